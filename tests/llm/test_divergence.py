"""The divergence audit against dictionaries of counts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from brute import UPPER
from pyspark.sql import functions as F

from terrace.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(rows: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    """Rows (doc_id, text, lang, source) as the contract's rows."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(UPPER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][x] for x in kept)) for t in kept} for s in sources}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted(((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pairs), ("term", terms[:top])) for i, (item, value) in enumerate(found)]
    return out


def case(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "The", "é", "ÉCU", "naïve", "x", "日本", "a1b", "o'clock", "A_B", *(f"w{c}" for c in "abcdefghijklm")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["s", "t", "", None, "ž"])) for i in range(n)]
    return [*rows, (900, None, "en", "s"), (901, "", "de", "alone"), (902, "12 - 34", "de", "other"), (903, "once once once", "it", "s"), (rows[0]), (rows[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_plain_counts(spark, folder, seed):
    rows = case(seed)
    got = divergence.op11_divergence_audit(spark, folder(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(audit(rows))


def test_query_on_empty_and_termless_tables(spark, folder):
    assert divergence.op11_divergence_audit(spark, folder([])).count() == 0
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "7", None, None)]
    assert sorted(map(tuple, divergence.op11_divergence_audit(spark, folder(rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_terms_rank_to_200_and_ties_by_bytes(spark, folder):
    words = ["".join("abcdefghijklmnopqrstuvwxyz"[int(d)] for d in f"{i:03d}") for i in range(260)]
    rows = [(i, " ".join(words), "en", "many") for i in range(3)] + [(9, "zz", "en", "few"), (10, "zz", "en", "few"), (11, "zz", "en", "few")]
    got = divergence.op11_divergence_audit(spark, folder(rows)).filter("source = 'many' and part = 'term'").orderBy("rank").collect()
    assert [r["item"] for r in got] == sorted(words)[:200] and [r["rank"] for r in got] == list(range(1, 201))


def test_histograms_of_many_blocks_sum_to_the_terms_and_without_broadcast(spark, folder):
    rows = [(i, " ".join("w" + "abcdefghij"[j] for j in range(10) if (i * 7 + j) % 3), "en", f"s{i % 9}") for i in range(90)]
    docs = spark.read.parquet(f"{folder(rows)}/documents.parquet")
    small = divergence.DivergenceAudit(spark, docs, block=2, broadcast_rows=0)
    sums = small.joint_histograms().groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("k").alias("least")).collect()
    assert {(r["a"], r["b"]) for r in sums} == {(a, b) for a in range(9) for b in range(a + 1, 9)}
    assert {r["k"] for r in sums} == {10} and min(r["least"] for r in sums) >= 0
    want = [r for r in audit(rows) if r[2] == "pair"]
    assert {(r["source"], r["item"]): r["value"] for r in small.pairs().collect()} == {(r[1], r[3]): r[4] for r in want}


def test_a_task_sums_before_it_gives_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 10)
    rows = case(5, 60)
    docs = spark.read.parquet(f"{folder(rows)}/documents.parquet")
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"text": r["text"] or "", "lang": r["lang"] or "", "source": r["source"] or ""} for r in docs.collect()])]
    counted = pa.Table.from_batches(list(divergence._counted(iter(batches)))).to_pylist()
    groups = {(r["lang"] or "", r["source"] or "") for r in docs.collect()}
    assert {(r["lang"], r["source"]) for r in counted if r["term"] is None} == groups
    total = Counter()
    for r in counted:
        if r["term"] is not None:
            total[r["term"]] += r["n"]
    want = Counter(t for _, text, _, _ in rows for t in TERM.findall((text or "").translate(UPPER)))
    assert total == want


def _batches(rows: list[tuple]) -> list:
    """One Arrow batch for each row (text, lang, source)."""
    import pyarrow as pa

    return [pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), row, strict=True))]) for row in rows]


def test_a_task_gives_a_term_once_while_sums_stay_few(monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 100)
    rows = [("the quick brown fox sees the lazy dog", "en", f"s{i % 2}") for i in range(400)]
    given = [r for b in divergence._counted(iter(_batches(rows))) for r in b.to_pylist() if r["term"] is not None]
    assert len(given) == 14 and {(r["n"], r["docs"]) for r in given if r["term"] == "the"} == {(400, 200)}


def test_a_task_gives_long_terms_before_they_fill_it(monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH_BYTES", 5_000, raising=False)
    taken = []
    source = (taken.append(1) or b for b in _batches([(chr(97 + i % 26) * (400 + i), "en", "s") for i in range(100)]))
    given, first = [], None
    for batch in divergence._counted(source):
        first = first or len(taken)
        given += [r["term"] for r in batch.to_pylist() if r["term"] is not None]
    assert first < 20 and sorted(map(len, given)) == list(range(400, 500))


def test_rows_of_tasks_are_shuffled_once(spark):
    rows = spark.createDataFrame([("en", 0, "a", 3, 2), ("en", 0, "a", 4, 1), ("en", 2, "a", 1, 1), ("en", 1, "b", 9, 2)], "lang string, no int, term string, n long, docs long")
    counted = divergence.term_counts(rows, 3)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    assert [r.asDict(recursive=True) for r in counted.collect()] == [{"lang": "en", "term": "a", "lang_n": 8, "held": [{"no": 0, "n": 7}, {"no": 2, "n": 1}]}]
