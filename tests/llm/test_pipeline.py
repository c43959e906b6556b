"""Each stage of the pipeline on its own input, against plain Python where that can express it."""

import random

import corpus_pipeline as cp
from brute import contamination, jaccard_components, personal, targets, words

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards box"


def documents():
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choices(["ka", "ro", "ti", "mu", "se"], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 60)))
    rows = [(i, text(), "aa", "ab"[i % 4 == 0]) for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" tail" if i % 2 else ""), "aa", "c") for i in range(10)]
    rows += [(300, f"{text()} {ITEM.upper()}! {text()}", "aa", "a"), (301, "12 34", "aa", "a"), (302, None, None, None), (303, "", "aa", "a"), (304, f"{text()} me@x.org {text()} 10.0.0.1", "aa", None)]
    return rows + [rows[5], (None, text(), "aa", "a"), (5, text(), "aa", "b")]


def test_stages_and_run(spark, folder):
    rows = documents()
    sf = folder(rows, benchmark=[(1, ITEM), (2, None)], labels=[(i, i % 2, 0) for i in range(50)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for _, stage in cp.STAGES:
        docs = cp.Scratch(spark, "test").save(stage(spark, docs, sf), "out")
        seen.append([r.asDict() for r in docs.collect()])
        assert docs.columns[:5] == list(cp.COLUMNS)
    assert all(set(r) == set(cp.COLUMNS) for r in seen[0])
    language, unique, clean, redacted, mixed = seen

    ids = lambda part: sorted((r["doc_id"] for r in part), key=repr)
    assert ids(language) == sorted((r[0] for r in rows if r[0] not in (301, 302, 303)), key=repr)

    texts = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in language})
    roots = jaccard_components([t for *_, t in texts])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in unique) == sorted({texts[root] for root in roots})
    assert ids(unique).count(5) == 2 and ids(unique).count(None) == 1

    assert ids(clean) == sorted((r["doc_id"] for r in unique if not contamination(r["text"], [(1, ITEM)])[1]), key=repr)
    assert 300 in ids(unique) and 300 not in ids(clean)

    before = {(r["doc_id"], r["text"]) for r in clean if not personal(r["text"])}
    assert before <= {(r["doc_id"], r["text"]) for r in redacted} and ids(redacted) == ids(clean)
    assert all(not personal(r["text"]) and r["n_chars"] == len(r["text"]) for r in redacted)
    assert next(r["text"] for r in redacted if r["doc_id"] == 304).split()[-1] == "<IP>"

    sizes = {}
    for r in redacted:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    want = targets(sizes)
    for source in sizes:
        assert abs(sum(r["taken"] for r in mixed if r["source"] == source) - want[source]) < 1
    assert all(0 < r["taken"] <= 3 * r["size"] for r in mixed) and set(ids(mixed)) <= set(ids(redacted))

    assert sorted(map(repr, (r.asDict() for r in cp.run(spark, sf).collect()))) == sorted(map(repr, mixed))


def test_run_on_empty_tables(spark, folder):
    assert cp.run(spark, folder([])).count() == 0


def test_mix_takes_by_row_where_ids_repeat(spark, folder):
    """Several null ids and repeated ids and texts: words taken meet the target, none counted twice."""
    rows = [(None, "a b", "aa", "x"), (None, "a b c d e f", "aa", "x"), (7, "one two three", "aa", "x"), (7, "one", "aa", "x"), (7, "one", "aa", "x"), *[(i, "w " * (i % 5 + 1), "aa", "y") for i in range(20)]]
    sf = folder(rows, labels=[(7, 1, 0), (3, 0, 0)])
    got = cp.mix_sources(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    sizes = {"x": 13, "y": sum(i % 5 + 1 for i in range(20))}
    want = targets(sizes)
    assert all(r["size"] == len(words(r["text"])) and r["taken"] <= 3 * r["size"] for r in got)
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) < 1


def test_mix_moves_no_texts_for_labels(spark, folder):
    """Texts meet the labels without a shuffle, though the session would not broadcast any table by itself; beyond the limit rows are the same."""
    sf = folder([(i, f"text {i} " * 400, "aa", "ab"[i % 2]) for i in range(200)], labels=[(i, i % 2, 0) for i in range(150)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    saved = []
    save = cp.Scratch.save

    def kept(self, df, name):
        saved.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return save(self, df, name)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cp.Scratch.save = kept
    try:
        few = sorted(map(repr, cp.mix_sources(spark, docs, sf).collect()))
        plan = next(p for name, p in saved if name == "sized")
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        limit, cp.BROADCAST_LABELS = cp.BROADCAST_LABELS, 10
        try:
            assert sorted(map(repr, cp.mix_sources(spark, docs, sf).collect())) == few
        finally:
            cp.BROADCAST_LABELS = limit
    finally:
        cp.Scratch.save = save
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
