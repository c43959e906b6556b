"""Decontamination, mixing, URL filter and PII against plain Python."""

import random
import time
from datetime import date, timedelta

import pytest
from brute import clean_words, contamination, personal, sha256, targets, words
from pyspark.sql import functions as F

from terrace.llm import decontaminate as dc
from terrace.llm import mixing, pii, urls

EDGES = [(None, None), (None, "a b"), (901, None), (902, ""), (903, " \n\t "), (904, "...!?"), (905, "x"), (905, "x"), (905, "other words here")]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Benchmark decontamination


def decontamination_case():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([14, 10, 11, 3, 2, 1, 25, 12])]
    items += [(3, "Extra, ITEM of-an id that repeats and has ten words at least"), (20, None), (21, "..."), (22, items[0][1])]
    texts = [items[rng.randrange(8)][1].upper() + "! " + " ".join(rng.choices(vocabulary, k=rng.randrange(30))) for _ in range(30)]
    texts += [" ".join(rng.choices(vocabulary, k=4000)), " ".join([items[1][1]] * 40), "é-Ü " + items[2][1] + "é"]
    return list(enumerate(texts)) + EDGES, items


@pytest.mark.parametrize("block", [50_000, 3])
def test_decontaminate_equals_brute_force(spark, folder, block):
    documents, items = decontamination_case()
    sf = folder(documents, items)
    found = dc.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), block_windows=block)
    want = sorted(((i, *contamination(t, items)) for i, t in documents), key=repr)
    assert rows(found, "doc_id", "n_words", "n_hit", "items") == want


def test_decontaminate_keeps_many_copies(spark, folder):
    sf = folder([(1, "a b c")] * 9000 + [(2, "b")], [(1, "a b c")])
    got = dc.op2_decontaminate(spark, sf).groupBy("doc_id", "n_hit", "contaminated").count().collect()
    assert sorted(map(tuple, got)) == [(1, 3, True, 9000), (2, 0, False, 1)]


def test_decontaminate_query(spark, folder):
    documents, items = decontamination_case()
    got = dc.op2_decontaminate(spark, folder(documents[:10], items)).collect()
    for r in got:
        n, hit, found = contamination(documents[r["doc_id"]][1], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), sha256(",".join(found)), hit > 0)


def test_decontaminate_empty_tables(spark, folder):
    assert dc.op2_decontaminate(spark, folder([], [(1, "a b c")])).count() == 0
    assert rows(dc.op2_decontaminate(spark, folder([(1, "a b c")])), "doc_id", "n_words", "n_hit", "contaminated") == [(1, 3, 0, False)]


def test_words_split_as_stated(spark):
    text = "It's 3.5 ÄB_cd x İ"
    assert spark.range(1).select(dc.words_of(F.lit(text)).alias("w")).first()["w"] == clean_words(text)


# Mixing


def mixing_case():
    rng = random.Random(9)
    documents = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80])), "aa", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    documents += [(900, "long " * 5000, "aa", "b"), (901, None, "aa", "e"), (None, "x y", "aa", "a"), (None, "x y", "aa", "a"), (902, "one", "aa", "tiny")]
    labels = [(i, i % 2, 0) for i in range(0, 400, 3)] + [(3, 1, 0), (None, 1, 0), (6, None, None)]
    return documents, labels


def test_mix_meets_targets(spark, folder):
    documents, labels = mixing_case()
    query = mixing.op4_mix(spark, folder(documents, labels=labels))
    got = rows(query, "doc_id", "size", "source_size", "target", "taken")
    assert got == rows(query, "doc_id", "size", "source_size", "target", "taken")
    assert len(got) == len(documents)
    source = {d[0]: d[3] for d in documents}
    sizes = {}
    for d in documents:
        sizes[d[3]] = sizes.get(d[3], 0) + len(words(d[1]))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for doc_id, size, source_size, target, n in got:
        s = source[doc_id]
        assert source_size == sizes[s] and target == pytest.approx(want[s]) and 0 <= n <= 3 * size
        taken[s] += n
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mix_takes_whole_epochs_first_and_better_documents_more_often(spark, folder):
    documents = [(i, "w w w w", "aa", "ab"[i >= 600]) for i in range(2060)]
    labels = [(i, i % 2, 0) for i in range(2060)]
    got = mixing.op4_mix(spark, folder(documents, labels=labels)).collect()
    target = {r["doc_id"] < 600: r["target"] / r["source_size"] for r in got}
    for r in got:
        epochs = int(target[r["doc_id"] < 600])
        assert epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"]
    share = [sum(r["taken"] for r in got if r["doc_id"] % 2 == q and r["doc_id"] >= 600) for q in (0, 1)]
    assert share[1] > 1.2 * share[0]


def test_mix_of_many_sources_is_joined_alike(spark, folder):
    documents, labels = mixing_case()
    sf = folder(documents, labels=labels)
    sized = mixing.sized_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    columns = ("doc_id", "source", "size", "source_size", "target", "taken")
    assert rows(mixing.mix(sized, broadcast_sources=0), *columns) == rows(mixing.mix(sized), *columns)


def test_mix_single_source_and_no_words(spark, folder):
    assert rows(mixing.op4_mix(spark, folder([(1, "a b"), (2, "c")])), "doc_id", "taken") == [(1, 2), (2, 1)]
    assert rows(mixing.op4_mix(spark, folder([(1, None, None, "a"), (2, "", None, "b")])), "doc_id", "taken", "target") == [(1, 0, 0.0), (2, 0, 0.0)]
    assert mixing.op4_mix(spark, folder([])).count() == 0


def test_mix_bins_are_small_whatever_the_quality(spark):
    """No bin that is sorted holds more than a small share of a source, at the least quality too."""
    for quality in (1.0, 0.25, mixing.LEAST_QUALITY):
        key = -F.log(mixing.uniform(F.col("id"), "s")) / quality
        fine = spark.range(60_000).select(F.floor(F.log2(key) * mixing.FINE).alias("fine"))
        coarse = fine.groupBy(F.floor(F.col("fine") / (mixing.FINE // mixing.COARSE))).count().agg(F.max("count")).first()[0]
        assert coarse < 0.004 * 60_000 and fine.groupBy("fine").count().agg(F.max("count")).first()[0] <= 3


def test_mix_keeps_columns_whose_names_clash(spark):
    names = ["budget", "epochs", "chosen", "start", "key", "fine", "goal_source", "cut_bin", "salt", "row", "target"]
    data = [(i, "ab"[i % 3 == 0], 5 + i % 7, 0.01, *["mine"] * len(names)) for i in range(50)]
    sized = spark.createDataFrame(data, "doc_id long, source string, size long, quality double, " + ", ".join(f"{n} string" for n in names))
    for few in (0, 100):
        got = mixing.mix(sized, broadcast_sources=few)
        assert got.columns == ["doc_id", "source", "size", "quality", *names[:-1], "source_size", "target", "taken"]
        assert all(r["budget"] == r["row"] == "mine" and r["target"] > 1 for r in got.collect())


def test_targets_of_many_sources_equal_brute_force(spark):
    rng = random.Random(6)
    sizes = {f"s{i:03}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(300)} | {None: 77, "\U0001F600": 5, "\uffee": 9}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


# URL filters


def url_brute(captures, entries):
    out = []
    for page, url, day in sorted(set(captures), key=repr):
        host = None
        if url and "://" in url:
            host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].rsplit("@", 1)[-1].split(":")[0].lower().rstrip(".") or None
        best = None
        labels = host.split(".") if host else []
        for k in range(max(len(labels) - 1, 1) if labels else 0):
            name = ".".join(labels[k:])
            held = [(since, action) for pattern, action, since in entries if pattern and action and since and pattern.lower() == name and day and since <= day]
            if held:
                since, action = max(held)
                best = (name, action, since)
                break
        out.append((page, url, day, host, *(best or (None, None, None)), bool(best and best[1] == "block")))
    return sorted(out, key=repr)


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(1)
    day = lambda n: date(2023, 1, 1) + timedelta(n)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "B.org.", "host", "a.com:80", "me@b.org"]
    captures = [(i, f"https://{rng.choice(hosts)}/p?q", day(rng.randrange(400))) for i in range(200)]
    captures += [(500, None, day(5)), (501, "no url", day(5)), (502, "http://a.com", None), (None, "http://b.org", day(300)), captures[0], (503, "http:///x", day(1))]
    entries = [(rng.choice(["a.com", "x.a.com", "b.org", "host", "com"]), rng.choice(["block", "allow"]), day(rng.randrange(400))) for _ in range(40)]
    entries += [(None, "block", day(1)), ("a.com", None, day(1)), ("a.com", "block", None), entries[0], ("b.org", "allow", day(100)), ("b.org", "block", day(100))]
    made = urls.filter_urls(spark.createDataFrame([(*c, "x") for c in captures], "page_id long, url string, fetched date, host string"), spark.createDataFrame([(*e, 1) for e in entries], "pattern string, action string, listed_at date, until int"))
    assert rows(made, "page_id", "url", "fetched", "host", "pattern", "action", "since", "blocked") == url_brute(captures, entries)


def test_url_filter_empty_tables(spark):
    pages = "page_id long, url string, fetched date"
    entries = "pattern string, action string, listed_at date"
    one = spark.createDataFrame([(1, "http://a.com", date(2024, 1, 1))], pages)
    assert urls.filter_urls(spark.createDataFrame([], pages), spark.createDataFrame([("a.com", "block", date(2023, 1, 1))], entries)).count() == 0
    assert rows(urls.filter_urls(one, spark.createDataFrame([], entries)), "page_id", "pattern", "blocked") == [(1, None, False)]


def test_addresses_as_hosts(spark):
    cases = {"http://[2001:db8::1]:80/x": ["[2001:db8::1]"], "https://u@10.1.2.3/": ["10.1.2.3"], "http://a.b.c.d": ["a.b.c.d", "b.c.d", "c.d"], "http://1.2.3.4.5/": ["1.2.3.4.5", "2.3.4.5", "3.4.5", "4.5"]}
    got = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urls.suffixes(urls.host_of(F.col("url"))).alias("s")).collect()
    assert {r["url"]: r["s"] for r in got} == cases


# Personal data

TEXTS = [
    "mail me: a.b@c.de, or x@y.z@q.com and a@b", "@@a.b a@.b a@b..c a@b.c. +1@x-y.zz", "1.2.3.4 256.1.1.1 1.2.3.4.5 1.2.3.4.5.6.7.8 001.02.3.255",
    "call +49 (30) 123-456 78 or +1 23 and ++4930123456789 +49.30.1234567", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559",
    "é😀 a@b.cd 😀 +420 777 123 456 ü 10.0.0.1", "1" * 400 + " " + "a" * 5000 + "@", "4111 1111 1111 1111 4111 1111 1111 1111", "+" * 50, "1.1.1.1.1.1.1", "a@b.c-d.e@f.g", "%+-._@x.y",
]


def random_texts(n):
    rng = random.Random(21)
    return ["".join(rng.choice("0123456789..-- ()+@abZ%_é\n") for _ in range(rng.randrange(120))) for _ in range(n)]


def test_pii_base_spans_equal_plain_regular_expressions(spark, folder):
    texts = TEXTS + random_texts(400) + ["lorem " * 3000 + "x@y.zz " + "1 " * 3000]
    documents = list(enumerate(texts)) + EDGES
    got = pii.op7_pii(spark, folder(documents)).collect()
    assert len(got) == len(documents)
    for r in got:
        options = {sha256(",".join(f"{k}:{a}:{b}" for k, a, b in personal(t))): (t, personal(t)) for i, t in documents if i == r["doc_id"]}
        text, base = options[r["base_sha256"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert set(base) <= set(spans) and all(0 <= a < b <= len(text or "") for _, a, b in spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def pii_corpus(n: int, seed: int):
    """Prose with personal data in base forms, and with numbers and marks that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def card() -> str:
        while True:
            d = "4" + digits(15)
            if personal(d):
                return d

    def other() -> str:
        return rng.choice([f"in {rng.randrange(1900, 2100)}", f"order {digits(7)}", f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"', f"version {rng.randrange(9)}.{rng.randrange(99)}", f"{digits(3)} of {digits(4)}", "look at example.com", "at the dot", f"{rng.randrange(24)}:30", "5" + digits(15)])

    make = {
        "email": lambda: f"{rng.choice(['ann', 'bob.k', 'c_d'])}.{digits(2)}@mail{digits(1)}.example.org",
        "ip": lambda: ".".join(str(rng.randrange(10, 256)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+{rng.randrange(1, 90)} ({digits(3)}) 555-{digits(4)}",
    }
    words = lambda: " ".join(rng.choices(["mira", "tolo", "senda", "kru", "palo,", "vex."], k=rng.randint(3, 20)))
    return rng, make, other, words, digits


@pytest.fixture(scope="module")
def redactor(spark):
    rng, make, other, words, _ = pii_corpus(3000, 4)
    texts = [" ".join([words(), make[rng.choice(pii.KINDS)](), words(), other(), words()]) for _ in range(3000)]
    return pii.Redactor.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_pii_finds_planted_forms_that_the_base_misses(spark, redactor):
    """Recall on forms in texts of other draws, and texts without personal data left alone."""
    rng, make, other, words, digits = pii_corpus(0, 77)
    forms = {
        "email": [lambda v: v.replace("@", " @ "), lambda v: v.replace("@", "[at]"), lambda v: v.split("@")[0] + " at " + v.split("@")[1].replace(".", " dot ")],
        "ip": [lambda v: v.replace(".", "[.]"), lambda v: v.replace(".", " . ")],
        "card": [lambda v: ".".join(v[i : i + 4] for i in range(0, 16, 4)), lambda v: "7536784127813051 " + v],
        "phone": [lambda v: v[1:], lambda v: v[v.index("(") :], lambda v: v + " 7536784127813051"],
    }
    rows, want = [], {}
    for i in range(600):
        kind = pii.KINDS[i % 4]
        value = make[kind]()
        form = rng.choice(forms[kind])(value)
        at = {"7": 17}.get(form[0], 0) if kind == "card" else 0
        end = len(form) - (17 if kind == "phone" and form.endswith("051") and "7536784127813051" in form else 0)
        before = words() + " "
        rows.append((i, before + form + " " + words()))
        want[i] = (i % 4, len(before) + at, len(before) + end)
    clean = [(1000 + i, " ".join([words(), other(), words(), other(), words()])) for i in range(300)]
    clean = [(i, t) for i, t in clean if not personal(t)]
    got = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} for r in redactor.with_spans(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    for k in range(4):
        own = [i for i in want if want[i][0] == k]
        assert sum(want[i] in got[i] for i in own) >= 0.9 * len(own), pii.KINDS[k]
    assert sum(bool(got[i]) for i, _ in clean) <= 0.01 * len(clean)


def test_pii_without_base_spans_adds_nothing(spark):
    documents = spark.createDataFrame([(1, "card 4111.1111.1111.1111 or a @ b.cd"), (2, None)], "doc_id long, text string")
    fitted = pii.Redactor.fit(documents)
    assert fitted.thresholds == [None] * 4
    assert [r["spans"] for r in fitted.with_spans(documents).collect()] == [[], []]


def test_pii_sweeps_equal_plain_comparison(spark, redactor):
    """Spans added meet no base span nor each other, and all that meets no other is kept; over more spans than a chunk."""
    rng, make, other, words, _ = pii_corpus(0, 5)
    texts = [" ".join(rng.choice([make[rng.choice(pii.KINDS)](), other(), make["phone"]()[1:], make["phone"]() + " " + make["card"]()]) for _ in range(n)) for n in (0, 1, 5, 40, 400)]
    documents = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    met = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
    found = redactor.with_spans(documents).withColumn("p", pii.proposals(F.col("text"))).withColumn("free", pii.free_of(F.col("p"), F.col("base"))).withColumn("cut", pii.redact(F.col("text"), F.col("spans")))
    for r in found.collect():
        base = [s.asDict() for s in r["base"]]
        free = [(p["start"], p["end"]) for p in r["p"] if not any(met(p, b) for b in base)]
        assert sorted((p["start"], p["end"]) for p in r["free"]) == sorted(free)
        added = [s.asDict() for s in r["spans"] if s.asDict() not in base]
        assert not any(met(a, b) for a in added for b in base) and not any(met(a, b) for i, a in enumerate(added) for b in added[:i])
        data = r["text"].encode()
        assert all(data[s["from"] : s["to"]].decode() == r["text"][s["start"] : s["end"]] for s in r["spans"])
        out, at = "", 0
        for s in sorted(r["spans"], key=lambda s: (s["from"], s["to"], s["kind"])):
            if s["start"] >= at:
                out += r["text"][at : s["start"]] + f"<{pii.KINDS[s['kind']].upper()}>"
            at = max(at, s["end"])
        assert r["cut"] == out + r["text"][at:]


def test_pii_time_follows_the_length(spark, redactor):
    """Eight times the numbers take about eight times as long, not sixty-four."""
    took = []
    for n in (4_000, 32_000):
        text = " ".join(f"10.0.{i % 256}.7 x {i % 7}" for i in range(n))
        documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = redactor.with_spans(documents).select(F.size("spans").alias("n"), F.char_length(pii.redact(F.col("text"), F.col("spans"))).alias("m"))
        begun = time.perf_counter()
        assert found.first()["n"] == n
        took.append(time.perf_counter() - begun)
    assert took[1] < 24 * took[0]


def test_pii_redaction(spark):
    documents = spark.createDataFrame([(1, "é a@b.cd x 10.0.0.1!", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, base int")
    found = pii.Redactor([[]] * 4, [None] * 4).with_spans(documents.drop("base"))
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é <EMAIL> x <IP>!", 2: None, 3: ""}


def test_pii_empty_table(spark, folder):
    assert pii.op7_pii(spark, folder([])).count() == 0
