"""The inverted join of signature coordinates against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import shingles
from pyspark.sql import functions as F
from test_jaccard import case

from terrace.llm import jaccard, minhash
from terrace.llm.shingles import shingle_sets


def components(texts: list, size: int, percent: int) -> list[int]:
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"pivot_rounds": 0, "small_group": 0, "block": 2}), (3, {"broadcast_classes": 0, "pivot_rounds": 2})])
def test_join_equals_all_pairs(spark, folder, seed, options):
    texts = case(seed)
    docs = spark.read.parquet(f"{folder([(100 + i, t) for i, t in enumerate(texts)])}/documents.parquet")
    got = {r["doc_id"]: r for r in minhash.MinHashJoin(spark, docs, **options).labels().collect()}
    want = components(texts, 2, 80)
    for i, t in enumerate(texts):
        assert (got[100 + i]["n_shingles"], got[100 + i]["component_id"]) == (len(shingles(t, 2)), 100 + want[i])


def test_query_handles_null_and_repeated_ids(spark, folder):
    text = " ".join(f"w{i}" for i in range(40))
    got = minhash.op12_minhash_dedup(spark, folder([(5, text), (5, text), (3, text + " end"), (None, None), (None, "alone"), (7, None), (8, " \t")])).collect()
    want = [(5, 39, 3, False), (5, 39, 3, False), (3, 40, 3, True), (None, 0, None, True), (None, 1, None, True), (7, 0, 7, True), (8, 0, 8, True)]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == sorted(w for w in want if w[0])
    assert sorted((r["n_shingles"], r["kept"]) for r in got if r["doc_id"] is None) == [(0, True), (1, True)]


def test_query_on_empty_table(spark, folder):
    assert minhash.op12_minhash_dedup(spark, folder([])).count() == 0


def test_chance_of_a_miss_is_as_stated():
    k, p, t = minhash.COORDINATES, 0.8**minhash.MINIMA, minhash.MATCHES
    assert sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(t)) < 1e-8


def test_coordinates_collide_as_often_as_similarity_says():
    rng = random.Random(4)
    for share in (0.3, 0.6, 0.8, 0.95):
        n, seen = 400, []
        common = round(2 * n * share / (1 + share))
        for _ in range(12):
            base = [f"a{rng.random()}" for _ in range(common)]
            texts = ["\n".join(base + [f"b{rng.random()}" for _ in range(n - common)]) for _ in range(2)]
            (sets,) = shingle_sets(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text", 1)
            one, two = minhash.signatures(sets)
            seen.append(float((one == two).mean()))
        assert np.mean(seen) == pytest.approx(share**minhash.MINIMA, abs=0.07)


def test_equal_bytes_are_counted(spark):
    rows = [(0, 0, 8), (-1, 0, 0), (0x0102030405060708, 0x0102030405060709, 7), (-(2**63), 0, 7), (0x00FF00FF00FF00FF, 0, 4)]
    got = spark.createDataFrame(rows, "u long, v long, n int").withColumn("got", F.expr(minhash._equal_bytes("u", "v"))).collect()
    assert all(r["n"] == r["got"] for r in got)


def near_misses(n: int, words: int, shared: int) -> list[str]:
    passage = [f"p{i}" for i in range(shared)]
    return [" ".join(passage + [f"own{d}x{i}" for i in range(words - shared)]) for d in range(n)]


@pytest.mark.parametrize(("make", "texts"), [(jaccard.JaccardJoin, lambda n: near_misses(n, 100, 86)), (minhash.MinHashJoin, lambda n: near_misses(n, 100, 88))])
def test_unlinked_texts_of_one_passage_are_not_paired(spark, folder, make, texts):
    """Similarity just below the threshold: what is compared grows with the number of texts, not with its square."""
    met = []
    for n in (150, 300):
        docs = spark.read.parquet(f"{folder(list(enumerate(texts(n))))}/documents.parquet")
        join = make(spark, docs)
        verified = join._verified
        pairs = []
        join._verified = lambda p, name, verified=verified, pairs=pairs: verified(pairs.append(p.count()) or p, name)
        labels = join.labels()
        assert labels.filter("component_id <> doc_id").count() == 0
        met.append(sum(pairs))
    assert met[1] <= 3 * max(met[0], n)
