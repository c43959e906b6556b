"""The Merkle manifest against a plain tree, and proofs that hold and fail."""

import zlib
from collections import defaultdict

import pytest
from brute import UPPER, sha256
from pyspark.sql import functions as F

from terrace.llm import merkle


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def level_up(nodes: list[str], fanout: int) -> list[str]:
    return [sha256("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def climb(nodes: list[str], at: int, fanout: int) -> list[tuple[str, str]]:
    """(left, right) of a leaf by level, up to the root of its tree."""
    steps = []
    while len(nodes) > 1:
        run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
        steps.append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        nodes, at = level_up(nodes, fanout), at // fanout
    return steps


def root_of(nodes: list[str], fanout: int) -> str:
    while len(nodes) > 1:
        nodes = level_up(nodes, fanout)
    return nodes[0]


def manifest(rows: list[tuple], fanout: int = 16) -> list[tuple]:
    """Rows (doc_id, source, lang, n_chars, text) as the contract's rows."""
    leaves = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        altered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = sha256("".join(map(field, (doc_id, source, lang, n_chars, text))))
        held = sha256("".join(map(field, (doc_id, source, lang, n_chars, text.translate(UPPER) if altered and text is not None else text))))
        leaves[source].append((doc_id, leaf, held))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        leaves[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [root_of([x[1] for x in leaves[s]], fanout) for s in order]
    root, out = root_of(tops, fanout) if tops else None, []
    for i, source in enumerate(order):
        own = [x[1] for x in leaves[source]]
        for at, (doc_id, leaf, held) in enumerate(leaves[source]):
            steps = climb(own, at, fanout) + climb(tops, i, fanout)
            node = held
            for left, right in steps:
                node = sha256(left + node + right)
            out.append((doc_id, leaf, tops[i], root, sha256("".join(a + b for a, b in steps)), node, node == root))
    return out


def documents(seed: int, sizes: dict) -> list[tuple]:
    rows, i = [], seed
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 10007, f"Text {i} É\n" if i % 4 else f"lower {i}", None if i % 6 == 0 else "en", source))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"a": 300, None: 5, "": 1, "č": 2, "Z": 33}, {f"s{i}": 1 + i % 3 for i in range(20)}])
def test_query_equals_a_plain_tree(spark, folder, sizes):
    rows = documents(len(sizes), sizes)
    rows += [(None, "No id", "en", "a"), (None, None, None, "a"), (77, "Same", "en", "a"), (77, "Same", "en", "a"), (77, "Other", "en", "a"), (5, "", "en", "a"), (6, "Long " * 30_000, "en", "a")]
    got = merkle.op13_merkle_manifest(spark, folder(rows))
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = manifest([(d, s, lang, len(t) if t is not None else None, t) for d, t, lang, s in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(not r[6] for r in want) or len(rows) < 12


def test_empty_table(spark, folder):
    assert merkle.op13_merkle_manifest(spark, folder([])).count() == 0


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts_and_positions_joined_without_broadcast(spark, folder, fanout):
    rows = documents(3, {"a": 29, "b": 8, "c": 1})
    docs = spark.read.parquet(f"{folder(rows)}/documents.parquet")
    made = merkle.MerkleManifest(spark, docs, fanout=fanout, broadcast_rows=0)
    found = made.proofs().select("doc_id", "leaf", "subroot", merkle.folded(F.col("leaf"), F.col("path")).alias("root"), merkle.siblings_digest(F.col("path")).alias("proof")).collect()
    want = {(r[0], r[1]): (r[2], r[3], r[4]) for r in manifest([(d, s, lang, len(t), t) for d, t, lang, s in rows], fanout)}
    assert {(r["doc_id"], r["leaf"]): (r["subroot"], r["root"], r["proof"]) for r in found} == want
    assert {r["root"] for r in found} == {made.root}


def test_a_hot_source_is_many_runs(spark):
    """No run or node of one source is gathered: ranges split it, and runs hold at most the fanout."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text")).repartition(6)
    made = merkle.MerkleManifest(spark, docs)
    assert [lv.count() for lv in made.levels] == [250, 16, 1]
    assert made.levels[0].agg(F.max(F.length("digests"))).first()[0] == 16 * merkle.WIDTH
    assert made.levels[0].agg(F.max("pos"), F.count_distinct("pos")).first()[:] == (249, 250)
