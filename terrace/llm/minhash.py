"""Near-duplicate removal by a signature-coordinate inverted join.

A document's set is its distinct 2-word shingles. Its signature has 40 coordinates, each the pair of the set's least values
under two hash orders. Documents are posted under each (coordinate, value); two sets of similarity s collide in a
coordinate with probability s * s. Two minima to a coordinate keep sets apart that share a common word pair or two. Pairs
of at least 8 collisions are candidates, and their whole sets are compared. A pair at the similarity of 0.8 itself, of 25.6
expected collisions, has fewer than 8 with probability 3e-9, nearer pairs hardly ever.

Counting is by prefix and skip merging. Posting lists are ordered by length; of a class's 40 postings only the
40 - 8 + 1 in the shortest lists are merged, as two signatures with 8 collisions have one of those in common. Lists of a
single class lead the order, so a set that collides with others in fewer than 8 coordinates has none left and drops out.
The long lists, common word pairs and the bulk of large groups, are skipped: for pairs met in a short list, collisions over
all coordinates are counted from the signatures, a byte a coordinate in five 64-bit words, inside the join. A byte may agree
where values differ, which only lets a pair through to the comparison of whole sets.

Groups of classes that share a short list go through links.py: pivots, components, and for what they leave in large groups an
exact join by single features. So a group of copies is never expanded into pairs, and no list is gathered in a task.

Defined results: as for the Jaccard join. Null and wordless texts have empty sets and are linked with nothing, and stay; equal
sets are one class and always link; repeated rows give a row each; a null id keeps its row, with its own null component
unless linked; a document stays if its id is its component's least; empty tables give no rows; very long texts
have their whole sets; lists of equal length are ordered by hash; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.links import BLOCK, BROADCAST_CLASSES, SMALL_GROUP, LinkedSets
from terrace.llm.shingles import U64, Sets, mix64, per_set

SHINGLE = 2
NUM, DEN = 4, 5
COORDINATES, MINIMA, MATCHES = 40, 2, 8
_SEED = mix64(np.arange(2 * MINIMA * COORDINATES, dtype=U64) + U64(0x5DEECE66D)).reshape(2, COORDINATES, MINIMA)
_FACTORS, _SHIFTS = _SEED[0] | U64(1), _SEED[1]


def signatures(sets: Sets) -> np.ndarray:
    """32-bit coordinates, a row a set: each from the least values under two orders."""
    out = np.zeros((len(sets.bounds) - 1, COORDINATES), np.uint32)
    for i in range(COORDINATES):
        value = np.zeros(len(out), U64)
        for j in range(MINIMA):
            value = mix64(value + per_set(sets.hashes * _FACTORS[i, j] + _SHIFTS[i, j], sets, np.minimum, 0))
        out[:, i] = value >> U64(32)
    return out


def _equal_bytes(u: str, v: str) -> str:
    """SQL for the number of bytes in which two 64-bit words agree."""
    x = f"({u} ^ {v})"
    for by in (4, 2, 1):
        x = f"({x} | shiftrightunsigned({x}, {by}))"
    return f"8 - bit_count({x} & {0x0101010101010101}L)"


class MinHashJoin(LinkedSets):
    """The join over one table."""

    width, num, den = SHINGLE, NUM, DEN
    own_columns = {"signature": "array<int>", **{f"m{i}": "long" for i in range(COORDINATES // 8)}}

    def __init__(self, spark: SparkSession, documents: DataFrame, broadcast_classes: int = BROADCAST_CLASSES, pivot_rounds: int = 1, small_group: int = SMALL_GROUP, block: int = BLOCK, matches: int = MATCHES):
        super().__init__(spark, documents, "minhash", broadcast_classes, pivot_rounds, small_group, block)
        self.matches = matches

    @staticmethod
    def _own(sets: Sets) -> list[pa.Array]:
        found = signatures(sets)
        short = mix64(found.astype(U64) + np.arange(COORDINATES, dtype=U64)).astype(np.uint8).view(np.int64)
        bounds = pa.array(np.arange(0, found.size + 1, COORDINATES, dtype=np.int32))
        return [pa.ListArray.from_arrays(bounds, pa.array(found.view(np.int32).ravel())), *(pa.array(short[:, i].copy()) for i in range(short.shape[1]))]

    @property
    def _bound_columns(self) -> list[str]:
        return [*super()._bound_columns, *(f"m{i}" for i in range(COORDINATES // 8))]

    def _near(self, u: str, v: str) -> Column:
        equal = " + ".join(_equal_bytes(f"{u}_m{i}", f"{v}_m{i}") for i in range(COORDINATES // 8))
        return F.expr(f"{equal} >= {self.matches}")

    def _candidates(self) -> DataFrame:
        """(sig, cls): the short lists that each class needs, with two classes or more."""
        posts = self.classes.select("cls", F.posexplode("signature").alias("i", "value")).select("cls", F.xxhash64("i", "value").alias("sig"))
        lists = posts.groupBy("sig").agg(F.count("*").alias("length")).filter("length > 1")
        shared = posts.join(lists, "sig")
        own = shared.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("length", "sig"))).alias("lists"))
        # Lists of the class alone come first; what they leave of the prefix goes to the shortest of the others.
        prefix = F.slice("lists", F.lit(1), F.greatest(F.lit(1 - self.matches) + F.size("lists"), F.lit(0)))
        merged = self.scratch.save(own.select("cls", F.explode(prefix).alias("list")).select(F.col("list.sig").alias("sig"), "cls"), "prefix")
        return self.scratch.save(self._one_of_equal(merged), "merged")


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, and whether it stays."""
    found = MinHashJoin(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).labels()
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 1], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS s FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
