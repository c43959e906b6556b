"""Exact n-gram Jaccard join with PartEnum signatures.

Sets are the distinct 5-word shingles of whole texts. Sizes fall into bands that grow fourfold; a set takes part in its
own band and, where a partner may lie there, in the next. For a band the feature domain is partitioned into blocks by
hash, and the blocks are dealt into groups of g. In each group all subsets of g - s blocks are enumerated; a signature is
the hash of a set's features in one of them, none if there are none, and each content of a group counts once. Two sets of
Jaccard similarity 0.75 and sizes a, b differ in at most k = (a + b) / 7 features, so in at most k blocks, and of the
signatures of a group with q such blocks at most C(g, s) - C(g - q, s - q) are lost, all if q > s. The most that k blocks can
spoil, m, follows for each set from what its groups hold. Of its signatures a set needs only the first m + 1 in an order
all sets share; that order is by rarity, from a fixed-size table of hashed feature counts over the whole corpus, so common
lines and passages seldom make candidates. Any order is exact. Sets with no more than m signatures in all, such as few
features in one block, add their first k + 1 single features: two similar sets without a common signature are both such.
Production has g = 3 and s = 1 (pairs out of three blocks).

The jobs: one pass over the texts gives sizes, set hashes, sketches and feature counts (see links.py). A second emits
signatures, packed into binary blocks by bucket; a bucket keeps those that two classes share. Signatures that the counts
show to be very frequent skip the buckets, so no bucket holds one hot group. Of signatures that the very same classes share,
one stays. The groups of classes that share a signature are then joined into components as links.py says: by pivots, and
what those leave in large groups by single features, each for partners of the sizes it can serve.

Defined results: null and wordless texts have empty sets and are linked with nothing; repeated rows give a row each;
a null id keeps its row, with its own null component unless linked; equal sets link even at one shingle; empty tables
give no rows; very long texts have their whole sets; ties in rarity are broken by hash; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import tidy
from terrace.llm.links import BLOCK, BROADCAST_CLASSES, SMALL_GROUP, LinkedSets, class_ids, counted
from terrace.llm.shingles import U64, mix64, shingle_sets

SHINGLE = 5
#: Similarity as a fraction: links hold if DEN * intersection >= NUM * union.
NUM, DEN = 3, 4
FIRST_BAND, BAND_GROWTH, FEATURES_PER_BLOCK = 32, 4, 1.5
#: Blocks of a group, and how many of them a signature leaves out.
GROUP, SPOILED = 3, 1
#: Signatures counted more often than this are joined by Spark alone; a bucket has about BUCKET_ROWS signatures.
HOT_COUNT, BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 500_000, 64
EMIT_ROWS = 300_000
_BY_FEATURE = 0xA0761D6478BD642F


def band_of(size: int) -> int:
    band, top = 0, FIRST_BAND
    while size > top:
        band, top = band + 1, top * BAND_GROWTH
    return band


@cache
def _enumerated(group: int, spoiled: int) -> tuple[np.ndarray, np.ndarray]:
    """The subsets of a group's blocks, and how many of them 0, 1, .. spoiled + 1 differing blocks can take."""
    subsets = np.array(list(combinations(range(group), group - spoiled)))
    return subsets, np.array([len(subsets) - (math.comb(group - q, spoiled - q) if q <= spoiled else 0) for q in range(spoiled + 2)])


def _signatures(hashes: np.ndarray, rarity: np.ndarray, band: int, group: int = GROUP, spoiled: int = SPOILED) -> tuple[np.ndarray, np.ndarray]:
    """The needed signatures of one set in a band, and the rarity of each (the least of its features)."""
    size = len(hashes)
    differ = (size + size * DEN // NUM) * (DEN - NUM) // (DEN + NUM)
    subsets, taken = _enumerated(group, spoiled)
    groups = max(1, round(FIRST_BAND * BAND_GROWTH**band / FEATURES_PER_BLOCK / group))
    # Blocks by multiplication: features in order of their hash are then in order of their block.
    block = (hashes >> U64(32)) * U64(groups * group) >> U64(32)
    first = np.flatnonzero(np.diff(block, prepend=block[:1] + U64(1)))
    place = block[first].astype(np.int64)
    row = np.cumsum(np.diff(place // group, prepend=place[0] // group) != 0)
    # Groups that hold features, by block; the content of an empty block is 0.
    held = np.zeros((row[-1] + 1, group), U64)
    held[row, place % group] = np.add.reduceat(mix64(hashes), first)
    least = np.full(held.shape, 255, rarity.dtype)
    least[row, place % group] = np.minimum.reduceat(rarity, first)
    content, rank = held[:, subsets].sum(axis=2), least[:, subsets].min(axis=2)
    order = np.argsort(content, axis=1)
    content, rank = np.take_along_axis(content, order, axis=1), np.take_along_axis(rank, order, axis=1)
    kept = content != 0
    kept[:, 1:] &= content[:, 1:] != content[:, :-1]
    lost = np.diff(np.minimum(kept.sum(axis=1)[:, None], taken), axis=1)
    most = int(np.sort(lost, axis=None)[::-1][:differ].sum())
    tag = (band + 1) * 0xD6E8FEB86659FD93
    signatures, rank = mix64(content[kept] + U64(tag % (1 << 64))), rank[kept]
    if len(signatures) > most:
        chosen = np.lexsort((signatures, rank))[: most + 1]
        return signatures[chosen], rank[chosen]
    single = np.lexsort((hashes, rarity))[: differ + 1]
    return np.concatenate([signatures, mix64(hashes[single] + U64((tag + _BY_FEATURE) % (1 << 64)))]), np.concatenate([rank, rarity[single]])


def _emit(rarity_table, buckets: int, hot: int, group: int, spoiled: int):
    """Signatures of all classes of a task: packed by bucket, or as plain rows where they may be very frequent."""
    names = ["bucket", "sigs", "classes", "sig", "cls"]
    hot_rank = min(4 * np.log2(hot), 254)

    def pack(sigs: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sigs)
        sigs, classes = sigs[order], classes[order]
        bucket = ((sigs >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        for part in np.array_split(full, max(1, len(sigs) // 200_000)):
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([(sigs[edges[b] : edges[b + 1]] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() for b in part], pa.binary()), pa.array([classes[edges[b] : edges[b + 1]].tobytes() for b in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64())], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity_table.value
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for sets in shingle_sets(batch, "text", SHINGLE):
                ids = class_ids(sets)
                rarity = table[counted(sets.hashes)]
                for i, (a, b) in enumerate(zip(sets.bounds[:-1], sets.bounds[1:], strict=True)):
                    size, cls = int(b - a), int(ids[i])
                    if not size or cls in seen:
                        continue
                    seen.add(cls)
                    band = band_of(size)
                    bands = [band, band + 1] if DEN * size >= NUM * (FIRST_BAND * BAND_GROWTH**band + 1) else [band]
                    for at in bands:
                        s, rank = _signatures(sets.hashes[a:b], rarity[a:b], at, group, spoiled)
                        if (often := rank >= hot_rank).any():
                            yield pa.RecordBatch.from_arrays([pa.nulls(int(often.sum()), pa.int32()), *[pa.nulls(int(often.sum()), pa.binary())] * 2, pa.array(s[often].view(np.int64)), pa.array(np.full(int(often.sum()), ids[i]).view(np.int64))], names)
                            s = s[~often]
                        sigs.append(s)
                        classes.append(np.full(len(s), ids[i]))
                        held += len(s)
            if len(seen) > 4_000_000:
                seen = set()  # only saves work: later steps drop repeats
            if held > EMIT_ROWS:
                yield from pack(np.concatenate(sigs), np.concatenate(classes))
                sigs, classes, held = [], [], 0
        if held:
            yield from pack(np.concatenate(sigs), np.concatenate(classes))

    return tidy(emit)


def _shared(buckets: int):
    """Of a bucket's signatures those of two classes or more."""

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs = np.frombuffer(b"".join(pdf["sigs"]), np.uint32)
        classes = np.frombuffer(b"".join(pdf["classes"]), np.int64)
        order = np.lexsort((classes, sigs))
        sigs, classes = sigs[order], classes[order]
        fresh = np.ones(len(sigs), bool)
        fresh[1:] = (sigs[1:] != sigs[:-1]) | (classes[1:] != classes[:-1])
        sigs, classes = sigs[fresh], classes[fresh]
        same = sigs[1:] == sigs[:-1]
        keep = np.zeros(len(sigs), bool)
        keep[1:] |= same
        keep[:-1] |= same
        bucket = int(pdf["bucket"].iloc[0]) if len(pdf) else 0
        return pd.DataFrame({"sig": (np.int64(bucket) << 32) + sigs[keep].astype(np.int64), "cls": classes[keep]})

    return shared


class JaccardJoin(LinkedSets):
    """The join over one table."""

    width, num, den = SHINGLE, NUM, DEN

    def __init__(self, spark: SparkSession, documents: DataFrame, hot_count: int = HOT_COUNT, broadcast_classes: int = BROADCAST_CLASSES, pivot_rounds: int = 1, small_group: int = SMALL_GROUP, block: int = BLOCK, group: int = GROUP, spoiled: int = SPOILED):
        super().__init__(spark, documents, "jaccard", broadcast_classes, pivot_rounds, small_group, block)
        self.hot, self.group, self.spoiled = hot_count, group, spoiled

    def _candidates(self) -> DataFrame:
        """(sig, cls): signatures that several classes have."""
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        buckets = max(LEAST_BUCKETS, int(total * 0.7 / BUCKET_ROWS))
        table = self.spark.sparkContext.broadcast(self.rarity)
        packed = self.documents.mapInArrow(_emit(table, buckets, self.hot, self.group, self.spoiled), "bucket int, sigs binary, classes binary, sig long, cls long")
        if (self.rarity >= min(4 * np.log2(self.hot), 254)).any():
            packed = self.scratch.save(packed, "packed")
            plain = packed.filter("bucket is null").select("sig", "cls").distinct()
            packed = packed.filter("bucket is not null")
        else:
            plain = None
        shared = packed.select("bucket", "sigs", "classes").groupBy("bucket").applyInPandas(_shared(buckets), "sig long, cls long")
        raw = self.scratch.save(shared if plain is None else shared.unionByName(plain), "shared-all")
        return self.scratch.save(self._one_of_equal(raw), "shared")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return JaccardJoin(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).labels()


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
