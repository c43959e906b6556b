"""Components of linked sets, from groups of candidates: what the near-duplicate operators share.

Sets are the distinct word shingles of whole texts; two link if their Jaccard similarity is at least num / den. One pass over
the texts gives sizes, hashes of sets, 512-bit parity sketches and a fixed-size table of feature counts; equal sets become a
class. An operator adds groups of classes (sig, cls) such that linked classes meet in some group. Then:

1. Each class is compared with a pivot of its group: pairs pass the size and sketch bounds, longer sketches, and then their
   whole sets are compared. Links give components; groups that still lie in several go on.
2. Groups of at most SMALL_GROUP classes are paired. Larger ones are split: their classes meet by single features.
   In the order that all sets share, rare features first, the first feature that two linked sets have in common has at
   least the needed overlap behind it in both. So a feature with r features from it on serves only partners of size at
   most r (num + den) / num - n, and a set enters it once for each range of sizes that it can serve: as the smaller set of
   a pair, and as the larger. A passage that sets share, but that is too short for a link, comes last in the order, is
   too short for any partner and makes no entry; where it is long enough, the sets link by it and pivots join them.
3. Split groups are compared with a pivot of either side, and what still lies in several components meets by smaller and
   larger side, with the size, sketch and position bounds inside the join and large sides dealt by blocks over many tasks.

So no link between components is lost, and no group is expanded into its pairs. Pairs whose sizes, positions and sketches allow a
link, though they have none, are compared: sets that share all but their rarest features and miss the threshold by a feature or two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import Scratch, small_batches, tidy
from terrace.llm.components import components
from terrace.llm.shingles import U64, Sets, mix64, per_set, shingle_sets

COUNT_BITS, SKETCH_BITS = 20, 512
#: Groups of at most this many classes are paired without being split; a key of the last join has about one block of larger sets.
SMALL_GROUP, BLOCK = 16, 256
#: Largest number of class ids broadcast (16 MB); beyond it the same join shuffles.
BROADCAST_CLASSES = 2_000_000
#: Growth of the ranges of sizes by which split groups meet; sizes below 1 / (growth - 1) are ranges of their own.
RANGE_GROWTH = 1.08
#: Counts of a row of a table of counts, and how many of those rows go into a batch. A cell is small, since Spark limits
#: the batches that it makes of such rows by their number alone.
_COUNT_BLOCK, _COUNT_ROWS = 1 << 10, 128
#: Tasks that sum the blocks at last.
_COUNT_PARTS = 16
_WORDS = SKETCH_BITS // 64


def counted(hashes: np.ndarray) -> np.ndarray:
    """The place of each feature in the table of counts."""
    return (mix64(hashes ^ U64(0x5851F42D4C957F2D)) >> U64(64 - COUNT_BITS)).astype(np.int64)


def class_ids(sets: Sets) -> np.ndarray:
    """A hash of each set, the same for equal sets; 0 for the empty one."""
    return mix64(per_set(mix64(sets.hashes ^ U64(0x2545F4914F6CDD1D)), sets, np.add, 0) + sets.sizes.astype(U64)) * (sets.sizes > 0)


def _sketch_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(hashes ^ U64(0x14057B7EF767814F)) & U64(bits - 1)).astype(np.int64)


def _long_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities as 64-bit words: at least twice as many bits as features, by powers of four."""
    bits = SKETCH_BITS
    while bits < 2 * len(hashes):
        bits *= 4
    odd = np.bincount(_sketch_places(hashes, bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _sketches(sets: Sets) -> np.ndarray:
    """Parities of the numbers of features that fall on each of the bits, as eight 64-bit words a set."""
    n = len(sets.bounds) - 1
    bits = _sketch_places(sets.hashes, SKETCH_BITS)
    odd = np.bincount(sets.owner() * SKETCH_BITS + bits, minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(">i8").astype(np.int64)


def _count_rows(counts: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
    """The blocks that hold counts, by _COUNT_ROWS."""
    blocks = counts.reshape(-1, _COUNT_BLOCK)
    narrow = np.int64 if blocks.max(initial=0) > 0xFFFFFFFF else np.uint32
    full = np.flatnonzero(blocks.any(axis=1))
    for at in range(0, len(full), _COUNT_ROWS):
        part = full[at : at + _COUNT_ROWS].tolist()
        yield part, [blocks[i].astype(narrow).tobytes() for i in part]


def _add_block(counts: np.ndarray, block: int, data: bytes) -> None:
    wide = len(data) == 8 * _COUNT_BLOCK
    counts[block * _COUNT_BLOCK : (block + 1) * _COUNT_BLOCK] += np.frombuffer(data, np.int64 if wide else np.uint32)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of counts; holds one table, however many rows come."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            _add_block(counts, block, data.as_py())
    for blocks, data in _count_rows(counts):
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], ["block", "counts"])


def feature_counts(profile: DataFrame) -> np.ndarray:
    """The summed table, of fixed size whatever the input: each count as its base-2 logarithm in quarter steps, one byte.

    Tables are summed in two levels, so that no task reads more than about the square root of their number: first tables
    dealt at random, then what is left of each block.
    """
    rows = profile.filter("block is not null").select("block", "counts")
    blocks = (1 << COUNT_BITS) // _COUNT_BLOCK
    groups = max(_COUNT_PARTS, math.isqrt(rows.count() // blocks))
    summed = rows.repartition(groups, F.rand(7)).mapInArrow(tidy(_add_counts), "block int, counts binary")
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for row in summed.repartition(_COUNT_PARTS, "block").mapInArrow(tidy(_add_counts), "block int, counts binary").collect():
        _add_block(counts, row["block"], row["counts"])
    return np.minimum(np.log2(np.maximum(counts, 1)) * 4, 255).astype(np.uint8)


def _set_rows(width: int):
    """(cls, sketch, features): of each new set its long sketch and its sorted 64-bit hashes."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for sets in shingle_sets(batch, "text", width):
                rows = []
                for cls, a, b in zip(class_ids(sets).view(np.int64).tolist(), sets.bounds[:-1], sets.bounds[1:], strict=True):
                    if a < b and cls not in seen:
                        seen.add(cls)
                        rows.append((cls, _long_sketch(sets.hashes[a:b]), sets.hashes[a:b].tobytes()))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["cls", "sketch", "features"])

    return tidy(rows_of)


def size_range(size: np.ndarray) -> np.ndarray:
    """The number of the range of sizes that a size is in; never falls as sizes grow."""
    first = round(1 / (RANGE_GROWTH - 1))
    return np.where(size <= first, size, first + np.floor(np.log(np.maximum(size, first) / first) / math.log(RANGE_GROWTH))).astype(np.int64)


def entries(hashes: np.ndarray, rarity: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """(feature, i, j, smaller, most) of one set: for each feature and pair of size ranges in which it can be the first shared one.

    i and j are the ranges of the smaller and of the larger set, `most` is the largest partner that the feature serves.
    """
    n = len(hashes)
    order = np.lexsort((hashes, rarity))
    least = -(-n * num // den)
    most = (n - np.arange(n)) * (num + den) // num - n
    order, most = order[most >= least], most[most >= least]
    own = int(size_range(np.array([n]))[0])
    out = []
    for smaller, low, high in ((False, least, np.minimum(most, n)), (True, n, np.minimum(most, n * den // num))):
        first, last = int(size_range(np.array([low]))[0]), size_range(np.maximum(high, 1))
        width = np.where(high >= low, last - first + 1, 0)
        place = np.repeat(np.arange(len(width)), width)
        other = first + np.arange(len(place)) - np.repeat(np.cumsum(width) - width, width)
        mine = np.full(len(place), own)
        out.append((hashes[order[place]], mine if smaller else other, other if smaller else mine, np.full(len(place), smaller), most[place]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _entry_rows(rarity_table, num: int, den: int):
    """(cls, sig, i, j, smaller, most): the entries of stored sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity_table.value
        for batch in batches:
            for cls, data in zip(batch.column("cls").to_pylist(), batch.column("features"), strict=True):
                hashes = np.frombuffer(data.as_py(), U64)
                sig, i, j, smaller, most = entries(hashes, table[counted(hashes)], num, den)
                for at in range(0, len(sig), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig[part]), cls)), pa.array(sig[part].view(np.int64)), pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), pa.array(smaller[part]), pa.array(most[part].astype(np.int64))], ["cls", "sig", "i", "j", "smaller", "most"])

    return tidy(rows)


def _verify(num: int, den: int):
    """Candidate pairs whose whole sets link."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last, left = None, np.empty(0, U64)
            for i, (u, x, y) in enumerate(zip(batch.column("u"), batch.column("fu"), batch.column("fv"), strict=True)):
                if u != last:
                    last, left = u, np.frombuffer(x.as_py(), U64)
                right = np.frombuffer(y.as_py(), U64)
                small, large = (left, right) if len(left) < len(right) else (right, left)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                keep[i] = common > 0 and den * common >= num * (len(left) + len(right) - common)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return tidy(verify)


class LinkedSets:
    """Components of one table. Subclasses state width, num and den, and give the groups of candidates."""

    width, num, den = 5, 3, 4
    #: Further columns of a class, by name and type, that `_own` computes and `_near` may use.
    own_columns: dict[str, str] = {}

    def __init__(self, spark: SparkSession, documents: DataFrame, name: str, broadcast_classes: int = BROADCAST_CLASSES, pivot_rounds: int = 1, small_group: int = SMALL_GROUP, block: int = BLOCK):
        self.spark, self.broadcast_classes, self.pivot_rounds, self.small_group, self.block = spark, broadcast_classes, pivot_rounds, small_group, block
        small_batches(spark)
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.scratch = Scratch(spark, name)

    @staticmethod
    def _own(sets: Sets) -> list[pa.Array]:
        """The further columns of the sets."""
        return []

    def _near(self, u: str, v: str) -> Column:
        """A further bound of pairs."""
        return F.lit(True)

    def _candidates(self) -> DataFrame:
        """(sig, cls): groups such that any two linked classes share one."""
        raise NotImplementedError

    @cached_property
    def _profile_schema(self) -> str:
        own = "".join(f", {c} {kind}" for c, kind in self.own_columns.items())
        return "doc_id long, text_hash long, cls long, n int, " + ", ".join(f"s{i} long" for i in range(_WORDS)) + own + ", block int, counts binary"

    def _profile(self):
        """Rows of documents, and at the end of a task its feature counts by block of the table."""
        width, own, own_names = self.width, self._own, list(self.own_columns)

        def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(1 << COUNT_BITS, np.int64)
            waiting: list[np.ndarray] = []
            held, kinds = 0, []
            names = ["doc_id", "text_hash", "cls", "n", *(f"s{i}" for i in range(_WORDS)), *own_names, "block", "counts"]
            for batch in batches:
                for sets in shingle_sets(batch, "text", width):
                    n = len(sets.bounds) - 1
                    sketch = _sketches(sets)
                    columns = [batch.column("doc_id").slice(sets.first_row, n), batch.column("text_hash").slice(sets.first_row, n), pa.array(class_ids(sets).view(np.int64)), pa.array(sets.sizes.astype(np.int32)), *(pa.array(sketch[:, i].copy()) for i in range(_WORDS)), *own(sets)]
                    kinds = [c.type for c in columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
                    waiting.append(counted(sets.hashes))
                    held += len(waiting[-1])
                    if held > 1 << COUNT_BITS:
                        counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                        waiting, held = [], 0
            if waiting:
                counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
            for blocks, data in _count_rows(counts) if kinds else ():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(blocks), t) for t in kinds), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names)

        return tidy(profile)

    def _profiles(self) -> None:
        profile = self.scratch.save(self.documents.withColumn("text_hash", F.xxhash64("text")).mapInArrow(self._profile(), self._profile_schema), "profile")
        self.rows = profile.filter("block is null").drop("block", "counts")
        self.rarity = feature_counts(profile)
        first = [F.first(c).alias(c) for c in (*(f"s{i}" for i in range(_WORDS)), *self.own_columns)]
        grouped = self.rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *first)
        self.classes = self.scratch.save(grouped, "classes")

    def _one_of_equal(self, groups: DataFrame) -> DataFrame:
        """Groups of two classes or more; of groups of the very same classes, one."""
        members = groups.groupBy("sig").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(cls, 1))").alias("x"), F.expr("bit_xor(xxhash64(cls, 2))").alias("y"))
        one = members.filter("n > 1").groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
        return groups.join(one, "sig", "left_semi")

    @property
    def _bound_columns(self) -> list[str]:
        return [f"s{i}" for i in range(_WORDS)]

    def _side(self, rows: DataFrame, x: str, *more: Column) -> DataFrame:
        """Columns of one side of a pair, by its letter."""
        return rows.select(*more, F.col("cls").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}_{c}") for c in self._bound_columns])

    def _bounds(self, u: str, v: str) -> Column:
        """Sizes within the similarity of each other, and no more differing sketch bits than features may differ."""
        sizes = F.expr(f"{self.den} * least(n{u}, n{v}) >= {self.num} * greatest(n{u}, n{v})")
        bits = " + ".join(f"bit_count({u}_s{i} ^ {v}_s{i})" for i in range(_WORDS))
        return sizes & F.expr(f"{self.den + self.num} * ({bits}) <= {self.den - self.num} * (n{u} + n{v})") & self._near(u, v)

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) of classes whose sizes and sketches allow a link."""
        return pairs.join(self._side(self.classes, "u"), "u").join(self._side(self.classes, "v"), "v").filter(self._bounds("u", "v")).select("u", "v", "nu", "nv")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links among bounded pairs (u, v, nu, nv). A pair whose sketches differ in length keeps the short bound alone."""
        pairs = self.scratch.save(pairs, f"pairs-{name}")
        short = lambda x: self.sets.select(F.col("cls").alias(x), F.col("sketch").alias(f"s{x}"))
        bits = "aggregate(zip_with(su, sv, (a, b) -> cast(bit_count(a ^ b) as int)), 0, (t, x) -> t + x)"
        near = f"size(su) <> size(sv) or {self.den + self.num} * {bits} <= {self.den - self.num} * (nu + nv)"
        pairs = self.scratch.save(pairs.join(short("u"), "u").join(short("v"), "v").filter(near).select("u", "v"), f"near-{name}")
        used = self.scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct(), f"used-{name}")
        sets = self.sets.join(self._small(used), "cls", "left_semi")
        left = sets.select(F.col("cls").alias("u"), F.col("features").alias("fu"))
        right = sets.select(F.col("cls").alias("v"), F.col("features").alias("fv"))
        return pairs.join(right, "v").join(left, "u").select("u", "v", "fu", "fv").mapInArrow(_verify(self.num, self.den), "u long, v long")

    def _small(self, keys: DataFrame) -> DataFrame:
        """One column of ids, marked for broadcast only if they are few enough."""
        return F.broadcast(keys) if keys.count() <= self.broadcast_classes else keys

    def _store_sets(self, groups: DataFrame) -> None:
        """Whole sets of the classes that have a candidate, from one document of each class."""
        wanted = groups.select("cls").distinct().join(self.classes, "cls").select(F.col("rep").alias("doc_id"))
        wanted = self._small(self.scratch.save(wanted, "wanted"))
        texts = self.documents.join(wanted, self.documents["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        # An id may repeat, so a class may come once per task, or not belong to the wanted ones: links are the same.
        self.sets = self.scratch.save(texts.select("text").mapInArrow(_set_rows(self.width), "cls long, sketch array<long>, features binary"), "sets")

    def _joined(self, graph: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """The components of a graph (u, v) and of the links among bounded pairs."""
        found = self.scratch.save(self._verified(pairs, name), f"links-{name}")
        return graph if found.isEmpty() else components(graph.unionByName(found), self.scratch, f"graph-{name}")

    def _with_pivots(self, members: DataFrame, order: Column) -> DataFrame:
        """Bounded pairs of each class with the pivot of its group, the least in the given order."""
        pivots = members.groupBy("sig").agg(F.min(F.struct(order.alias("o"), F.col("cls").alias("pivot"), F.col("label").alias("pivot_label"))).alias("p")).select("sig", "p.pivot", "p.pivot_label")
        pairs = members.join(pivots, "sig").filter("label <> pivot_label").select(F.greatest("cls", "pivot").alias("u"), F.least("cls", "pivot").alias("v"))
        return self._bounded(pairs.distinct())

    def _labelled(self, members: DataFrame, graph: DataFrame) -> DataFrame:
        """Members with their component as label."""
        return members.join(graph.select(F.col("u").alias("cls"), F.col("v").alias("label")), "cls", "left").withColumn("label", F.coalesce("label", "cls"))

    def _mixed(self, members: DataFrame, graph: DataFrame, name: str) -> DataFrame:
        """Labelled members of the groups that lie in several components."""
        labelled = self._labelled(members, graph)
        mixed = labelled.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("sig")
        return self.scratch.save(labelled.join(mixed, "sig", "left_semi"), name)

    def _met(self, entered: DataFrame, graph: DataFrame, name: str) -> DataFrame:
        """Labelled entries under which sets of several components meet, as smaller and as larger ones."""
        labelled = self._labelled(entered, graph)
        of = lambda c, smaller: F.when(F.col("smaller") if smaller else ~F.col("smaller"), F.col(c))
        ends = [f(of("label", smaller)).alias(f"{k}{int(smaller)}") for smaller in (True, False) for k, f in (("low", F.min), ("high", F.max))]
        met = labelled.groupBy("sig", "i", "j").agg(*ends).filter("low0 <> high1 or low1 <> high0").select("sig", "i", "j")
        return self.scratch.save(labelled.join(met, ["sig", "i", "j"], "left_semi"), name)

    def _entered(self, members: DataFrame) -> DataFrame:
        """(sig, i, j, smaller, most, cls) of the members' classes."""
        wanted = self.scratch.save(members.select("cls").distinct(), "used-split")
        table = self.spark.sparkContext.broadcast(self.rarity)
        sets = self.sets.join(self._small(wanted), "cls", "left_semi").select("cls", "features")
        # Sets may be stored more than once.
        return sets.mapInArrow(_entry_rows(table, self.num, self.den), "cls long, sig long, i int, j int, smaller boolean, most long").distinct()

    def _at_pivots(self, met: DataFrame) -> DataFrame:
        """Bounded pairs of each entry with a pivot of the other side: the smallest smaller set, and a larger one by hash."""
        key = ["sig", "i", "j"]
        pivot = lambda smaller, order: met.filter(F.col("smaller") == smaller).groupBy(*key).agg(F.min(F.struct(order.alias("o"), F.col("cls").alias("pivot"), F.col("label").alias("pivot_label"))).alias("p")).select(*key, F.lit(not smaller).alias("smaller"), "p.pivot", "p.pivot_label")
        pivots = pivot(True, -F.col("most")).unionByName(pivot(False, F.xxhash64("cls", "sig")))
        pairs = met.join(pivots, [*key, "smaller"]).filter("label <> pivot_label").select(F.greatest("cls", "pivot").alias("u"), F.least("cls", "pivot").alias("v"))
        return pairs.select("u", "v")

    def _sides(self, met: DataFrame) -> DataFrame:
        """Bounded pairs across components of smaller and larger sets under each entry. Larger ones are dealt by blocks."""
        key = ["sig", "i", "j"]
        blocks = met.filter("not smaller").groupBy(*key).agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        known = self.scratch.save(met.join(blocks, key).join(self.classes.drop("rep"), "cls"), "sides")
        # A stated number of partitions: pairs are more than rows, so rows must not be gathered in few tasks.
        spread = lambda rows: rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *key, "block")
        own = lambda x: (*key, "block", F.col("label").alias(f"l{x}"), F.col("most").alias(f"m{x}"))
        left = known.filter("smaller").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        right = known.filter("not smaller").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        left, right = self._side(spread(left), "u", *own("u")), self._side(spread(right), "v", *own("v"))
        met = F.expr("lu <> lv and (nu < nv or nu = nv and u < v) and nv <= mu and nu <= mv")
        pairs = left.join(right.hint("merge"), [*key, "block"]).filter(met & self._bounds("u", "v"))
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def _within(self, members: DataFrame) -> DataFrame:
        """Bounded pairs across components of small groups."""
        known = self.scratch.save(members.join(self.classes.drop("rep"), "cls"), "small")
        own = lambda x: ("sig", F.col("label").alias(f"l{x}"))
        pairs = self._side(known, "u", *own("u")).join(self._side(known, "v", *own("v")), "sig").filter(F.expr("lu <> lv and u > v") & self._bounds("u", "v"))
        return pairs.select("u", "v")

    def labels(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        return self.labelled().select("doc_id", "n_shingles", "component_id")

    def labelled(self) -> DataFrame:
        """The labels with text_hash (xxhash64) and root, which names the component where ids repeat; null for empty sets."""
        self._profiles()
        groups = self._candidates()
        self._store_sets(groups)
        # No list of rows: that would start Python workers of another kind, which stay.
        graph = self.spark.range(0).selectExpr("id as u", "id as v")
        members = groups.withColumn("label", F.col("cls"))
        for step in range(self.pivot_rounds):
            order = F.xxhash64("cls", F.lit(step)) if step == 0 else F.xxhash64("cls", "sig", F.lit(step))
            graph = self._joined(graph, self._with_pivots(members, order), f"pivot-{step}")
            members = self._mixed(groups, graph, f"members-{step}")
        sizes = members.groupBy("sig").agg(F.count("*").alias("n"))
        large = self._small(self.scratch.save(sizes.filter(F.col("n") > self.small_group).select("sig"), "large"))
        small, split = members.join(large, "sig", "left_anti"), members.join(large, "sig", "left_semi")
        met = self._met(self.scratch.save(self._entered(split), "entered"), graph, "met")
        graph = self._joined(graph, self._bounded(self._within(small).unionByName(self._at_pivots(met)).distinct()), "small")
        met = self._met(met.drop("label"), graph, "met-again")
        if not met.isEmpty():
            graph = self._joined(graph, self._bounded(self._sides(met).distinct()), "rest")
        graph = self.scratch.save(graph, "components")
        for table in self.scratch.saved - {"profile", "classes", "components"}:
            self.scratch.drop(table)
        roots = self.classes.select("cls", "rep").join(graph.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = roots.groupBy("root").agg(F.min("rep").alias("component"))
        of_class = roots.join(least, "root").select("cls", "component", "root")
        return self.rows.select("doc_id", "text_hash", "n", "cls").join(of_class, "cls", "left").select("doc_id", "text_hash", "root", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
