"""Mixing sources to target weights, in DataFrame functions alone.

Targets: sources share the total size by weight, none above `repeat` times its own size; what is above is shared again by
weight, over and over until none is above: a sum over the sources each time, and no task holds them all. Weights follow the
sources' order, whose ranks come from a range partitioning: places in a part, and counts of the parts before.

Selection (Efraimidis-Spirakis): a document's key is -ln(u) / quality, u from a hash of its id and the seed, so reruns and
recomputed tasks agree. Whole epochs of a source come first, then its documents in key order up to the rest of the
target in whole words; the document that the budget ends in is taken in part, so a source's words miss its target by less than one.

A source may hold most rows, so no task sorts a source. Keys fall into bins of their logarithm: whatever the qualities, a
bin of 1/FINE of an octave holds less than 0.26/FINE of a source's documents. Sums by coarse bin (pre-aggregated in each task
and prefix-summed) tell the one coarse bin that the budget ends in, sums of its fine bins the one fine bin, and only that
is sorted, by key, id and size. What is decided for each source is written and counted; up to BROADCAST_SOURCES rows it is broadcast,
beyond that it is joined by source and one of SALTS salts, so a source with most rows spreads over that many tasks.

Defined results: null and blank texts have size 0 and take 0; very long texts count whole; null is a source of its own, last
in order; a null id has a fixed key; rows that repeat are documents of their own and, where id and size are equal,
interchangeable; null, negative or zero quality counts as the least quality; an empty table gives no rows; other columns
stay, whatever their names, but for source_size, target and taken, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import Scratch, word_count

WEIGHTS, REPEAT, SEED = (5, 2, 1), 3, "mix-1"
#: Bins of an octave of keys: coarse ones, and fine ones of the coarse bin that a budget ends in.
COARSE, FINE = 256, 1 << 20
LEAST_QUALITY = 0.01
#: Largest number of sources broadcast (about 10 MB); parts of a source where there are more.
BROADCAST_SOURCES, SALTS = 100_000, 64


def _ranked(sums: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds rank (from 0) in order of source by code point, null last."""
    order = (F.col("source").isNull(), F.col("source"))
    parts = scratch.save(sums.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each part, not for each source.
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("place", place).join(F.broadcast(starts), "part").select(*sums.columns, (F.col("begin") + F.col("place")).alias("rank"))


def source_targets(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size)."""
    scratch = Scratch(sums.sparkSession, "targets")
    dealt = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = _ranked(sums, scratch).select("source", "source_size", dealt.alias("weight"), (repeat * F.col("source_size")).cast("double").alias("cap"))
    capped = scratch.save(capped.withColumn("level", F.col("cap") / F.col("weight")), "weighed")
    level, held = None, -1
    while True:
        # Sources whose cap is at most their share at the last level have their cap; the rest share what is left.
        full = F.lit(False) if level is None else F.col("level") <= level
        row = capped.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if row["n"] == held or row["weight"] is None:
            break
        level, held = (row["total"] - (row["cap"] or 0.0)) / row["weight"], row["n"]
    if row["weight"] is None:
        return capped.select("source", "source_size", F.col("cap").alias("target"))
    return capped.select("source", "source_size", F.when(F.col("level") <= level, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the seed and the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _cuts(bin_sums: DataFrame, goals: DataFrame) -> DataFrame:
    """(cut_source, cut_bin, cut_start): of each source the bin that the budget ends in; none where it takes no part.

    `bin_sums` are (source, bin, bin_size), `goals` (goal_source, budget, begin): words before the first of these bins.
    """
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bin_sums.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    cuts = starts.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("bin_start", F.col("bin_start") + F.col("begin"))
    cuts = cuts.filter("bin_start <= budget and bin_start + bin_size > budget")
    return cuts.select(F.col("source").alias("cut_source"), F.col("bin").alias("cut_bin"), F.col("bin_start").alias("cut_start"))


def _planned(keyed: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with what is decided for their source."""
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    if few:
        return keyed.join(F.broadcast(plan), same, "left")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)))
    spread = plan.withColumn("goal_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, same & (F.col("salt") == F.col("goal_salt")), "left")


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT, seed: str = SEED, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """Adds source_size, target and taken to rows with doc_id, source, size (long) and quality (0 to 1).

    `sized` is read several times, so it should be a table, not a plan over texts.
    """
    scratch = Scratch(sized.sparkSession, "mix")
    quality = F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(LEAST_QUALITY))
    keyed = sized.select(F.struct(*[F.col(f"`{c}`") for c in sized.columns]).alias("row"), "doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / quality).alias("key"))
    keyed = keyed.withColumn("fine", F.floor(F.log2("key") * FINE))
    coarse = F.floor(F.col("fine") / (FINE // COARSE))
    bin_sums = scratch.save(keyed.groupBy("source", coarse.alias("bin")).agg(F.sum("size").alias("bin_size")), "bins")
    goals = source_targets(bin_sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, repeat)
    goals = goals.select(F.col("source").alias("goal_source"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    goals = scratch.save(goals.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")), "goals")
    few = goals.count() <= broadcast_sources
    first = scratch.save(_cuts(bin_sums, goals.select("goal_source", "budget", F.lit(0).alias("begin"))), "coarse-cuts")
    begun = first.join(goals, F.col("cut_source").eqNullSafe(F.col("goal_source"))).select("goal_source", "budget", F.col("cut_start").alias("begin"), "cut_bin")
    inner = _planned(keyed.select("doc_id", "source", "size", "key", "fine", coarse.alias("coarse")), begun, few).filter("coarse = cut_bin")
    inner_sums = inner.groupBy("source", F.col("fine").alias("bin")).agg(F.sum("size").alias("bin_size"))
    cuts = _cuts(inner_sums, begun.drop("cut_bin"))
    plan = scratch.save(goals.join(cuts, F.col("goal_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "plan")
    planned = _planned(keyed, plan, few)
    edge = F.coalesce(F.col("fine") == F.col("cut_bin"), F.lit(False))
    inside = F.coalesce(F.col("fine") < F.col("cut_bin"), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = planned.filter(edge).withColumn("start", F.col("cut_start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.withColumn("chosen", F.least("size", F.greatest(F.col("budget") - F.col("start"), F.lit(0)))).drop("start")
    # Without a cut the budget is 0, or, by rounding, the whole source.
    whole = inside | (F.col("cut_bin").isNull() & (F.col("budget") > 0))
    rest = planned.filter(~edge).withColumn("chosen", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("size") * F.col("epochs") + F.col("chosen")).cast("long")
    kept = [F.col(f"row.`{c}`").alias(c) for c in sized.columns if c not in ("source_size", "target", "taken")]
    return rest.unionByName(cut).select(*kept, "source_size", "target", taken.alias("taken"))


def label_quality(labels: DataFrame) -> DataFrame:
    """(label_id, quality): 1 for documents labelled good, 0.25 for bad, their mean where labels differ."""
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.25)).alias("quality"))


def with_quality(sized: DataFrame, quality: DataFrame) -> DataFrame:
    """Adds the quality of `quality` (label_id, quality) by id; 0.5 where no label is known."""
    return sized.join(quality, F.col("doc_id") == F.col("label_id"), "left").withColumn("quality", F.coalesce("quality", F.lit(0.5))).drop("label_id")


def sized_documents(documents: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The carried columns, size and quality of all documents."""
    return with_quality(documents.select(*carry, word_count(F.col("text")).alias("size")), label_quality(labels))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    sized = sized_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(Scratch(spark, "op4").save(sized, "sized")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH q AS (SELECT doc_id, avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT d.doc_id, d.source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(coalesce(q.quality, 0.5::DOUBLE), 0.01::DOUBLE) AS key
  FROM documents d LEFT JOIN q USING (doc_id)
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / weight AS lvl FROM w),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rest
  FROM c WINDOW b AS (ORDER BY lvl, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, max(CASE WHEN lvl > rest THEN rest END) OVER () AS final FROM r),
g AS (SELECT source, source_size, CASE WHEN final IS NULL OR lvl <= final THEN cap ELSE final * weight END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size + 0.5::DOUBLE)::BIGINT AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  (size * epochs + least(size, greatest(budget - start, 0)))::BIGINT AS taken FROM o
"""
