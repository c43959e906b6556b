"""Exact order statistics of groups of any size by refined histograms.

A rank is selected without gathering its group: counts, least and greatest values by range tell which range holds the rank;
only that range's rows go on, in new ranges between its own ends, until it holds one value or few enough rows to be numbered.
Each pass is one aggregation with partial sums in each task, of at most `bins` rows a target; what a pass leaves is written
to the shared folder, so later passes read a small part of the rows. A target stands for all ranks that lie in one range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.streaming.refresh import shared_root

BINS, FEW = 1024, 4096
#: Rows of a table of groups that may be broadcast (a key and some numbers each).
SMALL = 100_000


def _few(rows: DataFrame, limit: int = SMALL) -> DataFrame:
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def _order(x: Column) -> Column:
    """A number that grows with x by its exponent and fraction."""
    exponent = F.floor(F.log2(F.abs(x)))
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (exponent + F.abs(x) / F.pow(F.lit(2.0), exponent) + 1075))


class RankSelection:
    """Values at ranks of each group's finite values in ascending order; null and NaN are left out."""

    def __init__(self, rows: DataFrame, keys: list[str], value: str, bins: int = BINS, few: int = FEW):
        self.keys, self.bins, self.few = keys, bins, few
        self.spark = rows.sparkSession
        self.root, self.step = f"{shared_root(self.spark)}/ranks-{uuid.uuid4().hex}", 0
        # Null keys are groups too: joins below are on a key that is never null.
        own = [F.col(k).cast("string") for k in keys]
        key = F.concat(F.lit(""), *[F.coalesce(F.concat(F.char_length(k).cast("string"), F.lit(":"), k), F.lit("-")) for k in own])
        self.rows = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, key.alias("_key"), F.col(value).cast("double").alias("_v"))
        self.groups = self._saved(self.rows.groupBy("_key", *keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean")))

        self.few_groups = self.groups.limit(SMALL // 8 + 1).count() <= SMALL // 8

    def _small(self, ranges: DataFrame) -> DataFrame:
        """Ranges of groups, at most two a rank: broadcast without a count where the groups are few enough for it."""
        return F.broadcast(ranges) if self.few_groups else _few(ranges)

    def _saved(self, rows: DataFrame) -> DataFrame:
        self.step += 1
        rows.write.parquet(f"{self.root}/{self.step}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{self.step}")

    def _ends(self, ranges: DataFrame) -> DataFrame:
        """Ranges with what their bins need, computed once a range."""
        low, high = F.col("low"), F.col("high")
        close = (low * high > 0) & (F.greatest(F.abs(low), F.abs(high)) <= 2 * F.least(F.abs(low), F.abs(high)))
        ranges = ranges.withColumn("close", close)
        return ranges.withColumns({"from": F.when(close, low).otherwise(_order(low)), "to": F.when(close, high).otherwise(_order(high))})

    def _bin(self) -> Column:
        """The range of a value between a target's ends, the last one for the upper end itself.

        Ranges are equal in value where the ends are within a factor of two of each other, else in exponent and fraction,
        so that steep groups take as few passes as even ones: about 64 / log2(bins) each way at most.
        """
        at = F.when(F.col("close"), F.col("_v")).otherwise(_order(F.col("_v")))
        share = (at - F.col("from")) / (F.col("to") - F.col("from"))
        return F.least(F.floor(share * self.bins), F.lit(self.bins - 1)).cast("int")

    def at(self, ranks: DataFrame) -> DataFrame:
        """(_key, rank, value) of ranks (_key, rank), from 0; a rank beyond the group gives no row."""
        spread = self.groups.select("_key", "n", "low", "high")
        targets = self._saved(ranks.distinct().join(spread, "_key").filter("rank between 0 and n - 1").select("_key", "rank", "low", "high", "n", F.col("rank").alias("left")))
        rows, found = self.rows.select("_key", "_v"), []
        while True:
            counts = targets.agg(F.count_if(F.col("low") == F.col("high")), F.count_if(F.expr(f"low < high and n <= {self.few}")), F.count_if(F.expr(f"low < high and n > {self.few}"))).first()
            if counts[0]:
                found.append(targets.filter("low = high").select("_key", "rank", F.col("low").alias("value")))
            if counts[1]:
                found.append(self._numbered(rows, targets.filter(F.expr(f"low < high and n <= {self.few}"))))
            if not counts[2]:
                break
            targets = targets.filter(F.expr(f"low < high and n > {self.few}"))
            # Targets of one range are counted once.
            ranges = targets.groupBy("_key", "low", "high").agg(F.min("rank").alias("range"))
            inside = rows.join(self._small(self._ends(ranges)), "_key").filter("_v between low and high").withColumn("bin", self._bin())
            counts = inside.groupBy("_key", "low", "high", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
            before = Window.partitionBy("_key", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
            counts = self._saved(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
            held = targets.drop("n").join(counts, ["_key", "low", "high"]).filter("left >= before and left < before + n")
            targets = self._saved(held.select("_key", "rank", F.col("least").alias("low"), F.col("most").alias("high"), "n", (F.col("left") - F.col("before")).alias("left")))
            kept = targets.filter("low < high").select("_key", "low", "high").distinct()
            # Ranges of a group do not overlap, so a row stays at most once.
            rows = self._saved(rows.join(self._small(kept), "_key").filter("_v between low and high").select("_key", "_v"))
        out = found[0] if found else targets.select("_key", "rank", F.col("low").alias("value"))
        for more in found[1:]:
            out = out.unionByName(more)
        return self._saved(out)

    def _numbered(self, rows: DataFrame, targets: DataFrame) -> DataFrame:
        """Values of targets whose ranges hold few rows."""
        ranges = targets.select("_key", "low", "high").distinct()
        inside = rows.join(self._small(ranges), "_key").filter("_v between low and high")
        place = F.row_number().over(Window.partitionBy("_key", "low", "high").orderBy("_v")) - 1
        return inside.withColumn("left", place.cast("long")).join(targets, ["_key", "low", "high", "left"]).select("_key", "rank", F.col("_v").alias("value"))

    def quantiles(self, shares: dict[str, float]) -> DataFrame:
        """(*keys, n, mean, a column a name): quantiles at shares of 0 to 1, between two values in proportion to their distance."""
        place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
        both = [f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]
        ranks = self.groups.select("_key", F.explode(F.array_distinct(F.array(*both))).alias("rank"))
        found = self.at(ranks)
        held = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
        out = self.groups.join(held, "_key")
        low, high = (lambda p: F.col("at")[F.floor(p).cast("long")]), (lambda p: F.col("at")[F.ceil(p).cast("long")])
        between = [(low(p) + (high(p) - low(p)) * (p - F.floor(p))).alias(name) for name, p in place.items()]
        return out.select("_key", *self.keys, "n", "mean", *between)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], **options) -> DataFrame:
    """Exact quantiles of each group; groups without values are left out."""
    return RankSelection(rows, keys, value, **options).quantiles(shares).drop("_key")


def robust_stats(rows: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """Median, scaled median absolute deviation, 99.5th percentile and mean per group."""
    selection = RankSelection(rows, keys, value, **options)
    centre = selection.quantiles({"median": 0.5, "p995": 0.995})
    apart = selection.rows.join(_few(centre.select("_key", "median")), "_key").select(F.col("_key").alias("of"), F.abs(F.col("_v") - F.col("median")).alias("apart"))
    spread = quantiles(apart, ["of"], "apart", {"mad": 0.5}, **options).select(F.col("of").alias("_key"), "mad")
    return centre.join(spread, "_key").select(*keys, "median", "p995", "mean", "mad", (F.col("mad") * 1.4826).alias("sigma"))


def best_capture(responses: DataFrame, keys: list[str], capture: str, value: str, **options) -> DataFrame:
    """(*keys, capture, contrast): per key the capture whose 99.5th percentile stands out most over its median, the first of equal ones by name."""
    found = quantiles(responses, [*keys, capture], value, {"median": 0.5, "p995": 0.995}, **options)
    ranked = found.withColumn("contrast", F.col("p995") / F.greatest("median", F.lit(1e-6)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("contrast"), capture))
    return ranked.withColumn("_first", first).filter("_first = 1").select(*keys, capture, F.round("contrast", 1).alias("contrast"))
