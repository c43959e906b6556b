"""Peaks, bands and robust statistics of one-dimensional profiles (profile_id, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_of_positive(profile: DataFrame) -> DataFrame:
    return profile.filter("value > 0").groupBy("profile_id").agg(F.median("value").alias("base"))


def local_maxima(profile: DataFrame, ratio: float, top: int | None = None, reach: int = 1) -> DataFrame:
    """(profile_id, idx, value, ratio, shift): interior maxima within `reach`, above `ratio` times the positive median.

    `shift` is the sub-pixel place of a parabola through the neighbours. A profile without positive values has none.
    """
    line = Window.partitionBy("profile_id").orderBy("idx")
    around = line.rowsBetween(-reach, reach)
    left, right, v = F.lag("value").over(line), F.lead("value").over(line), F.col("value")
    seen = profile.withColumn("most", F.max("value").over(around)).withColumn("a", left).withColumn("c", right)
    seen = seen.filter(F.col("a").isNotNull() & F.col("c").isNotNull() & (v >= F.col("most")))
    found = seen.join(median_of_positive(profile), "profile_id").withColumn("ratio", v / F.col("base")).filter(F.col("ratio") > ratio)
    bend = F.col("a") - 2 * v + F.col("c")
    found = found.withColumn("shift", F.when(bend != 0, 0.5 * (F.col("a") - F.col("c")) / bend).otherwise(0.0)).select("profile_id", "idx", "value", "ratio", "shift")
    if top is None:
        return found
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("ratio"), "idx"))
    return found.withColumn("r", rank).filter(F.col("r") <= top).drop("r")


def band_pairs(peaks: DataFrame, least: int, most: int) -> DataFrame:
    """Per profile the pair of peaks `least` to `most` apart whose weaker one is strongest; the first of equal ones.

    The band is an equi-join on buckets as wide as the band, each peak looking into its own bucket and the next ones,
    so a long profile is not compared with all of itself.
    """
    width = max(most, 1)
    one = peaks.select("profile_id", F.col("idx").alias("i"), F.col("value").alias("vi"), F.explode(F.sequence(F.floor(F.col("idx") / width), F.floor((F.col("idx") + most) / width))).alias("bucket"))
    two = peaks.select("profile_id", F.col("idx").alias("j"), F.col("value").alias("vj"), F.floor(F.col("idx") / width).alias("bucket"))
    pairs = one.join(two, ["profile_id", "bucket"]).filter(F.expr(f"j - i between {least} and {most}"))
    best = F.min_by(F.struct("i", "j", F.least("vi", "vj").alias("strength")), F.struct(-F.least("vi", "vj"), "i", "j"))
    return pairs.groupBy("profile_id").agg(best.alias("p")).select("profile_id", "p.i", "p.j", "p.strength")


def goal_lines(profile: DataFrame, spans: DataFrame, reach: int, margin: int, ratio: float = 2.0) -> DataFrame:
    """(profile_id, i, j, start, end, strength): per span the pair of lines between which its length lies, the weaker one as strong as can be.

    Spans are (profile_id, a, b, least, most, flush): lines lie in a <= i < b, `least` to `most` apart. With flush "start" the
    first lies within `margin` of a, with "end" the second within `margin` of b. A line is the greatest value within `reach` and
    above `ratio` times the median of the span, zeros included; start and end are sub-pixel places, strength is the weaker
    line over the median of the profile's positive values. Pairs meet by buckets as wide as a span's longest pair.
    """
    line = Window.partitionBy("profile_id").orderBy("idx")
    seen = profile.withColumns({"top": F.max("value").over(line.rowsBetween(-reach, reach)), "before": F.lag("value").over(line), "after": F.lead("value").over(line)})
    inside = seen.join(spans, "profile_id").filter("idx >= a and idx < b")
    base = inside.groupBy("profile_id").agg(F.median("value").alias("base"))
    lines = inside.join(base, "profile_id").filter(F.expr(f"value >= top and value > {ratio} * base"))
    bend = F.expr("before - 2 * value + after")
    place = F.col("idx") - F.when(F.abs(bend) >= 1e-9, 0.5 * (F.col("after") - F.col("before")) / bend).otherwise(0.0)
    lines = lines.withColumn("place", F.coalesce(place, F.col("idx").cast("double")))
    width = F.greatest("most", F.lit(1))
    span = ("a", "b", "least", "most", "flush")
    one = lines.select("profile_id", *span, F.col("idx").alias("i"), F.col("value").alias("vi"), F.col("place").alias("start"), F.explode(F.sequence(F.floor(F.col("idx") / width), F.floor((F.col("idx") + F.col("most")) / width))).alias("bucket"))
    two = lines.select("profile_id", F.col("idx").alias("j"), F.col("value").alias("vj"), F.col("place").alias("end"), F.floor(F.col("idx") / width).alias("bucket"))
    ends = F.expr(f"case flush when 'start' then i <= a + {margin} when 'end' then j >= b - {margin} else true end")
    pairs = one.join(two, ["profile_id", "bucket"]).filter(F.expr("j - i between least and most") & ends)
    best = F.min_by(F.struct("i", "j", "start", "end", F.least("vi", "vj").alias("weaker")), F.struct(-F.least("vi", "vj"), "i", "j"))
    found = pairs.groupBy("profile_id").agg(best.alias("p")).join(median_of_positive(profile).withColumnRenamed("base", "usual"), "profile_id", "left")
    return found.select("profile_id", "p.i", "p.j", "p.start", "p.end", F.round(F.col("p.weaker") / F.greatest(F.coalesce("usual", F.lit(0.0)), F.lit(1e-6)), 1).alias("strength"))


def nearest_peak(edges: DataFrame, peaks: DataFrame, reach: int) -> DataFrame:
    """For each edge (profile_id, edge) the nearest peak within `reach`, the stronger of equally near ones; null without.

    Peaks are looked up by bucket, as in band_pairs.
    """
    width = max(reach, 1)
    keyed = edges.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("edge") - reach) / width), F.floor((F.col("edge") + reach) / width))))
    held = peaks.select(F.col("profile_id").alias("pid"), "idx", "ratio", F.floor(F.col("idx") / width).alias("of_bucket"))
    near = (F.col("profile_id") == F.col("pid")) & (F.col("bucket") == F.col("of_bucket")) & (F.abs(F.col("idx") - F.col("edge")) <= reach)
    found = keyed.join(held, near, "left")
    best = F.min_by(F.struct("idx", "ratio"), F.when(F.col("idx").isNotNull(), F.struct(F.abs(F.col("idx") - F.col("edge")), -F.col("ratio"), "idx"))).alias("p")
    return found.groupBy("profile_id", "edge").agg(best).select("profile_id", "edge", "p.idx", (F.col("p.idx") - F.col("edge")).alias("offset"))


def snap(edges: DataFrame, profile: DataFrame, reach: int, ratio: float) -> DataFrame:
    """Moves each edge to the strongest place within `reach` if it exceeds `ratio` times the profile's base."""
    width = max(reach, 1)
    keyed = edges.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("edge") - reach) / width), F.floor((F.col("edge") + reach) / width))))
    held = profile.select("profile_id", "idx", "value", F.floor(F.col("idx") / width).alias("bucket"))
    near = keyed.join(held, ["profile_id", "bucket"]).filter(F.abs(F.col("idx") - F.col("edge")) <= reach)
    best = near.groupBy("profile_id", "edge").agg(F.max(F.struct("value", (-F.col("idx")).alias("i"))).alias("b"))
    based = edges.join(best, ["profile_id", "edge"], "left").join(median_of_positive(profile), "profile_id", "left")
    return based.select("profile_id", "edge", F.when(F.col("b.value") > ratio * F.col("base"), -F.col("b.i")).otherwise(F.col("edge")).alias("snapped"))


def division_grid(profile: DataFrame, parts: int, gaps: list[int], lengths: list[int], starts: list[int]) -> DataFrame:
    """Per profile the (gap, start, length) whose shared edges have the largest mean value; the first of equal ones.

    The grid is generated, its edges are looked up by equi-join, and the best is one aggregation.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(s).alias("start"), F.lit(n).alias("length")) for g in gaps for s in starts for n in lengths]))
    ids = profile.select("profile_id").distinct().select("profile_id", grid.alias("c"))
    step = (F.col("c.length") - (parts - 1) * F.col("c.gap")) / parts
    plain = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda k: F.round(F.col("c.start") + k * step).cast("int"))
    split = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.array(F.round(F.col("c.start") + k * (step + F.col("c.gap"))).cast("int"), F.round(F.col("c.start") + k * (step + F.col("c.gap")) + step).cast("int"))))
    edges = ids.withColumn("idx", F.explode(F.when(F.col("c.gap") == 0, plain).otherwise(split)))
    scored = edges.join(profile, ["profile_id", "idx"]).groupBy("profile_id", "c").agg(F.avg("value").alias("score"))
    best = F.min_by(F.struct("c", "score"), F.struct(-F.col("score"), "c.gap", "c.start", "c.length")).alias("b")
    return scored.groupBy("profile_id").agg(best).select("profile_id", "b.c.*", "b.score")


def rectangle_gates(area: Column, short: Column, long: Column, rectangularity: Column, border: Column) -> Column:
    """Limits of candidate rectangles: area, sides, aspect, fill and border."""
    return area.between(420, 12000) & (short >= 18) & (long <= 130) & (long / short).between(1.02, 3.0) & (rectangularity >= 0.70) & (border >= 0.45)
