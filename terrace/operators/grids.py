"""Operations on grids of cells (grid, y, x, value): prefix sums, background, regions, angle and edge fits. All in DataFrame functions.

Cells are rows, so a grid of any size is dealt over tasks by tiles or lines; nothing gathers a grid.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.streaming.refresh import shared_root


def vector_cells(rows: DataFrame, id_column: str, vector: str, width: int, scale: int = 1000) -> DataFrame:
    """Cells of vectors read line by line, in whole steps of 1 / scale so that sums do not depend on their order."""
    cells = rows.select(F.col(id_column).alias("grid"), F.posexplode(vector).alias("at", "v"))
    return cells.select("grid", F.expr(f"cast(at div {width} as int)").alias("y"), F.expr(f"at % {width}").alias("x"), F.round(F.col("v").cast("double") * scale).cast("long").alias("value"))


def _saved(df: DataFrame, root: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


def summed_area(cells: DataFrame, tile: int = 64) -> DataFrame:
    """(grid, y, x, value, area, squares): the sums of values, and of their squares, of all cells up to (y, x).

    Prefix sums within tiles by windows of a tile's line or column; a tile's last sums are then carried over the
    tiles to its left, above, and both, so no window holds more than a tile's line or a line of tiles.
    """
    at = cells.select("grid", "y", "x", "value", F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx"), F.col("value").alias("area"), (F.col("value") * F.col("value")).alias("squares"))
    frame = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = ("area", "squares")
    for by, order in ((("grid", "ty", "tx", "y"), "x"), (("grid", "ty", "tx", "x"), "y")):
        at = at.withColumns({c: F.sum(c).over(frame(by, order)) for c in both})
    # What the tiles to the left add is by line, what those above add by column; the corner's share is in both orders once.
    right = at.groupBy("grid", "ty", "tx", "y").agg(*[F.max_by(c, "x").alias(c) for c in both])
    left = right.withColumns({c: F.sum(c).over(Window.partitionBy("grid", "ty", "y").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)) for c in both})
    wide = at.join(left.select("grid", "ty", "tx", "y", *[F.coalesce(c, F.lit(0)).alias(f"left_{c}") for c in both]), ["grid", "ty", "tx", "y"])
    wide = wide.withColumns({c: F.col(c) + F.col(f"left_{c}") for c in both}).drop(*[f"left_{c}" for c in both])
    low = wide.groupBy("grid", "ty", "x").agg(*[F.max_by(c, "y").alias(c) for c in both])
    above = low.withColumns({c: F.sum(c).over(Window.partitionBy("grid", "x").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)) for c in both})
    whole = wide.join(above.select("grid", "ty", "x", *[F.coalesce(c, F.lit(0)).alias(f"above_{c}") for c in both]), ["grid", "ty", "x"])
    return whole.select("grid", "y", "x", "value", *[(F.col(c) + F.col(f"above_{c}")).alias(c) for c in both])


def local_background(cells: DataFrame, reach: int, tile: int | None = None) -> DataFrame:
    """(grid, y, x, value, n, mean, sd): number, mean and deviation of the cells within `reach`, clipped at the grid's ends.

    Sums along lines, then of these along columns, each as the difference of two prefix sums, whatever the reach: cells are
    shuffled twice, and a window holds one line or column. `tile`, which once cut the prefix sums, changes nothing.
    """

    def near(rows: DataFrame, by: str, order: str) -> DataFrame:
        line = Window.partitionBy("grid", by).orderBy(order)
        upto, before = (line.rangeBetween(Window.unboundedPreceding, end) for end in (reach, -reach - 1))
        return rows.withColumns({c: F.sum(c).over(upto) - F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "area", "squares")})

    counted = cells.select("grid", "y", "x", "value", F.lit(1).cast("long").alias("n"), F.col("value").alias("area"), (F.col("value") * F.col("value")).alias("squares"))
    found = near(near(counted, "y", "x"), "x", "y")
    mean = F.col("area") / F.col("n")
    return found.select("grid", "y", "x", "value", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))


def valid_tiles(cells: DataFrame, dark: int, most: float = 0.01) -> DataFrame:
    """(grid, dark_share) of grids of which no more than a share is nearly black, which a tile cut off on its way would be."""
    shares = cells.groupBy("grid").agg((F.count_if(F.col("value") < dark) / F.count("*")).alias("dark_share"))
    return shares.filter(F.col("dark_share") <= most)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; edges (a, b) either way.

    Labels pass over the edges, then to the label's own label, so a chain halves each time; passes are written to the
    shared folder until none changes a label.
    """
    spark, root = nodes.sparkSession, f"{shared_root(nodes.sparkSession)}/labels-{uuid.uuid4().hex}"
    both = _saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), root, "edges")
    labels, step = _saved(nodes.select("node", F.col("node").alias("label")), root, "0"), 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = least.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = least.join(up, "label", "left").select("node", "old", F.least("label", "above").alias("label"))
        step += 1
        jumped = _saved(jumped, root, str(step))
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels


def grown_regions(cells: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """(grid, y, x, region): cells that pass `loose` and are connected, also by corners, to one that passes `strict`.

    Two levels: cells of a line that touch are one run, numbered by a window; runs of neighbouring lines that touch are the edges
    of a graph of runs, whose components are the regions. A region is named by its first run's line and column.
    """
    line = Window.partitionBy("grid", "y").orderBy("x")
    held = cells.filter(loose).withColumn("strict", strict).withColumn("first", F.coalesce(F.col("x") - F.lag("x").over(line) > 1, F.lit(True)))
    held = held.withColumn("run", F.sum(F.col("first").cast("int")).over(line))
    runs = held.groupBy("grid", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("strict").alias("strict"))
    node = F.struct("grid", "y", "x0")
    runs = runs.withColumn("node", node)
    below = runs.select("grid", (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("node").alias("b"))
    edges = runs.join(below, ["grid", "y"]).filter("bx0 <= x1 + 1 and bx1 >= x0 - 1").select(F.col("node").alias("a"), "b")
    labels = connected(runs.select("node"), edges)
    named = runs.join(labels, "node")
    kept = named.filter("strict").select("label").distinct()
    named = named.join(kept, "label", "left_semi")
    region = F.struct(F.col("label.y").alias("y"), F.col("label.x0").alias("x"))
    return named.select("grid", "y", F.explode(F.sequence("x0", "x1")).alias("x"), region.alias("region"))


#: Keeps sums, which are often halves of a thousandth, off the places where rounding would turn on their last bit.
OFF_TIES = 0.0000123


def best_angle(cells: DataFrame, centre: tuple[float, float], degrees: list[float]) -> DataFrame:
    """(grid, angle, sharpness): the angle at which a grid's line and column profiles vary most, the least of equal ones.

    Each cell falls into one bin of each profile at each angle; profiles are sums by bin, combined in each task first.
    """
    turn = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("angle"), F.lit(math.cos(math.radians(d))).alias("c"), F.lit(math.sin(math.radians(d))).alias("s")) for d in degrees]))
    dx, dy = F.col("x") - centre[0], F.col("y") - centre[1]
    turned = cells.withColumn("t", turn)
    place = lambda axis, at: F.struct(F.lit(axis).alias("axis"), F.floor(F.round(at, 9) + 0.5).cast("int").alias("bin"))
    bins = turned.select("grid", "t.angle", F.explode(F.array(place(0, dx * F.col("t.c") + dy * F.col("t.s")), place(1, dy * F.col("t.c") - dx * F.col("t.s")))).alias("p"), "value")
    profile = bins.groupBy("grid", "angle", "p").agg((F.sum("value") / F.count("*")).alias("level"))
    spread = profile.groupBy("grid", "angle", "p.axis").agg((F.var_pop("level") * F.count("*")).alias("spread"))
    sharp = spread.groupBy("grid", "angle").agg(F.round(F.sum("spread") + OFF_TIES, 3).alias("sharpness"))
    return sharp.groupBy("grid").agg(F.max(F.struct("sharpness", (-F.col("angle")).alias("back"))).alias("m")).select("grid", (-F.col("m.back")).alias("angle"), "m.sharpness")


EDGES = ("left", "right", "top", "bottom")


def fitted_edges(cells: DataFrame, start: DataFrame, outward: int, inward: int, passes: int = 4) -> DataFrame:
    """(grid, left, right, top, bottom, passes): edges moved in turns to the strongest place of the profile between the other two.

    Bands are anchored to the first edges `start` (grid, left, right, top, bottom), never to the moving ones. A profile is read
    off prefix sums of its lines, two lookups each, so a pass does not sum the grid again; a grid whose edges stay leaves.
    """
    spark, root = cells.sparkSession, f"{shared_root(cells.sparkSession)}/edges-{uuid.uuid4().hex}"
    upto = lambda by, order: F.sum("value").over(Window.partitionBy("grid", by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sums = _saved(cells.select("grid", "y", "x", upto("x", "y").alias("down"), upto("y", "x").alias("along")), root, "sums")
    ends = sums.groupBy("grid").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    first = [F.col(e).cast("double").alias(f"{e}_0") for e in EDGES]
    state = _saved(start.join(ends, "grid").select("grid", "mx", "my", *[F.col(e).cast("double").alias(e) for e in EDGES], *first, F.lit(0).alias("passes")), root, "0")
    done = None
    for step in range(1, passes + 1):
        moved = _moved(sums, state, "x", "y", "down", ("left", "right"), ("top", "bottom"), "mx", "my", outward, inward)
        moved = _moved(sums, moved, "y", "x", "along", ("top", "bottom"), ("left", "right"), "my", "mx", outward, inward)
        old = state.select("grid", *[F.col(e).alias(f"{e}_old") for e in EDGES])
        stays = F.lit(True)
        for e in EDGES:
            stays = stays & (F.abs(F.col(e) - F.col(f"{e}_old")) < 1e-9)
        moved = _saved(moved.join(old, "grid").withColumn("stays", stays).withColumn("passes", F.lit(step)), root, str(step))
        over = moved.filter("stays" if step < passes else "true").select("grid", *EDGES, "passes")
        done = over if done is None else done.unionByName(over)
        state = moved.filter("not stays").select(*state.columns)
        if step < passes and state.isEmpty():
            break
    return done


def _moved(sums: DataFrame, state: DataFrame, along: str, across: str, prefix: str, edges: tuple[str, str], other: tuple[str, str], most: str, other_most: str, outward: int, inward: int) -> DataFrame:
    """The state with two opposite edges moved along one axis."""
    # The slice of the other axis: from its low edge, cut to whole cells, up to but without its high one.
    low, high = F.greatest(F.floor(other[0]), F.lit(0)).cast("int"), F.least(F.floor(other[1]), F.col(other_most) + 1).cast("int")
    # Edges that meet leave no slice and so no profile: the other two then stay at their first places.
    span = state.select("grid", low.alias("lo"), high.alias("hi")).filter("lo < hi")
    lookups = span.select("grid", F.explode(F.array(F.struct((F.col("hi") - 1).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("lo") - 1).alias("at"), F.lit(-1).alias("sign")))).alias("l"), (F.col("hi") - F.col("lo")).alias("n"))
    lookups = lookups.select("grid", F.col("l.at").alias(across), "l.sign", "n")
    profile = sums.join(lookups, ["grid", across]).groupBy("grid", F.col(along).alias("i"), "n").agg((F.sum(F.col(prefix) * F.col("sign")) / F.col("n")).alias("v"))
    line = Window.partitionBy("grid").orderBy("i")
    profile = profile.select("grid", "i", "v", F.lag("v").over(line).alias("a"), F.lead("v").over(line).alias("c"))
    out = state
    for edge, (before, after) in zip(edges, ((outward, inward), (inward, outward)), strict=True):
        a = F.greatest(F.bround(F.col(f"{edge}_0") - before), F.lit(0)).cast("int")
        b = F.least(F.bround(F.col(f"{edge}_0") + after), F.col(most)).cast("int")
        band = state.select("grid", a.alias("from"), b.alias("to")).filter("to - from >= 3")
        seen = profile.join(band, "grid").filter("i between from and to")
        best = seen.groupBy("grid").agg(F.max_by(F.struct("i", "v", "a", "c", "from", "to"), F.struct("v", -F.col("i"))).alias("m"))
        bend = F.expr("m.a - 2 * m.v + m.c")
        shift = F.when((F.col("m.i") > F.col("m.from")) & (F.col("m.i") < F.col("m.to")) & (bend != 0), F.expr("0.5 * (m.a - m.c)") / bend).otherwise(0.0)
        out = out.join(best.select("grid", (F.col("m.i") + shift).alias("_new")), "grid", "left").withColumn(edge, F.coalesce("_new", F.col(f"{edge}_0"))).drop("_new")
    return out
