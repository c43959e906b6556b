"""Queries of grid operators over vectors read as 8 x 8 grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.operators import grids

DEGREES = [round(-10 + 0.5 * i, 1) for i in range(41)]
STRICT, LOOSE = 300, 100
FIRST = {"left": 2, "right": 6, "top": 2, "bottom": 6}
OUTWARD, INWARD, PASSES = 1, 2, 4


def _cells(spark, sf_dir):
    return grids.vector_cells(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 8)


def q70_local_background(spark, sf_dir):
    """Per grid, how far its brightest cell stands out from the cells around it, and how many stand out by their deviation."""
    found = grids.local_background(_cells(spark, sf_dir), reach=1, tile=4)
    return found.groupBy("grid").agg(F.round(F.max(F.col("value") - F.col("mean")), 4).alias("contrast"), F.count_if(F.col("value") > F.col("mean") + F.col("sd")).alias("bright"), F.round(F.max("sd"), 4).alias("roughest"))


def q71_grown_regions(spark, sf_dir):
    """Regions of cells over a loose threshold that hold a cell over a strict one."""
    found = grids.grown_regions(_cells(spark, sf_dir), F.col("value") >= STRICT, F.col("value") >= LOOSE)
    return found.groupBy("grid", F.col("region.y").alias("region_y"), F.col("region.x").alias("region_x")).agg(F.count("*").alias("cells"), F.sum(F.col("y") * 8 + F.col("x")).alias("places"))


def q72_best_angle(spark, sf_dir):
    """The angle of 41 at which a grid's profiles are sharpest."""
    return grids.best_angle(_cells(spark, sf_dir), (3.5, 3.5), DEGREES)


def q73_fitted_edges(spark, sf_dir):
    """Four edges of each grid, settled in turns on its strongest lines."""
    cells = _cells(spark, sf_dir)
    start = cells.select("grid").distinct().select("grid", *[F.lit(v).alias(k) for k, v in FIRST.items()])
    found = grids.fitted_edges(cells, start, OUTWARD, INWARD, PASSES)
    return found.select("grid", *[F.round(e, 6).alias(e) for e in grids.EDGES])


def q85_valid_tiles(spark, sf_dir):
    """Grids of which a quarter at most is dark, with that share."""
    return grids.valid_tiles(_cells(spark, sf_dir), dark=-100, most=0.25)


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}

_C = "c AS (SELECT vec_id AS grid, (i // 8)::INT AS y, (i % 8)::INT AS x, round(embedding[i + 1]::DOUBLE * 1000)::BIGINT AS v FROM embeddings, range(64) t(i))"


def _axis(step: int, state: str, along: str, edges: tuple[str, str], other: tuple[str, str]) -> tuple[str, str]:
    """SQL of one move of two edges: common table expressions, and the name of the new state."""
    tag = f"{along}{step}"
    across = "y" if along == "x" else "x"
    parts = [
        f'''p{tag} AS (SELECT s.grid, c.{along} AS i, sum(v) / count(*) AS v FROM {state} s JOIN c ON c.grid = s.grid AND {across} >= greatest(floor("{other[0]}"), 0) AND {across} < least(floor("{other[1]}"), 8) GROUP BY 1, 2)''',
        f"n{tag} AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS d FROM p{tag} WINDOW w AS (PARTITION BY grid ORDER BY i))",
    ]
    for edge, (before, after) in zip(edges, ((OUTWARD, INWARD), (INWARD, OUTWARD)), strict=True):
        low, high = max(FIRST[edge] - before, 0), min(FIRST[edge] + after, 7)
        parts.append(
            f"""e{tag}{edge} AS (SELECT grid, i + CASE WHEN i > {low} AND i < {high} AND a - 2 * v + d <> 0 THEN 0.5::DOUBLE * (a - d) / (a - 2 * v + d) ELSE 0 END AS e
      FROM n{tag} WHERE i BETWEEN {low} AND {high} QUALIFY row_number() OVER (PARTITION BY grid ORDER BY v DESC, i) = 1)"""
        )
    kept = ", ".join(f's."{o}"' for o in other)
    moved = ", ".join(f'coalesce(e{tag}{e}.e, {FIRST[e]})::DOUBLE AS "{e}"' for e in edges)
    joins = " ".join(f"LEFT JOIN e{tag}{e} ON e{tag}{e}.grid = s.grid" for e in edges)
    parts.append(f"s{tag} AS (SELECT s.grid, {kept}, {moved} FROM {state} s {joins})")
    return ", ".join(parts), f"s{tag}"


def _edges_sql() -> str:
    sql, state = f"WITH {_C}, s AS (SELECT DISTINCT grid, " + ", ".join(f'{v}::DOUBLE AS "{k}"' for k, v in FIRST.items()) + " FROM c)", "s"
    for step in range(PASSES):
        for axis in (("x", ("left", "right"), ("top", "bottom")), ("y", ("top", "bottom"), ("left", "right"))):
            part, state = _axis(step, state, axis[0], axis[1], axis[2])
            sql += ", " + part
    return f"{sql} SELECT grid, " + ", ".join(f'round("{e}", 6) AS "{e}"' for e in grids.EDGES) + f" FROM {state}"


ORACLES = {
    "q70_local_background": f"""WITH {_C}, b AS (SELECT a.grid, a.y, a.x, a.v, avg(o.v) AS mean, sqrt(greatest(sum(o.v * o.v) / count(*) - (sum(o.v) / count(*)) * (sum(o.v) / count(*)), 0)) AS sd
      FROM c a JOIN c o ON o.grid = a.grid AND o.y BETWEEN a.y - 1 AND a.y + 1 AND o.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)
    SELECT grid, round(max(v - mean), 4) AS contrast, count(*) FILTER (v > mean + sd) AS bright, round(max(sd), 4) AS roughest FROM b GROUP BY grid""",
    "q71_grown_regions": f"""WITH RECURSIVE {_C}, l AS (SELECT * FROM c WHERE v >= {LOOSE}),
    r AS (SELECT grid, y, x, y * 8 + x AS r FROM l UNION SELECT l.grid, l.y, l.x, r.r FROM r JOIN l ON l.grid = r.grid AND abs(l.y - r.y) <= 1 AND abs(l.x - r.x) <= 1),
    m AS (SELECT grid, y, x, min(r) AS r FROM r GROUP BY ALL), s AS (SELECT DISTINCT m.grid, m.r FROM m JOIN c USING (grid, y, x) WHERE v >= {STRICT})
    SELECT grid, (r // 8)::INT AS region_y, (r % 8)::INT AS region_x, count(*) AS cells, sum(y * 8 + x)::BIGINT AS places FROM m JOIN s USING (grid, r) GROUP BY ALL""",
    "q72_best_angle": f"""WITH {_C}, t AS (SELECT grid, x - 3.5::DOUBLE AS dx, y - 3.5::DOUBLE AS dy, v, -10 + 0.5::DOUBLE * k AS angle FROM c, range(41) g(k)),
    p AS (SELECT grid, angle, 0 AS axis, floor(round(dx * cos(radians(angle)) + dy * sin(radians(angle)), 9) + 0.5) AS bin, v FROM t
      UNION ALL SELECT grid, angle, 1, floor(round(dy * cos(radians(angle)) - dx * sin(radians(angle)), 9) + 0.5), v FROM t),
    q AS (SELECT grid, angle, axis, bin, sum(v) / count(*) AS level FROM p GROUP BY ALL), s AS (SELECT grid, angle, axis, var_pop(level) * count(*) AS s FROM q GROUP BY ALL),
    z AS (SELECT grid, angle, round(sum(s) + 0.0000123::DOUBLE, 3) AS sharpness FROM s GROUP BY ALL)
    SELECT grid, angle, sharpness FROM z QUALIFY row_number() OVER (PARTITION BY grid ORDER BY sharpness DESC, angle) = 1""",
    "q73_fitted_edges": _edges_sql(),
    "q85_valid_tiles": f"WITH {_C} SELECT grid, count(*) FILTER (v < -100) / count(*) AS dark_share FROM c GROUP BY grid HAVING count(*) FILTER (v < -100) / count(*) <= 0.25",
}
