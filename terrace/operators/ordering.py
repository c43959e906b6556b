"""Places in a total order of a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.streaming.refresh import shared_root


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Rows with their place from 1 in a total order.

    Range partitions are sorted and written; a place is the row's number in its partition and the sizes of those before it. So no
    task sorts more than its range, and only the partitions' sizes meet in one window.
    """
    root = f"{shared_root(rows.sparkSession)}/order-{uuid.uuid4().hex}"
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    runs = runs.withColumns({"_run": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    runs.write.parquet(root)
    runs = rows.sparkSession.read.schema(runs.schema).parquet(root)
    sizes = runs.groupBy("_run").agg(F.count("*").alias("n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return runs.join(sizes, "_run").withColumn(name, F.col("_before") + F.col("_row") + 1).select(*rows.columns, name)


def publication_order(teams: DataFrame, team: str, division: str) -> DataFrame:
    """Teams with their place by lower-cased name, then division."""
    return numbered(teams, F.lower(F.col(team)), F.col(division))
