"""Refresh of results with Structured Streaming: event-time joins of fixtures with reports, and tables of latest results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.streaming.log import ResultTable


def events_stream(spark: SparkSession, source: str, files_at_once: int | None = None) -> DataFrame:
    """A Parquet table as a stream, of so many files a batch."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    return reader.parquet(f"{source}*")  # a glob, for a source may be a single file


def results_stream(spark: SparkSession, source: str) -> DataFrame:
    """Events as a stream of results: a team's score in a code; errors and every seventh event are blank reads."""
    known = (F.col("event_type") != "error") & (F.col("event_id") % 7 != 0)
    return events_stream(spark, source).select(F.col("user_id").alias("team"), F.col("event_type").alias("code"), F.when(known, F.col("value")).alias("score"), "event_id")


def shared_root(spark: SparkSession) -> str:
    """A new folder in the session's shared one; a temporary one only in a local session that names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder or 'file://' + tempfile.mkdtemp(prefix='terrace-')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there; `sink` takes each batch and its number."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def refresh_once(spark: SparkSession, source: str) -> DataFrame:
    """Reads all that is there as a stream, merges it batch by batch and returns the table."""
    root = shared_root(spark)
    table = ResultTable(spark, f"{root}/table", ["team", "code"], "event_id")
    run_available(results_stream(spark, source), table.merge, f"{root}/checkpoint")
    return table.read().select("team", "code", "score")


def awaited_results(fixtures: DataFrame, reports: DataFrame, horizon: str = "10 days", late: str = "2 days") -> DataFrame:
    """Streams of fixtures (fixture, team, day) and reports (report, reported_team, at, score) joined in event time.

    A fixture waits for reports for `horizon` after its day: each report in that time makes a row, and a fixture without any makes one
    row without a report once the streams are `late` past it. Then both sides' state goes, so a result that never comes is
    not asked about forever. A report that is delivered again within `late` counts once; rows later than `late` are dropped.
    """
    fixtures = fixtures.withWatermark("day", late)
    reports = reports.withWatermark("at", late).dropDuplicatesWithinWatermark(["report"])
    when = F.expr(f"reported_team = team AND at >= day AND at <= day + interval {horizon}")
    return fixtures.join(reports, when, "left_outer").drop("reported_team")


def windowed_counts(events: DataFrame, late: str = "10 days", size: str = "7 days") -> DataFrame:
    """Event-time counts per code, with a watermark as long as the re-read window: a window is given once it is over."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class RowLog:
    """A sink of rows in a shared folder: a batch overwrites its own part, so a batch that comes again changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop("batch")


def awaited_once(spark: SparkSession, source: str) -> DataFrame:
    """Sign-ups as fixtures of a user, purchases as reports: which were reported within the horizon, and which ran out."""
    root = shared_root(spark)
    events = events_stream(spark, source)
    fixtures = events.filter("event_type = 'signup'").select(F.col("event_id").alias("fixture"), F.col("user_id").alias("team"), F.col("ts").cast("timestamp").alias("day"))
    again = events_stream(spark, source)
    reports = again.filter("event_type = 'purchase'").select(F.col("event_id").alias("report"), F.col("user_id").alias("reported_team"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("score"))
    sink = RowLog(spark, f"{root}/rows")
    run_available(awaited_results(fixtures, reports), sink, f"{root}/checkpoint")
    return sink.read()


def counts_once(spark: SparkSession, source: str) -> DataFrame:
    """Windows of events that are over, by type."""
    root = shared_root(spark)
    sink = RowLog(spark, f"{root}/rows")
    run_available(windowed_counts(events_stream(spark, source).withColumn("ts", F.col("ts").cast("timestamp")), late="2 days"), sink, f"{root}/checkpoint")
    return sink.read()
