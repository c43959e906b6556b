"""Gram index and keyed releases: results, and what their plans read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terrace.functions.text import fold
from terrace.operators.grams import GramIndex, first_hits
from terrace.plans.release import KeyedRelease


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    letters = "aábcčdeéě "
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(300)] + [(900, None), (901, "ab"), (902, "Příliš ŽLUŤOUČKÝ kůň")]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    made = GramIndex(spark, texts, "id", "text", buckets=16, splits=2, root=f"file://{tmp_path_factory.mktemp('grams')}")
    yield made
    made.drop()


@pytest.mark.parametrize("needle", ["abc", "čde", "ée a", "zlutoucky", "ŽLUT", "aaaa", "aa", "", "zzzz", "Kun"])
def test_search_equals_a_scan(spark, texts, index, needle):
    want = texts.filter(F.contains(fold(F.col("text")), fold(F.lit(needle))))
    got = index.search(needle)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def plan_of(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_a_search_reads_the_buckets_of_its_grams_alone(spark, index):
    # The scan names the buckets that it selects only while it keeps them as partitions.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        one, three = plan_of(index.candidates("abc")), plan_of(index.candidates("abcde"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    selected = lambda plan: tuple(map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan).groups()))
    assert selected(one)[0] <= 2 and selected(three)[0] <= 6 and selected(one)[1] == 16  # a gram is in two lists
    assert "In(list" in three and "text" not in three


def test_first_hits_count_what_they_leave_out(spark):
    got = first_hits(spark.range(50).withColumnRenamed("id", "n"), "n", limit=3).collect()
    assert [tuple(r) for r in got] == [(0, 47), (1, 47), (2, 47)]
    assert [tuple(r) for r in first_hits(spark.range(2), "id", limit=3).orderBy("id").collect()] == [(0, 0), (1, 0)]


def payloads(spark, n: int, mark: str = ""):
    return spark.range(n).select(F.col("id").alias("slug"), F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(mark)).alias("payload"))


def test_a_release_keeps_one_spare_and_stays_when_unchanged(spark, tmp_path):
    release = KeyedRelease(spark, f"file://{tmp_path}", "slug", parts=8)
    assert release.live() == []
    one = release.publish(payloads(spark, 100))
    two = release.publish(payloads(spark, 100, "b"))
    assert release.live() == [two, one]
    assert release.publish(payloads(spark, 100, "b").repartition(5)) == two and release.live() == [two, one]
    assert release.get(7).collect()[0]["payload"] == "p7b" and release.get(7, one).collect()[0]["payload"] == "p7"
    three = release.publish(payloads(spark, 100, "c"))
    assert release.live() == [three, two] and sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("h-")) == sorted([two, three])
    assert release.publish(payloads(spark, 100, "b")) == two and release.live() == [two, three]


def test_a_lookup_reads_one_part_and_a_join_prunes_as_it_runs(spark, tmp_path):
    release = KeyedRelease(spark, f"file://{tmp_path}", "slug", parts=8)
    release.publish(payloads(spark, 500))
    one = release.get(42)
    assert [tuple(r) for r in one.collect()] == [(42, "p42")]
    plan = plan_of(one)
    assert re.search(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = \d+\)\]", plan) and "EqualTo(slug,42)" in plan
    assert release.get(10**9).count() == 0
    keys = spark.range(500).withColumnRenamed("id", "slug").filter("slug in (3, 44, 7000)")
    many = release.get_all(keys)
    assert sorted(map(tuple, many.collect())) == [(3, "p3"), (44, "p44")]
    assert "dynamicpruning" in many._jdf.queryExecution().toString()
