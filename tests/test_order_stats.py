"""Rank selection against sorting, and what a task sees of a large group."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from terrace.operators.order_stats import RankSelection, best_capture, quantiles, robust_stats


def groups(seed: int) -> dict:
    rng = random.Random(seed)
    return {
        "even": [rng.uniform(-5, 5) for _ in range(700)],
        "ties": [float(rng.choice([1, 2, 2, 2, 3])) for _ in range(500)],
        "one": [4.5],
        "same": [7.0] * 90,
        "steep": [10.0 ** rng.uniform(-200, 200) for _ in range(400)],
        None: [1.0, 2.0],
    }


def frame(spark, data: dict):
    return spark.createDataFrame([(k, v) for k, values in data.items() for v in values] + [("even", None), ("even", float("nan"))], "k string, v double")


@pytest.mark.parametrize(("bins", "few"), [(64, 0), (1024, 50)])
def test_every_rank_is_the_sorted_value(spark, bins, few):
    data = groups(bins)
    selection = RankSelection(frame(spark, data), ["k"], "v", bins=bins, few=few)
    ranks = selection.groups.select("_key", "k", F.explode(F.expr("array(0, 1, n div 3, n div 2, n - 2, n - 1, n, -1)")).alias("rank"))
    got = {(r["k"], r["rank"]): r["value"] for r in selection.at(ranks.select("_key", "rank")).join(selection.groups, "_key").collect()}
    want = {(k, r): sorted(v)[r] for k, v in data.items() for r in {0, 1, len(v) // 3, len(v) // 2, len(v) - 2, len(v) - 1} if 0 <= r < len(v)}
    assert got == want


def test_quantiles_lie_between_two_values_and_robust_stats_follow(spark):
    data = groups(3)
    got = {r["k"]: r for r in robust_stats(frame(spark, data), ["k"], "v", bins=64, few=30).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        middle = statistics.median(values)
        assert got[k]["median"] == pytest.approx(middle)
        assert got[k]["mad"] == pytest.approx(statistics.median(abs(v - middle) for v in values))
        assert got[k]["mean"] == pytest.approx(statistics.mean(values))


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert [tuple(r) for r in quantiles(df, [], "v", {"q": 0.25}).collect()] == [(11, 5.0, 2.5)]
    assert quantiles(df.filter("v < 0"), [], "v", {"q": 0.5}).count() == 0


def test_no_aggregation_holds_a_groups_values(spark):
    """One group of all rows: what is numbered in one task is bounded by `few`, whatever the group's size."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.xxhash64("id") % 100_000).cast("double").alias("v"))
    selection = RankSelection(df, ["k"], "v", bins=64, few=500)
    seen = []
    numbered = selection._numbered
    selection._numbered = lambda rows, targets: seen.append(targets.agg(F.max("n")).first()[0]) or numbered(rows, targets)
    got = selection.quantiles({"m": 0.5, "p": 0.995}).first()
    want = df.agg(F.median("v"), F.percentile("v", F.lit(0.995))).first()
    assert (got["m"], got["p"]) == pytest.approx(tuple(want)) and max(seen) <= 500
    plan = selection.groups._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_best_capture_by_contrast_then_name(spark):
    rows = [("g", c, float(v)) for c, values in {"b": [1] * 200 + [50] * 5, "a": [1] * 200 + [50] * 5, "c": [1] * 205}.items() for v in values] + [("h", "z", 0.0)]
    got = best_capture(spark.createDataFrame(rows, "ground string, capture string, v double"), ["ground"], "capture", "v").collect()
    assert [tuple(r) for r in sorted(got)] == [("g", "a", 50.0), ("h", "z", 0.0)]
