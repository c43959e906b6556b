"""The result table over restarts and replays, footwear rules, digests and set comparisons."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terrace.functions import rules
from terrace.operators.dedupe import compare_sets
from terrace.plans.publish import digest_tree
from terrace.streaming import refresh
from terrace.streaming.log import ResultTable

SCHEMA = "team long, code string, score double, event_id long"


def held(table: ResultTable) -> dict:
    return {(r["team"], r["code"]): r["score"] for r in table.read().collect()}


def table(spark, tmp_path, **options) -> ResultTable:
    return ResultTable(spark, f"file://{tmp_path}/table", ["team", "code"], "event_id", **({"buckets": 4} | options))


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_result_table_survives_a_restart_and_a_replay(spark, tmp_path):
    make = lambda: table(spark, tmp_path)
    first = rows(spark, [(i, "a", float(i), i) for i in range(20)])
    second = rows(spark, [(3, "a", None, 50), (4, "a", 9.0, 51), (99, "b", 1.0, 52)])
    assert make().read() is None
    make().merge(first, 0, "w")
    make().merge(second, 1, "w")  # another instance, as after a restart
    want = {(i, "a"): float(i) for i in range(20)} | {(4, "a"): 9.0, (99, "b"): 1.0}
    assert held(make()) == want
    before = make().manifest()["version"]
    make().merge(second, 1, "w")
    make().merge(first, 0, "w")
    assert held(make()) == want and make().manifest()["version"] == before


def test_a_new_checkpoint_starts_at_0_and_erases_nothing(spark, tmp_path):
    table(spark, tmp_path).merge(rows(spark, [(i, "a", float(i), i) for i in range(40)]), 0, "old checkpoint")
    table(spark, tmp_path).merge(rows(spark, [(100 + i, "a", 1.0, 100 + i) for i in range(5)]), 0, "new checkpoint")
    assert len(held(table(spark, tmp_path))) == 45


def test_two_writers_lose_no_row(spark, tmp_path):
    """Both read the same version before either commits: the second claims the next number with the first one's parts."""
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.merge(rows(spark, [(0, "a", 1.0, 0)]), 0, "one")
    claim, done = one.files.claim, []

    def late(name: str, text: str) -> bool:
        if not done:
            done.append(two.merge(rows(spark, [(1, "a", 2.0, 1), (0, "a", 3.0, 2)]), 0, "two"))
        return claim(name, text)

    one.files.claim = late
    one.merge(rows(spark, [(2, "a", 4.0, 3)]), 1, "one")
    assert held(one) == {(0, "a"): 3.0, (1, "a"): 2.0, (2, "a"): 4.0}
    assert one.manifest()["batches"] == {"one": 1, "two": 0} and one.manifest()["version"] == 2


def test_a_compaction_that_meets_another_starts_again(spark, tmp_path):
    one, two = table(spark, tmp_path, buckets=1, most_parts=99), table(spark, tmp_path, buckets=1, most_parts=2)
    for i in range(4):
        one.merge(rows(spark, [(i, "a", 1.0, i)]), i, "w")
    claim, done = two.files.claim, []

    def late(name: str, text: str) -> bool:
        if not done:
            done.append(1)
            table(spark, tmp_path, buckets=1, most_parts=2).compact()
            one.merge(rows(spark, [(9, "a", 9.0, 9)]), 4, "w")
        return claim(name, text)

    two.files.claim = late
    two.compact()
    assert held(two) == {(i, "a"): 1.0 for i in range(4)} | {(9, "a"): 9.0}
    assert len(two.manifest()["parts"]["0"]) == 2  # one compacted, one added meanwhile


def test_a_batch_writes_its_rows_alone_and_many_parts_are_compacted(spark, tmp_path):
    own = table(spark, tmp_path, buckets=2, most_parts=3)
    for i in range(5):
        own.merge(rows(spark, [(j, "a", float(i), i) for j in range(10 * i, 10 * i + 10)]), i, "w")
    assert len(held(own)) == 50
    assert all(len(parts) <= 3 for parts in own.manifest()["parts"].values())


def test_one_spare_version_is_kept_and_older_ones_go(spark, tmp_path):
    own = table(spark, tmp_path, buckets=1, most_parts=1)
    for i in range(5):
        own.merge(rows(spark, [(1, "a", float(i), i)]), i, "w")
    newest = own.manifest()["version"]
    assert own.versions() == [newest - 1, newest]
    assert held(own) == {(1, "a"): 4.0} and own.read(newest - 1).count() == 1
    named = {n.split("/")[1] for v in own.versions() for parts in own.manifest(v)["parts"].values() for n in parts}
    assert {p.name for p in (tmp_path / "table" / "data").iterdir()} == named


def test_a_part_without_a_commit_is_not_read(spark, tmp_path):
    own = table(spark, tmp_path)
    own.merge(rows(spark, [(1, "a", 1.0, 1)]), 0, "w")
    own._write(rows(spark, [(1, "a", 2.0, 2)]))
    assert held(own) == {(1, "a"): 1.0}


FIXTURES, REPORTS = "fixture long, team long, day timestamp", "report long, reported_team long, at timestamp, score double"


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, 1, hour) + timedelta(days=day)


def test_awaited_results_over_batches_late_rows_and_a_restart(spark, tmp_path):
    """A file is a batch; the query stops and starts between files, so state and watermark come from the checkpoint."""
    sink = refresh.RowLog(spark, f"file://{tmp_path}/rows")

    def more(fixtures: list, reports: list) -> None:
        for name, data, schema in (("fixtures", fixtures, FIXTURES), ("reports", reports, REPORTS)):
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("fixtures", FIXTURES), ("reports", REPORTS))]
        refresh.run_available(refresh.awaited_results(*streams), sink, f"{tmp_path}/checkpoint")

    more([(1, 7, at(0)), (2, 8, at(1)), (3, 9, at(2))], [(50, 7, at(3), 1.0), (50, 7, at(3), 1.0)])
    got = lambda: sorted(((r["fixture"], r["report"]) for r in sink.read().collect()), key=str)
    assert got() == [(1, 50)]  # delivered twice, counted once; 2 and 3 still wait
    more([(4, 7, at(14))], [(50, 7, at(3), 1.0), (51, 8, at(10), 2.0), (52, 1, at(14, 6), 0.0)])
    assert (2, 51) in got() and (1, 50) in got()  # joined with state of the run before; 3 is over the horizon at day 12 = 14 - 2
    more([(5, 6, at(20))], [(53, 9, at(3), 9.0), (54, 5, at(20), 0.0)])
    # A report of day 3 is later than the watermark of day 12 and is dropped, so fixture 3 ran out.
    assert got() == sorted([(1, 50), (2, 51), (3, None)], key=str)
    # A batch that is given again overwrites itself.
    before = got()
    sink(spark.createDataFrame([], sink.read().schema), 99)
    assert got() == before


def test_windowed_counts_give_a_window_once_it_is_over(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    sink = refresh.RowLog(spark, f"file://{tmp_path}/rows")
    for data in ([(at(1), "a", 1.0), (at(2), "a", 2.0)], [(at(9), "a", 4.0)], [(at(1), "a", 100.0), (at(30), "b", 1.0)]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/events")
        refresh.run_available(refresh.windowed_counts(stream, late="1 day"), sink, f"{tmp_path}/checkpoint")
    got = {(r["window"]["start"].date().isoformat(), r["event_type"]): (r["n"], r["total"]) for r in sink.read().collect()}
    assert got == {("2023-12-28", "a"): (2, 3.0), ("2024-01-04", "a"): (1, 4.0)}  # the late row of day 1 is dropped


def test_footwear_by_whole_terms(spark):
    cases = {
        "Povrch: x\nObuv: AG povoleny, ale zakázány lisovky ": ("forbidden", "allowed", "AG or turf, no lisovky"),
        "Povrch: x\n Obuv: AG povoleny, ale zakázány lisovky": ("unknown", "unknown", ""),
        "Obuv: magnetické povoleny": ("unknown", "unknown", "no lisovky"),
        "Obuv: lisovky povoleny": ("allowed", "unknown", "lisovky OK"),
        "Obuv: zakázány lisovky i AG": ("forbidden", "forbidden", "turf / indoor only"),
        "nic": ("unknown", "unknown", ""),
    }
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", rules.footwear(F.col("n")).alias("f")).collect()
    assert {r["n"]: (r["f"]["studs"], r["f"]["artificial"], r["f"]["summary"]) for r in got} == cases


def test_compared_sets(spark):
    df = spark.createDataFrame([("k", 1, 1), ("k", 2, 1), ("k", 2, 2), ("k", 3, 2), ("k", 2, 1), ("m", 1, 1)], "k string, x int, side int")
    got = compare_sets(df, ["k"], "x", F.col("side") == 1, F.col("side") == 2).collect()
    assert [tuple(r) for r in got] == [("k", 3, 1, 1, False)]


def test_digest_tree_depends_on_order_and_content_alone(spark):
    rows = [(i, f"p{i}") for i in range(300)]
    digest = lambda data, n: digest_tree(spark.createDataFrame(data, "id long, payload string").repartition(n), [], F.floor(F.col("id") / 50), "id", "payload").first()
    assert digest(rows, 3) == digest(rows[::-1], 7) and digest(rows, 3)["n"] == 300
    assert digest(rows, 3)["digest"] != digest([*rows[:-1], (299, "other")], 3)["digest"]
