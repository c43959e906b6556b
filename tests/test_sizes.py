"""What keeps the work of a task, and what is shuffled, from growing faster than the tables."""

import re

import pytest
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import grids, meetings
from terrace.operators.grams import GramIndex
from terrace.plans import publish
from terrace.sources import html

MATCH = "family string, slug long, opponent long, season int, day date, match_id long, line int, res string, gf int, ga int"


@pytest.fixture
def no_small_tables(spark):
    """Only what the code marks is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def played(spark):
    rows = [("f", s % 5, s % 3, 2 + s % 3, None, s, 1, "WDL"[s % 3], s % 4, s % 2) for s in range(40)]
    return spark.createDataFrame(rows, MATCH)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_are_not_dealt_by_family(spark, no_small_tables):
    m = played(spark)
    past = meetings.past_meetings(m, m.groupBy("family").agg(F.max("season").alias("current")))
    plan = plan_of(past)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert past.filter("season = 4").count() == 0 and past.count() == sum(2 + s % 3 != 4 for s in range(40))


def test_tasks_of_pairs_follow_the_rows(spark):
    assert meetings.tasks(spark, 0) == spark.sparkContext.defaultParallelism
    assert meetings.tasks(spark, 100 * meetings.TASK_ROWS + 1) == 101
    m = played(spark)
    for dealt, plain in ((meetings.balance(m, 7), meetings.balance(m)), (meetings.tally(m, 7), meetings.tally(m))):
        # One dealing with as many tasks as asked for, and no further one for the groups.
        assert re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan_of(dealt)) == ["7"]
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_meetings_of_other_pairs_leave_before_lists_are_made(spark, no_small_tables):
    m = played(spark)
    fixtures = spark.createDataFrame([("f", 1, 1, "x"), ("f", 1, 1, "y"), ("f", 3, 9, "x")], "family string, slug long, opponent long, note string")
    lists = meetings.meeting_lists(fixtures, m)
    plan = plan_of(lists)
    assert plan.index("ObjectHashAggregate") < plan.index("LeftSemi")
    got = [(r["note"], [x["match_id"] for x in r["meetings"]], r["w"] + r["d"] + r["l"]) for r in lists.orderBy("note").collect()]
    want = [s for s in range(40) if s % 5 == 1 and s % 3 == 1]
    assert got == [("x", want, len(want)), ("y", want, len(want))]


def test_texts_that_nothing_would_change_are_left_alone(spark):
    texts = ["plain name", "", " lead", "trail ", "two  blanks", "tab\there", "a\xa0b", "a<br>b", "x &amp; y", "a\n b", "a  ", "a\rb", "a\x0bb\x0b", "ěšč 1:2", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip_tags(F.col("t")).alias("got"), text._stripped(F.col("t")).alias("want"), F.col("t").rlike(text.TO_STRIP).alias("changes")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert all(r["changes"] for r in got if r["got"] != r["t"]) and not got[0]["changes"]


def test_a_filter_copies_no_parsing(spark):
    pages = spark.createDataFrame([("A", "<table></table>")], "team string, html string")
    plan = html.fixtures(pages)._jdf.queryExecution().optimizedPlan().toString()
    # A plan is printed with the texts of its patterns, which hold line breaks: each node begins with its mark.
    filters = [node for node in re.split(r"\n *\+- ", plan) if node.startswith("Filter")]
    assert filters and not any("regexp" in node for node in filters)


def test_details_and_sheets_are_read_in_one_pass(spark):
    pages = spark.createDataFrame([("t1", "<table></table>")], "slug string, html string")
    plan = html.season_with_sheets(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate explode\((?:filter\(split|regexp_extract_all)\(html#", plan)) == 1


def test_blocks_begin_at_each_anchor(spark):
    page = 'x id="game-1" a ID="game-2"\nb id="game-x" id="game-30"'
    pages = spark.createDataFrame([("k", page), ("n", None), ("o", "none"), ("s", 'id="game-7"')], "k string, html string")
    got = [tuple(r) for r in html.match_blocks(pages).collect()]
    assert got == [("k", 'id="game-1" a '), ("k", 'ID="game-2"\nb id="game-x" '), ("k", 'id="game-30"'), ("s", 'id="game-7"')]


def test_coverage_deals_teams_and_grounds_out(spark):
    rows = [(i % 5 if i % 7 else None, i % 3, float(i) if i % 2 else None, i % 4 == 1) for i in range(60)]
    fixtures = spark.createDataFrame(rows, "team long, code long, score double, official boolean")
    got = publish.coverage(fixtures, 6)
    assert "Expand" not in plan_of(got)
    want = (5, 60, 30, sum(1 for _, _, s, o in rows if o and s is not None), 3)
    assert tuple(got.first()) == want == tuple(publish.coverage(fixtures).first())
    assert tuple(publish.coverage(fixtures.filter("false"), 6).first()) == (0, 0, 0, 0, 0)


def test_background_shuffles_cells_twice(spark, no_small_tables):
    cells = spark.createDataFrame([(1, y, x, y * x) for y in range(4) for x in range(5)], "grid long, y int, x int, value long")
    assert plan_of(grids.local_background(cells, reach=1)).count("Exchange hashpartitioning") == 2


def test_an_index_shuffles_postings_once_and_takes_repeated_ids(spark, tmp_path):
    texts = spark.createDataFrame([(1, "abcd"), (1, "xabc"), (2, "bcd"), (3, "abc")], "id long, text string")
    index = GramIndex(spark, texts, "id", "text", buckets=4, splits=2, root=f"file://{tmp_path}")
    assert spark.table(index.table).filter("gram = 'abc'").count() == 3
    assert sorted(map(tuple, index.search("abc").collect())) == [(1, "abcd"), (1, "xabc"), (3, "abc")]
    assert sorted(map(tuple, index.search("abcd").collect())) == [(1, "abcd")]
    index.drop()
