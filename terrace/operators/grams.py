"""Folded substring search by an inverted index of three-character grams.

The index is a bucketed, sorted table of postings (list, gram, doc): a list holds a gram's documents of one of `splits` shares of
the ids, so a frequent gram is spread over as many lists, and its buckets over as many tasks. A search computes the lists of the
needle's grams, reads the buckets of those lists alone, keeps documents that hold every gram, and verifies them on their texts.
A needle of fewer than three characters has no gram; it is searched for in all texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.text import fold
from terrace.streaming.refresh import shared_root

GRAM, BUCKETS, SPLITS = 3, 64, 4


def grams(folded: Column) -> Column:
    """The distinct grams of a folded text, in one pass over it; none if it is shorter than one."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


class GramIndex:
    """An index of one table of texts by id."""

    def __init__(self, spark: SparkSession, texts: DataFrame, id_column: str, text_column: str, buckets: int = BUCKETS, splits: int = SPLITS, root: str | None = None):
        self.spark, self.texts, self.id, self.text, self.buckets, self.splits = spark, texts, id_column, text_column, buckets, splits
        name = uuid.uuid4().hex
        self.table = f"grams_{name}"
        share = F.pmod(F.xxhash64(id_column), F.lit(splits)).cast("int")
        postings = texts.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc"), share.alias("share"), F.explode(grams(fold(F.col(text_column)))).alias("gram"))
        postings = postings.select(F.xxhash64("gram", "share").alias("list"), "gram", "doc")
        # One file a bucket: the same hash deals the rows to tasks and to buckets. This is the only shuffle: a text's grams are
        # distinct as they are, and what an id that repeats posts twice is told apart by the searches, which read few lists.
        postings = postings.repartition(buckets, "list")
        postings.write.bucketBy(buckets, "list").sortBy("list", "doc").option("path", f"{root or shared_root(spark)}/{self.table}").saveAsTable(self.table)

    def lists(self, needle: str) -> list[tuple[str, int]]:
        """(gram, list) of the needle's grams: the lists that hold them."""
        one = self.spark.range(1).select(F.explode(grams(fold(F.lit(needle)))).alias("gram"))
        keys = one.select("gram", F.explode(F.sequence(F.lit(0), F.lit(self.splits - 1))).alias("share"))
        return [(r["gram"], r["list"]) for r in keys.select("gram", F.xxhash64("gram", "share").alias("list")).collect()]

    def candidates(self, needle: str) -> DataFrame:
        """(doc): documents that hold all grams of the needle; all documents if it has none."""
        lists = self.lists(needle)
        names = sorted({gram for gram, _ in lists})
        if not names:
            return self.texts.select(F.col(self.id).alias("doc")).filter("doc is not null").distinct()
        read = self.spark.table(self.table).filter(F.col("list").isin([at for _, at in lists]) & F.col("gram").isin(names))
        return read.groupBy("doc").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(names)).select("doc")

    def search(self, needle: str) -> DataFrame:
        """Rows of the texts whose folded text contains the folded needle."""
        found = self.texts.join(self.candidates(needle), F.col(self.id) == F.col("doc"), "left_semi")
        return found.filter(F.contains(fold(F.col(self.text)), fold(F.lit(needle))))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def first_hits(hits: DataFrame, order: str, limit: int = 40) -> DataFrame:
    """The first hits in order, each with the number that the list leaves out. Hits are found once and kept in the shared folder."""
    spark = hits.sparkSession
    path = f"{shared_root(spark)}/hits"
    hits.write.parquet(path)
    found = spark.read.schema(hits.schema).parquet(path)
    return found.orderBy(order).limit(limit).withColumn("more", F.greatest(F.lit(found.count() - limit), F.lit(0)))
