"""JSON documents whose key is the file name, layered lists and images, as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.dedupe import overlay
from terrace.streaming.log import Files


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)


def json_documents(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """(key, doc): each file as one value of the schema, keyed by the file's stem."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(_stem().alias(key), F.from_json("value", schema).alias("doc"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """(season, slug, division) from {slug: division} documents. An empty document gives no rows but is a season; see seasons()."""
    docs = json_documents(spark, path, "map<string,string>", "season")
    return docs.select("season", F.explode("doc").alias("slug", "division"))


def seasons(spark: SparkSession, path: str) -> DataFrame:
    """(season): all documents, empty ones too."""
    return spark.read.text(path, wholetext=True).select(_stem().alias("season")).distinct()


def standings(spark: SparkSession, path: str) -> DataFrame:
    """(season, division, place, slug, played, w, d, l, score, points) from {division: [[place, slug, ...]]} documents."""
    docs = json_documents(spark, path, "map<string,array<array<string>>>", "season")
    rows = docs.select("season", F.explode("doc").alias("division", "rows")).select("season", "division", F.explode("rows").alias("r"))
    value = lambda i: F.get("r", F.lit(i))
    number = lambda i: value(i).try_cast("int")
    return rows.select("season", "division", number(0).alias("place"), value(1).alias("slug"), number(2).alias("played"), number(3).alias("w"), number(4).alias("d"), number(5).alias("l"), value(6).alias("score"), number(7).alias("points"))


VENUE = "struct<code:string,name:string,lat:double,lon:double,address:string,notes:string,surface:string,training:boolean>"


def venues(spark: SparkSession, base: str, extra: str) -> DataFrame:
    """Venues with extra ones laid over them; keys that start with _ are comments."""
    read = lambda path: spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{VENUE}>")).alias("code", "v")).select("code", "v.name", "v.lat", "v.lon", "v.address", "v.notes", "v.surface", "v.training")
    return overlay(read(base), read(extra), "code")


def opt_outs(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value): players and teams that asked to be left out."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<players:array<string>,teams:array<string>>").alias("d"))
    kinds = F.map_from_arrays(F.array(F.lit("player"), F.lit("team")), F.array("d.players", "d.teams"))
    return doc.select(F.explode(kinds).alias("kind", "values")).select("kind", F.explode("values").alias("value"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(code, content) of image files."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("code"), "content")


def tile_is_valid(dark_share: Column) -> Column:
    """Whether no more than a hundredth of a tile is nearly black."""
    return dark_share <= 0.01


def seasons_by_family(index: DataFrame, family: str, season: str, order: str) -> DataFrame:
    """(family, seasons): each family's distinct seasons as a list, newest first; equal orders by name."""
    each = index.groupBy(family, season).agg(F.max(order).alias("_order"))
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("_order", season))))
    return each.groupBy(family).agg(F.transform(newest, lambda s: s[season]).alias("seasons"))


class FilledTable:
    """A table of rows by key in a shared folder that is read where it holds a key, and filled where it does not.

    Each fill appends its rows and its keys: a key without rows is known to be empty and is not asked for again. Both are parts of
    one folder that counts only once it is whole, so a fill that was cut off is done anew.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        self.spark, self.folder, self.key, self.schema = spark, folder, key, schema
        self.files = Files(spark, folder)

    def _read(self, kind: str, schema: str) -> DataFrame:
        whole = [n for n, _ in self.files.listed(self.folder) if n.startswith("fill-") and any(x == "done" for x, _ in self.files.listed(f"{self.folder}/{n}"))]
        paths = [f"{self.folder}/{n}/{kind}" for n in sorted(whole)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def get(self, wanted: DataFrame, fill: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of the wanted keys; `fill` makes those of the keys that are not held, from a table of these keys."""
        kind = f"{self.key} {wanted.schema[self.key].dataType.simpleString()}, _fill string"
        keys = wanted.select(self.key).distinct()
        missing = keys.join(self._read("keys", kind), self.key, "left_anti")
        if not missing.isEmpty():
            name = uuid.uuid4().hex
            part = f"{self.folder}/fill-{name}"
            missing.withColumn("_fill", F.lit(name)).write.parquet(f"{part}/keys")
            asked = self.spark.read.schema(kind).parquet(f"{part}/keys")
            fill(asked.select(self.key)).join(asked, self.key).write.parquet(f"{part}/rows")
            self.files.put(f"{part}/done", "")
        # Two fills at once may both hold a key: one of them counts.
        held = self._read("keys", kind).join(keys, self.key, "left_semi").groupBy(self.key).agg(F.min("_fill").alias("_fill"))
        return self._read("rows", f"{self.schema}, _fill string").join(held, [self.key, "_fill"]).drop("_fill")
