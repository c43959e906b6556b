"""The corpus pipeline: language ID, near-duplicate removal, decontamination, redaction and mixing, one after another.

Each stage takes (spark, docs, sf_dir), works on all rows of its input and returns a DataFrame that `run` writes as Parquet
to the shared folder and reads again for the next one. All but the last return the columns of documents; the last adds
what the mix takes. No stage joins texts to a table that grows, but for the last, which joins its decisions by id.

Defined results: of linked rows one stays, a null id after all others; an empty input passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm import langid
from terrace.llm.common import Scratch, word_count
from terrace.llm.decontaminate import decontaminate
from terrace.llm.jaccard import BROADCAST_CLASSES, JaccardJoin
from terrace.llm.mixing import label_quality, mix, with_quality
from terrace.llm.pii import Redactor, redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if no language is this likely; texts without letters are rejected too.
LEAST_SCORE = 0.4
#: Largest number of labelled documents whose quality is broadcast (about 30 MB); beyond it the texts are shuffled once.
BROADCAST_LABELS = 500_000

#: Trained networks and trees are not SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def _few(keys: DataFrame, scratch: Scratch, name: str, limit: int = BROADCAST_CLASSES) -> DataFrame:
    """Keys that texts are joined to, marked for broadcast only if they are few."""
    keys = scratch.save(keys, name)
    return F.broadcast(keys) if keys.count() <= limit else keys


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a likely language. All columns ride along with the scored text, so nothing is joined."""
    carried = langid.identify(docs, langid.fit(docs), carry=COLUMNS)
    kept = carried.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"carried_{c}").alias(c) for c in COLUMNS])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the least by id (null last), then by hash of the text; of equal rows one.

    Rows are told apart by id and text, so an id that repeats with other texts loses none of them.
    """
    scratch = Scratch(spark, "pipeline-jaccard")
    join = JaccardJoin(spark, docs)
    labels = scratch.save(join.labelled(), "labels").filter("root is not null")
    join.scratch.clear()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    groups = labels.groupBy("root").agg(least, F.count("*").alias("n")).filter("n > 1")
    groups = groups.select("root", F.col("least.doc_id").alias("least_id"), F.col("least.text_hash").alias("least_hash"))
    first = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_hash") == F.col("least_hash"))
    members = scratch.save(labels.join(_few(groups, scratch, "groups"), "root").select("doc_id", "text_hash", first.alias("first")), "members")
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["copy_id"]) & (F.xxhash64(docs["text"]) == keys["copy_hash"])
    named = [F.col("doc_id").alias("copy_id"), F.col("text_hash").alias("copy_hash")]
    copies = _few(members.filter("not first").select(*named).distinct(), scratch, "copies")
    repeated = _few(members.filter("first").groupBy(*named).count().filter("count > 1").drop("count"), scratch, "repeated")
    for table in ("labels", "groups", "members"):
        scratch.drop(table)
    once = docs.select(*COLUMNS).join(copies, same(copies), "left_anti").join(repeated, same(repeated), "left_anti")
    place = Window.partitionBy("doc_id", "text").orderBy("source", "lang", "n_chars")
    again = docs.select(*COLUMNS).join(repeated, same(repeated), "left_semi").withColumn("place", F.row_number().over(place))
    return once.unionByName(again.filter("place = 1").drop("place"))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of any benchmark item."""
    hits = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0")
    hits = _few(hits.select(F.col("doc_id").alias("hit_id"), "text_hash"), Scratch(spark, "pipeline-benchmark"), "hits")
    same = docs["doc_id"].eqNullSafe(F.col("hit_id")) & (F.xxhash64(docs["text"]) == F.col("text_hash"))
    return docs.join(hits, same, "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows."""
    found = Redactor.fit(docs).with_spans(docs.select(*COLUMNS))
    text = redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted).

    The texts ride along with the sizes, so each row keeps what the mix takes of it, whatever ids repeat.
    """
    scratch = Scratch(spark, "pipeline-mix")
    quality = _few(label_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")), scratch, "quality", BROADCAST_LABELS)
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    return mix(scratch.save(with_quality(sized, quality), "sized")).filter("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("pii", redact_personal_data),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i > 0:
            scratch.drop(STAGES[i - 1][0])
    return docs
