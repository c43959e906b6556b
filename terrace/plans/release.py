"""Publication by key: releases named by their content, one spare kept, and reads of single keys or few.

A release is a folder of Parquet parts, one a share of the keys, sorted by key. A lookup computes its key's share, so a read lists
one part and skips its row groups by their least and greatest keys. A join with a table of keys prunes parts as it runs.
The pointer `live.json` names the current release and the one before it; who holds the old pointer can still read. A release
whose content is unchanged changes nothing, so its spare stays too; older releases are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.plans.publish import release_digest
from terrace.streaming.log import Files

PARTS = 32


class KeyedRelease:
    """Payloads (key, payload) published under one root."""

    def __init__(self, spark: SparkSession, root: str, key: str, parts: int = PARTS):
        self.spark, self.root, self.key, self.parts = spark, root, key, parts
        self.files = Files(spark, root)

    def _part(self, key: Column) -> Column:
        return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(self.parts)).cast("int")

    def live(self) -> list[str]:
        """Names of the current release and of its spare."""
        names = {n for n, _ in self.files.listed(self.root)}
        return json.loads(self.files.text(f"{self.root}/live.json"))["releases"] if "live.json" in names else []

    def publish(self, payloads: DataFrame) -> str:
        """Writes a release if its content is new, points to it and removes what is older than the spare; its name."""
        name = f"h-{release_digest(payloads, self.key).first()['digest']}"
        before = self.live()
        if before[:1] == [name]:
            return name
        dealt = payloads.select(self.key, "payload").withColumn("part", self._part(F.col(self.key)))
        dealt.repartition(self.parts, "part").sortWithinPartitions("part", self.key).write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{name}")
        kept = [name, *(n for n in before if n != name)][:2]
        self.files.put(f"{self.root}/live.json", json.dumps({"releases": kept}))
        for old, _ in self.files.listed(self.root):
            if old.startswith("h-") and old not in kept:
                self.files.remove(f"{self.root}/{old}")
        return name

    def read(self, release: str | None = None) -> DataFrame:
        """A whole release, the current one by default."""
        return self.spark.read.parquet(f"{self.root}/{release or self.live()[0]}")

    def get(self, key, release: str | None = None) -> DataFrame:
        """The payload of one key, from the one part that can hold it."""
        part = self.spark.range(1).select(self._part(F.lit(key)).alias("part")).first()["part"]
        return self.read(release).filter((F.col("part") == part) & (F.col(self.key) == F.lit(key))).select(self.key, "payload")

    def get_all(self, keys: DataFrame, release: str | None = None) -> DataFrame:
        """The payloads of a table of keys; parts without any of them are not read."""
        wanted = keys.select(F.col(self.key)).filter(F.col(self.key).isNotNull()).distinct().withColumn("part", self._part(F.col(self.key)))
        return self.read(release).join(wanted, ["part", self.key]).select(self.key, "payload")
