"""A table of latest rows on a commit log: atomic versions, conflict checks, replays, compaction and retention.

A version is one small JSON manifest: for each bucket of keys the Parquet parts that hold it, and for each writer the last batch
that it committed. A commit writes its parts under a new name, then claims the next version by a rename that does not
overwrite; who loses the claim reads the new manifest and adds its parts to that, so parts of two writers never conflict.
A compaction puts one part in the place of several of a bucket; if one of those is no longer there, its claim is void and it
starts again. Parts are merged when they are read: a key's row is the newest one with a score, which any grouping of
parts gives alike. So a batch writes its own rows alone, whatever buckets its keys fall in.

A batch that comes again with a number that its writer has committed changes nothing. Writers are told apart by the
streaming query's id, which a new checkpoint draws anew: its batches start at 0 without meeting those of the old one.

The current version and `spare` older ones stay readable; parts that only older ones name are removed, and so are parts that no manifest
names once they are a day old, as a writer may still be about to commit them.

A claim is atomic where the file system's rename without overwriting is, as on HDFS. A writer that has slept while versions were
swept could claim a number that is free again; it looks for newer versions after its claim, and then claims anew.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAY_MS = 24 * 3600 * 1000


class Conflict(RuntimeError):
    """What a commit replaces is no longer there."""


class Files:
    """The session's file system, as far as the log needs it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.system = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of a folder's entries; none if there is no such folder."""
        at = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Writes a file unless there is one of that name; whether it did."""
        held = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.system.create(held, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), self.conf)
        try:
            context.rename(held, self.path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            self.remove(held.toString())
            return False

    def put(self, name: str, text: str) -> None:
        """Writes a file, in the place of one of that name, which is whole until then."""
        held = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.system.create(held, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), self.conf)
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.gateway.new_array(kinds, 1)
        over[0] = kinds.OVERWRITE
        context.rename(held, self.path(name), over)

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def latest_known(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the newest row with a score, else the newest row: a blank never replaces a score."""
    rest = [c for c in results.columns if c not in keys]
    rank = F.struct(F.col("score").isNotNull(), F.col(order))
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


class ResultTable:
    """Latest known results by key under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, buckets: int = 16, spare: int = 1, most_parts: int = 8):
        self.spark, self.folder, self.keys, self.order = spark, folder, keys, order
        self.buckets, self.spare, self.most_parts = buckets, spare, most_parts
        self.files = Files(spark, folder)

    @property
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Committed versions that can be read, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n, _ in self.files.listed(f"{self.folder}/log") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the newest by default; version -1 is the empty table."""
        while True:
            found = self.versions()
            if version is None and not found:
                return {"version": -1, "parts": {}, "batches": {}, "schema": None}
            try:
                return json.loads(self.files.text(f"{self.folder}/log/{found[-1] if version is None else version:020d}.json"))
            except Exception as error:
                # The newest may be swept between listing and reading: then there is a newer one.
                if version is not None or "FileNotFound" not in str(error):
                    raise

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Claims the next version with what `change` makes of the newest manifest; as it is if that is None."""
        while True:
            held = self.manifest()
            made = change(json.loads(json.dumps(held)))
            if made is None:
                return held
            made["version"] = held["version"] + 1
            name = f"{self.folder}/log/{made['version']:020d}.json"
            if not self.files.claim(name, json.dumps(made)):
                continue
            if self.versions()[-1] > made["version"]:
                self.files.remove(name)
                continue
            self._sweep()
            return made

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes the latest rows as parts by bucket, one file each; the parts by bucket."""
        name = f"data/{int(time.time() * 1000)}-{uuid.uuid4().hex}"
        latest = latest_known(rows, self.keys, self.order).withColumn("bucket", self._bucket).repartition("bucket")
        latest.write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return {n.removeprefix("bucket="): [f"{name}/{n}"] for n, _ in self.files.listed(f"{self.folder}/{name}") if n.startswith("bucket=")}

    def merge(self, batch: DataFrame, batch_id: int, writer: str | None = None) -> None:
        """Commits a batch once: a writer's batch that is committed already changes nothing."""
        writer = writer or self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        if self.manifest()["batches"].get(writer, -1) >= batch_id:
            return
        schema, parts = batch.schema.json(), self._write(batch)

        def added(held: dict) -> dict | None:
            if held["batches"].get(writer, -1) >= batch_id:
                return None
            for bucket, names in parts.items():
                held["parts"][bucket] = held["parts"].get(bucket, []) + names
            held["batches"][writer], held["schema"] = batch_id, schema
            return held

        made = self._commit(added)
        if any(len(names) > self.most_parts for names in made["parts"].values()):
            self.compact()

    def compact(self) -> None:
        """Puts one part in the place of a bucket's many, in all buckets of over `most_parts`."""
        while True:
            held = self.manifest()
            many = {b: names for b, names in held["parts"].items() if len(names) > self.most_parts}
            if not many:
                return
            parts = self._write(self._read([n for names in many.values() for n in names], held["schema"]))

            def replaced(now: dict, many: dict = many, parts: dict = parts) -> dict:
                for bucket, names in many.items():
                    own = now["parts"].get(bucket, [])
                    if not set(names) <= set(own):
                        raise Conflict(bucket)
                    now["parts"][bucket] = parts[bucket] + [n for n in own if n not in names]
                return now

            try:
                self._commit(replaced)
                return
            except Conflict:
                continue

    def _sweep(self) -> None:
        """Removes versions older than the spare ones with the parts that they alone name, and old parts without a version."""
        found = self.versions()
        names = lambda v: {n.split("/")[1] for parts in self.manifest(v)["parts"].values() for n in parts}
        kept = set().union(*map(names, found[-1 - self.spare :]))
        gone: set[str] = set()
        for old in found[: -1 - self.spare]:
            gone |= names(old) - kept
            self.files.remove(f"{self.folder}/log/{old:020d}.json")
        if not gone:
            return
        listed = self.files.listed(f"{self.folder}/data")
        newest = max(changed for _, changed in listed)
        for name, changed in listed:
            if name in gone or name not in kept and changed < newest - DAY_MS:
                self.files.remove(f"{self.folder}/data/{name}")

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{self.folder}/{p}" for p in parts])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The latest known row of each key, in the newest or another readable version; None if the table is empty."""
        held = self.manifest(version)
        parts = sorted(n for names in held["parts"].values() for n in names)
        return latest_known(self._read(parts, held["schema"]), self.keys, self.order) if parts else None
