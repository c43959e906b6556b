"""Helpers shared by the training-data operators: shared-folder tables, ASCII lower-casing, Arrow text chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Whitespace of the word definitions: blank, tab, LF, VT, FF, CR.
BLANKS = r"[\x20\x09-\x0D]+"


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's. A local session that names none (tests) has a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _LOCAL_FOLDERS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="terrace-"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's limit of rows in an Arrow batch: whole texts may be long, and a batch is in memory twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


class Scratch:
    """Intermediate Parquet tables in the shared folder: they cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.saved.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self.saved.discard(name)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Drops all tables: for owners whose result no longer reads them."""
        for name in list(self.saved):
            self.drop(name)


def tidy(task: Callable) -> Callable:
    """A task over batches after which the worker gives memory that it has freed back to the system.

    Workers stay between stages and count against their executor; allocators else keep what a task once held.
    """

    @wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def few(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, marked for broadcast only if there are at most `limit`."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII text takes the fast built-in, which then does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words between blanks; 0 for null or blank text."""
    trimmed = F.regexp_replace(text, rf"\A{BLANKS}", "")
    pieces = F.size(F.split(trimmed, BLANKS))
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(pieces - F.when(trimmed.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo n; null where doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about `limit` bytes: (first row, end row, bytes, offsets of rows in them).

    Rows stay whole, so a longer text is a chunk of its own; null texts are empty.
    """
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
