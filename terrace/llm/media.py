"""Media columns: byte payloads stored losslessly as 8-bit grey PNG images in a binary column, and features read back.

A payload becomes rows of 64 samples. Writing picks a row filter (none, sub or up) by the least sum of absolute
differences and cuts the zlib stream into IDAT chunks. Reading tests the signature and every chunk's CRC-32,
inflates, undoes the filters in numpy and hashes the low frequencies of a cosine transform.

Defined results: a null text is an empty payload, so it is 64 zero bytes; equal texts give equal bytes and features;
rows are independent, so repeated rows, ties and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import small_batches

WIDTH = 64
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

IDAT_BYTES = 1 << 20
LEVEL = 3
#: Output batches end at about this many bytes, so a worker never holds a partition.
BATCH_BYTES = 4 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG, 64 samples a row. The payload's length must be a positive multiple of 64."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    options = np.stack([pixels, sub, up])
    cost = np.minimum(options, 0 - options).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((len(pixels), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = options[best, np.arange(len(pixels))]
    packed = zlib.compress(lines.tobytes(), LEVEL)
    header = struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 0, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", header)]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undoes row filters of one byte a sample. Rows of one kind are done together; average and Paeth go row by row."""
    out = lines.copy()
    subs = kinds == SUB
    out[subs] = np.add.accumulate(lines[subs], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds, prepend=kinds[:1] ^ 1, append=kinds[-1:] ^ 1))
    for first, end in zip(edges[:-1], edges[1:], strict=True):
        kind = kinds[first]
        if kind == UP:
            if first:
                out[first] += out[first - 1]
            out[first:end] = np.add.accumulate(out[first:end], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for r in range(first, end):
                above = out[r - 1].astype(int) if r else np.zeros(lines.shape[1], int)
                left = corner = 0
                for c in range(lines.shape[1]):
                    b = int(above[c])
                    if kind == AVERAGE:
                        guess = (left + b) // 2
                    else:
                        p = left + b - corner
                        guess = min((left, b, corner), key=lambda x: abs(p - x))
                    left, corner = (int(lines[r, c]) + guess) & 255, b
                    out[r, c] = left
        elif kind > PAETH:
            raise ValueError(f"unknown row filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a grey 8-bit PNG without interlace. Raises ValueError on a bad signature, checksum, size or filter."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, size, kind = 8, [], (0, 0), b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("cut short")
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only grey 8-bit images without interlace")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    width, height = size
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != height * (width + 1) or not raw:
        raise ValueError("size and pixel data differ")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), np.arange(n) + 0.5) / n)


_SIDE, _LOW = 32, 8
_COS = _cosines(_SIDE, _LOW)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits, as hex: signs against the median of the 8 x 8 lowest cosine frequencies of the image shrunk to 32 x 32."""
    height, width = pixels.shape
    rows = np.arange(_SIDE) * height // _SIDE
    sums = np.add.reduceat(pixels, rows, axis=0, dtype=np.float64) / np.maximum(np.diff(rows, append=height), 1)[:, None]
    columns = np.arange(_SIDE) * width // _SIDE
    small = np.add.reduceat(sums, columns, axis=1) / np.maximum(np.diff(columns, append=width), 1)
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def to_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PNG."""
    small_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                payload = data + bytes((-len(data)) % WIDTH or (0 if data else WIDTH))
                rows.append((doc_id.as_py(), len(data), encode_png(payload)))
                held += len(rows[-1][2])
                if held > BATCH_BYTES:
                    yield _flush(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _flush(rows, schema)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds payload (the pixels read back) and feature to (doc_id, n_bytes, media). A damaged image fails the job."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, n_bytes, image in zip(*batch.columns, strict=True):
                image = image.as_py()
                pixels = decode_png(image)
                rows.append((doc_id.as_py(), n_bytes.as_py(), image, pixels.tobytes(), cosine_hash(pixels)))
                held += len(image) + pixels.size
                if held > BATCH_BYTES:
                    yield _flush(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _flush(rows, schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's stored image and of the payload read back from it."""
    stored = read_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, octet_length(payload) - {WIDTH - 1}, {WIDTH})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
