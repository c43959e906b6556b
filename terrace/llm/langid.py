"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded; filters of widths 2, 3 and 4 slide over windows of fixed length; each filter's maximum over the window
goes through a softmax. Training takes a bounded sample: windows of up to PER_LANGUAGE documents of each label,
drawn by a hash of the id, so reruns and recomputed tasks agree. Scoring cuts every whole
text into windows and averages their probabilities by length. There a filter is a sum of table rows: one row for each
pair of bytes, so the tables' size is fixed.

Defined results: null texts and texts without a letter are `und` with score 0; without labelled rows every text is `und`;
A-Z are lower-cased; very long texts are scored whole, window by window; of equally likely languages the first by name is
given; repeated rows give a row each; equal texts give equal results; a null id is not held out and not learned from; an
empty table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import crc_bucket, small_batches, text_chunks, tidy

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
PER_LANGUAGE, WINDOWS_PER_DOCUMENT = 300, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.005, 11
#: Windows that a task scores at once.
SCORED = 512
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class ByteNet:
    """Weights: embedding (256, d), for each width filters (width, d, f) and biases, and the output layer."""

    languages: list[str]
    parameters: list[np.ndarray]

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        logits = np.maximum(features, 0) @ self.parameters[-2] + self.parameters[-1]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def tables(self) -> list[np.ndarray]:
        """For each width the rows that stand for pairs of bytes, or for a last single byte."""
        out = []
        for i, width in enumerate(WIDTHS):
            single = [self.parameters[0] @ self.parameters[1 + 2 * i][j] for j in range(width)]
            single[0] = single[0] + self.parameters[2 + 2 * i]
            out.append([(single[j][:, None] + single[j + 1][None]).reshape(-1, FILTERS).astype(np.float32) if j + 1 < width else single[j].astype(np.float32) for j in range(0, width, 2)])
        return out


def pooled(windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Each filter's maximum over each window of bytes."""
    pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
    out = []
    for width, parts in zip(WIDTHS, tables, strict=True):
        length = windows.shape[1] - width + 1
        total = None
        for j, table in zip(range(0, width, 2), parts, strict=True):
            index = pairs if len(table) > 256 else windows
            rows = table[index[:, j : j + length]]
            total = rows if total is None else np.add(total, rows, out=total)
        out.append(total.max(axis=1))
    return np.concatenate(out, axis=1)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> ByteNet:
    """Adam on cross-entropy; a maximum passes its gradient to the place it came from."""
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, 0.3, (256, EMBEDDING))]
    for width in WIDTHS:
        p += [rng.normal(0, 0.3, (width, EMBEDDING, FILTERS)), np.zeros(FILTERS)]
    p += [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages))]
    p = [x.astype(np.float32) for x in p]
    net = ByteNet(languages, p)
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(EPOCHS if len(languages) > 1 else 0):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            n, places, features = len(x), [], []
            embedded = p[0][x]
            for i, width in enumerate(WIDTHS):
                length = x.shape[1] - width + 1
                conv = sum(embedded[:, j : j + length] @ p[1 + 2 * i][j] for j in range(width)) + p[2 + 2 * i]
                places.append(conv.argmax(axis=1))
                features.append(np.take_along_axis(conv, places[-1][:, None], axis=1)[:, 0])
            hidden = np.concatenate(features, axis=1)
            delta = net.probabilities(hidden)
            delta[np.arange(n), y] -= 1
            delta /= n
            grads = [np.zeros_like(v) for v in p]
            grads[-2], grads[-1] = np.maximum(hidden, 0).T @ delta, delta.sum(axis=0)
            back = (delta @ p[-2].T) * (hidden > 0)
            for i, width in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[2 + 2 * i] = g.sum(axis=0)
                for j in range(width):
                    seen = np.take_along_axis(x, places[i] + j, axis=1)
                    grads[1 + 2 * i][j] = np.einsum("nfd,nf->df", p[0][seen], g)
                    np.add.at(grads[0], seen, g[:, :, None] * p[1 + 2 * i][j].T[None])
            step += 1
            for v, g, m, s in zip(p, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _window_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts in order, padded with 0; for each its text and how many bytes it has."""
    lengths = np.diff(offsets)
    n = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][owner] + place * WINDOW
    size = np.minimum(offsets[1:][owner] - start, WINDOW)
    index = start[:, None] + np.arange(WINDOW)
    rows = _LOWER[data[np.minimum(index, max(len(data) - 1, 0))]] if len(data) else np.zeros((0, WINDOW), np.uint8)
    rows[np.arange(WINDOW)[None] >= size[:, None]] = 0
    return rows, owner, size


def sample_windows(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounded sample: (windows, label of each, languages) from rows with doc_id, text and lang."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * PER_LANGUAGE / r["n"])))])
    order = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40))
    window = f"substring(text, cast(pmod(xxhash64(doc_id, i), greatest(char_length(text) - {WINDOW}, 0) + 1) as int) + 1, {WINDOW})"
    drawn = labelled.withColumn("h", order).filter(F.col("h") < share[F.col("lang")] * float(1 << 40))
    drawn = drawn.select("lang", "h", "doc_id", F.expr(f"transform(sequence(1, {WINDOWS_PER_DOCUMENT}), i -> {window})").alias("pieces"))
    rows = sorted(drawn.collect(), key=lambda r: (r["lang"], r["h"], r["doc_id"], r["pieces"]))
    languages = sorted({r["lang"] for r in rows})
    texts, labels, taken = [], [], dict.fromkeys(languages, 0)
    for r in rows:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= PER_LANGUAGE:
            texts += [piece.encode()[:WINDOW] for piece in r["pieces"]]
            labels += [languages.index(r["lang"])] * len(r["pieces"])
    data = _LOWER[np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in texts), np.uint8)].reshape(-1, WINDOW)
    return data, np.array(labels), languages


def identify(documents: DataFrame, net: ByteNet, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, and the columns to carry along, so that none is joined back."""
    small_batches(documents.sparkSession)
    chosen = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    fields = [f"`carried_{c}` {documents.schema[c].dataType.simpleString()}" for c in carry]
    schema = ", ".join(["doc_id long, lang_pred string, score double", *fields])
    names_out = ["doc_id", "lang_pred", "score", *(f"carried_{c}" for c in carry)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        names = np.array([*net.languages, UNDETERMINED], object)
        for batch in batches:
            for first, _, data, offsets in text_chunks(batch, "text", 1 << 18):
                n = len(offsets) - 1
                rows, owner, size = _window_rows(data, offsets)
                sums = np.zeros((n, max(len(net.languages), 1)))
                for a in range(0, len(rows) if net.languages else 0, SCORED):
                    b = min(a + SCORED, len(rows))
                    np.add.at(sums, owner[a:b], net.probabilities(pooled(rows[a:b], tables)) * size[a:b, None])
                best = sums.argmax(axis=1)
                value = sums[np.arange(n), best] / np.maximum(sums.sum(axis=1), 1e-12)
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[i] = any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode()))
                known = has & bool(net.languages)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.where(known, value, 0.0)), *(batch.column(c).slice(first, n) for c in names_out[3:])], names_out)

    return chosen.mapInArrow(tidy(score), schema)


def held_out() -> Column:
    return F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))


def fit(documents: DataFrame) -> ByteNet:
    """Learns from the labelled rows that are not held out."""
    labelled = documents.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
    return train(*sample_windows(labelled.select("doc_id", "text", "lang")))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, fit(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
