"""Toxicity as ordinal regression: cumulative links over sparse word features, one weight vector for all thresholds.

Severity grades are whole numbers from 0, one for each labelled document; the query takes them from the labels' two columns:
0 not toxic, 1 toxic in a good document, 2 toxic in a bad one. Features are the distinct words of a text (A-Z lower-cased,
punctuation apart) and their beginnings of PREFIXES bytes, for inflected and joined words; each counts again as a feature of its own
where it occurs MANY times or more. They are hashed to BITS bits. P(grade > k) = sigmoid(w.x - t_k) with rising t_k; the
output is the expected grade, the sum of those probabilities. The fit takes up to PER_GRADE documents of each grade, drawn by a
hash of the id and weighted to the grades' counts among all labels, and shrinks weights to 0 by an L1 penalty, so most words
of a long text weigh nothing.

Defined results: null and wordless texts have no features; very long texts count whole, one feature for each word at most
twice; a document labelled more than once counts with its highest grade; null labels are none; without two grades the severity
is that of the only grade, or 0; repeated rows give a row each; equal texts give
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import small_batches, text_chunks
from terrace.llm.shingles import APART, U64, mix64, word_hashes

BITS, GRADES = 20, 3
#: Lengths of beginnings in bytes, and from how many occurrences on a feature counts again.
PREFIXES, MANY = (4, 5, 6, 8), 3
PER_GRADE, LEAST_DOCUMENTS = 2500, 4
ROUNDS, RATE, PENALTY, SEED = 250, 0.08, 3e-4, 17
#: A document is above a grade if that is this likely.
CUT = 0.3


@dataclass
class Ordinal:
    """Weights by hashed word, and thresholds between neighbouring grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None])))


def fit(features: list[np.ndarray], grades: np.ndarray, weight: np.ndarray) -> Ordinal:
    """Proximal Adam on the weighted likelihood of the grades. Thresholds are a first one and positive steps."""
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    model = Ordinal(np.zeros(2 << BITS), np.full(GRADES - 1, 30.0))
    present = np.unique(grades)
    if len(present) < 2:
        model.thresholds[: int(present[0]) if len(present) else 0] = -30.0
        return model
    often = np.bincount(flat, minlength=2 << BITS) >= LEAST_DOCUMENTS
    names = np.flatnonzero(often)
    number = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    kept = often[flat]
    index, owner = number[flat[kept]], owner[kept]
    weight = weight / weight.sum()
    w = np.zeros(len(names))
    # P(grade > k) of the population starts the thresholds.
    tail = np.clip([weight[grades > k].sum() for k in range(GRADES - 1)], 1e-6, 1 - 1e-6)
    start = -np.log(tail / (1 - tail))
    t = np.concatenate([start[:1], np.log(np.expm1(np.maximum(np.diff(start), 1e-2)))])
    m_w, s_w, m_t, s_t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    rows = np.arange(len(features))
    for step in range(1, ROUNDS + 1):
        theta = np.concatenate([t[:1], t[:1] + np.cumsum(np.log1p(np.exp(t[1:])))])
        score = np.bincount(owner, w[index], minlength=len(features))
        p = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(-(score[:, None] - theta))), np.zeros((len(rows), 1))], axis=1)
        chance = np.maximum(p[rows, grades] - p[rows, grades + 1], 1e-9)
        slope = p * (1 - p)
        # d log P(grade) / d score, and with respect to the thresholds on either side.
        g_score = weight * (slope[rows, grades] - slope[rows, grades + 1]) / chance
        g_theta = np.zeros(GRADES + 1)
        np.add.at(g_theta, grades, -weight * slope[rows, grades] / chance)
        np.add.at(g_theta, grades + 1, weight * slope[rows, grades + 1] / chance)
        g_theta = g_theta[1:GRADES]
        g_t = np.concatenate([[g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] / (1 + np.exp(-t[1:]))])
        g_w = np.bincount(index, g_score[owner], minlength=len(w))
        for value, g, m, s, shrink in ((w, g_w, m_w, s_w, PENALTY), (t, g_t, m_t, s_t, 0.0)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            scale = RATE / (np.sqrt(s / (1 - 0.99**step)) + 1e-5)
            value += scale * m / (1 - 0.9**step)
            value[:] = np.sign(value) * np.maximum(np.abs(value) - scale * shrink, 0) if shrink else value
    model.weights[names] = w
    model.thresholds = np.concatenate([t[:1], t[:1] + np.cumsum(np.log1p(np.exp(t[1:])))])
    return model


def _features(batch: pa.RecordBatch, used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of rows: first row, number of rows, and (owner, feature) of each distinct feature of each row.

    With `used`, a mark for each feature, only used ones are looked for.
    """
    for first, _, data, offsets in text_chunks(batch, "text"):
        hashes, ends, *begun = word_hashes(data, offsets, APART, PREFIXES)
        n = len(ends)
        owner = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        keys = []
        for i, (values, there) in enumerate([(hashes, slice(None)), *begun]):
            feature = (mix64(values[there] + U64(i)) >> U64(64 - BITS)).astype(np.int64)
            keys.append(owner[there] << BITS | feature)
            if used is not None:
                keys[-1] = keys[-1][used[feature]]
        pairs, counts = np.unique(np.concatenate(keys), return_counts=True)
        pairs = np.concatenate([pairs, pairs[counts >= MANY] | np.int64(1) << 62])
        yield first, n, (pairs & ~(np.int64(1) << 62)) >> BITS, (pairs & ((1 << BITS) - 1)) | (pairs >> 62) << BITS


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, owner, feature in _features(batch):
            order = np.lexsort((feature, owner))
            edges = np.searchsorted(owner[order], np.arange(n + 1))
            data = [feature[order][a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("grade").slice(first, n), pa.array(data, pa.binary())], ["doc_id", "grade", "features"])


def grades_of(labels: DataFrame) -> DataFrame:
    """(label_id, grade) of labelled documents."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    return labels.select(F.col("doc_id").alias("label_id"), grade.alias("grade")).filter("label_id is not null and grade is not null").groupBy("label_id").agg(F.max("grade").alias("grade"))


def train(documents: DataFrame, graded: DataFrame) -> Ordinal:
    """Fits on the documents of `graded` (label_id, grade)."""
    small_batches(documents.sparkSession)
    counts = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], np.zeros(0, int), np.zeros(0))
    order = F.pmod(F.xxhash64("label_id", F.lit(SEED)), F.lit(1 << 40))
    share = F.create_map(*[x for g, n in sorted(counts.items()) for x in (F.lit(g), F.lit(min(1.0, PER_GRADE / n)))])
    drawn = graded.filter(order < share[F.col("grade")] * float(1 << 40))
    # At most about PER_GRADE rows of each grade, whatever the input.
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "grade")
    rows = sorted(rows.mapInArrow(_feature_rows, "doc_id long, grade int, features binary").collect())
    grades = np.array([r["grade"] for r in rows], np.int64)
    sampled = np.bincount(grades, minlength=GRADES)
    weight = np.array([counts[int(g)] / sampled[g] for g in grades])
    return fit([np.frombuffer(r["features"], np.int32).astype(np.int64) for r in rows], grades, weight)


def severity(documents: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, severity, p_toxic, grade) of every row: expected grade, P(grade > 0) and the number of grades that it is above."""
    small_batches(documents.sparkSession)
    used = np.flatnonzero(model.weights)
    values, thresholds = model.weights[used], model.thresholds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(2 << BITS)
        weights[used] = values
        heavy = (weights[: 1 << BITS] != 0) | (weights[1 << BITS :] != 0)
        for batch in batches:
            for first, n, owner, feature in _features(batch, heavy):
                total = np.bincount(owner, weights[feature], minlength=n)
                above = Ordinal(weights, thresholds).above(total)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy()), pa.array((above >= CUT).sum(axis=1).astype(np.int32))], ["doc_id", "severity", "p_toxic", "grade"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, severity double, p_toxic double, grade int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return severity(documents, model).select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= CUT).alias("toxic"))
