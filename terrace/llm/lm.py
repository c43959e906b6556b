"""Language-model scoring with a gated recurrent network trained in numpy.

Tokens are words between blanks, A-Z lower-cased, and one end per document. Counts come from all training documents.
The network's vocabulary is the most frequent tokens, dealt by rank into classes; a token's probability is that of its
class times that within the class. A class of its own stands for all other words, and its probability is shared out by
their smoothed unigram probabilities, so every text has a proper probability.

Every training document is learned from. Their tokens are numbered once and dealt by a hash into ROUNDS parts. In a round
each task starts from the network of the round before and goes through the part's whole documents that it holds, by
truncated backpropagation: documents follow each other in streams, states are carried from window to window and end with a document.
The mean of the tasks' networks, weighted by tokens, is the round's. Means are summed in two levels of tasks, so the driver
gets one network. The first round starts from a network trained alike on the driver on START_DOCUMENTS documents, a window of
at most START_TOKENS tokens of each, at a place drawn by hash: that sample only saves the first steps of every task.
Scoring runs SIDE whole documents side by side, longest first, and carries each document's state across its windows to its end.

The counts of the most frequent words, at most BROADCAST_WORDS, go to every task; those of rarer words are joined by hash, after the
pass, for the rare words of each document alone. The most frequent of those has a small share of all tokens, so no key is
hot. Words are known by 64-bit hashes. The network's size is fixed: CLASSES, PER_CLASS and HIDDEN.

Defined results: a null text is empty and has its end alone; without training documents N = V = 0 and both scores are
unigram scores; an empty table gives no rows; very long texts are learned from and scored whole, one state from start to end;
words of equal counts rank by hash; repeated rows give a row each, and equal texts equal scores up to the rounding of sums;
a null id is not held out and not learned from; other columns are ignored. The fit depends on how rows are dealt into tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import Scratch, crc_bucket, small_batches, text_chunks
from terrace.llm.shingles import word_hashes

CLASSES, PER_CLASS, HIDDEN = 40, 40, 24
#: The number that stands for all words outside the network's vocabulary: alone in the last class.
OTHER = CLASSES * PER_CLASS
BROADCAST_WORDS = 65_536
START_DOCUMENTS, START_TOKENS, START_EPOCHS, START_STREAMS = 1000, 300, 2, 48
ROUNDS, STREAMS, STEPS, RATE, SEED = 4, 384, 16, 0.01, 5
#: Tokens that a task learns from at once.
LEARN_TOKENS = 600_000
#: Tokens that a task scores at once, documents side by side, and the least steps between output layers.
BATCH_TOKENS, SIDE, WINDOW = 2_000_000, 1024, 32
#: Bits of a hash that lead to its place among the sorted ones.
LEAD = 18
#: The end token's hash; a word's hash equals it with the chance of any other collision.
END = np.int64(0x454E44)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _chosen_logs(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-softmax of each column at one place, and the columns' sums: `x` then holds exponentials not yet divided by these.

    Columns, as numpy takes maxima and sums across short rows several times slower than down columns.
    """
    x -= x.max(axis=0)
    out = x[chosen, np.arange(len(chosen))]
    np.exp(x, out=x)
    sums = x.sum(axis=0)
    return out - np.log(sums), sums


def _slope(x: np.ndarray, chosen: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Sum of losses of the columns and the slope of `scale` times it, in the place of x."""
    logs, sums = _chosen_logs(x, chosen)
    x *= scale / sums
    x[chosen, np.arange(len(chosen))] -= scale
    return -float(logs.sum()), x


def _by_gate(x: np.ndarray) -> np.ndarray:
    """(rows, three gates side by side) as (gate, rows, HIDDEN), so that what a step does to a gate runs over one piece of memory."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with the bias as a last row, for states whose last column is 1."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _step(h: np.ndarray, x: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after inputs x (gate, streams, HIDDEN), where the gates' values then stand, and the candidates' recurrent part."""
    u = np.matmul(h, recurrent)
    x[:2] += u[:2]
    z, r = _sigmoid(x[:2])
    n = x[2]
    n += r * u[2]
    np.tanh(n, out=n)
    after = h - n
    after *= z
    after += n
    return after, u[2]


@dataclass
class Gru:
    """Input rows by word (three gates), recurrent weights, class layer, and for each class but the last a word layer."""

    inputs: np.ndarray
    recurrent: np.ndarray
    class_weights: np.ndarray
    class_bias: np.ndarray
    word_weights: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray) -> Gru:
        """Small random weights; biases so that the untrained network has the corpus frequencies."""
        rng = np.random.default_rng(SEED)
        p = (counts + 1.0) / (counts + 1.0).sum()
        own = p[:OTHER].reshape(CLASSES, PER_CLASS)
        draw = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        return cls(draw(OTHER + 1, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), draw(HIDDEN, CLASSES + 1), np.log(np.append(own.sum(axis=1), p[OTHER])).astype(np.float32), draw(CLASSES, HIDDEN, PER_CLASS), np.log(own / own.sum(axis=1, keepdims=True)).astype(np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.class_weights, self.class_bias, self.word_weights, self.word_bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    @classmethod
    def unpacked(cls, values: np.ndarray) -> Gru:
        shapes = [p.shape for p in cls.start(np.zeros(OTHER + 1)).parameters()]
        edges = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        return cls(*[values[a:b].reshape(s).astype(np.float32) for a, b, s in zip(edges[:-1], edges[1:], shapes, strict=True)])

    def step(self, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _step(h, _by_gate(self.inputs).take(words, axis=1), _by_gate(self.recurrent))

    def log_probabilities(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of words after states."""
        return self.logs()(h, words)

    def logs(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """`log_probabilities` with the weights as they are now, for many calls."""
        top, own = _with_bias(self.class_weights, self.class_bias), _with_bias(self.word_weights, self.word_bias)

        def logs(h: np.ndarray, words: np.ndarray) -> np.ndarray:
            flat = np.append(h, np.ones((len(h), 1), h.dtype), axis=1)
            kind = words // PER_CLASS
            out = _chosen_logs(top.T @ flat.T, kind)[0].astype(np.float64)
            at, parts = _by_class(kind)
            out[at] += _chosen_logs(_word_layer(flat.take(at, axis=0), own, parts), words[at] % PER_CLASS)[0]
            return out

        return logs

    def gradients(self, h: np.ndarray, words: np.ndarray, fresh: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
        """Of the mean loss of a window (steps, streams): loss, gradients, last state. `fresh` marks first tokens."""
        steps, streams = words.shape
        target = words.ravel()
        kind, scale = target // PER_CLASS, 1.0 / target.size
        recurrent, alive = _by_gate(self.recurrent), ~fresh[:, :, None]
        gates = _by_gate(self.inputs).take(target, axis=1).reshape(3, steps, streams, HIDDEN)
        states = np.empty((steps, streams, HIDDEN), h.dtype)
        candidates = np.empty_like(states)
        for t in range(steps):
            np.multiply(h, alive[t], out=states[t])
            h, candidates[t] = _step(states[t], gates[:, t], recurrent)
        grads = [np.zeros_like(p) for p in self.parameters()]
        # Output layers.
        flat = np.ones((target.size, HIDDEN + 1), h.dtype)
        flat[:, :HIDDEN] = states.reshape(-1, HIDDEN)
        loss, delta = _slope(_with_bias(self.class_weights, self.class_bias).T @ flat.T, kind, scale)
        slope = flat.T @ delta.T
        grads[2][...], grads[3][...] = slope[:-1], slope[-1]
        back = delta.T @ self.class_weights.T
        at, parts = _by_class(kind)
        own = flat.take(at, axis=0)
        more, delta = _slope(_word_layer(own, _with_bias(self.word_weights, self.word_bias), parts), target[at] % PER_CLASS, scale)
        turned = np.empty((len(at), HIDDEN), h.dtype)
        for c, a, b in parts:
            slope = own[a:b].T @ delta[:, a:b].T
            grads[4][c], grads[5][c] = slope[:-1], slope[-1]
            np.matmul(delta[:, a:b].T, self.word_weights[c].T, out=turned[a:b])
        back[at] += turned
        # Back through the steps. `into`: slopes of the gates' inputs; `last`: of the candidates' recurrent part.
        back = back.reshape(steps, streams, HIDDEN)
        into = np.empty_like(gates)
        last = np.empty_like(states)
        carry = np.zeros_like(back[0])
        across = np.ascontiguousarray(recurrent.transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            (z, r, n), (dz, dr, dn) = gates[:, t], into[:, t]
            away = 1 - z
            away *= carry
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= away
            np.subtract(states[t], n, out=dz)
            dz *= z
            dz *= away
            np.multiply(dn, r, out=last[t])
            np.subtract(1, r, out=dr)
            dr *= last[t]
            dr *= candidates[t]
            carry *= z
            carry += dz @ across[0]
            carry += dr @ across[1]
            carry += last[t] @ across[2]
            carry += back[t]
            carry *= alive[t]
        before = states.reshape(-1, HIDDEN).T
        for gate, slopes in enumerate((into[0], into[1], last)):
            grads[1][:, gate * HIDDEN : (gate + 1) * HIDDEN] = before @ slopes.reshape(-1, HIDDEN)
        grads[0] = _sum_by_word(into.reshape(3, -1, HIDDEN), target)
        return loss * scale + more * scale, grads, h


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of all classes but the last, ordered by class, and the classes that occur with their bounds in that order."""
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    return order[: edges[CLASSES]], [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]


def _word_layer(states: np.ndarray, weights: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """A column for each state, of the weights of its class."""
    out = np.empty((PER_CLASS, len(states)), states.dtype)
    for c, a, b in parts:
        np.matmul(weights[c].T, states[a:b].T, out=out[:, a:b])
    return out


def _sum_by_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(gate, rows, HIDDEN) summed over the rows of each word: rows by word, gates side by side."""
    order = np.argsort(words.astype(np.uint16), kind="stable")
    words, x = words[order], x.take(order, axis=1)
    first = np.flatnonzero(np.diff(words, prepend=-1))
    counts = np.diff(first, append=len(words))
    out = np.zeros((3, OTHER + 1, HIDDEN), x.dtype)
    # Most words of a window occur once and are only copied; a few occur often. `reduceat` is slow at both.
    once, often = counts == 1, counts >= 32
    out[:, words[first[once]]] = x[:, first[once]]
    for a, n in zip(first[often].tolist(), counts[often].tolist(), strict=True):
        out[:, words[a]] = np.ones(n, x.dtype) @ x[:, a : a + n]
    rest = np.repeat(~(once | often), counts)
    if rest.any():
        words, x = words[rest], x[:, rest]
        first = np.flatnonzero(np.diff(words, prepend=-1))
        out[:, words[first]] = np.add.reduceat(x, first, axis=1)
    return out.transpose(1, 0, 2).reshape(OTHER + 1, 3 * HIDDEN)


class Learner:
    """Adam over windows of streams of documents."""

    def __init__(self, network: Gru, rate: float, streams: int):
        self.network, self.rate, self.streams, self.steps = network, rate, streams, 0
        self.first, self.second = ([np.zeros_like(p) for p in network.parameters()] for _ in range(2))

    def learn(self, documents: list[np.ndarray]) -> None:
        """Goes once through whole documents (arrays of word numbers, ends included), dealt evenly into streams."""
        words = np.concatenate(documents).astype(np.int64)
        fresh = np.zeros(len(words), bool)
        fresh[np.cumsum([0, *map(len, documents[:-1])])] = True
        streams = max(1, min(self.streams, len(words) // STEPS))
        length = -(-len(words) // streams)
        # A few tokens from the start fill the last stream.
        words, fresh = (np.resize(x, streams * length).reshape(streams, length).T.copy() for x in (words, fresh))
        fresh[0] = True
        h = np.zeros((streams, HIDDEN), np.float32)
        for at in range(0, length, STEPS):
            _, grads, h = self.network.gradients(h, words[at : at + STEPS], fresh[at : at + STEPS])
            self._move(grads)

    def _move(self, grads: list[np.ndarray]) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        size = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for p, g, m, s in zip(self.network.parameters(), grads, self.first, self.second, strict=True):
            g *= clip
            m *= 0.9
            m += 0.1 * g
            s *= 0.999
            np.multiply(g, g, out=g)
            s += 0.001 * g
            np.sqrt(s, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= size
            p -= g


def start(documents: list[np.ndarray], counts: np.ndarray) -> Gru:
    """The network that the first round starts from."""
    network = Gru.start(counts)
    rng = np.random.default_rng(SEED)
    for epoch in range(START_EPOCHS if documents else 0):
        Learner(network, RATE / (1 + epoch), START_STREAMS).learn([documents[i] for i in rng.permutation(len(documents))])
    return network


@dataclass
class Vocabulary:
    """Sorted hashes of the broadcast words, their counts, and their numbers in the network (OTHER: not in it)."""

    hashes: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray

    @cached_property
    def firsts(self) -> np.ndarray:
        """For each value of the highest LEAD bits, the place of the first hash that is not below it; sorted as signed numbers."""
        return np.searchsorted(self.hashes, (np.arange(1 << LEAD) - (1 << LEAD - 1)) << 64 - LEAD).astype(np.int32)

    @cached_property
    def ended(self) -> np.ndarray:
        """The hashes with a last one that no other exceeds."""
        return np.append(self.hashes, np.iinfo(np.int64).max)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.firsts[(hashes >> 64 - LEAD) + (1 << LEAD - 1)]
        behind = np.flatnonzero(self.ended[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.ended[at[behind]] < hashes[behind]]
        np.minimum(at, len(self.hashes) - 1, out=at)
        return at, self.hashes[at] == hashes

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at, there = self.look_up(hashes)
        return np.where(there, self.numbers[at], OTHER) if len(self.numbers) else np.full(len(hashes), OTHER)


def _tokens(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of runs of rows: first row, token hashes with ends, bounds of the rows in them."""
    for first, _, data, offsets in text_chunks(batch, column):
        words, ends = word_hashes(data, offsets)
        bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        out = np.full(bounds[-1], END)
        mask = np.ones(len(out), bool)
        mask[bounds[1:] - 1] = False
        out[mask] = words.view(np.int64)
        yield first, out, bounds


def count_words(training: DataFrame) -> DataFrame:
    """(hash, n) of all tokens; a task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["hash", "n"])

        waiting, held = [], 0
        for batch in batches:
            for _, tokens, _ in _tokens(batch, "text"):
                waiting.append(tokens)
                held += len(tokens)
                if held > 6_000_000:
                    yield summed()
                    waiting, held = [], 0
        if waiting:
            yield summed()

    return training.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Counts of a corpus and a network, fitted on `training` (doc_id, text)."""

    def __init__(self, spark: SparkSession, training: DataFrame):
        small_batches(spark)
        self.spark, self.scratch = spark, Scratch(spark, "lm")
        training = training.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.counts = self.scratch.save(count_words(training), "counts")
        totals = self.counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.distinct = totals["n"] or 0, totals["v"]
        top = sorted(self._frequent().collect(), key=lambda r: (-r["n"], r["hash"]))
        hashes, n = np.array([r["hash"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64)
        numbers = np.minimum(np.arange(len(top)), OTHER)
        order = np.argsort(hashes)
        self.vocabulary = Vocabulary(hashes[order], n[order], numbers[order])
        inside = np.zeros(OTHER + 1)
        inside[: min(OTHER, len(n))] = n[:OTHER]
        inside[OTHER] = self.tokens - inside.sum()
        #: Unigram probability of all that is not in the network's vocabulary, unseen words included.
        self.other = 1 - float((n[:OTHER] + 1).sum()) / (self.tokens + self.distinct + 1)
        self.network = self._train(training, inside)

    def _frequent(self) -> DataFrame:
        """The most frequent words, BROADCAST_WORDS of them or nearly: whole classes of frequency, from the highest down, and
        of the class that crosses the number those with the least hashes.

        The classes are sixteenths of powers of two, and hashes fall into 4,096 ranges, so the driver gets a few thousand
        sums, whatever the vocabulary.
        """
        step = F.floor(F.log2("n") * 16).cast("int")
        part = F.shiftrightunsigned("hash", 52).cast("int")
        sizes = {r["s"]: r["w"] for r in self.counts.groupBy(step.alias("s")).agg(F.count("*").alias("w")).collect()}
        least, words = 1 << 30, 0
        for s in sorted(sizes, reverse=True):
            if words + sizes[s] > BROADCAST_WORDS:
                parts = {r["p"]: r["w"] for r in self.counts.filter(step == s).groupBy(part.alias("p")).agg(F.count("*").alias("w")).collect()}
                upto = 0
                while upto < 4096 and words + parts.get(upto, 0) <= BROADCAST_WORDS:
                    words += parts.get(upto, 0)
                    upto += 1
                return self.counts.filter((step >= least) | (step == s) & (part < upto))
            words, least = words + sizes[s], s
        return self.counts

    def _numbered(self, training: DataFrame) -> DataFrame:
        """(draw, words): the word numbers of each whole document as 16-bit integers, and a number drawn for it."""
        model = self.spark.sparkContext.broadcast(self.vocabulary)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = model.value
            for batch in batches:
                for first, tokens, bounds in _tokens(batch, "text"):
                    words = vocabulary.number(tokens).astype(np.uint16)
                    data = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("draw").slice(first, len(data)), pa.array(data, pa.binary())], ["draw", "words"])

        drawn = training.select(F.xxhash64("doc_id", F.lit(SEED)).alias("draw"), "text")
        return drawn.mapInArrow(number, "draw long, words binary")

    def _train(self, training: DataFrame, inside: np.ndarray) -> Gru:
        """Rounds over all numbered documents, from a start on a sample of them."""
        if not self.tokens:
            return Gru.start(inside)
        numbered = self._numbered(training).withColumn("round", F.pmod(F.shiftright("draw", 8), F.lit(ROUNDS)).cast("int"))
        numbered.write.partitionBy("round").parquet(f"{self.scratch.root}/numbered")
        numbered = self.spark.read.schema("draw long, words binary, round int").parquet(f"{self.scratch.root}/numbered")
        n = numbered.count()
        place = F.pmod(F.shiftright("draw", 20), F.greatest(F.octet_length("words") / 2 - START_TOKENS + 1, F.lit(1)).cast("long"))
        sample = numbered.filter(F.pmod("draw", F.lit(1 << 40)) < min(1.0, 2 * START_DOCUMENTS / n) * float(1 << 40))
        sample = sample.select("draw", F.substring("words", (2 * place + 1).cast("int"), F.lit(2 * START_TOKENS)).alias("words"))
        rows = sample.orderBy("draw", "words").limit(START_DOCUMENTS).collect()
        network = start([np.frombuffer(r["words"], np.uint16) for r in rows], inside)
        for r in range(ROUNDS):
            held = self.spark.sparkContext.broadcast(network.packed())
            learned = numbered.filter(F.col("round") == r).select("words").mapInArrow(_learned(held, RATE / (2 + r)), "tokens long, network binary")
            learned = self.scratch.save(learned, f"round-{r}")
            groups = max(1, math.isqrt(learned.count()))
            mean = learned.repartition(groups, F.rand(SEED)).mapInArrow(_mean, "tokens long, network binary").coalesce(1).mapInArrow(_mean, "tokens long, network binary").collect()
            network = Gru.unpacked(np.frombuffer(mean[0]["network"], np.float32)) if mean else network
        self.scratch.drop("numbered")
        return network

    def score(self, documents: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
        model = self.spark.sparkContext.broadcast((self.vocabulary, self.network))
        rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(model), "row long, doc_id long, n_tokens long, known long, others long, log_counts double, log_others double, network double, rare array<long>")
        rows = self.scratch.save(rows, "rows")
        rare = rows.select("row", F.explode("rare").alias("hash"))
        sums = rare.join(self.counts, "hash").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_sum"))
        joined = rows.drop("rare").join(sums, "row", "left").fillna(0, ["rare_known", "rare_sum"])
        total = float(np.log10(self.tokens + self.distinct + 1))
        base = F.col("log_counts") + F.col("rare_sum") - F.col("n_tokens") * total
        spelled = F.col("log_others") + F.col("rare_sum") - F.col("others") * (total + float(np.log10(max(self.other, 1e-300))))
        score = F.col("network") + spelled if self.tokens else base
        return joined.select("doc_id", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(self.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def _learned(held, rate: float):
    """Of a task that holds documents: the tokens it went through, and the network it came to."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, total, waiting, size = None, 0, [], 0
        for batch in batches:
            for data in batch.column("words"):
                waiting.append(np.frombuffer(data.as_buffer(), np.uint16))
                size += len(waiting[-1])
                if size >= LEARN_TOKENS:
                    learner = learner or Learner(Gru.unpacked(held.value), rate, STREAMS)
                    learner.learn(waiting)
                    total, waiting, size = total + size, [], 0
        if waiting:
            learner = learner or Learner(Gru.unpacked(held.value), rate, STREAMS)
            learner.learn(waiting)
            total += size
        if learner:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([learner.network.packed().tobytes()], pa.binary())], ["tokens", "network"])

    return learned


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of networks, weighted by tokens; holds one sum, however many come."""
    total, tokens = None, 0
    for batch in batches:
        for n, data in zip(batch.column("tokens").to_pylist(), batch.column("network"), strict=True):
            values = np.frombuffer(data.as_buffer(), np.float32) * float(n)
            total, tokens = values if total is None else total + values, tokens + n
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["tokens", "network"])


def _scored(model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = model.value
        task = TaskContext.get().partitionId() << 40
        row, waiting, held = 0, [], 0
        for batch in batches:
            for first, tokens, bounds in _tokens(batch, "text"):
                waiting.append((batch.column("doc_id").slice(first, len(bounds) - 1), tokens, bounds))
                held += len(tokens)
                if held > BATCH_TOKENS:
                    out = _score_rows(waiting, vocabulary, network, task + row)
                    row, waiting, held = row + out.num_rows, [], 0
                    yield out
        if waiting:
            yield _score_rows(waiting, vocabulary, network, task + row)

    return scored


def _score_rows(parts: list, vocabulary: Vocabulary, network: Gru, first_row: int) -> pa.RecordBatch:
    tokens = np.concatenate([t for _, t, _ in parts])
    sizes = np.concatenate([np.diff(b) for _, _, b in parts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at, there = vocabulary.look_up(tokens)
    empty = not len(vocabulary.hashes)
    logs = np.where(there, 0.0 if empty else np.log10(vocabulary.counts + 1.0)[at], 0.0)
    words = np.where(there, OTHER if empty else vocabulary.numbers[at], OTHER)
    summed = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every row has its end token, so none is empty
    rare = np.concatenate([[0], np.cumsum(summed((~there).astype(np.int64)))])
    values = [np.arange(len(sizes)) + first_row, None, sizes, summed(there.astype(np.int64)), summed((words == OTHER).astype(np.int64)), summed(logs), summed(np.where(words == OTHER, logs, 0.0)), _run(network, words, bounds) / np.log(10)]
    arrays = [pa.array(v) if v is not None else pa.concat_arrays([i.cast(pa.int64()) for i, _, _ in parts]) for v in values]
    lists = pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(tokens[~there]))
    return pa.RecordBatch.from_arrays([*arrays, lists], ["row", "doc_id", "n_tokens", "known", "others", "log_counts", "log_others", "network", "rare"])


def _run(network: Gru, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log-likelihoods of whole documents: SIDE of them side by side, the longest first, states carried from window to window."""
    order = np.argsort(-np.diff(bounds), kind="stable")
    inputs, recurrent, logs = _by_gate(network.inputs), _by_gate(network.recurrent), network.logs()
    out = np.empty(len(order))
    for at in range(0, len(order), SIDE):
        own = order[at : at + SIDE]
        starts, lengths = bounds[own], bounds[own + 1] - bounds[own]
        # Documents that are not yet at their end, by step.
        active = len(own) - np.cumsum(np.bincount(lengths, minlength=1))[:-1]
        total, h, t = np.zeros(len(own)), np.zeros((len(own), HIDDEN), np.float32), 0
        while t < len(active):
            steps = active[t : t + max(WINDOW, WINDOW * SIDE // (4 * active[t]))].tolist()
            edges = np.cumsum([0, *steps])
            states, owners = np.empty((edges[-1], HIDDEN), np.float32), np.arange(edges[-1]) - np.repeat(edges[:-1], steps)
            targets = words[starts[owners] + np.repeat(np.arange(t, t + len(steps)), steps)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                states[a:b] = h = h[: b - a]
                h, _ = _step(h, inputs.take(targets[a:b], axis=1), recurrent)
            total += np.bincount(owners, logs(states, targets), minlength=len(own))
            t += len(steps)
        out[own] = total
    return out


def held_out() -> Column:
    return F.coalesce(crc_bucket(F.col("doc_id"), 7) == 2, F.lit(False))


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the smoothed unigrams and under the network."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = LanguageModel(spark, documents.filter(~held_out() & F.col("doc_id").isNotNull()))
    return model.score(documents).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
