"""Source divergence audit by joint count histograms.

Terms of whole texts are counted by language and source; each language keeps the terms that enough of its documents hold.
For each pair of a language's sources the distinct (count, count) combinations of the kept terms are tallied, with the cells
where one or both are zero: those follow from the sources' own histograms and the number of terms, so no row is made for a
term that a source lacks. A divergence f is then evaluated once for each combination, times its multiplicity.

The jobs: sources are numbered from their own two columns. One pass over the texts counts terms in numpy and Arrow: a task
sums what it holds, by numbers of groups and terms, and gives rows only when sums no longer make them fewer. Those rows are
shuffled once, by term, and become one row for each kept term with the counts of its sources, which all else reads.
A term's sources meet by pairs of blocks of 64 sources, so a term of many sources is dealt over many tasks; its pairs are as
many as the result asks for. Ranks need no more than the first 200 terms of a group: each task keeps its own first ones
before they meet.

Arithmetic is in whole numbers: counts are scaled to parts of 10^9 by decimal division, squares stay below 2^63.

Defined results: null language, source and text are empty strings; texts without terms still make their group; a language
without kept terms has zero divergence; repeated rows are documents of their own; ties rank by the item's bytes; an empty
table gives no rows; further columns are ignored. A task holds one Arrow batch, or one text, at a time, and counts of up to
2,000,000 terms of documents or 64 MB of terms; very long texts are counted whole. A term's row holds all its sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import Scratch, few, small_batches, text_chunks, tidy

SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP = 3, 200
BLOCK = 64
#: What a task holds of counts, and of the bytes of their terms.
FLUSH_ROWS, FLUSH_BYTES = 2_000_000, 64 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of terms: letters, and all of characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of several texts in order, lower-cased, and the row of each."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = _LOWER[data[letter]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
    return terms.dictionary_encode(), np.searchsorted(offsets, starts, side="right") - 1


#: Terms with the number of the group, the occurrences and the documents of each.
Sums = tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]


def _summed(parts: list[Sums]) -> Sums:
    """One row for each group and term of the parts."""
    terms = pa.chunked_array([part[0] for part in parts]).unify_dictionaries()
    words = terms.chunk(0).dictionary
    group, n, docs = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
    key = group * len(words) + np.concatenate([chunk.indices.to_numpy() for chunk in terms.chunks])
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    group, code = np.divmod(key[starts], len(words))
    return pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), words), group, np.add.reduceat(n[order], starts), np.add.reduceat(docs[order], starts)


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task, summed; (lang, source) alone for each group of the task."""
    waiting: list[Sums] = []
    held, taken, groups = 0, 0, {}
    columns = ["lang", "source", "term", "n", "docs"]

    def names() -> list[pa.Array]:
        return [pa.array(x, pa.large_string()) for x in zip(*groups, strict=True)]

    def rows(sums: Sums) -> Iterator[pa.RecordBatch]:
        terms, group, n, docs = sums
        named = names()
        for at in range(0, len(terms), 20_000):
            to = slice(at, at + 20_000)
            place = pa.array(group[to])
            yield pa.RecordBatch.from_arrays([*(x.take(place) for x in named), terms[to].dictionary_decode(), pa.array(n[to]), pa.array(docs[to])], columns)

    for batch in batches:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([groups.setdefault(pair, len(groups)) for pair in pairs], np.int64)
        for first, end, data, offsets in text_chunks(batch, "text"):
            terms, row = _terms(data, offsets)
            if not len(terms):
                continue
            # Distinct terms of each row with their counts.
            size = len(terms.dictionary)
            each, n = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(each, size)
            waiting.append((pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), terms.dictionary), group[first:end][row], n, np.ones(len(n), np.int64)))
            held += len(n)
            taken += terms.dictionary.nbytes
            if held > FLUSH_ROWS or taken > FLUSH_BYTES:
                waiting = [_summed(waiting)]
                held, taken = len(waiting[0][0]), waiting[0][0].dictionary.nbytes
                if held > FLUSH_ROWS // 2 or taken > FLUSH_BYTES // 2:
                    yield from rows(waiting[0])
                    waiting, held, taken = [], 0, 0
    if waiting:
        yield from rows(_summed(waiting))
    if groups:
        nothing = [pa.nulls(len(groups), kind) for kind in (pa.large_string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*names(), *nothing], columns)


def scaled(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for all counts."""
    part = f"(cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast(greatest({total} + {terms}, 1) as decimal(19,0))"
    return F.expr(f"1 + {part}")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def term_counts(rows: DataFrame, least_documents: int) -> DataFrame:
    """(lang, term, lang_n, held array of (no, n)) of rows (lang, no, term, n, docs), of terms in enough documents.

    Tasks have summed already, so rows go out as they are, and by term: sums by source need no other shuffle.
    """
    dealt = rows.select("lang", "term", "no", "n", "docs").repartition("lang", "term")
    sums = dealt.groupBy("lang", "term", "no").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = F.sort_array(F.collect_list(F.struct("no", "n"))).alias("held")
    terms = sums.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), held)
    return terms.filter(F.col("docs") >= least_documents).drop("docs")


class DivergenceAudit:
    """Counts of one table's terms by (lang, source), and the divergences of its sources."""

    def __init__(self, spark: SparkSession, documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, block: int = BLOCK, broadcast_rows: int = 100_000):
        self.spark, self.block, self.broadcast_rows = spark, block, broadcast_rows
        self.scratch = Scratch(spark, "divergence")
        small_batches(spark)
        docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
        by_lang = Window.partitionBy("lang")
        place = [(F.row_number().over(by_lang.orderBy("source")) - 1).alias("no"), (F.count("*").over(by_lang) - 1).alias("last")]
        named = self.scratch.save(docs.select("lang", "source").distinct().select("lang", "source", *place), "named")
        rows = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").filter("term is not null")
        #: (lang, term, lang_n, held): kept terms, with (no, n) of each source that has them, by number.
        self.kept = self.scratch.save(term_counts(rows.join(few(named, broadcast_rows), ["lang", "source"]), least_documents), "kept")
        counts = self.kept.select("lang", "term", "lang_n", F.inline("held"))
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = counts.groupBy("lang", "no").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
        numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "held", "v", "lang_total")]
        groups = named.join(totals, ["lang", "no"], "left").join(langs, "lang", "left")
        #: (lang, source, no, last, total, held, v, lang_total): every group, numbered from 0 to last within its language.
        self.groups = self.scratch.save(groups.select("lang", "source", "no", "last", *numbers), "groups")
        #: (lang, no, term, lang_n, n) and the group's columns, of kept terms that occur in the source.
        self.counts = counts.join(few(self.groups.drop("held"), broadcast_rows), ["lang", "no"])

    def joint_histograms(self) -> DataFrame:
        """(lang, a, b, x, y, k): of sources numbered a < b of a language, k kept terms are counted x in a and y in b.

        Cells where a count is zero are there too: each pair's multiplicities sum to the language's number of terms.
        """
        lasts = self.groups.groupBy("lang").agg(F.max("last").alias("last"))
        blocks = F.expr(f"transform(sequence(0, last div {self.block}), i -> filter(held, h -> h.no div {self.block} = i))")
        terms = self.kept.join(few(lasts, self.broadcast_rows), "lang").select("lang", "term", blocks.alias("blocks"))
        left = terms.select("lang", "term", "blocks", F.posexplode("blocks").alias("i", "left"))
        both = left.select("lang", "term", "i", "left", F.posexplode(F.expr("slice(blocks, i + 1, size(blocks))")).alias("further", "right"))
        if lasts.filter(F.col("last") >= self.block).limit(1).count():
            both = both.filter("size(left) > 0 and size(right) > 0").repartition("lang", "term", "i", "further")
        both = both.select("lang", "further", "right", F.posexplode("left").alias("at", "own"))
        # Of one block, a source meets those after it.
        both = both.select("lang", F.col("own.no").alias("a"), F.col("own.n").alias("x"), F.inline(F.expr("if(further = 0, slice(right, at + 2, size(right)), right)")).alias("b", "y"))
        both = self.scratch.save(both.groupBy("lang", "a", "b", "x", "y").agg(F.count("*").alias("k")), "both")
        # A source's own histogram gives each pair's cells with a zero, less what both have; the rest of the terms have neither.
        own = self.counts.groupBy("lang", "no", "n", "last").agg(F.count("*").alias("m")).withColumn("other", F.explode(F.expr("sequence(0, last)"))).filter("other <> no")
        pair = [F.least("no", "other").alias("a"), F.greatest("no", "other").alias("b")]
        one = own.select("lang", *pair, F.expr("if(no < other, n, 0)").alias("x"), F.expr("if(no < other, 0, n)").alias("y"), F.col("m").alias("k"))
        less = [both.select("lang", "a", "b", x.alias("x"), y.alias("y"), (F.col("k") * sign).alias("k")) for x, y, sign in ((F.col("x"), F.lit(0), -1), (F.lit(0), F.col("y"), -1), (F.lit(0), F.lit(0), 1))]
        pairs = self.groups.filter("no < last").select("lang", F.col("no").alias("a"), F.explode(F.expr("sequence(no + 1, last)")).alias("b"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("v").alias("k"))
        neither = one.select("lang", "a", "b", F.lit(0).alias("x"), F.lit(0).alias("y"), (-F.col("k")).alias("k"))
        zeros = pairs.unionByName(one).unionByName(neither)
        for part in less:
            zeros = zeros.unionByName(part)
        return both.unionByName(zeros.groupBy("lang", "a", "b", "x", "y").agg(F.sum("k").alias("k")))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): the divergence of each source from each other one of its language."""
        side = lambda x: few(self.groups.select("lang", F.col("no").alias(x), F.col("source").alias(f"source_{x}"), F.col("total").alias(f"total_{x}"), *(["v"] if x == "a" else [])), self.broadcast_rows)
        cells = self.joint_histograms().join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
        cells = cells.withColumns({"p": scaled("x", "total_a", "v"), "q": scaled("y", "total_b", "v")})
        total = lambda p, q: F.sum(F.col("k").cast("decimal(19,0)") * divergence(p, q)).cast("long")
        sums = cells.groupBy("lang", "source_a", "source_b").agg(total("p", "q").alias("ab"), total("q", "p").alias("ba"))
        ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("ba").alias("value"))))
        return sums.select("lang", ways.alias("way")).select("lang", "way.*")

    def terms(self) -> DataFrame:
        """(lang, source, item, value): kept terms that a source has more often than its language."""
        shares = self.counts.withColumns({"p": scaled("n", "total", "v"), "q": scaled("lang_n", "lang_total", "v")}).filter("p > q")
        return shares.select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of sources from each other, and each source's terms that stand out, ranked."""
    audit = DivergenceAudit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return columns(audit.pairs(), "pair").unionByName(columns(audit.terms(), "term").filter(F.col("rank") <= TOP))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, term, count(*) AS c FROM o GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c, k.c AS lang_c FROM g JOIN k USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
t AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY ALL),
p AS (
  SELECT x.*, 1 + (1000000000::HUGEINT * (c + 1)) // (t.n + l.v) AS p, 1 + (1000000000::HUGEINT * (lang_c + 1)) // (l.n + l.v) AS q
  FROM x JOIN t USING (lang, source) JOIN l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
"""
