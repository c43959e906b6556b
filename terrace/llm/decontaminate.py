"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

Items are cut into windows of `window` consecutive words (a shorter item is one window). A window's tokens are its
shingles of `shingle` words, ordered by rarity: their number of occurrences in the whole corpus, then their hash.
Full containment needs every token, so the necessary prefix has length one: the rarest shingle. The corpus joins on that
token; its place in the window gives the only possible start, bounded by the document's ends (positional and length
bounds), and the words from there are compared with the window itself, so hash collisions change nothing.

Both joins probe a broadcast table of benchmark tokens. Its rows are counted first; beyond `block_windows` the windows
are dealt into blocks of at most that many, and each block is joined to all rows in a pass of its own. Nothing that
grows with the documents is broadcast, and the corpus is never shuffled: only hits are.

Defined results: a null or wordless text has no words and no hits; repeated rows (same id and text) give a row each, all
alike, and so do rows with null ids; equal ids with different texts have results of their own; very long texts are searched
whole; of tied shingles the one with the least hash is the prefix; items that are null, wordless or repeated (same id and
words) add nothing; an empty table on either side gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import lower_ascii

WINDOW, SHINGLE, BLOCK_WINDOWS = 10, 3, 50_000
#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order: runs of 0-9, a-z and non-ASCII characters of the lower-cased text; empty for null."""
    return F.coalesce(F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != ""), F.array().cast("array<string>"))


def _token(words: Column, at: Column, width: int) -> Column:
    """Hash of `width` words from the zero-based place `at`; what lies behind the end counts as null."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(width)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_words, items): distinct windows with the sorted ids of the items that hold them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter("size(w) > 0 and item_id is not null")
    starts = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    return starts.groupBy(F.expr(f"slice(w, s + 1, {window})").alias("window_words")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _positions(documents: DataFrame, width: int) -> DataFrame:
    """A row for each word: key of the document, its words, place and the token that starts there; and one of place -1 without."""
    words = documents.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    placed = words.select("*", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    return placed.withColumn("token", F.when(F.col("at") >= 0, _token(F.col("words"), F.col("at"), width)))


def _token_counts(documents: DataFrame, tokens: DataFrame, width: int) -> DataFrame:
    """Occurrences in the corpus of each benchmark token; counted before the shuffle, so a token is a row per task."""
    return _positions(documents, width).select("token").join(F.broadcast(tokens), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))


def _prefixes(documents: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(token, offset, window_words, items): each window with its rarest shingle."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("window_words") - width), lambda i: _token(F.col("window_words"), i, width)))
    shingles = windows.select("window_words", "items", at.alias("offset", "token"))
    counts = _token_counts(documents, shingles.select("token").distinct(), width)
    ranked = shingles.join(counts, "token", "left").groupBy("window_words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("first"), F.first("items").alias("items"))
    return ranked.select("first.token", "first.offset", "window_words", "items")


def find_occurrences(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, n_words, start, length, items): every occurrence of a window, start from 0.

    Each row of documents also has one row with null start, so that documents without hits stay, and repeated ones count.
    """
    windows = item_windows(benchmark, window)
    # Lengths and the number of windows, each as often as items hold it, come from the benchmark alone; at most `window` rows reach the driver.
    sizes = {r["length"]: r["n"] for r in windows.groupBy(F.size("window_words").alias("length")).agg(F.sum(F.size("items")).alias("n")).collect()}
    wide = sum(n for length, n in sizes.items() if length >= shingle)
    groups = [(length, F.size("window_words") == length, n) for length, n in sorted(sizes.items()) if length < shingle]
    groups += [(shingle, F.size("window_words") >= shingle, wide)] if wide or not groups else []
    found = []
    for width, belongs, n in groups:
        blocks = max(1, -(-n // block_windows))
        for block in range(blocks):
            part = windows.filter(belongs & (F.pmod(F.xxhash64("window_words"), F.lit(blocks)) == block))
            keyed = F.broadcast(_prefixes(documents, part, width))
            joined = _positions(documents, width).join(keyed, "token", "left")
            start = F.col("at") - F.col("offset")
            length = F.size("window_words")
            verified = F.col("offset").isNotNull() & (start >= 0) & (start + length <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window_words"))
            rows = joined.withColumn("hit", F.coalesce(verified, F.lit(False))).filter(F.col("hit") | ((F.col("at") < 0) & F.lit(not found)))
            found.append(rows.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.when(F.col("hit"), start).alias("start"), F.when(F.col("hit"), length).alias("length"), F.when(F.col("hit"), F.col("items")).alias("items")))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """For each row doc_id, text_hash, n_words, n_hit (words inside any occurrence), items (sorted ids)."""
    hits = find_occurrences(documents, benchmark, **options)
    covered = F.expr("flatten(transform(filter(spans, x -> x.start is not null), x -> sequence(x.start, x.start + x.length - 1)))")
    found = hits.groupBy("doc_id", "text_hash").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("items"), F.count_if(F.col("start").isNull()).alias("copies"))
    found = found.select("doc_id", "text_hash", "n_words", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "copies")
    # Copies in two steps, so that no array of them is long.
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 4096))))
    rows = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("part") * 4096, F.lit(4096).cast("long")))))
    return rows.drop("copies", "part", "copy")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)
), occ AS (SELECT doc_id, s, bw.n AS n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
