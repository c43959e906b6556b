"""Merkle manifest of a table of documents as an external-memory node store.

Leaves are digests of rows. Per source they are sorted into runs of range partitions, numbered, and stream into Parquet
tables by level: a row of a level is a run of 16 consecutive nodes, kept as one string of their digests, with the digest of
the run. Each level is made from the table before it alone. The sources' subroots form a tree of their own, built in the
same way. Proofs come from merge joins of the levels by coordinate (tree, position), from the root down: a node's path is
its left and right siblings, then its parent's path, so 16 leaves share each path that is shuffled.

Texts are read once, for the leaves; all later work is on digests. A source of any size is many runs and many nodes: no
step gathers more than 16 nodes, and positions are counts of runs, summed. Only the root, one digest, comes to the driver.

Defined results: a null column is `-`; an empty text is `0:`; rows of one id in one source are ordered by leaf, and rows that are
equal in all columns of the leaf by any order, which gives them the same digests as a set; null ids come first and are never
tampered with; a lone leaf is its source's subroot and a lone subroot the root, with no siblings and the proof H(''); an
empty table gives no rows and no root; further columns are ignored; very long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import Scratch, crc_bucket, few, lower_ascii

FANOUT = 16
WIDTH = 64
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(*values: Column) -> Column:
    """H of the fields: `-` for null, else byte count, colon, value."""
    texts = [v.cast("string") for v in values]
    fields = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return digest(F.concat(*fields))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def siblings_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


class MerkleManifest:
    """The node store of one table: `root`, `levels` and proofs."""

    def __init__(self, spark: SparkSession, documents: DataFrame, fanout: int = FANOUT, broadcast_rows: int = 100_000):
        self.spark, self.fanout, self.broadcast_rows = spark, fanout, broadcast_rows
        self.scratch = Scratch(spark, "merkle")
        columns = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
        docs = documents.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns.items()])
        field = [F.col(c) for c in LEAF_COLUMNS]
        tampered = F.when(crc_bucket(F.col("doc_id"), TAMPER_EVERY) == 0, leaf_digest(*field[:-1], lower_ascii(F.col("text"))))
        # The key of a source's tree: never null, and in the order of sources, null first.
        tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
        leaves = docs.select(tree.alias("tree"), "doc_id", leaf_digest(*field).alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
        leaves = self.scratch.save(leaves, "leaves")
        placed = self._placed(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")], "leaf-runs")
        leaf = placed.select("tree", "pos", "n", "digest", F.struct("doc_id", "tampered").alias("payload"))
        self.levels, self.subroots = self._built(leaf, "sources")
        tops = self._placed(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "height"), [F.col("name")], "subroot-runs")
        top = tops.select("tree", "pos", "n", "digest", F.struct("name", "height").alias("payload"))
        self.top_levels, roots = self._built(top, "top")
        found = roots.select("digest", "tree", "height").head()
        self.root = found["digest"] if found else None

    def _placed(self, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
        """Rows with pos, from 0 in each tree's order, and n, the tree's number of rows.

        Range partitions, sorted, are the runs; a row's place is its place in the run and the sizes of the runs before.
        """
        by = [F.col("tree"), *order]
        runs = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
        runs = runs.withColumn("run", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")
        runs = self.scratch.save(runs, name)
        parts = runs.groupBy("tree", "run").agg(F.min("row").alias("first"), F.count("*").alias("part"))
        before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("tree", "run", (F.coalesce(F.sum("part").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("part").over(Window.partitionBy("tree")).alias("n"))
        parts = self.scratch.save(parts, f"{name}-sizes")
        return runs.join(few(parts, self.broadcast_rows), ["tree", "run"]).withColumn("pos", F.col("row") + F.col("shift")).drop("run", "row", "shift")

    def _built(self, nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
        """Tables of runs by level, and the trees' roots (tree, digest, height).

        A run is (tree, pos, n, digests, payloads, digest): its position among the n nodes of the next level, and its
        members' digests one after another. Payloads exist on the lowest level alone, where lone leaves are runs too.
        """
        levels: list[DataFrame] = []
        roots: list[DataFrame] = []
        while True:
            member = F.struct("pos", "digest", *([] if levels else ["payload"]))
            runs = nodes.groupBy("tree", F.expr(f"pos div {self.fanout}").alias("parent"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
            digests = F.array_join(F.transform("members", lambda m: m["digest"]), "")
            payloads = [] if levels else [F.transform("members", lambda m: m["payload"]).alias("payloads")]
            above = F.expr(f"(n + {self.fanout - 1}) div {self.fanout}")
            runs = runs.select("tree", F.col("parent").alias("pos"), F.col("n").alias("members_n"), above.alias("n"), digests.alias("digests"), *payloads)
            runs = runs.withColumn("digest", F.when(F.col("members_n") == 1, F.col("digests")).otherwise(digest(F.col("digests"))))
            runs = self.scratch.save(runs.sortWithinPartitions("tree", "pos"), f"{name}/level={len(levels)}")
            levels.append(runs)
            height = F.when(F.col("members_n") == 1, 0).otherwise(len(levels))
            roots.append(runs.filter("n = 1").select("tree", "digest", height.alias("height")))
            nodes = runs.filter("n > 1").select("tree", "pos", "n", "digest")
            if nodes.isEmpty():
                break
        found = roots[0]
        for more in roots[1:]:
            found = found.unionByName(more)
        return levels, found

    def _descended(self, levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
        """(payload, digest, path, *keep) of every leaf: levels joined by coordinate from the top, with the tops' own paths.

        `tops` is (tree, height, path, *keep). Each join carries a path for a run of nodes, not for each leaf.
        """
        step = F.struct(F.expr(f"substring(digests, 1, {WIDTH} * i)").alias("left"), F.expr(f"substring(digests, {WIDTH} * (i + 1) + 1)").alias("right"))
        own = F.expr(f"substring(digests, {WIDTH} * i + 1, {WIDTH})")
        paths = None
        for level in reversed(range(len(levels))):
            start = tops.filter(F.col("height") == level + 1).select("tree", F.lit(0).cast("long").alias("pos"), "path", *keep)
            paths = start if paths is None else paths.unionByName(start)
            runs = levels[level].filter("members_n > 1").drop("digest")
            members = runs.hint("merge").join(paths, ["tree", "pos"])
            if level:
                numbers = F.explode(F.expr(f"sequence(0, length(digests) div {WIDTH} - 1)")).alias("i")
                members = members.select("tree", "pos", "digests", "path", *keep, numbers)
                paths = members.select("tree", (F.col("pos") * self.fanout + F.col("i")).alias("pos"), F.concat(F.array(step), "path").alias("path"), *keep)
        leaves = members.select("digests", "path", *keep, F.posexplode("payloads").alias("i", "payload"))
        leaves = leaves.select("payload", own.alias("digest"), F.concat(F.array(step), "path").alias("path"), *keep)
        lone = levels[0].filter("members_n = 1").select("tree", F.col("payloads")[0].alias("payload"), "digest")
        return leaves.unionByName(lone.join(tops.filter("height = 0"), "tree").select("payload", "digest", "path", *keep))

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, tampered, subroot, path) of every row; path holds (left, right), from the leaf to the root.

        tampered is the leaf of the altered row, null where the row is not altered.
        """
        none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
        tops = self.top_levels[-1].select("tree", F.when(F.col("members_n") == 1, 0).otherwise(len(self.top_levels)).alias("height"), none.alias("path")).filter("tree = ''")
        subroots = self._descended(self.top_levels, tops, [])
        subroots = subroots.select(F.col("payload.name").alias("tree"), F.col("payload.height").alias("height"), "path", F.col("digest").alias("subroot"))
        subroots = self.scratch.save(subroots, "subroot-paths")
        leaves = self._descended(self.levels, subroots, ["subroot"])
        return leaves.select("payload.doc_id", F.col("digest").alias("leaf"), "payload.tampered", "subroot", "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and the check of every row, altered where 5 divides the id's crc32."""
    manifest = MerkleManifest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    root = F.lit(manifest.root).cast("string")
    found = manifest.proofs().select("doc_id", "leaf", "subroot", root.alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of decimal digits, bit by bit, as no function of the SQL engine gives it.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce(range(8), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"""
OP13_SQL = rf"""
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS t, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, coalesce({_CRC} % 5 = 0, false) AS altered FROM documents
), h AS (
  SELECT doc_id, t, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN altered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS held
  FROM f
), l AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM h
), nodes AS (
  SELECT t, 0 AS k, pos, n, leaf AS h FROM l
  UNION ALL
  SELECT t, k + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY t, k, n, pos // 16
), subroots AS (
  SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS k, pos, n, h FROM subroots
  UNION ALL
  SELECT k + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY k, n, pos // 16
), runs AS (
  SELECT t, k, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS members FROM nodes WHERE n > 1 GROUP BY t, k, pos // 16
  UNION ALL SELECT '', k, pos // 16, string_agg(h, '' ORDER BY pos) FROM top WHERE n > 1 GROUP BY k, pos // 16
), climb AS (
  SELECT row_number() OVER () AS i, t, doc_id, leaf, 0 AS k, pos, n, held AS x, '' AS proof FROM l
  UNION ALL
  SELECT i, c.t, doc_id, leaf, c.k + 1, c.pos // 16, (c.n + 15) // 16,
    sha256(left(members, 64 * (c.pos % 16)) || x || substr(members, 64 * (c.pos % 16) + 65)),
    proof || left(members, 64 * (c.pos % 16)) || substr(members, 64 * (c.pos % 16) + 65)
  FROM climb c JOIN runs ON runs.t = c.t AND runs.k = c.k AND run = c.pos // 16 WHERE c.n > 1
), over AS (
  SELECT i, doc_id, leaf, s.h AS subroot, 0 AS k, s.pos, s.n, x, proof FROM climb c JOIN subroots s ON s.t = c.t WHERE c.n = 1
  UNION ALL
  SELECT i, doc_id, leaf, subroot, o.k + 1, o.pos // 16, (o.n + 15) // 16,
    sha256(left(members, 64 * (o.pos % 16)) || x || substr(members, 64 * (o.pos % 16) + 65)),
    proof || left(members, 64 * (o.pos % 16)) || substr(members, 64 * (o.pos % 16) + 65)
  FROM over o JOIN runs ON runs.t = '' AND runs.k = o.k AND run = o.pos // 16 WHERE o.n > 1
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.h AS verified
FROM over, (SELECT h FROM top WHERE n = 1) r WHERE n = 1
"""
