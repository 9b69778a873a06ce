"""Merkle manifest of a table of documents, and proofs for each row.

A document is a leaf; leaves of a group stand in order of their id, runs of
consecutive nodes become their parent level by level, and the groups' roots
become one root in the same way.

Levels are made by windows: rows are partitioned by group and parent, and a
collect_list over the ordered full frame is at once what the parent hashes and
where a node finds its siblings. STRIDE levels are made in one partitioning,
that of the node that all rows of a block come to: inside it each node is
represented by its first row, so that a parent counts once, and the block's
first row alone goes on to the next stride. A stride's rows are a table in the
shared folder. Proofs are put together from the top: a row appends the
siblings of its block's node, which the stride above has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import scanned
from .common import Scratch, documents

#: Levels that are made in one partitioning; a block has arity ** STRIDE nodes at most. Leaves that are numbered in one task, about.
STRIDE, STRETCH_ROWS = 6, 1 << 15
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def preimage(columns: Sequence[Column]) -> Column:
    """What a leaf hashes: each value as its UTF-8 byte count, a colon and itself, or - for a null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat(*parts)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _side(family: Column, own: Column, before: bool) -> Column:
    """The digests of a run before or after the node at a place in it, as one text."""
    return F.concat_ws("", F.slice(family, F.lit(1), own) if before else F.slice(family, own + 2, F.greatest(F.size(family) - own - 1, F.lit(0))))


def _stride(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes (grp, at: place in the group, n: nodes of the group, digest) with `path`, the siblings before and after at each level below the block's node, and `top`, that node's digest.

    A group that has come to one node stays as it is, so its path ends there.
    """
    block = arity**levels
    rows = nodes.withColumn("block", F.floor(F.col("at") / block)).repartition("grp", "block").withColumn("top", F.col("digest"))
    path = []
    for level in range(levels):
        below, here = arity**level, arity ** (level + 1)
        left = F.ceil(F.col("n") / below)  # nodes of the group at this level
        whole = Window.partitionBy("grp", "block", F.floor(F.col("at") / here)).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("family", F.collect_list(F.when(F.col("at") % below == 0, F.col("top"))).over(whole))
        own = (F.floor(F.col("at") / below) % arity).cast("int")
        going = left > 1
        rows = rows.withColumns({f"p{level}": F.when(going, F.struct(_side(F.col("family"), own, True).alias("before"), _side(F.col("family"), own, False).alias("after"))), "top": F.when(going, digest(F.concat_ws("", "family"))).otherwise(F.col("top"))})
        path.append(f"p{level}")
    return rows.withColumn("path", F.filter(F.array(*path), lambda p: p.isNotNull())).drop("family", *path)


def _tree(nodes: DataFrame, most: int, arity: int, stride: int, scratch: Scratch, tag: str) -> DataFrame:
    """nodes (grp, at, n, digest and others) of groups of at most `most` nodes with `path`, from the node up to its group's last, and `top`, that last node's digest."""
    levels, reach = 0, 1
    while reach < most:
        reach, levels = reach * arity, levels + 1
    now = min(stride, levels)
    own = scratch.written(_stride(nodes, arity, now) if now else nodes.withColumns({"block": F.col("at"), "top": F.col("digest"), "path": F.array().cast("array<struct<before:string,after:string>>")}), f"{tag}-nodes")
    if levels <= stride:
        return own.drop("block")
    block = arity**now
    # parents count once: the block's first row has its node
    above = own.filter(F.col("at") % block == 0).select("grp", F.col("block").alias("at"), F.ceil(F.col("n") / block).alias("n"), F.col("top").alias("digest"))
    upper = _tree(above, -(-most // block), arity, stride, scratch, tag).select("grp", F.col("at").alias("block"), F.col("path").alias("rest"), F.col("top").alias("last"))
    return own.join(upper, ["grp", "block"]).withColumns({"path": F.concat("path", "rest"), "top": F.col("last")}).drop("block", "rest", "last")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path make."""
    return F.aggregate(path, leaf, lambda at, p: digest(F.concat(p["before"], at, p["after"])))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(p["before"], p["after"])))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", columns: Sequence[str] = LEAF, arity: int = 2, stride: int = STRIDE, keep: Sequence[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of docs: the order column, leaf, subroot, root, `path` (for each level up to the root a struct of the siblings before and after, as hex text) and the columns of keep.

    Leaves ascend by the order column, null first; of rows that repeat it by leaf digest, so equal rows are leaves of their own side by side. A group is a value of the group column, null included; groups ascend by UTF-8 bytes, null first. A run of one node is hashed like others while its group has more than one node; a lone leaf is its subroot, and a lone subroot the root. An empty table gives an empty result. Other columns than those named are not read, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    one = {c: F.col(f"`{c}`") for c in dict.fromkeys([*columns, group, order, *keep])}
    leaves = docs.select(one[group].cast("string").alias("value"), one[order].alias("o"), digest(preimage([one[c] for c in columns])).alias("digest"), *[one[c].alias(f"k{i}") for i, c in enumerate(keep)])
    leaves = scratch.written(leaves, "leaves")
    sizes = leaves.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # a number for each group, in order; a row a group, ordered in stretches where there are many
    groups = scratch.written(scanned(sizes, [], ["value"], rank="grp"), "groups")
    n_groups, most, n_rows = groups.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if not n_groups:
        return docs.select(one[order], *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root")], F.lit(None).cast("array<struct<before:string,after:string>>").alias("path"), *[one[c] for c in keep]).limit(0)
    placed = scanned(leaves, ["value"], ["o", "digest"], rank="at", at_most=int(n_rows), stretch_rows=STRETCH_ROWS)
    known = F.broadcast(groups) if n_groups <= 10_000 else groups
    nodes = placed.join(known.withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v"))).drop("v", "value")
    lower = _tree(nodes, int(most), arity, stride, scratch, "leaf")
    tops = lower.filter("at = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("at"), F.lit(n_groups).alias("n"), F.col("top").alias("digest"))
    upper = _tree(tops, int(n_groups), arity, stride, scratch, "group").select(F.col("at").alias("grp"), F.col("path").alias("rest"), F.col("top").alias("root"))
    every = lower.join(F.broadcast(upper) if n_groups <= 10_000 else upper, "grp")
    return every.select(F.col("o").alias(order), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c != order])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and folded_root, verified of the leaf after tampering: where 7 divides the crc32 of the id, n_chars is one more."""
    docs = documents(spark, sf_dir)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    seen = {c: F.col(c) + touched.cast("int") if c == "n_chars" else F.col(c) for c in LEAF}
    scratch = Scratch(spark)
    rows = manifest(docs.withColumn("seen", digest(preimage([seen[c] for c in LEAF]))), keep=["seen"], scratch=scratch)
    checked = rows.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return scratch.result(checked.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")


def _preimage_sql(n_chars: str) -> str:
    values = ["doc_id", "source", "lang", n_chars, "text"]
    return " || ".join(f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values)


def _walk_sql(name: str, start: str, tree: str, group: str) -> str:
    """Rows of start on their way up: the proof so far and the digest folded so far."""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT w.* REPLACE (w.level + 1 AS level, w.pos // 2 AS pos, (w.n + 1) // 2 AS n, w.proof || coalesce(s.digest, '') AS proof,
                      sha256(CASE WHEN w.pos % 2 = 1 THEN s.digest || w.folded ELSE w.folded || coalesce(s.digest, '') END) AS folded)
  FROM {name} w LEFT JOIN {tree} s ON {group} s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)"""


def _tree_sql(name: str, start: str, group: str) -> str:
    keys = f"{group}, " if group else ""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT {keys}level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY {keys}level, pos // 2)"""


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id
  FROM (SELECT doc_id, lang, sha256({_preimage_sql("n_chars")}) AS leaf,
               CASE WHEN doc_id IS NOT NULL AND crc % 7 = 0 THEN sha256({_preimage_sql("n_chars + 1")}) ELSE sha256({_preimage_sql("n_chars")}) END AS seen
        FROM (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                                        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
              FROM documents))),
{_tree_sql("tree", "SELECT lang, 0 AS level, pos, n, leaf AS digest FROM leaves", "lang").strip()},
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
{_tree_sql("tops", "SELECT 0 AS level, pos, n, subroot AS digest FROM subroots", "").strip()},
{_walk_sql("low", "SELECT id, lang, 0 AS level, pos, n, '' AS proof, seen AS folded FROM leaves", "tree", "s.lang IS NOT DISTINCT FROM w.lang AND").strip()},
{_walk_sql("high", "SELECT l.id, l.lang, 0 AS level, s.pos, s.n, l.proof, l.folded FROM low l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang WHERE l.n = 1", "tops", "").strip()}
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root, h.folded = r.digest AS verified
FROM leaves l JOIN high h ON h.id = l.id AND h.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT digest FROM tops WHERE n = 1) r
"""
