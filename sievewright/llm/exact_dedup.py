"""Exact deduplication by a two-pass Bloom filter.

Pass one adds every text's hash to a blocked counting Bloom filter of two bit
planes: "some key set this bit" and "at least two did". Pass two tests every
row: only where all bits of a key are in the second plane can the text occur
twice, and only those rows shuffle, by their full SHA-256. The rest pass
straight through as groups of one.

What moves is a digest row (id, length, SHA-256), never a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, documents, fields, tidy, written

#: ASCII white space, deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
#: log2 of the bits of a block; a block's two planes are merged by one task.
BLOCK_BITS = 16
#: A group is large from this part of all rows on.
LARGE = 1000
#: Bits that a key sets, each 16 bits of its hash.
PROBES = 4

DIGEST = fields(("doc_id", T.LongType()), ("n_code_points", T.LongType()), ("sha", T.BinaryType()), ("h1", T.LongType()), ("h2", T.LongType()))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_code_points", pa.int64()), ("sha", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        sha = [hashlib.sha256(x.translate(None, WHITE)).digest() for x in text.cast(pa.binary()).to_pylist()]
        words = np.frombuffer(b"".join(sha), dtype="<i8").reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.utf8_length(text).cast(pa.int64()), pa.array(sha, pa.binary()), pa.array(words[:, 0] & 0x7FFFFFFFFFFFFFFF), pa.array(words[:, 1].copy())], schema=_ARROW)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, code points of the original text, SHA-256 of the text without white space, and two 64-bit parts of that hash."""
    return chosen(docs, id_col, text_col).mapInArrow(tidy(_digest), DIGEST)


def _marks(n_blocks: int):
    """A task's part of the filter: for each block the positions set once and set twice or more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(c)) for c in ("h1", "h2"))
            block = (h1 % n_blocks) << BLOCK_BITS
            seen += [block | ((h2 >> (16 * i)) & 0xFFFF) for i in range(PROBES)]
        if not seen:
            return
        bits, times = np.unique(np.concatenate(seen), return_counts=True)
        block = bits >> BLOCK_BITS
        cut = np.flatnonzero(np.diff(block)) + 1
        low, twice = (bits & 0xFFFF).astype("<u2"), times > 1
        starts = np.concatenate([[0], cut])
        rows = [(int(block[s]), a[~t].tobytes(), a[t].tobytes()) for s, a, t in zip(starts, np.split(low, cut), np.split(twice, cut), strict=True)]
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary())], names=["block", "once", "twice"])

    return build


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The second plane of a block, as 64-bit words."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    for once in pdf["once"]:
        at = np.frombuffer(once, "<u2")
        count[at] = np.minimum(count[at] + 1, 2)
    for twice in pdf["twice"]:
        count[np.frombuffer(twice, "<u2")] = 2
    words = np.packbits(count > 1, bitorder="little").view("<i8")
    return pd.DataFrame({"block": [key[0]], "words": [words.tolist()]})


def repeat_filter(dg: DataFrame, n_rows: int, bits_per_key: int) -> tuple[DataFrame, int]:
    """The plane of bits that two keys or more have set, a row for each block, and the number of blocks.

    It takes bits_per_key bits for each row, so it tells as much at any size.
    """
    n_blocks = max(1, -(-n_rows * bits_per_key >> BLOCK_BITS))
    marks = dg.select("h1", "h2").mapInArrow(tidy(_marks(n_blocks), 10_000), fields(("block", T.LongType()), ("once", T.BinaryType()), ("twice", T.BinaryType())))
    planes = marks.groupBy("block").applyInPandas(_merge, fields(("block", T.LongType()), ("words", T.ArrayType(T.LongType()))))
    return planes, n_blocks


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_key: int = 16, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space. Of equal texts the row with the most code points stays, then the smallest id; a null id comes after all others.
    The filter is broadcast up to max_broadcast_bytes; a larger one is dealt by block, and digest rows are sent to their block (AQE splits a block that many rows hit). A null text counts as empty, so all null, empty and blank texts are one group. Rows that repeat an id and a text are all counted and all marked kept where their id is the one kept. An empty table gives an empty result. Other columns are not read.
    """
    dg = written(digests(docs, id_col, text_col), "digests")
    n_rows = dg.count()
    planes, n_blocks = repeat_filter(dg, n_rows, bits_per_key)
    planes = written(planes, "planes")
    planes = F.broadcast(planes) if n_blocks << BLOCK_BITS - 3 <= max_broadcast_bytes else planes
    probe = dg.withColumn("block", F.col("h1") % F.lit(n_blocks)).join(planes, "block", "left")
    hits = [F.getbit(F.element_at("words", ((at := F.shiftrightunsigned("h2", 16 * i).bitwiseAND(F.lit(0xFFFF))) / 64).cast("int") + 1), (at % 64).cast("int")) == 1 for i in range(PROBES)]
    flagged = hits[0]
    for hit in hits[1:]:
        flagged = flagged & hit
    probe = probe.select("doc_id", "n_code_points", "sha", F.coalesce(flagged, F.lit(False)).alias("possible"))

    single = probe.filter(~F.col("possible")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    rows = probe.filter("possible").select("doc_id", "n_code_points", "sha")
    order = F.struct((-F.col("n_code_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    groups = rows.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")).select("sha", F.col("first.id").alias("keep_id"), "group_size")
    # groups of a thousandth of all rows or more are at most a thousand: they are broadcast, so that no task gets all rows of one
    large = F.col("group_size") * LARGE >= n_rows
    met = rows.join(F.broadcast(groups.filter(large)), "sha", "left")
    rest = met.filter("group_size IS NULL").select("doc_id", "sha").join(groups.filter(~large), "sha")
    many = met.filter("group_size IS NOT NULL").select("doc_id", "sha", "keep_id", "group_size").unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
    return single.unionByName(many).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, text_sha256,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d)
"""
