"""Packing by best-fit decreasing.

Documents are tokenised where they are read. Overlong ones are cut into full
windows there; what moves is one small row for each piece (id, place, length,
checksum), never a text or its ids. Pieces are dealt by a hash of a number of
their own into groups of a bounded size, so no id or text can make a group
large, and each group is packed by itself:
longest piece first, into the open sequence with the least room that holds it.
A segment tree over remaining capacities finds that sequence in
log2(capacity) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, documents, fields, tidy, written
from .tokens import tokenizer

PIECE = fields(("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()))
#: Pieces with a number of their own, which deals them.
NUMBERED = T.StructType(PIECE.fields + fields(("number", T.LongType())).fields)
PACKED = T.StructType(PIECE.fields + fields(("sequence_id", T.LongType()), ("offset", T.LongType()), ("sequence_tokens", T.LongType()), ("padded_to", T.LongType())).fields)


class CapacityTree:
    """Open sequences by remaining capacity, 0 to size; tightest(need) finds the smallest capacity that is at least need."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self._open[capacity].append(sequence)
        self._shift(capacity, 1)

    def take(self, capacity: int) -> int:
        self._shift(capacity, -1)
        return self._open[capacity].pop()

    def _shift(self, capacity: int, by: int) -> None:
        node = capacity + self._leaves
        while node:
            self._count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        count, node = self._count, need + self._leaves
        if count[node]:
            return need
        while node > 1:  # up, until a right neighbour holds something
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self._leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self._leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order, each at most capacity: the sequence and the offset of each, and the tokens of each sequence."""
    tree, used = CapacityTree(capacity), []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        room = tree.tightest(n)
        if room is None:
            room, at = capacity, len(used)
            used.append(0)
        else:
            at = tree.take(room)
        sequence[i], offset[i] = at, used[at]
        used[at] += n
        if room > n:
            tree.add(room - n, at)
    return sequence, offset, np.array(used, np.int64)


def _cut(path: str, end_id: int, window: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), int(end_id).to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.ids(texts), strict=True):
                ids += end
                total = len(ids) // 4
                rows += [(doc, at, min(window, total - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), total) for at in range(0, total, window)]
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(number, number + len(rows)))], names=NUMBERED.names)
            number += len(rows)
        encode.forget()

    return pieces


def _pack_group(capacity: int, n_groups: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32", "number"], ascending=[False, True, True, True, True], na_position="last")
        sequence, offset, used = best_fit_decreasing(pdf["length"].tolist(), capacity)
        total = used[sequence]
        pdf = pdf.assign(sequence_id=sequence * n_groups + key[0], offset=offset, sequence_tokens=total, padded_to=np.where(total & (total - 1) == 0, total, capacity))
        return pdf[PACKED.names].astype({"doc_id": "Int64"})

    return pack


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, group_rows: int = 50_000) -> DataFrame:
    """One row for each piece of a document: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens (with the end id), sequence_id, offset; and sequence_tokens and padded_to of its sequence.

    Every document ends with end_id, so a null or empty text is a piece of one token. Each id lies in exactly one piece; a document shorter than the window stays whole. A sequence of a power of two tokens is not padded, any other is padded to the window.
    Sequences never mix pieces of different groups; a group has about group_rows pieces, however many rows repeat an id or a text. Rows that repeat an id are packed as documents of their own. Pieces of equal length go in order of id, null ones last, start, checksum and a number that is written with them, so a task that is run again gives the same rows. An empty table gives an empty result. Other columns are not read.
    """
    pieces = written(chosen(docs, id_col, text_col).mapInArrow(tidy(_cut(tokenizer_path, end_id, window)), NUMBERED), "pieces")
    n_groups = max(1, -(-pieces.count() // group_rows))
    group = F.pmod(F.xxhash64("number"), F.lit(n_groups)).alias("group")
    return pieces.groupBy(group).applyInPandas(_pack_group(window, n_groups), PACKED)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
