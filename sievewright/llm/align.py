"""Alignment of two tokenizers' ids over the same bytes.

Each text is cut twice into tokens; the ends of both, as running byte counts,
are merged. Where a token of either side ends, one overlap of an A token with
a B token ends: that is a link, and there is one for each two tokens whose
bytes overlap. Where tokens of both sides end, a group ends.

How many documents hold a pair of ids linked is known only from all of them.
Documents come in chunks: a chunk's row lists its distinct pairs once and for
each document which of them it has, and how often. Only the chunk's pairs
move: Spark counts the documents of each pair, finds the greatest count of
each id of either side, joins both back and brings them to the chunks, which
sum them up for their documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chosen, documents, fields, give_back
from .links import small
from .tokens import _byte_alphabet

#: Bytes of text that are aligned at once, and documents and links of a chunk, but for a last document.
BATCH_BYTES, CHUNK_DOCS, CHUNK_LINKS = 1 << 20, 4096, 1 << 20
#: Signs from which on Unicode's classes differ between versions and libraries.
_LATE = re.compile("[^\x00-\u02ff\u2010-\u2027\u20ac]")
#: Splits a text as byte-level BPE does. A fixed value of the file's format.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK = fields(
    ("chunk", T.LongType()), ("doc_id", T.ArrayType(T.LongType())), ("n_a", T.ArrayType(T.LongType())), ("n_b", T.ArrayType(T.LongType())), ("n_groups", T.ArrayType(T.LongType())), ("n_links", T.ArrayType(T.LongType())), ("groups_sha256", T.ArrayType(T.StringType())),
    ("pairs", T.ArrayType(T.LongType())), ("docs", T.ArrayType(T.LongType())), ("held", T.ArrayType(T.LongType())), ("which", T.BinaryType()), ("times", T.BinaryType()),
)
ALIGNED = fields(
    ("doc_id", T.LongType()),
    ("groups", T.ArrayType(T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))]))),
    ("links", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "start", "end")]))),
)
SUMMED = fields(*((c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", T.StringType()))


class Tokens:
    """Ids of texts by one side's file, and the bytes of each id.

    byte_level: a file of the tokenizers library with byte-level BPE, which gets a space before the text; its merges run in tiktoken where every sign of a text is of a class that no version of Unicode disputes, in the library itself otherwise. pieces: a sentencepiece model, which adds the space.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], of_id: list[bytes], exact: bool = False):
        self.encode, self.of_id = encode, of_id
        self.exact = exact  # the tokens of any text are its bytes after a space
        self.lengths = np.array([len(b) for b in of_id], np.int64)


def byte_level(path: str) -> Tokens:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    byte_of = {shown: b for b, shown in _byte_alphabet().items()}
    of_id = [b""] * library.get_vocab_size()
    special = set(library.get_added_tokens_decoder())
    for token, i in library.get_vocab().items():
        of_id[i] = token.encode() if i in special else bytes(byte_of[c] for c in token)
    ranks = {b: i for i, b in enumerate(of_id) if i not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def one(text: str) -> np.ndarray:
        if _LATE.search(text):
            return np.array(library.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)

    # bytes are merged and never changed, unless a file normalises texts first
    return Tokens(lambda texts: list(map(one, texts)), of_id, exact=library.normalizer is None)


def pieces(path: str) -> Tokens:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of_id = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return Tokens(lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)], of_id)


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = pieces(path) if path.endswith(".model") else byte_level(path)
    return _LOADED[path]


@dataclass
class Merge:
    """Texts one after the other: ids of both sides and, over all of them, what the merge of their ends gives. docs: where each text ends in a, b, groups, links and bytes."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray  # the A token of each link, and the B token
    of_b: np.ndarray
    ends: np.ndarray  # of each link, in bytes from the first text on
    group_a: np.ndarray  # the group of each A token, and of each B token
    group_b: np.ndarray
    docs: np.ndarray  # (texts, 5): ends in a, b, groups, links, bytes


def merged(texts: list[str], side_a: Tokens, side_b: Tokens) -> Merge:
    """Aligns texts. One that is empty, or whose tokens of a side are not a space and its bytes, has no tokens."""
    ids_a, ids_b = side_a.encode(texts), side_b.encode(texts)
    none = np.zeros(0, np.int64)
    for i, text in enumerate(texts):
        whole = b" " + text.encode()
        if not text or any(b"".join(map(side.of_id.__getitem__, ids.tolist())) != whole for side, ids in ((side_a, ids_a[i]), (side_b, ids_b[i])) if not side.exact):
            ids_a[i], ids_b[i] = none, none
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([none, *ids]) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
    # both are rising, so the place of an end among the other side's is one step of two pointers
    at = np.searchsorted(end_b, end_a)
    both_a = end_b[np.minimum(at, len(end_b) - 1)] == end_a if len(end_b) else np.zeros(len(end_a), bool)
    both_b = np.zeros(len(end_b), bool)
    both_b[at[both_a]] = True
    # the union in order: an A end stands after all A ends before it and all B ends that are less and no A end
    place_a = np.arange(len(end_a)) + np.concatenate([[0], np.cumsum(~both_b)])[at]
    ends = np.empty(len(end_a) + int((~both_b).sum()), np.int64)
    ends[place_a] = end_a
    ends_a, ends_b = np.zeros(len(ends), bool), np.ones(len(ends), bool)
    ends_a[place_a] = True
    ends[~ends_a] = end_b[~both_b]
    ends_b[place_a[~both_a]] = False

    def before(marks: np.ndarray) -> np.ndarray:
        return np.cumsum(marks) - marks

    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    last_byte = np.concatenate([[0], end_a])[last_a]
    docs = np.stack([last_a, last_b, np.concatenate([[0], np.cumsum(both_a)])[last_a], np.searchsorted(ends, last_byte, side="right"), last_byte], 1)
    return Merge(a, b, before(ends_a), before(ends_b), ends, before(both_a), before(both_b), docs)


def digit_table(n_a: int, n_b: int) -> np.ndarray:
    """Decimal text of each id and a sign after it, A ids first, filled up with zero bytes: at 2 n where more ids of the side follow, at 2 n + 1 at the end of a group's side."""
    return np.array([f"{i}{sign}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for sign in (",", last)])


def group_texts(m: Merge, table: np.ndarray, n_a: int) -> list[bytes]:
    """a1,a2|b1;a3|b2,b3 of each text. table: of the sides' ids, n_a of A."""
    closes_a = np.append(m.group_a[1:] != m.group_a[:-1], True)[: len(m.a)]
    closes_b = np.append(m.group_b[1:] != m.group_b[:-1], True)[: len(m.b)]
    in_a, in_b = np.bincount(m.group_a), np.bincount(m.group_b)
    said = np.empty(len(m.a) + len(m.b), table.dtype)
    said[np.arange(len(m.a)) + (np.cumsum(in_b) - in_b)[m.group_a]] = table[2 * m.a + closes_a]
    said[np.arange(len(m.b)) + np.cumsum(in_a)[m.group_b]] = table[2 * n_a + 2 * m.b + closes_b]
    cuts = np.concatenate([[0], m.docs[:, 0] + m.docs[:, 1]]).tolist()
    return [said[x:y].tobytes().replace(b"\0", b"")[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, of about BATCH_BYTES."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for doc, text in zip(some.column("doc_id").to_pylist(), pc.fill_null(some.column("text"), "").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _chunks(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = tokens(path_a), tokens(path_b)
        n_a, table = len(side_a.of_id), digit_table(len(side_a.of_id), len(side_b.of_id))
        chunk = TaskContext.get().partitionId() << 28
        held: list[tuple] = []
        n_docs = n_links = 0

        def closed() -> pa.RecordBatch:
            ids, counts, shas, pairs, cells = zip(*held, strict=True)
            known = np.unique(np.concatenate(pairs))
            # cells: document of the batch, place of the pair in the batch, times
            which = np.concatenate([np.searchsorted(known, p)[c[1]] for p, c in zip(pairs, cells, strict=True)])
            per_doc = np.concatenate([np.bincount(c[0], minlength=len(i)) for i, c in zip(ids, cells, strict=True)])
            row = [
                pa.array([chunk], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in ([d for i in ids for d in i], *np.concatenate(counts).T.tolist())), pa.array([[s for x in shas for s in x]], pa.list_(pa.string())),
                *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (known, np.bincount(which, minlength=len(known)), per_doc)), pa.array([which.astype("<u4").tobytes()], pa.binary()), pa.array([np.concatenate([c[2] for c in cells]).astype("<u4").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, names=CHUNK.names)

        try:
            for ids, texts in _batches(batches):
                m = merged(texts, side_a, side_b)
                counts = np.diff(m.docs[:, :4], axis=0, prepend=0)
                shas = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(m, table, n_a)]
                pairs, place = np.unique(m.a[m.of_a] << 32 | m.b[m.of_b], return_inverse=True)
                doc = np.repeat(np.arange(len(ids)), counts[:, 3])
                cells, times = np.unique(doc * max(1, len(pairs)) + place, return_counts=True)
                held.append((ids, counts, shas, pairs, (cells // max(1, len(pairs)), cells % max(1, len(pairs)), times)))
                n_docs, n_links = n_docs + len(ids), n_links + len(m.ends)
                if n_docs >= CHUNK_DOCS or n_links >= CHUNK_LINKS:
                    yield closed()
                    chunk, held, n_docs, n_links = chunk + 1, [], 0, 0
            if held:
                yield closed()
        finally:
            give_back()

    return work


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a chunk, with the sums over their links."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            flat = {c: row.column(c).flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            docs = np.asarray(row.column("pair_docs").flatten(), dtype=np.int64)
            best = np.asarray(row.column("best_a").flatten().cast(pa.int64()))
            which, times = (np.frombuffer(row.column(c)[0].as_buffer(), "<u4").astype(np.int64) for c in ("which", "times"))
            held = np.asarray(row.column("held").flatten())
            ends = np.concatenate([[0], np.cumsum(held)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(times * weight[which])])[ends]) if len(which) else np.zeros(len(held), np.int64) for weight in (best, docs)]
            yield pa.RecordBatch.from_arrays([*(flat[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]), flat["groups_sha256"]], names=SUMMED.names)


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """chunk, pair, a, b, docs: documents of the chunk that hold the pair linked."""
    each = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    return each.withColumns({"a": F.shiftright("pair", 32).cast("int"), "b": F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, a, b, docs (documents that hold it linked), best_a and best_b (whether no other pair of its A id, or of its B id, has more)."""
    counts = pairs.groupBy("pair", "a", "b").agg(F.sum("docs").alias("docs"))
    most_a = counts.groupBy("a").agg(F.max("docs").alias("most_a"))
    most_b = counts.groupBy("b").agg(F.max("docs").alias("most_b"))
    joined = counts.join(most_a, "a").join(most_b, "b")
    return joined.select("pair", "a", "b", "docs", (F.col("docs") == F.col("most_a")).alias("best_a"), (F.col("docs") == F.col("most_b")).alias("best_b"))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links of each row: doc_id, groups (ids of both sides), links (ids of both sides and the bytes they share, counted from the space before the text). A text that is null or empty, or that a side does not give back byte for byte, has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = tokens(path_a), tokens(path_b)
        kinds = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])), pa.list_(pa.struct([(c, pa.int32()) for c in ("a", "b", "start", "end")]))
        for ids, texts in _batches(batches):
            m = merged(texts, side_a, side_b)
            groups, links, at = [], [], np.zeros(5, np.int64)
            for to in m.docs:
                cut_a, cut_b = (np.searchsorted(g[at[k] : to[k]], np.arange(at[2], to[2]), side="right") for k, g in ((0, m.group_a), (1, m.group_b)))
                groups.append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(np.split(m.a[at[0] : to[0]], cut_a)[:-1], np.split(m.b[at[1] : to[1]], cut_b)[:-1], strict=True)])
                ends = m.ends[at[3] : to[3]] - at[4]
                each = (m.a[m.of_a[at[3] : to[3]]], m.b[m.of_b[at[3] : to[3]]], np.concatenate([[0], ends])[:-1], ends)
                links.append([dict(zip(("a", "b", "start", "end"), x, strict=True)) for x in zip(*(y.tolist() for y in each), strict=True)])
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, kinds[0]), pa.array(links, kinds[1])], names=ALIGNED.names)

    return chosen(docs, id_col, text_col).mapInArrow(work, ALIGNED)


def link_sums(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair no other pair of its A id passes in documents), count_sum (documents of the pair, summed over links), groups_sha256 (of the groups written as a1,a2|b1;a3|b2,b3).

    A text that is null or empty, or that a side does not give back byte for byte after a space, has no tokens: zeros and an empty groups_sha256. Rows that repeat an id, or have none, are documents of their own; pairs with equal counts are all best. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.written(chosen(docs, id_col, text_col).mapInArrow(_chunks(path_a, path_b), CHUNK), "chunks")
    pairs = chunk_pairs(chunks)
    counts = scratch.written(pair_counts(pairs).select("pair", "docs", "best_a"), "pair-counts")
    known = pairs.select("chunk", "pair").join(small(counts, counts.count(), 32), "pair")
    back = known.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "docs", "best_a"))).alias("k")).select("chunk", F.col("k.docs").alias("pair_docs"), F.col("k.best_a").alias("best_a"))
    empty = {"pair_docs": F.array().cast("array<bigint>"), "best_a": F.array().cast("array<boolean>")}
    every = chunks.drop("pairs", "docs").join(back, "chunk", "left").withColumns({c: F.coalesce(c, e) for c, e in empty.items()})
    return scratch.result(every.mapInArrow(_finished, SUMMED), "aligned")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_sums(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
