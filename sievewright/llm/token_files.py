"""Token ids as binary files with Elias-Fano boundaries.

A shard is two files. `N.ids` holds the ids of its documents one after the
other, little-endian, two bytes each where the vocabulary allows. `N.idx`
holds where each document ends and which document it is, both as Elias-Fano
sequences: the low bits of each value packed, the high bits in unary, and a
sample of the places of set bits, from which select(i) is found by looking at
a few words. No table of 64-bit offsets is kept.

Files are written by executors straight to the shared folder, under a name of
their own for each attempt. The manifest names those of the attempt that Spark
committed, so a task that is run again neither needs to replace a file nor can
leave half of one behind; an attempt that fails deletes what it wrote.
"""

from __future__ import annotations

import contextlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, documents, fields, file_system, shared_path, tidy, written
from .tokens import tokenizer

MAGIC = b"SWEF"
#: Every so many set bits one place is sampled.
SAMPLE = 256
ENCODED = fields(("shard", T.IntegerType()), ("doc_id", T.LongType()), ("ids", T.BinaryType()))
MANIFEST = fields(("shard", T.IntegerType()), ("path", T.StringType()), ("n_docs", T.LongType()), ("n_ids", T.LongType()))
INDEX = fields(("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))


@dataclass
class EliasFano:
    """A sequence of non-negative integers that never falls."""

    n: int
    low_bits: int
    low: np.ndarray  # packed bits
    high: np.ndarray  # 64-bit words
    samples: np.ndarray  # places of set bits 0, SAMPLE, 2 * SAMPLE, ...

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(-(-(((top >> low_bits) + n + 1)) // 64) * 64, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view("<u8"), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i, from the sample before it and the words from there on."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word_at = place // 64
        word = int(self.high[word_at]) >> (place % 64) << (place % 64)
        while (ones := word.bit_count()) <= left:
            left -= ones
            word_at += 1
            word = int(self.high[word_at])
        for _ in range(left):
            word &= word - 1
        high = word_at * 64 + (word & -word).bit_length() - 1 - i
        return high << self.low_bits | self._low_of(i)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.int64)
        at = index[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at // 8] >> (at % 8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def _low_of(self, i: int) -> int:
        first = i * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All of them."""
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return (places - np.arange(self.n)) << self.low_bits | self._low(np.arange(self.n))

    def to_bytes(self) -> bytes:
        return struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, f: io.BufferedIOBase) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack("<qqqqq", f.read(40))
        return cls(n, low_bits, np.frombuffer(f.read(a), np.uint8), np.frombuffer(f.read(8 * b), "<u8"), np.frombuffer(f.read(4 * c), "<u4"))


class ShardWriter:
    """Writes the two files of a shard; documents come in order of id."""

    def __init__(self, folder: str, shard: int, width: int):
        self._fs, where = file_system(folder)
        self._fs.create_dir(where, recursive=True)
        name, self.width = f"{shard:08d}-{uuid.uuid4().hex}", width
        self.path, self._part = f"{folder}/{name}", f"{where}/{name}"
        self._ids = self._fs.open_output_stream(f"{self._part}.ids")
        self._docs: list[int] = []
        self._ends: list[int] = []
        self._nulls, self._n = 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._ids.write(ids)
        self._n += len(ids) // self.width
        self._ends.append(self._n)
        if doc_id is None:
            self._nulls += 1
        else:
            self._docs.append(doc_id)

    def close(self) -> tuple[int, int]:
        self._ids.close()
        first = self._docs[0] if self._docs else 0
        with self._fs.open_output_stream(f"{self._part}.idx") as f:
            f.write(MAGIC + struct.pack("<iqq", self.width, self._nulls, first))
            f.write(EliasFano.of(np.array(self._ends, np.int64)).to_bytes())
            f.write(EliasFano.of(np.array(self._docs, np.int64) - first).to_bytes())
        return len(self._ends), self._n

    def discard(self) -> None:
        """Deletes what this attempt has written."""
        with contextlib.suppress(OSError):
            self._ids.close()
        for kind in ("ids", "idx"):
            with contextlib.suppress(OSError):
                self._fs.delete_file(f"{self._part}.{kind}")


class Shard:
    """A shard's files: doc_ids, ends and the ids of a document."""

    def __init__(self, path: str):
        self._fs, self._path = file_system(path)
        with self._fs.open_input_stream(f"{self._path}.idx") as f:
            head = f.read(24)
            if head[:4] != MAGIC:
                raise ValueError(f"{path}.idx is not an index of token ids")
            self.width, self._nulls, self._first = struct.unpack("<iqq", head[4:])
            self.ends, self._docs = EliasFano.read(f), EliasFano.read(f)

    @property
    def n_docs(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        """Id of document i, by select."""
        return None if i < self._nulls else self._docs.select(i - self._nulls) + self._first

    def doc_ids(self) -> list[int | None]:
        return [self.doc_id(i) for i in range(self.n_docs)]

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i starts and ends, by select."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        with self._fs.open_input_file(f"{self._path}.ids") as f:
            f.seek(a * self.width)
            return np.frombuffer(f.read((b - a) * self.width), f"<u{self.width}").astype("<u4")

    def each(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document in order: id, start, ids. Where each ends is found by select."""
        at = 0
        with self._fs.open_input_stream(f"{self._path}.ids") as f:
            for i in range(self.n_docs):
                end = self.ends.select(i)
                yield self.doc_id(i), at, np.frombuffer(f.read((end - at) * self.width), f"<u{self.width}").astype("<u4")
                at = end


def _encode(path: str, end_id: int, width: int, cuts: list[int]):
    edges = np.array(cuts, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = tokenizer(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            docs = batch.column("doc_id")
            shard = np.where(np.asarray(pc.is_null(docs)), 0, np.searchsorted(edges, np.asarray(pc.fill_null(docs, 0)), side="right"))
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            out = [np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for x in ids_of.ids(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), docs, pa.array(out, pa.binary())], names=ENCODED.names)
        ids_of.forget()

    return encode


def _write(folder: str, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writers: list[ShardWriter] = []
        done: list[tuple[int, str, int, int]] = []
        shard = None
        try:
            for batch in batches:
                for s, doc, ids in zip(*(batch.column(c).to_pylist() for c in ENCODED.names), strict=True):
                    if s != shard:
                        if writers:
                            done.append((shard, writers[-1].path, *writers[-1].close()))
                        writers.append(ShardWriter(folder, s, width))
                        shard = s
                    writers[-1].add(doc, ids)
            if writers:
                done.append((shard, writers[-1].path, *writers[-1].close()))
        except BaseException:
            for writer in writers:
                writer.discard()
            raise
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=MANIFEST.names)

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: int = 49408, docs_per_shard: int = 4096, max_shards: int = 65_536) -> DataFrame:
    """Writes the ids of all texts, with end_id behind each, into folder in ascending order of id; gives the manifest: shard, path, n_docs, n_ids.

    Shards follow one another by id; their bounds are quantiles of the ids. There are at most max_shards, whatever the rows: a shard is written as its rows stream by, so its size is no matter of memory. A null text counts as empty, so it has the end id alone. Rows without an id come first. Rows that repeat an id lie next to one another, ordered by their token ids. An empty table gives an empty manifest and no files. Other columns are not read.
    """
    rows = chosen(docs, id_col, text_col)
    n_shards = min(max_shards, max(1, -(-docs.count() // docs_per_shard)))
    quantiles = rows.agg(F.percentile_approx("doc_id", [i / n_shards for i in range(1, n_shards)], 20 * n_shards)).first()[0] if n_shards > 1 else []
    width = 2 if vocabulary <= 1 << 16 else 4
    encoded = rows.mapInArrow(tidy(_encode(tokenizer_path, end_id, width, sorted(set(quantiles or [])))), ENCODED)
    dealt = encoded.repartitionById(n_shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return written(dealt.mapInArrow(tidy(_write(folder, width)), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            rows = [(doc, base + start, len(ids), zlib.crc32(ids)) for doc, start, ids in Shard(path).each()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)], names=INDEX.names)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. The manifest has a row for each shard, so its running sum is small."""
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    n = (manifest.agg(F.max("shard")).first()[0] or 0) + 1
    return based.repartitionById(n, "shard").select("path", "base").mapInArrow(tidy(_read), INDEX)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "token-files")
    return read_token_files(write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json")))
