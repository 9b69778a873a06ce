"""Near-duplicate documents by min-max hashing.

A document's set holds a 56-bit hash of each of its distinct shingles. Under
each of PERMUTATIONS hash functions both the least and the greatest value are
kept, so a signature of 2 * PERMUTATIONS values takes PERMUTATIONS evaluations
a shingle. Either value agrees between two sets with the probability of their
Jaccard similarity; the two of one function are less alike than those of two
functions, so the share of agreeing values has no bias and less variance.

Signatures are banded: ROWS minima, or ROWS maxima, of neighbouring functions
are a key, and documents that share a key are candidates. Two sets of
similarity 0.8 share none of the BANDS keys with probability
(1 - 0.8**ROWS)**BANDS, under 4e-9. A bit of each value goes with a row as a
sketch: sets of that similarity differ in a tenth of these bits, and a pair
that differs in MOST_DIFFER of them, six standard deviations more, is left
out. So is one whose parity bitmaps (is the number of tokens that hash to a bit
odd?) differ in more bits than the sets may in tokens, which is exact and tells
small sets apart best. Every other candidate is verified on the full sets
(links.py).

Exact copies of a set become one class first, of which one row has keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chosen, documents, fields, mix64, tidy
from .links import SET, linked_components, named_by_component, small, with_class
from .ngram_join import _each, _pack, _unpack, _Words, shingle_set

#: Values of a key, and keys of a document: half of minima, half of maxima.
ROWS, BANDS = 6, 64
PERMUTATIONS = ROWS * BANDS // 2
#: 64-bit words of a sketch, a bit for each value, and of a parity bitmap.
WORDS, PARITY = ROWS * BANDS // 64, 6
#: Differing bits of a sketch from which on a pair is left out; (1 - 0.8) / 2 of the bits are expected at similarity 0.8.
MOST_DIFFER = 80
SIGNED = fields(("row", T.LongType()), ("doc_id", T.LongType()), ("n", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("tokens", T.BinaryType()), ("keys", T.ArrayType(T.LongType())), *((f"{c}{i}", T.LongType()) for c, words in (("s", WORDS), ("b", PARITY)) for i in range(words)))
SKETCH = ["n", *(f"s{i}" for i in range(WORDS)), *(f"b{i}" for i in range(PARITY))]


def _functions(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """An offset and an odd factor for each hash function (x ^ offset) * factor."""
    at = mix64(np.arange(2 * PERMUTATIONS, dtype=np.uint64) + np.uint64(seed << 32))
    return at[:PERMUTATIONS], at[PERMUTATIONS:] | np.uint64(1)


def signatures(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of each set under each function: a row for each set. tokens: the sets one after the other, none empty, each from its start."""
    out = np.empty((2 * PERMUTATIONS, len(starts)), np.uint64)
    value = np.empty_like(tokens)
    with np.errstate(over="ignore"):
        for i, (offset, factor) in enumerate(zip(*_functions(), strict=True)):
            np.bitwise_xor(tokens, offset, out=value)
            np.multiply(value, factor, out=value)
            np.minimum.reduceat(value, starts, out=out[i])
            np.maximum.reduceat(value, starts, out=out[PERMUTATIONS + i])
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature's bands."""
    banded = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), banded.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, i])
    return key


def sketches(signature: np.ndarray) -> np.ndarray:
    """A bit of each value, in 64-bit words."""
    bits = (signature >> np.uint64(20) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def parity_bitmaps(mixed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parity bitmap of each set, in 64-bit words. mixed: mixed tokens of the sets one after the other."""
    at = (mixed >> np.uint64(40)) % np.uint64(64 * PARITY)
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * (64 * PARITY) + at.astype(np.int64), minlength=len(sizes) * 64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sizes), -1), axis=1, bitorder="little").view("<i8")


def _signed(width: int):
    """Set size, hash of the set, packed tokens, keys, sketch and parity bitmap of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, sets = [], []
            for doc, text in _each([batch]):
                ids.append(doc)
                sets.append(shingle_set(text.lower().split(), width, cache))
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            hashes, sketch = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), WORDS + PARITY), np.int64)
            keys = np.zeros(0, np.uint64)
            if len(some):
                tokens = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                mixed = mix64(tokens)
                with np.errstate(over="ignore"):
                    hashes[some, 0] = np.add.reduceat(mixed, starts)
                    hashes[some, 1] = np.add.reduceat(mix64(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                signature = signatures(tokens, starts)
                sketch[some] = np.concatenate([sketches(np.ascontiguousarray(signature)), parity_bitmaps(mixed, sizes[some])], 1)
                keys = band_keys(signature).ravel()
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
            arrays = [pa.array(row + np.arange(len(sets))), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(hashes[:, 0].copy().view(np.int64)), pa.array(hashes[:, 1].copy().view(np.int64)), pa.array([_pack(s) or None for s in sets], pa.binary()), listed]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(sketch[:, i].copy()) for i in range(WORDS + PARITY)], names=SIGNED.names)
            row += len(sets)

    return sign


def _unpacked(data: pa.Scalar) -> np.ndarray:
    return _unpack(data.as_py())


def _differing(a: str, b: str, name: str, words: int) -> Column:
    bits = [F.bit_count(F.col(f"{a}{name}{i}").bitwiseXOR(F.col(f"{b}{name}{i}"))) for i in range(words)]
    return sum(bits[1:], bits[0])


def _may_link(percent: int):
    """A condition on two rows: sizes are near enough, parity bitmaps do not rule a link out, and sketches are near enough."""

    def condition(a: str, b: str) -> Column:
        na, nb = F.col(f"{a}n"), F.col(f"{b}n")
        near = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
        return near & (_differing(a, b, "b", PARITY) * (100 + percent) <= (na + nb) * (100 - percent)) & (_differing(a, b, "s", WORDS) < MOST_DIFFER)

    return condition


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Two documents link where 100 * intersection >= percent * union of their sets of shingles of width words; component_id is the smallest doc_id that links reach, the own one included, and kept says that it is the own one. The bands are made for similarities from 0.8: a lower percent is refused.
    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than width is one shingle. A null, empty or blank text has an empty set, links with nothing, and is a component of its own. Rows that repeat an id are documents of their own, so all of them are kept where their id is the smallest. A row without an id takes the smallest id of its component, null if there is none, and is kept in that case alone. An empty table gives an empty result; other columns are not read.
    """
    if percent < 80:
        raise ValueError("the bands find pairs of a similarity of 80 percent or more")
    scratch = Scratch(docs.sparkSession)
    written = scratch.written
    signed = written(chosen(docs, id_col, text_col).mapInArrow(tidy(_signed(width), 256), SIGNED), "signatures")
    n_docs = signed.count()
    meta = signed.select("row", "doc_id", *SET)
    classes = written(meta.filter("n > 0").groupBy(*SET).agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "classes")
    copied = classes.filter("copies > 1").select(*SET, F.col("row").alias("first"), "copies")
    copies = written(with_class(meta.filter("n > 0").select("row", *SET), copied, n_docs, "inner").filter("row <> first").select("row"), "copies")
    firsts = signed.filter("n > 0").select("row", "n", "keys").join(small(copies, copies.count(), 16), "row", "left_anti")
    keys = firsts.select("row", "n", F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min(F.struct("row", "n")).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("key", F.col("first.row").alias("leader"), F.col("first.n").alias("leader_n"))
    shared = written(keys.withColumn("side", F.lit(0)).join(leaders, "key"), "buckets")
    # sets of rows that share a key: the others are never verified
    rows = written(shared.select("row").distinct(), "candidates")
    sets = written(signed.select("row", "tokens", *SKETCH).join(small(rows, rows.count(), 16), "row", "left_semi"), "sets")
    found = linked_components(shared, sets, SKETCH, _may_link(percent), percent, scratch, _unpacked)
    every = named_by_component(meta, classes, found, n_docs).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return scratch.result(every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near")


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
tokens AS (SELECT doc_id, hash(unnest(s)) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""
