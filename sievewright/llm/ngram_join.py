"""N-gram Jaccard join by token-combination prefixes.

A document's set holds a 56-bit hash of each of its distinct 5-word shingles.
Tokens are ordered by frequency class (the power of two of the documents that
hold them), rarest first, then by hash. A class has a combination width: 1
where it is rare, else the least k for which documents drawn at random would
share a k-token combination less than once in the whole corpus, at most
MOST_WIDTH.

The prefix of a set is extended until it is worth one unit more than the
tokens that a similar partner may lack. A token of width 1 is worth a unit. The
tokens of a width k are dealt by hash into groups, and a group is worth its
tokens in the prefix less k - 1. A partner that lacks as many tokens as it may
still leaves k of them in some group (pigeonhole), and those are in its own
prefix where it ends later; so of two similar sets the one whose prefix ends
first shares with the other a rare token or a combination of k tokens of a
group. Keys are the rare tokens and all k-combinations inside groups.

How many tokens a partner may lack depends on its size. Sizes are in narrow
classes; combinations are made for each class that a partner can have and meet
only that class. A set without tokens enough for a prefix of that worth has all
its combinations as keys, and its first tokens singly: two such sets share one
of those.

A token of one document alone can join nothing, so it never gets further than
the count; a set with fewer shared tokens than any link needs is done there.

Exact copies of a set become one class first. Within a bucket each set is
first verified against one leader; verified links make components; rows of
buckets with several components try a few more leaders, for as long as that
links; then all pairs of a bucket that are still in different components are
verified, but for those that a lower bound of their difference rules out (the
bits in which parity bitmaps of the sets differ). So every link between
different components is found, while a group of thousands of near copies costs
a few verifications a member.

What moves: packed postings of 7 bytes a token once, and rows of the few
documents that may link. Of a token that many documents of a chunk hold, only
its count in the chunk moves; so a token of a third of all documents is a row a
chunk to the task that counts it. Every step is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chosen, documents, fields, give_back, mix64, tidy
from .links import SET, least_overlap, linked_components, named_by_component, size_edges, small, with_class

BITS = 56
#: Documents of a chunk at most, so that a place in it takes two bytes.
CHUNK_DOCS = 4096
#: Tokens of a chunk, but for a last document.
CHUNK_TOKENS = 1 << 20
#: A token of as many documents is frequent.
FREQUENT = 32
#: 64-bit words of a set's parity bitmap.
WORDS = 4
#: Documents of a chunk from which on a token's places stay with the chunk.
HELD_AT_HOME = 8
#: Tokens of a combination at most.
MOST_WIDTH = 4
#: Rows of postings: a chunk's documents; tokens with their places; tokens with counts, of which the places stay; those places.
HEAD, PLACED, COUNTED, AT_HOME = range(4)
#: Classes of frequency: powers of two of the documents that hold a token.
POSTINGS = fields(("part", T.IntegerType()), ("chunk", T.LongType()), ("kind", T.IntegerType()), ("docs", T.BinaryType()), ("tokens", T.BinaryType()), ("extra", T.BinaryType()))
PROFILE = fields(("row", T.LongType()), ("doc_id", T.LongType()), ("n", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("tokens", T.BinaryType()), ("classes", T.BinaryType()), ("alone", T.LongType()), *((f"b{i}", T.LongType()) for i in range(WORDS)))
KEYS = fields(("key", T.LongType()), ("row", T.LongType()), ("n", T.LongType()), ("side", T.IntegerType()))


class _Words(dict):
    """Hash of a word, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(words: list[bytes], width: int, cache: _Words) -> np.ndarray:
    """Sorted distinct token hashes of a list of words: runs of `width` words, or the whole sequence as one if it is shorter; empty without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    m = len(words) - k + 1
    out = np.full(m, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]) if i == k - 1 else (out + h[i : i + m]) * np.uint64(0xD6E8FEB86659FD93) ^ (out >> np.uint64(29))
    return np.unique(out >> np.uint64(64 - BITS))


def prefix_length(n: int | np.ndarray, percent: int):
    """Tokens of a prefix: n - ceil(percent / 100 * n) + 1."""
    return n - -(-n * percent // 100) + 1


def _pack(sorted_tokens: np.ndarray) -> bytes:
    """Sorted tokens of a range as differences of five bytes, or as they are in eight, with the width in front."""
    if not len(sorted_tokens):
        return b""
    gaps = np.diff(sorted_tokens)
    if len(gaps) and int(gaps.max()) >> 40:
        return b"\x08" + sorted_tokens.astype("<u8").tobytes()
    return b"\x05" + sorted_tokens[:1].astype("<u8").tobytes() + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    if data[0] == 8:
        return np.frombuffer(data, "<u8", offset=1).astype(np.uint64)
    first = np.frombuffer(data, "<u8", 1, 1)
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 5)
    wide = np.zeros((len(rest), 8), np.uint8)
    wide[:, :5] = rest
    return np.cumsum(np.concatenate([first, wide.view("<u8").ravel()]), dtype=np.uint64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """Id and text of each row."""
    for batch in batches:
        yield from zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist(), strict=True)


def _postings(n_parts: int, width: int):
    """Rows of a chunk: its documents, the tokens that fall into each part with the documents' places or, where many hold them, with their number, and the places of these."""
    bounds = (np.arange(1, n_parts, dtype=object) * (1 << BITS) // n_parts).astype(np.uint64)

    def flush(chunk: int, ids: list, sets: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(s) for s in sets], np.int64)
        both = np.zeros((len(sets), 2), np.uint64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(sets):
                mixed = mix64(s)
                both[i] = mixed.sum(dtype=np.uint64), mix64(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        no_id = np.array([x is None for x in ids], np.uint8)
        known = np.array([0 if x is None else x for x in ids], np.int64)
        yield chunk % n_parts, chunk, HEAD, known.tobytes() + sizes.tobytes(), both.tobytes(), no_id.tobytes()
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order], np.repeat(np.arange(len(sets), dtype="<u2"), sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        holders = np.diff(np.append(first, len(tokens)))
        many = holders >= HELD_AT_HOME
        stays = np.repeat(many, holders)
        if many.any():
            yield chunk % n_parts, chunk, AT_HOME, place[stays].tobytes(), _pack(tokens[stays]), None
        for kind, t, p in ((PLACED, tokens[~stays], place[~stays]), (COUNTED, tokens[first[many]], holders[many].astype("<u2"))):
            cuts = np.searchsorted(t, bounds)
            for part, (some, with_them) in enumerate(zip(np.split(t, cuts), np.split(p, cuts), strict=True)):
                if len(some):
                    yield part, chunk, kind, with_them.tobytes(), _pack(some), None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=POSTINGS.names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        chunk = TaskContext.get().partitionId() << 28
        ids: list = []
        sets: list[np.ndarray] = []
        held = 0
        for doc, text in _each(batches):
            ids.append(doc)
            sets.append(shingle_set(text.lower().split(), width, cache))
            held += len(sets[-1])
            if len(ids) == CHUNK_DOCS or held >= CHUNK_TOKENS:
                yield batch_of(list(flush(chunk, ids, sets)))
                chunk, ids, sets, held = chunk + 1, [], [], 0
                give_back()
        if ids:
            yield batch_of(list(flush(chunk, ids, sets)))

    return make


def _count(group: pa.Table) -> pa.Table:
    """A part's tokens with the documents that hold each: those of two or more go back to their chunks, with the class of that number."""
    kind = np.asarray(group.column("kind"))
    waiting = (kind == PLACED) | (kind == COUNTED)
    through, rows = group.filter(pa.array(~waiting)), group.filter(pa.array(waiting))
    chunks, kinds = np.asarray(rows.column("chunk")), np.asarray(rows.column("kind"))
    unpacked = [_unpack(x) for x in rows.column("tokens").to_pylist()]
    out = [through]
    if unpacked:
        lengths = np.array([len(u) for u in unpacked])
        extra = rows.column("docs").to_pylist()
        tokens = np.concatenate(unpacked)
        held = np.concatenate([np.frombuffer(x, "<u2").astype(np.int64) if k == COUNTED else np.ones(n, np.int64) for x, k, n in zip(extra, kinds.tolist(), lengths.tolist(), strict=True)])
        order = np.argsort(tokens, kind="stable")
        run = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        times = np.empty(len(run), np.int64)
        times[order] = np.repeat(np.add.reduceat(held[order], first), np.diff(np.append(first, len(run))))
        at, made = 0, []
        for chunk, k, t, x, n in zip(chunks.tolist(), kinds.tolist(), unpacked, extra, lengths.tolist(), strict=True):
            here = times[at : at + n]
            at += n
            if (many := here > 1).any():
                made.append((chunk, k, np.frombuffer(x, "<u2")[many].tobytes(), _pack(t[many]), np.log2(here[many]).astype(np.uint8).tobytes()))
        if made:
            c, w, d, k, x = zip(*made, strict=True)
            part = group.column("part")[0].as_py()
            out.append(pa.table([pa.array([part] * len(c), pa.int32()), pa.array(c, pa.int64()), pa.array(w, pa.int32()), pa.array(d, pa.binary()), pa.array(k, pa.binary()), pa.array(x, pa.binary())], names=POSTINGS.names))
    give_back()
    return pa.concat_tables([t.cast(pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("tokens", pa.binary()), ("extra", pa.binary())])) for t in out])


def _assemble(percent: int):
    """A chunk's documents again: size, hash of the set, and the shared tokens of those that hold enough of them to link with anything."""

    def assemble(group: pa.Table) -> pa.Table:
        kinds, docs, tokens, extra = (group.column(c).to_pylist() for c in ("kind", "docs", "tokens", "extra"))
        chunk = group.column("chunk")[0].as_py()
        head = kinds.index(HEAD)
        ids, sizes = np.frombuffer(docs[head], "<i8").reshape(2, -1)
        hashes = np.frombuffer(tokens[head], "<i8").reshape(-1, 2)
        no_id = np.frombuffer(extra[head], np.uint8) == 1

        def of(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = [i for i, k in enumerate(kinds) if k == kind]
            return (
                np.concatenate([np.frombuffer(docs[i], "<u2") for i in rows] or [np.zeros(0, "<u2")]),
                np.concatenate([_unpack(tokens[i]) for i in rows] or [np.zeros(0, np.uint64)]),
                np.concatenate([np.frombuffer(extra[i] or b"", np.uint8) for i in rows] or [np.zeros(0, np.uint8)]),
            )

        place, token, rank = of(PLACED)
        stayed, held, _ = of(AT_HOME)
        if len(held):
            _, counted, class_of = of(COUNTED)
            by = np.argsort(counted)
            place, token = np.concatenate([place, stayed]), np.concatenate([token, held])
            rank = np.concatenate([rank, class_of[by][np.searchsorted(counted[by], held)]])
        order = np.lexsort((token, place))
        token, rank = token[order], rank[order]
        counts = np.bincount(place, minlength=len(ids))
        ends = np.cumsum(counts)
        enough = (counts >= -(-sizes * percent // 100)) & (sizes > 0)
        cut = [(token[e - c : e].astype("<u8").tobytes(), rank[e - c : e].tobytes()) if ok else (None, None) for c, e, ok in zip(counts.tolist(), ends.tolist(), enough.tolist(), strict=True)]
        # bit t of a set's bitmap: is the number of its shared tokens that hash to t odd
        at = (mix64(token) >> np.uint64(40)) % np.uint64(64 * WORDS)
        odd = np.zeros(len(ids) * 64 * WORDS, np.uint8)
        np.bitwise_xor.at(odd, place[order].astype(np.int64) * (64 * WORDS) + at.astype(np.int64), 1)
        bitmap = np.packbits(odd, bitorder="little").view("<i8").reshape(-1, WORDS)
        arrays = [pa.array((chunk << 12) + np.arange(len(ids))), pa.array(ids, mask=no_id), pa.array(sizes), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary()), pa.array(sizes - counts)]
        arrays += [pa.array(bitmap[:, i].copy()) for i in range(WORDS)]
        give_back()
        return pa.table(arrays, names=PROFILE.names)

    return assemble


def combination_width(rank: int, frequent: int, n_docs: int) -> int:
    """Tokens of a combination in the class of tokens that 2**rank to 2**(rank + 1) of n_docs documents hold."""
    if rank < int(math.log2(frequent)):
        return 1
    share = min(1.0, 2.0 ** (rank + 1) / max(2, n_docs))
    needed = math.log(max(2, n_docs)) / -math.log(share) if share < 1 else MOST_WIDTH
    return int(min(MOST_WIDTH, max(2, math.ceil(needed))))


@lru_cache(maxsize=8)
def worth(width: int) -> float:
    """What a group of width - 0.5 tokens on average is worth."""
    mean = width - 0.5
    return sum(math.exp(-mean) * mean**p / math.factorial(p) * (p - width + 1) for p in range(width, 40))


@lru_cache(maxsize=4096)
def _choices(n: int, width: int) -> np.ndarray:
    return np.array(list(combinations(range(n), width)), np.int64).reshape(-1, width)


def _combinations(tokens: np.ndarray, group: np.ndarray, width: int, tag: int) -> np.ndarray:
    """A key for each combination of width tokens of a group. Groups of as many tokens are done together."""
    by = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[by], prepend=-1))
    lengths = np.diff(np.append(first, len(by)))
    mixed = mix64(tokens[by] ^ np.uint64(tag))
    out = [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for p in np.unique(lengths[lengths >= width]).tolist():
            member = mixed[first[lengths == p][:, None] + np.arange(p)]
            out.append(mix64(member[:, _choices(p, width)].sum(2, dtype=np.uint64) + np.uint64(width)).ravel())
    return np.concatenate(out)


def index_entries(n: int, tokens: np.ndarray, ranks: np.ndarray, percent: int, frequent: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set of n tokens, of which `tokens` are held by several documents, `ranks` being the power of two of their number; and the side of each: 0 meets all with the key, 1 (of the smaller class of sizes) meets 2 alone."""
    order = np.lexsort((tokens, ranks))
    tokens, ranks = tokens[order], ranks[order]
    alone = n - len(tokens)
    rare = int(np.searchsorted(ranks, int(math.log2(frequent))))
    often, kinds = tokens[rare:], ranks[rare:]
    wide = np.array([combination_width(r, frequent, n_docs) for r in range(64)], np.int64)[kinds]
    edges = size_edges(1 << max(10, (2 * n).bit_length()))
    own = int(np.searchsorted(edges, n, side="right")) - 1
    least, most = -(-n * percent // 100), n * 100 // percent
    single, keys, sides = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    low = int(np.searchsorted(edges, least, side="right")) - 1
    for other in range(low, int(np.searchsorted(edges, most, side="right"))):
        smallest = max(int(edges[other]), least)
        needed = n - least_overlap(n, smallest, percent) + 1 - alone
        if needed <= 0 or not len(tokens):
            continue
        single = max(single, min(needed, rare))
        left = needed - rare
        if left <= 0 or not len(often):
            continue
        a, b = sorted((own, other))
        tag = (a << 20 | b) << 8
        large, small = int(edges[b]), int(edges[a])
        units = max(1, large - least_overlap(large, max(small, -(-large * percent // 100)), percent) + 1)
        group, value = np.empty(len(often), np.int64), np.zeros(len(often), np.int64)
        for k in np.unique(wide).tolist():
            at = np.flatnonzero(wide == k)
            n_groups = max(1, round(units / worth(k)))
            g = (mix64(often[at] ^ np.uint64((tag | k) << 8 | 1)) % np.uint64(n_groups)).astype(np.int64)
            by = np.argsort(g, kind="stable")
            first = np.flatnonzero(np.diff(g[by], prepend=-1))
            place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
            value[at[by]] = place >= k - 1
            group[at] = g
        gained = np.cumsum(value)
        end = int(np.searchsorted(gained, left)) + 1  # tokens of the prefix
        here = [_combinations(often[:end][wide[:end] == k], group[:end][wide[:end] == k], k, tag) for k in np.unique(wide[:end]).tolist()]
        if gained[-1] < left:  # no prefix is worth it: all is index, and the first tokens by themselves
            here.append(mix64(often[:left] ^ np.uint64(tag | 0xFF)))
        found = np.unique(np.concatenate(here))
        keys.append(found)
        sides.append(np.full(len(found), 0 if own == other else 1 if own == a else 2, np.int32))
    keys.append(mix64(tokens[:single]))
    sides.append(np.zeros(single, np.int32))
    return np.concatenate(keys), np.concatenate(sides)


def index_keys(n: int, tokens: np.ndarray, ranks: np.ndarray, percent: int, frequent: int, n_docs: int = 1 << 10) -> np.ndarray:
    """The keys alone."""
    return index_entries(n, tokens, ranks, percent, frequent, n_docs)[0]


def _index(percent: int, frequent: int, n_docs: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sides, rows, sizes = [], [], [], []
            for row, n, t, c in zip(*(batch.column(x).to_pylist() for x in ("row", "n", "tokens", "classes")), strict=True):
                k, side = index_entries(n, np.frombuffer(t, "<u8").astype(np.uint64), np.frombuffer(c, np.uint8), percent, frequent, n_docs)
                keys.append(k)
                sides.append(side)
                rows.append(np.full(len(k), row))
                sizes.append(np.full(len(k), n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sides))], names=KEYS.names)

    return index


def _may_link(a: str, b: str, percent: int):
    """A condition that every pair that links meets: sizes are near enough, and so are the sets by a lower bound of their difference, the bits in which their bitmaps differ and the tokens that each holds alone. a, b: prefixes of the columns n, alone and b0, b1, ..."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    differ = F.col(f"{a}alone") + F.col(f"{b}alone")
    for i in range(WORDS):
        differ = differ + F.bit_count(F.col(f"{a}b{i}").bitwiseXOR(F.col(f"{b}b{i}")))
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def profiles(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, part_tokens: int = 1 << 19) -> DataFrame:
    """A row for each document: row (unique), doc_id, n (set size), h1 and h2 (hash of the set); for those that may link also the tokens that other documents hold, with their classes of frequency."""
    rows = chosen(docs, id_col, text_col)
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, math.ceil(n_bytes / 6 / part_tokens))
    postings = rows.mapInArrow(tidy(_postings(n_parts, width), 128), POSTINGS)
    counted = postings.groupBy("part").applyInArrow(_count, POSTINGS)
    return counted.groupBy("chunk").applyInArrow(_assemble(percent), PROFILE)


#: What _may_link needs of a row.
SKETCH = ["n", "alone", *(f"b{i}" for i in range(WORDS))]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Two documents link where 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id that links reach, the own one included.
    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than width is one shingle. A null, empty or blank text has an empty set, links with nothing, and is a component of its own. Rows that repeat an id are documents of their own. A row without an id takes the smallest id of its component, null if there is none. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    written = scratch.written
    all_docs = written(profiles(docs, id_col, text_col, percent, width), "profiles")
    n_docs = all_docs.count()
    meta = all_docs.select("row", "doc_id", *SET)
    some = meta.filter("n > 0")
    classes = written(some.groupBy(*SET).agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "classes")
    # copies of a class but its first row stay out of the index
    eligible = all_docs.filter("tokens IS NOT NULL")
    copied = classes.filter("copies > 1").select(*SET, F.col("row").alias("first"), "copies")
    copies = written(with_class(eligible.select("row", *SET), copied, n_docs, "inner").filter("row <> first").select("row"), "copies")
    sets = eligible.join(small(copies, copies.count(), 16), "row", "left_anti")
    keys = sets.select("row", "n", "tokens", "classes").mapInArrow(tidy(_index(percent, frequent, n_docs)), KEYS)
    first = F.min(F.when(F.col("side") < 2, F.struct("row", "n")))
    leaders = keys.groupBy("key").agg(first.alias("first"), F.min("side").alias("s"), F.max("side").alias("t"), F.count(F.lit(1)).alias("members")).filter("members > 1 AND (t = 0 OR s < t)")
    shared = written(keys.join(leaders.select("key", F.col("first.row").alias("leader"), F.col("first.n").alias("leader_n")), "key"), "buckets")

    found = linked_components(shared, eligible, SKETCH, lambda a, b: _may_link(a, b, percent), percent, scratch)
    every = named_by_component(meta, classes, found, n_docs)
    return scratch.result(every.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "joined")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
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
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""
