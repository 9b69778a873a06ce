"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact verification.

The CGK random walk maps strings of small edit distance to strings of small
Hamming distance: it copies the character under a cursor and moves the cursor
on or not, by a random bit for the step and the character. Two walks are made
over windows of each text, and samples of their coordinates are the keys of an
LSH table of the benchmark. Every character of an item whose walk ends inside
the item starts a window, and every third character of a text, whatever the
words are; so an item has as many windows as it is long, and one stretch of it
that keeps its sampled coordinates is enough to find it. Items of at most 96
characters have few windows. For them the grams that edits must leave are
counted by their shift between item and text, which is exact.

A pair found is verified in two steps. An item is cut into pieces of at most a
word of bits; if it is held, some piece is within its share of the edits, and
the edit distances of all pieces of a batch are followed at once, bit-parallel.
What is left gets the exact edit distance of the whole item.

The benchmark is the stated query set. Its index is built by the executors in
blocks of a bounded number of items; every text is read once and compared with
one block after the other, of which a worker holds one at a time.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, documents, fields, file_system, shared_path, table, tidy

#: Characters of a window, roughly; a walk takes two steps for each. A text has a window at each STRIDE characters.
SIZE, STRIDE = 20, 3
#: Samples of coordinates, half of them from each of two walks, and the coordinates in each.
REPEATS, SAMPLED = 4, 14
#: Items of at most as many characters are looked for without LSH; characters of a piece at most.
SHORT, WORD = 96, 64
#: Bits of a key that the table of possible keys leaves out.
KEY_SHIFT = 12
#: Windows walked at a time, so that their arrays stay in the processor's cache; pieces followed at a time, and the characters of a stretch of text for it.
WALKED, FOLLOWED, STRETCH = 8192, 2048, 512
#: Characters in a row that are counted, of short and of long items, to rule pairs out, and the bits of their hash. Cells that are counted in a table at most; more are sorted.
TRIGRAM, GRAM, GRAM_BITS, CELLS = 3, 4, 14, 1 << 23
LEAKS = fields(("doc_id", T.LongType()), ("item_id", T.LongType()), ("distance", T.LongType()), ("item_chars", T.LongType()), ("start", T.LongType()))


def normalised(text: str | None) -> list[str]:
    return (text or "").lower().split()


def codes(text: str) -> np.ndarray:
    """A byte for each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((c * np.uint64(2654435761) >> np.uint64(7)) & np.uint64(0xFF)).astype(np.uint8)


@lru_cache(maxsize=1)
def walks() -> tuple[np.ndarray, np.ndarray, list[list[list[tuple[int, np.uint32]]]]]:
    """Bits of the two walks by step and character; for each walk and step, up to the last that is sampled, the samples (repeat, factor) that take it."""
    rng = np.random.default_rng(20240229)
    bits = rng.integers(0, 2, (2, 2 * SIZE, 256), dtype=np.uint8)
    takes: list[list[list[tuple[int, np.uint32]]]] = [[[] for _ in range(2 * SIZE)] for _ in range(2)]
    for r in range(REPEATS):
        for j in np.sort(rng.choice(2 * SIZE, SAMPLED, replace=False)):
            takes[r % 2][j].append((r, np.uint32(int(rng.integers(1, 1 << 63)) & 0xFFFFFFFF | 1)))
    return bits, rng.integers(1, 1 << 63, REPEATS, dtype=np.int64).astype(np.uint32), [t[: 1 + max(j for j, x in enumerate(t) if x)] for t in takes]


def signatures(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LSH keys of windows, [repeat, window], and the last character that each repeat's walk has read. text ends with 2 * SIZE zeros."""
    bits, salts, takes = walks()
    keys = np.repeat(salts[:, None], len(starts), axis=1)
    read = np.empty((REPEATS, len(starts)), np.int64)
    for w in range(2):
        at = starts.copy()
        for j, taken in enumerate(takes[w]):
            c = text.take(at)
            if taken:
                wide = c.astype(np.uint32) + np.uint32(1)
                for r, factor in taken:
                    keys[r] += wide * factor
            if j + 1 == len(takes[w]):
                read[w::2] = at
            at += bits[w, j].take(c)
    return keys, read


def grams(c: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of size characters in a row."""
    h = np.zeros(max(0, len(c) - size + 1), np.uint32)
    for k in range(size):
        h = h * np.uint32(2654435761) + c[k : k + len(h)] + np.uint32(1)
    return (h * np.uint32(2246822519)) >> np.uint32(32 - GRAM_BITS)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, none of them negative. Sorting is faster here than a table of hashes."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


def edit_distance_within(item: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of item from any part of text, and where that part ends; None if it is over most. Bit-parallel, exact."""
    if not item:
        return None
    at = text.find(item)
    if at >= 0:
        return 0, at + len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best = full, 0, len(item), ((len(item), 0) if len(item) <= most else None)  # no character of text at all
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp, hm = (minus | ~(d0 | plus)) & full, plus & d0
        score += bool(hp & last) - bool(hm & last)
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = (hm | ~(d0 | hp)) & full, hp & d0
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Kept:
    """Grams of one size of short items, by hash."""

    def __init__(self, size: int):
        self.size = size
        self.items: list[int] = []
        self._rows = [np.zeros((3, 0), np.int64)]
        self._facts: list[tuple[int, int, int]] = []

    def add(self, item: int, hashes: np.ndarray, least: int, most: int, length: int) -> None:
        self._rows.append(np.stack([hashes.astype(np.int64), np.full(len(hashes), len(self.items)), self.size * np.arange(len(hashes))]))
        self.items.append(item)
        self._facts.append((least, most, length))

    def done(self) -> None:
        row = np.concatenate(self._rows, axis=1)
        row = row[:, np.argsort(row[0], kind="stable")]
        self.holder, self.offset = row[1], row[2]
        self.n = np.bincount(row[0], minlength=1 << GRAM_BITS)
        self.first = np.cumsum(self.n) - self.n
        self.least, most, self.length = np.array(self._facts, np.int64).reshape(-1, 3).T
        self.cell = int(most.max(initial=1))  # the shifts of a copy lie in two cells in a row

    def places(self, joined: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, and the part of the text where enough of its grams stand at like shifts."""
        hashed = grams(joined, self.size)
        n = self.n[hashed]
        at = np.flatnonzero(n)
        n = n[at]
        d = np.repeat(np.searchsorted(offsets, at, "right") - 1, n)
        row = np.repeat(self.first[hashed[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, offset = self.holder[row], self.offset[row]
        shift = np.repeat(at, n) - offsets[d] - offset + SHORT  # where the item would start, and never negative
        cells = (lengths + SHORT) // self.cell + 2
        base = np.cumsum(cells) - cells
        key = (base[d] + shift // self.cell) * len(self.items) + item
        total = int(cells.sum()) * len(self.items)
        if total <= CELLS:  # most cells hold too few, even if all grams counted
            count = np.bincount(key, minlength=total + len(self.items))
            enough = (count[: -len(self.items)] + count[len(self.items) :]).reshape(-1, len(self.items)) >= self.least
            enough[1:] |= enough[:-1].copy()
            key, offset = (x[enough.ravel()[key]] for x in (key, offset))
        # each gram counts once in its cell and the one before, and once in its cell and the one behind
        seen = _distinct(key * SHORT + offset)
        seen = _distinct(np.concatenate([seen, seen + len(self.items) * SHORT])) // SHORT
        first = np.flatnonzero(np.diff(seen, prepend=-1))
        key = seen[first]
        hit = key[np.diff(np.append(first, len(seen))) >= self.least[key % len(self.items)]]
        k, cell = hit % len(self.items), hit // len(self.items)
        d = np.searchsorted(base, cell, "right") - 1
        begin = (cell - base[d] - 1) * self.cell - SHORT - self.cell
        runs: list[list[int]] = []
        by = np.lexsort((begin, d, k))
        for e, doc, a, length in zip(k[by].tolist(), d[by].tolist(), begin[by].tolist(), self.length[k[by]].tolist(), strict=True):
            b = a + 4 * self.cell + length
            if runs and runs[-1][:2] == [doc, e] and a <= runs[-1][3]:
                runs[-1][3] = b
            else:
                runs.append([doc, e, a, b])
        for doc, e, a, b in runs:
            yield doc, self.items[e], max(0, a), min(b, int(lengths[doc]))


class Index:
    """The LSH table of a block of benchmark items, and the grams of its short ones."""

    def __init__(self, items: list[tuple[int, str | None]], max_ratio: float):
        self.items = {i: " ".join(normalised(t)) for i, t in items}
        self.items = {i: t for i, t in self.items.items() if t}
        self.most = {i: int(max_ratio * len(t)) for i, t in self.items.items()}
        self.order = list(self.items)
        self._cut()
        self._count_short()
        self._hash_long()

    def _cut(self) -> None:
        """Pieces of all items; for each piece and code of a character the places where it stands."""
        self.pieces: list[tuple[int, int]] = []  # first and one past the last piece of an item
        codes_of, self.allowed = [], []
        for i in self.order:
            c = codes(self.items[i])
            n = -(-len(c) // WORD)
            self.pieces.append((len(codes_of), len(codes_of) + n))
            codes_of += np.array_split(c, n)
            self.allowed += [self.most[i] // n] * n
        self.lengths = np.array([len(c) for c in codes_of], np.int64)
        self.masks = np.zeros((len(codes_of), 256), np.uint64)
        for k, c in enumerate(codes_of):
            np.bitwise_or.at(self.masks[k], c, np.uint64(1) << np.arange(len(c), dtype=np.uint64))

    def _count_short(self) -> None:
        """Short items by the trigrams that lie end to end in them. An edit breaks one of these at most, so a copy keeps all but as many; and the shifts of those it keeps, from their place in the item to that in the text, differ by no more than the edits. An item of which edits may break all is looked for everywhere, one that allows no edit by itself."""
        self.whole, self.everywhere = [], []
        self.kept = Kept(TRIGRAM)
        for e, i in enumerate(self.order):
            t, most = self.items[i], self.most[i]
            n = len(t) // TRIGRAM
            if len(t) > SHORT:
                continue
            if not most:
                self.whole.append(e)
            elif n <= most:
                self.everywhere.append(e)
            else:
                self.kept.add(e, grams(codes(t), TRIGRAM)[::TRIGRAM][:n], n - most, most, len(t))
        self.kept.done()

    def _hash_long(self) -> None:
        self.long = [e for e, i in enumerate(self.order) if len(self.items[i]) > SHORT]
        self.grams = np.zeros((len(self.long), 1 << GRAM_BITS), bool)
        found: list[list[np.ndarray]] = [[] for _ in range(REPEATS)]
        pad = np.zeros(2 * SIZE, np.uint8)
        for k, e in enumerate(self.long):
            text = codes(self.items[self.order[e]])
            self.grams[k, grams(text)] = True
            keys, read = signatures(np.concatenate([text, pad]), np.arange(len(text), dtype=np.int64))
            for r in range(REPEATS):
                inside = np.flatnonzero(read[r] < len(text))
                key, first = np.unique(keys[r, inside], return_index=True)
                last = len(inside) - 1 - np.unique(keys[r, inside[::-1]], return_index=True)[1]
                found[r].append(np.stack([key.astype(np.int64), np.full(len(key), k), inside[first], inside[last]]))
        self.keys: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.maybe = np.zeros((REPEATS, 1 << 20), bool)
        for r in range(REPEATS if self.long else 0):
            rows = np.concatenate(found[r], axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            self.keys.append(rows[0].astype(np.uint32))
            self.rows.append(rows[1:].astype(np.int32))  # item, and the first and last place in it with this key
            self.maybe[r, rows[0] >> KEY_SHIFT] = True

    def candidates(self, joined: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Document, long item, and the least and greatest character where the item would start: columns of one row for each pair of equal keys, in that order."""
        starts = np.concatenate([np.arange(a, a + n, STRIDE) for a, n in zip(offsets.tolist(), lengths.tolist(), strict=True)])
        out = [np.zeros((4, 0), np.int64)]
        for at in range(0, len(starts), WALKED):
            here = starts[at : at + WALKED]
            keys, _ = signatures(joined, here)
            for r in range(REPEATS):
                rows = np.flatnonzero(self.maybe[r, keys[r] >> KEY_SHIFT])
                k = keys[r, rows]
                a, b = np.searchsorted(self.keys[r], k, "left"), np.searchsorted(self.keys[r], k, "right")
                n = b - a
                row = np.repeat(here[rows], n)
                item, first, last = self.rows[r][:, np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                d = np.searchsorted(offsets, row, "right") - 1
                out.append(np.stack([d, item, row - offsets[d] - last, row - offsets[d] - first]))
        found = np.concatenate(out, axis=1)
        return found[:, np.lexsort(found[::-1])]

    def _may_hold(self, k: int, part: np.ndarray) -> bool:
        """Whether some stretch of a part, as long as a copy may be, has as many of the long item's grams as edits leave. An edit takes GRAM of them at most, so no copy is ruled out."""
        i = self.order[self.long[k]]
        least = len(self.items[i]) - GRAM + 1 - GRAM * self.most[i]
        if least <= 0:
            return True
        total = np.cumsum(self.grams[k, part])
        width = len(self.items[i]) + self.most[i]
        return len(total) > 0 and int(total.max() if len(total) <= width else max(total[width - 1], (total[width:] - total[:-width]).max())) >= least

    def _long_places(self, joined: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, and the part of the text around a place where the LSH finds it."""
        runs: list[list[int]] = []
        for d, k, low, high in self.candidates(joined, offsets, lengths).T.tolist():  # near ones share a stretch of text
            if runs and runs[-1][:2] == [d, k] and low <= runs[-1][3] + self.most[self.order[self.long[k]]]:
                runs[-1][3] = max(runs[-1][3], high)
            else:
                runs.append([d, k, low, high])
        hashed = grams(joined)
        for d, k, low, high in runs:
            e = self.long[k]
            item, most = self.items[self.order[e]], self.most[self.order[e]]
            a, b = max(0, low - 2 * most - 1), min(int(lengths[d]), high + len(item) + 2 * most + 1)
            if self._may_hold(k, hashed[offsets[d] + a : max(offsets[d] + a, offsets[d] + b - GRAM + 1)]):
                yield d, e, a, b

    def _short_places(self, joined: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The same of short items."""
        for e in self.everywhere:
            yield from ((d, e, 0, n) for d, n in enumerate(lengths.tolist()))
        if self.kept.items:
            yield from self.kept.places(joined, offsets, lengths)

    def _follow(self, joined: np.ndarray, piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least edit distance of each piece from a part of joined[start:end], or less where characters share a code."""
        out = np.empty(len(piece), np.int64)
        order = np.argsort(start - end, kind="stable")
        one = np.uint64(1)
        for at in range(0, len(order), FOLLOWED):
            here = order[at : at + FOLLOWED]
            p, s, n = piece[here], start[here], (end - start)[here]
            length = self.lengths[p]
            last = (length - 1).astype(np.uint64)
            full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - last)
            plus, minus, score = full.copy(), np.zeros(len(p), np.uint64), length.copy()
            best = score.copy()
            active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")
            for j, m in enumerate(active.tolist()):
                if m < len(plus):
                    plus, minus, score, last, full, p, s = plus[:m], minus[:m], score[:m], last[:m], full[:m], p[:m], s[:m]
                eq = self.masks[p, joined[s + j]]
                d0 = (((eq & plus) + plus) ^ plus) | eq | minus
                hp, hm = minus | ~(d0 | plus), plus & d0
                score = score + ((hp >> last) & one).astype(np.int64) - ((hm >> last) & one).astype(np.int64)
                hp, hm = hp << one, hm << one
                plus, minus = (hm | ~(d0 | hp)) & full, hp & d0 & full
                np.minimum(best[:m], score, out=best[:m])
            out[here] = best
        return out

    def leaks(self, docs: list[list[str]]) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (distance, character where the part ends), for all pairs found and verified."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        texts = [" ".join(words) for words in docs]
        for e in self.whole:
            item = self.items[self.order[e]]
            found.update(((d, self.order[e]), (0, t.find(item) + len(item))) for d, t in enumerate(texts) if item in t)
        pad = np.zeros(2 * SIZE, np.uint8)
        hashed = [codes(t) for t in texts]
        lengths = np.fromiter(map(len, hashed), np.int64, len(hashed))
        if not lengths.sum():
            return found
        joined = np.concatenate([x for c in hashed for x in (c, pad)])
        offsets = np.cumsum(lengths + len(pad)) - lengths - len(pad)
        places = [*self._short_places(joined, offsets, lengths), *(self._long_places(joined, offsets, lengths) if self.long else ())]
        if not places:
            return found
        d, e, a, b = np.array(places, np.int64).T
        cuts = np.array(self.pieces, np.int64)

        def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each row n times, and which of its times it is."""
            row = np.repeat(np.arange(len(n)), n)
            return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

        row, k = spread(-(-(b - a) // STRETCH))  # a part is followed in stretches, with what a piece may take before each
        a, b, d, e = a[row] + k * STRETCH, np.minimum(b[row], a[row] + (k + 1) * STRETCH), d[row], e[row]
        row, k = spread(cuts[e, 1] - cuts[e, 0])
        piece = cuts[e[row], 0] + k
        before = np.maximum(a[row] - 2 * WORD, 0)
        near = self._follow(joined, piece, offsets[d[row]] + before, offsets[d[row]] + b[row]) <= np.array(self.allowed)[piece]
        around: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        for k in np.unique(row[near]).tolist():
            doc, at = int(d[k]), int(e[k])
            reach = len(self.items[self.order[at]]) + self.most[self.order[at]]
            begin, end = max(0, int(a[k]) - 2 * WORD - reach), int(b[k]) + reach
            runs = around[doc, at]
            if runs and begin <= runs[-1][1] and runs[-1][0] <= begin:
                runs[-1][1] = max(end, runs[-1][1])
            else:
                runs.append([begin, end])
        for doc, at, begin, end in ((*key, *run) for key, runs in around.items() for run in runs):
            i = self.order[at]
            got = edit_distance_within(self.items[i], texts[doc][begin:end], self.most[i])
            if got and ((doc, i) not in found or (got[0], got[1] + begin) < found[doc, i]):
                found[doc, i] = (got[0], got[1] + begin)
        return found


#: Characters of items in a block, whose index takes about 45 bytes for each; rows and bytes of text that are searched at once, but for a longer text by itself.
BLOCK_CHARS, PIECE_ROWS, PIECE_BYTES = 1_000_000, 400, 4 << 20


def pieces(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of few rows and bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), dtype=np.int64)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > PIECE_BYTES or i - start == PIECE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(start)


class Blocks:
    """The index of a benchmark: one block that travels with the task, or several in a folder that all workers reach, read one at a time. A block is bounded in items and in characters, but for an item that is longer by itself."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, max_ratio: float, block_items: int):
        items = chosen(benchmark, id_col, text_col).filter("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
        n_items, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        self.n = max(1, -(-n_items // block_items), -(-chars // BLOCK_CHARS))
        self._one = self._path = None
        if self.n == 1:
            self._one = spark.sparkContext.broadcast(Index([(r["doc_id"], r["text"]) for r in items.orderBy("doc_id").collect()], max_ratio))
            return

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id")
            return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps(Index(list(zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True)), max_ratio))]})

        self._path = shared_path(spark, "benchmark")
        block = F.pmod(F.xxhash64("doc_id"), F.lit(self.n)).alias("block")
        items.groupBy(block).applyInPandas(build, "block long, data binary").write.partitionBy("block").parquet(self._path)

    def __iter__(self) -> Iterator[Index]:
        if self._one is not None:
            yield self._one.value
            return
        store, where = file_system(self._path)
        for k in range(self.n):
            if store.get_file_info(f"{where}/block={k}").type.name != "NotFound":
                for data in ds.dataset(f"{where}/block={k}", filesystem=store, format="parquet").to_table(columns=["data"]).column("data").to_pylist():
                    yield pickle.loads(data)

    def rows(self) -> int:
        """Rows of a batch: more where each needs every block again."""
        return 400 if self.n == 1 else 4000


def _texts(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, list[list[str]]]]:
    """The place and the normalised words of each piece of a batch."""
    at = 0
    for piece in pieces(batch, text_col):
        yield at, [normalised(t) for t in piece.column(text_col).to_pylist()]
        at += piece.num_rows


def _find(blocks: Blocks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d + at], i, dist, len(index.items[i]), max(0, end - len(index.items[i]))) for index in blocks for at, texts in _texts(batch, "text") for (d, i), (dist, end) in index.leaks(texts).items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], names=LEAKS.names)

    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_ratio: float = 0.2, block_items: int = 2_000) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, distance, item_chars, start.

    Texts are compared in lower case with white space turned into single spaces. An item is held where some part of the document is within max_ratio of the item's characters in edits (0.2: a similarity of 0.8); distance is the least found, start is about where that part begins, in characters of the normalised text.
    Null and empty texts and items hold nothing and are held by nothing. Documents that repeat an id are searched one by one, each with rows of its own; of items that repeat an id the text that sorts first counts, an item without an id is void. An empty table on either side gives an empty result. Other columns are not read.
    """
    blocks = Blocks(docs.sparkSession, benchmark, item_id_col, item_text_col, max_ratio, block_items)
    return chosen(docs, id_col, text_col).mapInArrow(tidy(_find(blocks), blocks.rows()), LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_ratio: float = 0.2, block_items: int = 2_000) -> DataFrame:
    """Rows of docs that hold no benchmark item, all columns as they were. Rows stream through: nothing shuffles."""
    blocks = Blocks(docs.sparkSession, benchmark, item_id_col, item_text_col, max_ratio, block_items)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = {d + at for index in blocks for at, texts in _texts(batch, text_col) for d, _ in index.leaks(texts)}
            yield batch.filter(pa.array([d not in holds for d in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(tidy(keep, blocks.rows()), docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
