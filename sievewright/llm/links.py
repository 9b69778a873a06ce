"""From keys that rows share to the components of rows that link.

Rows meet where they share a key. Each first tries one leader; verified links
make components; rows of keys that hold several components try a few more
leaders, for as long as that links; then all pairs of a key that are still in
different components and that a bound does not rule out are verified. So every
link between different components is found, and none inside one is looked for.

Rows of a large key are mostly texts with a long passage in common that do not
link. Instead of all their pairs, tokens are counted among the rows of all large
keys. What two sets share of the tokens that many of these rows hold is no more
than the smaller of their numbers of such tokens; where a link takes more, the
two share a token that few hold, and the first of those they share is in the
prefix of both (the rarest tokens, as many as there are less what must be shared,
and one more). So each such token is a key, of few rows. Where a link may take no
more, two sets have nearly all in common if their frequent tokens are the same,
and leaders have linked them before; these alone still meet in the large key,
and only with rows of a size that may link.

A row's sketch is looked up once, not for each of its keys and rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fields, mix64, tidy
from .components import components

#: Where open buckets hold more pairs an entry than the first, rows try more leaders before all pairs are verified: each those of so many buckets, for so many rounds at most.
PAIRS_AN_ENTRY, TRIES, STAR_ROUNDS = 1, 16, 8

#: Rows of a large key at least, and of a frequent token among the rows of large keys; ratio of the bounds of a class of sizes, in percent.
LARGE, MANY, SIZE_RATIO = 64, 128, 110
#: Frequent tokens at most; where there would be more, more rows are needed for one.
MOST_FREQUENT = 1_000_000
ENTRY = fields(("key", T.LongType()), ("row", T.LongType()), ("side", T.IntegerType()))

#: A set by its hash.
SET = ["h1", "h2", "n"]
#: Whether the rows of two column prefixes can link at all.
MayLink = Callable[[str, str], Column]


def raw(data: pa.Scalar) -> np.ndarray:
    """Sorted tokens that are stored in eight bytes each."""
    return np.frombuffer(data.as_buffer(), "<u8")


def _linked(percent: int, unpack: Callable[[pa.Scalar], np.ndarray]):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb"))
            ta, tb = (batch.column(c) for c in ("ta", "tb"))
            out = []
            for i in range(batch.num_rows):
                x, y = unpack(ta[i]), unpack(tb[i])
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                if 100 * same >= percent * (na[i] + nb[i] - same):
                    out.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return verify


def verified(pairs: DataFrame, sets: DataFrame, percent: int, unpack: Callable[[pa.Scalar], np.ndarray] = raw) -> DataFrame:
    """The pairs (a, b) whose sets link. pairs are distinct."""
    left = sets.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(tidy(_linked(percent, unpack)), fields(("a", T.LongType()), ("b", T.LongType())))


def small(df: DataFrame, n_rows: int, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """df, broadcast where its rows prove it small."""
    return F.broadcast(df) if n_rows * row_bytes <= most else df


def similar_sizes(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _meet(a: str, b: str) -> Column:
    """Whether rows of these sides of a key meet."""
    return (F.col(a) == 0) | (F.col(a) != F.col(b))


def with_class(meta: DataFrame, classes: DataFrame, n_rows: int, how: str) -> DataFrame:
    """meta joined with columns of classes by set. Classes of a thousandth of all rows or more are at most a thousand: they are broadcast, so that no task gets all rows of one."""
    large = F.col("copies") * 1000 >= n_rows
    hot = meta.join(F.broadcast(classes.filter(large)), SET, "left")
    rest = hot.filter("copies IS NULL").select(*meta.columns).join(classes.filter(~large), SET, how)
    return hot.filter("copies IS NOT NULL").unionByName(rest.select(*hot.columns))


def _open(entries: DataFrame, found: DataFrame) -> DataFrame:
    """entries (key, row, side, ...) of buckets that hold more than one component, with the component of each."""
    now = entries.drop("component").join(small(found.withColumnRenamed("node", "row"), found.count(), 24), "row", "left").withColumn("component", F.coalesce("component", "row"))
    open_keys = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    return now.join(open_keys, "key")


def _sketched(entries: DataFrame, sketches: DataFrame, n_sketches: int) -> DataFrame:
    """entries (key, row, side, component) with the sketch of their row, looked up once for all keys of a row."""
    of_row = entries.groupBy("row", "component").agg(F.collect_list(F.struct("key", "side")).alias("keys"))
    known = of_row.join(small(sketches, n_sketches, 8 + 8 * len(sketches.columns)), "row")
    return known.withColumn("k", F.explode("keys")).select("k.key", "row", "k.side", "component", *[c for c in sketches.columns if c != "row"])


def _as(rows: DataFrame, prefix: str, sketch: Sequence[str]) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{prefix}{c}") for c in ("row", "side", "component", *sketch)])


def _across(x: DataFrame, y: DataFrame, sketch: Sequence[str], may_link: MayLink) -> DataFrame:
    """Rows of a key that are in different components and may link."""
    return _as(x, "x_", sketch).join(_as(y, "y_", sketch), "key").filter((F.col("x_component") != F.col("y_component")) & _meet("x_side", "y_side") & may_link("x_", "y_"))


def _more_stars(rest: DataFrame, turn: int, sketch: Sequence[str], may_link: MayLink) -> DataFrame:
    """Pairs (a, b) of rows of open buckets with leaders of another component: a bucket's leaders are two rows of different components that hash lowest in this turn, and a row tries those of TRIES of its buckets."""
    hashed = rest.withColumn("h", F.xxhash64("row", "key", F.lit(turn)))
    best = hashed.groupBy("key", "component").agg(F.min(F.struct("h", "row", "side", *sketch)).alias("r"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("r"))
    leaders = best.withColumn("k", rank).filter("k <= 2").select("key", "component", "r.row", "r.side", *[f"r.{c}" for c in sketch])
    mine = hashed.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("h", "key"))).filter(F.col("k") <= TRIES)
    met = _across(mine, leaders, sketch, may_link)
    return met.select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b")).distinct()


@lru_cache(maxsize=8)
def size_edges(top: int) -> np.ndarray:
    """Smallest sizes of the classes of sizes: each over the one before by a tenth (SIZE_RATIO), by one at least. top is a power of two; the last is beyond it."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, edges[-1] * SIZE_RATIO // 100))
    return np.array(edges, np.int64)


def least_overlap(a: int, b: int, percent: int) -> int:
    """Tokens that similar sets of a and b tokens share at least."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_entries(n: int, frequent: int, shared: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides and weakness of a set of n tokens: frequent of them are frequent, shared are those that few rows hold, but not this one alone, the rarest first. For each class of sizes of a partner, a key for each token of the prefix; and one more, a weak one, of the class itself, where a link may need none of them."""
    edges = size_edges(1 << max(10, (2 * n).bit_length()))
    own = int(np.searchsorted(edges, n, side="right")) - 1
    least, most = -(-n * percent // 100), n * 100 // percent
    alone = n - frequent - len(shared)
    keys, sides, weak = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
    for other in range(int(np.searchsorted(edges, least, side="right")) - 1, int(np.searchsorted(edges, most, side="right"))):
        a, b = sorted((own, other))
        tag, side = (a << 20 | b) << 8, 0 if own == other else 1 if own == a else 2
        needed = least_overlap(n, max(int(edges[other]), least), percent) - frequent
        first = max(0, n - frequent - max(needed, 1) + 1 - alone)
        found = mix64(mix64(shared[:first]) ^ np.uint64(tag))
        if needed <= 0:
            found = np.append(found, mix64(np.array([~tag & (1 << 64) - 1], np.uint64)))
        keys.append(found)
        sides.append(np.full(len(found), side, np.int32))
        weak.append(np.arange(len(found)) >= len(found) - (needed <= 0))
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(weak)


def _entries(percent: int):
    """The keys of rows but for weak ones."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = batch.column("row").to_pylist(), []
            for n, frequent, shared in zip(*(batch.column(c).to_pylist() for c in ("n", "frequent", "shared")), strict=True):
                found, side, weak = prefix_entries(n, frequent, np.array(shared, np.int64).view(np.uint64), percent)
                made.append((found[~weak], side[~weak]))
            keys, sides = (np.concatenate(x) for x in zip(*made, strict=True)) if made else ([], [])
            owner = np.repeat(np.array(rows, np.int64), [len(k) for k, _ in made])
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys, np.uint64).view(np.int64)), pa.array(owner), pa.array(np.asarray(sides, np.int32))], names=ENTRY.names)

    return index


def _counted(unpack: Callable[[pa.Scalar], np.ndarray]):
    """Tokens of a few thousand rows, with the number that holds each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rows = np.unique(np.concatenate([np.zeros(0, np.uint64), *[unpack(t).astype(np.uint64) for t in batch.column("tokens")]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(rows.astype(np.int64))], names=["token", "rows"])

    return count


def _parted(unpack: Callable[[pa.Scalar], np.ndarray], frequent):
    """The number of frequent tokens of each row, and its others."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            others, n = [], []
            for data in batch.column("tokens"):
                tokens = unpack(data).astype(np.uint64).view(np.int64)
                at = np.searchsorted(often, tokens)
                is_often = often[np.minimum(at, len(often) - 1)] == tokens if len(often) else np.zeros(len(tokens), bool)
                n.append(int(is_often.sum()))
                others.append(tokens[~is_often].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(n, pa.int64()), pa.array(others, pa.list_(pa.int64()))], names=["row", "n", "frequent", "others"])

    return part


def _both_sides(entries: DataFrame) -> DataFrame:
    """Entries (key, side, ...) of keys under which two rows can meet."""
    sides = entries.groupBy("key").agg(F.min("side").alias("_s"), F.max("side").alias("_t"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND (_t = 0 OR _s < _t)").select("key")
    return entries.join(sides, "key", "left_semi")


def _weak_entries(held: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Entries of held whose rows may link without a token that few hold, with size and frequent, under keys of their key and size: a row meets those of its own bin of sizes (side 0), and of the one below (side 1). Bins are a little wider than sizes of a link may differ, so such sizes are never two bins apart."""
    n, width = F.col("n"), math.log(100 / percent) + 1e-4
    least = F.ceil(n * percent / 100)
    weak = profile.filter(percent * (n + least) <= (100 + percent) * F.col("frequent")).select("row", n.alias("size"), "frequent", F.floor(F.log(n) / width).alias("bin"))
    bins = F.explode(F.array(*[F.struct((F.col("bin") - below).alias("bin"), F.lit(below).alias("side")) for below in (0, 1)]))
    binned = held.drop("side").join(weak, "row").withColumn("at", bins)
    return _both_sides(binned.withColumns({"key": F.xxhash64("key", "at.bin"), "side": F.col("at.side")}).drop("bin", "at"))


def split_large(rest: DataFrame, large: DataFrame, found: DataFrame, sets: DataFrame, sketch: Sequence[str], may_link: MayLink, percent: int, scratch: Scratch, unpack: Callable[[pa.Scalar], np.ndarray]) -> DataFrame:
    """Pairs (x_row, y_row) of different components that share a large key and may link, and some that share none: by rare tokens, and what is left by the large keys."""
    held = scratch.written(rest.join(large, "key", "left_semi"), "large")
    rows = held.select("row").distinct()
    own = scratch.written(sets.select("row", "n", "tokens").join(rows, "row", "left_semi"), "large-sets")
    counts = own.select("tokens").mapInArrow(tidy(_counted(unpack), 4096), fields(("token", T.LongType()), ("rows", T.LongType()))).groupBy("token").agg(F.sum("rows").alias("rows"))
    counts = scratch.written(counts.filter("rows > 1"), "tokens")
    # at most MOST_FREQUENT tokens are held by a so-manyth part of all: 8 bytes each to the driver and back
    held_tokens = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    many = max(MANY, -(-held_tokens // MOST_FREQUENT))
    frequent = held.sparkSession.sparkContext.broadcast(np.sort(counts.filter(F.col("rows") >= many).select("token").toArrow().column("token").to_numpy()))
    parted = own.mapInArrow(tidy(_parted(unpack, frequent), 256), fields(("row", T.LongType()), ("n", T.LongType()), ("frequent", T.LongType()), ("others", T.ArrayType(T.LongType()))))
    few = parted.select("row", F.explode("others").alias("token")).join(counts.filter(F.col("rows") < many), "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rows", "token"))).alias("few"))
    none = F.array().cast("array<bigint>")
    profile = scratch.written(parted.drop("others").join(few, "row", "left").select("row", "n", "frequent", F.coalesce(F.transform("few", lambda x: x["token"]), none).alias("shared")), "profile")
    entries = scratch.written(profile.mapInArrow(tidy(_entries(percent), 256), ENTRY), "entries")
    by_token = _sketched(_open(_both_sides(entries), found), sets.select("row", *sketch), sets.count())
    by_key = _weak_entries(held, profile, percent)

    def both_weak(a: str, b: str) -> Column:
        """Whether a link of the two needs no more than their frequent tokens; where it needs one that few hold, they share an entry by token."""
        needed = percent * (F.col(f"{a}size") + F.col(f"{b}size"))
        return (needed <= (100 + percent) * F.least(f"{a}frequent", f"{b}frequent")) & may_link(a, b)

    left = _across(by_key, by_key, [*sketch, "size", "frequent"], both_weak).select("x_row", "y_row")
    return _across(by_token, by_token, sketch, may_link).select("x_row", "y_row").unionByName(left)


def linked_components(shared: DataFrame, sets: DataFrame, sketch: Sequence[str], may_link: MayLink, percent: int, scratch: Scratch, unpack: Callable[[pa.Scalar], np.ndarray] = raw) -> DataFrame:
    """node, component (its smallest row) of all rows that link with another.

    shared: written rows (key, row, n, side, leader, leader_n) of keys with several rows; sides 1 and 2 of a key meet each other and side 0 alone. sets: row, n, tokens and the columns of sketch, which may_link reads. Links are 100 * intersection >= percent * union.
    """
    written = scratch.written
    first = shared.filter((F.col("row") != F.col("leader")) & (F.col("side") != 1)).filter(similar_sizes("n", "leader_n", percent)).groupBy("row").agg(F.min("leader").alias("a")).select("a", F.col("row").alias("b"))
    tried = written(first, "pairs")
    links = written(verified(tried, sets, percent, unpack), "links")
    found = components(links, scratch=scratch)
    sketches = sets.select("row", *sketch)
    n_sketches = sets.count()
    rest = written(_sketched(_open(shared.select("key", "row", "side"), found), sketches, n_sketches), "open")
    for turn in range(STAR_ROUNDS):
        cells = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        left = cells.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0)).alias("pairs"), F.coalesce(F.sum("s"), F.lit(0)).alias("entries")).first()
        if left["pairs"] <= PAIRS_AN_ENTRY * left["entries"]:
            break
        pairs = written(_more_stars(rest, turn, sketch, may_link).join(tried, ["a", "b"], "left_anti"), "pairs")
        got = written(verified(pairs, sets, percent, unpack), "links")
        tried, links = tried.unionByName(pairs), links.unionByName(got)
        n_got, n_pairs = got.count(), pairs.count()
        if n_got:
            found = components(links, scratch=scratch)
            rest = written(_open(rest, found), "open")
        if 10 * n_got < n_pairs or 100 * n_got < left["entries"]:
            break

    # all pairs that share a bucket and are in different components still
    large = written(rest.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= LARGE).select("key"), "large-keys")
    n_large = large.count()
    few = rest.join(small(large, n_large, 16), "key", "left_anti") if n_large else rest
    met = _across(few, few, sketch, may_link).select("x_row", "y_row")
    if n_large:
        met = met.unionByName(split_large(rest, small(large, n_large, 16), found, sets, sketch, may_link, percent, scratch, unpack))
    pairs = met.filter("x_row < y_row").select(F.col("x_row").alias("a"), F.col("y_row").alias("b")).distinct()
    pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(pairs, sets, percent, unpack), "links")
    return found if more.isEmpty() else components(links.unionByName(more), scratch=scratch)


def named_by_component(meta: DataFrame, classes: DataFrame, found: DataFrame, n_docs: int) -> DataFrame:
    """doc_id, n, component_id of all rows of meta (doc_id and the columns of SET): found tells of the first row of a class of equal sets (SET, row, least_id, copies) which rows it links with; component_id is the smallest doc_id of a component, null for an empty set."""
    of_class = classes.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("docs")).filter("docs > 1").drop("docs")
    named = of_class.join(least, "component").select(*SET, "component_id", "copies")
    some, none = meta.filter("n > 0").select("doc_id", *SET), meta.filter("n = 0")
    return with_class(some, named, n_docs, "left").select("doc_id", "n", "component_id").unionByName(none.select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
