"""Deduplication: by identity, exact groups, near copies within a Hamming radius."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import hamming


def first_by(rows: DataFrame, key: Sequence[str | Column], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def duplicate_groups(rows: DataFrame, key: str, *extra: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), *extra).filter("copies > 1")


def with_keeper(rows: DataFrame, key: str, ident: str, order: Column) -> DataFrame:
    """Each row of a duplicate group with the id of the row that stays, the one with the least order."""
    keepers = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min_by(ident, order).alias("keeper")).filter("copies > 1")
    return rows.join(keepers, key).withColumn("is_keeper", F.col(ident) == F.col("keeper"))


def admit(rows: DataFrame, key: str, excluded: DataFrame, order: Column) -> DataFrame:
    """Every row with a status as a one-by-one consumer in a unique order would give it: `excluded` where the key is known already, `duplicate` behind the first of its key, else `accepted`."""
    known = excluded.select(key).distinct().withColumn("_known", F.lit(True))
    ordered = rows.withColumn("_order", order)
    firsts = ordered.groupBy(key).agg(F.min("_order").alias("_first"))
    marked = ordered.join(firsts, key).join(known, key, "left")
    return marked.withColumn("status", F.when(F.col("_known"), "excluded").when(F.col("_order") > F.col("_first"), "duplicate").otherwise("accepted")).drop("_known", "_order", "_first")


#: Bits of a key at least, and keys of a hash at most.
LEAST_BITS, MOST_KEYS = 8, 100


def key_masks(radius: int, n_rows: int, width: int = 64) -> list[int]:
    """Masks of the keys under which two hashes within the radius meet, as signed 64-bit numbers.

    Of radius + k bands two such hashes agree in k at least, so each k bands together are a key. k is the least for which keys have as many values as there are rows, so that the candidates of a hash do not grow with the table; a radius that leaves keys of under LEAST_BITS bits is refused.
    """
    for k in range(1, width - radius):
        m = radius + k
        if math.comb(m, k) > MOST_KEYS and k > 1:
            m, k = m - 1, k - 1
            break
        if width // m * k >= max(LEAST_BITS, math.log2(max(2, n_rows))):
            break
    if width // m * k < LEAST_BITS:
        raise ValueError(f"a radius of {radius} leaves bands of {width // m} bits; keys of at least {LEAST_BITS} are needed")
    edges = [(width * i // m, width * (i + 1) // m) for i in range(m)]
    masks = [sum((1 << b) - (1 << a) for a, b in some) for some in combinations(edges, k)]
    return [_signed(x) for x in masks]


#: A key is hot from so many rows on, by a sample of so many.
HOT_ROWS, SAMPLE_ROWS = 2_000, 20_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_masks(ones: Sequence[float], radius: int, n_rows: float) -> list[int]:
    """Masks of further keys for the rows of a hot key, from the share of ones in each of the 64 bits there.

    Any dealing of the bits into radius + k bands will do, as each differing bit falls into one of them; so bits that tell these rows apart, by their entropy, are dealt evenly, those that all rows share go along. k is the one that makes fewest candidates and keys.
    """
    entropy = [0.0 if p <= 0 or p >= 1 else -p * math.log2(p) - (1 - p) * math.log2(1 - p) for p in ones]
    best: tuple[float, list[int]] | None = None
    for k in range(1, 5):
        n_bands = radius + k
        if math.comb(n_bands, k) > MOST_KEYS:
            break
        bands, sums = [0] * n_bands, [0.0] * n_bands
        for bit in sorted(range(64), key=lambda b: -entropy[b]):
            at = sums.index(min(sums))
            bands[at] |= 1 << bit
            sums[at] += entropy[bit]
        keys = list(combinations(range(n_bands), k))
        cost = sum(n_rows + n_rows * n_rows * 2.0 ** -sum(sums[i] for i in some) for some in keys)
        if best is None or cost < best[0]:
            best = cost, [_signed(sum(bands[i] for i in some)) for some in keys]
    return best[1]


def _hot_keys(rows: DataFrame, bits: str, masks: Sequence[int], radius: int, n_rows: int) -> list[tuple[int, int, list[int]]]:
    """(band, value, masks of further keys) of keys with many rows, from a bounded sample of the hashes. One that the sample misses costs time, not results."""
    if n_rows < HOT_ROWS:
        return []
    share = min(1.0, SAMPLE_ROWS / n_rows)
    sample = rows.select(F.col(bits).alias("x"))
    sample = sample.sample(share, seed=1) if share < 1 else sample
    keyed = sample.select("x", F.posexplode(F.array(*[F.col("x").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "value"))
    ones = [F.avg(F.shiftrightunsigned("x", i).bitwiseAND(1)).alias(f"p{i}") for i in range(64)]
    found = keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), *ones).filter(F.col("n") >= max(20, HOT_ROWS * share)).collect()
    return [(r["band"], r["value"], split_masks([r[f"p{i}"] for i in range(64)], radius, r["n"] / share)) for r in found]


def keyed_hashes(rows: DataFrame, columns: Sequence[Column], bits: str, masks: Sequence[int], hot: DataFrame | None) -> DataFrame:
    """columns of each row under each of its keys: band, value, and in hot keys also part and detail, the further key, with the list of their masks."""
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col(bits).bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    plain = rows.select(*columns, F.col(bits).alias("_x"), F.explode(keys).alias("b")).select("*", "b.band", "b.value").drop("b")
    if hot is None:
        return plain.drop("_x")
    split = plain.join(F.broadcast(hot), ["band", "value"], "left")
    further = F.coalesce(F.transform("masks", lambda m: F.col("_x").bitwiseAND(m)), F.array(F.lit(0).cast("long")))
    return split.select("*", F.posexplode(further).alias("part", "detail")).drop("_x")


def hamming_join(left: DataFrame, right: DataFrame, ident: str, bits: str, radius: int, self_join: bool = False, apart: str | None = None) -> DataFrame:
    """left_id, right_id, distance for all pairs within the radius, each once (left_id < right_id in a self-join); apart: a column in which the two must differ, such as the split.

    An equi-join on keys of bands (see key_masks), so no cross join; a pair that agrees in several keys is kept for the first of them, which needs no distinct. The condition is arithmetic on the two hashes, so it stays in generated code. Keys that many rows share, as of flat images, are split by further bits in which those rows differ (see split_masks). Equal hashes should be one class before (see hamming_classes_join): a class is one row here.
    """
    n_rows = left.count() if self_join else max(left.count(), right.count())
    masks = key_masks(radius, n_rows)
    every = left.select(bits) if self_join else left.select(bits).unionByName(right.select(bits))
    found = _hot_keys(every, bits, masks, radius, n_rows)
    hot = left.sparkSession.createDataFrame(found, "band int, value long, masks array<long>") if found else None

    def side(rows: DataFrame, name: str) -> DataFrame:
        columns = [F.col(ident).alias(f"{name}_id"), F.col(bits).alias(f"{name}_bits"), *([F.col(apart).alias(f"{name}_apart")] if apart else [])]
        return keyed_hashes(rows, columns, bits, masks, hot)

    a, b = side(left, "left"), side(right, "right")
    on = ["band", "value", *(["part", "detail"] if hot is not None else [])]
    differ = F.col("left_bits").bitwiseXOR(F.col("right_bits"))
    # the work is in the pairs, not in the bytes: adaptive execution would put small inputs into one task
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(n, *on), (b.drop("masks") if hot is not None else b).repartition(n, *on)
    pairs = a.join(b, on).filter(F.bit_count(differ) <= radius)
    if self_join:
        pairs = pairs.filter("left_id < right_id")
    if apart:
        pairs = pairs.filter("left_apart <> right_apart")
    first = F.when(differ.bitwiseAND(F.lit(masks[0])) == 0, 0)
    for i, m in enumerate(masks[1:], 1):
        first = first.when(differ.bitwiseAND(F.lit(m)) == 0, i)
    pairs = pairs.filter(first == F.col("band"))
    if hot is not None:
        agrees = F.array_position(F.transform("masks", lambda m: differ.bitwiseAND(m) == 0), True)
        pairs = pairs.filter(F.coalesce(agrees - 1 == F.col("part"), F.lit(True)))
    return pairs.select("left_id", "right_id", hamming(F.col("left_bits"), F.col("right_bits")).cast("int").alias("distance"))


def hamming_classes_join(rows: DataFrame, ident: str, bits: str, radius: int, apart: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): each row's class, the least id of its equal hashes (of its own split, with apart), and pairs of classes within the radius. Copies cost no pairs."""
    key = [bits, *([apart] if apart else [])]
    classes = rows.groupBy(*key).agg(F.min(ident).alias("class_id"))
    membership = rows.join(classes, key).select(F.col(ident), "class_id")
    classes = classes.withColumnRenamed("class_id", ident)
    return membership, hamming_join(classes, classes, ident, bits, radius, self_join=True, apart=apart)


def near_duplicate_victims(pairs: DataFrame, priority: DataFrame, ident: str) -> DataFrame:
    """Of each pair the row that goes: the higher priority number, then the larger digest; with the list of its conflicts. priority: ident, priority, digest."""
    p = priority.select(ident, "priority", "digest")
    a = p.select(F.col(ident).alias("left_id"), F.struct("priority", "digest", ident).alias("l"))
    b = p.select(F.col(ident).alias("right_id"), F.struct("priority", "digest", ident).alias("r"))
    judged = pairs.join(a, "left_id").join(b, "right_id").withColumn("left_goes", F.col("l") > F.col("r"))
    victim, other = F.when(F.col("left_goes"), F.col("left_id")).otherwise(F.col("right_id")), F.when(F.col("left_goes"), F.col("right_id")).otherwise(F.col("left_id"))
    return judged.groupBy(victim.alias("victim")).agg(F.count(F.lit(1)).alias("conflicts"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", other.cast("string"), F.col("distance").cast("string")))), ",").alias("conflict_list"))
