"""Joins with the checks that go with them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, on one side only, and the first five of those."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full")
    missing, extra = F.col("_r").isNull(), F.col("_l").isNull()

    def first(side: Column) -> Column:
        return F.count_if(side)

    counts = both.agg(F.count_if(~missing & ~extra).alias("both"), first(missing).alias("missing"), first(extra).alias("extra"))
    least = [both.filter(side).select(F.col(key).cast("string").alias("k")).orderBy("k").limit(5).agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias(name)) for side, name in ((missing, "first_missing"), (extra, "first_extra"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), least, counts).withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))


def overlap_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key the number of distinct values that both tables hold; blanks and nulls do not count. One shuffle for all keys."""

    def values(df: DataFrame, side: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
        return df.select(F.explode(pairs).alias("p")).select("p.key", "p.value", F.lit(side).alias("side")).filter("value IS NOT NULL AND value <> ''")

    held = values(left, 1).unionByName(values(right, 2)).groupBy("key", "value").agg(F.bit_or("side").alias("sides"))
    counts = held.groupBy("key").agg(F.count_if(F.col("sides") == 3).alias("shared"))
    every = left.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return every.join(counts, "key", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def pairwise_overlap(rows: DataFrame, part: str, parts: Sequence[str], key: str) -> DataFrame:
    """For each pair of parts the number of values of key they share, pairs without any included. Each value's set of parts is found first, so a value makes as many rows as it has pairs of parts, whatever its rows."""
    held = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(part)).alias("_in")).filter(F.size("_in") > 1)
    one = held.select("_in", F.explode("_in").alias("left_split"))
    two = one.select("left_split", F.explode("_in").alias("right_split")).filter("left_split < right_split")
    counts = two.groupBy("left_split", "right_split").agg(F.count(F.lit(1)).alias("shared"))
    ordered = sorted(parts)
    every = rows.sparkSession.createDataFrame([(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :]], "left_split string, right_split string")
    return every.join(counts, ["left_split", "right_split"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def delta(first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both versions' values side by side, with second minus first."""
    a = first.select(*keys, *[F.col(v).alias(f"{v}_{names[0]}") for v in values])
    b = second.select(*keys, *[F.col(v).alias(f"{v}_{names[1]}") for v in values])
    return a.join(b, list(keys)).withColumns({f"{v}_delta": F.col(f"{v}_{names[1]}") - F.col(f"{v}_{names[0]}") for v in values})


def expand_views(rows: DataFrame, views: int, key: str) -> DataFrame:
    """Each row with its views 1 to views - 1, and the item number that goes with them; rows carry `position`."""
    return rows.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(views - 1)))).withColumn("item", F.col("position") * (views - 1) + F.col("view") - 1)
