"""Connected components as joins, for graphs of any size.

A graph whose edges are counted and fit one task easily is done there, in one
pass. Beyond that, large-star and small-star rounds by turns: each round links a node's
neighbours to the smallest node it sees, so every component becomes a star
after a number of rounds that grows with the logarithm of its longest path.
Each round is written to the shared folder; nothing comes to the driver but
whether an edge has changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fields

#: Edges that one task takes, 16 bytes each.
ONE_TASK = 2_000_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches]
    if parts:
        node, component = least_reached(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these. Edges come as (larger a, smaller b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, one_task: int = ONE_TASK, scratch: Scratch | None = None) -> DataFrame:
    """node, component for every node of an edge: component is the smallest node that edges reach from it.

    Loops and edges with a null are left out; repeated edges count once; no edge gives no row. What is written goes by way of scratch, if that is given.
    """
    written = (scratch or Scratch(edges.sparkSession)).written
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    if now.count() <= one_task:
        return written(now.repartition(1).mapInArrow(_whole, fields(("node", T.LongType()), ("component", T.LongType()))), "components")
    seen = _print(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = written(_small_star(_large_star(now)), "edges")
        last, seen = seen, _print(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
