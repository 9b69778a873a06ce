"""Checks as data: each is a row (check_order, check, result, failures)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """Rows of a frame that violate a rule; failures is an aggregate over the frame, a long."""

    name: str
    frame: DataFrame
    failures: Column
    warn_only: bool = False


def run_checks(checks: Sequence[Check]) -> DataFrame:
    """One row for each check. Checks over the same frame share one aggregation."""
    frames: list[DataFrame] = []
    for c in checks:
        if not any(c.frame is f for f in frames):
            frames.append(c.frame)
    parts = []
    for f in frames:
        own = [(i, c) for i, c in enumerate(checks) if c.frame is f]
        row = f.agg(*[F.coalesce(c.failures.cast("long"), F.lit(0)).alias(f"c{i}") for i, c in own])
        made = F.array(*[F.struct(F.lit(i).alias("check_order"), F.lit(c.name).alias("check"), F.lit("WARN" if c.warn_only else "FAIL").alias("bad"), F.col(f"c{i}").alias("failures")) for i, c in own])
        parts.append(row.select(F.explode(made).alias("r")).select("r.*"))
    every = reduce(DataFrame.unionByName, parts)
    return every.select("check_order", "check", F.when(F.col("failures") == 0, "PASS").otherwise(F.col("bad")).alias("result"), "failures")


def require(checks: Sequence[Check]) -> None:
    """Raises where a check fails."""
    bad = run_checks(checks).filter("result = 'FAIL'").orderBy("check_order").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['failures']}" for r in bad))


def where(condition: Column) -> Column:
    """Number of rows that a condition holds for."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def repeats(column: str) -> Column:
    """Rows beyond the first of each value."""
    return F.count(column) - F.count_distinct(column)


def not_one_value(column: str) -> Column:
    return F.when(F.count_distinct(column) == 1, 0).otherwise(1)


def differs(value: Column, expected: int) -> Column:
    return F.abs(value - F.lit(expected))


def reconcile(computed: DataFrame, published: DataFrame, keys: Sequence[str], exact: Sequence[str], close: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """key..., metric, computed, published of every value that differs: counts at all, others beyond the tolerance; a row on one side only differs too."""
    metrics = [*exact, *close]
    a = computed.select(*keys, *[F.col(m).cast("double").alias(f"_a_{m}") for m in metrics], F.lit(1).alias("_a"))
    b = published.select(*keys, *[F.col(m).cast("double").alias(f"_b_{m}") for m in metrics], F.lit(1).alias("_b"))
    rows = a.join(b, list(keys), "full")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_a_{m}").alias("computed"), F.col(f"_b_{m}").alias("published"), F.lit(0.0 if m in exact else tolerance).alias("allowed")) for m in metrics]))
    wide = rows.select(*keys, each.alias("m")).select(*keys, "m.*")
    return wide.filter(F.coalesce(F.abs(F.col("computed") - F.col("published")) > F.col("allowed"), ~F.col("computed").eqNullSafe(F.col("published")))).drop("allowed")
