"""Summaries over conditions and versions, headlines, gates, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition_summary(metrics: DataFrame, by: Sequence[str], index: str = "condition_index", name: str = "condition", auroc: str = "auroc", accuracy: str = "balanced_accuracy") -> DataFrame:
    """The clean condition beside mean, worst and name of the worst of the others; these are null where there is only the clean one. Equal worst values: the condition that comes first."""
    clean, robust = F.col(index) == 0, F.col(index) > 0

    def only(c: str, keep: Column) -> Column:
        return F.when(keep, F.col(c))

    worst = F.min_by(F.when(robust, F.col(name)), F.when(robust, F.struct(F.col(auroc), F.col(index))))
    return metrics.groupBy(*by).agg(
        F.max(only(auroc, clean)).alias("clean_auroc"),
        F.max(only(accuracy, clean)).alias("clean_balanced_accuracy"),
        F.avg(only(auroc, robust)).alias("robust_mean_auroc"),
        F.min(only(auroc, robust)).alias("robust_worst_auroc"),
        worst.alias("robust_worst_condition"),
        (F.max(only(auroc, clean)) - F.avg(only(auroc, robust))).alias("delta_auroc"),
        F.avg(only(accuracy, robust)).alias("robust_mean_balanced_accuracy"),
        F.count(F.lit(1)).alias("conditions"),
    )


def headline(rows: DataFrame, name: str, order: str, values: Sequence[str]) -> DataFrame:
    """The best row for each value; of equal ones the first in order. One aggregation, then one row for each metric."""
    best = rows.agg(*[F.max_by(F.struct(F.col(name).alias("best"), F.col(v).cast("double").alias("value")), F.struct(F.col(v), -F.col(order))).alias(v) for v in values])
    return best.select(F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"{v}.best").alias("best"), F.col(f"{v}.value").alias("value")) for v in values])).alias("r")).select("r.*")


def gated_winner(candidates: DataFrame, eligible: Column, *order: Column) -> DataFrame:
    """The first eligible candidate in lexicographic order."""
    return candidates.filter(eligible).orderBy(*order).limit(1)


def accept_if(base: DataFrame, candidate: DataFrame, key: str, gain: str, least_gain: float, guarded: Sequence[str], most_loss: float) -> DataFrame:
    """Per key: gain, worst loss over the guarded values, accepted."""
    both = base.select(key, *[F.col(c).alias(f"_0_{c}") for c in (gain, *guarded)]).join(candidate.select(key, *[F.col(c).alias(f"_1_{c}") for c in (gain, *guarded)]), key)
    loss = F.greatest(*[F.col(f"_0_{c}") - F.col(f"_1_{c}") for c in (*guarded, guarded[0])])
    out = both.select(key, (F.col(f"_1_{gain}") - F.col(f"_0_{gain}")).alias("gain"), loss.alias("worst_loss"))
    return out.withColumn("accepted", (F.col("gain") >= least_gain) & (F.col("worst_loss") <= most_loss))


def long_form(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), list(values), "series", "value")


def wide_form(rows: DataFrame, keys: Sequence[str], column: str, names: Sequence, value: str, prefix: str) -> DataFrame:
    """One column for each name, all given, so there is no pass to find them."""
    pivoted = rows.groupBy(*keys).pivot(column, list(names)).agg(F.first(value))
    return pivoted.select(*keys, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])


def zero_filled(counts: DataFrame, bins: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """bins has every key; those without a count get zero."""
    return bins.join(counts, list(key), "left").withColumn(value, F.coalesce(value, F.lit(0)))
