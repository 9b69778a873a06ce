"""Statistics that iterate: calibration fits as Newton steps over sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def auroc_numpy(labels: np.ndarray, scores: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Half credit for ties; weights are whole numbers of copies. nan for one class."""
    w = np.ones(len(labels)) if weights is None else weights.astype(float)
    values, where = np.unique(scores, return_inverse=True)
    pos, neg = np.bincount(where, w * (labels == 1), len(values)), np.bincount(where, w * (labels == 0), len(values))
    below = np.cumsum(neg) - neg
    total = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / total) if total else float("nan")


def fit_platt(logits: np.ndarray, labels: np.ndarray, temperature_only: bool = False, steps: int = 100, least_slope: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept of a logistic fit, by damped Newton steps; the slope stays positive. With temperature_only the intercept is zero."""
    slope, intercept = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * logits + b
        return float(np.mean(np.logaddexp(0, z) - labels * z)) + 1e-9 * (a * a + b * b)

    now = loss(slope, intercept)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * logits + intercept, -500, 500)))
        g = np.array([np.mean((p - labels) * logits) + 2e-9 * slope, np.mean(p - labels) + 2e-9 * intercept])
        w = p * (1 - p)
        h = np.array([[np.mean(w * logits * logits), np.mean(w * logits)], [np.mean(w * logits), np.mean(w)]]) + np.eye(2) * 1e-6
        step = np.array([g[0] / h[0, 0], 0.0]) if temperature_only else np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-8:
            a, b = max(least_slope, slope - size * step[0]), intercept - size * step[1]
            if loss(a, b) < now:
                break
            size /= 2
        else:
            break
        slope, intercept, gain, now = a, b, now - loss(a, b), loss(a, b)
        if gain < 1e-12:
            break
    return slope, intercept


#: Lengths of a Newton step that one pass over the rows tries.
TRIED = (1.0, 0.5, 0.25, 0.125, 1 / 32, 1 / 256)


#: Part of a Newton step under which a fit has settled.
LEAST_STEP = 1e-8


def _ahead(at: tuple[float, float], step: np.ndarray, least_slope: float) -> list[tuple[float, float]]:
    return [(max(least_slope, at[0] - t * float(step[0])), at[1] - t * float(step[1])) for t in TRIED]


def _sums(logit: Column, label: Column, n: Column, a: Column, b: Column, tag: str) -> list[Column]:
    """Sums over rows of a logistic fit's loss, gradient and curvature at slope a and intercept b."""
    z = a * logit + b
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
    w = p * (1 - p)
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - label * z
    terms = {"loss": loss, "ga": (p - label) * logit, "gb": p - label, "haa": w * logit * logit, "hab": w * logit, "hbb": w}
    return [F.sum(n * term).alias(f"{name}{tag}") for name, term in terms.items()]


def fit_views(scored: DataFrame, by: Sequence[str], logit: str = "logit", label: str = "label", temperature_only: bool = False, steps: int = 30, least_slope: float = 1e-4) -> DataFrame:
    """Slope and intercept for each group, for example (teacher, view): by, n, slope, intercept.

    Damped Newton steps as in fit_platt, for all groups at once: rows are counted by group, logit and label first, and each step is one aggregation over those counts. To the driver comes a row of sums for each group; groups that have settled drop out, and one that a score parts without error, which has no best slope, stops after `steps`. Rows without a logit or label are left out.
    """
    keys = list(by)
    types = dict(scored.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    spark = scored.sparkSession
    cells = scored.filter(F.col(logit).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(logit).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        sizes = {tuple(r[:-1]): r[-1] for r in cells.groupBy(*keys).agg(F.sum("_n")).collect()}
        now = dict.fromkeys(sizes, (1.0, 0.0))
        tried = {g: [(1.0, 0.0)] * len(TRIED) for g in sizes}
        known: dict[tuple, float] = {}
        way: dict[tuple, tuple[np.ndarray, float]] = {}  # of each group the step, and the part of it that was tried in vain
        for _ in range(steps + 1):
            if not tried:
                break
            columns = [f"{c}{i}" for i in range(len(TRIED)) for c in "ab"]
            asked = spark.createDataFrame([(*g, *(v for ab in at for v in ab)) for g, at in tried.items()], schema + ", " + ", ".join(f"{c} double" for c in columns))
            sums = cells.join(F.broadcast(asked), keys).groupBy(*keys).agg(*[c for i in range(len(TRIED)) for c in _sums(F.col("_x"), F.col("_y"), F.col("_n"), F.col(f"a{i}"), F.col(f"b{i}"), str(i))])
            for row in sums.collect():
                g = tuple(row[k] for k in keys)
                n, moved = sizes[g], None
                for i, (a, b) in enumerate(tried[g]):
                    loss = row[f"loss{i}"] / n + 1e-9 * (a * a + b * b)
                    if g not in known or loss < known[g]:
                        moved = i, loss
                        break
                if not moved and way[g][1] > LEAST_STEP:  # shorter steps yet
                    step, part = way[g]
                    way[g] = step, part * TRIED[-1] / 2
                    tried[g] = _ahead(now[g], step * way[g][1], least_slope)
                    continue
                gain = known.get(g, math.inf) - moved[1] if moved else 0.0
                if moved:
                    now[g], known[g] = tried[g][moved[0]], moved[1]
                if gain < 1e-10:
                    del tried[g]
                    continue
                (a, b), i = now[g], moved[0]
                gradient = np.array([row[f"ga{i}"] / n + 2e-9 * a, row[f"gb{i}"] / n + 2e-9 * b])
                curve = np.array([[row[f"haa{i}"], row[f"hab{i}"]], [row[f"hab{i}"], row[f"hbb{i}"]]]) / n + np.eye(2) * 1e-6
                step = np.array([gradient[0] / curve[0, 0], 0.0]) if temperature_only else np.linalg.solve(curve, gradient)
                way[g] = step, 1.0
                tried[g] = _ahead(now[g], step, least_slope)
    finally:
        cells.unpersist()
    return spark.createDataFrame([(*g, n, *now[g]) for g, n in sizes.items()], schema + ", n long, slope double, intercept double")
