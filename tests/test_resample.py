"""Bootstrap intervals against NumPy's resampling of rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import resample, scan
from sievewright.operators.stats import auroc_numpy


def made(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(g, int(rng.random() < share), rng.random()) for g, share in (("a", 0.5), ("b", 0.2)) for _ in range(n)]
    rows = [(g, y, round(min(1.0, 0.6 * s + 0.3 * y), 2), round(0.5 * s + 0.4 * y, 3)) for g, y, s in rows]
    return rows, spark.createDataFrame(rows, "g string, label int, pred double, other double")


def numpy_metrics(y, s):
    hit = s >= 0.5
    tp, fp, fn, tn = ((y == 1) & hit).sum(), ((y == 0) & hit).sum(), ((y == 1) & ~hit).sum(), ((y == 0) & ~hit).sum()
    return {"accuracy": (tp + tn) / len(y), "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2, "precision": tp / (tp + fp), "recall": tp / (tp + fn), "specificity": tn / (tn + fp), "f1": 2 * tp / (2 * tp + fp + fn), "auroc": auroc_numpy(y, s), "brier": ((s - y) ** 2).mean()}


@pytest.mark.parametrize("mean", [1, 2, 9, 64, 65, 3000])
def test_draws_have_the_mean_and_variance(spark, mean):
    df = spark.range(4000).select(F.lit(mean).cast("long").alias("c"), F.sha2(F.concat(F.col("id").cast("string"), F.lit("x")), 256).alias("d"))
    drawn = np.array([v for r in df.select(*[resample.poisson(F.col("c"), F.col("d"), F.lit(i)).alias(f"v{i}") for i in range(4)]).collect() for v in r])
    assert abs(drawn.mean() - mean) < 4 * math.sqrt(mean / len(drawn)) and abs(drawn.var() / mean - 1) < 0.06


def test_intervals_are_those_of_resampled_rows(spark):
    rows, df = made(spark)
    got = {(r["g"], r["metric"]): r for r in resample.bootstrap(df, "g", rounds=400).collect()}
    assert len(got) == 16
    rng = np.random.default_rng(0)
    for g in "ab":
        y, s = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        point = numpy_metrics(y, s)
        parts = [np.flatnonzero(y == k) for k in (0, 1)]
        drawn = [numpy_metrics(y[i], s[i]) for i in (np.concatenate([rng.choice(p, len(p)) for p in parts]) for _ in range(400))]
        for m in resample.METRICS:
            low, high = np.quantile([d[m] for d in drawn], [0.025, 0.975])
            r = got[g, m]
            assert r["estimate"] == pytest.approx(point[m]) and r["low"] <= r["estimate"] <= r["high"]
            width = high - low
            assert abs(r["low"] - low) < 0.25 * width and abs(r["high"] - high) < 0.25 * width


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_same_whatever_the_partitions_and_stretches(spark, monkeypatch):
    _, df = made(spark, 80)
    first = rounded(resample.bootstrap(df, "g", rounds=30))
    assert rounded(resample.bootstrap(df.repartition(7), "g", rounds=30)) == first
    assert rounded(resample.bootstrap(df, "g", rounds=30, seed=1)) != first
    monkeypatch.setattr(scan.scanned, "__kwdefaults__", scan.scanned.__kwdefaults__ | {"stretch_rows": 20})
    assert rounded(resample.bootstrap(df, "g", rounds=30)) == first


def test_no_python_in_the_plan(spark):
    _, df = made(spark, 20)
    plan = resample.bootstrap(df, "g", rounds=8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_paired_and_cohorts(spark):
    rows, df = made(spark)
    same = resample.paired_bootstrap(df.withColumn("twin", F.col("pred")), "g", "pred", "twin", rounds=20).collect()
    assert len(same) == 16 and all(abs(r["delta"]) < 1e-12 and abs(r["low"]) < 1e-12 and abs(r["high"]) < 1e-12 for r in same)
    got = {(r["g"], r["metric"]): r for r in resample.paired_bootstrap(df, "g", "pred", "other", rounds=200).collect()}
    for g in "ab":
        y, a, b = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2, 3))
        assert got[g, "auroc"]["delta"] == pytest.approx(auroc_numpy(y, b) - auroc_numpy(y, a)) and got[g, "auroc"]["low"] <= got[g, "auroc"]["delta"] <= got[g, "auroc"]["high"]
    cohorts = df.withColumn("cohort", F.when(F.col("other") * 1000 % 2 < 1, "x").otherwise("y"))
    own = {r["g"]: r for r in resample.cohort_bootstrap(cohorts, "g", "cohort", ["x", "y"], rounds=100).collect()}
    parts = {(r["g"], r["cohort"]): (r["y"], r["s"]) for r in cohorts.groupBy("g", "cohort").agg(F.collect_list("label").alias("y"), F.collect_list("pred").alias("s")).collect()}
    for g in "ab":
        x, y = (auroc_numpy(np.array(parts[g, c][0]), np.array(parts[g, c][1])) for c in "xy")
        assert own[g]["delta_auroc"] == pytest.approx(y - x) and own[g]["low"] <= own[g]["high"]


def test_odd_rows(spark):
    df = spark.createDataFrame([("one", 1, 0.7), ("one", 1, 0.2), ("one", 1, None), (None, 0, 0.4), (None, 1, 0.9), (None, 2, 0.9), ("gone", None, 0.5)], "g string, label int, pred double")
    got = {(r["g"], r["metric"]): r for r in resample.bootstrap(df, "g", rounds=40).collect()}
    assert {k[0] for k in got} == {"one", None} and got["one", "auroc"]["estimate"] is None and got["one", "recall"]["estimate"] == 0.5 and got["one", "specificity"]["estimate"] == 0.0
    assert got[None, "auroc"]["estimate"] == 1.0 == got[None, "auroc"]["low"]
    assert resample.bootstrap(df.limit(0), "g", rounds=4).count() == 0


def test_draws_stay_small(spark):
    """A digest is taken apart once a draw, not once a step of the search; the table of distribution functions is no part of the plan; pairs of scores are summed by score before there is a row for each round."""
    _, df = made(spark, 20)
    plan = resample.paired_bootstrap(df, "g", "pred", "other", rounds=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda x" in plan and not re.search(r"lambda x\S* < [^,]*conv\(", plan)
    assert len(plan) < 40_000
    above = plan[: plan.index("slot, 0")]  # the rows for each round come after (in the text, above) the draws
    assert "lambda x" not in above and "lambda x" in plan[len(above) :]
