"""Ordered scans against plain Python, with stretches of a few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import metrics, selection
from sievewright.operators.scan import exact_percentiles, scanned


def made(spark, n=400, groups=(None, "a", "b"), seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(groups), place, rng.choice([None, *range(9)])) for place in rng.sample(range(10 * n), n)] + [("b", None, 4)]
    return rows, spark.createDataFrame(rows, "g string, place long, v int").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [["g"], []])
def test_scan_equals_a_loop(spark, by, descending):
    rows, df = made(spark)
    got = scanned(df, by, ["place"] if by else ["place", "g"], running={"sum": "v"}, totals={"all": "v"}, before={"left": "v"}, after={"right": "v"}, rank="nth", descending=descending, stretch_rows=30)
    want = []
    for group in {r[0] for r in rows} if by else [None]:
        own = sorted((r for r in rows if not by or r[0] == group), key=lambda r: (-1 if r[1] is None else r[1]), reverse=descending)
        values = [r[2] for r in own]
        for i, (g, place, v) in enumerate(own):
            seen = [x for x in values[: i + 1] if x is not None]
            want.append((g, place, v, sum(seen) if seen else None, sum(x for x in values if x is not None), values[i - 1] if i else None, values[i + 1] if i + 1 < len(own) else None, i))
    assert sorted(map(repr, (tuple(r) for r in got.select("g", "place", "v", "sum", "all", "left", "right", "nth").collect()))) == sorted(map(repr, want))
    assert sorted(map(repr, scanned(df, by, ["place"] if by else ["place", "g"], running={"sum": "v"}, totals={"all": "v"}, before={"left": "v"}, after={"right": "v"}, rank="nth", descending=descending).collect())) == sorted(map(repr, got.collect()))


def test_no_task_gets_a_whole_group(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.col("id").alias("place"), F.lit(1).alias("v"))
    got = scanned(df, ["g"], ["place"], running={"sum": "v"}, stretch_rows=500)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().toString() and "Join" not in got._jdf.queryExecution().toString()
    assert got.filter("sum <> place + 1").count() == 0
    from sievewright.operators.scan import stretched

    sizes = [r["count"] for r in stretched(df, ["g"], ["place"], 20_000, 500).groupBy("_stretch").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 2_000


def test_crowded_scores(spark):
    """Scores that crowd at the ends still fall into many stretches."""
    from sievewright.operators.scan import stretched

    df = spark.range(10_000).select((F.pow(F.lit(10.0), -F.col("id") / 1000 - 5)).alias("score"))
    sizes = [r["count"] for r in stretched(df, [], ["score"], 10_000, 500).groupBy("_stretch").count().collect()]
    assert max(sizes) < 1_500


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "g string, place long, v int")
    assert scanned(none, ["g"], ["place"], running={"sum": "v"}, rank="nth").count() == 0
    assert exact_percentiles(none, ["g"], "v", {"half": 0.5}).count() == 0
    same = spark.createDataFrame([("a", 1, 2)] * 50, "g string, place long, v int")
    assert sorted(r["sum"] for r in scanned(same, ["g"], ["place"], running={"sum": "v"}, stretch_rows=4).collect()) == [2 * i for i in range(1, 51)]


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.integers(0, 50, 333), "b": rng.normal(size=200), "c": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)], "g string, v double")
    wanted = {"p0": 0.0, "p5": 0.05, "half": 0.5, "p95": 0.95, "p100": 1.0}
    for size in (20, 1 << 20):
        got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", wanted, stretch_rows=size).collect()}
        assert set(got) == set(values)
        for g, vs in values.items():
            assert [got[g][n] for n in wanted] == pytest.approx([np.quantile(vs, q) for q in wanted.values()])


def test_curve_metrics_over_stretches(spark, monkeypatch):
    """The metrics that rest on scans give the same over many stretches as over one window."""
    from sievewright.operators import scan

    rng = random.Random(1)
    df = spark.createDataFrame([(g, rng.choice("xy"), round(rng.random(), 2), rng.randrange(2)) for g in "ab" for _ in range(300)], "g string, h string, pred double, label int")

    def every():
        out = {f.__name__: f(df, ["g"]) for f in (metrics.auroc, metrics.average_precision, metrics.balanced_threshold, metrics.roc_points, metrics.roc_grid, metrics.pr_grid)}
        out |= {"tpr": metrics.tpr_at_fpr(df, ["g"], 0.1), "pooled": metrics.pooled_auroc(df, "h", ["g"]), "cap": selection.byte_cap(df.withColumn("n", F.monotonically_increasing_id()), ["g"], "label", 40, "n").groupBy("g").count()}
        return {k: sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in v.collect()))) for k, v in out.items()}

    plain = every()
    monkeypatch.setattr(scan.scanned, "__kwdefaults__", scan.scanned.__kwdefaults__ | {"stretch_rows": 25})
    assert every() == plain
