import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions.identity import stable_digest
from sievewright.operators import audit, compare, dedup, joins, metrics, repair, selection, stats, weights


def scored(spark, seed=0, n=200, groups=3, values=12):
    r = random.Random(seed)
    rows = [(f"s{i}", f"g{r.randrange(groups)}", r.randint(0, 1), r.randint(0, values) / values) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id string, g string, label int, pred double")


def pairs_auroc(rows):
    p, n = [r[3] for r in rows if r[2] == 1], [r[3] for r in rows if r[2] == 0]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def test_curves_with_ties(spark):
    rows, df = scored(spark)
    got = {r["g"]: r for r in metrics.auroc(df, ["g"]).join(metrics.average_precision(df, ["g"]), "g").join(metrics.calibration_error(df, ["g"]), "g").join(metrics.balanced_threshold(df, ["g"]).withColumnRenamed("balanced_accuracy", "ba"), "g").collect()}
    for g in got:
        own = [r for r in rows if r[1] == g]
        y, s = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        assert math.isclose(got[g]["auroc"], pairs_auroc(own)) and math.isclose(got[g]["auroc"], stats.auroc_numpy(y, s))
        ap, last = 0.0, 0.0
        for t in sorted(set(s), reverse=True):
            tp, all_ = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
            ap += (tp / y.sum() - last) * tp / all_
            last = tp / y.sum()
        assert math.isclose(got[g]["average_precision"], ap)
        slot = np.minimum((s * 15).astype(int), 14)
        assert math.isclose(got[g]["ece_15"], sum(abs(y[slot == b].sum() - s[slot == b].sum()) for b in set(slot)) / len(s))
        ba = {t: ((s >= t)[y == 1].mean() + (s < t)[y == 0].mean()) / 2 for t in set(s)}
        best = max(ba.values())
        assert got[g]["threshold"] == max(t for t in ba if math.isclose(ba[t], best))


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7)], "g string, label int, pred double")
    assert metrics.auroc(df, ["g"]).first()["auroc"] is None
    assert metrics.balanced_threshold(df, ["g"]).first()["threshold"] == 0.5
    assert metrics.auroc(df.limit(0), ["g"]).count() == 0


def test_certain_scores_are_in_the_last_bin(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 1.0)], "g string, label int, pred double")
    assert metrics.calibration_error(df, ["g"]).first()["ece_15"] == 0.5


# Published confusion counts and the rates that go with them.
PUBLISHED = [(311, 439, 194, 556, 0.578, 0.741333, 0.414667), (603, 147, 388, 362, 0.643333, 0.482667, 0.804), (311, 439, 1, 249, 0.705333, 0.996, 0.414667)]


@pytest.mark.parametrize("row", PUBLISHED)
def test_rates_from_counts(spark, row):
    got = metrics.from_counts(spark.createDataFrame([row[:4]], "tn long, fp long, fn long, tp long")).first()
    assert np.allclose([got["balanced_accuracy"], got["recall"], got["specificity"]], row[4:], atol=1e-6)
    zero = metrics.from_counts(spark.createDataFrame([(0, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert zero["accuracy"] == zero["mcc"] == zero["f1"] == 0


def roc_with_dropped_points(y, s):
    """The curve as common libraries give it: without points in the middle of evenly spaced straight runs."""
    ts = sorted(set(s), reverse=True)
    tp = np.array([((s >= t) & (y == 1)).sum() for t in ts])
    fp = np.array([((s >= t) & (y == 0)).sum() for t in ts])
    keep = np.ones(len(ts), bool)
    full_tp, full_fp = np.concatenate([[0], tp]), np.concatenate([[0], fp])
    for i in range(len(ts) - 1):
        if full_tp[i + 2] - 2 * full_tp[i + 1] + full_tp[i] == 0 and full_fp[i + 2] - 2 * full_fp[i + 1] + full_fp[i] == 0:
            keep[i] = False
    return np.concatenate([[0], fp[keep] / (y == 0).sum()]), np.concatenate([[0], tp[keep] / (y == 1).sum()])


def test_roc_corners_and_grid(spark):
    rows, df = scored(spark, 3, 150, 2)
    grid = {}
    for r in metrics.roc_grid(df, ["g"], 21).collect():
        grid.setdefault(r["g"], {})[r["step"]] = r["y"]
    at = {r["g"]: r["tpr_at_fpr"] for r in metrics.tpr_at_fpr(df, ["g"], 0.3).collect()}
    for g in grid:
        own = [r for r in rows if r[1] == g]
        y, s = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        fpr, tpr = roc_with_dropped_points(y, s)
        assert math.isclose(at[g], tpr[np.flatnonzero(fpr <= 0.3)[-1]])
        want = np.interp(np.linspace(0, 1, 21), fpr, tpr)
        want[0], want[-1] = 0, 1
        assert sorted(grid[g]) == list(range(21))
        assert np.allclose([grid[g][i] for i in range(21)], want, atol=1e-9)


def test_pr_grid(spark):
    rows, df = scored(spark, 4, 150, 1)
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    best = {}
    for t in set(s):
        tp = ((s >= t) & (y == 1)).sum()
        best[tp / y.sum()] = max(best.get(tp / y.sum(), 0), tp / (s >= t).sum())
    best[0.0] = 1.0
    xs = sorted(best)
    want = np.interp(np.linspace(0, 1, 21), xs, [best[x] for x in xs])
    want[0], want[-1] = 1, y.mean()
    got = {r["step"]: r["y"] for r in metrics.pr_grid(df, ["g"], 21).collect()}
    assert np.allclose([got[i] for i in range(21)], want, atol=1e-9)


def test_pooled_auroc_is_that_of_group_and_pool(spark):
    rows, df = scored(spark, 5)
    got = {r["g"]: r["auroc"] for r in metrics.pooled_auroc(df, "g").collect()}
    for g in got:
        assert math.isclose(got[g], pairs_auroc([r for r in rows if r[2] == 0 or r[1] == g]))


def test_condition_summary(spark):
    df = spark.createDataFrame([("m", 0, "clean", 0.9, 0.8), ("m", 1, "blur", 0.7, 0.7), ("m", 2, "noise", 0.5, 0.6), ("only", 0, "clean", 0.9, 0.8)], "model string, condition_index int, condition string, auroc double, balanced_accuracy double")
    got = {r["model"]: r for r in compare.condition_summary(df, ["model"]).collect()}
    assert math.isclose(got["m"]["robust_mean_auroc"], 0.6) and got["m"]["robust_worst_auroc"] == 0.5 and got["m"]["robust_worst_condition"] == "noise" and math.isclose(got["m"]["delta_auroc"], 0.3)
    assert got["only"]["robust_mean_auroc"] is None and got["only"]["robust_worst_condition"] is None and got["only"]["delta_auroc"] is None


def test_headline_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.7), ("c", 2, 0.7)], "model string, i int, v double")
    assert compare.headline(df, "model", "i", ["v"]).first()["best"] == "b"


def test_gates(spark):
    df = spark.createDataFrame([("dual", 0.91, 0.90), ("m3", 0.90, 0.9005), ("bad", 0.99, 0.5)], "name string, clean double, worst double")
    assert compare.gated_winner(df, F.col("worst") >= 0.8, F.desc("clean")).first()["name"] == "dual"
    base = spark.createDataFrame([("k", 0.8, 0.9)], "k string, gain double, guard double")
    better = spark.createDataFrame([("k", 0.85, 0.88)], "k string, gain double, guard double")
    assert compare.accept_if(base, better, "k", "gain", 0.01, ["guard"], 0.05).first()["accepted"]
    assert not compare.accept_if(base, better, "k", "gain", 1.0, ["guard"], 0.05).first()["accepted"]


# Selection


def sequential_quota(sizes, total):
    whole = sum(sizes.values())
    exact = {k: (total * n // whole, total * n % whole) for k, n in sizes.items()}
    quota = {k: e[0] for k, e in exact.items()}
    for k in sorted(sizes, key=lambda k: (exact[k][1], sizes[k], k), reverse=True)[: total - sum(quota.values())]:
        quota[k] += 1
    return quota


def test_quotas(spark):
    r = random.Random(1)
    for _ in range(6):
        sizes = {f"k{i}": r.randint(1, 30) for i in range(r.randint(1, 9))}
        total = r.randint(0, sum(sizes.values()))
        df = spark.createDataFrame(list(sizes.items()), "k string, size long")
        got = {x["k"]: x["quota"] for x in selection.largest_remainder(df, "k", "size", total).collect()}
        assert got == sequential_quota(sizes, total) and sum(got.values()) == total and all(got[k] <= sizes[k] for k in sizes)
        rounded = {x["k"]: x["quota"] for x in selection.rounded_quota(df, "k", "size", total).collect()}
        assert rounded == one_by_one(sizes, total)
    with pytest.raises(ValueError):
        selection.rounded_quota(df, "k", "size", 10_000)


def one_by_one(sizes, total):
    """Rounded quotas, moved a unit at a time."""
    everything = sum(sizes.values())
    quota = {k: min(n, round(total * n / everything)) for k, n in sizes.items()}
    while sum(quota.values()) > total:
        quota[max(sorted(quota), key=quota.get)] -= 1
    while sum(quota.values()) < total:
        quota[max(sorted(quota), key=lambda k: sizes[k] - quota[k])] += 1
    return quota


def test_cut_from_top(spark):
    r = random.Random(4)
    for n in (1, 2, 7, 12):
        values = {f"k{i:02d}": r.randint(0, 6) for i in range(n)}
        df = spark.createDataFrame(list(values.items()), "k string, v long")
        for amount in (0, 1, sum(values.values()) // 2, sum(values.values())):
            left = dict(values)
            for _ in range(amount):
                left[max(sorted(left), key=left.get)] -= 1
            assert {x["k"]: x["v"] - x["cut"] for x in selection.cut_from_top(df, "k", "v", amount).collect()} == left
    with pytest.raises(ValueError):
        selection.cut_from_top(df, "k", "v", 10_000)


def test_round_robin_is_balanced(spark):
    rows = [(f"r{i}", f"g{i % 5 if i < 30 else 0}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, g string")
    got = selection.round_robin(df, "g", 17, stable_digest(1, F.col("g")), stable_digest(1, F.col("id"))).collect()
    counts = {g: sum(r["g"] == g for r in got) for g in {r["g"] for r in got}}
    assert len(got) == 17 and max(counts.values()) - min(counts.values()) <= 1


def test_compact_pick_touches_few_cells(spark):
    rows = [(i, c) for c, n in (("a", 3), ("b", 10), ("c", 7), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, cell string")
    got = selection.compact_pick(df, 15, 1, "s", ["cell"], stable_digest(1, F.col("i"))).collect()
    assert len(got) == 15 and {r["cell"] for r in got} == {"b", "c"}


def test_global_rank_and_shards(spark):
    keys = [f"k{random.Random(i).randrange(10**9):09d}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in set(keys)], "k string").repartition(5)
    got = sorted((r["position"], r["k"], r["shard"]) for r in selection.contiguous_shards(df, 7, "k").collect())
    n = len(set(keys))
    assert [g[1] for g in got] == sorted(set(keys)) and [g[0] for g in got] == list(range(n))
    edges = [n * i // 7 for i in range(8)]
    assert all(edges[s] <= p < edges[s + 1] for p, _, s in got)


def test_feasible_contribution(spark):
    df = spark.createDataFrame([(50,)] * 150 + [(100,)] * 90, "n int")
    assert selection.feasible_contribution(df, "n", 10000).first()["contribution"] == 50
    assert selection.feasible_contribution(df.limit(1), "n", 10000).first()["contribution"] is None


def test_holdout(spark):
    r = random.Random(9)
    for n, target in ((5, 20), (30, 60), (30, 15), (30, 900)):
        groups = [(f"f{r.randrange(4)}", f"g{i:02d}", r.randint(1, 12)) for i in range(n)]
        chosen = {}
        for fam in sorted({g[0] for g in groups}):
            size, name = min((g[2], g[1]) for g in groups if g[0] == fam)
            chosen[name] = size
        order = sorted((g for g in groups if g[1] not in chosen), key=lambda g: hashlib.sha256(f"7\x1f{g[1]}".encode()).hexdigest())
        for _, name, size in order:
            if sum(chosen.values()) + size <= target:
                chosen[name] = size
        if sum(chosen.values()) < target and (rest := [(g[2], g[1]) for g in groups if g[1] not in chosen]):
            chosen[min(rest)[1]] = min(rest)[0]
        df = spark.createDataFrame(groups, "fam string, g string, n int")
        got = [(x["g"], x["n"]) for x in selection.whole_group_holdout(df, "fam", "g", "n", target, 7).collect()]
        assert sorted(got) == sorted(chosen.items())


# Weights


def manifest(spark):
    rows = [(f"r{i}", 0, "", "", "src") for i in range(4)]
    rows += [(f"a{i}", 1, "lat", "big", "x") for i in range(4)] + [("b0", 1, "lat", "small", "x")] + [(f"c{i}", 1, "pix", "only", "x") for i in range(4)] + [(f"d{i}", 1, "gan", "g", "x") for i in range(2)]
    return spark.createDataFrame(rows, "sample_id string, label int, architecture string, generator_id string, source_dataset string")


MASS = {"lat": 0.5, "pix": 0.25, "gan": 0.25}


def test_hierarchical_mass(spark):
    got = weights.hierarchical_mass(manifest(spark), MASS, 0.5, 0.5, 3).collect()
    mass = {}
    for r in got:
        mass[r["generator_id"]] = mass.get(r["generator_id"], 0) + r["row_mass"]
        assert math.isclose(r["weight"] * 3, r["row_mass"])
    assert math.isclose(sum(mass.values()), 1, abs_tol=1e-12) and math.isclose(mass[""], 0.5)
    assert np.allclose([mass["big"], mass["small"], mass["only"], mass["g"]], [1 / 6, 1 / 12, 1 / 8, 1 / 8])


def test_square_root_law(spark):
    rows = [("p", 0, "", "", "one")] + [(f"q{i}", 0, "", "", "three") for i in range(3)] + [("a", 1, "lat", "g", "x")]
    df = spark.createDataFrame(rows, "sample_id string, label int, architecture string, generator_id string, source_dataset string")
    got = weights.hierarchical_mass(df, {"lat": 1.0}, 0.5, 0.5, 1).collect()
    one = sum(r["row_mass"] for r in got if r["source_dataset"] == "one") / 0.5
    assert math.isclose(one, 1 / (1 + 3**0.5))


@pytest.mark.parametrize("change", ["alpha", "views", "family", "blank", "label", "cross"])
def test_mass_fails_closed(spark, change):
    df, mass, alpha, views = manifest(spark), MASS, 0.5, 1
    if change == "alpha":
        alpha = float("nan")
    if change == "views":
        views = 0
    if change == "family":
        mass = {"lat": 0.5, "pix": 0.5}
    if change == "blank":
        df = df.withColumn("generator_id", F.when(F.col("generator_id") == "g", " ").otherwise(F.col("generator_id")))
    if change == "label":
        df = df.withColumn("label", F.when(F.col("sample_id") == "r0", 2).otherwise(F.col("label")))
    if change == "cross":
        df = df.withColumn("generator_id", F.when(F.col("generator_id") == "g", "only").otherwise(F.col("generator_id")))
    with pytest.raises(ValueError):
        weights.hierarchical_mass(df, mass, alpha, 0.5, views)


def test_weighted_draw(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", 6.0)], "k string, w double")
    got = weights.weighted_draw(df, "k", "w", 2000, 3).collect()
    share = {k: sum(r["k"] == k for r in got) / 2000 for k in "abcd"}
    assert len(got) == 2000 and share["c"] == 0 and abs(share["a"] - 0.1) < 0.03 and abs(share["b"] - 0.3) < 0.04
    assert sorted(map(tuple, got)) == sorted(map(tuple, weights.weighted_draw(df.repartition(3), "k", "w", 2000, 3).collect()))


# Duplicates, joins, audits


def test_hamming_join_finds_planted_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(60)]
    rows = [(i, b) for i, b in enumerate(base)]
    for d in (0, 4, 5):
        flipped = base[d]
        for bit in r.sample(range(64), d):
            flipped ^= 1 << bit
        rows.append((100 + d, flipped))
    signed = [(i, b - (1 << 64) if b >> 63 else b) for i, b in rows]
    df = spark.createDataFrame(signed, "id long, bits long")
    got = {(x["left_id"], x["right_id"]): x["distance"] for x in dedup.hamming_join(df, df, "id", "bits", 4, self_join=True).collect()}
    want = {(a, c): (b ^ d).bit_count() for a, b in rows for c, d in rows if a < c and (b ^ d).bit_count() <= 4}
    assert got == want and got[0, 100] == 0 and got[4, 104] == 4 and (5, 105) not in got
    membership, pairs = dedup.hamming_classes_join(df, "id", "bits", 4)
    assert {x["id"]: x["class_id"] for x in membership.collect()}[100] == 0 and all(x["distance"] > 0 for x in pairs.collect())
    victims = dedup.near_duplicate_victims(dedup.hamming_join(df, df, "id", "bits", 4, self_join=True), df.select("id", (F.col("id") >= 100).cast("int").alias("priority"), F.col("id").cast("string").alias("digest")), "id")
    assert {v["victim"] for v in victims.collect()} == {100, 104}


def test_fits_of_all_groups_at_once(spark):
    r = np.random.default_rng(4)
    rows = []
    for g, (slope, shift, n) in {"a": (2.0, 0.5, 400), "b": (0.3, -1.0, 300), "c": (40.0, 0.0, 60), "one": (1.0, 0.0, 1)}.items():
        x = np.round(r.normal(0, 2, n), 2)
        y = (r.random(n) < 1 / (1 + np.exp(-(slope * x + shift)))).astype(int)
        rows += [(g, float(a), int(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, ("a", None, 1), ("a", 0.0, None)], "g string, logit double, label int").repartition(5)
    for only in (False, True):
        got = {x["g"]: x for x in stats.fit_views(df, ["g"], temperature_only=only).collect()}
        assert {g: x["n"] for g, x in got.items()} == {"a": 400, "b": 300, "c": 60, "one": 1}
        for g in "abc":
            own = [(a, b) for k, a, b in rows if k == g]
            x, y = np.array([a for a, _ in own]), np.array([float(b) for _, b in own])

            def loss(a, b, x=x, y=y):
                return np.mean(np.logaddexp(0, a * x + b) - y * (a * x + b))

            slope, intercept = stats.fit_platt(x, y, only)
            assert loss(got[g]["slope"], got[g]["intercept"]) <= loss(slope, intercept) + (1e-7 if g != "c" else 1e-3)  # c is parted without error, so its slope has no bound
            if g != "c":
                assert abs(got[g]["slope"] - slope) < 1e-3 and abs(got[g]["intercept"] - intercept) < 1e-3
            assert not only or got[g]["intercept"] == 0
    assert stats.fit_views(df.limit(0), ["g"]).count() == 0


def test_hamming_join_across_splits(spark):
    base = [(i, (i * 0x9E3779B97F4A7C15) % (1 << 63)) for i in range(40)]
    rows = [(i, b, i % 2) for i, b in base] + [(100 + i, b ^ 3, i % 2) for i, b in base[:10]] + [(200 + i, b ^ 5, 1 - i % 2) for i, b in base[:10]] + [(300 + i, b, 1 - i % 2) for i, b in base[:3]] + [(400 + i, b, i % 2) for i, b in base[:3]]
    df = spark.createDataFrame(rows, "id long, bits long, split int")
    got = {(x["left_id"], x["right_id"]) for x in dedup.hamming_join(df, df, "id", "bits", 4, self_join=True, apart="split").collect()}
    assert got == {(a, c) for a, b, s in rows for c, d, u in rows if a < c and (b ^ d).bit_count() <= 4 and s != u}
    membership, pairs = dedup.hamming_classes_join(df, "id", "bits", 4, apart="split")
    of = dict(map(tuple, membership.collect()))
    assert of[400] == 0 and of[300] == 300
    linked = {(x["left_id"], x["right_id"]) for x in pairs.collect()}
    assert {tuple(sorted((of[a], of[c]))) for a, c in got} == linked
    with pytest.raises(ValueError, match="bands of 3 bits"):
        dedup.hamming_join(df, df, "id", "bits", 20)


def test_hamming_keys_grow_with_the_table():
    """Keys have as many values as there are rows, so random hashes meet about as often at any size, and hashes within the radius always do."""
    r = random.Random(5)
    for n in (100, 10**4, 10**6, 10**9):
        masks = dedup.key_masks(4, n)
        assert len(masks) <= dedup.MOST_KEYS
        for m in masks:
            assert n / 2 ** (m & (1 << 64) - 1).bit_count() <= 1, n
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), 4))
            assert any(flips & m & (1 << 64) - 1 == 0 for m in masks)
    assert [len(dedup.key_masks(4, n)) for n in (1000, 10**6, 10**8, 10**9)] == [5, 15, 35, 70]


def test_coverage(spark):
    a = spark.createDataFrame([(f"k{i}",) for i in range(10)], "k string")
    b = spark.createDataFrame([(f"k{i}",) for i in range(3, 12)], "k string")
    r = joins.coverage(a, b, "k").first()
    assert (r["both"], r["missing"], r["extra"], r["first_missing"], r["first_extra"], r["complete"]) == (7, 3, 2, "k0,k1,k2", "k10,k11", False)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "i int, s string")
    checks = [audit.Check("repeats", df, audit.repeats("i")), audit.Check("nulls", df, audit.where(F.col("s").isNull()), True), audit.Check("fine", df, audit.where(F.col("i") > 5))]
    got = [(r["result"], r["failures"]) for r in audit.run_checks(checks).orderBy("check_order").collect()]
    assert got == [("FAIL", 1), ("WARN", 1), ("PASS", 0)]
    with pytest.raises(ValueError, match="repeats: 1"):
        audit.require(checks)


def test_reconcile(spark):
    a = spark.createDataFrame([("m", 1, 0.5), ("n", 2, 0.5), ("x", 1, 0.1)], "k string, tp long, auroc double")
    b = spark.createDataFrame([("m", 1, 0.5000001), ("n", 3, 0.6)], "k string, tp long, auroc double")
    got = sorted((r["k"], r["metric"]) for r in audit.reconcile(a, b, ["k"], ["tp"], ["auroc"]).collect())
    assert got == [("n", "auroc"), ("n", "tp"), ("x", "auroc"), ("x", "tp")]


def test_repair_until_no_repeats(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"s{i}", "u" if i % 2 else "v", f"h{r.randrange(25)}") for i in range(30)]
    pool = [(f"c{i}", "u" if i % 2 else "v", f"h{r.randrange(400)}") for i in range(120)]
    df, cand = (spark.createDataFrame(x, "id string, identity string, sha string") for x in (rows, pool))

    def keep(frame, n):
        keep.k += 1
        frame.write.parquet(f"{tmp_path}/{keep.k}")
        return spark.read.parquet(f"{tmp_path}/{keep.k}")

    keep.k = 0
    digest = stable_digest(1, F.col("id"))

    def replace(selection, losers, attempted):
        return repair.replace_losers(selection, losers, cand.join(attempted, "id", "left_anti"), "id", ["identity"], ["id"], [digest])

    out, rounds = repair.repair(df, lambda s: repair.exact_duplicate_losers(s, "sha", stable_digest(2, F.col("id"))), replace, keep, "id")
    got = out.collect()
    assert rounds >= 1 and len(got) == 30 and len({g["sha"] for g in got}) == 30
    assert sum(g["identity"] == "u" for g in got) == 15
    with pytest.raises(ValueError):
        repair.replace_losers(df, df.limit(20), cand.limit(1), "id", ["identity"], ["id"], ["id"])


# Statistics


def test_platt():
    for centre, logits in ((5.0, [3, 4, 7, 8]), (7.0, [5, 6, 9, 10])):
        slope, intercept = stats.fit_platt(np.array(logits, float), np.array([0, 0, 1, 1], float))
        assert slope > 0 and logits[1] < -intercept / slope < logits[2]
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * x)))).astype(float)
    slope, intercept = stats.fit_platt(x, y, temperature_only=True)
    assert abs(slope - 0.5) < 0.08 and intercept == 0
