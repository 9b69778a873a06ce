"""Queries over metrics of scores, comparisons, calibration, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import scores as S
from ..operators import audit, compare, joins, metrics, resample, stats
from ..sources import images
from . import analogues
from .analogues import CONDITIONS, MANIFEST, digest_sql, manifest, pred_sql, predictions, t
from .projections import TWO, both_scores
from .registry import query

#: Added before results are rounded, in both engines, so that a value halfway between two does not depend on the order of a sum.
NUDGE = "1e-10"


def sql(*ctes: str, select: str) -> str:
    return analogues.sql(*ctes, select=select).replace(", 6)", f" + {NUDGE}, 6)")


CLEAN = pred_sql(1, "predictions", "c.condition_index = 0")
BASE = (MANIFEST, CONDITIONS, pred_sql())
CLEAN_BASE = (MANIFEST, CONDITIONS, CLEAN)
KEYS = "architecture, condition_index"
BY = ["architecture", "condition_index"]


def frame_sql(by: str, source: str = "predictions", name: str = "frame") -> str:
    """The cumulative frame, in SQL."""
    return f"""
{name} AS (
  SELECT *, sum(tp) OVER (PARTITION BY {by} ORDER BY score DESC) AS cum_tp, sum(fp) OVER (PARTITION BY {by} ORDER BY score DESC) AS cum_fp,
         sum(tp) OVER (PARTITION BY {by}) AS total_p, sum(fp) OVER (PARTITION BY {by}) AS total_n
  FROM (SELECT {by}, pred AS score, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS fp FROM {source} GROUP BY {by}, pred))"""


def auroc_sql(by: str, source: str = "predictions", extra: str = "") -> str:
    """By counting pairs, which shares nothing with the frame."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in by.split(","))
    named = ", ".join(f"a.{k.strip()}" for k in by.split(","))
    return f"SELECT {named}, round(avg(CASE WHEN a.pred > b.pred THEN 1 WHEN a.pred = b.pred THEN 0.5 ELSE 0 END), 6) AS auroc{extra} FROM {source} a JOIN {source} b ON {on} AND a.label = 1 AND b.label = 0 GROUP BY {named}"


CONFUSION = "count(*) FILTER (WHERE label = 0 AND pred < 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND pred >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND pred < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND pred >= 0.5) AS tp"


def div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"


RATES = {
    "accuracy": div("tp + tn", "tn + fp + fn + tp"), "precision": div("tp", "tp + fp"), "recall": div("tp", "tp + fn"), "specificity": div("tn", "tn + fp"), "npv": div("tn", "tn + fn"), "f1": div("2 * tp", "2 * tp + fp + fn"),
    "macro_f1": f"({div('2 * tp', '2 * tp + fp + fn')} + {div('2 * tn', '2 * tn + fp + fn')}) / 2", "balanced_accuracy": f"({div('tp', 'tp + fn')} + {div('tn', 'tn + fp')}) / 2",
    "mcc": "CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END",
    "false_positive_rate": div("fp", "fp + tn"), "false_negative_rate": div("fn", "fn + tp"), "predicted_positive_rate": div("tp + fp", "tn + fp + fn + tp"),
}
RATES_SQL = ", ".join(f"round({v}, 6) AS {k}" for k, v in RATES.items())


def rounded(df, *exact):
    """Doubles to six places, the oracle's precision."""
    return df.select(*[F.round(F.col(c) + float(NUDGE), 6).alias(c) if k == "double" and c not in exact else F.col(c) for c, k in df.dtypes])


@query("clean_metrics_by_architecture", sql(*CLEAN_BASE, "au AS (" + auroc_sql("architecture") + ")", "ece AS (SELECT architecture, round(sum(abs(y - s)) / sum(m), 6) AS ece_15 FROM (SELECT architecture, least(floor(pred * 15)::INT, 14) AS b, count(*) AS m, sum(pred) AS s, sum(label) AS y FROM predictions GROUP BY ALL) GROUP BY architecture)", "c AS (SELECT architecture, count(*) AS n, " + CONFUSION + " FROM predictions GROUP BY architecture)", select=f"SELECT c.*, round({RATES['accuracy']}, 6) AS accuracy, auroc, ece_15 FROM c LEFT JOIN au USING (architecture) LEFT JOIN ece USING (architecture)"))
def clean_metrics_by_architecture(spark, sf):
    scored = predictions(spark, sf, clean_only=True)
    by = ["architecture"]
    counts = metrics.threshold_metrics(scored, by).select("architecture", "n", "tn", "fp", "fn", "tp", "accuracy")
    return rounded(counts.join(metrics.auroc(scored, by), by, "left").join(metrics.calibration_error(scored, by), by, "left"))


@query("confusion_metrics", sql(*BASE, f"c AS (SELECT {KEYS}, count(*) AS n, {CONFUSION} FROM predictions GROUP BY {KEYS})", select=f"SELECT *, {RATES_SQL} FROM c"))
def confusion_metrics(spark, sf):
    return rounded(metrics.threshold_metrics(predictions(spark, sf), BY))


@query("auroc", sql(*BASE, select=auroc_sql(KEYS)))
def auroc(spark, sf):
    return rounded(metrics.auroc(predictions(spark, sf), BY)).filter("auroc IS NOT NULL")


@query("average_precision", sql(*BASE, frame_sql(KEYS), select=f"SELECT {KEYS}, round(sum(tp / total_p * cum_tp / (cum_tp + cum_fp)), 6) AS average_precision FROM frame GROUP BY {KEYS}"))
def average_precision(spark, sf):
    return rounded(metrics.average_precision(predictions(spark, sf), BY))


@query("brier", sql(*BASE, select=f"SELECT {KEYS}, round(avg((pred - label) ** 2), 6) AS brier FROM predictions GROUP BY {KEYS}"))
def brier(spark, sf):
    return rounded(predictions(spark, sf).groupBy(*BY).agg(metrics.brier().alias("brier")))


@query("ece15", sql(*BASE, select=f"SELECT {KEYS}, round(sum(m * abs(y / m - s / m)) / sum(m), 6) AS ece_15 FROM (SELECT {KEYS}, least(floor(pred * 15)::INT, 14) AS b, count(*) AS m, sum(pred) AS s, sum(label) AS y FROM predictions GROUP BY ALL) GROUP BY {KEYS}"))
def ece15(spark, sf):
    return rounded(metrics.calibration_error(predictions(spark, sf), BY))


@query("balanced_threshold", sql(*BASE, frame_sql(KEYS), "b AS (SELECT *, 0.5 * (cum_tp / total_p + 1 - cum_fp / total_n) AS ba FROM frame WHERE total_p > 0 AND total_n > 0)", select=f"SELECT {KEYS}, score AS threshold, round(ba, 6) AS balanced_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY round(ba, 12) DESC, score DESC) AS k FROM b) WHERE k = 1"))
def balanced_threshold(spark, sf):
    return rounded(metrics.balanced_threshold(predictions(spark, sf), BY)).filter("balanced_accuracy IS NOT NULL")


@query("roc_frame", sql(*CLEAN_BASE, frame_sql("architecture"), select="SELECT architecture, score, tp, fp, cum_tp::BIGINT AS cum_tp, cum_fp::BIGINT AS cum_fp, total_p::BIGINT AS total_p, total_n::BIGINT AS total_n FROM frame"))
def roc_frame(spark, sf):
    return metrics.score_frame(predictions(spark, sf, clean_only=True), ["architecture"])


CORNERS = """
p AS (SELECT *, coalesce(lag(cum_tp) OVER w, 0) AS tp0, coalesce(lag(cum_fp) OVER w, 0) AS fp0, lead(cum_tp) OVER w AS tp1, lead(cum_fp) OVER w AS fp1 FROM frame WINDOW w AS (PARTITION BY condition_index ORDER BY score DESC)),
corner AS (SELECT condition_index, score, cum_fp / total_n AS fpr, cum_tp / total_p AS tpr FROM p WHERE NOT coalesce(tp1 - 2 * cum_tp + tp0 = 0 AND fp1 - 2 * cum_fp + fp0 = 0, FALSE))"""


@query("tpr_at_fpr", sql(*BASE, frame_sql("condition_index"), CORNERS, select="SELECT condition_index, round(coalesce(max(tpr) FILTER (WHERE fpr <= 0.05), 0), 6) AS tpr_at_fpr FROM corner GROUP BY condition_index"))
def tpr_at_fpr(spark, sf):
    return rounded(metrics.tpr_at_fpr(predictions(spark, sf), ["condition_index"], 0.05))


def _grid_sql(points: str, first: str, first_y: str, last_y: str) -> str:
    """A curve of the clean condition on 201 even steps: at each the point there, or the line between its neighbours."""
    return sql(
        *CLEAN_BASE,
        frame_sql("condition_index"),
        CORNERS,
        f"""
found AS (SELECT x, min(y) AS lo, max(y) AS hi FROM ({points}) GROUP BY x),
curve AS (SELECT * FROM found UNION ALL SELECT 0, {first}, {first} WHERE NOT EXISTS (SELECT 1 FROM found WHERE x = 0)),
ends AS (SELECT {first_y} AS first_y, {last_y} AS last_y FROM frame),
near AS (SELECT range AS i, max(x) FILTER (WHERE x < range / 200.0 - 1e-12) AS x0, arg_max(hi, x) FILTER (WHERE x < range / 200.0 - 1e-12) AS y0,
                min(x) FILTER (WHERE x >= range / 200.0 - 1e-12) AS x1, arg_min(lo, x) FILTER (WHERE x >= range / 200.0 - 1e-12) AS y1, arg_min(hi, x) FILTER (WHERE x >= range / 200.0 - 1e-12) AS top
         FROM range(201), curve GROUP BY range)""",
        select="""
SELECT 'clean' AS condition, i::INTEGER AS step, round(i / 200.0, 6) AS x,
       round(CASE WHEN i = 0 THEN first_y WHEN i = 200 THEN last_y WHEN abs(x1 - i / 200.0) <= 1e-12 THEN top ELSE y0 + (i / 200.0 - x0) * (y1 - y0) / (x1 - x0) END::DOUBLE, 6) AS y
FROM near, ends""",
    )


@query("roc_grid", _grid_sql("SELECT fpr AS x, tpr AS y FROM corner", "0", "0", "max(1)"))
def roc_grid(spark, sf):
    return rounded(metrics.roc_grid(predictions(spark, sf, clean_only=True), ["condition"]))


@query("pr_grid", _grid_sql("SELECT cum_tp / total_p AS x, max(cum_tp / (cum_tp + cum_fp)) AS y FROM frame GROUP BY cum_tp / total_p", "1", "1", "max(total_p / (total_p + total_n))"))
def pr_grid(spark, sf):
    return rounded(metrics.pr_grid(predictions(spark, sf, clean_only=True), ["condition"]))


@query("sliced_recall", sql(*BASE, select="SELECT condition_index, generator_id, count(*) AS n, round(avg((pred >= 0.5)::INT), 6) AS recall, round(avg(pred), 6) AS mean_score FROM predictions WHERE label = 1 GROUP BY ALL"))
def sliced_recall(spark, sf):
    rows = predictions(spark, sf).filter("label = 1").groupBy("condition_index", "generator_id")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg(S.predicted(F.col("pred"), 0.5)).alias("recall"), F.avg("pred").alias("mean_score")))


@query("sliced_specificity", sql(*BASE, select="SELECT condition_index, generator_id, count(*) AS n, round(avg((pred < 0.5)::INT), 6) AS specificity, round(avg(pred), 6) AS mean_score FROM predictions WHERE label = 0 GROUP BY ALL"))
def sliced_specificity(spark, sf):
    rows = predictions(spark, sf).filter("label = 0").groupBy("condition_index", "generator_id")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg(1 - S.predicted(F.col("pred"), 0.5)).alias("specificity"), F.avg("pred").alias("mean_score")))


METRICS_BY_SPLIT = "mm AS (SELECT x.split, x.condition_index, au.auroc, x.balanced_accuracy FROM (SELECT split, condition_index, " + RATES["balanced_accuracy"] + " AS balanced_accuracy FROM (SELECT split, condition_index, " + CONFUSION + " FROM predictions GROUP BY ALL)) x JOIN (" + auroc_sql("split, condition_index").replace("round(avg", "(avg").replace(", 6) AS auroc", ") AS auroc") + ") au USING (split, condition_index))"


def by_split(spark, sf, seed=1):
    scored = predictions(spark, sf, seed)
    by = ["split", "condition_index"]
    return metrics.auroc(scored, by).join(metrics.threshold_metrics(scored, by).select(*by, "balanced_accuracy"), by).withColumn("condition", F.when(F.col("condition_index") == 0, "clean").otherwise(F.concat(F.lit("condition_"), F.col("condition_index").cast("string"))))


@query("condition_summary", sql(*BASE, METRICS_BY_SPLIT, select="""SELECT split, round(max(auroc) FILTER (WHERE condition_index = 0), 6) AS clean_auroc, round(max(balanced_accuracy) FILTER (WHERE condition_index = 0), 6) AS clean_balanced_accuracy,
round(avg(auroc) FILTER (WHERE condition_index > 0), 6) AS robust_mean_auroc, round(min(auroc) FILTER (WHERE condition_index > 0), 6) AS robust_worst_auroc,
'condition_' || arg_min(condition_index, round(auroc, 12) + condition_index * 1e-14) FILTER (WHERE condition_index > 0) AS robust_worst_condition,
round(max(auroc) FILTER (WHERE condition_index = 0) - avg(auroc) FILTER (WHERE condition_index > 0), 6) AS delta_auroc, round(avg(balanced_accuracy) FILTER (WHERE condition_index > 0), 6) AS robust_mean_balanced_accuracy, count(*) AS conditions FROM mm GROUP BY split"""))
def condition_summary(spark, sf):
    rows = by_split(spark, sf).withColumn("auroc", F.round("auroc", 12))
    return rounded(compare.condition_summary(rows, ["split"]))


@query("macro_average", sql(*BASE, METRICS_BY_SPLIT, select="SELECT condition_index, round(avg(auroc), 6) AS macro_auroc, round(avg(balanced_accuracy), 6) AS macro_accuracy, count(*) AS splits FROM mm GROUP BY condition_index"))
def macro_average(spark, sf):
    return rounded(by_split(spark, sf).groupBy("condition_index").agg(F.avg("auroc").alias("macro_auroc"), F.avg("balanced_accuracy").alias("macro_accuracy"), F.count(F.lit(1)).alias("splits")))


@query("hierarchical_macro", sql(*CLEAN_BASE, select="SELECT round(avg(r), 6) AS macro_recall, round(min(r), 6) AS worst_recall, count(*) AS architectures FROM (SELECT architecture, avg(r) AS r FROM (SELECT architecture, generator_id, avg((pred >= 0.5)::INT) AS r FROM predictions WHERE label = 1 GROUP BY ALL) GROUP BY architecture)"))
def hierarchical_macro(spark, sf):
    rows = predictions(spark, sf, clean_only=True).filter("label = 1")
    per = rows.groupBy("architecture", "generator_id").agg(F.avg(S.predicted(F.col("pred"), 0.5)).alias("r")).groupBy("architecture").agg(F.avg("r").alias("r"))
    return rounded(per.agg(F.avg("r").alias("macro_recall"), F.min("r").alias("worst_recall"), F.count(F.lit(1)).alias("architectures")))


@query("shared_pool_auroc", sql(*CLEAN_BASE, select="SELECT a.generator_id, round(avg(CASE WHEN a.pred > b.pred THEN 1 WHEN a.pred = b.pred THEN 0.5 ELSE 0 END), 6) AS auroc FROM predictions a JOIN predictions b ON a.label = 1 AND b.label = 0 GROUP BY a.generator_id"))
def shared_pool_auroc(spark, sf):
    scored = predictions(spark, sf, clean_only=True)
    return rounded(metrics.pooled_auroc(scored, "generator_id", ["condition_index"])).select("generator_id", "auroc")


@query("argmax_headline", sql(*BASE, METRICS_BY_SPLIT, "h AS (SELECT condition_index, round(avg(auroc), 6) AS auroc, round(avg(balanced_accuracy), 6) AS accuracy FROM mm GROUP BY condition_index)", select="SELECT 'auroc' AS metric, arg_max(condition_index, auroc * 1e9 - condition_index) AS best, max(auroc) AS value FROM h UNION ALL SELECT 'accuracy', arg_max(condition_index, accuracy * 1e9 - condition_index), max(accuracy) FROM h"))
def argmax_headline(spark, sf):
    rows = by_split(spark, sf).groupBy("condition_index").agg(F.round(F.avg("auroc"), 6).alias("auroc"), F.round(F.avg("balanced_accuracy"), 6).alias("accuracy"))
    return compare.headline(rows, "condition_index", "condition_index", ["auroc", "accuracy"])


FEATURES = "features AS (SELECT e.vec_id, (e.label % 2) AS label, f AS feature, round(e.embedding[f], 6) AS pred FROM embeddings e CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS f))"


@query("feature_separability", sql(FEATURES, "au AS (" + auroc_sql("feature", "features").replace("round(avg", "(avg").replace(", 6) AS auroc", ") AS auroc") + ")", select="SELECT feature, round(auroc, 6) AS auroc, round(greatest(auroc, 1 - auroc), 6) AS separability, round(avg(pred) FILTER (WHERE label = 0), 6) AS mean_real, round(avg(pred) FILTER (WHERE label = 1), 6) AS mean_generated FROM features JOIN au USING (feature) GROUP BY feature, auroc"))
def feature_separability(spark, sf):
    rows = t(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), F.posexplode(F.slice("embedding", 1, 6)).alias("p", "v")).select("label", (F.col("p") + 1).alias("feature"), F.round(F.col("v").cast("double"), 6).alias("pred"))
    means = rows.groupBy("feature").agg(F.avg(F.when(F.col("label") == 0, F.col("pred"))).alias("mean_real"), F.avg(F.when(F.col("label") == 1, F.col("pred"))).alias("mean_generated"))
    joined = metrics.auroc(rows, ["feature"]).withColumn("separability", F.greatest("auroc", 1 - F.col("auroc"))).join(means, "feature")
    return rounded(joined)


@query("gate_statistics", sql(*BASE, select="SELECT condition_index, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS std, min(pred) AS least, max(pred) AS most, round(avg(-(greatest(1e-12, pred) * ln(greatest(1e-12, pred)) + greatest(1e-12, 1 - pred) * ln(greatest(1e-12, 1 - pred)))), 6) AS mean_entropy FROM predictions GROUP BY condition_index"))
def gate_statistics(spark, sf):
    p = F.col("pred")
    return rounded(predictions(spark, sf).groupBy("condition_index").agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("least"), F.max(p).alias("most"), F.avg(S.entropy_nats(p)).alias("mean_entropy")))


@query("probability_shift", sql(MANIFEST, CONDITIONS, pred_sql(), pred_sql(2, "predictions_b"), "x AS (SELECT a.condition_index, a.pred, b.pred AS pred_b FROM predictions a JOIN predictions_b b USING (sample_id, condition_index))", select="SELECT condition_index, round(avg(abs(pred - pred_b)), 6) AS mean_shift, round(max(abs(pred - pred_b)), 6) AS max_shift, round(avg(((pred >= 0.5) <> (pred_b >= 0.5))::INT), 6) AS flip_rate FROM x GROUP BY condition_index"))
def probability_shift(spark, sf):
    gap = F.abs(F.col("pred") - F.col("pred_b"))
    flips = (F.col("pred") >= 0.5) != (F.col("pred_b") >= 0.5)
    return rounded(both_scores(spark, sf, False).groupBy("condition_index").agg(F.avg(gap).alias("mean_shift"), F.max(gap).alias("max_shift"), F.avg(flips.cast("int")).alias("flip_rate")))


@query("mixture_grid", sql(*TWO, "grid AS (SELECT range / 4.0 AS weight FROM range(5))", "mixed AS (SELECT g.weight, label, round(greatest(0, least(1, pred * (1 - weight) + pred_b * weight)), 9) AS pred FROM both_scores CROSS JOIN grid g)", select="SELECT x.*, b.brier FROM (" + auroc_sql("weight", "mixed") + ") x JOIN (SELECT weight, round(avg((pred - label) ** 2), 6) AS brier FROM mixed GROUP BY weight) b USING (weight)"))
def mixture_grid(spark, sf):
    weights = F.explode(F.array(*[F.lit(i / 4) for i in range(5)])).alias("weight")
    mixed = both_scores(spark, sf).select("label", "pred", "pred_b", weights).select("weight", "label", F.round(S.mixture(F.col("pred"), F.col("pred_b"), F.col("weight")), 9).alias("pred"))
    return rounded(metrics.auroc(mixed, ["weight"]).join(mixed.groupBy("weight").agg(metrics.brier().alias("brier")), "weight"))


@query("symmetric_kl", sql(*TWO, "c AS (SELECT greatest(1e-7, least(1 - 1e-7, pred)) AS p, greatest(1e-7, least(1 - 1e-7, pred_b)) AS q, label AS y FROM both_scores)", select="SELECT round(avg(0.5 * ((p - q) * (ln(p) - ln(q)) + (q - p) * (ln(1 - p) - ln(1 - q)))), 6) AS kl, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS bce_a, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS bce_b FROM c"))
def symmetric_kl(spark, sf):
    p, q, y = F.col("pred"), F.col("pred_b"), F.col("label")
    return rounded(both_scores(spark, sf).agg(F.avg(S.symmetric_kl(p, q)).alias("kl"), F.avg(S.cross_entropy(p, y)).alias("bce_a"), F.avg(S.cross_entropy(q, y)).alias("bce_b")))


@query("paired_loss", sql(*TWO, "c AS (SELECT greatest(1e-7, least(1 - 1e-7, pred)) AS p, greatest(1e-7, least(1 - 1e-7, pred_b)) AS q, label AS y FROM both_scores)", select="SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))) + avg(-(y * ln(q) + (1 - y) * ln(1 - q))) + 0.5 * avg(0.5 * ((p - q) * (ln(p) - ln(q)) + (q - p) * (ln(1 - p) - ln(1 - q)))), 6) AS loss FROM c"))
def paired_loss(spark, sf):
    p, q, y = F.col("pred"), F.col("pred_b"), F.col("label")
    return rounded(both_scores(spark, sf).agg((F.avg(S.cross_entropy(p, y)) + F.avg(S.cross_entropy(q, y)) + 0.5 * F.avg(S.symmetric_kl(p, q))).alias("loss")))


@query("cosine_feature_loss", "SELECT a.vec_id, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-12), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_feature_loss(spark, sf):
    rows = t(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(S.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


GRAM = "list_dot_product(a.embedding[{0}]::DOUBLE[], b.embedding[{0}]::DOUBLE[]) / greatest(sqrt(list_dot_product(a.embedding[{0}]::DOUBLE[], a.embedding[{0}]::DOUBLE[])) * sqrt(list_dot_product(b.embedding[{0}]::DOUBLE[], b.embedding[{0}]::DOUBLE[])), 1e-12)"


@query("pairwise_geometry_loss", f"SELECT batch, round(avg(CASE WHEN abs(d) < 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END), 6) AS loss FROM (SELECT a.vec_id // 16 AS batch, {GRAM.format('1:32')} - {GRAM.format('33:64')} AS d FROM embeddings a JOIN embeddings b ON a.vec_id // 16 = b.vec_id // 16 AND a.vec_id < b.vec_id) GROUP BY batch")
def pairwise_geometry_loss(spark, sf):
    # batches have 16 rows, so a batch makes 120 pairs at most
    rows = t(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), F.slice("embedding", 1, 32).alias("s"), F.slice("embedding", 33, 32).alias("r"))
    other = rows.select("batch", F.col("vec_id").alias("v2"), F.col("s").alias("s2"), F.col("r").alias("r2"))
    d = (1 - S.cosine_distance(F.col("s"), F.col("s2"))) - (1 - S.cosine_distance(F.col("r"), F.col("r2")))
    return rounded(rows.join(other, "batch").filter("vec_id < v2").groupBy("batch").agg(F.avg(S.smooth_l1(d)).alias("loss")))


@query("dual_threshold", sql(*CLEAN_BASE, "c AS (SELECT architecture, thr.threshold, count(*) FILTER (WHERE label = 0 AND pred < thr.threshold) AS tn, count(*) FILTER (WHERE label = 0 AND pred >= thr.threshold) AS fp, count(*) FILTER (WHERE label = 1 AND pred < thr.threshold) AS fn, count(*) FILTER (WHERE label = 1 AND pred >= thr.threshold) AS tp FROM predictions CROSS JOIN (SELECT unnest([0.5, 0.65])::DOUBLE AS threshold) thr GROUP BY ALL)", select=f"SELECT architecture, threshold, tn, fp, fn, tp, round({RATES['balanced_accuracy']}, 6) AS balanced_accuracy FROM c"))
def dual_threshold(spark, sf):
    rows = predictions(spark, sf, clean_only=True).withColumn("threshold", F.explode(F.array(F.lit(0.5), F.lit(0.65))))
    return rounded(metrics.threshold_metrics(rows, ["architecture", "threshold"], F.col("threshold")).select("architecture", "threshold", "tn", "fp", "fn", "tp", "balanced_accuracy"))


@query("view_affine", sql(*BASE, "a AS (SELECT range::INT AS condition_index, 1 + range / 10.0 AS slope, -0.5 - range / 20.0 AS intercept FROM range(21))", select="SELECT sample_id, condition_index, round(1 / (1 + exp(-(pred * slope + intercept))), 6) AS calibrated FROM predictions JOIN a USING (condition_index)"))
def view_affine(spark, sf):
    params = spark.range(21).select(F.col("id").cast("int").alias("condition_index"), (1 + F.col("id") / 10).alias("slope"), (-0.5 - F.col("id") / 20).alias("intercept"))
    joined = predictions(spark, sf).join(F.broadcast(params), "condition_index")
    return joined.select("sample_id", "condition_index", F.round(S.platt(F.col("pred"), F.col("slope"), F.col("intercept")) + float(NUDGE), 6).alias("calibrated"))


@query("positional_zip", sql(*BASE, select="SELECT p.condition_index, c.condition, count(*) AS rows, bool_and(p.condition = c.condition) AS names_match FROM predictions p JOIN conditions c USING (condition_index) GROUP BY ALL"))
def positional_zip(spark, sf):
    from .analogues import conditions

    dim = conditions(spark).withColumnRenamed("condition", "matrix_name")
    joined = predictions(spark, sf).join(F.broadcast(dim), "condition_index")
    return joined.groupBy("condition_index", F.col("matrix_name").alias("condition")).agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("condition") == F.col("matrix_name")).alias("names_match"))


# Comparison and reshaping


SECOND = pred_sql(2, "predictions_b")
MM_B = METRICS_BY_SPLIT.replace("mm AS", "mm_b AS").replace("FROM predictions", "FROM predictions_b").replace("JOIN predictions b", "JOIN predictions_b b")


@query("version_delta", sql(*BASE, SECOND, METRICS_BY_SPLIT, MM_B, select="SELECT split, condition_index, round(a.auroc, 6) AS auroc_a, round(b.auroc, 6) AS auroc_b, round(b.auroc - a.auroc, 6) AS auroc_delta FROM mm a JOIN mm_b b USING (split, condition_index)"))
def version_delta(spark, sf):
    return rounded(joins.delta(by_split(spark, sf), by_split(spark, sf, 2), ["split", "condition_index"], ["auroc"]))


@query("unpivot_chart", sql(*BASE, METRICS_BY_SPLIT, select="SELECT split, condition_index, unnest(['auroc', 'balanced_accuracy']) AS series, unnest([round(auroc, 6), round(balanced_accuracy, 6)]) AS value FROM mm"))
def unpivot_chart(spark, sf):
    return compare.long_form(rounded(by_split(spark, sf).drop("condition")), ["split", "condition_index"], ["auroc", "balanced_accuracy"])


@query("pivot_wide", sql(*BASE, METRICS_BY_SPLIT, select="SELECT split, round(max(auroc) FILTER (WHERE condition_index = 0), 6) AS auroc_0, round(max(auroc) FILTER (WHERE condition_index = 1), 6) AS auroc_1, round(max(auroc) FILTER (WHERE condition_index = 20), 6) AS auroc_20 FROM mm GROUP BY split"))
def pivot_wide(spark, sf):
    return rounded(compare.wide_form(by_split(spark, sf), ["split"], "condition_index", [0, 1, 20], "auroc", "auroc_"))


@query("metric_reconcile", sql(*BASE, METRICS_BY_SPLIT, select="SELECT split, condition_index, 'auroc' AS metric, round(auroc, 6) AS computed, round(auroc + CASE WHEN condition_index % 5 = 0 THEN 0.01 ELSE 0 END, 6) AS published FROM mm WHERE condition_index % 5 = 0"))
def metric_reconcile(spark, sf):
    computed = by_split(spark, sf)
    published = computed.withColumn("auroc", F.col("auroc") + F.when(F.col("condition_index") % 5 == 0, 0.01).otherwise(0.0))
    return rounded(audit.reconcile(computed, published, ["split", "condition_index"], [], ["auroc", "balanced_accuracy"]))


@query("snapshot_sql", sql(MANIFEST, select="SELECT architecture, count(*) AS rows, sum(byte_size)::BIGINT AS bytes FROM manifest GROUP BY architecture HAVING count(*) > 10"))
def snapshot_sql(spark, sf):
    return spark.sql("SELECT architecture, count(*) AS rows, sum(byte_size) AS bytes FROM {manifest} GROUP BY architecture HAVING count(*) > 10", manifest=manifest(spark, sf))


@query("slice_overlay", sql(*CLEAN_BASE, select="SELECT 'base' AS report, split, count(*) AS rows FROM predictions WHERE split <> 'validation' GROUP BY split UNION ALL SELECT 'overlay', split, count(*) FROM predictions WHERE split = 'validation' GROUP BY split"))
def slice_overlay(spark, sf):
    counts = predictions(spark, sf, clean_only=True).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(F.when(F.col("split") == "validation", "overlay").otherwise("base").alias("report"), "split", "rows")


@query("candidate_gate", sql(*BASE, METRICS_BY_SPLIT, "h AS (SELECT condition_index, round(avg(auroc), 6) AS auroc, round(avg(balanced_accuracy), 6) AS accuracy FROM mm GROUP BY condition_index)", select="SELECT condition_index, auroc, accuracy FROM h WHERE accuracy >= 0.5 ORDER BY auroc DESC, accuracy DESC, condition_index LIMIT 1"))
def candidate_gate(spark, sf):
    rows = by_split(spark, sf).groupBy("condition_index").agg(F.round(F.avg("auroc"), 6).alias("auroc"), F.round(F.avg("balanced_accuracy"), 6).alias("accuracy"))
    return compare.gated_winner(rows, F.col("accuracy") >= 0.5, F.desc("auroc"), F.desc("accuracy"), F.col("condition_index"))


@query("acceptance", sql(*BASE, SECOND, METRICS_BY_SPLIT, MM_B, select="SELECT split, round(b.auroc - a.auroc, 6) AS gain, round(a.balanced_accuracy - b.balanced_accuracy, 6) AS worst_loss, b.auroc - a.auroc >= 0 AND a.balanced_accuracy - b.balanced_accuracy <= 0.05 AS accepted FROM mm a JOIN mm_b b USING (split, condition_index) WHERE condition_index = 0"))
def acceptance(spark, sf):
    a, b = (by_split(spark, sf, s).filter("condition_index = 0") for s in (1, 2))
    return rounded(compare.accept_if(a, b, "split", "auroc", 0.0, ["balanced_accuracy"], 0.05))


# Statistics and kernels


def _cells_sql(keys: str, scores: str = "pred", source: str = "predictions") -> str:
    """Rows counted by their scores, and the totals of each of keys."""
    return f"""
cells AS (SELECT {keys}, {scores}, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {source} GROUP BY ALL),
totals AS (SELECT {keys}, sum(p) AS all_p, sum(n) AS all_n FROM cells GROUP BY ALL),
poisson AS (SELECT c, list(total ORDER BY k) AS cdf
            FROM (SELECT c, k, sum(exp(-c + k * ln(c) - lgamma(k + 1))) OVER (PARTITION BY c ORDER BY k) AS total FROM range(1, 65) t(c), range(0, 160) s(k)) GROUP BY c)"""


def _drawn_sql(keys: str, scores: str, rounds: int = 1000) -> str:
    """Each cell once a round, round 0 with its own counts."""

    def one(count: str, tag: str) -> str:
        digest = digest_sql("0", f"'{tag}'", *[c.strip() for c in f"{keys}, {scores}".split(",")], "block")
        return f"""SELECT {keys}, {scores}, 0 AS round, {count} AS w FROM cells WHERE {count} > 0
  UNION ALL
  SELECT {keys}, {scores}, block * 4 + slot + 1 AS round, CASE WHEN {count} <= 64 THEN len(list_filter(cdf, lambda x: x < u)) ELSE greatest(0, floor({count} + sqrt({count}) * z + (z * z - 1) / 6 + 0.5))::BIGINT END AS w
  FROM (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z
        FROM (SELECT *, (('0x' || substring(digest, slot * 16 + 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS u, (('0x' || substring(digest, slot * 16 + 9, 8))::BIGINT + 1) / 4294967296.0::DOUBLE AS v
              FROM (SELECT *, {digest} AS digest FROM cells, (SELECT range AS block FROM range({-(-rounds // 4)})) WHERE {count} > 0), range(4) r(slot))) LEFT JOIN poisson ON c = {count}
  WHERE block * 4 + slot < {rounds}"""

    return f"""
drawn_p AS ({one("p", "1")}),
drawn_n AS ({one("n", "0")})"""


def _line_sql(keys: str) -> str:
    """The metrics of each of keys and round, from drawn (keys, round, score, pos, neg)."""
    on = ", ".join(["round", *[k.strip() for k in keys.split(",")]])
    shares = {"recall": ("tp", "p", "all_p"), "fpr": ("fp", "n", "all_n"), "bpos": ("bp", "p", "all_p"), "bneg": ("bn", "n", "all_n")}
    made = ", ".join(f"CASE WHEN {rows} = 0 THEN 0 WHEN {drawn} > 0 THEN {part} / {drawn} END AS {name}" for name, (part, drawn, rows) in shares.items())
    tp, fp = "recall * all_p", "fpr * all_n"
    rates = {
        "accuracy": div(f"{tp} + all_n - {fp}", "(all_p + all_n)"), "balanced_accuracy": "(recall + CASE WHEN all_n = 0 THEN 0 ELSE 1 - fpr END) / 2", "precision": div(tp, f"({tp} + {fp})"), "recall": "recall", "specificity": "CASE WHEN all_n = 0 THEN 0 ELSE 1 - fpr END",
        "f1": div(f"2 * {tp}", f"({tp} + {fp} + all_p)"), "auroc": "CASE WHEN p > 0 AND n > 0 THEN area / (p * n) END", "brier": div("bpos * all_p + bneg * all_n", "(all_p + all_n)"),
    }
    listed = " UNION ALL ".join(f"SELECT {on}, '{m}' AS metric, ({v})::DOUBLE AS value FROM sums" for m, v in rates.items())
    return f"""
line AS (SELECT *, sum(neg) OVER (PARTITION BY {on} ORDER BY score) - neg AS below FROM drawn),
sums AS (
  SELECT *, {made} FROM (
    SELECT {on}, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, coalesce(sum(pos) FILTER (WHERE score >= 0.5), 0)::DOUBLE AS tp, coalesce(sum(neg) FILTER (WHERE score >= 0.5), 0)::DOUBLE AS fp,
           sum(pos * (below + neg / 2.0::DOUBLE)) AS area, sum(pos * (1 - score) ** 2) AS bp, sum(neg * score ** 2) AS bn
    FROM line GROUP BY {on}) JOIN totals USING ({keys})),
metrics AS ({listed})"""


def _interval_sql(keys: str, estimate: str, source: str) -> str:
    q = ", ".join(f"round(quantile_cont(value, {s}) FILTER (WHERE round > 0) + {NUDGE}, 6) AS {n}" for n, s in (("low", 0.025), ("high", 0.975)))
    return f"SELECT {keys}, round(max(value) FILTER (WHERE round = 0) + {NUDGE}, 6) AS {estimate}, {q} FROM {source} GROUP BY {keys}"


def _summed_sql(keys: str) -> str:
    """pos and neg of each score, from what was drawn of each label."""
    return f"""
drawn AS (SELECT {keys}, round, pred AS score, sum(pos) AS pos, sum(neg) AS neg
          FROM (SELECT *, w AS pos, 0 AS neg FROM drawn_p UNION ALL SELECT *, 0 AS pos, w AS neg FROM drawn_n) GROUP BY ALL)"""


@query("bootstrap_intervals", analogues.sql(*CLEAN_BASE, _cells_sql("condition"), _drawn_sql("condition", "pred"), _summed_sql("condition"), _line_sql("condition"), select=_interval_sql("condition, metric", "estimate", "metrics")))
def bootstrap_intervals(spark, sf):
    return rounded(resample.bootstrap(predictions(spark, sf, clean_only=True), "condition"))


PAIRED = """
drawn AS (SELECT condition, side, round, score, sum(pos) AS pos, sum(neg) AS neg
          FROM (SELECT condition, round, w AS pos, 0 AS neg, unnest([{'side': -1, 'score': pred}, {'side': 1, 'score': pred_b}], recursive := true) FROM drawn_p
                UNION ALL SELECT condition, round, 0 AS pos, w AS neg, unnest([{'side': -1, 'score': pred}, {'side': 1, 'score': pred_b}], recursive := true) FROM drawn_n) GROUP BY ALL)"""


@query(
    "paired_bootstrap",
    analogues.sql(
        *TWO, _cells_sql("condition", "pred, pred_b", "both_scores"), _drawn_sql("condition", "pred, pred_b"), PAIRED, _line_sql("condition, side").replace("USING (condition, side)", "USING (condition)"),
        "gaps AS (SELECT condition, round, metric, CASE WHEN count(value) = 2 THEN sum(side * value) END AS value FROM metrics GROUP BY ALL)", select=_interval_sql("condition, metric", "delta", "gaps"),
    ),
)
def paired_bootstrap(spark, sf):
    return rounded(resample.paired_bootstrap(both_scores(spark, sf), "condition", "pred", "pred_b"))


COHORTS = "cohorts AS (SELECT *, CASE WHEN split = 'train' THEN 'seen' ELSE 'unseen' END AS cohort FROM predictions)"


@query(
    "cohort_bootstrap",
    analogues.sql(
        *CLEAN_BASE, COHORTS, _cells_sql("condition, cohort", "pred", "cohorts"), _drawn_sql("condition, cohort", "pred"), _summed_sql("condition, cohort"), _line_sql("condition, cohort"),
        "gaps AS (SELECT condition, round, CASE WHEN count(value) = 2 THEN sum(CASE WHEN cohort = 'unseen' THEN value ELSE -value END) END AS value FROM metrics WHERE metric = 'auroc' GROUP BY ALL)", select=_interval_sql("condition", "delta_auroc", "gaps"),
    ),
)
def cohort_bootstrap(spark, sf):
    rows = predictions(spark, sf, clean_only=True).withColumn("cohort", F.when(F.col("split") == "train", "seen").otherwise("unseen"))
    return rounded(resample.cohort_bootstrap(rows, "condition", "cohort", ["seen", "unseen"]))


@query("platt_fit")
def platt_fit(spark, sf):
    rows = predictions(spark, sf).withColumn("logit", S.logit(F.col("pred")))
    return stats.fit_views(rows, ["condition"])


@query("temperature_fit")
def temperature_fit(spark, sf):
    rows = predictions(spark, sf, clean_only=True).withColumn("logit", S.logit(F.col("pred")))
    return stats.fit_views(rows, ["architecture"], temperature_only=True)


@query("quality_features", sql("""
px AS (SELECT vec_id, y, x, least(abs(embedding[8 * y + x + 1]), 1)::DOUBLE AS v FROM embeddings, (SELECT range AS y FROM range(8)), (SELECT range AS x FROM range(8))),
steps AS (SELECT range - 1 AS s FROM range(3)),
around AS (SELECT n.vec_id, sum(w) / 9 AS local, abs(sum(w) FILTER (WHERE abs(down) + abs(across) = 1) - 4 * any_value(p.v)) AS laplacian, any_value(p.v) AS v
           FROM (SELECT vec_id, y, x, v FROM px) p JOIN (SELECT a.vec_id, a.y, a.x, b.v AS w, h.s AS down, k.s AS across FROM px a, steps h, steps k, px b
                 WHERE b.vec_id = a.vec_id AND b.y = CASE a.y + h.s WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.y + h.s END AND b.x = CASE a.x + k.s WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.x + k.s END) n
           ON n.vec_id = p.vec_id AND n.y = p.y AND n.x = p.x GROUP BY n.vec_id, p.y, p.x),
slope AS (SELECT a.vec_id, (avg(abs(b.v - a.v)) FILTER (WHERE b.y = a.y) + avg(abs(b.v - a.v)) FILTER (WHERE b.x = a.x)) / 2 AS gradient
          FROM px a JOIN px b ON a.vec_id = b.vec_id AND (b.y = a.y AND b.x = a.x + 1 OR b.x = a.x AND b.y = a.y + 1) GROUP BY a.vec_id),
facts AS (SELECT vec_id, avg(laplacian) AS laplacian, avg(abs(v - local)) AS noise, stddev_pop(v) AS deviation FROM around GROUP BY vec_id)""", select="""
SELECT vec_id, round(ln(1 + 100 * gradient), 6) AS gradient_energy, round(ln(1 + 100 * laplacian), 6) AS laplacian_energy, round(0::DOUBLE, 6) AS blockiness,
       round(ln(1 + 100 * noise), 6) AS residual_noise, round(ln(1 + laplacian / greatest(gradient, 1e-6)), 6) AS resolution_proxy, round(ln(1 + 10 * deviation), 6) AS dynamic_range FROM facts JOIN slope USING (vec_id)"""))
def quality_features(spark, sf):
    """Of vectors as images of 8 x 8; none of these has a block edge inside."""
    rows = t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.greatest(F.abs(x), F.lit(0.0)), F.lit(1.0))).alias("pixels"))
    made = rows.select("vec_id", kernels.quality_features_udf("pixels", F.lit(8)).alias("f"))
    return rounded(made.select("vec_id", *[F.element_at("f", i).alias(name) for i, name in enumerate(kernels.QUALITY_FEATURES, 1)]))


@query("perceptual_hash")
def perceptual_hash(spark, sf):
    rows = t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.abs(x), F.lit(1.0))).alias("pixels"))
    return rows.select("vec_id", kernels.perceptual_hash_udf("pixels", F.lit(8)).alias("phash"))


#: Conditions whose views are made twice.
AUDITED = [
    {"name": "clean"}, {"name": "jpeg", "params": {"quality": 50}}, {"name": "gaussian_noise", "params": {"sigma": 0.05, "seed": 3}}, {"name": "strict_random_six", "params": {"seed": 11}},
    {"name": "chain", "params": {"transforms": kernels.chain({"resize": {"scale": 0.5}, "gaussian_noise": {"sigma": 0.02}})}}, {"name": "harmonise", "params": {"size": 16}},
]


@query("transform_audit", f"SELECT view::INTEGER AS view, count(*) AS views, 0::BIGINT AS mismatched FROM embeddings, range({len(AUDITED)}) r(view) GROUP BY view")
def transform_audit(spark, sf):
    """Vectors as gray images of 8 x 8, their views made twice."""
    level = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor(F.least(F.abs(x), F.lit(1.0)) * 255)), 2, "0"))
    rows = t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(level, "")).alias("pixels"), F.lit("ok").alias("status"))
    found = images.view_mismatches(rows, AUDITED, F.col("path").cast("long"))
    return found.groupBy("view").agg(F.count(F.lit(1)).alias("views"), F.count_if(F.col("status") != "ok").alias("mismatched"))


@query("branch_share", "SELECT vec_id, round(CASE WHEN t = 0 THEN 0 ELSE abs(a) / t END, 6) AS share_a, round(CASE WHEN t = 0 THEN 0 ELSE abs(b) / t END, 6) AS share_b FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, abs(embedding[1]::DOUBLE) + abs(embedding[2]::DOUBLE) AS t FROM embeddings)")
def branch_share(spark, sf):
    from ..functions.identity import ratio

    a, b = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    return t(spark, sf, "embeddings").select("vec_id", F.round(ratio(F.abs(a), F.abs(a) + F.abs(b)), 6).alias("share_a"), F.round(ratio(F.abs(b), F.abs(a) + F.abs(b)), 6).alias("share_b"))
