"""Ranking and threshold metrics of scored labels, per group, from one cumulative frame.

Every curve metric starts from rows (group, score, positives, negatives): a
partial aggregation that a map task does before anything shuffles, so ties
count once. Running sums and neighbours come from `scan`, so no task needs a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import ratio
from .scan import scanned


def score_frame(scored: DataFrame, by: Sequence[str], score: str = "pred", label: str = "label", after: Mapping[str, str] | None = None) -> DataFrame:
    """by, score, tp, fp (rows of the score), cum_tp, cum_fp (of it and higher ones), total_p, total_n; after names columns of the next lower score. Rows without a score or label are left out."""
    keys = list(by)
    steps = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("fp"))
    return scanned(steps, keys, ["score"], running={"cum_tp": "tp", "cum_fp": "fp"}, totals={"total_p": "tp", "total_n": "fp"}, after=after, descending=True, at_most=scored)


def auroc_of(tp: str = "tp", fp: str = "fp", cum_tp: str = "cum_tp", p: str = "total_p", n: str = "total_n") -> Column:
    """Mann-Whitney with half credit for ties, over a score frame; null for a group of one class."""
    area = F.sum(F.col(fp) * (F.col(cum_tp) - F.col(tp) / 2.0))
    return F.try_divide(area, F.max(F.col(p) * F.col(n)).cast("double"))


def auroc(scored: DataFrame, by: Sequence[str], score: str = "pred", label: str = "label") -> DataFrame:
    return score_frame(scored, by, score, label).groupBy(*by).agg(auroc_of().alias("auroc"))


def average_precision(scored: DataFrame, by: Sequence[str], score: str = "pred", label: str = "label") -> DataFrame:
    step = F.try_divide(F.col("tp"), F.col("total_p").cast("double")) * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    return score_frame(scored, by, score, label).groupBy(*by).agg(F.sum(step).alias("average_precision"))


def confusion(pred: Column, label: str = "label") -> list[Column]:
    y = F.col(label)
    return [F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 0) & (pred == 1)).alias("fp"), F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 1) & (pred == 1)).alias("tp")]


def from_counts(counts: DataFrame) -> DataFrame:
    """Adds the rates that follow from tn, fp, fn, tp; zero where a denominator is zero."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1, f1_negative = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    product = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "precision": ratio(tp, tp + fp),
            "recall": recall,
            "specificity": specificity,
            "npv": ratio(tn, tn + fn),
            "f1": f1,
            "macro_f1": (f1 + f1_negative) / 2,
            "balanced_accuracy": (recall + specificity) / 2,
            "mcc": F.when(product > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(product)).otherwise(0.0),
            "false_positive_rate": ratio(fp, fp + tn),
            "false_negative_rate": ratio(fn, fn + tp),
            "predicted_positive_rate": ratio(tp + fp, tn + fp + fn + tp),
        }
    )


def threshold_metrics(scored: DataFrame, by: Sequence[str], threshold: float | Column = 0.5, score: str = "pred", label: str = "label") -> DataFrame:
    counts = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *confusion((F.col(score) >= threshold).cast("int"), label))
    return from_counts(counts)


def brier(score: str = "pred", label: str = "label") -> Column:
    return F.avg(F.pow(F.col(score) - F.col(label), 2))


def calibration_error(scored: DataFrame, by: Sequence[str], bins: int = 15, score: str = "pred", label: str = "label") -> DataFrame:
    """Expected calibration error over equal bins, [low, high) but for the last, which is closed."""
    slot = F.least(F.floor(F.col(score) * bins).cast("int"), F.lit(bins - 1)).alias("bin")
    per_bin = scored.groupBy(*by, slot).agg(F.count(F.lit(1)).alias("m"), F.sum(score).alias("s"), F.sum(F.col(label).cast("long")).alias("y"))
    return per_bin.groupBy(*by).agg((F.sum(F.abs(F.col("y") - F.col("s"))) / F.sum("m")).alias(f"ece_{bins}"))


def balanced_threshold(scored: DataFrame, by: Sequence[str], score: str = "pred", label: str = "label") -> DataFrame:
    """The score with the greatest balanced accuracy, the highest of equal ones, within 0 and 1; 0.5 for a group of one class."""
    ba = 0.5 * (F.col("cum_tp") / F.col("total_p") + 1 - F.col("cum_fp") / F.col("total_n"))
    frame = score_frame(scored, by, score, label).withColumn("ba", F.when((F.col("total_p") > 0) & (F.col("total_n") > 0), ba))
    best = F.max_by("score", F.when(F.col("ba").isNotNull(), F.struct(F.round("ba", 12), F.col("score"))))
    return frame.groupBy(*by).agg(F.when(best.isNull(), 0.5).otherwise(F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0))).alias("threshold"), F.max("ba").alias("balanced_accuracy"))


def roc_points(scored: DataFrame, by: Sequence[str], score: str = "pred", label: str = "label") -> DataFrame:
    """Points of the ROC curve that are corners: those in the middle of an evenly spaced straight run are dropped, as common implementations do. (0, 0) is not among the rows."""
    frame = score_frame(scored, by, score, label, after={"tp_after": "tp", "fp_after": "fp"})
    marked = frame.withColumn("straight", F.coalesce((F.col("tp_after") == F.col("tp")) & (F.col("fp_after") == F.col("fp")), F.lit(False)))
    return marked.filter(~F.col("straight")).select(*by, "score", F.try_divide("cum_fp", F.col("total_n").cast("double")).alias("fpr"), F.try_divide("cum_tp", F.col("total_p").cast("double")).alias("tpr"))


def tpr_at_fpr(scored: DataFrame, by: Sequence[str], target: float, score: str = "pred", label: str = "label") -> DataFrame:
    """True positive rate at the last corner of the ROC curve whose false positive rate is at most target."""
    points = roc_points(scored, by, score, label)
    return points.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("fpr") <= target, F.col("tpr"))), F.lit(0.0)).alias("tpr_at_fpr"))


def curve_on_grid(points: DataFrame, by: Sequence[str], x: str, y: str, first: tuple[float, float], n: int = 201, at_most: DataFrame | int | None = None) -> DataFrame:
    """Linear interpolation of points on n even steps from 0 to 1, as a join of each step with the stretch it lies in. Of points with the same x the last y counts. first: the point before all."""
    ends = points.groupBy(*by, F.col(x).alias(x)).agg(F.min(y).alias("y_low"), F.max(y).alias("y_high"))
    placed = scanned(ends, by, [x], before={"_x0": x, "_y0": "y_high"}, at_most=at_most)
    stretch = placed.select(*by, F.coalesce("_x0", F.lit(first[0])).alias("x0"), F.coalesce("_y0", F.lit(first[1])).alias("y0"), F.col(x).alias("x1"), F.col("y_low").alias("y1"), F.col("y_high").alias("y1_top"))
    step = 1.0 / (n - 1)
    # a stretch makes its own grid steps: no join, no pairs that are thrown away
    low, high = F.ceil((F.col("x0") + 1e-12) / step), F.floor((F.col("x1") + 1e-12) / step)
    inside = stretch.filter(low <= high).withColumn("i", F.explode(F.sequence(low, high)))
    at = F.col("i") * step
    value = F.when(F.abs(at - F.col("x1")) <= 1e-12, F.col("y1_top")).otherwise(F.col("y0") + F.try_divide((at - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("x1") - F.col("x0")))
    return inside.select(*by, F.col("i").cast("int").alias("step"), at.alias("x"), value.alias("y"))


def roc_grid(scored: DataFrame, by: Sequence[str], n: int = 201) -> DataFrame:
    """ROC curve on an even grid, from (0, 0) to (1, 1)."""
    grid = curve_on_grid(roc_points(scored, by), by, "fpr", "tpr", (0.0, 0.0), n, scored)
    start = scored.select(*by).distinct().select(*by, F.lit(0).alias("step"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return grid.filter("step > 0").withColumn("y", F.when(F.col("step") == n - 1, 1.0).otherwise(F.col("y"))).unionByName(start)


def pr_grid(scored: DataFrame, by: Sequence[str], n: int = 201) -> DataFrame:
    """Precision over an even grid of recall: the best precision of equal recalls, 1 at the start, the share of positives at the end."""
    frame = score_frame(scored, by).filter("total_p > 0")
    points = frame.select(*by, (F.col("cum_tp") / F.col("total_p")).alias("recall"), (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"), (F.col("total_p") / (F.col("total_p") + F.col("total_n"))).alias("base"))
    best = points.groupBy(*by, "recall").agg(F.max("precision").alias("precision"))
    grid = curve_on_grid(best, by, "recall", "precision", (0.0, 1.0), n, scored)
    base = points.groupBy(*by).agg(F.max("base").alias("base"))
    inner = grid.filter((F.col("step") > 0) & (F.col("step") < n - 1))
    ends = base.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("step"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y")), F.struct(F.lit(n - 1).alias("step"), F.lit(1.0).alias("x"), F.col("base").alias("y")))).alias("e")).select(*by, "e.step", "e.x", "e.y")
    return inner.unionByName(ends)


def pooled_auroc(scored: DataFrame, group: str, by: Sequence[str] = (), score: str = "pred", label: str = "label") -> DataFrame:
    """AUROC of each group of positives against all negatives of `by`, without copying the negatives to each group.

    The running number of negatives below each score is found once for each `by` and joined to the positives by score.
    """
    every = scored.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 0).alias("neg"))
    below = scanned(every, by, ["score"], running={"upto": "neg"}, totals={"total_n": "neg"}, at_most=scored).withColumn("below", F.col("upto") - F.col("neg"))
    positives = scored.filter(F.col(label) == 1).groupBy(*by, group, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("pos"))
    joined = positives.join(below, [*by, "score"])
    return joined.groupBy(*by, group).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), (F.sum("pos") * F.max("total_n")).cast("double")).alias("auroc"))
