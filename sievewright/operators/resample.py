"""Bootstrap intervals from counts: no row is copied, and no group is in one task.

Rows are counted by (group, score, label) first. A resample is a Poisson draw
for each count, found from a digest of (seed, label, group, score, round): it
depends on nothing else, so partitions do not matter and a lost task draws the
same again. Weights of a label are scaled to its number of rows, which keeps
labels at their shares, as a stratified resample does. The metrics of all
rounds are sums over the drawn counts; AUROC takes a running sum along the
score (scan.py).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import stable_digest
from .scan import scanned

METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "auroc", "brier")
#: Rounds that one digest serves, 64 of its bits each; counts up to which the draw is exact.
ROUNDS_A_DIGEST, EXACT = 4, 64
#: Cells of a task at most, about, which are few bytes and many draws.
CELLS_A_TASK = 20_000


def poisson_table(most: int = EXACT) -> list[list[float]]:
    """For each mean from 1 to most the distribution function at 0, 1, 2, ... as far as it matters."""
    out = []
    for mean in range(1, most + 1):
        term = total = math.exp(-mean)
        row = [total]
        for k in range(1, mean + 9 * math.isqrt(mean) + 12):
            term *= mean / k
            total += term
            row.append(total)
        out.append(row)
    return out


def _part(digest: Column, at: Column | int) -> Column:
    """32 bits of a digest as a number over 0 and up to 1."""
    start = at if isinstance(at, Column) else F.lit(at)
    return (F.conv(F.substring(digest, start, F.lit(8)), 16, 10).cast("double") + 1) / F.lit(4294967296.0)


def poisson(count: Column, digest: Column, slot: Column, cdf: Column | None = None) -> Column:
    """A draw with mean count (a whole number): by the distribution function up to EXACT, beyond by a normal with the skew corrected, which is off by less than the step between whole numbers. cdf: the distribution function of count, for a caller that has it in its rows."""
    if cdf is None:
        cdf = F.get(F.array(*[F.array(*map(F.lit, row)) for row in poisson_table()]), count.cast("int") - 1)
    first, second = _part(digest, slot * 16 + 1), _part(digest, slot * 16 + 9)
    # a variable of its own for first: inside the search it would be made from the digest again for every step
    exact = F.get(F.transform(F.array(first), lambda u: F.size(F.filter(cdf, lambda x: x < u))), F.lit(0))
    z = F.sqrt(-2 * F.log(first)) * F.cos(2 * math.pi * second)
    wide = F.greatest(F.floor(count + F.sqrt(count) * z + (z * z - 1) / 6 + 0.5), F.lit(0))
    return F.when(count == 0, 0).when(count <= EXACT, exact).otherwise(wide).cast("long")


def _of_slot(name: str, slot: int) -> str:
    return f"_{name}_{slot}"


def _drawn_blocks(cells: DataFrame, counts: Mapping[str, tuple[str, str]], ident: Sequence[str], rounds: int, seed: int | str) -> DataFrame:
    """Each cell once for the rounds that one digest serves: `_block`, and the drawn counts of each slot. Block -1 is round 0 and has the counts themselves in its first slot."""
    table = F.broadcast(cells.sparkSession.createDataFrame([(i, row) for i, row in enumerate(poisson_table(), 1)], "_mean long, _cdf array<double>"))  # EXACT rows
    blocks = -(-rounds // ROUNDS_A_DIGEST)
    n_tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // CELLS_A_TASK))
    each = cells.repartition(n_tasks, *ident).withColumns({f"_i{i}": F.col(c).cast("string") for i, c in enumerate(ident)})
    for name, (column, _) in counts.items():
        each = each.join(table.select(F.col("_mean").alias(f"_m_{name}"), F.col("_cdf").alias(f"_c_{name}")), F.col(column) == F.col(f"_m_{name}"), "left")
    each = each.withColumn("_block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))))
    named = [F.col(f"_i{i}") for i in range(len(ident))]
    each = each.withColumns({f"_d_{name}": F.when((F.col(column) > 0) & (F.col("_block") >= 0), stable_digest(seed, F.lit(tag), *named, F.col("_block").cast("string"))) for name, (column, tag) in counts.items()})
    own = F.col("_block") < 0
    values = {_of_slot(name, i): F.when(own, F.col(column) if i == 0 else F.lit(0)).otherwise(poisson(F.col(column), F.col(f"_d_{name}"), F.lit(i), F.col(f"_c_{name}"))).cast("long") for name, (column, _) in counts.items() for i in range(ROUNDS_A_DIGEST)}
    return each.withColumns(values).drop(*[f"_{kind}_{name}" for kind in "mcd" for name in counts], *[f"_i{i}" for i in range(len(ident))])


def _by_round(blocks: DataFrame, names: Sequence[str], rounds: int) -> DataFrame:
    """Rows of _drawn_blocks, once a round: `round` and the counts by their names."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), *[F.col(_of_slot(name, i)).alias(name) for name in names]) for i in range(ROUNDS_A_DIGEST)])
    each = blocks.withColumn("_s", F.explode(F.when(F.col("_block") < 0, F.slice(slots, 1, 1)).otherwise(slots)))
    each = each.withColumn("round", F.when(F.col("_block") < 0, 0).otherwise(F.col("_block") * ROUNDS_A_DIGEST + F.col("_s.slot") + 1)).withColumns({name: F.col(f"_s.{name}") for name in names})
    return each.filter(F.col("round") <= rounds).drop("_s", "_block", *[_of_slot(name, i) for name in names for i in range(ROUNDS_A_DIGEST)])


def drawn(cells: DataFrame, counts: Mapping[str, tuple[str, str]], ident: Sequence[str], rounds: int, seed: int | str) -> DataFrame:
    """Each cell once a round, with `round` and the drawn counts: new name to (column, text that tells its draws from others'). Round 0 has the counts themselves. ident: columns that tell cells apart."""
    return _by_round(_drawn_blocks(cells, counts, ident, rounds, seed), list(counts), rounds)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def round_metrics(draws: DataFrame, keys: Sequence[str], threshold: float, group_rows: int) -> DataFrame:
    """keys and the eight metrics for each of keys, which tell rounds apart. draws: keys, score (once each), pos, neg (drawn), all_p, all_n (of the group). group_rows: a number that the scores of one of keys do not pass. A round that draws none of a label that has rows has null metrics."""
    line = scanned(draws, keys, ["score"], running={"_upto": "neg"}, at_most=group_rows)
    hit, s = F.col("score") >= threshold, F.col("score")
    sums = line.groupBy(*keys).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.col("pos") * (F.col("_upto") - F.col("neg") / 2.0)).alias("area"),
        F.sum(F.col("pos") * (1 - s) * (1 - s)).alias("bp"), F.sum(F.col("neg") * s * s).alias("bn"),
    )
    all_p, all_n = F.col("all_p"), F.col("all_n")

    def share(part: str, drawn_rows: str, rows: Column) -> Column:
        return F.when(rows == 0, 0.0).when(F.col(drawn_rows) > 0, F.col(part) / F.col(drawn_rows))

    scaled = sums.withColumns({"recall": share("tp", "p", all_p), "_fpr": share("fp", "n", all_n), "_bp": share("bp", "p", all_p), "_bn": share("bn", "n", all_n)})
    tp, fp = F.col("recall") * all_p, F.col("_fpr") * all_n
    rate = {"specificity": F.when(all_n == 0, 0.0).otherwise(1 - F.col("_fpr"))}
    rate |= {"accuracy": _ratio(tp + all_n - fp, all_p + all_n), "precision": _ratio(tp, tp + fp), "f1": _ratio(2 * tp, tp + fp + all_p), "auroc": F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n"))), "brier": _ratio(F.col("_bp") * all_p + F.col("_bn") * all_n, all_p + all_n)}
    return scaled.withColumns(rate).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2).select(*keys, *METRICS)


def intervals(by_round: DataFrame, keys: Sequence[str], value: str, estimate: str) -> DataFrame:
    """keys, the estimate (round 0), low and high: 2.5 and 97.5 percent of the other rounds. A buffer holds a group's rounds."""
    drawn_values = F.percentile(F.when(F.col("round") > 0, F.col(value)), F.array(F.lit(0.025), F.lit(0.975)))
    found = by_round.groupBy(*keys).agg(F.max(F.when(F.col("round") == 0, F.col(value))).alias(estimate), drawn_values.alias("_q"))
    return found.select(*keys, estimate, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def _long(by_round: DataFrame, keys: Sequence[str]) -> DataFrame:
    return by_round.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")).select(*keys, "m.metric", "m.value")


def _cells(scored: DataFrame, keys: Sequence[str], scores: Sequence[str], label: str) -> DataFrame:
    valid = scored.filter(F.col(label).isin(0, 1))
    for s in scores:
        valid = valid.filter(F.col(s).isNotNull())
    y = F.col(label)
    return valid.groupBy(*keys, *scores).agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))


def _with_totals(draws: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """all_p and all_n of each of keys, by a join that compares nulls as equal."""
    totals = cells.groupBy(*keys).agg(F.sum("_p").alias("all_p"), F.sum("_n").alias("all_n"))
    renamed = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "all_p", "all_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return draws.join(renamed, same).drop(*[f"_k{i}" for i in range(len(keys))])


def _largest(cells: DataFrame, keys: Sequence[str]) -> int:
    return cells.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


BOTH = {"pos": ("_p", "1"), "neg": ("_n", "0")}


def bootstrap(scored: DataFrame, by: str, threshold: float = 0.5, rounds: int = 1000, seed: int = 0, score: str = "pred", label: str = "label") -> DataFrame:
    """by, metric, estimate, low and high (2.5 and 97.5 percent) of eight metrics over resamples. Rows without a score, or with a label other than 0 and 1, are left out."""
    cells = _cells(scored, [by], [score], label)
    draws = _with_totals(drawn(cells, BOTH, [by, score], rounds, seed), cells, [by]).withColumnRenamed(score, "score")
    found = round_metrics(draws, [by, "round"], threshold, _largest(cells, [by]))
    return intervals(_long(found, [by, "round"]), [by, "metric"], "value", "estimate")


def paired_bootstrap(scored: DataFrame, by: str, first: str, second: str, threshold: float = 0.5, rounds: int = 1000, seed: int = 0, label: str = "label") -> DataFrame:
    """by, metric, delta, low, high of the differences second - first, where each resample is scored by both: rows are drawn by their two scores together."""
    cells = _cells(scored, [by], [first, second], label)
    both = F.explode(F.array(F.struct(F.lit(-1.0).alias("side"), F.col(first).alias("score")), F.struct(F.lit(1.0).alias("side"), F.col(second).alias("score")))).alias("s")
    # summed by score before there is a row for each round: pairs of scores are many, scores few
    slots = [_of_slot(name, i) for name in BOTH for i in range(ROUNDS_A_DIGEST)]
    blocks = _drawn_blocks(cells, BOTH, [by, first, second], rounds, seed).select(by, "_block", *slots, both)
    summed = blocks.groupBy(by, "_block", "s.side", "s.score").agg(*[F.sum(c).alias(c) for c in slots])
    sides = _with_totals(_by_round(summed, list(BOTH), rounds), cells, [by])
    scores = cells.select(by, both).groupBy(by, "s.side", "s.score").agg(F.count(F.lit(1)))
    found = _long(round_metrics(sides, [by, "round", "side"], threshold, _largest(scores, [by, "side"])), [by, "round", "side"])
    gaps = found.groupBy(by, "round", "metric").agg(F.when(F.count("value") == 2, F.sum(F.col("side") * F.col("value"))).alias("value"))
    return intervals(gaps, [by, "metric"], "value", "delta")


def cohort_bootstrap(scored: DataFrame, by: str, cohort: str, names: Sequence[str], rounds: int = 1000, seed: int = 0, score: str = "pred", label: str = "label") -> DataFrame:
    """by, delta_auroc, low, high: AUROC of the second cohort less that of the first; each is resampled by itself."""
    keys = [by, cohort]
    cells = _cells(scored.filter(F.col(cohort).isin(*names)), keys, [score], label)
    draws = _with_totals(drawn(cells, BOTH, [*keys, score], rounds, seed), cells, keys).withColumnRenamed(score, "score")
    found = round_metrics(draws, [*keys, "round"], 0.5, _largest(cells, keys))
    sign = F.when(F.col(cohort) == names[1], 1.0).otherwise(-1.0)
    gaps = found.groupBy(by, "round").agg(F.when(F.count("auroc") == 2, F.sum(sign * F.col("auroc"))).alias("value"))
    return intervals(gaps, [by], "value", "delta_auroc")
