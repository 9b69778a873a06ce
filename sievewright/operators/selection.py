"""Deterministic sampling: ranks by digest, quotas, round robin, compact picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import stable_digest
from .scan import scanned


def top_n_per_group(rows: DataFrame, group: str | Sequence[str], n: int | Column, *order: Column | str, most: int | None = None) -> DataFrame:
    """The first n rows of each group. Where n is a column, `most` is a number that it never passes: with a constant a map task keeps its first rows of a group only, so groups may be few and large."""
    window = Window.partitionBy(group) if isinstance(group, str) else Window.partitionBy(*group)
    ranked = rows.withColumn("_rank", F.row_number().over(window.orderBy(*order)))
    if most is not None:
        ranked = ranked.filter(F.col("_rank") <= most)
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def round_robin(rows: DataFrame, group: str, total: int, group_order: Column, *row_order: Column | str) -> DataFrame:
    """The first of each group, then the second of each, until total rows: a sort by (rank in the group, rank of the group)."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*row_order)))
    return ranked.filter(F.col("_rank") <= total).orderBy("_rank", group_order, group).limit(total).drop("_rank")


def round_robin_within(rows: DataFrame, part: str, group: str, total: int, *row_order: Column | str) -> DataFrame:
    """round_robin in natural order of groups, for each value of part."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(part, group).orderBy(*row_order))).filter(F.col("_rank") <= total)
    return ranked.withColumn("_turn", F.row_number().over(Window.partitionBy(part).orderBy("_rank", group))).filter(F.col("_turn") <= total).drop("_rank", "_turn")


def compact_order(scope: Column | str, seed: int | str, cell: Sequence[str], row_digest: Column, by: Sequence[str] = ()) -> tuple[dict[str, Column], list[Column]]:
    """Columns and order that prefer cells with most rows, then the cell's digest, then the row's."""
    added = {"_cell_rows": F.count(F.lit(1)).over(Window.partitionBy(*by, *cell)), "_cell": stable_digest(seed, scope, "row-group", *[F.col(c) for c in cell]), "_row": row_digest}
    return added, [F.desc("_cell_rows"), F.col("_cell"), F.col("_row")]


def compact_pick(rows: DataFrame, count: int, seed: int | str, scope: str, cell: Sequence[str], row_digest: Column) -> DataFrame:
    """count rows out of as few cells (row groups of a file) as possible."""
    added, order = compact_order(scope, seed, cell, row_digest)
    return rows.withColumns(added).orderBy(*order).limit(count).drop(*added)


def balanced_compact(rows: DataFrame, group: str, count: int, seed: int | str, scope: str, cell: Sequence[str], row_digest: Column) -> DataFrame:
    """compact_pick in each group, with count div groups rows each and one more for the first groups in order of their digest."""
    groups = rows.select(group).distinct().withColumn("_digest", stable_digest(seed, scope, "generator", F.col(group)))
    n = groups.count()
    if not n:
        return rows
    quotas = groups.withColumn("_quota", F.lit(count // n) + (F.row_number().over(Window.orderBy("_digest", group)) <= count % n).cast("int")).drop("_digest")
    added, order = compact_order(F.concat(F.lit(f"{scope}:"), F.col(group)), seed, cell, row_digest, [group])
    ranked = rows.withColumns(added).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= count // n + 1)
    return ranked.join(F.broadcast(quotas) if n <= 100_000 else quotas, group).filter(F.col("_rank") <= F.col("_quota")).drop(*added, "_rank", "_quota")


def largest_remainder(sizes: DataFrame, key: str, size: str, total: int, ascending_key: bool = False) -> DataFrame:
    """key, size, quota: shares of total in proportion to size, rounded down, and one more for the largest fractions; ties by size and then key, falling (or by key, rising). sizes has a row for each group."""
    whole = Window.partitionBy()
    if ascending_key:
        order = [F.desc("_fraction"), F.col(key)]
    else:
        order = [F.desc("_fraction"), F.desc(size), F.desc(key)]
    exact = sizes.select(key, size, F.sum(size).over(whole).alias("_all")).withColumns({"_floor": F.floor(F.lit(total) * F.col(size) / F.col("_all")), "_fraction": F.pmod(F.lit(total) * F.col(size), F.col("_all"))})
    left = exact.withColumns({"_left": F.lit(total) - F.sum("_floor").over(whole), "_rank": F.row_number().over(Window.orderBy(*order))})
    return left.select(key, size, F.least(F.col(size), F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quota"))


def stratified_pick(members: DataFrame, stratum: str, member: str, total: int, seed: int | str, forced: Sequence[str] = ()) -> DataFrame:
    """total members: forced ones, then those with the lowest digests in each stratum, by largest-remainder quotas."""
    rest = members.filter(~F.col(member).isin(*forced)) if forced else members
    quotas = largest_remainder(rest.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")), stratum, "size", total - len(forced))
    ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(stable_digest(seed, F.col(stratum), F.col(member)))))
    picked = ranked.join(quotas.select(stratum, "quota"), stratum).filter(F.col("_rank") <= F.col("quota")).select(*members.columns)
    return picked.unionByName(members.filter(F.col(member).isin(*forced))) if forced else picked


def rare_preserving_pick(members: DataFrame, stratum: str, member: str, total: int, seed: int | str, rare: int = 5) -> DataFrame:
    """All members of strata with at most `rare`, the others by quotas with ties by rising key."""
    sized = members.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(stratum)))
    few, many = sized.filter(F.col("_n") <= rare).drop("_n"), sized.filter(F.col("_n") > rare).drop("_n")
    left = total - few.count()
    quotas = largest_remainder(many.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")), stratum, "size", left, ascending_key=True)
    ranked = many.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(stable_digest(seed, F.col(stratum), F.col(member)))))
    return few.unionByName(ranked.join(quotas.select(stratum, "quota"), stratum).filter(F.col("_rank") <= F.col("quota")).select(*members.columns))


def feasible_contribution(sizes: DataFrame, size: str, total: int, top: int = 1000, bottom: int = 10, step: int = 10) -> DataFrame:
    """The largest equal contribution c, of top, top - step, ... bottom, that divides total and that total / c groups can give."""
    tries = [c for c in range(top, bottom - 1, -step) if total % c == 0]
    counts = sizes.agg(*[F.count_if(F.col(size) >= c).alias(f"n{c}") for c in tries])
    rows = F.array(*[F.struct(F.lit(c).alias("contribution"), F.lit(total // c).alias("needed"), F.col(f"n{c}").alias("available")) for c in tries])
    best = F.array_max(F.filter(rows, lambda r: r["available"] >= r["needed"]))
    return counts.select(best.alias("b")).select("b.contribution", F.col("b.needed").alias("groups_needed"), F.col("b.available").alias("groups_available"))


def ordered_split(rows: DataFrame, by: Sequence[str], order: Column, first: int, names: tuple[str, str] = ("validation", "train")) -> DataFrame:
    """The first rows of each group by a unique order go to the first split. The order's value at the cut is found from the first rows alone, so no task ranks a whole group."""
    keyed = rows.withColumn("_order", order)
    cuts = top_n_per_group(keyed.select(*by, "_order"), by, first, "_order").groupBy(*by).agg(F.max("_order").alias("_cut"))
    return keyed.join(cuts, list(by), "left").withColumn("project_split", F.when(F.col("_order") <= F.col("_cut"), names[0]).otherwise(names[1])).drop("_order", "_cut")


def representative(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The least row of each group, by a partial aggregation."""
    rest = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(group, *[f"_r.{c}" for c in rest])


def global_rank(rows: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    """rows with `position`, counted from 0 in order of a unique key (null first), without bringing all rows to one task. n_rows: their number, if it is known."""
    return scanned(rows, [], [key], rank="position", at_most=n_rows)


def contiguous_shards(rows: DataFrame, n_shards: int, key: str) -> DataFrame:
    """Shard of each row in order of a unique key, where shard i holds positions N * i div k up to N * (i + 1) div k."""
    n = rows.count()
    return global_rank(rows, key, n).withColumn("shard", F.floor(((F.col("position") + 1) * n_shards - 1) / F.lit(max(1, n))).cast("int"))


def byte_cap(rows: DataFrame, by: Sequence[str], size: str, cap: int, *order: str) -> DataFrame:
    """Rows of each group, in an order that is unique in it, until their sizes pass the cap."""
    return scanned(rows, by, order, running={"running_bytes": size}).filter(F.col("running_bytes") <= cap)


def cut_from_top(rows: DataFrame, key: str, value: str, amount: int, name: str = "cut") -> DataFrame:
    """rows with how many of `amount` units go from each, where each unit is taken from the row that has most left, the least key of equal ones. Values are whole numbers and hold that many units together.

    The greatest values come down to a common level. How many take part follows from running sums along the falling values: the first k for which what they have over the next value is enough.
    """
    if amount <= 0:
        return rows.withColumn(name, F.lit(0).cast("long"))
    line = scanned(rows.withColumn("_down", -F.col(value)), [], ["_down", key], running={"_sum": value}, after={"_next": value}, rank="_k").withColumn("_k", F.col("_k") + 1)
    enough = F.col("_sum") - F.col("_k") * F.coalesce("_next", F.lit(0)) >= amount
    k, total = line.filter(enough).agg(F.min(F.struct("_k", "_sum")).alias("m")).select("m.*").first()
    if k is None:
        raise ValueError(f"the rows do not hold {amount} units")
    level, higher = divmod(total - amount, k)
    taking = scanned(line.filter(F.col("_k") <= k), [], [key], rank="_place", at_most=k)
    stays = F.lit(level) + (F.col("_place") >= k - higher).cast("long")
    cut = taking.withColumn(name, F.col(value) - stays)
    rest = line.filter(F.col("_k") > k).withColumn(name, F.lit(0).cast("long"))
    return cut.select(*rows.columns, name).unionByName(rest.select(*rows.columns, name))


def rounded_quota(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """key, size, quota by the third rule: shares rounded half to even, then one less for the largest quota, or one more for the largest slack, until the sum fits; the least key of equal ones."""
    everything = sizes.agg(F.sum(size)).first()[0] or 0
    if total > everything:
        raise ValueError("more is asked for than there is")
    share = F.bround(F.lit(total) * F.col(size) / F.lit(float(max(1, everything))), 0).cast("long")
    quota = sizes.select(key, size, F.least(F.col(size), share).alias("quota")).withColumn("_slack", F.col(size) - F.col("quota"))
    extra = (quota.agg(F.sum("quota")).first()[0] or 0) - total
    moved = cut_from_top(quota, key, "quota" if extra > 0 else "_slack", abs(extra), "_moved")
    return moved.select(key, size, (F.col("quota") - F.col("_moved") if extra > 0 else F.col("quota") + F.col("_moved")).alias("quota"))


def whole_group_holdout(groups: DataFrame, family: str, group: str, size: str, target: int, seed: int) -> DataFrame:
    """Groups to hold out whole, with their size: the smallest of each family first, then others in order of their digest while they fit, then the one that overshoots least.

    One that does not fit never will, so the others are taken a run at a time: running sums tell how far they fit, the one behind is passed over, those too large for what is left drop out, and so on. A run brings two numbers to the driver.
    """
    keyed = groups.select(family, group, F.col(size).cast("long").alias(size), F.sha2(F.concat(F.lit(f"{seed}\x1f"), F.col(group)), 256).alias("_order"))
    first = keyed.groupBy(family).agg(F.min_by(F.struct(group, size, "_order"), F.struct(size, group)).alias("r")).select(family, f"r.{group}", f"r.{size}", "r._order")
    left = target - (first.agg(F.sum(size)).first()[0] or 0)
    rest = keyed.join(first.select(group), group, "left_anti")
    runs: list[Column] = []
    after = ""
    while left > 0:
        fits = (F.col("_order") > after) & (F.col(size) <= left)
        line = scanned(rest.filter(fits), [], ["_order"], running={"_sum": size})
        got, stop = line.agg(F.max(F.when(F.col("_sum") <= left, F.col("_sum"))), F.min(F.when(F.col("_sum") > left, F.col("_order")))).first()
        runs.append(fits & (F.col("_order") < stop) if stop else fits)
        left -= got or 0
        if not stop:
            break
        after = stop
    taken = F.lit(False)
    for run in runs:
        taken = taken | run
    chosen = first.unionByName(rest.filter(taken).select(*first.columns))
    if left > 0:
        others = rest.filter(~taken)
        best = others.agg(F.min_by(group, F.struct(F.col(size) - left, group))).first()[0]
        chosen = chosen.unionByName(others.filter(F.col(group) == best).select(*first.columns))
    return chosen.drop("_order")
