"""Ordered scans of groups of any size: running sums, totals, neighbours, ranks, percentiles.

A window over a whole group puts that group into one task. Here the order of
all groups together is cut into stretches at bounds taken from a sample, so a
large group lies in many stretches and small ones share one. Each stretch is
summed up by a partial aggregation; what stands before it in its group, and
the rows next to its ends, are put into it as rows of their own, and one
window over (group, stretch) does the rest. No join, and no task that holds
more than a stretch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch, about; stretches at most; sampled keys for each.
STRETCH_ROWS, MOST_STRETCHES, SAMPLED = 1 << 20, 4096, 24


def _bounds(rows: DataFrame, key: Sequence[str], n_rows: int, stretch_rows: int) -> list[tuple]:
    """Keys that cut the rows into stretches; the sample is bounded, whatever the rows."""
    n = min(MOST_STRETCHES, -(-n_rows // stretch_rows))
    share = min(1.0, n * SAMPLED / n_rows)
    first = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)])
    drawn = rows.sample(share, seed=1).select(first.alias("k"))
    cuts = drawn.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()
    total, out, seen = sum(r["n"] for r in cuts), [], 0
    for r in cuts:
        if seen * n >= (len(out) + 1) * total:
            out.append(tuple(r["k"]))
        seen += r["n"]
    return out


def _place(key: Column, bounds: Column, n: int) -> Column:
    """How many of n rising bounds are at most the key: a binary search, step by step."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def stretched(rows: DataFrame, by: Sequence[str], order: Sequence[str], n_rows: int, stretch_rows: int = STRETCH_ROWS, name: str = "_stretch") -> DataFrame:
    """rows with the number of their stretch, rising with (by, order), nulls first."""
    key = [*by, *order]
    types = dict(rows.dtypes)
    cuts = _bounds(rows, key, n_rows, stretch_rows)
    if not cuts:
        return rows.withColumn(name, F.lit(0))
    bounds = F.array(*[F.struct(*[F.lit(v).cast(types[k]).alias(f"k{i}") for i, (k, v) in enumerate(zip(key, cut, strict=True))]) for cut in cuts])
    return rows.withColumn(name, _place(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)]), bounds, len(cuts)))


def scanned(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    running: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    before: Mapping[str, str] | None = None,
    after: Mapping[str, str] | None = None,
    rank: str | None = None,
    descending: bool = False,
    at_most: DataFrame | int | None = None,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """rows with new columns made along the order of their group.

    running: new name to the column that is summed over a row and those before it; totals: over the whole group; before, after: the column's value in the neighbouring row, null at the ends; rank: a name for the number of rows before.
    order names columns that are unique in a group; nulls come first, or last where descending. at_most: a number of rows that rows does not pass, or a table with as many, which may be cheaper to count. Where that is no more than a stretch, one window does.
    """
    by, order = list(by), list(order)
    running, totals, before, after = dict(running or {}), dict(totals or {}), dict(before or {}), dict(after or {})
    counted = rows.withColumn("_one", F.lit(1).cast("long")) if rank else rows
    if rank:
        running[rank] = "_one"
    n_rows = at_most if isinstance(at_most, int) else (at_most if at_most is not None else rows).count()
    along = [F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_first() for c in order]
    to_here = (Window.unboundedPreceding, 0)

    def finished(df: DataFrame) -> DataFrame:
        return df.withColumn(rank, F.col(rank) - 1).drop("_one") if rank else df

    if n_rows <= stretch_rows:
        group, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*along)
        made = {name: F.sum(c).over(line.rowsBetween(*to_here)) for name, c in running.items()} | {name: F.sum(c).over(group) for name, c in totals.items()}
        return finished(counted.withColumns(made | {name: F.lag(c).over(line) for name, c in before.items()} | {name: F.lead(c).over(line) for name, c in after.items()}))

    dealt = stretched(counted, by, order, n_rows, stretch_rows)
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    first, last = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)
    sums = {c: f"_sum{i}" for i, c in enumerate(dict.fromkeys([*running.values(), *totals.values()]))}
    ends = [last(F.struct(*before.values()), key).alias("_last")] if before else []
    starts = [first(F.struct(*after.values()), key).alias("_first")] if after else []
    marks = dealt.groupBy(*by, "_stretch").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(s) for c, s in sums.items()], *ends, *starts)
    types = dict(marks.dtypes)
    whole = Window.partitionBy(*by)
    stretches = whole.orderBy(F.desc("_stretch") if descending else F.col("_stretch"))
    over = {f"_r_{name}": F.sum(sums[c]).over(stretches.rowsBetween(Window.unboundedPreceding, -1)) for name, c in running.items()}
    over |= {f"_t_{name}": F.sum(sums[c]).over(whole) for name, c in totals.items()}
    over |= {"_prev": F.lag("_last").over(stretches)} if before else {}
    over |= {"_next": F.lead("_first").over(stretches)} if after else {}
    offsets = marks.withColumns(over)
    head = offsets.select(*by, "_stretch", F.lit(0).alias("_kind"), *[f"_r_{name}" for name in running], *[f"_t_{name}" for name in totals], *[F.col(f"_prev.{c}").alias(f"_b_{name}") for name, c in before.items()])
    extra = {f"_r_{name}": F.col(c).cast(types[sums[c]]) for name, c in running.items()} | {f"_b_{name}": F.col(c) for name, c in before.items()} | {f"_a_{name}": F.col(c) for name, c in after.items()}
    parts = dealt.withColumns({"_kind": F.lit(1), **extra}).unionByName(head, allowMissingColumns=True)
    if after:
        parts = parts.unionByName(offsets.select(*by, "_stretch", F.lit(2).alias("_kind"), *[F.col(f"_next.{c}").alias(f"_a_{name}") for name, c in after.items()]), allowMissingColumns=True)
    line = Window.partitionBy(*by, "_stretch").orderBy("_kind", *along)
    made = {name: F.sum(f"_r_{name}").over(line.rowsBetween(*to_here)) for name in running} | {name: F.max(f"_t_{name}").over(line.rowsBetween(*to_here)) for name in totals}
    made |= {name: F.lag(f"_b_{name}").over(line) for name in before} | {name: F.lead(f"_a_{name}").over(line) for name in after}
    names = [*counted.columns, *running, *totals, *before, *after]
    return finished(parts.withColumns(made).filter("_kind = 1").select(*[F.col(f"`{c}`") for c in dict.fromkeys(names)]))


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], at_most: DataFrame | int | None = None, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """by and a double for each wanted share from 0 to 1, with linear interpolation between the two values around it. Nulls do not count; a group without values has no row.

    Equal values are counted in the map tasks, counts are summed along the order, and the value at a place is the least one whose running count passes it: no buffer holds the values of a group.
    """
    by = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    line = scanned(counts, by, ["_value"], running={"_upto": "_n"}, totals={"_all": "_n"}, at_most=rows if at_most is None else at_most, stretch_rows=stretch_rows)
    aggregates = []
    for i, share in enumerate(wanted.values()):
        place = (F.col("_all") - 1) * F.lit(float(share))
        aggregates += [F.min(F.when(F.col("_upto") > F.floor(place), F.col("_value"))).alias(f"_lo{i}"), F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_value"))).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_part{i}")]
    found = line.groupBy(*by).agg(*aggregates)
    return found.select(*by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).cast("double").alias(name) for i, name in enumerate(wanted)])
