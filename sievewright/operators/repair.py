"""Repair rounds: rows that repeat or conflict are replaced until none is left.

Each round is a plan over immutable tables: losers are found by a join, each
loser's k-th in its identity takes the k-th best unused candidate of the same
identity (a rank on both sides and an equi-join, which is what taking them one
after another gives), and the new selection is written before the next round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_losers(selection: DataFrame, losers: DataFrame, candidates: DataFrame, ident: str, identity: Sequence[str], loser_order: Sequence[str | Column], candidate_order: Sequence[str | Column]) -> DataFrame:
    """selection without losers, plus as many unused candidates of the same identity. losers and candidates have selection's columns; fails where an identity has too few candidates."""
    lost = losers.withColumn("_k", F.row_number().over(Window.partitionBy(*identity).orderBy(*loser_order))).select(*identity, "_k")
    free = candidates.join(selection.select(ident), ident, "left_anti").join(losers.select(ident), ident, "left_anti")
    ranked = free.withColumn("_k", F.row_number().over(Window.partitionBy(*identity).orderBy(*candidate_order)))
    taken = ranked.join(lost, [*identity, "_k"], "left_semi").drop("_k")
    short = lost.join(ranked.select(*identity, "_k"), [*identity, "_k"], "left_anti").limit(1).collect()
    if short:
        raise ValueError(f"no candidate left for {short[0].asDict()}")
    return selection.join(losers.select(ident), ident, "left_anti").unionByName(taken.select(*selection.columns))


def repair(selection: DataFrame, find_losers: Callable[[DataFrame], DataFrame], replace: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame], keep: Callable[[DataFrame, int], DataFrame], ident: str, max_rounds: int = 20) -> tuple[DataFrame, int]:
    """(selection, rounds). find_losers gives rows to go; replace(selection, losers, attempted) gives the next selection, where attempted has the ids of all losers so far; keep writes a round's table and reads it back."""
    attempted: DataFrame | None = None
    for n in range(max_rounds):
        losers = keep(find_losers(selection), n)
        if losers.isEmpty():
            return selection, n
        ids = losers.select(ident)
        attempted = ids if attempted is None else attempted.unionByName(ids)
        selection = keep(replace(selection, losers, attempted), n)
    if not find_losers(selection).isEmpty():
        raise RuntimeError(f"still conflicts after {max_rounds} rounds")
    return selection, max_rounds


def exact_duplicate_losers(selection: DataFrame, key: str, order: Column) -> DataFrame:
    """All but the first row of each key by a unique order."""
    ordered = selection.withColumn("_order", order)
    firsts = ordered.groupBy(key).agg(F.min("_order").alias("_first"))
    return ordered.join(firsts, key).filter("_order > _first").select(*selection.columns)


def needed_candidates(losers: DataFrame, candidates: DataFrame, ident: str, identity: Sequence[str], cell: Sequence[str], digest: str, same_cell_first: bool) -> DataFrame:
    """The candidates that replace_sequentially can come to, at most three for each loser of an identity.

    With L losers no more than L candidates go, so of one cell no more than its first L matter. Leaving the cell, a loser finds one among the first 2 L of those, as L at most are of its own cell. Staying in it, one that finds its cell empty takes one of the first L of all; a cell gives those of its own that are among these, and then one to each of its own losers.
    """
    keys, own = list(identity), list(cell)
    lost = losers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lost"))
    at_home = losers.groupBy(*keys, *own).agg(F.count(F.lit(1)).alias("_home"))
    most = lost.agg(F.max("_lost")).first()[0] or 0
    order = [F.col(digest), F.col(ident)]
    first = candidates.select(ident, *keys, *own, digest).join(lost, keys).withColumn("_c", F.row_number().over(Window.partitionBy(*keys, *own).orderBy(*order))).filter(F.col("_c") <= F.lit(most)).filter("_c <= _lost")
    placed = first.withColumn("_g", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if not same_cell_first:
        return placed.filter(F.col("_g") <= F.lit(2 * most)).filter("_g <= 2 * _lost").drop("_lost", "_c", "_g")
    among = F.count(F.when(F.col("_g") <= F.col("_lost"), 1)).over(Window.partitionBy(*keys, *own))
    return placed.withColumn("_among", among).join(at_home, [*keys, *own], "left").filter("_g <= _lost OR _c <= _among + coalesce(_home, 0)").drop("_lost", "_c", "_g", "_among", "_home")


def replace_sequentially(losers: DataFrame, candidates: DataFrame, ident: str, identity: Sequence[str], cell: Sequence[str], digest: str, same_cell_first: bool) -> DataFrame:
    """loser, replacement: inside each identity the losers in order of id each take the best candidate that is left, by (same cell or not, digest, id). Ids are unique.

    same_cell_first keeps a replacement in the loser's row group where it can, otherwise it leaves it where it can. A loser without a candidate has a null replacement. A group gets its losers and at most three candidates for each (needed_candidates), however many there are, and its time grows with n log n: the best of each cell is in a heap.
    """
    import heapq

    import pandas as pd

    keys, own = list(identity), list(cell)

    def pick(lost: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple, list] = {}
        for d, name, home in sorted(zip(free[digest], free[ident], free[own].itertuples(index=False, name=None), strict=True), reverse=True) if len(free) else []:
            cells.setdefault(home, []).append((d, name))  # the best at the end
        heads = [(*rest[-1], home) for home, rest in cells.items()]
        heapq.heapify(heads)

        def best(other_than: tuple | None) -> tuple | None:
            """The cell with the best candidate, another one than that. Heads that have gone are dropped on the way."""
            aside = None
            while heads:
                head = heads[0]
                rest = cells[head[2]]
                if not rest or rest[-1] != head[:2]:
                    heapq.heappop(heads)
                    if rest:
                        heapq.heappush(heads, (*rest[-1], head[2]))
                elif head[2] == other_than:
                    aside = heapq.heappop(heads)
                else:
                    break
            found = heads[0][2] if heads else None
            if aside:
                heapq.heappush(heads, aside)
            return found

        rows = []
        for name, home in sorted(zip(lost[ident], lost[own].itertuples(index=False, name=None), strict=True)) if len(lost) else []:
            at_home = home if cells.get(home) else None
            at = (at_home or best(None)) if same_cell_first else (best(home) or at_home)
            rows.append((name, cells[at].pop()[1] if at else None))
        return pd.DataFrame(rows, columns=["loser", "replacement"])

    kind = dict(candidates.dtypes)[ident]
    needed = needed_candidates(losers, candidates, ident, keys, own, digest, same_cell_first)
    # new columns, as both tables may be parts of one
    needed = needed.select(*[F.col(c).alias(c) for c in needed.columns])
    return losers.select(*[F.col(c).alias(c) for c in (ident, *keys, *own)]).groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInPandas(pick, f"loser {kind}, replacement {kind}")
