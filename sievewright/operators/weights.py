"""Sampling weights: inverse frequency and hierarchical mass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Mass of each class.
CLASS_MASS = {"real": 0.5, "aigi": 0.5}


def inverse_frequency(rows: DataFrame, *group: Column | str) -> DataFrame:
    """weight = 1 / rows of the group. The counts are a small aggregate joined back, so no group has to fit in one task."""
    named = {f"_g{i}": (g if isinstance(g, Column) else F.col(g)) for i, g in enumerate(group)}
    keyed = rows.withColumns(named)
    counts = keyed.groupBy(*named).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return keyed.join(counts, list(named)).drop(*named)


def hierarchical_mass(rows: DataFrame, family_mass: dict[str, float], generator_alpha: float, source_alpha: float, views: int, label: str = "label", architecture: str = "architecture", generator: str = "generator_id", source: str = "source_dataset") -> DataFrame:
    """row_mass and weight (mass of each of `views` items) of every row.

    Half the mass is of each class. Positives share theirs by family, inside a family by generator in proportion to rows ** generator_alpha; negatives by source in proportion to rows ** source_alpha; equal shares inside a group. Fails on a family that has no mass or has mass but no rows, on blank names, on labels other than 0 and 1, and on exponents that are not finite or negative.
    """
    for name, alpha in (("generator_alpha", generator_alpha), ("source_alpha", source_alpha)):
        if not math.isfinite(alpha) or alpha < 0:
            raise ValueError(f"{name} must be finite and not negative")
    if views < 1:
        raise ValueError("at least one view is needed")
    cells = rows.groupBy(F.col(label).alias("_label"), F.when(F.col(label) == 1, F.trim(architecture)).otherwise("").alias("_family"), F.when(F.col(label) == 1, F.trim(generator)).otherwise(F.trim(source)).alias("_member")).agg(F.count(F.lit(1)).alias("_n"))
    seen = cells.groupBy("_label", "_family").agg(F.count_if(F.coalesce("_member", F.lit("")) == "").alias("blank")).collect()
    if any(r["_label"] not in (0, 1) or r["blank"] for r in seen):
        raise ValueError("labels must be 0 or 1 and names not blank")
    families = {r["_family"] for r in seen if r["_label"] == 1}
    if families != set(family_mass) or not any(r["_label"] == 0 for r in seen):
        raise ValueError(f"families differ: {sorted(families ^ set(family_mass))}, or a class is empty")
    crossing = cells.filter("_label = 1").groupBy("_member").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(5).collect()
    if crossing:
        raise ValueError(f"generators of several families: {[r['_member'] for r in crossing]}")
    mass_of = F.create_map(*[F.lit(x) for pair in family_mass.items() for x in pair])
    powered = cells.withColumn("_w", F.pow(F.col("_n").cast("double"), F.when(F.col("_label") == 1, generator_alpha).otherwise(source_alpha)))
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy("_label", "_family"))
    top = F.when(F.col("_label") == 1, CLASS_MASS["aigi"] * F.element_at(mass_of, F.col("_family"))).otherwise(CLASS_MASS["real"])
    masses = powered.withColumn("row_mass", top * share / F.col("_n")).select("_label", "_family", "_member", "row_mass")
    keyed = rows.withColumns({"_label": F.col(label), "_family": F.when(F.col(label) == 1, F.trim(architecture)).otherwise(""), "_member": F.when(F.col(label) == 1, F.trim(generator)).otherwise(F.trim(source))})
    return keyed.join(masses, ["_label", "_family", "_member"]).drop("_label", "_family", "_member").withColumn("weight", F.col("row_mass") / views)


def weighted_draw(rows: DataFrame, key: str, weight: str, n: int, seed: int | str, bucket_rows: int = 100_000) -> DataFrame:
    """draw, key: n draws with replacement, uniform numbers from digests, each matched to the row whose stretch of the running weight holds it.

    Rows lie in order of a bucket, the first hex digits of their key's digest, and then of the key. There are so many digits, two at least, that a bucket has about bucket_rows rows; the running weight is summed inside buckets and then across them. The unit interval is cut into as many cells as there are rows, 4096 at least, so that a draw meets a few rows by an equi-join on the cell.
    """
    from ..functions.identity import stable_digest, uniform

    n_rows = rows.count()
    digits = max(2, math.ceil(math.log(max(1, n_rows / bucket_rows), 16)))
    bucketed = rows.select(key, F.col(weight).cast("double").alias("_w"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits).alias("_b")).filter("_w > 0")
    before = bucketed.groupBy("_b").agg(F.sum("_w").alias("_s"))
    before = before.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_start"), F.sum("_s").over(Window.partitionBy()).alias("_total"))
    inside = F.sum("_w").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    high = (F.col("_start") + F.col("_in")) / F.col("_total")
    small = 16**digits <= 1 << 20
    runs = bucketed.withColumn("_in", inside).join(F.broadcast(before) if small else before, "_b").select(key, (high - F.col("_w") / F.col("_total")).alias("low"), high.alias("high"))
    cells = max(4096, n_rows)
    runs = runs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform(stable_digest(seed, F.col("id"))) * 0.9999999999).alias("u")).withColumn("_cell", F.floor(F.col("u") * cells))
    return draws.join(runs, "_cell").filter("u >= low AND u < high").select("draw", key)
