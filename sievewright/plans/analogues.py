"""Stand-ins for the corpus tables, built from the driver's tables by the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import stable_digest, uniform

N_CONDITIONS = 21


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: sample_id, label, architecture (language), generator_id (source), digest of the text, size, split."""
    first = F.substring(F.sha2(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 256), 1, 1)
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return rows.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("sample_id"),
        "doc_id",
        F.col("quality").alias("label"),
        F.col("lang").alias("architecture"),
        F.col("source").alias("generator_id"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("byte_size"),
        F.when(first < "b", "train").when(first < "d", "validation").otherwise("test").alias("split"),
    )


MANIFEST = """
manifest AS (
  SELECT 'doc_' || d.doc_id AS sample_id, d.doc_id, l.quality AS label, d.lang AS architecture, d.source AS generator_id,
         sha256(d.text) AS sha256, d.n_chars AS byte_size,
         CASE WHEN substr(sha256('split:' || d.doc_id), 1, 1) < 'b' THEN 'train'
              WHEN substr(sha256('split:' || d.doc_id), 1, 1) < 'd' THEN 'validation' ELSE 'test' END AS split
  FROM documents d JOIN labels l USING (doc_id))"""


def conditions(spark: SparkSession) -> DataFrame:
    return spark.range(N_CONDITIONS).select(F.col("id").cast("int").alias("condition_index"), condition_name(F.col("id")).alias("condition"))


def condition_name(index: Column) -> Column:
    return F.when(index == 0, "clean").otherwise(F.concat(F.lit("condition_"), index.cast("string")))


CONDITIONS = """
conditions AS (
  SELECT range::INTEGER AS condition_index, CASE WHEN range = 0 THEN 'clean' ELSE 'condition_' || range END AS condition FROM range(21))"""


def predictions(spark: SparkSession, sf: str, seed: int = 1, clean_only: bool = False) -> DataFrame:
    """manifest's rows under each condition with a score: three decimals, so that scores tie."""
    rows = manifest(spark, sf)
    indices = F.array(F.lit(0)) if clean_only else F.sequence(F.lit(0), F.lit(N_CONDITIONS - 1))
    rows = rows.withColumn("condition_index", F.explode(indices))
    pred = F.round(uniform(stable_digest(seed, F.col("sample_id"), F.col("condition_index"))) * 0.7 + F.col("label") * 0.3, 3)
    return rows.withColumns({"condition": condition_name(F.col("condition_index")), "pred": pred})


def pred_sql(seed: int = 1, name: str = "predictions", where: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT m.*, c.condition_index, c.condition,
         round(('0x' || substring(sha256('{seed}' || chr(31) || m.sample_id || chr(31) || c.condition_index), 1, 8))::BIGINT / 4294967295.0 * 0.7 + 0.3 * m.label, 3) AS pred
  FROM manifest m CROSS JOIN conditions c WHERE {where})"""


def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of files by row group: a generator is a supplier, its architecture the supplier's nation."""
    suppliers = t(spark, sf, "supplier").join(F.broadcast(t(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = t(spark, sf, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.lit("lineitem").alias("dataset_key"),
        F.concat(F.lit("part-"), (F.col("l_orderkey") % 7).cast("string")).alias("source_file"),
        F.floor(F.col("l_orderkey") / 1000).cast("int").alias("row_group"),
        (F.col("l_orderkey") % 1000 * 10 + F.col("l_linenumber")).cast("long").alias("row_index"),
        F.concat(F.lit("img_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("image_name"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("label"),
        F.concat(F.lit("gen-"), F.col("l_suppkey").cast("string")).alias("canonical_generator_id"),
        F.col("n_name").alias("architecture"),
        F.when(F.col("l_linestatus") == "O", "Train").otherwise("test").alias("official_split"),
        F.col("l_quantity").cast("int").alias("width"),
        F.col("l_linenumber").cast("int").alias("height"),
        F.floor(F.col("l_extendedprice")).cast("long").alias("byte_size"),
    )


SOURCE = """
source_rows AS (
  SELECT 'lineitem' AS dataset_key, 'part-' || (l_orderkey % 7) AS source_file, (l_orderkey // 1000)::INTEGER AS row_group,
         l_orderkey % 1000 * 10 + l_linenumber AS row_index, 'img_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS image_name,
         CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label, 'gen-' || l_suppkey AS canonical_generator_id, n_name AS architecture,
         CASE WHEN l_linestatus = 'O' THEN 'Train' ELSE 'test' END AS official_split, l_quantity::INTEGER AS width, l_linenumber::INTEGER AS height,
         floor(l_extendedprice)::BIGINT AS byte_size
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

#: SQL of a digest: parts are SQL expressions.
def digest_sql(*parts: str) -> str:
    return "sha256(" + " || chr(31) || ".join(f"coalesce(({p})::VARCHAR, 'None')" for p in parts) + ")"


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select
