"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. run() writes every stage's rows as Parquet and reads them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import compression, decontaminate, exact_dedup, ngram_join, packing
from sievewright.llm.common import Scratch, table, written

#: Bytes of ids that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 32 << 20


def _few(rows: DataFrame) -> DataFrame:
    """rows, broadcast where their number proves them small."""
    return F.broadcast(rows) if rows.count() * 16 <= MOST_BROADCAST else rows


def _drop(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is not among ids. The ids are counted: where they are few, the texts do not move."""
    return docs.join(_few(written(ids, "dropped")), "doc_id", "left_anti").select(*docs.columns)


def _by_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows that their id tells from all others, and the rest, which repeat an id or have none; None if there is no such row."""
    repeated = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs, None
    some = _few(repeated)
    odd = docs.join(some, docs["doc_id"].eqNullSafe(some["doc_id"]), "left_semi")
    return docs.filter("doc_id IS NOT NULL").join(_few(repeated.filter("doc_id IS NOT NULL")), "doc_id", "left_anti").select(*docs.columns), odd.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score at least 0.3). It learns from labelled rows with crc32(doc_id) mod 5 other than 0."""
    model = compression.fit(docs, table(spark, sf_dir, "labels"), "quality", compression.remainder("doc_id", 5) != 0)
    return compression.accepted(docs, model, 0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, though rows may repeat an id or have none: of those that could stay alike, one with the longest text, then the least hash of it."""
    judged = written(exact_dedup.exact_dedup(docs), "judged")
    plain, odd = _by_id(docs)
    kept = _drop(plain, judged.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    if odd is None:
        return kept
    text = F.coalesce("text", F.lit(""))
    keyed = odd.withColumn("_sha", F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256))
    stays = judged.filter("kept").select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep")).distinct()
    could = keyed.join(stays, "_sha").filter(F.col("doc_id").eqNullSafe(F.col("_keep")))
    row = F.struct(*[F.col(c) for c in docs.columns])
    return kept.unionByName(could.groupBy("_sha").agg(F.min_by(row, F.struct(-F.length(text), F.xxhash64(text))).alias("r")).select("r.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar documents, that with the smallest id; one without an id stays only where no member has one. Rows that repeat an id are told apart by a hash of id and text; such rows with one text are one."""
    plain, odd = _by_id(docs)
    if odd is None:
        judged = ngram_join.jaccard_join(docs)
        return _drop(docs, judged.filter("component_id <> doc_id").select("doc_id"))
    odd = written(odd.withColumn("_key", F.xxhash64("doc_id", "text")).dropDuplicates(["_key"]), "odd")
    every = plain.select(F.col("doc_id").alias("_key"), "text").unionByName(odd.select("_key", "text"))
    judged = ngram_join.jaccard_join(every, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id")
    # ids of the odd rows; all others are keys themselves
    ids = odd.select("_key", F.lit(True).alias("odd"), F.col("doc_id").alias("own"))
    named = judged.join(_few(ids), "_key", "left").withColumn("id", F.when(F.col("odd"), F.col("own")).otherwise(F.col("_key")))
    first = named.groupBy("component_id").agg(F.min_by("_key", F.struct(F.col("id").isNull(), "id", "_key")).alias("first"))
    gone = written(named.join(first, "component_id").filter("_key <> first").select("_key", "odd"), "gone")
    kept = _drop(plain, gone.filter("odd IS NULL").select(F.col("_key").alias("doc_id")))
    return kept.unionByName(odd.join(_few(gone.filter("odd").select("_key")), "_key", "left_anti").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the first, the fourth and the last stage; tests compare all with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table is deleted when the next one stands; the last stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    before = Scratch(spark)
    for name, stage in STAGES:
        now = Scratch(spark)
        docs = now.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        before.clear()
        before = now
    return docs
