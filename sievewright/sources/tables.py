"""Readers and writers: manifests, predictions, locators, atomic sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import is_safe_path
from ..operators.audit import Check, require, where
from ..operators.dedup import first_by

LOCATOR = ["dataset_key", "source_file", "row_group", "row_index"]
# Columns that a manifest must have; fields of a prediction.
REQUIRED = ("sample_id", "path", "label", "split", "source_dataset", "generator_id")
PREDICTION = T.StructType([T.StructField(n, t) for n, t in (("sample_id", T.StringType()), ("image_path", T.StringType()), ("label", T.IntegerType()), ("pred", T.DoubleType()), ("transform", T.StringType()), ("transform_params", T.StringType()))])


def scan(spark: SparkSession, path: str, columns: Sequence[str], binary_labels: str | None = None) -> DataFrame:
    """Metadata columns of Parquet shards; fails where one is missing; other labels than 0 and 1 are dropped. Projection and filter reach the scan."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    df = df.select(*columns)
    return df.filter(F.col(binary_labels).isin(0, 1)) if binary_labels else df


def route(df: DataFrame, cases: Sequence[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """CASE over rows: the first condition that holds gives the constants; rows without one are dropped."""
    names = list(cases[0][1])

    def pick(name: str) -> Column:
        return reduce(lambda chain, c: chain.when(c[0], c[1][name]), cases[1:], F.when(cases[0][0], cases[0][1][name]))

    return df.withColumns({n: pick(n) for n in names}).filter(reduce(lambda a, b: a | b, [c[0] for c in cases]))


def pinned_files(df: DataFrame, prefix: str, expected: Sequence[str]) -> list[str]:
    """Names of the Parquet files under prefix, sorted; fails where they are not the expected ones."""
    found = sorted(m[1] for f in df.inputFiles() if (m := re.search(rf"({re.escape(prefix)}[^/]*\.parquet)$", f)))
    if found != sorted(expected):
        raise ValueError(f"files differ: {sorted(set(found) ^ set(expected))[:5]}")
    return found


def probe(df: DataFrame, histogram_of: Sequence[str]) -> DataFrame:
    """column, value, rows for each histogram column, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in histogram_of])).alias("h")
    return df.select(each).select("h.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def read_csv(spark: SparkSession, path: str | list[str], required: Sequence[str] = ()) -> DataFrame:
    """Lenient: all columns as text under the header's names; fails where a required one is missing."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Strict: required columns that are not empty, labels 0 or 1, safe relative paths, unique ids and paths, at least one row."""
    df = read_csv(spark, path, REQUIRED)
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in REQUIRED]
    require(
        [
            Check("empty", df, F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)),
            Check("blank", df, where(reduce(lambda a, b: a | b, blank))),
            Check("label", df, where(~F.coalesce(F.col("label"), F.lit("")).isin("0", "1"))),
            Check("path", df, where(~is_safe_path(F.col("path")))),
            Check("repeated id", df, F.count("sample_id") - F.count_distinct("sample_id")),
            Check("repeated path", df, F.count("path") - F.count_distinct("path")),
        ]
    )
    return df.withColumn("label", F.col("label").cast("int"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that is no JSON fails, blank lines are skipped."""
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def union_manifests(spark: SparkSession, paths: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Manifests in order of name, without those whose name has an excluded token; the first row of each locator, and all rows without one."""
    names = [p for p in sorted(paths) if not any(t in p.rsplit("/", 1)[-1] for t in exclude)]
    frames = [read_csv(spark, p).withColumn("_file", F.lit(i)).withColumn("_row", F.monotonically_increasing_id()) for i, p in enumerate(names)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    located = reduce(lambda a, b: a & b, [F.coalesce(F.trim(c), F.lit("")) != "" for c in LOCATOR])
    kept = first_by(every.filter(located), LOCATOR, "_file", "_row")
    return kept.unionByName(every.filter(~F.coalesce(located, F.lit(False)))).drop("_file", "_row")


def fetch(source: DataFrame, wanted: DataFrame, payload: str) -> DataFrame:
    """Payloads of wanted locators. Only the payload and the locator are read; the wanted side is small beside the source."""
    return source.select(*LOCATOR, payload).join(wanted.select(*LOCATOR).distinct(), LOCATOR, "left_semi")


def payload_bytes(df: DataFrame, column: str) -> Column:
    """Bytes of a payload that is binary, or a struct with a field `bytes`."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BinaryType):
        return F.col(column)
    if isinstance(kind, T.StructType) and "bytes" in kind.names:
        return F.col(f"{column}.bytes")
    raise TypeError(f"{column} holds no payload: {kind.simpleString()}")


def images_in(spark: SparkSession, folder: str, suffixes: Sequence[str] = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")) -> DataFrame:
    """path and length of image files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.filter(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))


def two_class_layout(files: DataFrame, classes: tuple[str, str] = ("REAL", "FAKE"), splits: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Files of the one root that has both splits with both classes; fails where there is none or more than one."""
    parts = F.regexp_extract("path", rf"^(.*)/({'|'.join(splits)})/({'|'.join(classes)})/[^/]+$", 1)
    placed = files.withColumns({"root": parts, "split": F.regexp_extract("path", rf"/({'|'.join(splits)})/({'|'.join(classes)})/[^/]+$", 1), "class": F.regexp_extract("path", rf"/({'|'.join(splits)})/({'|'.join(classes)})/[^/]+$", 2)}).filter("root <> ''")
    roots = [r["root"] for r in placed.groupBy("root").agg(F.count_distinct("split", "class").alias("n")).filter("n = 4").limit(2).collect()]
    if len(roots) != 1:
        raise ValueError(f"expected one layout, found {len(roots)}")
    return placed.filter(F.col("root") == roots[0])


def union_of_keys(frames: Sequence[DataFrame], preferred: Sequence[str] = ()) -> DataFrame:
    """All rows; columns are the preferred ones, then those of the first frame, then later ones as they appear. Fails without frames."""
    if not frames:
        raise ValueError("no rows to write")
    names = list(dict.fromkeys([*(c for c in preferred if any(c in f.columns for f in frames)), *(c for f in frames for c in f.columns)]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*names)


def rows_as_json(frames: dict[str, DataFrame]) -> DataFrame:
    """distribution, row_json: rows of unlike tables in one."""
    return reduce(DataFrame.unionByName, [f.select(F.lit(n).alias("distribution"), F.to_json(F.struct(*sorted(f.columns))).alias("row_json")) for n, f in frames.items()])


def write_complete(df: DataFrame, path: str, audit: dict) -> None:
    """Parquet under path, then an audit record beside it; a reader trusts the table only with the record, which is written last and names the table's digest."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    back = df.sparkSession.read.parquet(f"{path}/data")
    digest = back.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
    digest.withColumn("audit", F.lit(json.dumps(audit, sort_keys=True))).coalesce(1).write.mode("overwrite").json(f"{path}/COMPLETE")


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """The table of write_complete; fails where its record is missing or differs."""
    record = spark.read.schema("rows long, digest string, audit string").json(f"{path}/COMPLETE").first()
    back = spark.read.parquet(f"{path}/data")
    now = back.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    if record is None or (record["rows"], record["digest"]) != (now["rows"], now["digest"]):
        raise ValueError(f"{path} is not complete")
    return back


def backfill(plan: DataFrame, existing: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Plan rows whose file exists take its attributes and are complete; others stay pending."""
    have = existing.select(key, *[F.col(a).alias(f"_have_{a}") for a in attributes], F.lit(True).alias("_have"))
    out = plan.join(have, key, "left").withColumn("status", F.when(F.col("_have"), "complete").otherwise("pending"))
    return out.withColumns({a: F.coalesce(F.col(f"_have_{a}"), F.col(a)) if a in plan.columns else F.col(f"_have_{a}") for a in attributes}).drop("_have", *[f"_have_{a}" for a in attributes])


def transform_key(spec: dict) -> str:
    """Name of a condition: parameters in order of name without the seed, parts of a composite joined."""
    params = spec.get("params") or {}
    if "transforms" in params:
        return "__".join(transform_key(t) for t in params["transforms"])
    tail = "_".join(f"{k}={params[k]}" for k in sorted(params) if k != "seed")
    return f"{spec['name']}__{tail}" if tail else spec["name"]


def stage_text(spec: dict) -> str:
    """For people: stages with arrows between them, seeds hidden."""
    params = spec.get("params") or {}
    if "transforms" in params:
        return " -> ".join(stage_text(t) for t in params["transforms"])
    shown = ", ".join(f"{k}={params[k]}" for k in sorted(params) if k != "seed")
    return f"{spec['name']}({shown})" if shown else spec["name"]


def deep_merge(base: dict, over: dict) -> dict:
    """A configuration with another laid over it."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def canonical_digest(value: object) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole JSON document, of one object or a list of them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_cache(spark: SparkSession, path: str, views: Sequence[str], arrays: Sequence[str], lineage: Sequence[str] = ()) -> DataFrame:
    """Shards of cached scores: each array column has a value for each view, ids are unique, and each lineage column has one value over all shards."""
    df = spark.read.parquet(path)
    checks = [Check("repeated id", df, F.count("sample_id") - F.count_distinct("sample_id"))]
    checks += [Check(f"shape of {a}", df, where(F.size(a) != len(views))) for a in arrays]
    checks += [Check(f"lineage {c}", df, F.when(F.count_distinct(c) <= 1, 0).otherwise(1)) for c in lineage]
    require(checks)
    return df


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and status of each manifest row against the files: `missing`, `size`, `digest` or `ok`. files: path, byte_size, sha256."""
    have = files.select("path", F.col("byte_size").alias("_size"), F.col("sha256").alias("_sha"))
    joined = manifest.join(have, "path", "left")
    return joined.select("path", F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("byte_size"), "size").when(F.col("_sha") != F.lower("sha256"), "digest").otherwise("ok").alias("status"))


def pending(plan: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a resumed job has still to do."""
    return plan.join(done.select(*key).distinct(), list(key), "left_anti")


def provenance(spark: SparkSession, name: str, sql: str, tables: Sequence[str], filters: Sequence[str] = ()) -> DataFrame:
    """A record of how a result was made."""
    return spark.createDataFrame([(name, "spark", sql, list(tables), list(filters), canonical_digest(sql))], "name string, engine string, sql string, tables array<string>, filters array<string>, sql_digest string")
