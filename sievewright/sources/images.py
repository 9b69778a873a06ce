"""Images through Spark's own decoder, as pixel arrays for the kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels

# Limits of an accepted file.
MOST_BYTES, MOST_PIXELS = 20 << 20, 50_000_000


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, channels, pixels (blue, green, red bytes, row by row), status: `ok`, or `undecodable` for a file that the decoder refuses."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"), F.when(F.col("image.width") > 0, "ok").otherwise("undecodable").alias("status"))


def within_limits(images: DataFrame, files: DataFrame, most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """images with `too_large` as the status of those over a limit; files: path and length."""
    sized = images.join(files.select("path", "length"), "path", "left")
    over = (F.col("length") > most_bytes) | (F.col("width").cast("long") * F.col("height") > most_pixels)
    return sized.withColumn("status", F.when((F.col("status") == "ok") & F.coalesce(over, F.lit(False)), "too_large").otherwise(F.col("status")))


def to_array(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Height x width x 3 in [0, 1], red first; gray images have equal channels, a fourth channel is left out."""
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(float) / 255
    return np.repeat(a, 3, 2) if channels == 1 else a[..., 2::-1][..., :3]


@F.pandas_udf(T.StructType([T.StructField("phash", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType()))]))
def _describe(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.DataFrame:
    images = [to_array(p, w, h, c) for p, w, h, c in zip(pixels, width, height, channels, strict=True)]
    return pd.DataFrame({"phash": [f"{kernels.perceptual_hash(i):016x}" for i in images], "features": [kernels.quality_features(i).tolist() if min(i.shape[:2]) > 1 else [0.0] * 6 for i in images]})


def describe(images: DataFrame) -> DataFrame:
    """Adds sha256 of the pixels, perceptual hash and quality features of decoded images."""
    good = images.filter("status = 'ok'")
    d = _describe("pixels", "width", "height", "channels")
    return good.withColumns({"sha256": F.sha2("pixels", 256), "_d": d}).select(*good.columns, "sha256", "_d.phash", "_d.features")


def to_bytes(image: np.ndarray) -> bytes:
    """The pixels of an image as to_array takes them: blue, green, red."""
    flat = np.repeat(image[..., None], 3, 2) if image.ndim == 2 else image
    return np.round(np.clip(flat, 0, 1)[..., ::-1] * 255).astype(np.uint8).tobytes()


MADE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("intact", T.BooleanType())])


def _made(matrix: Sequence[dict]):
    @F.pandas_udf(MADE)
    def make(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, position: pd.Series, view: pd.Series) -> pd.DataFrame:
        out = []
        for p, w, h, c, row, v in zip(pixels, width, height, channels, position, view, strict=True):
            spec, source = matrix[int(v)], to_array(p, w, h, c)
            kept = source.copy()
            image = kernels.apply_transform(source, spec["name"], spec.get("params") or {}, int(row))
            out.append((image.shape[1], image.shape[0], to_bytes(image), bool((source == kept).all())))
        return pd.DataFrame(out, columns=["width", "height", "pixels", "intact"])

    return make


def transformed(images: DataFrame, matrix: Sequence[dict], position: Column) -> DataFrame:
    """Each decoded image under each condition of the matrix, in order: path, view, width, height, channels, pixels, and intact, whether the source is as before. Noise and random draws take their seed plus the image's position, so a view is the same in any partition."""
    for spec in matrix:  # a condition that is none is found before a task is
        kernels.steps_of(spec["name"], spec.get("params") or {})
    rows = images.filter("status = 'ok'").withColumn("_position", position).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(len(matrix) - 1))))
    made = rows.select("path", "view", _made(matrix)("pixels", "width", "height", "channels", "_position", "view").alias("m"))
    return made.select("path", "view", "m.width", "m.height", F.lit(3).alias("channels"), "m.pixels", "m.intact")


def all_views(images: DataFrame, matrix: Sequence[dict], position: Column) -> DataFrame:
    """path, view and the digest of the pixels that transformed makes."""
    return transformed(images, matrix, position).select("path", "view", F.sha2("pixels", 256).alias("digest"))


def harmonised(images: DataFrame, size: int = 224, quality: int = 90) -> DataFrame:
    """Decoded images as a model takes them: a square of that size through one JPEG round trip. path, width, height, channels, pixels."""
    return transformed(images, [{"name": "harmonise", "params": {"size": size, "quality": quality}}], F.lit(0)).drop("view", "intact")


def view_mismatches(images: DataFrame, matrix: Sequence[dict], position: Column, parts: tuple[int, int] = (3, 7)) -> DataFrame:
    """Every view made twice, under two partitionings, and joined: path, view, first, second (digests) and status: `ok`, `differs`, `missing` in one of them, or `source changed`. parts: numbers of partitions; where a run has fewer than there are cores, both are multiplied by as much as it takes to give each core one."""
    runs = []
    times = -(-images.sparkSession.sparkContext.defaultParallelism // min(parts))
    for n, name in zip(parts, ("first", "second"), strict=True):
        dealt = images.repartition(n * times, F.xxhash64("path", F.lit(n)))
        made = transformed(dealt, matrix, position)
        runs.append(made.select("path", "view", F.sha2("pixels", 256).alias(name), F.col("intact").alias(f"{name}_intact")))
    joined = runs[0].join(runs[1], ["path", "view"], "full")
    status = F.when(F.col("first").isNull() | F.col("second").isNull(), "missing").when(F.col("first") != F.col("second"), "differs").when(~F.col("first_intact") | ~F.col("second_intact"), "source changed").otherwise("ok")
    return joined.select("path", "view", "first", "second", status.alias("status"))
