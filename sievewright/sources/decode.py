"""From a folder of image files to pixels as they are to be seen, in one plan with two phases.

Spark's decoder takes whole folders, so a file that it should not see must not
be in one. The first phase judges every file from its bytes (verify.py), puts
the accepted ones into a staging folder under the digest of their path, and
writes a row for each file; a small file that claims a huge picture is turned
away there, before anything is decoded. The second decodes the staging folder,
joins the rows back and turns pixels by their orientation. Staged names depend
on the path alone, so a task that runs again writes the same file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import oriented
from .images import MOST_BYTES, MOST_PIXELS, read_images
from .verify import COLUMNS, INSPECTED, WHOLE, judged, readable

TURNED = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())])


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it; Hadoop writes file:/x for file:///x."""
    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


def stage(spark: SparkSession, folder: str, staging: str, most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """The rows of verify.inspected for every file below folder, with `staged`, the name of the copy of an accepted one. Written to staging/judged; copies are in staging/files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    where = f"{staging.rstrip('/')}/files"

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(where)
        for batch in batches:
            rows = []
            for path, length, content in zip(batch["path"], batch["length"], batch["content"], strict=True):
                row, name = judged(path, length, content, most_bytes, most_pixels), None
                if row[COLUMNS.index("status")] == "ok":
                    name = hashlib.sha256(path.encode()).hexdigest()
                    store.create_dir(f"{base}/{name[:2]}", recursive=True)
                    with store.open_output_stream(f"{base}/{name[:2]}/{name}") as out:
                        out.write(content)
                rows.append((*row, name))
            yield pd.DataFrame(rows, columns=[*COLUMNS, "staged"]).astype(WHOLE)

    readable(files, most_bytes=most_bytes).mapInPandas(copy, f"{INSPECTED}, staged string").write.mode("overwrite").parquet(f"{staging.rstrip('/')}/judged")
    return spark.read.parquet(f"{staging.rstrip('/')}/judged")


@F.pandas_udf(TURNED)
def _turned(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, orientation: pd.Series) -> pd.DataFrame:
    out = []
    for p, w, h, c, o in zip(pixels, width, height, channels, orientation, strict=True):
        a = oriented(np.frombuffer(p, np.uint8).reshape(h, w, c), int(o))
        out.append((a.shape[1], a.shape[0], a.tobytes()))
    return pd.DataFrame(out, columns=["width", "height", "pixels"])


def decoded(spark: SparkSession, folder: str, staging: str, most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """path, format, orientation, width, height, channels, pixels and status of every file below folder: pixels of the first frame, turned as they are to be seen (blue, green, red bytes, row by row); null for a file that was turned away (its status says why) or that the decoder refused (`undecodable`). staging: a folder that the driver and all workers reach, for the copies; the caller deletes it when the result is no longer read. Spark lists no file without bytes. A folder without an accepted file gives the rows alone."""
    rows = stage(spark, folder, staging, most_bytes, most_pixels)
    kept = ["path", "format", "orientation", "status", "staged"]
    if rows.filter("staged IS NOT NULL").isEmpty():
        return rows.select("path", "format", "orientation", "width", "height", F.lit(None).cast("int").alias("channels"), F.lit(None).cast("binary").alias("pixels"), "status")
    read = read_images(spark, f"{staging.rstrip('/')}/files").filter("status = 'ok'").select(F.substring_index("path", "/", -1).alias("staged"), "channels", "pixels", F.col("width").alias("w"), F.col("height").alias("h"))
    good = read.join(rows.select("staged", "orientation"), "staged").withColumn("t", _turned("pixels", "w", "h", "channels", "orientation")).select("staged", "channels", "t.width", "t.height", "t.pixels")
    every = rows.select(*kept).join(good, "staged", "left")
    status = F.when((F.col("status") == "ok") & F.col("pixels").isNull(), "undecodable").otherwise(F.col("status"))
    return every.select("path", "format", "orientation", "width", "height", "channels", "pixels", status.alias("status"))
