"""What the operators share: the shared folder, written tables, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used by sessions of a single machine that name no folder (tests); a cluster must name one.
LOCAL_FALLBACK = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only a session that runs in one process may leave it unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/sievewright-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. This cuts the lineage: lost executors cost no recomputation of what came before, and each row is made once."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop writes file:/x for file:///x."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class Scratch:
    """Written tables of one operator, deleted when its result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: list[str] = []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = shared_path(self._spark, tag)
        self._paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, tag: str) -> DataFrame:
        """df, written; then all that came before is deleted."""
        out = written(df, tag)
        self.clear()
        return out

    def clear(self) -> None:
        conf = self._spark.sparkContext._jsc.hadoopConfiguration()
        for path in self._paths:
            where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self._paths = []


def chosen(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own, so that other columns may have any name."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))



def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Returns a Python worker's free memory to the system; workers live on between tasks, two or more beside one executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over a few rows of a batch at a time, so that few are Python objects at once; free memory goes back when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            give_back()

    return run


def fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
