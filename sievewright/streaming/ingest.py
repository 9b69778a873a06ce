"""Streams with keyed state: a consumer with quotas, and a bounded shuffle buffer.

State is in Spark's state store (RocksDB), keyed so that a micro-batch touches
only what its own rows need: a look-up for each of its keys, a number for each
of its classes, a buffer of fixed size for each of its lanes. Earlier batches
are never read again. A restart from the checkpoint goes on where the last
committed batch ended, and the file sink takes each batch once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.identity import SEPARATOR

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _arrived(rows: Iterator[Row], order: str) -> list[dict]:
    """A key's rows of a micro-batch in order of arrival."""
    return sorted((r.asDict() for r in rows), key=lambda r: r[order])


class FirstOfKey(StatefulProcessor):
    """Marks rows whose key was seen before, in this micro-batch or an earlier one, as duplicates. Keys are looked up one by one."""

    def __init__(self, key: str, kind: str, order: str):
        self.key, self.kind, self.order = key, kind, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"key {self.kind}", "first string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = set()
        for row in _arrived(rows, self.order):
            value = row[self.key]
            if value in now or self.seen.containsKey((value,)):
                row["status"] = "duplicate"
            else:
                self.seen.updateValue((value,), (str(row[self.order]),))
            now.add(value)
            yield Row(**row)

    def close(self) -> None:
        pass


class TakeQuota(StatefulProcessor):
    """Accepts the first rows of a class up to the quota; the others are over it."""

    def __init__(self, order: str, quota: int):
        self.order, self.quota = order, quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = have = self.taken.get()[0] if self.taken.exists() else 0
        out = []
        for row in _arrived(rows, self.order):
            if row["status"] == "accepted":
                if have < self.quota:
                    have += 1
                else:
                    row["status"] = "over"
            out.append(Row(**row))
        if have > before:
            self.taken.update((have,))
        return iter(out)

    def close(self) -> None:
        pass


class QuotaIngest:
    """Takes the first `quota` rows of each class, without repeats of `key`, in order of arrival (micro-batch, then `order`, which is unique).

    Rows without a key or class are left out. Keys of excluded never count. buckets: tasks among which keys are dealt. Progress has the metrics `accepted`, `duplicate` and `over` of each micro-batch under the name `ingest`.
    """

    def __init__(self, spark: SparkSession, out: str, key: str, label: str, order: str, quota: int, excluded: DataFrame | None = None, buckets: int = 64):
        self.spark, self.out, self.key, self.label, self.order, self.quota, self.buckets = spark, out.rstrip("/"), key, label, order, quota, buckets
        self.excluded = excluded
        self.parameters = json.dumps({"key": key, "label": label, "order": order, "quota": quota, "buckets": buckets}, sort_keys=True)

    def judged(self, stream: DataFrame) -> DataFrame:
        """Rows of the stream with their status."""
        rows = stream.filter(F.col(self.key).isNotNull() & F.col(self.label).isNotNull())
        if self.excluded is not None:
            rows = rows.join(self.excluded.select(self.key).distinct(), self.key, "left_anti").select(*stream.columns)
        kind = dict(stream.dtypes)[self.key]
        rows = rows.withColumn("status", F.lit("accepted"))
        out = T.StructType([*stream.schema.fields, T.StructField("status", T.StringType())])
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))
        first = dealt.groupBy("_bucket").transformWithState(FirstOfKey(self.key, kind, self.order), T.StructType([*out.fields, T.StructField("_bucket", T.LongType())]), "Append", "None").drop("_bucket")
        return first.groupBy(self.label).transformWithState(TakeQuota(self.order, self.quota), out, "Append", "None")

    def _same_parameters(self, checkpoint: str) -> None:
        """Fails if the checkpoint was begun with other parameters."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/parameters")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            if self.spark.read.text(f"{checkpoint}/parameters").first()[0] != self.parameters:
                raise ValueError("parameters differ from those of the run that is resumed")
        else:
            self.spark.createDataFrame([(self.parameters,)], "value string").coalesce(1).write.text(f"{checkpoint}/parameters")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        self._same_parameters(checkpoint)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        counts = [F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "over")]
        taken = self.judged(stream).observe("ingest", *counts).filter("status = 'accepted'").drop("status")
        return taken.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self.out)


class Shuffle(StatefulProcessor):
    """A buffer of rows: once it is full each new row takes the place of one that is given out, chosen by a digest of (seed, lane, number of the row). Rows come out with their place in the lane."""

    def __init__(self, columns: T.StructType, order: str, size: int, seed: int, skip: int):
        self.columns, self.order, self.size, self.seed, self.skip = columns, order, size, seed, skip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", self.columns)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        names = self.columns.names
        held = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for row in _arrived(rows, self.order):
            now = tuple(row[c] for c in names)
            if len(held) < self.size:
                held.append(now)
            else:
                digest = hashlib.sha256(SEPARATOR.join(map(str, (self.seed, key[0], n))).encode()).digest()
                at, place = int.from_bytes(digest[:8], "big") % self.size, n - self.size + 1
                if place > self.skip:
                    out.append(Row(*names, "lane", "place")(*held[at], key[0], place))
                held[at] = now
            n += 1
        self.buffer.put(held)
        self.count.update((n,))
        return iter(out)

    def close(self) -> None:
        pass


class ShuffleBuffer:
    """A stream in shuffled order with a buffer of `size` rows in each of `lanes`, in order of arrival (micro-batch, then `order`). What comes out, and where, does not depend on how arrivals fall into micro-batches. skip leaves out the first places of each lane, which an earlier consumer has had.

    Memory is lanes * size rows, whatever the stream.
    """

    def __init__(self, spark: SparkSession, order: str, size: int = 2048, seed: int = 0, lanes: int = 1, skip: int = 0):
        self.spark, self.order, self.size, self.seed, self.lanes, self.skip = spark, order, size, seed, lanes, skip

    def shuffled(self, stream: DataFrame) -> DataFrame:
        """Columns of the stream, lane, place (from 1)."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        lane = F.pmod(F.xxhash64(self.order), F.lit(self.lanes))
        out = T.StructType([*stream.schema.fields, T.StructField("lane", T.LongType()), T.StructField("place", T.LongType())])
        processor = Shuffle(T.StructType(stream.schema.fields), self.order, self.size, self.seed, self.skip)
        return stream.withColumn("lane", lane).groupBy("lane").transformWithState(processor, out, "Append", "None")

    def rest(self, checkpoint: str) -> DataFrame:
        """Rows that are still in the buffers when the stream has ended, read from the state in its checkpoint: the consumer takes them last, in any seeded order."""
        held = self.spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "buffer").load()
        return held.select(F.col("key").getField(held.schema["key"].dataType.names[0]).alias("lane"), "list_element.*")
