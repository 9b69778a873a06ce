"""Streams with keyed state: quotas and repeats across restarts, a bounded shuffle."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievewright.streaming.ingest import QuotaIngest, ShuffleBuffer

SCHEMA = "id long, label int, h string"


class Feed:
    """Files that arrive one after the other, each a micro-batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def send(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/f{self.n:03d}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(self.folder)


def consumed(batches, quota, excluded):
    """What a consumer of one row at a time takes."""
    seen, counts, out = set(excluded), {}, []
    for batch in batches:
        for i, label, h in sorted(batch):
            if h is None or label is None or h in seen:
                continue
            seen.add(h)
            if counts.get(label, 0) < quota:
                counts[label] = counts.get(label, 0) + 1
                out.append(i)
    return sorted(out)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quota_ingest_with_restarts(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(100 * b + i, rng.choice([0, 1, 1]), f"h{rng.randrange(60)}") for i in range(25)] for b in range(4)]
    batches[1] += [(190, None, "n1"), (191, 1, None), (192, 1, None)]
    feed, excluded = Feed(spark, f"{tmp_path}/in"), [f"h{i}" for i in range(10)]
    ingest = QuotaIngest(spark, f"{tmp_path}/out", "h", "label", "id", 16, spark.createDataFrame([(h,) for h in excluded], "h string"), buckets=3)
    for part in (batches[:2], batches[2:3], batches[3:]):  # resumes behind what it has read
        for b in part:
            feed.send(b)
        run = ingest.start(feed.stream(), f"{tmp_path}/ck")
        run.awaitTermination()
    assert sorted(r["id"] for r in ingest.result().collect()) == consumed(batches, 16, excluded)
    assert run.lastProgress["observedMetrics"]["ingest"]["duplicate"] > 0
    before = ingest.result().count()
    ingest.start(feed.stream(), f"{tmp_path}/ck").awaitTermination()  # nothing new
    assert ingest.result().count() == before
    with pytest.raises(ValueError):
        QuotaIngest(spark, f"{tmp_path}/out", "h", "label", "id", 9, buckets=3).start(feed.stream(), f"{tmp_path}/ck")


def test_a_batch_reads_no_earlier_one(spark, tmp_path):
    """Rows that a batch reads are its own, whatever came before."""
    feed = Feed(spark, f"{tmp_path}/in")
    for b in range(3):
        feed.send([(100 * b + i, i % 2, f"h{b}-{i}") for i in range(20)])
    run = QuotaIngest(spark, f"{tmp_path}/out", "h", "label", "id", 1000, buckets=2).start(feed.stream(), f"{tmp_path}/ck")
    run.awaitTermination()
    own = [p["observedMetrics"]["ingest"] for p in run.recentProgress if p["numInputRows"]]
    assert [tuple(m) for m in own] == [(20, 0, 0)] * 3 and [p["numInputRows"] for p in run.recentProgress if p["numInputRows"]] == [20, 20, 20]


def buffered(rows, size, seed, lane=0):
    """The order of a consumer with one buffer, and what is left in it."""
    held, out = [], []
    for n, row in enumerate(rows):
        if len(held) < size:
            held.append(row)
        else:
            at = int.from_bytes(hashlib.sha256(f"{seed}\x1f{lane}\x1f{n}".encode()).digest()[:8], "big") % size
            out.append(held[at])
            held[at] = row
    return out, held


@pytest.mark.parametrize("cuts", [[60], [7, 20, 33]])
def test_bounded_shuffle(spark, tmp_path, cuts):
    """The same order however arrivals fall into micro-batches, also across a restart."""
    feed, ids, at = Feed(spark, f"{tmp_path}/in"), list(range(60)), 0
    shuffle = ShuffleBuffer(spark, "id", size=8, seed=5, skip=4)
    for n in cuts:
        feed.send([(i, None if i % 3 else i % 5, f"h{i}") for i in ids[at : at + n]])
        at += n
        shuffle.shuffled(feed.stream()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["place"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want, left = buffered(ids, 8, 5)
    assert got == [(i + 1, x) for i, x in enumerate(want)][4:]
    assert sorted(r["id"] for r in shuffle.rest(f"{tmp_path}/ck").collect()) == sorted(left)


def test_lanes(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/in")
    feed.send([(i, 0, "h") for i in range(90)])
    shuffle = ShuffleBuffer(spark, "id", size=5, seed=1, lanes=3)
    shuffle.shuffled(feed.stream()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    lanes = {r["id"]: r["lane"] for r in spark.range(90).select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("lane")).collect()}
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    for lane in range(3):
        assert [r["id"] for r in sorted((r for r in out if r["lane"] == lane), key=lambda r: r["place"])] == buffered([i for i in range(90) if lanes[i] == lane], 5, 1, lane)[0]
