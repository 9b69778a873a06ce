"""Hamming joins where many hashes are nearly alike."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import dedup

SCHEMA = "id long, bits long, split string"


def hashes(n, free_bits, seed=1):
    """Random hashes; a tenth are alike but for their lowest free_bits, and some are near others."""
    rng = random.Random(seed)
    centre, free = rng.getrandbits(64), range(free_bits)
    out = []
    for i in range(n):
        if i % 10 == 0:
            x = centre
            for b in free:
                x ^= rng.getrandbits(1) << b
        elif i % 10 == 1 and i > 20:
            x = out[i - rng.randrange(2, 20)][1] & ((1 << 64) - 1)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
        else:
            x = rng.getrandbits(64)
        out.append((i, dedup._signed(x), "ab"[i % 2]))
    return out


def brute(rows, radius, apart=False):
    flat = [(i, x & ((1 << 64) - 1), s) for i, x, s in rows]
    return sorted((i, j, (x ^ y).bit_count()) for i, x, s in flat for j, y, t in flat if i < j and (x ^ y).bit_count() <= radius and not (apart and s == t))


@pytest.mark.parametrize("radius, apart", [(3, None), (4, "split")])
def test_hot_keys_lose_and_repeat_no_pair(spark, monkeypatch, radius, apart):
    monkeypatch.setattr(dedup, "HOT_ROWS", 40)
    rows = hashes(900, 22)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert dedup._hot_keys(df, "bits", dedup.key_masks(radius, 900), radius, 900)
    got = sorted(tuple(r) for r in dedup.hamming_join(df, df, "id", "bits", radius, self_join=True, apart=apart).collect())
    assert got == brute(rows, radius, apart is not None) and len(got) > 20
    left, right = df.filter("id < 400"), df.filter("id >= 400")
    want = [p for p in brute(rows, radius, apart is not None) if p[0] < 400 <= p[1]]
    assert sorted(tuple(r) for r in dedup.hamming_join(left, right, "id", "bits", radius, apart=apart).collect()) == want


def test_candidates_of_alike_hashes(spark, monkeypatch):
    """A tenth of the rows share most bits: their keys alone would make all pairs of them; split, there are fewer candidates than rows."""
    monkeypatch.setattr(dedup, "HOT_ROWS", 100)
    radius, made = 3, {}
    for n in (4000, 8000):
        df = spark.createDataFrame(hashes(n, 40), SCHEMA).cache()
        masks = dedup.key_masks(radius, n)
        found = dedup._hot_keys(df, "bits", masks, radius, n)
        hot = spark.createDataFrame(found, "band int, value long, masks array<long>")
        for name, table in (("plain", None), ("split", hot)):
            keyed = dedup.keyed_hashes(df, [F.col("id")], "bits", masks, table)
            counts = keyed.groupBy(*[c for c in keyed.columns if c not in ("id", "masks")]).count()
            made[name, n] = counts.agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    assert made["plain", 8000] > 8000 * 40 and all(made["split", n] < n for n in (4000, 8000))


def test_bits_that_tell_apart_are_dealt_evenly():
    ones = [0.5 if b in (1, 2, 3, 40, 41, 42, 60, 61, 62, 63) else 0.0 for b in range(64)]
    masks = [m & ((1 << 64) - 1) for m in dedup.split_masks(ones, 1, 100_000)]
    free = [(m & sum(1 << b for b in (1, 2, 3, 40, 41, 42, 60, 61, 62, 63))).bit_count() for m in masks]
    assert min(free) >= 5 and max(free) - min(free) <= 2
