"""Keys that many rows share: split by rare tokens, nothing lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import links, minmax
from sievewright.llm import ngram_join as nj
from sievewright.llm.common import Scratch

from .test_ngram_join import brute


def passages(seed, n=160):
    """Texts with one of two long passages in common, some of them near copies of others."""
    r = random.Random(seed)
    shared = [[f"{p}{i}" for i in range(60)] for p in "pq"]
    out = []
    for i in range(n):
        if i % 4 == 3:
            text = list(out[r.randrange(len(out))])
            for _ in range(r.randrange(1, 5)):
                text[r.randrange(len(text))] = f"e{r.randrange(50)}"
        else:
            own = [f"w{r.randrange(60)}" for _ in range(r.choice([6, 12, 20, 40]))]
            at = r.randrange(len(own))
            text = own[:at] + shared[i % 2] + own[at:]
        out.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, large, many", [(1, 4, 3), (2, 4, 8), (3, 8, 30), (4, 2, 2), (5, 4, 1000)])
@pytest.mark.parametrize("width", [4, 5])
def test_large_keys_lose_no_link(spark, monkeypatch, seed, large, many, width):
    for name, value in (("LARGE", large), ("MANY", many), ("STAR_ROUNDS", 1)):
        monkeypatch.setattr(links, name, value)
    docs = passages(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if width == 4:
        got = minmax.near_duplicates(df).select("doc_id", "n_shingles", "component_id")
    else:
        got = nj.jaccard_join(df, frequent=4)
    assert sorted(map(tuple, got.collect())) == brute(docs, width=width)


def test_links_share_an_entry():
    """Of two sets that link, both have an entry of one key, or both are weak for each other's sizes."""
    rng = np.random.default_rng(0)
    for _ in range(2000):
        n_common, n_a, n_b = int(rng.integers(1, 120)), int(rng.integers(0, 30)), int(rng.integers(0, 30))
        universe = rng.permutation(400).astype(np.uint64) + np.uint64(1)
        common, own_a, own_b = np.split(universe[: n_common + n_a + n_b], [n_common, n_common + n_a])
        a, b = np.concatenate([common, own_a]), np.concatenate([common, own_b])
        if 100 * n_common < 80 * (n_common + n_a + n_b):
            continue
        rows = {int(t): int(rng.choice([1, 3, 9, 200])) for t in universe}  # rows that hold a token
        for t in common:
            rows[int(t)] = max(2, rows[int(t)])
        entries = []
        for s in (a, b):
            shared = sorted((t for t in s.tolist() if 1 < rows[t] < links.MANY), key=lambda t: (rows[t], t))
            keys, sides, _ = links.prefix_entries(len(s), sum(rows[t] >= links.MANY for t in s.tolist()), np.array(shared, np.uint64), 80)
            entries.append(set(zip(keys.tolist(), sides.tolist(), strict=True)))
        assert any(k == j and (x == 0 or x != y) for k, x in entries[0] for j, y in entries[1])


@pytest.mark.parametrize("n", [600, 2400])
def test_a_common_passage_makes_few_pairs(spark, n):
    """Sets of 100 tokens of which 85 are one passage, the others each in 40 sets: no pair links, and pairs that are made grow with the sets, not with their square."""
    rng = np.random.default_rng(n)
    passage = np.arange(1, 86)
    own = np.stack([rng.permutation(n) for _ in range(15)])  # a set's place in each of 15 shuffles decides which 40 share a token
    sets = [np.sort(np.concatenate([passage, 1000 + np.arange(15) * n + own[:, i] // 40])).astype(np.uint64) for i in range(n)]
    rows = [(i, 100, bytearray(s.astype("<u8").tobytes())) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "row long, n long, tokens binary")
    rest = table.select(F.lit(7).cast("long").alias("key"), "row", F.lit(0).alias("side"), F.col("row").alias("component"), "n")
    found = spark.createDataFrame([], "node long, component long")
    scratch = Scratch(spark)
    met = links.split_large(rest, rest.select("key").distinct(), found, table, ["n"], lambda a, b: F.lit(True), 80, scratch, links.raw)
    assert 0 < met.count() / n < 15 * 40
    scratch.clear()


def test_weak_rows_have_two_entries_a_key(spark):
    """Near copies of all sizes that share three large keys: each has two entries a key, whatever the classes of sizes of its partners, and rows of sizes that may link meet in one bin."""
    sizes = [10, 12, 15, 40, 41, 50, 60, 62, 75, 78, 100, 125, 1000, 1249, 1250]
    profile = spark.createDataFrame([(i, n, n) for i, n in enumerate(sizes)], "row long, n long, frequent long")
    held = profile.select("row", F.explode(F.array(*[F.lit(k).cast("long") for k in (7, 8, 9)])).alias("key"), F.lit(0).alias("side"), F.col("row").alias("component"))
    entries = links._weak_entries(held, profile, 80).collect()
    assert len(entries) <= 2 * 3 * len(sizes)
    met = {(a["row"], b["row"]) for a in entries for b in entries if a["key"] == b["key"] and (a["side"] == 0 or a["side"] != b["side"])}
    assert all((a, b) in met for a, x in enumerate(sizes) for b, y in enumerate(sizes) if 80 * x <= 100 * y and 80 * y <= 100 * x and a != b)
    assert not any(x > 2 * y for x, y in ((sizes[a], sizes[b]) for a, b in met))
