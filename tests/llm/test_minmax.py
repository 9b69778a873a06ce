"""Min-max hashing: recall and bias of the signatures, and the operator against all pairs."""

import random

import numpy as np
import pytest

from sievewright.llm import minmax
from sievewright.llm.common import documents

from .test_ngram_join import brute


def near_pair(n, similarity, rng):
    """Token hashes of two sets of about n with that similarity."""
    shared = round(n * 2 * similarity / (1 + similarity))
    return [np.unique(np.concatenate([common, rng.integers(0, 1 << 56, n - shared, dtype=np.uint64)])) for common in [rng.integers(0, 1 << 56, shared, dtype=np.uint64)] for _ in range(2)]


def signed(sets):
    return minmax.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]))


def test_signatures_are_minima_and_maxima():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64)) for n in (1, 7, 300)]
    offsets, factors = minmax._functions()
    with np.errstate(over="ignore"):
        for got, s in zip(signed(sets), sets, strict=True):
            value = (s[:, None] ^ offsets) * factors
            assert (got == np.concatenate([value.min(0), value.max(0)])).all()


def test_estimates_have_no_bias_and_less_variance():
    """The share of equal values estimates the similarity; minima and maxima of half as many functions vary no more than minima alone of all."""
    rng = np.random.default_rng(2)
    both, minima = [], []
    for _ in range(400):
        a, b = signed(near_pair(60, 0.5, rng))
        both.append((a == b).mean())
        minima.append((a == b)[: minmax.PERMUTATIONS].mean())
    assert abs(np.mean(both) - 0.5) < 0.01
    assert np.var(both) < 0.62 * np.var(minima)


@pytest.mark.parametrize("n", [9, 18, 45, 405])
def test_pairs_at_the_threshold_share_a_key_and_a_sketch(n):
    rng = np.random.default_rng(n)
    for _ in range(300):
        a, b = near_pair(n, 0.8, rng)
        signature = signed([a, b])
        keys = minmax.band_keys(signature)
        assert (keys[0] == keys[1]).any()
        x, y = minmax.sketches(np.ascontiguousarray(signature))
        assert sum(int(w).bit_count() for w in (x ^ y).view(np.uint64)) < minmax.MOST_DIFFER


def test_small_sets_at_the_threshold():
    rng = np.random.default_rng(6)
    for _ in range(300):
        b = np.unique(rng.integers(0, 1 << 56, 5, dtype=np.uint64))
        signature = signed([b[:4], b])
        keys, (x, y) = minmax.band_keys(signature), minmax.sketches(np.ascontiguousarray(signature))
        assert (keys[0] == keys[1]).any() and sum(int(w).bit_count() for w in (x ^ y).view(np.uint64)) < minmax.MOST_DIFFER


def test_unlike_pairs_are_seldom_candidates():
    rng = np.random.default_rng(3)
    keys = [minmax.band_keys(signed(near_pair(200, 0.3, rng))) for _ in range(300)]
    assert sum((k[0] == k[1]).any() for k in keys) < 60


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def wanted(rows):
    return sorted(((*r, r[0] == r[2]) for r in brute(rows, width=4)), key=repr)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(5, 120))] for _ in range(40)]
    rows = []
    for _ in range(260):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((len(rows), " ".join(text)))
    rows += [(500, rows[3][1].upper()), (501, None), (502, ""), (503, " \t\n"), (504, "one two"), (505, "One  TWO"), (506, "one"), (507, " ".join(words * 60))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, n long").repartition(4)
    assert rows_of(minmax.near_duplicates(df)) == wanted(rows)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(4, text), (4, text), (9, text + " end"), (None, text), (None, "other words that are alone here")], "doc_id long, text string")
    assert rows_of(minmax.near_duplicates(df)) == sorted([(4, 27, 4, True), (4, 27, 4, True), (9, 28, 4, False), (None, 27, 4, False), (None, 3, None, True)], key=repr)
    assert rows_of(minmax.near_duplicates(df.limit(0))) == []
    with pytest.raises(ValueError):
        minmax.near_duplicates(df, percent=70)


def test_a_large_group(spark):
    """Hundreds of near copies are one component though no two of them are all compared."""
    rng = random.Random(8)
    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        now = list(text)
        now[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(now)))
    got = rows_of(minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {r[2] for r in got} == {0} and [r[0] for r in got if r[3]] == [0]


def test_op11_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in documents(spark, sf).select("doc_id", "text").collect()]
    assert rows_of(minmax.op11_minmax_dedup(spark, sf)) == wanted(rows)


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    for similarity in (0.5, 0.8, 0.95):
        a, b = near_pair(100, similarity, rng)
        x, y = minmax.parity_bitmaps(minmax.mix64(np.concatenate([a, b])), np.array([len(a), len(b)]))
        assert sum(int(w).bit_count() for w in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))
