import random

import numpy as np
import pytest

from sievewright.llm import links
from sievewright.llm import ngram_join as nj
from sievewright.llm.components import components


def brute(docs, percent=80, width=5):
    """Components by all pairs."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    return sorted((docs[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(docs)))


def corpus(seed, n=150, copies=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [r.choice(words) for _ in range(40)]
    docs = []
    base = [r.choice(words) for _ in range(120)]
    for _ in range(n):
        kind = r.random()
        if kind < 0.3:
            t = [r.choice(words) for _ in range(r.randint(1, 150))]
        elif kind < 0.5:  # shares a common passage
            t = [r.choice(words) for _ in range(r.randint(5, 60))] + passage
        else:  # near copies of one text, and copies of copies
            t = list(base if r.random() < 0.5 or not docs else docs[r.randrange(len(docs))])
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
        docs.append(t)
    docs += [list(docs[0]) for _ in range(copies)]
    return [(i, " ".join(t)) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,frequent", [(1, 32), (2, 2), (3, 4)])
def test_same_components_as_all_pairs(spark, seed, frequent):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = nj.jaccard_join(df, frequent=frequent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_more_star_rounds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(links, "PAIRS_AN_ENTRY", 0)
    docs = corpus(5, 100, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, nj.jaccard_join(df, frequent=4).collect())) == brute(docs)


def test_odd_rows(spark):
    docs = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (2, "ONE\x0btwo"), (3, "one two three"), (None, "one two"), (8, "one two")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, n_shingles int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.jaccard_join(df).collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 2), (8, 1, 2), (2, 1, 2), (3, 1, 3), (None, 1, 2)], key=str)
    assert nj.jaccard_join(df.limit(0)).count() == 0


def test_similar_sets_always_share_a_key():
    """Any two sets that link share an index key, whatever tokens are frequent."""
    rng = np.random.default_rng(0)
    for trial in range(400):
        n = int(rng.integers(1, 300)) if trial % 2 else int(rng.integers(1, 25))
        universe = rng.choice(1 << 50, 2 * n + 50, replace=False).astype(np.uint64)
        rank = dict(zip(universe.tolist(), rng.choice([0, 1, 2, 5, 6, 9], len(universe), p=rng.dirichlet(np.ones(6))).tolist(), strict=True))
        x = set(universe[:n].tolist())
        out = int(rng.integers(0, n // 9 + 1))
        y = set(list(x)[out:]) | set(universe[n : n + int(rng.integers(0, out + 2))].tolist())
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        keys = []
        for s in (x, y):
            # tokens of one document alone are not given; shared ones are held by two at least
            shared = np.array(sorted(t for t in s if rank[t] >= 1 or t in (x & y)), np.uint64)
            ranks = np.array([max(1, rank[int(t)]) for t in shared], np.uint8)
            keys.append(set(nj.index_keys(len(s), shared, ranks, 80, 32).tolist()))
        assert keys[0] & keys[1], (trial, len(x), len(y))


def test_packed_tokens_round_trip():
    for a in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64)), np.arange(500, dtype=np.uint64) * 3):
        assert (nj._unpack(nj._pack(a)) == a).all()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    adj = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(adj):
        if start in want:
            continue
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += adj[x]
    for one_task in (1000, 0):
        got = components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task)
        assert dict(map(tuple, got.collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _pairs_that_meet(entries):
    """Key pairs of sets, as the join makes them."""
    by_key = {}
    for row, (keys, sides) in enumerate(entries):
        for k, side in zip(keys.tolist(), sides.tolist(), strict=True):
            by_key.setdefault(k, []).append((row, side))
    return [(a, b) for rows in by_key.values() for i, (a, s) in enumerate(rows) for b, t in rows[:i] if s == 0 or s != t]


def test_similar_sets_meet_whatever_the_widths():
    """The pigeonhole holds for every number of documents (so for every width) and for small and large sets."""
    rng = np.random.default_rng(4)
    met = 0
    for trial in range(600):
        n = int(rng.integers(1, 600)) if trial % 3 == 0 else int(rng.integers(1, 40))
        universe = rng.choice(1 << 50, 2 * n + 50, replace=False).astype(np.uint64)
        rank = dict(zip(universe.tolist(), rng.choice([1, 4, 5, 7, 9, 12], len(universe), p=rng.dirichlet(np.ones(6) / 2)).tolist(), strict=True))
        x = set(universe[:n].tolist())
        out = int(rng.integers(0, n // 5 + 1))
        y = set(list(x)[out:]) | set(universe[n : n + int(rng.integers(0, n // 5 + 2))].tolist())
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        met += 1
        n_docs = int(rng.choice([40, 1000, 10**6, 10**10]))
        entries = []
        for s in (x, y):
            shared = np.array(sorted(t for t in s if t in (x & y) or rank[t] > 4), np.uint64)
            entries.append(nj.index_entries(len(s), shared, np.array([rank[int(t)] for t in shared], np.uint8), 80, 32, n_docs))
        assert _pairs_that_meet(entries), (trial, len(x), len(y), n_docs)
    assert met > 200


@pytest.mark.parametrize("passage", [30, 50])
def test_sets_that_share_a_passage_hardly_meet(passage):
    """A thousand sets of 100 tokens with one passage in all and every other token in 40 of them: none link, so few key pairs are made."""
    rng = np.random.default_rng(passage)
    own = 100 - passage
    common = np.arange(1, passage + 1, dtype=np.uint64) * np.uint64(1 << 40)
    others = rng.permutation(np.repeat(np.arange(1000 * own // 40, dtype=np.uint64), 40) + np.uint64(1 << 52)).reshape(1000, own)
    entries = []
    for row in others:
        tokens = np.unique(np.concatenate([common, row]))
        ranks = np.where(tokens < np.uint64(1 << 52), 9, 5).astype(np.uint8)
        entries.append(nj.index_entries(len(tokens), tokens, ranks, 80, 32, 1000))
    assert len(_pairs_that_meet(entries)) < 10 * 1000


def test_widths_grow_with_the_class():
    assert [nj.combination_width(r, 32, 10**6) for r in (1, 4, 5, 9, 13, 19)] == [1, 1, 2, 3, 4, 4]
    assert nj.combination_width(9, 32, 1000) == nj.MOST_WIDTH


def test_tokens_of_a_whole_chunk_are_counted_right(spark):
    """A token that many documents of a chunk hold travels as a count; profiles are as for the others."""
    docs = [(i, f"a b c d e f{i}") for i in range(300)] + [(1000 + i, f"p{i // 2} q r s t") for i in range(4)]
    rows = nj.profiles(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text", 40, 5).collect()
    ranks = {r["doc_id"]: (list(r["classes"] or b""), r["alone"]) for r in rows}
    assert all(ranks[i] == ([8], 1) for i in range(300)) and all(ranks[1000 + i] == ([1], 0) for i in range(4))
