"""The registered queries over whole small tables: against DuckDB, against brute force, or an exact round trip."""

import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sievewright.llm import compression, decontaminate, registry, toxicity
from sievewright.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def run(spark, name):
    return entry.queries()[name](spark, DATA)


def test_all_queries_are_there():
    assert {k.split("_")[0] for k in registry.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert registry.ORACLES.keys() <= entry.oracle_sql().keys() and registry.QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = run(spark, name)
    got = con.execute(registry.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_op4_scores_by_hand(spark, texts):
    """Each token's marginal by plain sums over the chain, the document's score by its definition."""
    docs = table(spark, DATA, "documents")
    model = toxicity.fit(docs, table(spark, DATA, "labels"), "toxic", toxicity.remainder("doc_id", 4) != 2)
    got = {r["doc_id"]: r for r in run(spark, "op4_toxicity").collect()}
    assert got.keys() == texts.keys()
    m = [[math.exp(model.moves[2 * a + b]) for b in (0, 1)] for a in (0, 1)]

    def marginals(words):
        weights = [(1.0, math.exp(min(30, max(-30, model.bias + sum(model.weights.get(f, 0) for f in toxicity.word_features(toxicity.word_of(w))))))) for w in words]
        forward = [weights[0]]
        for w in weights[1:]:
            f = forward[-1]
            now = [sum(f[a] * m[a][b] for a in (0, 1)) * w[b] for b in (0, 1)]
            forward.append((now[0] / sum(now), now[1] / sum(now)))
        back = [(1.0, 1.0)]
        for w in weights[:0:-1]:
            b = [sum(m[a][c] * w[c] * back[-1][c] for c in (0, 1)) for a in (0, 1)]
            back.append((b[0] / sum(b), b[1] / sum(b)))
        return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, back[::-1], strict=True)]

    for doc, text in sorted(texts.items())[:60] + sorted(texts.items(), key=lambda x: -len(x[1]))[:5]:
        p, chain = [], []
        words = text.encode().split()
        for i, w in enumerate(words):
            chain.append(w)
            if w[-1:] in (b".", b"!", b"?") or i == len(words) - 1:
                p += marginals(chain)
                chain = []
        none = sum(math.log1p(-min(x, 1 - 1e-12)) for x in p)
        x = [1, min(12, max(-12, math.log(max(-math.expm1(none), 1e-12)) - none)) if p else -12, sum(p) / math.sqrt(len(p) + 1) if p else 0]
        want = 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(x, model.curve, strict=True))))))
        r = got[doc]
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2)


def test_op8_scores_by_hand(spark, texts):
    docs = table(spark, DATA, "documents")
    model = compression.fit(docs, table(spark, DATA, "labels"), "quality", compression.remainder("doc_id", 5) != 0)
    flags = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **flags) for d in (model.good, model.bad)]
    for r in run(spark, "op8_quality").collect():
        data = texts[r["doc_id"]].encode()
        good, bad = (sum(len(c.compress(data[a : a + 256])) for a in range(0, len(data), 256)) for c in by)
        x = (1, 10 * (bad - good) / (len(data) + 64), 64 / (len(data) + 64))
        want = 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))
        assert abs(r["score"] - want) < 0.02 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_scores_follow_the_true_shares():
    """A curve fitted where labels are balanced, moved to a share, has that share as its mean on data with that share."""
    rng = np.random.default_rng(3)
    y = (rng.random(40_000) < 0.1).astype(float)
    x = np.column_stack([np.ones_like(y), rng.normal(2 * y - 1, 1)])
    half = np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[: int(y.sum())]])
    curve = compression.to_share(compression.fit_logistic(x[half], y[half]), y[half], 0.1)
    p = 1 / (1 + np.exp(-x @ curve))
    assert abs(p.mean() - 0.1) < 0.01
    for low, high in ((0.0, 0.1), (0.1, 0.3), (0.3, 0.6), (0.6, 1.0)):
        at = (p >= low) & (p < high)
        assert abs(p[at].mean() - y[at].mean()) < 0.05


def test_an_id_that_repeats_counts_once(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    got = compression.labelled_sample(docs, labels, "quality", compression.F.lit(True), 10)
    assert got == [(1, 0, b"text 0"), (2, 1, b"other")] and compression.label_share(labels, "quality", compression.F.lit(True)) == 2 / 3


def test_op5_and_op9_round_trip(spark, texts):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: plain.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    at = 0
    files = sorted(run(spark, "op5_token_files").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in files] == sorted(texts)
    for r in files:
        want = np.array([*ids[r["doc_id"]], 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    pieces, room = {}, {}
    for r in run(spark, "op9_packing").collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in pieces.items():
        want, at = np.array([*ids[d], 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    assert pieces.keys() == texts.keys()
    for parts in room.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_op7_one_row_a_page(spark):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    got = run(spark, "op7_html_text").collect()
    assert sorted(r["page_id"] for r in got) == sorted(p["page_id"] for p in pages) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_op10_against_all_pairs(spark, texts):
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in run(spark, "op10_decontamination").collect()}
    some = sorted({d for d, _ in got})[:10] + sorted(texts)[:10]
    want = {}
    for d in some:
        t = " ".join(texts[d].lower().split())
        for i, item in items.items():
            if (x := decontaminate.edit_distance_within(item, t, int(0.2 * len(item)))) is not None:
                want[d, i] = x[0]
    assert {k: v for k, v in got.items() if k[0] in some} == want


def test_many_blocks_give_the_same_leaks(spark):
    docs, bench = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    few, many = (sorted(map(tuple, decontaminate.find_leaks(docs, bench, block_items=n).collect())) for n in (2000, 40))
    assert few == many
    kept = decontaminate.without_leaks(docs, bench, block_items=40)
    assert {r["doc_id"] for r in docs.join(kept.select("doc_id"), "doc_id", "left_anti").collect()} == {d for d, *_ in few} and kept.columns == docs.columns


def test_long_items_make_blocks_by_their_characters(spark, monkeypatch):
    docs, bench = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    want = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2_000)
    assert decontaminate.Blocks(spark, bench, "item_id", "text", 0.2, 2_000).n > 1
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == want


def test_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 100)
    monkeypatch.setattr(decontaminate, "PIECE_ROWS", 4)
    texts = ["a" * n for n in (5, 60, 60, 500, 1, 1, 1, 1, 1)] + [None, "é" * 45, "b"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = [p.column("text").to_pylist() for p in decontaminate.pieces(batch, "text")]
    assert [len(p) for p in got] == [2, 1, 1, 4, 4] and [t for p in got for t in p] == texts
    assert list(decontaminate.pieces(batch.slice(0, 0), "text")) == []
