import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievewright.llm import exact_dedup, packing, token_files
from sievewright.llm.token_files import EliasFano
from sievewright.llm.tokens import SegmentTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


ODD = [(1, "Hello world, it's me"), (2, None), (3, ""), (4, "x " * 9000), (2, "again"), (5, "Ünïcode ﬁ ½ 漢字 <|endoftext|> don't!!"), (None, "no id"), (7, "Hello world, it's me"), (8, "a\x1cb c\r\nd"), (9, "x" * 5000)]


def ids(plain, text, end):
    return plain.encode(text or "", add_special_tokens=False).ids + [end]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, shard int, sha string")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["The", "it's", "don't", "é!", "ÀB--", "12ab", "...", "İ", "ΑΣ", "\n", " ", "á", "<|endoftext|>"])).map(" ".join))
def test_segments_give_the_ids_of_the_whole_text(text):
    fast = test_segments_give_the_ids_of_the_whole_text.__dict__.setdefault("fast", SegmentTokenizer(PATH, max_cached=50))
    want = fast._tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(fast.ids([text.encode()])[0], "<u4").tolist() == want


def test_dedup_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, "", " \t", "a b", "ab", "A b", "a\nb ", "a b", "long " * 500, str(i % 37), str(i)])) for i in range(400)]
    norm = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    want = sorted((i, min(groups[norm[i]])[1], len(groups[norm[i]]), min(groups[norm[i]])[1] == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in rows)
    for bits, most in ((16, 64 << 20), (1, 8192), (4096, 0)):  # with a filter that is far too small more rows shuffle, one of many blocks is not broadcast; nothing else changes
        got = exact_dedup.exact_dedup(frame(spark, rows).repartition(5), bits_per_key=bits, max_broadcast_bytes=most)
        assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def test_dedup_odd_rows(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, [(None, "a"), (3, " a"), (3, "a "), (9, None)])).collect()}
    assert got == {(None, 3, 3), (3, 3, 3), (9, 9, 1)}
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_few_rows_pass_the_filter(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(5000, "text 7")]
    dg = exact_dedup.digests(frame(spark, rows))
    planes, n = exact_dedup.repeat_filter(dg, 2001, 16)
    words = {r["block"]: np.array(r["words"], np.int64).view(np.uint64) for r in planes.collect()}
    hit = 0
    for r in dg.collect():
        w = words[r["h1"] % n]
        at = [(r["h2"] >> (16 * i)) & 0xFFFF for i in range(4)]
        hit += all(int(w[a // 64]) >> (a % 64) & 1 for a in at)
    assert 2 <= hit <= 40


def check_pieces(rows, docs, plain, capacity):
    want = sorted((d if d is not None else -1, tuple(ids(plain, t, 1))) for d, t in docs)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(len(x[1]) for x in want) == sum(r["length"] for r in rows)
    for d, tokens in want:
        own = sorted((r for r in rows if (r["doc_id"] if r["doc_id"] is not None else -1) == d and r["doc_tokens"] == len(tokens)), key=lambda r: r["start"])
        assert any(r["start"] == 0 for r in own)
        for r in own:
            part = np.array(tokens[r["start"] : r["start"] + r["length"]], "<u4")
            if len([x for x in want if x[0] == d]) == 1:
                assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]
        if len([x for x in want if x[0] == d]) == 1:
            at = 0
            for r in own:
                assert r["start"] == at
                at += r["length"]
            assert at == len(tokens)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"], r["padded_to"]))
    for parts in seqs.values():
        at = 0
        for o, n, total, padded in sorted(parts):
            assert o == at
            at += n
        assert at == total <= capacity and padded == (total if total & (total - 1) == 0 else capacity)


def test_packing(spark, plain):
    rows = packing.pack(frame(spark, ODD), PATH).collect()
    check_pieces(rows, ODD, plain, 2048)
    r = random.Random(2)
    docs = [(i, "word " * r.randint(0, 120)) for i in range(300)]
    rows = packing.pack(frame(spark, docs).repartition(4), PATH, window=64, group_rows=100).collect()
    check_pieces(rows, docs, plain, 64)
    assert packing.pack(frame(spark, []), PATH).count() == 0
    used = sum(x["length"] for x in rows)
    assert used / sum({x["sequence_id"]: x["padded_to"] for x in rows}.values()) > 0.95


def test_equal_rows_are_dealt_to_many_groups(spark):
    """A thousand empty texts without an id, a third of all rows, make no large group."""
    docs = [(None, None)] * 1000 + [(i, f"text {i}") for i in range(2000)]
    rows = packing.pack(frame(spark, docs).repartition(4), PATH, window=64, group_rows=100).withColumn("g", packing.F.col("sequence_id") % 30).groupBy("g").count().collect()
    assert len(rows) == 30 and max(r["count"] for r in rows) < 200


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_the_plain_one(lengths):
    lengths.sort(reverse=True)
    sequence, offset, used = packing.best_fit_decreasing(lengths, 50)
    bins = []
    for n, o in zip(lengths, offset.tolist(), strict=True):
        fits = [b for b in bins if 50 - b >= n]
        if fits:
            best = max(fits)
            assert o == best
            bins.remove(best)
            bins.append(best + n)
        else:
            assert o == 0
            bins.append(n)
    assert sorted(bins) == sorted(used.tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 30) | st.integers(0, 5), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    ef = EliasFano.read(__import__("io").BytesIO(EliasFano.of(np.array(values, np.int64)).to_bytes()))
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 100:  # about two bits and log2(u / n) a value
        assert len(ef.to_bytes()) < 40 + len(values) * (np.log2(max(1, values[-1]) / len(values) + 1) + 4) / 8 + 4 * (len(values) / 256 + 1) + 16


@pytest.mark.parametrize("per_shard", [4096, 2])
def test_token_files_round_trip(spark, plain, tmp_path, per_shard):
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(frame(spark, ODD).repartition(3), folder, PATH, docs_per_shard=per_shard)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    order = sorted(ODD, key=lambda d: (d[0] is not None, d[0] or 0))
    assert [r[0] for r in got] == [d for d, _ in order]
    at = 0
    seen = []
    for doc, start, n, crc in got:
        assert start == at
        at += n
        seen.append((doc, n, crc))
    want = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in ODD for x in [ids(plain, t, 2)]]
    assert sorted(seen, key=str) == sorted(want, key=str)
    for path, n in [(r["path"], r["n_docs"]) for r in manifest.collect()]:
        shard = token_files.Shard(path)
        assert shard.n_docs == n
        for i, (doc, _, tokens) in enumerate(shard.each()):
            assert shard.ids(i).tolist() == tokens.tolist() and shard.doc_ids()[i] == doc


def test_token_files_empty(spark, tmp_path):
    manifest = token_files.write_token_files(frame(spark, []), f"file://{tmp_path}/none", PATH)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


def test_a_write_that_is_run_again(spark, plain, tmp_path):
    """Every task fails after it has written; the next attempt writes files of its own, and the manifest names those alone."""
    import os

    folder, marks = f"file://{tmp_path}/again", str(tmp_path)
    write = token_files._write(folder, 2)

    def once(batches):
        out = list(write(batches))
        shards = [s for b in out for s in b.column("shard").to_pylist()]
        mark = f"{marks}/tried-{shards}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost")
        yield from out

    rows = [(0, i, np.arange(i + 1, dtype="<u2").tobytes()) for i in range(5)]
    try:
        manifest = spark.createDataFrame(rows, token_files.ENCODED).coalesce(1).mapInArrow(once, token_files.MANIFEST).collect()
    except Exception:  # local tasks are tried once
        manifest = spark.createDataFrame(rows, token_files.ENCODED).coalesce(1).mapInArrow(once, token_files.MANIFEST).collect()
    assert len(manifest) == 1 and [(d, a, len(t)) for d, a, t in token_files.Shard(manifest[0]["path"]).each()] == [(0, 0, 1), (1, 1, 2), (2, 3, 3), (3, 6, 4), (4, 10, 5)]
    assert len({f.split(".")[0] for f in os.listdir(f"{tmp_path}/again")}) == 2

    def broken(batches):
        yield from batches
        raise OSError("the stream breaks off")

    with pytest.raises(OSError):
        list(token_files._write(f"file://{tmp_path}/broken", 2)(broken(iter([pa.RecordBatch.from_pylist([{"shard": 0, "doc_id": 1, "ids": b"ab"}], schema=pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())]))]))))
    assert os.listdir(f"{tmp_path}/broken") == []
