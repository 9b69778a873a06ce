"""The pipeline's stages against brute force on the smallest documents, with cases planted among them."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sievewright.llm import compression
from sievewright.llm.common import table, written

from .test_ngram_join import brute
from .test_text_operators import distance

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents, and the rows of each stage."""
    docs = table(spark, DATA, "documents")
    r = random.Random(1)
    text = {x["doc_id"]: x["text"] for x in docs.collect()}
    item = table(spark, DATA, "benchmark").orderBy("item_id").first()["text"]
    clean = [i for i, t in sorted(text.items()) if t and len(t.split()) > 100 and "!!" not in t and "$$" not in t and "|" not in t][:20]
    words = text[clean[2]].split()
    words[50] = "zzz"
    planted = [(90001, text[clean[0]] + " \n"), (90002, " ".join(words)), (90003, " ".join(r.choice(text[clean[4]].split()) for _ in range(200)) + ". " + item), (90004, " ".join(r.choice(text[clean[5]].split()) for _ in range(300)))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted], docs.schema))
    now = written(docs, "test")
    out = [now]
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, DATA), f"test-{name}")
        out.append(now)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    model = compression.fit(stages[0], table(spark, DATA, "labels"), "quality", compression.remainder("doc_id", 5) != 0)
    sizer = compression.Sizer(model)
    want = {i for i, t in before.items() if model.score(np.array([sizer.sizes((t or "").encode())]))[0] >= 0.3}
    assert after.keys() == want
    good = {r["doc_id"] for r in table(spark, DATA, "labels").filter(F.col("quality") == 1).collect()}
    assert len(good & after.keys()) / len(good & before.keys()) > 0.9


def test_exact_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    groups = {}
    for i, t in before.items():
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    assert after.keys() == {min(g)[1] for g in groups.values()}


def test_near_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert after.keys() == {i for i, _, c in brute(sorted(before.items())) if i == c} and 90002 not in after


def test_decontamination_stage(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = [" ".join(r["text"].lower().split()) for r in table(spark, DATA, "benchmark").collect()]
    dropped = before.keys() - after.keys()
    assert 90003 in dropped and 90004 in after
    for i in dropped:
        t = " ".join((before[i] or "").lower().split())
        assert any(x in t for x in items) or min(distance(x, t) / len(x) for x in items) <= 0.2
    assert not any(x in " ".join((t or "").lower().split()) for t in after.values() for x in items)


def test_packing_stage(stages):
    docs = rows(stages[4])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {}
    for r in stages[5].collect():
        packed.setdefault(r["doc_id"], []).append(r)
    assert packed.keys() == docs.keys()
    for i, t in docs.items():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(packed[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_odd_documents_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int"
    plain = " ".join(f"word{i}" for i in range(40)) + "."
    odd = [(1, None), (2, ""), (None, plain + " x"), (3, "y " * 60_000), (4, plain), (4, plain), (5, plain + " \n"), (6, " \t ")]
    docs = spark.createDataFrame([(i, t, "en", None, None, "c", 0) for i, t in odd], schema)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[1:]:
            now = written(stage(spark, now, DATA), f"odd-{name}")
            if name != "packing":
                assert now.columns == docs.columns
        got = now.select("doc_id").distinct().collect()
        assert {r["doc_id"] for r in got} == (set() if empty else {3, 5, 6}), got
    model = compression.CompressionModel(b"", b"", [5.0, 0.0, 0.0])
    assert compression.accepted(docs, model).count() == len(odd)


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [f"word{i}" for i in range(60)]
    plain, close, other = " ".join(words), " ".join(["xx", *words]), " ".join(words[::-1])
    rows = [(1, plain), (1, plain), (1, plain + " "), (2, plain), (None, other), (None, other), (3, other + "\n"), (4, "alone"), (4, "apart"), (None, "nobody"), (None, "no body"), (5, close), (5, "alone"), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    exact = [(r["doc_id"], r["text"]) for r in corpus_pipeline.exact(spark, docs, DATA).collect()]
    assert sorted(exact, key=str) == sorted([(1, plain + " "), (3, other + "\n"), (4, "alone"), (4, "apart"), (None, "no body"), (5, close), (6, None)], key=str)
    near = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, DATA).collect()]
    assert len(near) == len(set(near))
    sets = sorted((r[0] is None, r[0], " ".join((r[1] or "").split())) for r in near)
    assert sets == sorted([(False, 1, plain), (False, 3, other), (False, 4, "alone"), (False, 4, "apart"), (True, None, "nobody"), (True, None, "no body"), (False, 6, "")])
