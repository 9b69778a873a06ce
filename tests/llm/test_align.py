"""Alignment of two tokenizers against a plain two-pointer loop over the libraries themselves."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievewright.llm import align
from sievewright.llm.common import documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), align._byte_alphabet()


def loop(sides, text):
    """Groups, and links as (a, b, start, end)."""
    library, model, shown = sides
    if not text:
        return [], []
    byte_of = {c: b for b, c in shown.items()}
    ids = library.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(ids.ids, ids.tokens, strict=True)]
    b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    groups, links, i, j, end_a, end_b, at = [([], [])], [], 0, 0, len(a[0][1]), len(b[0][1]), 0
    groups[0][0].append(a[0][0])
    groups[0][1].append(b[0][0])
    while True:
        to = min(end_a, end_b)
        links.append((a[i][0], b[j][0], at, to))
        at = to
        if to == len(whole):
            return groups, links
        ends = end_a == to, end_b == to
        if all(ends):
            groups.append(([], []))
        if ends[0]:
            i += 1
            end_a += len(a[i][1])
            groups[-1][0].append(a[i][0])
        if ends[1]:
            j += 1
            end_b += len(b[j][1])
            groups[-1][1].append(b[j][0])


def brute(sides, rows):
    aligned = [(doc, *loop(sides, text)) for doc, text in rows]
    counts = Counter(p for _, _, links in aligned for p in {x[:2] for x in links})
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc, groups, links in aligned:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        seen = [counts[x[:2]] for x in links]
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(n == best[x[0]] for n, x in zip(seen, links, strict=True)), sum(seen), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = ["", " ", "a", "  two  spaces ", "tab\there\n\nlines\r\n", "<|endoftext|> <s> </s> <unk>", "▁ is a sign", "naïve café – “quoted” …", "数字 и буквы 🙂🙃 é", "x" * 5000, "\x00 zero", "ﬁ ligature Ⅳ ½", " nbsp line", "don't we'll I'VE", "\u0085next", "é combining"]


def rows_of(result):
    return sorted((tuple(r) for r in result.select(*COLUMNS).collect()), key=repr)


def test_odd_texts(spark, sides):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id"), (90, None), (91, "tie tie"), (92, "tie")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, chunk string, n_links string").repartition(3)
    assert rows_of(align.link_sums(df, A, B)) == brute(sides, rows)
    assert rows_of(align.link_sums(df.limit(0), A, B)) == []


def test_random_texts(spark, sides, monkeypatch):
    """Signs of many kinds, chunks of a few documents."""
    rng = random.Random(7)
    signs = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "1", "23", ".", "'s", "-", " ", "\u0085", "ª", "²", "µ", "ǅ", "ʰ", "—", "’", "€", "の", "я", "🙂", "​", "<", "the ", "tion"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(align, "CHUNK_DOCS", 40)
    monkeypatch.setattr(align, "BATCH_BYTES", 300)
    assert rows_of(align.link_sums(df, A, B)) == brute(sides, rows)


def test_alignments_and_pair_counts(spark, sides):
    rows = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in align.alignments(df, A, B).collect():
        groups, links = loop(sides, rows[r["doc_id"]][1])
        assert [(g["a"], g["b"]) for g in r["groups"]] == groups and [tuple(x) for x in r["links"]] == links
    chunks = df.select("doc_id", "text").mapInArrow(align._chunks(A, B), align.CHUNK)
    got = {(r["a"], r["b"]): (r["docs"], r["best_a"], r["best_b"]) for r in align.pair_counts(align.chunk_pairs(chunks)).collect()}
    counts = Counter(p for _, t in rows for p in {x[:2] for x in loop(sides, t)[1]})
    assert got == {(a, b): (n, n == max(m for (x, _), m in counts.items() if x == a), n == max(m for (_, y), m in counts.items() if y == b)) for (a, b), n in counts.items()}


def test_op12_equals_brute_force(spark, sides):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in documents(spark, sf).select("doc_id", "text").collect()]
    got = align.op12_token_alignment(spark, sf)
    assert rows_of(got) == brute(sides, rows)
    assert [k for _, k in got.dtypes] == ["bigint"] * 7 + ["string"]


def test_fast_path_equals_the_library(spark, sides):
    """Texts of the table by the merges in tiktoken and by the library."""
    texts = [r[0] for r in documents(spark, "/root/testdata/sf0.01").orderBy(F.xxhash64("doc_id")).limit(150).select("text").collect()]
    side = align.byte_level(A)
    assert [x.tolist() for x in side.encode(texts)] == [sides[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
