"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sievewright.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity=2):
    """The last node, and each node's siblings (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
            at[k] = i // arity
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows, arity=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    sub = {g: tree([leaf(r) for r in by[g]], arity) for g in order}
    root, above = tree([sub[g][0] for g in order], arity) if order else (None, [])
    out = []
    for g, up in zip(order, above, strict=True):
        for r, path in zip(by[g], sub[g][1], strict=True):
            path = path + up
            touched = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1, r[4]) if touched else r)
            for before, after in path:
                now = h(before + now + after)
            out.append((r[0], leaf(r), sub[g][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digests(df, **more):
    return sorted((tuple(r) for r in merkle.manifest(df, **more).select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), merkle.fold(F.col("leaf"), F.col("path"))).collect()), key=repr)


ROWS = [(i, f"s{i % 3}", ("en", "é", "zz", None)[i % 4], i, "text " * (i % 5)) for i in range(61)] + [(7, "s", "en", None, None), (7, "s", "en", None, None), (None, None, None, None, None), (None, "s", "en", 3, ""), (1000, "s", "lone", 4, "ünï"), (-5, "s", "zz", 4, "x" * 30_000)]


@pytest.mark.parametrize("arity, stride, rows", [(2, 6, ROWS), (2, 1, ROWS), (2, 2, ROWS), (3, 2, ROWS), (2, 6, ROWS[:1]), (2, 6, [r for r in ROWS if r[2] == "en"])])
def test_equals_a_plain_tree(spark, arity, stride, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit(1), "leaf": F.lit("x"), "at": F.lit(2), "top": F.lit(3)}).repartition(3)
    assert digests(df, arity=arity, stride=stride) == sorted([(*r[:5], r[3]) for r in brute([(*x[:3], x[3], x[4]) for x in rows], arity)], key=repr)


def test_empty(spark):
    got = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "path"]


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 37:02d}", 1, "t") for i in range(90)]
    assert digests(spark.createDataFrame(rows, SCHEMA), stride=2) == [(*r[:5], r[3]) for r in brute(rows)] or digests(spark.createDataFrame(rows, SCHEMA), stride=2) == sorted([(*r[:5], r[3]) for r in brute(rows)], key=repr)


def test_query_and_sql_equal_a_plain_tree(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    want = brute(rows)
    assert sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, sf).select(*columns.split(", ")).collect()), key=repr) == want
    assert sorted(con.execute(f"SELECT {columns} FROM ({merkle.SQL})").fetchall(), key=repr) == want
    assert {r[-1] for r in want} == {True, False}


def test_sql_takes_nulls_and_repeats(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", ROWS)
    assert sorted(con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.SQL})").fetchall(), key=repr) == brute(ROWS)
