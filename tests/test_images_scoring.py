import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import repair, scoring
from sievewright.sources import images
from sievewright.sources import tables as src


def png(a):
    """A PNG file of a height x width x 3 array of bytes."""
    h, w, _ = a.shape

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 256, (20, 30, 3), dtype=np.uint8)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "sub" / "b.png").write_bytes(png(a))
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = images.read_images(spark, str(tmp_path))
    assert sorted(r["status"] for r in rows.collect()) == ["ok", "ok", "undecodable"]
    one = rows.filter("status = 'ok'").first()
    assert np.allclose(images.to_array(one["pixels"], one["width"], one["height"], one["channels"]) * 255, a)
    described = images.describe(rows).collect()
    assert len({r["phash"] for r in described}) == 1 and len(described[0]["features"]) == 6 and len(described[0]["phash"]) == 16
    files = src.images_in(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    limited = images.within_limits(rows.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), files, most_pixels=100)
    assert sorted(r["status"] for r in limited.collect()) == ["too_large", "too_large", "undecodable"]
    matrix = [{"name": "clean"}, {"name": "gaussian_noise", "params": {"sigma": 0.1, "seed": 3}}]
    views = {(r["path"][-5], r["view"]): r["digest"] for r in images.all_views(rows, matrix, F.when(F.col("path").endswith("a.png"), 0).otherwise(1)).collect()}
    assert views["a", 0] == views["b", 0] and views["a", 1] != views["b", 1]
    again = {(r["path"][-5], r["view"]): r["digest"] for r in images.all_views(rows, matrix, F.when(F.col("path").endswith("a.png"), 0).otherwise(1)).collect()}
    assert again == views


def test_scores_and_error_rows(spark):
    def scorer(items):
        if any(i < 0 for i in items):
            raise ValueError("negative")
        return [i - 2.0 for i in items]

    rows = spark.createDataFrame([(f"p{i}", float(i if i != 3 else -1)) for i in range(6)], "p string, x double").repartition(2)
    got = {r["image_path"]: r for r in scoring.score_rows(rows, "p", "x", scorer).collect()}
    assert len(got) == 6 and got["p3"]["error_type"] == "ValueError" and got["p3"]["pred"] is None and abs(got["p2"]["pred"] - 0.5) < 1e-12
    out = scoring.published(scoring.score_rows(rows, "p", "x", scorer)).collect()
    assert [r["image_path"] for r in out] == ["p0", "p1", "p2", "p4", "p5"] and list(out[0].asDict()) == ["image_path", "pred"]
    bad = spark.createDataFrame([("a", 1.1, "ok")], "image_path string, pred double, status string")
    with pytest.raises(ValueError, match="score"):
        scoring.published(bad)


@pytest.mark.parametrize("seed, n_losers, n_pool, cells", [(3, 12, 16, 3), (4, 30, 25, 4), (5, 40, 400, 6), (6, 25, 300, 1), (7, 20, 90, 30)])
@pytest.mark.parametrize("same", [True, False])
def test_sequential_replacement(spark, same, seed, n_losers, n_pool, cells):
    """As one loser after the other takes them; the last cell has most of the candidates."""
    r = random.Random(seed)
    losers = [(f"l{i}", r.choice("uv"), r.randrange(cells)) for i in range(n_losers)]
    pool = [(f"c{i}", r.choice("uvw"), r.choice([r.randrange(cells), cells - 1]), f"{r.random():.6f}") for i in range(n_pool)]
    want = {}
    left = list(pool)
    for name, who, home in sorted(losers):
        fit = [c for c in left if c[1] == who]
        best = min(fit, key=lambda c: ((c[2] != home) if same else (c[2] == home), c[3], c[0]), default=None)
        want[name] = best[0] if best else None
        if best:
            left.remove(best)
    lost, free = spark.createDataFrame(losers, "id string, who string, cell int"), spark.createDataFrame(pool, "id string, who string, cell int, digest string")
    got = repair.replace_sequentially(lost, free, "id", ["who"], ["cell"], "digest", same)
    assert repair.needed_candidates(lost, free, "id", ["who"], ["cell"], "digest", same).count() <= 3 * n_losers
    assert {x["loser"]: x["replacement"] for x in got.collect()} == want


def test_documents_caches_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1,\n "b": "x"}, {"a": 2, "b": null}]')
    assert [r["a"] for r in src.read_document(spark, f"{tmp_path}/d.json", "a int, b string").collect()] == [1, 2]
    cache = spark.createDataFrame([("s1", [0.1, 0.2], "h"), ("s2", [0.3, 0.4], "h")], "sample_id string, logits array<float>, lineage string")
    cache.write.parquet(f"{tmp_path}/cache")
    assert src.read_cache(spark, f"{tmp_path}/cache", ["v0", "v1"], ["logits"], ["lineage"]).count() == 2
    with pytest.raises(ValueError, match="shape"):
        src.read_cache(spark, f"{tmp_path}/cache", ["v0"], ["logits"])
    manifest = spark.createDataFrame([("a", 1, "AA"), ("b", 1, "bb"), ("c", 2, "cc"), ("d", 1, "dd")], "path string, byte_size long, sha256 string")
    files = spark.createDataFrame([("a", 1, "aa"), ("b", 2, "bb"), ("c", 2, "xx")], "path string, byte_size long, sha256 string")
    assert {r["path"]: r["status"] for r in src.verify_files(manifest, files).collect()} == {"a": "ok", "b": "size", "c": "digest", "d": "missing"}
    assert [r["path"] for r in src.pending(manifest, files, ["path"]).collect()] == ["d"]
    assert src.provenance(spark, "n", "SELECT 1", ["t"]).first()["engine"] == "spark"


def test_views_made_twice_use_all_cores(spark):
    """Both runs of the audit have a partition for each core at least, and not the same number."""
    rows = spark.createDataFrame([("1", 1, 1, 1, bytearray(b"x"), "ok")], "path string, width int, height int, channels int, pixels binary, status string")
    plan = images.view_mismatches(rows, [{"name": "clean"}], F.lit(0))._jdf.queryExecution().optimizedPlan().toString()
    parts = [int(line.rsplit(", ", 1)[1]) for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(set(parts)) == 2 and min(parts) >= spark.sparkContext.defaultParallelism
