import pytest
from pyspark.sql import functions as F

from sievewright.sources import tables as src

HEADER = "sample_id,path,label,split,source_dataset,generator_id\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_strict_manifest(spark, tmp_path):
    good = put(tmp_path / "m.csv", HEADER + "a,x/a.png,0,train,s,g\nb,x/b.png,1,test,s,g\n")
    assert [tuple(r) for r in src.read_manifest(spark, good).select("sample_id", "label").collect()] == [("a", 0), ("b", 1)]
    bad = {
        "label": "a,x/a.png,2,train,s,g\n",
        "path": "a,../a.png,1,train,s,g\n",
        "blank": "a,x/a.png,1,,s,g\n",
        "repeated id": "a,x/a.png,1,train,s,g\na,x/b.png,1,train,s,g\n",
        "repeated path": "a,x/a.png,1,train,s,g\nb,x/a.png,1,train,s,g\n",
        "empty": "",
    }
    for i, (name, text) in enumerate(bad.items()):
        with pytest.raises(ValueError, match=name):
            src.read_manifest(spark, put(tmp_path / f"bad{i}.csv", HEADER + text))
    with pytest.raises(ValueError, match="missing columns"):
        src.read_manifest(spark, put(tmp_path / "cols.csv", "sample_id,label\na,1\n"))


def test_predictions(spark, tmp_path):
    line = '{"sample_id":"a","image_path":"p","label":1,"pred":0.5,"transform":"clean","transform_params":"{}"}\n'
    assert src.read_predictions(spark, put(tmp_path / "p.jsonl", line + "\n" + line)).count() == 2
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED_RECORD"):
        src.read_predictions(spark, put(tmp_path / "q.jsonl", line + "{not json\n")).collect()


def test_union_of_manifests(spark, tmp_path):
    cols = "dataset_key,source_file,row_group,row_index,tag\n"
    put(tmp_path / "m_a.csv", cols + "d,f,1,1,first\nd,f,1,2,first\n,,,,loose\n")
    put(tmp_path / "m_b.csv", cols + "d,f,1,1,second\nd,f,1,3,second\n,,,,loose\n")
    put(tmp_path / "m_skip.csv", cols + "d,f,9,9,third\n")
    got = src.union_manifests(spark, [f"{tmp_path}/m_{n}.csv" for n in ("b", "skip", "a")], exclude=["skip"])
    assert sorted((r["row_index"] or "", r["tag"]) for r in got.collect()) == [("", "loose"), ("", "loose"), ("1", "first"), ("2", "first"), ("3", "second")]


def test_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 7)], "id int, name string, label int").write.parquet(f"{tmp_path}/t")
    df = src.scan(spark, f"{tmp_path}/t", ["id", "label"], "label")
    assert sorted(r["id"] for r in df.collect()) == [1, 2] and df.columns == ["id", "label"]
    plan = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:int,label:int>" in plan and "PushedFilters: [In(label" in plan
    with pytest.raises(ValueError, match="missing"):
        src.scan(spark, f"{tmp_path}/t", ["nope"])


def test_pinned_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    names = [f.rsplit("/", 1)[-1] for f in df.inputFiles()]
    assert src.pinned_files(df, "part-", names) == names
    with pytest.raises(ValueError):
        src.pinned_files(df, "part-", [*names, "part-more.parquet"])


def test_images_and_layout(spark, tmp_path):
    for split in ("train", "test"):
        for cls in ("REAL", "FAKE"):
            (tmp_path / "root" / split / cls).mkdir(parents=True)
            (tmp_path / "root" / split / cls / "1.JPG").write_bytes(b"x" * 3)
    (tmp_path / "root" / "note.txt").write_text("no image")
    files = src.images_in(spark, str(tmp_path))
    assert files.count() == 4 and {r["length"] for r in files.collect()} == {3}
    assert {(r["split"], r["class"]) for r in src.two_class_layout(files).collect()} == {(a, b) for a in ("train", "test") for b in ("REAL", "FAKE")}
    with pytest.raises(ValueError):
        src.two_class_layout(files.filter("path LIKE '%train%'"))


def test_fetch_and_payloads(spark):
    rows = spark.createDataFrame([("d", "f", 1, i, bytearray([i])) for i in range(5)], "dataset_key string, source_file string, row_group int, row_index int, payload binary")
    got = src.fetch(rows, rows.filter("row_index IN (1, 3)"), "payload")
    assert sorted(r["row_index"] for r in got.collect()) == [1, 3]
    nested = rows.select(F.struct(F.col("payload").alias("bytes"), F.lit("p").alias("path")).alias("image"), F.lit(1).alias("n"))
    assert nested.select(src.payload_bytes(nested, "image").alias("b")).first()["b"] == bytearray([0])
    with pytest.raises(TypeError):
        src.payload_bytes(nested, "n")


def test_union_of_keys(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    assert src.union_of_keys([a, b]).columns == ["x", "y", "z"]
    assert src.union_of_keys([a, b], preferred=["z"]).columns == ["z", "x", "y"]
    with pytest.raises(ValueError):
        src.union_of_keys([])


def test_complete_tables(spark, tmp_path):
    path = f"{tmp_path}/table"
    src.write_complete(spark.range(10), path, {"seed": 1})
    assert src.read_complete(spark, path).count() == 10
    spark.range(9).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        src.read_complete(spark, path)


def test_backfill(spark):
    plan = spark.createDataFrame([("a", None), ("b", 7)], "id string, width int")
    have = spark.createDataFrame([("a", 5)], "id string, width int")
    assert {tuple(r) for r in src.backfill(plan, have, "id", ["width"]).select("id", "width", "status").collect()} == {("a", 5, "complete"), ("b", 7, "pending")}
