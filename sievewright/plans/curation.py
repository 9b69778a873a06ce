"""Queries over joins, deduplication, set operations, audits, profiles, near duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import scores as S
from ..functions.identity import stable_digest
from ..operators import audit, compare, dedup, joins, repair
from ..operators.audit import Check, where
from ..operators.scan import exact_percentiles
from .analogues import CONDITIONS, MANIFEST, SOURCE, digest_sql, manifest, pred_sql, predictions, source_rows, sql, t
from .registry import query

CLEAN = pred_sql(1, "predictions", "c.condition_index = 0")
SPLITS = ("test", "train", "validation")


# Joins


@query("join_label_check", sql(MANIFEST, CONDITIONS, pred_sql(), select="SELECT p.condition_index, count(*) AS rows, count(*) FILTER (WHERE p.label <> m.label) AS label_mismatch, count(DISTINCT p.sample_id) AS ids FROM predictions p JOIN manifest m USING (sample_id) GROUP BY p.condition_index"))
def join_label_check(spark, sf):
    p = predictions(spark, sf).select("sample_id", "condition_index", F.col("label").alias("given"))
    both = p.join(manifest(spark, sf).select("sample_id", "label"), "sample_id")
    return both.groupBy("condition_index").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("given") != F.col("label")).alias("label_mismatch"), F.count_distinct("sample_id").alias("ids"))


LOC = "dataset_key, source_file, row_group, row_index, image_name"


@query("anti_unselected", sql(SOURCE, select=f"SELECT {LOC} FROM source_rows s WHERE NOT EXISTS (SELECT 1 FROM source_rows x WHERE x.label = 1 AND x.row_group % 2 = 0 AND x.dataset_key = s.dataset_key AND x.source_file = s.source_file AND x.row_group = s.row_group AND x.row_index = s.row_index)"))
def anti_unselected(spark, sf):
    rows = source_rows(spark, sf)
    taken = rows.filter("label = 1 AND row_group % 2 = 0").select("dataset_key", "source_file", "row_group", "row_index")
    return rows.join(taken, taken.columns, "left_anti").select("dataset_key", "source_file", "row_group", "row_index", "image_name")


#: Shares of a table that stand for what was frozen before: by digest, so that they grow with the table.
TRAIN_SQL, HELD_SQL = (f"{digest_sql('71', 'canonical_generator_id')} {bounds}" for bounds in ("< '6'", "BETWEEN '6' AND '8'"))


def in_train():
    return stable_digest(71, F.col("canonical_generator_id")) < "6"


def in_validation():
    return stable_digest(71, F.col("canonical_generator_id")).between("6", "8")


@query("unseen_generators", sql(SOURCE, select=f"SELECT DISTINCT canonical_generator_id FROM source_rows WHERE canonical_generator_id NOT IN (SELECT canonical_generator_id FROM source_rows WHERE {TRAIN_SQL})"))
def unseen_generators(spark, sf):
    rows = source_rows(spark, sf)
    return rows.select("canonical_generator_id").distinct().join(rows.filter(in_train()).select("canonical_generator_id"), "canonical_generator_id", "left_anti")


@query("full_coverage", sql(MANIFEST, f"""
l AS (SELECT DISTINCT sample_id FROM manifest), r AS (SELECT DISTINCT sample_id FROM manifest WHERE split <> 'test' UNION ALL SELECT 'extra_' || doc_id FROM manifest WHERE {digest_sql("73", "doc_id")} < '3'),
f AS (SELECT l.sample_id AS a, r.sample_id AS b FROM l FULL JOIN r USING (sample_id))""", select="SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a IS NULL) AS extra, coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT a FROM f WHERE b IS NULL ORDER BY a LIMIT 5)), '') AS first_missing, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT b FROM f WHERE a IS NULL ORDER BY b LIMIT 5)), '') AS first_extra, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AS complete FROM f"))
def full_coverage(spark, sf):
    rows = manifest(spark, sf)
    cached = rows.filter("split <> 'test'").select("sample_id").unionByName(rows.filter(stable_digest(73, F.col("doc_id")) < "3").select(F.concat(F.lit("extra_"), F.col("doc_id").cast("string")).alias("sample_id")))
    return joins.coverage(rows, cached, "sample_id")


@query("semi_cohort", sql(MANIFEST, select="SELECT sample_id FROM manifest WHERE generator_id IN (SELECT generator_id FROM manifest WHERE split = 'test') AND split <> 'test'"))
def semi_cohort(spark, sf):
    rows = manifest(spark, sf)
    return rows.filter("split <> 'test'").join(rows.filter("split = 'test'").select("generator_id"), "generator_id", "left_semi").select("sample_id")


@query("identity_overlap", sql(MANIFEST, select="SELECT key, coalesce(shared, 0) AS shared FROM (VALUES ('sample_id'), ('sha256'), ('generator_id'), ('architecture')) k(key) LEFT JOIN (" + " UNION ALL ".join(f"SELECT '{c}' AS key, count(*) AS shared FROM (SELECT {c} FROM manifest WHERE split = 'train' INTERSECT SELECT {c} FROM manifest WHERE split = 'test')" for c in ("sample_id", "sha256", "generator_id", "architecture")) + ") USING (key)"))
def identity_overlap(spark, sf):
    rows = manifest(spark, sf)
    return joins.overlap_counts(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["sample_id", "sha256", "generator_id", "architecture"])


@query("pairwise_overlap", sql(MANIFEST, "h AS (SELECT DISTINCT split, sha256 FROM manifest)", select="SELECT a.s AS left_split, b.s AS right_split, (SELECT count(*) FROM h x JOIN h y ON x.sha256 = y.sha256 WHERE x.split = a.s AND y.split = b.s) AS shared FROM (SELECT unnest(['test', 'train', 'validation']) AS s) a JOIN (SELECT unnest(['test', 'train', 'validation']) AS s) b ON a.s < b.s"))
def pairwise_overlap(spark, sf):
    return joins.pairwise_overlap(manifest(spark, sf), "split", SPLITS, "sha256")


#: Hashes of the vectors; one in ten is a copy of the one before with up to five of its last bits flipped.
BITS = """raw AS (SELECT vec_id, list_transform(embedding, lambda x: x > list_sort(embedding[2:64])[32]) AS b FROM embeddings),
bits AS (SELECT vec_id, b FROM raw WHERE vec_id % 10 <> 3 UNION ALL
         SELECT vec_id + 1, list_transform(b, lambda x, i: CASE WHEN i > 64 - (vec_id // 10) % 6 THEN NOT x ELSE x END) FROM raw WHERE vec_id % 10 = 2)"""
HAMMING = "pairs AS (SELECT l.vec_id AS left_id, r.vec_id AS right_id, len(list_filter(list_zip(l.b, r.b), lambda z: z[1] <> z[2]))::INTEGER AS distance FROM bits l JOIN bits r ON l.vec_id <> r.vec_id)"
RADIUS = 4


def _hashes(spark, sf):
    rows = t(spark, sf, "embeddings").select("vec_id", S.phash_bits(F.col("embedding")).alias("bits"))
    flipped = F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(F.col("vec_id") / 10) % 6).cast("int")) - 1
    copies = rows.filter("vec_id % 10 = 2").select((F.col("vec_id") + 1).alias("vec_id"), F.col("bits").bitwiseXOR(flipped).alias("bits"))
    return rows.filter("vec_id % 10 <> 3").unionByName(copies)


@query("phash_bits", sql(BITS, select="SELECT vec_id, array_to_string(list_transform(b, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS bits FROM bits"))
def phash_bits(spark, sf):
    return _hashes(spark, sf).select("vec_id", F.lpad(F.bin("bits"), 64, "0").alias("bits"))


@query("hamming_pairs", sql(BITS, HAMMING, "c AS (SELECT min(vec_id) AS vec_id FROM bits GROUP BY b, vec_id % 3)", select=f"SELECT left_id, right_id, distance FROM pairs WHERE left_id < right_id AND distance <= {RADIUS} AND left_id % 3 <> right_id % 3 AND left_id IN (SELECT vec_id FROM c) AND right_id IN (SELECT vec_id FROM c)"))
def hamming_pairs(spark, sf):
    """Pairs across splits; equal hashes of a split are one row."""
    hashes = _hashes(spark, sf).withColumn("split", F.col("vec_id") % 3)
    return dedup.hamming_classes_join(hashes, "vec_id", "bits", RADIUS, apart="split")[1]


@query("near_dup_victims", sql(BITS, HAMMING, "p AS (SELECT vec_id, vec_id % 3 AS priority, " + digest_sql("43", "vec_id") + " AS digest FROM embeddings)", select="""
SELECT victim, count(*) AS conflicts, string_agg(other || ':' || distance, ',' ORDER BY other || ':' || distance) AS conflict_list FROM (
  SELECT CASE WHEN l.priority > r.priority OR (l.priority = r.priority AND l.digest > r.digest) THEN left_id ELSE right_id END AS victim,
         CASE WHEN l.priority > r.priority OR (l.priority = r.priority AND l.digest > r.digest) THEN right_id ELSE left_id END AS other, distance
  FROM pairs JOIN p l ON l.vec_id = left_id JOIN p r ON r.vec_id = right_id WHERE left_id < right_id AND distance <= 4) GROUP BY victim"""))
def near_dup_victims(spark, sf):
    hashes = _hashes(spark, sf)
    priority = hashes.select("vec_id", (F.col("vec_id") % 3).alias("priority"), stable_digest(43, F.col("vec_id")).alias("digest"))
    return dedup.near_duplicate_victims(dedup.hamming_join(hashes, hashes, "vec_id", "bits", RADIUS, self_join=True), priority, "vec_id")


@query("additions_vs_frozen", sql(BITS, HAMMING, select=f"SELECT right_id AS addition, left_id AS other, distance FROM pairs WHERE distance <= {RADIUS} AND right_id % 4 = 3 AND (left_id % 4 <> 3 OR left_id < right_id)"))
def additions_vs_frozen(spark, sf):
    """Each addition (one in four) with the frozen rows and the earlier additions near it."""
    hashes = _hashes(spark, sf)
    pairs = dedup.hamming_join(hashes, hashes.filter("vec_id % 4 = 3"), "vec_id", "bits", RADIUS).filter("left_id <> right_id AND (left_id % 4 <> 3 OR left_id < right_id)")
    return pairs.select(F.col("right_id").alias("addition"), F.col("left_id").alias("other"), "distance")


@query("reserved_overlap", "SELECT b.item_id, count(d.doc_id) AS documents FROM benchmark b LEFT JOIN documents d ON sha256(d.text) = sha256(b.text) GROUP BY b.item_id")
def reserved_overlap(spark, sf):
    held = t(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("d")).agg(F.count(F.lit(1)).alias("documents"))
    return t(spark, sf, "benchmark").withColumn("d", F.sha2("text", 256)).join(held, "d", "left").groupBy("item_id").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))


@query("reserved_nearest", sql(BITS, HAMMING, select=f"SELECT right_id AS vec_id, min(distance) AS nearest FROM pairs WHERE left_id % 20 = 2 AND right_id % 20 <> 2 GROUP BY right_id HAVING min(distance) <= {RADIUS}"))
def reserved_nearest(spark, sf):
    """Rows near the reserved set, one row in twenty."""
    hashes = _hashes(spark, sf)
    near = dedup.hamming_join(hashes.filter("vec_id % 20 = 2"), hashes.filter("vec_id % 20 <> 2"), "vec_id", "bits", RADIUS)
    return near.groupBy(F.col("right_id").alias("vec_id")).agg(F.min("distance").alias("nearest"))


@query("grid", sql(MANIFEST, CONDITIONS, select="SELECT s.split, c.condition_index, count(m.sample_id) AS rows FROM (SELECT unnest(['test', 'train', 'validation']) AS split) s CROSS JOIN conditions c LEFT JOIN manifest m ON m.split = s.split AND m.doc_id % 21 = c.condition_index GROUP BY ALL"))
def grid(spark, sf):
    bins = spark.createDataFrame([(s, i) for s in SPLITS for i in range(21)], "split string, condition_index int")
    counts = manifest(spark, sf).groupBy("split", (F.col("doc_id") % 21).cast("int").alias("condition_index")).agg(F.count(F.lit(1)).alias("rows"))
    return compare.zero_filled(counts, F.broadcast(bins), ["split", "condition_index"], "rows")


@query("cohort_sets", sql(SOURCE, select="SELECT DISTINCT canonical_generator_id, architecture FROM source_rows WHERE label = 1"))
def cohort_sets(spark, sf):
    return source_rows(spark, sf).filter("label = 1").select("canonical_generator_id", "architecture").distinct()


@query("external_cohorts", sql(SOURCE, f"""
train AS (SELECT DISTINCT canonical_generator_id AS g, architecture AS a FROM source_rows WHERE {TRAIN_SQL}),
val AS (SELECT DISTINCT canonical_generator_id AS g FROM source_rows WHERE {HELD_SQL}),
ev AS (SELECT DISTINCT canonical_generator_id, architecture FROM source_rows)""", select="SELECT canonical_generator_id, CASE WHEN architecture IN (SELECT a FROM train) THEN 'seen_family' ELSE 'unseen_family' END AS cohort FROM ev WHERE canonical_generator_id NOT IN (SELECT g FROM train UNION SELECT g FROM val)"))
def external_cohorts(spark, sf):
    rows = source_rows(spark, sf)
    train = rows.filter(in_train())
    seen = train.select("canonical_generator_id").union(rows.filter(in_validation()).select("canonical_generator_id")).distinct()
    families = train.select("architecture", F.lit(True).alias("_seen")).distinct()
    unseen = rows.select("canonical_generator_id", "architecture").distinct().join(seen, "canonical_generator_id", "left_anti")
    return unseen.join(families, "architecture", "left").select("canonical_generator_id", F.when(F.col("_seen"), "seen_family").otherwise("unseen_family").alias("cohort"))


# Deduplication


@query("dedup_min_digest", sql(SOURCE, select=f"SELECT source_file, name, image_name FROM (SELECT *, row_number() OVER (PARTITION BY source_file, name ORDER BY {digest_sql('7', 'image_name')}, image_name) AS k FROM (SELECT *, lower(trim(' ' || canonical_generator_id || '/' || row_group % 3 || ' ')) AS name FROM source_rows)) WHERE k = 1"))
def dedup_min_digest(spark, sf):
    name = F.lower(F.trim(F.concat(F.lit(" "), F.col("canonical_generator_id"), F.lit("/"), (F.col("row_group") % 3).cast("string"), F.lit(" "))))
    return dedup.first_by(source_rows(spark, sf).withColumn("name", name), ["source_file", "name"], stable_digest(7, F.col("image_name")), "image_name").select("source_file", "name", "image_name")


@query("dedup_first_seen", sql(MANIFEST, select="SELECT sha256, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(sha256) ORDER BY doc_id) AS k FROM manifest) WHERE k = 1"))
def dedup_first_seen(spark, sf):
    return dedup.first_by(manifest(spark, sf), [F.lower("sha256")], "doc_id").select("sha256", "sample_id")


@query("exact_dup_groups", "SELECT sha256(text) AS text_digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_digest"))
    return dedup.duplicate_groups(rows, "text_digest", F.min("doc_id").alias("first_id"))


@query("dup_keeper", "SELECT doc_id, copies, keeper, doc_id = keeper AS is_keeper FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY " + digest_sql("47", "sha256(text)", "doc_id") + ") AS keeper FROM documents) WHERE copies > 1")
def dup_keeper(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_digest"))
    return dedup.with_keeper(rows, "text_digest", "doc_id", stable_digest(47, F.col("text_digest"), F.col("doc_id"))).select("doc_id", "copies", "keeper", "is_keeper")


FROZEN_SQL = f"{digest_sql('79', 'doc_id')} < '1'"


@query("admission_status", f"SELECT doc_id, CASE WHEN h IN (SELECT sha256(text) FROM documents WHERE {FROZEN_SQL}) THEN 'excluded' WHEN k > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents WHERE NOT {FROZEN_SQL})")
def admission_status(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    frozen = stable_digest(79, F.col("doc_id")) < "1"
    return dedup.admit(rows.filter(~frozen), "h", rows.filter(frozen), F.col("doc_id")).select("doc_id", "status")


@query("dup_counts", sql(MANIFEST, select="SELECT split, count(sha256) - count(DISTINCT sha256) AS sha256_repeats, count(sample_id) - count(DISTINCT sample_id) AS id_repeats FROM manifest GROUP BY split"))
def dup_counts(spark, sf):
    return manifest(spark, sf).groupBy("split").agg(audit.repeats("sha256").alias("sha256_repeats"), audit.repeats("sample_id").alias("id_repeats"))


@query("distinct_listing", sql(MANIFEST, select="SELECT split, string_agg(DISTINCT generator_id, ',' ORDER BY generator_id) AS generators FROM manifest GROUP BY split"))
def distinct_listing(spark, sf):
    return manifest(spark, sf).groupBy("split").agg(F.array_join(F.sort_array(F.collect_set("generator_id")), ",").alias("generators"))


# Set operations


@query("union_manifests", sql(MANIFEST, select="SELECT sample_id, split FROM manifest WHERE split = 'train' UNION ALL SELECT sample_id, split FROM manifest WHERE label = 0"))
def union_manifests(spark, sf):
    rows = manifest(spark, sf).select("sample_id", "split", "label")
    return rows.filter("split = 'train'").unionByName(rows.filter("label = 0")).drop("label")


@query("union_distinct_ids", sql(MANIFEST, select="SELECT generator_id FROM manifest WHERE split = 'train' UNION SELECT generator_id FROM manifest WHERE split = 'test'"))
def union_distinct_ids(spark, sf):
    rows = manifest(spark, sf)
    return rows.filter("split = 'train'").select("generator_id").union(rows.filter("split = 'test'").select("generator_id")).distinct()


@query("intersect_ids", sql(MANIFEST, select="SELECT sha256 FROM manifest WHERE split = 'train' INTERSECT SELECT sha256 FROM manifest WHERE split <> 'train'"))
def intersect_ids(spark, sf):
    rows = manifest(spark, sf)
    return rows.filter("split = 'train'").select("sha256").intersect(rows.filter("split <> 'train'").select("sha256"))


@query("except_ids", sql(MANIFEST, select="SELECT sha256 FROM manifest WHERE split = 'train' EXCEPT SELECT sha256 FROM manifest WHERE split = 'test'"))
def except_ids(spark, sf):
    rows = manifest(spark, sf)
    return rows.filter("split = 'train'").select("sha256").subtract(rows.filter("split = 'test'").select("sha256"))


@query("set_equality", sql(MANIFEST, "a AS (SELECT DISTINCT generator_id FROM manifest WHERE split = 'train')", "b AS (SELECT DISTINCT generator_id FROM manifest WHERE split = 'test')", select="SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_left, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_right, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) = 0 AS right_is_subset, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT FROM a)) = 0 AS equal_sets"))
def set_equality(spark, sf):
    rows = manifest(spark, sf)
    sides = rows.filter("split IN ('train', 'test')").groupBy("generator_id").agg(F.bit_or(F.when(F.col("split") == "train", 1).otherwise(2)).alias("sides"))
    counts = sides.agg(F.count_if(F.col("sides") == 1).alias("only_left"), F.count_if(F.col("sides") == 2).alias("only_right"))
    return counts.withColumns({"right_is_subset": F.col("only_right") == 0, "equal_sets": (F.col("only_left") == 0) & (F.col("only_right") == 0)})


# Audits


@query("class_counts", sql(MANIFEST, select="SELECT split, count(*) AS rows, count(*) FILTER (WHERE label = 0) AS real_rows, count(*) FILTER (WHERE label = 1) AS generated_rows FROM manifest GROUP BY split"))
def class_counts(spark, sf):
    return manifest(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 0).alias("real_rows"), F.count_if(F.col("label") == 1).alias("generated_rows"))


AUDIT = [
    ("unique ids", "SELECT count(sample_id) - count(DISTINCT sample_id) FROM manifest", "FAIL"),
    ("unique content", "SELECT count(sha256) - count(DISTINCT sha256) FROM manifest", "WARN"),
    ("digest format", "SELECT count(*) FROM manifest WHERE NOT regexp_matches(sha256, '^[0-9a-f]{64}$')", "FAIL"),
    ("labels", "SELECT count(*) FROM manifest WHERE label NOT IN (0, 1)", "FAIL"),
    ("empty content", "SELECT count(*) FROM manifest WHERE byte_size <= 20", "WARN"),
    ("content crosses splits", "SELECT count(*) FROM (SELECT sha256 FROM manifest GROUP BY sha256 HAVING count(DISTINCT split) > 1)", "FAIL"),
    ("content has two labels", "SELECT count(*) FROM (SELECT sha256 FROM manifest GROUP BY sha256 HAVING count(DISTINCT label) > 1)", "WARN"),
]


@query("integrity_checks", sql(MANIFEST, select=" UNION ALL ".join(f"SELECT {i} AS check_order, '{n}' AS \"check\", CASE WHEN f = 0 THEN 'PASS' ELSE '{bad}' END AS result, f AS failures FROM (SELECT ({q}) AS f)" for i, (n, q, bad) in enumerate(AUDIT))))
def integrity_checks(spark, sf):
    rows = manifest(spark, sf)
    content = rows.groupBy("sha256").agg(F.count_distinct("split").alias("splits"), F.count_distinct("label").alias("labels"))
    return audit.run_checks(
        [
            Check("unique ids", rows, audit.repeats("sample_id")),
            Check("unique content", rows, audit.repeats("sha256"), True),
            Check("digest format", rows, where(~I.is_sha256(F.col("sha256")))),
            Check("labels", rows, where(~F.col("label").isin(0, 1))),
            Check("empty content", rows, where(F.col("byte_size") <= 20), True),
            Check("content crosses splits", content, where(F.col("splits") > 1)),
            Check("content has two labels", content, where(F.col("labels") > 1), True),
        ]
    )


@query("leakage_protocol", sql(MANIFEST, "h AS (SELECT generator_id, max((split = 'train')::INT) AS tr, max((split = 'test')::INT) AS te, max((split = 'validation')::INT) AS va FROM manifest GROUP BY generator_id)", select="SELECT count(*) AS generators, count(*) FILTER (WHERE tr = 1 AND te = 1) AS train_and_test, count(*) FILTER (WHERE te = 1 AND tr = 0) AS test_only, count(*) FILTER (WHERE va = 1 AND tr = 0) AS validation_unseen FROM h"))
def leakage_protocol(spark, sf):
    def has(s):
        return F.max((F.col("split") == s).cast("int"))

    held = manifest(spark, sf).groupBy("generator_id").agg(has("train").alias("tr"), has("test").alias("te"), has("validation").alias("va"))
    tr, te, va = (F.col(c) == 1 for c in ("tr", "te", "va"))
    return held.agg(F.count(F.lit(1)).alias("generators"), F.count_if(tr & te).alias("train_and_test"), F.count_if(te & ~tr).alias("test_only"), F.count_if(va & ~tr).alias("validation_unseen"))


@query("architecture_span", sql(MANIFEST, select="SELECT generator_id, count(DISTINCT architecture) AS architectures, count(DISTINCT architecture) = 1 AS single FROM manifest GROUP BY generator_id"))
def architecture_span(spark, sf):
    spans = manifest(spark, sf).groupBy("generator_id").agg(F.count_distinct("architecture").alias("architectures"))
    return spans.withColumn("single", F.col("architectures") == 1)


@query("contribution_spread", sql(MANIFEST, select="SELECT split, max(n) - min(n) AS spread, max(n) - min(n) <= 1 AS balanced FROM (SELECT split, generator_id, count(*) AS n FROM manifest GROUP BY ALL) GROUP BY split"))
def contribution_spread(spark, sf):
    counts = manifest(spark, sf).groupBy("split", "generator_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("split").agg((F.max("n") - F.min("n")).alias("spread")).withColumn("balanced", F.col("spread") <= 1)


@query("conflicting_lineage", sql(MANIFEST, select="SELECT sha256, count(DISTINCT generator_id) AS generators, count(DISTINCT split) AS splits FROM manifest GROUP BY sha256 HAVING count(DISTINCT generator_id) > 1 OR count(DISTINCT split) > 1"))
def conflicting_lineage(spark, sf):
    by = manifest(spark, sf).groupBy("sha256").agg(F.count_distinct("generator_id").alias("generators"), F.count_distinct("split").alias("splits"))
    return by.filter((F.col("generators") > 1) | (F.col("splits") > 1))


@query("lineage_single_valued", "SELECT count(DISTINCT lang) <> 1 AS many_langs, count(DISTINCT source) <> 1 AS many_sources, count(DISTINCT 1) <> 1 AS many_revisions FROM documents")
def lineage_single_valued(spark, sf):
    return t(spark, sf, "documents").withColumn("revision", F.lit(1)).agg(*[(audit.not_one_value(c) == 1).alias(a) for c, a in (("lang", "many_langs"), ("source", "many_sources"), ("revision", "many_revisions"))])


@query("snapshot_row_counts", sql(MANIFEST, CONDITIONS, pred_sql(), select="SELECT 'manifest' AS name, count(*) AS rows FROM manifest UNION ALL SELECT 'predictions', count(*) FROM predictions"))
def snapshot_row_counts(spark, sf):
    frames = {"manifest": manifest(spark, sf), "predictions": predictions(spark, sf)}
    counted = [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, f in frames.items()]
    return counted[0].unionByName(counted[1])


@query("resume_state", sql(MANIFEST, select="SELECT label, count(*) AS planned, count(*) FILTER (WHERE split <> 'test') AS completed, count(*) FILTER (WHERE split <> 'test') > 200 AS over_quota FROM manifest GROUP BY label"))
def resume_state(spark, sf):
    done = F.count_if(F.col("split") != "test")
    return manifest(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("planned"), done.alias("completed"), (done > 200).alias("over_quota"))


@query("calibration_gate", sql(MANIFEST, CONDITIONS, CLEAN, select="SELECT count(*) AS samples, count(*) FILTER (WHERE (pred >= 0.5) <> ((1 / (1 + exp(-(ln(greatest(1e-7, least(1 - 1e-7, pred)) / (1 - greatest(1e-7, least(1 - 1e-7, pred)))) / 2.5)))) >= 0.5)) AS flipped, count(*) FILTER (WHERE (pred >= 0.5) <> ((1 / (1 + exp(-(ln(greatest(1e-7, least(1 - 1e-7, pred)) / (1 - greatest(1e-7, least(1 - 1e-7, pred)))) / 2.5)))) >= 0.5)) = 0 AS available FROM predictions WHERE pred <> 0.5"))
def calibration_gate(spark, sf):
    flipped = F.count_if((F.col("pred") >= 0.5) != (S.temperature_scale(F.col("pred"), 2.5) >= 0.5))
    return predictions(spark, sf, clean_only=True).filter("pred <> 0.5").agg(F.count(F.lit(1)).alias("samples"), flipped.alias("flipped"), (flipped == 0).alias("available"))


# Profiles


@query("split_profile", sql(MANIFEST, "dup AS (SELECT split, count(*) AS dup_groups FROM (SELECT split, sha256 FROM manifest GROUP BY ALL HAVING count(*) > 1) GROUP BY split)", select="SELECT m.split, count(*) AS rows, count(DISTINCT generator_id) AS generators, count(DISTINCT architecture) AS architectures, sum(byte_size)::BIGINT AS bytes, round(avg(byte_size), 6) AS mean_bytes, round(median(byte_size), 6) AS median_bytes, round(quantile_cont(byte_size, 0.95), 6) AS p95_bytes, min(byte_size) || '-' || max(byte_size) AS size_range, coalesce(max(dup_groups), 0) AS dup_groups FROM manifest m LEFT JOIN dup USING (split) GROUP BY m.split"))
def split_profile(spark, sf):
    rows = manifest(spark, sf)
    dup = rows.groupBy("split", "sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("split").agg(F.count(F.lit(1)).alias("dup_groups"))
    size = F.col("byte_size")
    profile = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("generator_id").alias("generators"), F.count_distinct("architecture").alias("architectures"), F.sum(size).alias("bytes"), F.round(F.avg(size), 6).alias("mean_bytes"), F.concat(F.min(size).cast("string"), F.lit("-"), F.max(size).cast("string")).alias("size_range"))
    middle = exact_percentiles(rows, ["split"], "byte_size", {"median_bytes": 0.5, "p95_bytes": 0.95}).select("split", F.round("median_bytes", 6).alias("median_bytes"), F.round("p95_bytes", 6).alias("p95_bytes"))
    return profile.join(middle, "split", "left").join(dup, "split", "left").withColumn("dup_groups", F.coalesce("dup_groups", F.lit(0)))


@query("category_share", sql(MANIFEST, select="SELECT split, architecture, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS share_percent FROM manifest GROUP BY split, architecture"))
def category_share(spark, sf):
    counts = manifest(spark, sf).groupBy("split", "architecture").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share_percent", F.round(F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy("split")), 6))


@query("resolution_zero_fill", sql(SOURCE, "b AS (SELECT unnest(['<=0.10 MP', '0.10-0.30 MP', '0.30-1.00 MP', '1.00-5.00 MP', '>5.00 MP']) AS bin)", "c AS (SELECT CASE WHEN mp <= 0.1 THEN '<=0.10 MP' WHEN mp <= 0.3 THEN '0.10-0.30 MP' WHEN mp <= 1 THEN '0.30-1.00 MP' WHEN mp <= 5 THEN '1.00-5.00 MP' ELSE '>5.00 MP' END AS bin FROM (SELECT byte_size * 10 / 1e6 AS mp FROM source_rows))", select="SELECT b.bin, count(c.bin) AS rows FROM b LEFT JOIN c USING (bin) GROUP BY b.bin"))
def resolution_zero_fill(spark, sf):
    bins = spark.createDataFrame([(b,) for b, _ in I.RESOLUTION_BINS], "bin string")
    counts = source_rows(spark, sf).groupBy(I.resolution_bin(F.col("byte_size") * 10 / 1e6).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    return compare.zero_filled(counts, bins, ["bin"], "rows")


@query("generator_profile", sql(MANIFEST, "tr AS (SELECT DISTINCT generator_id FROM manifest WHERE split = 'train')", select="SELECT m.generator_id, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_percent, string_agg(DISTINCT m.architecture, ',' ORDER BY m.architecture) AS architectures, m.generator_id IN (FROM tr) AS seen_in_train FROM manifest m WHERE m.split <> 'train' GROUP BY m.generator_id"))
def generator_profile(spark, sf):
    rows = manifest(spark, sf)
    seen = rows.filter("split = 'train'").select("generator_id", F.lit(True).alias("_seen")).distinct()
    counts = rows.filter("split <> 'train'").groupBy("generator_id").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.sort_array(F.collect_set("architecture")), ",").alias("architectures"))
    total = Window.partitionBy()
    return counts.join(seen, "generator_id", "left").select("generator_id", "rows", F.round(F.col("rows") * 100.0 / F.sum("rows").over(total), 6).alias("share_percent"), "architectures", F.coalesce("_seen", F.lit(False)).alias("seen_in_train"))


@query("exposure_profile", sql(MANIFEST, "tr AS (SELECT DISTINCT generator_id FROM manifest WHERE split = 'train')", select="SELECT split, count(*) AS generators, count(*) FILTER (WHERE generator_id IN (FROM tr)) AS seen, count(*) FILTER (WHERE generator_id NOT IN (FROM tr)) AS unseen FROM (SELECT DISTINCT split, generator_id FROM manifest) GROUP BY split"))
def exposure_profile(spark, sf):
    rows = manifest(spark, sf)
    seen = rows.filter("split = 'train'").select("generator_id", F.lit(True).alias("_seen")).distinct()
    pairs = rows.select("split", "generator_id").distinct().join(seen, "generator_id", "left")
    return pairs.groupBy("split").agg(F.count(F.lit(1)).alias("generators"), F.count_if(F.col("_seen")).alias("seen"), F.count_if(F.col("_seen").isNull()).alias("unseen"))


@query("top_k", "SELECT p_brand, count(*) AS rows FROM part GROUP BY p_brand ORDER BY rows DESC, p_brand LIMIT 8")
def top_k(spark, sf):
    return t(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "p_brand").limit(8)


@query("distinct_per_group", sql(SOURCE, select="SELECT architecture, count(DISTINCT canonical_generator_id) AS generators, count(DISTINCT source_file) AS files, coalesce(sum(CASE WHEN label = 5 THEN byte_size END), 0)::BIGINT AS no_bytes, min(byte_size) AS least, max(byte_size) AS most FROM source_rows GROUP BY architecture"))
def distinct_per_group(spark, sf):
    return source_rows(spark, sf).groupBy("architecture").agg(F.count_distinct("canonical_generator_id").alias("generators"), F.count_distinct("source_file").alias("files"), F.coalesce(F.sum(F.when(F.col("label") == 5, F.col("byte_size"))), F.lit(0)).alias("no_bytes"), F.min("byte_size").alias("least"), F.max("byte_size").alias("most"))


@query("training_profile", sql(MANIFEST, select="SELECT count(*) AS rows, count(*) FILTER (WHERE label = 0) AS real_rows, count(*) FILTER (WHERE label = 1) AS generated_rows, count(DISTINCT generator_id) FILTER (WHERE label = 1) AS generators, count(DISTINCT architecture) AS architectures FROM manifest WHERE split = 'train'"))
def training_profile(spark, sf):
    y = F.col("label")
    return manifest(spark, sf).filter("split = 'train'").agg(F.count(F.lit(1)).alias("rows"), F.count_if(y == 0).alias("real_rows"), F.count_if(y == 1).alias("generated_rows"), F.count_distinct(F.when(y == 1, F.col("generator_id"))).alias("generators"), F.count_distinct("architecture").alias("architectures"))


# Sorting


@query("ordered_output", "SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, source, doc_id")
def ordered_output(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "n_chars", "source").orderBy(F.desc("n_chars"), "source", "doc_id")


@query("first_k_report", sql(MANIFEST, select="SELECT sha256, copies FROM (SELECT sha256, count(*) AS copies FROM manifest GROUP BY sha256) ORDER BY copies DESC, sha256 LIMIT 20"))
def first_k_report(spark, sf):
    return manifest(spark, sf).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).orderBy(F.desc("copies"), "sha256").limit(20)


# Repair


REPAIR = """
s AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY sample_id) AS k FROM manifest WHERE split <> 'test'),
losers AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS r FROM s WHERE k > 1),
cand AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY """ + digest_sql("53", "sample_id") + """) AS r FROM manifest WHERE split = 'test' AND sha256 NOT IN (SELECT sha256 FROM s) AND sample_id IN (SELECT min(sample_id) FROM manifest WHERE split = 'test' GROUP BY sha256))"""


@query("repair_round", sql(MANIFEST, REPAIR, select="SELECT sample_id, label FROM s WHERE k = 1 UNION ALL SELECT c.sample_id, c.label FROM cand c JOIN losers l ON l.label = c.label AND l.r = c.r"))
def repair_round(spark, sf):
    rows = manifest(spark, sf).select("sample_id", "label", "sha256", "split")
    selection = rows.filter("split <> 'test'")
    losers = repair.exact_duplicate_losers(selection, "sha256", F.col("sample_id"))
    free = dedup.first_by(rows.filter("split = 'test'").join(selection.select("sha256"), "sha256", "left_anti"), ["sha256"], "sample_id")
    lost = losers.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("sample_id"))).select("label", "r")
    ranked = free.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(stable_digest(53, F.col("sample_id")))))
    taken = ranked.join(lost, ["label", "r"], "left_semi").select("sample_id", "label")
    return selection.join(losers.select("sample_id"), "sample_id", "left_anti").select("sample_id", "label").unionByName(taken)


PARTED = (
    SOURCE,
    f"""
parted AS (
  SELECT image_name AS id, architecture AS who, source_file || ':' || (row_group % 5) AS cell, substring({digest_sql("59", "image_name")}, 1, 2) AS part, {digest_sql("61", "image_name")} AS digest FROM source_rows),
losers AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY id) AS k FROM parted WHERE part < '02'),
pool AS (SELECT * FROM parted WHERE part >= '02' AND part < '05')""",
)


def _sequential_sql(same_first: bool) -> str:
    """One loser of each identity after the other, with the list of what has gone."""
    rank = "c.cell <> l.cell" if same_first else "c.cell = l.cell"
    walk = f"""
walk AS (
  SELECT who, 0::BIGINT AS k, []::VARCHAR[] AS gone, NULL::VARCHAR AS loser, NULL::VARCHAR AS replacement FROM (SELECT DISTINCT who FROM losers)
  UNION ALL
  SELECT w.who, w.k + 1, CASE WHEN min(c.id) IS NULL THEN any_value(w.gone) ELSE list_append(any_value(w.gone), arg_min(c.id, ({rank}, c.digest, c.id))) END, any_value(l.id), arg_min(c.id, ({rank}, c.digest, c.id))
  FROM walk w JOIN losers l ON l.who = w.who AND l.k = w.k + 1 LEFT JOIN pool c ON c.who = w.who AND NOT list_contains(w.gone, c.id) GROUP BY w.who, w.k)"""
    return sql(*PARTED, walk, select="SELECT loser, replacement FROM walk WHERE k > 0").replace("WITH", "WITH RECURSIVE", 1)


def _sequential(spark, sf, same_first: bool):
    rows = source_rows(spark, sf)
    name = F.col("image_name")
    parted = rows.select(name.alias("id"), F.col("architecture").alias("who"), F.concat("source_file", F.lit(":"), (F.col("row_group") % 5).cast("string")).alias("cell"), F.substring(stable_digest(59, name), 1, 2).alias("part"), stable_digest(61, name).alias("digest"))
    return repair.replace_sequentially(parted.filter("part < '02'"), parted.filter("part >= '02' AND part < '05'"), "id", ["who"], ["cell"], "digest", same_first)


@query("replacement_in_cell", _sequential_sql(True))
def replacement_in_cell(spark, sf):
    return _sequential(spark, sf, True)


@query("replacement_out_of_cell", _sequential_sql(False))
def replacement_out_of_cell(spark, sf):
    return _sequential(spark, sf, False)
