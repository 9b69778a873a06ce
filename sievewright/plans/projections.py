"""Queries over scalar expressions, filters and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import scores as S
from ..sources import tables as src
from .analogues import CONDITIONS, MANIFEST, SOURCE, conditions, digest_sql, manifest, pred_sql, predictions, source_rows, sql, t
from .registry import query

CLEAN = pred_sql(1, "predictions", "c.condition_index = 0")
ROW_KEY = digest_sql("7", "dataset_key", "source_file", "row_group", "row_index", "image_name")


@query("metadata_scan", sql(SOURCE, select="SELECT dataset_key, source_file, row_group, row_index, canonical_generator_id, label FROM source_rows WHERE label IN (0, 1)"))
def metadata_scan(spark, sf):
    rows = source_rows(spark, sf)
    return rows.filter(F.col("label").isin(0, 1)).select("dataset_key", "source_file", "row_group", "row_index", "canonical_generator_id", "label")


@query("second_corpus_scan", "SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'exact_real' ELSE 'exact_generated' END AS cohort, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 0 ELSE 1 END AS label FROM events WHERE (event_type = 'click' AND user_id % 2 = 0) OR (event_type = 'purchase' AND user_id % 2 = 1)")
def second_corpus_scan(spark, sf):
    rows = t(spark, sf, "events").select("event_id", "event_type", "user_id")
    even = F.col("user_id") % 2
    cases = [((F.col("event_type") == "click") & (even == 0), {"cohort": F.lit("exact_real"), "label": F.lit(0)}), ((F.col("event_type") == "purchase") & (even == 1), {"cohort": F.lit("exact_generated"), "label": F.lit(1)})]
    return src.route(rows, cases).select("event_id", "cohort", "label")


@query("schema_probe", "SELECT 'lang' AS \"column\", lang AS value, count(*) AS rows FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL")
def schema_probe(spark, sf):
    return src.probe(t(spark, sf, "documents").select("lang", "source"), ["lang", "source"])


@query("stable_digest", f"SELECT doc_id, {digest_sql('20240101', 'lang', 'source', 'doc_id')} AS digest FROM documents")
def stable_digest(spark, sf):
    return t(spark, sf, "documents").select("doc_id", I.stable_digest(20240101, F.col("lang"), F.col("source"), F.col("doc_id")).alias("digest"))


@query("row_key", sql(SOURCE, select=f"SELECT row_group, row_index, {ROW_KEY} AS row_key FROM source_rows"))
def row_key(spark, sf):
    return source_rows(spark, sf).select("row_group", "row_index", I.row_key(7).alias("row_key"))


@query("colon_rank", "SELECT doc_id, sha256('11:' || doc_id) AS rank_digest FROM documents")
def colon_rank(spark, sf):
    return t(spark, sf, "documents").select("doc_id", I.colon_rank(11, F.col("doc_id")).alias("rank_digest"))


CANONICAL = r"""array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(lower(trim(coalesce(NAME, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '^https?://huggingface\.co/', ''), '\', '/'), '/'), lambda p: regexp_replace(regexp_replace(p, '[^a-z0-9.+-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')), lambda p: p <> ''), '/')"""


@query("canonical_id", f"SELECT p_partkey, {CANONICAL.replace('NAME', chr(39) + ' https://huggingface.co/' + chr(39) + ' || p_brand || chr(92) || p_name || ' + chr(39) + '//x_Y. ' + chr(39))} AS canonical FROM part")
def canonical_id(spark, sf):
    raw = F.concat(F.lit(" https://huggingface.co/"), F.col("p_brand"), F.lit("\\"), F.col("p_name"), F.lit("//x_Y. "))
    return t(spark, sf, "part").select("p_partkey", I.canonical_generator_id(raw, ascii_only=True).alias("canonical"))


NAMED = "CASE user_id % 7 WHEN 0 THEN 'landscapesHQ' WHEN 1 THEN 'FF-HQ 1024' WHEN 2 THEN 'Vision set' WHEN 3 THEN 'raise_1k' WHEN 4 THEN 'LAION 5B' WHEN 5 THEN 'ms coco' ELSE event_type END"


@query("canonical_source", f"""SELECT event_id, CASE WHEN contains(c, 'landscape') THEN 'Landscapes HQ' WHEN contains(c, 'ffhq') THEN 'FFHQ' WHEN contains(c, 'vision') THEN 'VISION' WHEN contains(c, 'raise') THEN 'RAISE' WHEN contains(c, 'laion') THEN 'LAION' WHEN contains(c, 'coco') THEN 'COCO' ELSE '' END AS canonical
FROM (SELECT event_id, regexp_replace(lower({NAMED}), '[^a-z0-9]+', '', 'g') AS c FROM events)""")
def canonical_source(spark, sf):
    k = F.col("user_id") % 7
    raw = F.when(k == 0, "landscapesHQ").when(k == 1, "FF-HQ 1024").when(k == 2, "Vision set").when(k == 3, "raise_1k").when(k == 4, "LAION 5B").when(k == 5, "ms coco").otherwise(F.col("event_type"))
    return t(spark, sf, "events").select("event_id", I.canonical_real_source(raw).alias("canonical"))


@query("clean_nullish", "SELECT event_id, CASE WHEN trim(v) = '' OR lower(trim(v)) IN ('n/a', 'na', 'none', 'null') THEN 'UNSPECIFIED' ELSE trim(v) END AS cleaned FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'None' WHEN 2 THEN '  ' ELSE ' ' || event_type END AS v FROM events)")
def clean_nullish(spark, sf):
    k = F.col("event_id") % 5
    v = F.when(k == 0, " N/A ").when(k == 1, "None").when(k == 2, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type")))
    return t(spark, sf, "events").select("event_id", I.clean_nullish(v).alias("cleaned"))


FORMATS = "CASE l_orderkey % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'tif' WHEN 3 THEN ' Png ' WHEN 4 THEN NULL ELSE 'tiff' END"


@query("format_name", f"SELECT f, count(*) AS rows FROM (SELECT CASE WHEN u IN ('JPG', 'JPEG') THEN 'JPEG' WHEN u IN ('TIF', 'TIFF') THEN 'TIFF' ELSE u END AS f FROM (SELECT upper(coalesce(trim({FORMATS}), 'UNSPECIFIED')) AS u FROM lineitem)) GROUP BY f")
def format_name(spark, sf):
    k = F.col("l_orderkey") % 6
    v = F.when(k == 0, "jpg").when(k == 1, "JPEG").when(k == 2, "tif").when(k == 3, " Png ").when(k == 4, F.lit(None).cast("string")).otherwise("tiff")
    return t(spark, sf, "lineitem").groupBy(I.format_name(v).alias("f")).agg(F.count(F.lit(1)).alias("rows"))


@query("safe_stem", r"SELECT page_id, CASE WHEN s = '' THEN 'image' ELSE s END AS stem FROM (SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 40) AS s FROM pages)")
def safe_stem(spark, sf):
    return t(spark, sf, "pages").select("page_id", I.safe_stem(F.col("url"), 40).alias("stem"))


@query("sample_ids", sql(MANIFEST, select=f"SELECT doc_id, 'cf_' || split || '_' || CASE WHEN label = 1 THEN 'aigi' ELSE 'real' END || '_' || substr({digest_sql('3', 'doc_id')}, 1, 16) AS sample, split || '/' || CASE WHEN label = 1 THEN 'aigi' ELSE 'real' END || '/' || sample_id || '.jpg' AS path FROM manifest"))
def sample_ids(spark, sf):
    rows = manifest(spark, sf)
    return rows.select("doc_id", I.sample_id("cf", F.col("split"), F.col("label"), I.stable_digest(3, F.col("doc_id"))).alias("sample"), I.relative_path(F.col("split"), F.col("label"), F.col("sample_id"), I.extension(F.lit("jpeg"))).alias("path"))


@query("safe_paths", r"""SELECT page_id, p <> '' AND NOT starts_with(p, '/') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe
FROM (SELECT page_id, replace(CASE page_id % 5 WHEN 0 THEN '../' || page_id WHEN 1 THEN 'a\b\' || page_id WHEN 2 THEN '/' || page_id WHEN 3 THEN 'a//b' ELSE 'a/b.png' END, '\', '/') AS p FROM pages)""")
def safe_paths(spark, sf):
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    p = F.when(k == 0, F.concat(F.lit("../"), n)).when(k == 1, F.concat(F.lit("a\\b\\"), n)).when(k == 2, F.concat(F.lit("/"), n)).when(k == 3, "a//b").otherwise("a/b.png")
    return t(spark, sf, "pages").select("page_id", I.is_safe_path(p).alias("safe"))


@query("generator_identity", sql(MANIFEST, select="SELECT sample_id, CASE WHEN label = 1 THEN generator_id ELSE 'real:' || generator_id END AS generator, CASE WHEN label = 1 THEN architecture ELSE 'Real' END AS family, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE generator_id END, ''), nullif(architecture, ''), '') AS identity FROM manifest"))
def generator_identity(spark, sf):
    g = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("generator_id"))
    return manifest(spark, sf).select("sample_id", I.generator_id(F.col("label"), F.col("generator_id"), F.col("generator_id")).alias("generator"), I.family(F.col("label"), F.col("architecture")).alias("family"), I.identity_with_fallback(g, F.col("architecture")).alias("identity"))


@query("size_units", sql(SOURCE, select="SELECT row_group, row_index, image_name, round(width * height / 1e6, 6) AS megapixels, round(byte_size / 1073741824.0, 6) AS gib, round(CASE WHEN width = 0 THEN 0 ELSE byte_size / width::DOUBLE END, 6) AS per_pixel FROM source_rows"))
def size_units(spark, sf):
    return source_rows(spark, sf).select("row_group", "row_index", "image_name", F.round(I.megapixels(F.col("width"), F.col("height")), 6).alias("megapixels"), F.round(F.col("byte_size") / (1 << 30), 6).alias("gib"), F.round(I.ratio(F.col("byte_size"), F.col("width")), 6).alias("per_pixel"))


@query("resolution_bin", "SELECT CASE WHEN mp <= 0.1 THEN '<=0.10 MP' WHEN mp <= 0.3 THEN '0.10-0.30 MP' WHEN mp <= 1 THEN '0.30-1.00 MP' WHEN mp <= 5 THEN '1.00-5.00 MP' ELSE '>5.00 MP' END AS bin, count(*) AS rows FROM (SELECT p_retailprice * p_size / 10000 AS mp FROM part) GROUP BY bin")
def resolution_bin(spark, sf):
    return t(spark, sf, "part").groupBy(I.resolution_bin(F.col("p_retailprice") * F.col("p_size") / 10000).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def _group_sql(groups) -> str:
    return "CASE " + " ".join(f"WHEN condition_index BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in groups) + " END"


@query("condition_group", sql(CONDITIONS, select=f"SELECT condition_index, condition, {_group_sql(I.CONDITION_GROUPS)} AS grouping_a, {_group_sql(I.CONDITION_GROUPS_V2)} AS grouping_b FROM conditions"))
def condition_group(spark, sf):
    i = F.col("condition_index")
    return conditions(spark).select("condition_index", "condition", I.condition_group(i).alias("grouping_a"), I.condition_group(i, I.CONDITION_GROUPS_V2).alias("grouping_b"))


@query("locators", sql(SOURCE, select="SELECT image_name, dataset_key || '|' || source_file || '|' || row_group || '|' || row_index AS locator, substr(sha256(image_name), 1, 12) AS short_digest, CASE WHEN row_group % 4 = 0 THEN NULL ELSE dataset_key || '|' || source_file || '|' || row_group || '|' || row_index END AS known FROM source_rows"))
def locators(spark, sf):
    named = source_rows(spark, sf).withColumns({"locator": I.locator_text(), "short_digest": I.short_digest(F.sha2("image_name", 256))})
    blanked = named.withColumn("source_file", F.when(F.col("row_group") % 4 == 0, " ").otherwise(F.col("source_file")))
    return blanked.select("image_name", "locator", "short_digest", I.locator_or_null().alias("known"))


@query("thresholding", sql(MANIFEST, CONDITIONS, pred_sql(), select="SELECT sample_id, condition_index, pred, CASE WHEN pred >= 0.5 THEN 1 ELSE 0 END AS predicted FROM predictions"))
def thresholding(spark, sf):
    return predictions(spark, sf).select("sample_id", "condition_index", "pred", S.predicted(F.col("pred"), 0.5).alias("predicted"))


LOGIT = "ln(greatest(E, least(1 - E, pred)) / (1 - greatest(E, least(1 - E, pred))))"


@query("score_maps", sql(MANIFEST, CONDITIONS, CLEAN, select=f"SELECT sample_id, round({LOGIT.replace('E', '1e-6')}, 6) AS logit, round(1 / (1 + exp(-pred)), 6) AS sigmoid, round(1 / (1 + exp(-({LOGIT.replace('E', '1e-7')} / 2.5))), 6) AS tempered, round(1 / (1 + exp(-(pred * 3 - 1.5))), 6) AS platt FROM predictions"))
def score_maps(spark, sf):
    p = F.col("pred")
    return predictions(spark, sf, clean_only=True).select("sample_id", F.round(S.logit(p), 6).alias("logit"), F.round(S.sigmoid(p), 6).alias("sigmoid"), F.round(S.temperature_scale(p, 2.5), 6).alias("tempered"), F.round(S.platt(p, 3.0, -1.5), 6).alias("platt"))


@query("entropies", sql(MANIFEST, CONDITIONS, CLEAN, select="SELECT sample_id, round(CASE WHEN pred <= 0 OR pred >= 1 THEN 0 ELSE -(pred * ln(pred) + (1 - pred) * ln(1 - pred)) / ln(2) END, 6) AS bits, round(-(greatest(1e-12, pred) * ln(greatest(1e-12, pred)) + greatest(1e-12, 1 - pred) * ln(greatest(1e-12, 1 - pred))), 6) AS nats FROM predictions"))
def entropies(spark, sf):
    p = F.col("pred")
    return predictions(spark, sf, clean_only=True).select("sample_id", F.round(S.entropy_bits(p), 6).alias("bits"), F.round(S.entropy_nats(p), 6).alias("nats"))


BOTH = """
both_scores AS (SELECT a.*, b.pred AS pred_b FROM predictions a JOIN predictions_b b USING (sample_id, condition_index))"""
TWO = (MANIFEST, CONDITIONS, pred_sql(1, "predictions", "c.condition_index = 0"), pred_sql(2, "predictions_b", "c.condition_index = 0"), BOTH)


def both_scores(spark, sf, clean_only=True):
    """Scores of two versions side by side."""
    b = predictions(spark, sf, 2, clean_only).select("sample_id", "condition_index", F.col("pred").alias("pred_b"))
    return predictions(spark, sf, 1, clean_only).join(b, ["sample_id", "condition_index"])


@query("mixture_weights", sql(*TWO, select="SELECT sample_id, round(greatest(0, least(1, pred * 0.7 + pred_b * 0.3)), 6) AS mixed, CASE WHEN abs(pred - pred_b) > 0.5 THEN 0.25 ELSE 1 END::DOUBLE AS agreement, round(greatest(0.05, abs(pred - 0.5) * 2 * CASE WHEN (pred >= 0.5)::INT = label THEN 1 ELSE 0.5 END), 6) AS reliability FROM both_scores"))
def mixture_weights(spark, sf):
    a, b = F.col("pred"), F.col("pred_b")
    return both_scores(spark, sf).select("sample_id", F.round(S.mixture(a, b, 0.3), 6).alias("mixed"), S.disagreement_weight(a, b).alias("agreement"), F.round(S.reliability(a, F.col("label")), 6).alias("reliability"))


@query("promote", sql(MANIFEST, select="SELECT sample_id, CASE WHEN split = 'validation' THEN 'train' ELSE split END AS split, CASE WHEN split = 'validation' THEN 'promoted' ELSE 'original' END AS generator_exposure FROM manifest"))
def promote(spark, sf):
    moved = F.col("split") == "validation"
    return manifest(spark, sf).select("sample_id", F.when(moved, "train").otherwise(F.col("split")).alias("split"), F.when(moved, "promoted").otherwise("original").alias("generator_exposure"))


@query("interval_text", "SELECT o_orderkey, printf('%.2f%%-%.2f%%', (o_orderkey % 40) / 40.0 * 100, (o_orderkey % 40 + 1) / 40.0 * 100) AS interval_text FROM orders")
def interval_text(spark, sf):
    k = F.col("o_orderkey") % 40
    return t(spark, sf, "orders").select("o_orderkey", I.percent_interval(k / 40, (k + 1) / 40).alias("interval_text"))


@query("hash_format", sql(MANIFEST, select="SELECT sample_id, lower(sha256) AS folded, regexp_matches(CASE WHEN doc_id % 4 = 0 THEN upper(sha256) ELSE sha256 END, '^[0-9a-f]{64}$') AS valid FROM manifest"))
def hash_format(spark, sf):
    given = F.when(F.col("doc_id") % 4 == 0, F.upper("sha256")).otherwise(F.col("sha256"))
    return manifest(spark, sf).select("sample_id", F.lower("sha256").alias("folded"), I.is_sha256(given).alias("valid"))


@query("round_rows", sql(MANIFEST, CONDITIONS, CLEAN, select="SELECT sample_id, round(pred / 3, 6) AS third FROM predictions"))
def round_rows(spark, sf):
    return predictions(spark, sf, clean_only=True).select("sample_id", F.round(F.col("pred") / 3, 6).alias("third"))


# Filters


@query("equality_filter", sql(SOURCE, select="SELECT image_name, canonical_generator_id FROM source_rows WHERE dataset_key = 'lineitem' AND label = 1 AND canonical_generator_id <> ''"))
def equality_filter(spark, sf):
    return source_rows(spark, sf).filter("dataset_key = 'lineitem' AND label = 1 AND canonical_generator_id <> ''").select("image_name", "canonical_generator_id")


@query("case_folded_filter", sql(SOURCE, select="SELECT image_name, official_split FROM source_rows WHERE lower(official_split) = 'train'"))
def case_folded_filter(spark, sf):
    return source_rows(spark, sf).filter(F.lower("official_split") == "train").select("image_name", "official_split")


@query("in_list_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') OR (o_orderpriority LIKE '1%' AND o_totalprice > 100000)")
def in_list_filter(spark, sf):
    return t(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "P") | (F.col("o_orderpriority").like("1%") & (F.col("o_totalprice") > 100000))).select("o_orderkey", "o_orderstatus")


@query("membership_filter", sql(MANIFEST, select="SELECT sample_id FROM manifest WHERE generator_id IN ('src1', 'src2', 'src3') AND sha256 NOT IN (SELECT sha256 FROM manifest WHERE split = 'test')"))
def membership_filter(spark, sf):
    rows = manifest(spark, sf)
    return rows.filter(F.col("generator_id").isin("src1", "src2", "src3")).join(rows.filter("split = 'test'").select("sha256"), "sha256", "left_anti").select("sample_id")


@query("feature_violations", sql(MANIFEST, select="SELECT count(*) FILTER (WHERE label = 1 AND (coalesce(generator_id, '') = '' OR coalesce(architecture, '') = '')) AS generated_bad, count(*) FILTER (WHERE label = 0 AND coalesce(generator_id, '') = '') AS real_bad FROM manifest"))
def feature_violations(spark, sf):
    def blank(c):
        return F.coalesce(c, F.lit("")) == ""

    y = F.col("label")
    return manifest(spark, sf).agg(F.count_if((y == 1) & (blank("generator_id") | blank("architecture"))).alias("generated_bad"), F.count_if((y == 0) & blank("generator_id")).alias("real_bad"))


@query("finite_scores", "SELECT count(*) FILTER (WHERE NOT (isfinite(s) AND s BETWEEN 0 AND 1)) AS bad, count(*) AS rows FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE ELSE value / 100 END AS s FROM events)")
def finite_scores(spark, sf):
    s = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    return t(spark, sf, "events").agg(F.count_if(F.isnan(s) | ~s.between(0, 1)).alias("bad"), F.count(F.lit(1)).alias("rows"))


@query("shared_panels", "SELECT text_digest, copies FROM (SELECT sha256(text) AS text_digest, count(*) AS copies, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT source) AS sources FROM documents GROUP BY 1) WHERE copies > 1 AND langs = 'en'")
def shared_panels(spark, sf):
    groups = t(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("text_digest")).agg(F.count(F.lit(1)).alias("copies"), F.collect_set("lang").alias("langs"))
    return groups.filter((F.col("copies") > 1) & (F.col("langs") == F.array(F.lit("en")))).select("text_digest", "copies")


@query("clean_only", sql(MANIFEST, CONDITIONS, pred_sql(), select="SELECT sample_id, pred, count(*) OVER (PARTITION BY sample_id) AS times FROM predictions WHERE condition = 'clean'"))
def clean_only(spark, sf):
    from pyspark.sql import Window

    return predictions(spark, sf).filter("condition = 'clean'").select("sample_id", "pred", F.count(F.lit(1)).over(Window.partitionBy("sample_id")).alias("times"))


@query("expired_jobs", "SELECT event_id FROM events WHERE event_type <> 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00'")
def expired_jobs(spark, sf):
    return t(spark, sf, "events").filter((F.col("event_type") != "view") & (F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))).select("event_id")


# Sources that need more than one table


@query("payload_fetch", sql(SOURCE, select=f"SELECT image_name, byte_size FROM source_rows WHERE (dataset_key, source_file, row_group, row_index) IN (SELECT (dataset_key, source_file, row_group, row_index) FROM source_rows WHERE substr({ROW_KEY}, 1, 1) = '0')"))
def payload_fetch(spark, sf):
    rows = source_rows(spark, sf)
    wanted = rows.filter(F.substring(I.row_key(7), 1, 1) == "0")
    got = src.fetch(rows.withColumn("payload", F.struct("image_name", "byte_size")), wanted, "payload")
    return got.select("payload.image_name", "payload.byte_size")


@query("rows_as_json", "SELECT 'languages' AS distribution, '{\"lang\":\"' || lang || '\",\"rows\":' || count(*) || '}' AS row_json FROM documents GROUP BY lang UNION ALL SELECT 'statuses', '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"orders\":' || count(*) || '}' FROM orders GROUP BY o_orderstatus")
def rows_as_json(spark, sf):
    return src.rows_as_json({"languages": t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "statuses": t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))})


@query("plan_export", sql(MANIFEST, select="SELECT generator_id, sample_id, split FROM manifest ORDER BY generator_id, sample_id"))
def plan_export(spark, sf):
    return manifest(spark, sf).select("generator_id", "sample_id", "split").orderBy("generator_id", "sample_id")


@query("manifest_union", sql(MANIFEST, select="SELECT sha256, min(sample_id) AS sample_id, count(*) AS seen FROM manifest WHERE split <> 'test' GROUP BY sha256"))
def manifest_union(spark, sf):
    rows = manifest(spark, sf)
    every = rows.filter("split = 'train'").unionByName(rows.filter("split = 'validation'"))
    return every.groupBy("sha256").agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("seen"))


@query("source_routing", "SELECT event_id, CASE event_type WHEN 'click' THEN 'part-a.image' WHEN 'view' THEN 'part-b.image_data' END AS place FROM events WHERE event_type IN ('click', 'view')")
def source_routing(spark, sf):
    cases = [(F.col("event_type") == "click", {"place": F.lit("part-a.image")}), (F.col("event_type") == "view", {"place": F.lit("part-b.image_data")})]
    return src.route(t(spark, sf, "events").select("event_id", "event_type"), cases).select("event_id", "place")


@query("backfill", sql(MANIFEST, select="SELECT sample_id, CASE WHEN split = 'train' THEN 'complete' ELSE 'pending' END AS status, CASE WHEN split = 'train' THEN byte_size END AS byte_size FROM manifest"))
def backfill(spark, sf):
    rows = manifest(spark, sf)
    return src.backfill(rows.select("sample_id"), rows.filter("split = 'train'"), "sample_id", ["byte_size"]).select("sample_id", "status", "byte_size")
