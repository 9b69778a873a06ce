"""Queries over deterministic sampling, quotas, weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions.identity import stable_digest, uniform
from ..operators import joins, selection, weights
from .analogues import MANIFEST, SOURCE, digest_sql, manifest, source_rows, sql, t
from .registry import query

DOC_DIGEST = digest_sql("5", "sample_id")


def doc_digest():
    return stable_digest(5, F.col("sample_id"))


def src_digest(*scope):
    return stable_digest(7, *scope, F.col("image_name"))


@query("topn_per_group", sql(MANIFEST, select=f"SELECT sample_id, generator_id FROM (SELECT *, row_number() OVER (PARTITION BY generator_id ORDER BY {DOC_DIGEST}) AS k FROM manifest) WHERE k <= 5"))
def topn_per_group(spark, sf):
    return selection.top_n_per_group(manifest(spark, sf), "generator_id", 5, doc_digest()).select("sample_id", "generator_id")


@query("round_robin_pick", sql(MANIFEST, select=f"SELECT sample_id, generator_id FROM (SELECT *, row_number() OVER (PARTITION BY generator_id ORDER BY {DOC_DIGEST}) AS k FROM manifest) ORDER BY k, {digest_sql('5', 'generator_id')}, generator_id LIMIT 100"))
def round_robin_pick(spark, sf):
    return selection.round_robin(manifest(spark, sf), "generator_id", 100, stable_digest(5, F.col("generator_id")), doc_digest()).select("sample_id", "generator_id")


@query("round_robin_natural", sql(MANIFEST, select="SELECT sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, generator_id) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY label, generator_id ORDER BY sha256, sample_id) AS k FROM manifest)) WHERE turn <= 40"))
def round_robin_natural(spark, sf):
    return selection.round_robin_within(manifest(spark, sf), "label", "generator_id", 40, "sha256", "sample_id").select("sample_id", "label")


CELL = "source_file", "row_group"


@query("compact_pick", sql(SOURCE, select=f"SELECT image_name, source_file, row_group FROM (SELECT *, count(*) OVER (PARTITION BY source_file, row_group) AS n FROM source_rows WHERE label = 1) ORDER BY n DESC, {digest_sql('7', chr(39) + 'pick' + chr(39), chr(39) + 'row-group' + chr(39), 'source_file', 'row_group')}, {digest_sql('7', 'image_name')}, image_name LIMIT 500"))
def compact_pick(spark, sf):
    rows = source_rows(spark, sf).filter("label = 1")
    return selection.compact_pick(rows, 500, 7, "pick", CELL, F.struct(src_digest(), F.col("image_name"))).select("image_name", "source_file", "row_group")


@query("balanced_compact", sql(SOURCE, """
s AS (SELECT * FROM source_rows WHERE label = 1 AND architecture IN ('NATION_1', 'NATION_2', 'FRANCE', 'BRAZIL', 'CHINA', 'NATION_3') OR canonical_generator_id IN ('gen-1', 'gen-2', 'gen-3', 'gen-4', 'gen-5', 'gen-6', 'gen-7')), g AS (SELECT canonical_generator_id, row_number() OVER (ORDER BY """ + digest_sql("7", "'bal'", "'generator'", "canonical_generator_id") + """, canonical_generator_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT canonical_generator_id FROM s)),
q AS (SELECT canonical_generator_id, 60 // n + CASE WHEN i <= 60 % n THEN 1 ELSE 0 END AS quota FROM g)""", select=f"""
SELECT image_name, canonical_generator_id FROM (
  SELECT s.*, quota, row_number() OVER (PARTITION BY canonical_generator_id ORDER BY c DESC, {digest_sql('7', chr(39) + 'bal:' + chr(39) + ' || canonical_generator_id', chr(39) + 'row-group' + chr(39), 'source_file', 'row_group')}, {digest_sql('7', 'image_name')}, image_name) AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY canonical_generator_id, source_file, row_group) AS c FROM s) s JOIN q USING (canonical_generator_id)) WHERE k <= quota"""))
def balanced_compact(spark, sf):
    rows = source_rows(spark, sf).filter("label = 1 AND architecture IN ('NATION_1', 'NATION_2', 'FRANCE', 'BRAZIL', 'CHINA', 'NATION_3') OR canonical_generator_id IN ('gen-1', 'gen-2', 'gen-3', 'gen-4', 'gen-5', 'gen-6', 'gen-7')")
    return selection.balanced_compact(rows, "canonical_generator_id", 60, 7, "bal", CELL, F.struct(src_digest(), F.col("image_name"))).select("image_name", "canonical_generator_id")


@query("two_level_order", sql(SOURCE, select=f"SELECT image_name, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {digest_sql('9', 'source_file', 'row_group')}, {digest_sql('7', 'image_name')}, image_name) AS k FROM source_rows) WHERE k <= CASE label WHEN 1 THEN 150 ELSE 100 END"))
def two_level_order(spark, sf):
    needed = F.when(F.col("label") == 1, 150).otherwise(100)
    return selection.top_n_per_group(source_rows(spark, sf), "label", needed, stable_digest(9, F.col("source_file"), F.col("row_group")), src_digest(), F.col("image_name"), most=150).select("image_name", "label")


def _quota_sql(order: str) -> str:
    return f"""SELECT generator_id, size, least(size, f + CASE WHEN k <= 77 - sf THEN 1 ELSE 0 END)::BIGINT AS quota
FROM (SELECT *, sum(f) OVER () AS sf, row_number() OVER (ORDER BY {order}) AS k
      FROM (SELECT generator_id, size, 77 * size // total AS f, 77 * size % total AS r FROM (SELECT generator_id, count(*) AS size, sum(count(*)) OVER ()::BIGINT AS total FROM manifest GROUP BY generator_id)))"""


def _sizes(spark, sf):
    return manifest(spark, sf).groupBy("generator_id").agg(F.count(F.lit(1)).alias("size"))


@query("largest_remainder_quota", sql(MANIFEST, select=_quota_sql("r DESC, size DESC, generator_id DESC")))
def largest_remainder_quota(spark, sf):
    return selection.largest_remainder(_sizes(spark, sf), "generator_id", "size", 77)


@query("quota_ascending_ties", sql(MANIFEST, select=_quota_sql("r DESC, generator_id")))
def quota_ascending_ties(spark, sf):
    return selection.largest_remainder(_sizes(spark, sf), "generator_id", "size", 77, ascending_key=True)


MEMBERS = "members AS (SELECT DISTINCT canonical_generator_id AS member, architecture FROM source_rows)"


def _members(spark, sf):
    return source_rows(spark, sf).select(F.col("canonical_generator_id").alias("member"), "architecture").distinct()


def _pick_sql(source: str, total: str, order: str) -> str:
    return f"""(SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY {digest_sql('13', 'architecture', 'member')}) AS i FROM {source}) m JOIN
(SELECT architecture, f + CASE WHEN k <= {total} - sf THEN 1 ELSE 0 END AS quota FROM (SELECT *, sum(f) OVER () AS sf, row_number() OVER (ORDER BY {order}) AS k FROM
 (SELECT architecture, size, ({total}) * size // total AS f, ({total}) * size % total AS r FROM (SELECT architecture, count(*) AS size, sum(count(*)) OVER ()::BIGINT AS total FROM {source} GROUP BY architecture)))) q
USING (architecture) WHERE i <= quota)"""


@query("stratified_pick", sql(SOURCE, MEMBERS, "rest AS (SELECT * FROM members WHERE member NOT IN ('gen-1', 'gen-2'))", select=f"SELECT member, architecture FROM {_pick_sql('rest', '28', 'r DESC, size DESC, architecture DESC')} UNION ALL SELECT member, architecture FROM members WHERE member IN ('gen-1', 'gen-2')"))
def stratified_pick(spark, sf):
    return selection.stratified_pick(_members(spark, sf), "architecture", "member", 30, 13, ["gen-1", "gen-2"]).select("member", "architecture")


@query("rare_preserving_pick", sql(SOURCE, MEMBERS, "sized AS (SELECT *, count(*) OVER (PARTITION BY architecture) AS n FROM members)", "few AS (SELECT member, architecture FROM sized WHERE n <= 3)", "many AS (SELECT member, architecture FROM sized WHERE n > 3)", select=f"SELECT member, architecture FROM few UNION ALL SELECT member, architecture FROM {_pick_sql('many', '(SELECT (SELECT count(*) FROM few) + (SELECT count(*) FROM many) // 2 - (SELECT count(*) FROM few))', 'r DESC, architecture')}"))
def rare_preserving_pick(spark, sf):
    members = _members(spark, sf)
    sized = members.groupBy("architecture").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") <= 3, F.col("n"))), F.lit(0)).alias("few"), F.coalesce(F.sum(F.when(F.col("n") > 3, F.col("n"))), F.lit(0)).alias("many")).first()
    return selection.rare_preserving_pick(members, "architecture", "member", sized["few"] + sized["many"] // 2, 13, rare=3).select("member", "architecture")


@query("feasible_allocation", sql(SOURCE, select="SELECT c AS contribution, (10000 // c) AS groups_needed, n AS groups_available FROM (SELECT c, (SELECT count(*) FROM (SELECT count(*) AS size FROM source_rows GROUP BY canonical_generator_id) WHERE size >= c) AS n FROM (SELECT range::INTEGER AS c FROM range(10, 1001, 10)) WHERE 10000 % c = 0) WHERE n >= 10000 // c ORDER BY c DESC LIMIT 1"))
def feasible_allocation(spark, sf):
    sizes = source_rows(spark, sf).groupBy("canonical_generator_id").agg(F.count(F.lit(1)).alias("size"))
    return selection.feasible_contribution(sizes, "size", 10000).filter("contribution IS NOT NULL")


@query("ordered_split", sql(MANIFEST, select=f"SELECT sample_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {DOC_DIGEST}) <= 15 THEN 'validation' ELSE 'train' END AS project_split FROM manifest"))
def ordered_split(spark, sf):
    return selection.ordered_split(manifest(spark, sf), ["label"], doc_digest(), 15).select("sample_id", "label", "project_split")


@query("shortage_supplement", sql(MANIFEST, select=f"SELECT sample_id, generator_id FROM (SELECT *, row_number() OVER (PARTITION BY generator_id ORDER BY {DOC_DIGEST}) AS k FROM manifest WHERE label = 1) WHERE k <= 12 ORDER BY k, generator_id LIMIT 90"))
def shortage_supplement(spark, sf):
    capped = selection.top_n_per_group(manifest(spark, sf).filter("label = 1"), "generator_id", 12, doc_digest())
    return selection.round_robin(capped, "generator_id", 90, F.col("generator_id"), doc_digest()).select("sample_id", "generator_id")


@query("representative_row", sql(MANIFEST, select="SELECT generator_id, sample_id, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY generator_id ORDER BY sha256, sample_id) AS k FROM manifest) WHERE k = 1"))
def representative_row(spark, sf):
    return selection.representative(manifest(spark, sf), "generator_id", "sha256", "sample_id").select("generator_id", "sample_id", "sha256")


@query("shard_ranges", "SELECT o_orderkey, pos AS position, ((pos + 1) * 7 - 1) // n AS shard FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders))")
def shard_ranges(spark, sf):
    return selection.contiguous_shards(t(spark, sf, "orders").select("o_orderkey").distinct(), 7, "o_orderkey").select("o_orderkey", "position", F.col("shard").cast("long").alias("shard"))


@query("byte_cap", sql(SOURCE, select=f"SELECT image_name, source_file, running_bytes FROM (SELECT *, sum(byte_size) OVER (PARTITION BY source_file ORDER BY row_group, row_index, {digest_sql('7', 'image_name')} ROWS UNBOUNDED PRECEDING)::BIGINT AS running_bytes FROM source_rows) WHERE running_bytes <= 3000000"))
def byte_cap(spark, sf):
    rows = source_rows(spark, sf).withColumn("d", src_digest())
    return selection.byte_cap(rows, ["source_file"], "byte_size", 3_000_000, "row_group", "row_index", "d").select("image_name", "source_file", "running_bytes")


@query("inverse_weights", sql(MANIFEST, select="SELECT sample_id, round(1.0 / count(*) OVER (PARTITION BY label, architecture, CASE WHEN label = 1 THEN generator_id ELSE 'real' END), 8) AS weight FROM manifest"))
def inverse_weights(spark, sf):
    rows = weights.inverse_frequency(manifest(spark, sf), "label", "architecture", F.when(F.col("label") == 1, F.col("generator_id")).otherwise("real"))
    return rows.select("sample_id", F.round("weight", 8).alias("weight"))


@query("inverse_weights_by_view", sql(MANIFEST, select="SELECT sample_id, view, round(1.0 / count(*) OVER (PARTITION BY label, generator_id), 8) AS weight FROM manifest CROSS JOIN (SELECT unnest([1, 2, 3])::INTEGER AS view)"))
def inverse_weights_by_view(spark, sf):
    rows = weights.inverse_frequency(manifest(spark, sf), "label", "generator_id")
    return rows.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("sample_id", "view", F.round(F.col("weight") / 3, 8).alias("weight"))


FAMILY = {"en": 0.5, "de": 0.25, "fr": 0.125, "es": 0.125}


@query("hierarchical_mass", sql(MANIFEST, """
named AS (SELECT *, CASE WHEN label = 1 THEN architecture ELSE '' END AS family, CASE WHEN label = 1 THEN architecture || '/' || generator_id ELSE generator_id END AS member FROM manifest),
cells AS (SELECT label, family, member, count(*) AS n, sqrt(count(*)) AS w FROM named GROUP BY ALL),
masses AS (SELECT *, CASE WHEN label = 1 THEN 0.5 * CASE family WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.25 ELSE 0.125 END ELSE 0.5 END * w / sum(w) OVER (PARTITION BY label, family) / n AS row_mass FROM cells)""", select="SELECT sample_id, round(row_mass, 9) AS row_mass, round(row_mass / 3, 9) AS weight FROM named JOIN masses USING (label, family, member)"))
def hierarchical_mass(spark, sf):
    rows = manifest(spark, sf).withColumns({"source_dataset": F.col("generator_id"), "generator_id": F.concat("architecture", F.lit("/"), "generator_id")})
    massed = weights.hierarchical_mass(rows, FAMILY, 0.5, 0.5, 3)
    return massed.select("sample_id", F.round("row_mass", 9).alias("row_mass"), F.round("weight", 9).alias("weight"))


@query("weighted_draw", sql(MANIFEST, """
w AS (SELECT sample_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY label, generator_id) AS w, substr(sha256(sample_id), 1, 2) AS b FROM manifest),
runs AS (SELECT sample_id, (sum(w) OVER (ORDER BY b, sample_id) - w) / sum(w) OVER () AS low, sum(w) OVER (ORDER BY b, sample_id) / sum(w) OVER () AS high FROM w),
draws AS (SELECT range AS draw, ('0x' || substring(""" + digest_sql("17", "range") + """, 1, 8))::BIGINT / 4294967295.0 * 0.9999999999 AS u FROM range(500))""", select="SELECT draw, sample_id FROM draws JOIN runs ON u >= low AND u < high"))
def weighted_draw(spark, sf):
    rows = weights.inverse_frequency(manifest(spark, sf), "label", "generator_id")
    return weights.weighted_draw(rows, "sample_id", "weight", 500, 17)


@query("seeded_shuffle", sql(MANIFEST, select="SELECT sample_id, row_number() OVER (ORDER BY " + digest_sql("23", "sample_id") + ") - 1 AS place FROM manifest"))
def seeded_shuffle(spark, sf):
    keyed = manifest(spark, sf).select("sample_id", stable_digest(23, F.col("sample_id")).alias("d"))
    return selection.global_rank(keyed, "d").select("sample_id", F.col("position").alias("place"))


@query("view_expansion", "SELECT doc_id, view, (row_number() OVER (ORDER BY doc_id, view) - 1) AS item FROM documents CROSS JOIN (SELECT unnest([1, 2, 3])::INTEGER AS view)")
def view_expansion(spark, sf):
    ranked = selection.global_rank(t(spark, sf, "documents").select("doc_id"), "doc_id")
    return joins.expand_views(ranked, 4, "doc_id").select("doc_id", "view", "item")


@query("permutation_join", sql(MANIFEST, select="SELECT a.sample_id, b.sample_id AS gate_from FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS k FROM manifest) a JOIN (SELECT sample_id, row_number() OVER (ORDER BY " + digest_sql("29", "sample_id") + ") AS k FROM manifest) b USING (k)"))
def permutation_join(spark, sf):
    rows = manifest(spark, sf).select("sample_id")
    plain = selection.global_rank(rows, "sample_id")
    mixed = selection.global_rank(rows.select(F.col("sample_id").alias("gate_from"), stable_digest(29, F.col("sample_id")).alias("d")), "d")
    return plain.join(mixed.select("gate_from", "position"), "position").select("sample_id", "gate_from")


HOLDOUT = f"""
g AS (SELECT architecture, canonical_generator_id, count(*) AS n FROM source_rows GROUP BY ALL),
first AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY architecture ORDER BY n, canonical_generator_id) = 1),
rest AS (SELECT *, row_number() OVER (ORDER BY {digest_sql("31", "canonical_generator_id")}) AS k FROM g WHERE canonical_generator_id NOT IN (SELECT canonical_generator_id FROM first)),
walk AS (
  SELECT 0::BIGINT AS k, (SELECT sum(n) FROM g) // 3 - (SELECT sum(n) FROM first) AS room, FALSE AS taken
  UNION ALL
  SELECT r.k, CASE WHEN r.n <= w.room THEN w.room - r.n ELSE w.room END, r.n <= w.room FROM walk w JOIN rest r ON r.k = w.k + 1),
room AS (SELECT arg_max(room, k) AS room FROM walk),
last AS (SELECT canonical_generator_id FROM rest WHERE (SELECT room FROM room) > 0 AND k IN (SELECT k FROM walk WHERE NOT taken) ORDER BY n, canonical_generator_id LIMIT 1),
held AS (SELECT canonical_generator_id FROM first UNION SELECT canonical_generator_id FROM rest JOIN walk USING (k) WHERE taken UNION SELECT * FROM last)"""


@query("whole_group_holdout", sql(SOURCE, HOLDOUT, select="SELECT * FROM g WHERE canonical_generator_id IN (SELECT canonical_generator_id FROM held)").replace("WITH", "WITH RECURSIVE", 1))
def whole_group_holdout(spark, sf):
    groups = source_rows(spark, sf).groupBy("architecture", "canonical_generator_id").agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return selection.whole_group_holdout(groups, "architecture", "canonical_generator_id", "n", total // 3, 31)


SIZES = "sizes AS (SELECT generator_id, count(*) AS size FROM manifest GROUP BY generator_id)"
ROUNDED = """
s AS (SELECT *, sum(size) OVER () // 4 AS total FROM sizes),
q AS (SELECT *, least(size, round_even(total * size / sum(size) OVER ()::DOUBLE, 0)::BIGINT) AS quota FROM s),
e AS (SELECT sum(quota) - any_value(total) AS extra FROM q),
less AS (SELECT generator_id, count(*) AS n FROM (SELECT generator_id, unnest(range(1, quota + 1)) AS height FROM q ORDER BY height DESC, generator_id LIMIT (SELECT greatest(extra, 0) FROM e)) GROUP BY generator_id),
more AS (SELECT generator_id, count(*) AS n FROM (SELECT generator_id, unnest(range(1, size - quota + 1)) AS height FROM q ORDER BY height DESC, generator_id LIMIT (SELECT greatest(-extra, 0) FROM e)) GROUP BY generator_id)"""


@query("rounded_quota", sql(MANIFEST, SIZES, ROUNDED, select="SELECT generator_id, size, quota - coalesce(l.n, 0) + coalesce(m.n, 0) AS quota FROM q LEFT JOIN less l USING (generator_id) LEFT JOIN more m USING (generator_id)"))
def rounded_quota(spark, sf):
    sizes = _sizes(spark, sf)
    return selection.rounded_quota(sizes, "generator_id", "size", (sizes.agg(F.sum("size")).first()[0] or 0) // 4)


@query("bounded_shuffle_stream", "SELECT event_id, row_number() OVER (PARTITION BY event_id // 2048 ORDER BY sha256('37:' || event_id)) AS place FROM events WHERE event_id >= 100")
def bounded_shuffle_stream(spark, sf):
    """The batch form of a bounded shuffle (streaming.ingest.ShuffleBuffer has the other): windows of 2,048 arrivals, each in order of a digest. The first hundred events stand for those that a consumer has had before it resumes."""
    w = Window.partitionBy(F.floor(F.col("event_id") / 2048)).orderBy(I.colon_rank(37, F.col("event_id")))
    return t(spark, sf, "events").filter("event_id >= 100").select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("augmentation_choice", "SELECT doc_id, CASE WHEN u < 0.25 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS transforms FROM (SELECT doc_id, ('0x' || substring(" + digest_sql("41", "doc_id") + ", 1, 8))::BIGINT / 4294967295.0 AS u FROM documents)")
def augmentation_choice(spark, sf):
    u = uniform(stable_digest(41, F.col("doc_id")))
    return t(spark, sf, "documents").select("doc_id", F.when(u < 0.25, 0).when(u < 0.75, 1).otherwise(2).alias("transforms"))
