"""URL filtering: a blocked Bloom filter, then an exact hash join.

A listed entry is a host and a path; it fits that host and all its subdomains,
where the path starts with the entry's. So the canonical forms of a URL that
could be listed are few: each of its last labels as a host, with each listed
path length as a prefix. They are tested against a blocked Bloom filter of the
list, whose block is one row of four 64-bit words, and only possible hits go
to the hash join by the exact string, which removes false positives. The
longest entry decides.

A short list and its filter are part of the expression: every row is judged
where it is read, and nothing shuffles. Of a longer list each distinct URL is
judged once, and its verdict is joined back. All expressions are built-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Listed entries up to which the list is part of the expression.
MOST_LITERAL = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a block: four words of 64, of which a key sets one bit each.
WORDS, BITS = 4, 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, n_keys: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """The filter of the column `key`: a row for each block that is not empty, and the number of blocks."""
    n_blocks = max(1, -(-n_keys * bits_per_key // BITS))
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block")
    return keys.groupBy(block).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))]), n_blocks


def _bounded(df: DataFrame, n_rows: int, row_bytes: int, max_broadcast_bytes: int) -> DataFrame:
    """Broadcast where its rows are known to fit the bound, else a shuffled hash join."""
    return F.broadcast(df) if n_rows * row_bytes <= max_broadcast_bytes else df.hint("shuffle_hash")


def _forms(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """The forms of a URL that could be listed: its last labels as a host, with a beginning of its path."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    forms = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path"), F.concat(h, p).alias("key")))))
    return F.when(host != "", forms)


def _best_of_literals(forms: Column, listed: DataFrame, n_rules: int) -> Column:
    """The longest listed form, as key and verdict: the filter's blocks and the list are literals."""
    blocks, n_blocks = bloom_blocks(listed, n_rules)
    filled = {r["block"]: r for r in blocks.collect()}
    words = [F.array(*[F.lit(filled[b][f"w{i}"] if b in filled else 0).cast("long") for b in range(n_blocks)]) for i in range(WORDS)]
    verdicts = F.create_map(*[F.lit(x) for r in listed.orderBy("host", "path").collect() for x in (f"{r['host']}\0{r['path']}", r["verdict"])])

    def possible(form: Column) -> Column:
        at = (F.pmod(F.xxhash64(form["key"]), F.lit(n_blocks)) + 1).cast("int")
        hit = F.lit(True)
        for word, bit in zip(words, _bits(form["key"]), strict=True):
            hit = hit & (F.element_at(word, at).bitwiseAND(bit) != 0)
        return hit

    def verdict(form: Column) -> Column:
        return F.element_at(verdicts, F.concat(form["host"], F.lit("\0"), form["path"]))

    hits = F.filter(F.transform(F.filter(forms, possible), lambda f: F.struct(F.length(f["key"]).alias("n"), F.length(f["host"]).alias("h"), f["key"].alias("key"), verdict(f).alias("verdict"))), lambda f: f["verdict"].isNotNull())
    return F.array_max(hits)


def _judged_apart(urls: DataFrame, listed: DataFrame, n_rules: int, longest: int, labels: int, lengths: list[int], max_broadcast_bytes: int) -> DataFrame:
    """_sw_url, _sw_rule and _sw_verdict of the distinct URLs that something fits."""
    forms = urls.select("_sw_url", F.explode(_forms(F.col("_sw_host"), F.col("_sw_path"), labels, lengths)).alias("form")).select("_sw_url", "form.host", "form.path", "form.key")
    blocks, n_blocks = bloom_blocks(listed, n_rules)
    probed = forms.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).join(_bounded(blocks, n_blocks, 64, max_broadcast_bytes), "block")
    for i, bit in enumerate(_bits(F.col("key"))):
        probed = probed.filter(F.col(f"w{i}").bitwiseAND(bit) != 0)
    hits = probed.select("_sw_url", "host", "path").join(_bounded(listed, n_rules, 2 * longest + 64, max_broadcast_bytes), ["host", "path"])
    best = hits.groupBy("_sw_url").agg(F.max(F.struct(F.length("key").alias("n"), F.length("host").alias("h"), F.col("key"), F.col("verdict"))).alias("best"))
    return best.select("_sw_url", F.col("best.key").alias("_sw_rule"), F.col("best.verdict").alias("_sw_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_broadcast_bytes: int = 32 << 20, max_literal: int = MOST_LITERAL) -> DataFrame:
    """pages with the columns host, path, rule and verdict put in place of any of those names.

    rules: host (lower case), path, verdict; of repeated entries the verdict that sorts first counts, entries with a null are void. A URL takes the verdict of the longest entry that fits it (host and path together, then the longer host); where none fits, rule is null and verdict is default. A null URL, or one without `://`, has an empty host and path, fits nothing, and gets default. Rows of pages are kept one for one, repeated ones too; an empty table gives an empty result.
    A list of at most max_literal entries is judged in place; a longer one is broadcast up to max_broadcast_bytes and joined by a shuffle beyond, as is its filter.
    """
    listed = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", F.concat("host", "path")).select("key", "host", "path", "verdict")
    facts = listed.agg(F.count(F.lit(1)), F.max(F.length("key")), F.max(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    n_rules, longest, labels, lengths = facts[0], facts[1] or 0, facts[2] or 0, sorted(facts[3] or [])
    host, path = host_and_path(F.col(f"`{url_col}`"))
    out = pages.withColumns({"_sw_host": host, "_sw_path": path})
    if not n_rules:
        out = out.withColumns({"_sw_rule": F.lit(None).cast("string"), "_sw_verdict": F.lit(None).cast("string")})
    elif n_rules <= max_literal:
        out = out.withColumn("_sw_best", _best_of_literals(_forms(F.col("_sw_host"), F.col("_sw_path"), labels, lengths), listed, n_rules)).withColumns({"_sw_rule": F.col("_sw_best.key"), "_sw_verdict": F.col("_sw_best.verdict")})
    else:
        # a null URL and one without a host fit nothing, so they need no partner; they stay where they are
        out = out.withColumn("_sw_url", F.when(F.col("_sw_host") != "", F.col(f"`{url_col}`")))
        urls = out.filter("_sw_url IS NOT NULL").select("_sw_url", "_sw_host", "_sw_path").distinct()
        judged = _judged_apart(urls, listed, n_rules, longest, labels, lengths, max_broadcast_bytes)
        none = out.filter("_sw_url IS NULL").withColumns({"_sw_rule": F.lit(None).cast("string"), "_sw_verdict": F.lit(None).cast("string")})
        out = out.filter("_sw_url IS NOT NULL").join(judged, "_sw_url", "left").select(*none.columns).unionByName(none)
    out = out.withColumn("_sw_verdict", F.coalesce("_sw_verdict", F.lit(default)))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, *[F.col(f"_sw_{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {', '.join(str(r) for r in RULES)}),
p AS (SELECT row_number() OVER () AS rn, page_id,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT q.rn, q.page_id, q.host, q.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY q.rn ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
      FROM q LEFT JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
