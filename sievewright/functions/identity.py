"""Column expressions for identities, names, locators and labels (all JVM-side)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SEPARATOR = "\u001f"
UNSPECIFIED = "UNSPECIFIED"
NULLISH = ("n/a", "na", "none", "null")
REAL_SOURCES = (("landscape", "Landscapes HQ"), ("ffhq", "FFHQ"), ("vision", "VISION"), ("raise", "RAISE"), ("laion", "LAION"), ("coco", "COCO"))
RESOLUTION_BINS = (("<=0.10 MP", 0.10), ("0.10-0.30 MP", 0.30), ("0.30-1.00 MP", 1.00), ("1.00-5.00 MP", 5.00), (">5.00 MP", None))
CONDITION_GROUPS = (("clean", 0, 0), ("single_stage", 1, 15), ("two_stage", 16, 17), ("four_stage", 18, 19), ("six_stage", 20, 20))
CONDITION_GROUPS_V2 = (("clean", 0, 0), ("legacy_single_stage", 1, 15), ("legacy_two_stage", 16, 17), ("new_four_stage_a", 18, 18), ("new_four_stage_b", 19, 19), ("new_six_stage", 20, 20))
EXTENSIONS = {"JPEG": ".jpg", "JPG": ".jpg", "PNG": ".png", "WEBP": ".webp", "TIFF": ".tif", "BMP": ".bmp"}
LOCATOR = ("dataset_key", "source_file", "row_group", "row_index")


def text(value: Column | str | int) -> Column:
    """A value as text; null is the word None, so that no part of a digest vanishes."""
    col = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(col.cast("string"), F.lit("None"))


def stable_digest(seed: Column | str | int, *values: Column | str | int) -> Column:
    """SHA-256 of seed and values, joined by U+001F."""
    return F.sha2(F.concat_ws(SEPARATOR, text(seed), *map(text, values)), 256)


def row_key(seed: str | int, *scope: str) -> Column:
    """Digest of a row's locator and name."""
    return stable_digest(seed, *scope, *[F.col(c) for c in LOCATOR], F.col("image_name"))


def colon_rank(seed: str | int, value: Column) -> Column:
    """The other convention: SHA-256 of seed:value."""
    return F.sha2(F.concat(text(seed), F.lit(":"), text(value)), 256)


def uniform(digest: Column) -> Column:
    """A number from 0 to 1 from a digest's first 32 bits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility normalisation, for columns that are not ASCII; Spark has no such function."""
    return values.str.normalize("NFKC")


def canonical_generator_id(value: Column, ascii_only: bool = False) -> Column:
    """Lower-case identity with slashes between its parts; of a hub address the path only. Compatibility characters count as what they stand for; ascii_only leaves that step, which runs in Python, out of the plan where no value needs it."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    plain = F.lower(F.trim(text if ascii_only else nfkc(text), F.lit(" \t\n\r\x0b\x0c")))
    plain = F.regexp_replace(F.regexp_replace(plain, r"^https?://huggingface\.co/", ""), r"\\", "/")
    parts = F.transform(F.split(plain, "/"), lambda p: F.regexp_replace(F.regexp_replace(p, r"[^a-z0-9.+-]+", "-"), r"^[-.]+|[-.]+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def canonical_real_source(value: Column) -> Column:
    """The first known source whose key is in the value, or the empty string."""
    compact = F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), r"[^a-z0-9]+", "")
    return reduce(lambda chain, pair: chain.when(F.contains(compact, F.lit(pair[0])), pair[1]), REAL_SOURCES[1:], F.when(F.contains(compact, F.lit(REAL_SOURCES[0][0])), REAL_SOURCES[0][1])).otherwise("")


def clean_nullish(value: Column, fallback: str = UNSPECIFIED) -> Column:
    trimmed = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when((trimmed == "") | F.lower(trimmed).isin(*NULLISH), fallback).otherwise(trimmed)


def format_name(value: Column) -> Column:
    upper = F.upper(clean_nullish(value))
    return F.when(upper.isin("JPG", "JPEG"), "JPEG").when(upper.isin("TIF", "TIFF"), "TIFF").otherwise(upper)


def safe_stem(value: Column, most: int = 80) -> Column:
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    cut = F.substring(stem, 1, most)
    return F.when(cut == "", "image").otherwise(cut)


def extension(fmt: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.upper(F.coalesce(fmt, F.lit("")))), F.lit(".img"))


def sample_id(prefix: str, split: Column, label: Column, digest: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), split, class_name(label), F.substring(digest, 1, 16))


def relative_path(split: Column, label: Column, identity: Column, ext: Column) -> Column:
    return F.concat(split, F.lit("/"), class_name(label), F.lit("/"), identity, ext)


def class_name(label: Column) -> Column:
    return F.when(label == 1, "aigi").otherwise("real")


def is_safe_path(path: Column) -> Column:
    """Relative, not empty, no `.` or `..` or empty part once backslashes are slashes."""
    plain = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.split(plain, "/")
    return (plain != "") & ~plain.startswith("/") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def generator_id(label: Column, canonical: Column, source: Column) -> Column:
    return F.when(label == 1, canonical).otherwise(F.concat(F.lit("real:"), source))


def identity_with_fallback(canonical: Column, generator: Column) -> Column:
    return F.coalesce(F.nullif(canonical, F.lit("")), F.nullif(generator, F.lit("")), F.lit(""))


def family(label: Column, architecture: Column) -> Column:
    return F.when(label == 1, architecture).otherwise("Real")


def megapixels(width: Column, height: Column) -> Column:
    return width * height / F.lit(1e6)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def resolution_bin(mp: Column) -> Column:
    chain = F.when(mp <= RESOLUTION_BINS[0][1], RESOLUTION_BINS[0][0])
    for name, upper in RESOLUTION_BINS[1:-1]:
        chain = chain.when(mp <= upper, name)
    return chain.otherwise(RESOLUTION_BINS[-1][0])


def condition_group(index: Column, groups=CONDITION_GROUPS) -> Column:
    chain = F.when(index.between(groups[0][1], groups[0][2]), groups[0][0])
    for name, low, high in groups[1:]:
        chain = chain.when(index.between(low, high), name)
    return chain


def short_digest(value: Column, n: int = 12) -> Column:
    return F.substring(value, 1, n)


def locator_text() -> Column:
    return F.concat_ws("|", *[text(F.col(c)) for c in LOCATOR])


def locator_or_null() -> Column:
    """The locator as one value, null where any part is missing or blank."""
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in LOCATOR])
    return F.when(whole, locator_text())


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


def percent_interval(low: Column, high: Column) -> Column:
    return F.format_string("%.2f%%-%.2f%%", low * 100, high * 100)
