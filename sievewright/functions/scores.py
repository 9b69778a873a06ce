"""Column expressions over scores: thresholds, maps between them, weights, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def predicted(score: Column, threshold: Column | float) -> Column:
    """Inclusive threshold."""
    return (score >= threshold).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, edge: float = 1e-6) -> Column:
    p = clamp(p, edge, 1 - edge)
    return F.ln(p / (1 - p))


def temperature_scale(p: Column, temperature: Column | float) -> Column:
    return sigmoid(logit(p, 1e-7) / temperature)


def platt(x: Column, slope: Column | float, intercept: Column | float) -> Column:
    return sigmoid(x * slope + intercept)


def entropy_bits(p: Column) -> Column:
    inner = -(p * F.ln(p) + (1 - p) * F.ln(1 - p)) / F.ln(F.lit(2.0))
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(inner)


def entropy_nats(p: Column, edge: float = 1e-12) -> Column:
    a, b = clamp(p, edge, 1.0), clamp(1 - p, edge, 1.0)
    return -(a * F.ln(a) + b * F.ln(b))


def reliability(p: Column, label: Column, power: float = 1.0, wrong_scale: float = 0.5, floor: float = 0.05) -> Column:
    """How sure a score is, less where it is on the wrong side, and never under the floor."""
    sure = F.power(2 * F.abs(p - 0.5), F.lit(power))
    return F.greatest(F.lit(floor), F.when(predicted(p, 0.5) == label, sure).otherwise(sure * wrong_scale))


def mixture(a: Column, b: Column, weight_of_b: Column | float) -> Column:
    return clamp(a * (1 - weight_of_b) + b * weight_of_b, 0.0, 1.0)


def disagreement_weight(a: Column, b: Column, most: float = 0.5, scale: float = 0.25) -> Column:
    return F.when(F.abs(a - b) > most, scale).otherwise(1.0)


def cross_entropy(p: Column, label: Column, edge: float = 1e-7) -> Column:
    p = clamp(p, edge, 1 - edge)
    return -(label * F.ln(p) + (1 - label) * F.ln(1 - p))


def symmetric_kl(p: Column, q: Column, edge: float = 1e-7) -> Column:
    """Mean of both directions between two Bernoulli scores."""
    p, q = clamp(p, edge, 1 - edge), clamp(q, edge, 1 - edge)
    return 0.5 * ((p - q) * (F.ln(p) - F.ln(q)) + (q - p) * (F.ln(1 - p) - F.ln(1 - q)))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))

    return 1 - dot / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def smooth_l1(d: Column) -> Column:
    return F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)


def phash_bits(values: Column) -> Column:
    """The 64 bits of a hash, as a long: is a value over the median of all but the first."""
    middle = F.element_at(F.array_sort(F.slice(values, 2, 63)), 32)
    # the median is bound once: inside the inner function alone it would be sorted out again for every value
    bits = F.element_at(F.transform(F.array(middle), lambda m: F.array_join(F.transform(values, lambda x: F.when(x > m, "1").otherwise("0")), "")), 1)
    return F.conv(bits, 2, -10).cast("long")


def hex_bits(value: Column) -> Column:
    """Sixteen hex digits as a signed long."""
    return F.conv(value, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
