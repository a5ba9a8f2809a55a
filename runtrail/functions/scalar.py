"""Numbers as columns: coercion of hostile values, scores, verdicts, samples, entropy, hashing, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite_float(v: Column, default: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """A finite number from any column, cut to bounds; ``default`` for text that is none, NaN and infinities."""
    x = v.try_cast("double")
    x = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY), x).otherwise(F.lit(float(default)))
    x = F.greatest(x, F.lit(float(low))) if low is not None else x
    return F.least(x, F.lit(float(high))) if high is not None else x


def safe_int(v: Column, default: int = 0) -> Column:
    """An integer from text, hexadecimal with 0x too; ``default`` otherwise."""
    t = F.lower(F.trim(v.cast("string")))
    hexadecimal = F.conv(F.regexp_extract(t, "^0x([0-9a-f]{1,15})$", 1), 16, 10).try_cast("long")
    return F.coalesce(F.when(F.startswith(t, F.lit("0x")), hexadecimal), t.try_cast("long"), F.when(F.abs(t.try_cast("double")) < 9.2e18, F.floor(t.try_cast("double")).try_cast("long")), F.lit(default))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def softmax(scores: Column) -> Column:
    """Over an array of scores, the greatest subtracted first."""
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(powers, normalised)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def verdict(score: Column, suspicious: float = 0.5) -> Column:
    return F.when(score >= 0.8, "malicious").when(score >= suspicious, "suspicious").otherwise("benign")


def fused(static: Column, behaviour: Column, static_label: Column) -> Column:
    """struct(label, confidence, score): the greater of both scores; confidence falls where they disagree."""
    final = F.greatest(static, behaviour)
    agree = (static >= 0.5) == (behaviour >= 0.5)
    confidence = (
        F.when(behaviour.isNull(), F.when(static_label == "benign", "medium").otherwise("low"))
        .when(agree & (F.abs(static - behaviour) < 0.5), "high")
        .when(agree, "medium")
        .when(behaviour >= 0.8, "medium (behavior-driven)")
        .otherwise("low-static/behavior-disagree")
    )
    label = F.when(behaviour.isNull(), static_label).otherwise(verdict(final))
    return F.struct(label.alias("label"), confidence.alias("confidence"), F.when(behaviour.isNull(), static).otherwise(F.round(final, 4)).alias("score"))


def predicted_family(family: Column) -> Column:
    """The family named by a result, also where it is only the closest to an unknown."""
    closest = F.regexp_extract(family, r"^unknown \(closest: (.*)\)$", 1)
    return F.when(closest != "", closest).otherwise(family)


def kept_by_hash(key: Column, salt: str, rate: float) -> Column:
    """A deterministic sample: the first 8 hexadecimal digits of the salted SHA-256 under the rate."""
    digits = F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967295.0) < rate


def crc_bucket(token: Column, n: int) -> Column:
    return (F.crc32(token) % n).cast("int")


def entropy_of_counts(counts: Column) -> Column:
    """Bits per item of an array of counts."""
    bits = lambda counts, total: F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0))
    each = lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda total: F.when(total > 0, bits(c, total)).otherwise(F.lit(0.0)))
    return let(counts, each)


def normalised(histogram: Column) -> Column:
    """An array over its sum; zeros where the sum is zero."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(histogram, lambda x: F.when(t != 0, x / t).otherwise(F.lit(0.0))))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): Wilson's interval of a proportion; null for no trials."""
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct(F.round(F.greatest(F.lit(0.0), centre - half), 8).alias("low"), F.round(F.least(F.lit(1.0), centre + half), 8).alias("high")))
