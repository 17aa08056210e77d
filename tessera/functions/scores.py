"""Classes and scores: surprise, event intensity, priors, decay, calibration, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence and presence words as numbers.
CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.3}
PRESENCE = {"definitely": 1.0, "likely": 0.75, "possibly": 0.5, "unlikely": 0.25, "absent": 0.0}


def surprise(actual: Column, expected: Column, threshold: float = 0.02, around_zero: float = 0.02) -> Column:
    """Beat, Meet or Miss, relative to the expectation's size; absolute where it is zero."""
    d = actual - expected
    rel = d / F.abs(F.when(expected != 0, expected))
    zero = F.when(d > around_zero, "Beat").when(d < -around_zero, "Miss").otherwise("Meet")
    return F.when(actual.isNull() | expected.isNull(), None).when(expected == 0, zero).when(rel >= threshold, "Beat").when(rel <= -threshold, "Miss").otherwise("Meet")


def root(code: Column) -> Column:
    """The two-digit root of an event code that may lack its leading zero."""
    s = F.trim(code.cast("string"))
    return F.when(s != "", F.substring(F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s), 1, 2).try_cast("int"))


def intensity(code: Column) -> Column:
    r = root(code)
    return F.when(r.between(1, 9), "Peace").when(r.between(10, 17), "Tension").when(r.between(18, 20), "Violence")


def quad(code: Column) -> Column:
    """Verbal and material cooperation, verbal and material conflict (their bounds are not those of intensity)."""
    r = root(code)
    return F.when(r.between(1, 4), "VC").when(r.between(5, 8), "MC").when(r.between(9, 16), "VK").when(r.between(17, 20), "MK")


def quad_intensity(q: Column) -> Column:
    return F.when(q.isin("1", "2", "VC", "MC"), "Peace").when(q.isin("3", "4", "VK", "MK"), "Tension")


def crowd_prior(p: Column, truth: Column, strength: float = 0.0) -> Column:
    """A struct of expected answer, stability and fd_type; near even odds nothing is expected."""
    vague = p.isNull() | ((F.abs(p - 0.5) <= strength) if strength > 0 else F.lit(False))
    expected = F.when(~vague, F.when(p >= 0.5, "Yes").otherwise("No"))
    kind = F.when(expected.isNull(), "unknown").when(expected == truth, "stability").otherwise("change")
    return F.struct(expected.alias("expected"), F.coalesce(F.bround(F.abs(p - 0.5) * 2, 4), F.lit(0.0)).alias("stability"), kind.alias("fd_type"))


def recency(age: Column, lookback: Column | int) -> Column:
    return 1 - age / F.greatest(lookback if isinstance(lookback, Column) else F.lit(lookback), F.lit(1))


def blend(recent: Column, similarity: Column, weight: float) -> Column:
    return weight * recent + (1 - weight) * similarity


def decay(days: Column, alpha: float) -> Column:
    return F.exp(-alpha * F.abs(days))


def sigmoid(x: Column, a: float = 1.0, b: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(a * x + b)))


def softmax(xs: Column) -> Column:
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def words_to_number(text: Column, table: dict[str, float], default: float) -> Column:
    """By a table of words, or a number within [0, 1], or the default."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(known[F.lower(F.trim(text))], clip(F.trim(text).try_cast("double")), F.lit(default))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
