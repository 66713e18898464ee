"""Leaf comparators as Column expressions, inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import SIMILARITIES, similarity

Comparator = Callable[[Column, Column], Column]


def exact(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b).cast("double")


def exact_number(a: Column, b: Column) -> Column:
    """Equality of numbers: NaN equals nothing, itself included."""
    return F.when(F.isnan(a.cast("double")), F.lit(0.0)).otherwise(exact(a, b))


def _by_distance(x: Column, y: Column, unequal: Column) -> Column:
    """1 for equal numbers, infinities too; 0 beside NaN and where a difference has no size; else ``unequal``."""
    return F.when(F.isnan(x) | F.isnan(y), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(F.nanvl(unequal, F.lit(0.0)))


def invdiff(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return _by_distance(x, y, 1 / (1 + F.abs(x - y)))


def relative(a: Column, b: Column) -> Column:
    """One less the difference over the larger size, not below 0; equal numbers, zeros too, give 1."""
    x, y = a.cast("double"), b.cast("double")
    return _by_distance(x, y, F.greatest(F.lit(0.0), F.nanvl(1 - F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))), F.lit(0.0))))


def threshold(score: Column, least: float) -> Column:
    """Scores below ``least`` count as 0; the bound itself stays."""
    return F.when(score < least, F.lit(0.0)).otherwise(score) if least > 0 else score


def null_aware(a: Column, b: Column, score: Column, null_score: float = 0.0) -> Column:
    """Both null: 1. One null: ``null_score``."""
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(float(null_score))).otherwise(score)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, mapping: str = "clip") -> Column:
    """Cosine as a similarity: ``clip`` cuts it to [0, 1], ``affine`` maps [-1, 1] to [0, 1]. A zero vector has cosine 0."""
    if mapping not in ("clip", "affine"):
        raise ValueError(f"mapping must be 'clip' or 'affine', not {mapping!r}")
    cos = F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)) if mapping == "clip" else (cos + 1) / 2


COMPARATORS: dict[str, dict[str, Comparator]] = {
    "boolean": {"exact": exact},
    "number": {"exact": exact_number, "invdiff": invdiff, "relative": relative},
    "integer": {"exact": exact_number, "invdiff": invdiff, "relative": relative},
    "string": {name: (lambda a, b, name=name: similarity(name)(a, b)) for name in SIMILARITIES},
}
DEFAULTS = {"boolean": "exact", "number": "invdiff", "integer": "invdiff", "string": "jaro"}
