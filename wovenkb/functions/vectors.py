"""Vector arithmetic over array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(a: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers."""
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a guard in the denominator; a missing or zero vector gives 0."""
    na, nb = norm(a), norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb + F.lit(1e-8)))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + d)
