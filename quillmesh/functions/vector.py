"""Vector functions over array columns, JVM-side; and numeric helpers of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def doubles(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def clipped_dot(a: Column | str, b: Column | str) -> Column:
    """For unit vectors: at least 0; 0 where sizes differ."""
    return F.when(F.size(col(a)) == F.size(col(b)), F.greatest(dot(a, b), F.lit(0.0))).otherwise(0.0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """At least 0; 0 for a zero vector; sizes that differ fail."""
    sized = F.when(F.size(col(a)) != F.size(col(b)), F.raise_error(F.lit("vectors differ in size")).cast("double"))
    n = norm(a) * norm(b)
    return F.coalesce(sized, F.when(n == 0, 0.0).otherwise(F.greatest(dot(a, b) / F.when(n == 0, 1.0).otherwise(n), F.lit(0.0))))


def l2_normalize(a: Column | str) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(col(a), lambda x: F.when(n > 0, x.cast("double") / F.when(n > 0, n).otherwise(1.0)).otherwise(x.cast("double")))


def distance_to_similarity(distance: Column | str) -> Column:
    return F.greatest(F.lit(1.0) - col(distance), F.lit(0.0))


def clamp(x: Column | str) -> Column:
    return F.least(F.greatest(col(x), F.lit(0.0)), F.lit(1.0))


def confidence(vector: Column | str, keyword: Column | str, centrality: Column | str) -> Column:
    return clamp(vector) * 0.5 + clamp(keyword) * 0.3 + clamp(centrality) * 0.2
