"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column, functions as F


def dot(a, b) -> Column:
    """Inner product; null when the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b) -> Column:
    """Cosine of the angle; null, never NaN, when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def has_direction(a) -> Column:
    """True for a finite, non-zero vector (NaN sorts above infinity in Spark)."""
    length = norm(a)
    return (length > 0) & (length < float("inf"))
