"""Vector operators on ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, length: Column) -> Column:
    """Unit-length vector, given the vector's norm; a zero vector stays as it is.

    The norm is an argument so that it is a column computed once, not once per element.
    """
    return F.transform(_double(a), lambda x: x / _nonzero(length))


def _nonzero(length: Column) -> Column:
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine given both norms; 0 where a vector is zero."""
    return dot(a, b) / _nonzero(norm_a * norm_b)


def _distance(squares: Column) -> Column:
    return F.sqrt(_sum(squares))


def euclidean(a: Column, b: Column) -> Column:
    return _distance(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def unit_euclidean(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Distance of the two unit vectors, without building them."""
    p, q = _nonzero(norm_a), _nonzero(norm_b)
    return _distance(F.zip_with(_double(a), _double(b), lambda x, y: (x / p - y / q) * (x / p - y / q)))
