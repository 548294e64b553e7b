"""Column expressions over vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(vector: Column) -> Column:
    """Unit vector; a zero vector is left as it is."""
    # the one-element array binds the norm, or it would be computed again for every element
    def scaled(length: Column) -> Column:
        return F.when(length == 0, as_double(vector)).otherwise(
            F.transform(as_double(vector), lambda x: x / length))

    return F.get(F.transform(F.array(norm(vector)), scaled), F.lit(0))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays of equal length."""
    products = F.zip_with(as_double(left), as_double(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
