"""Vector expressions on array columns (float in, double sums out)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once: an expression used inside a
    lambda is otherwise evaluated again for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return bind(norm(v), lambda n: F.transform(as_double(v), lambda x: F.when(n == 0, x).otherwise(x / n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side is the zero vector."""
    return bind(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
        )
    )


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean with partial sums on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))


def sum_vector(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(as_double(v))))
