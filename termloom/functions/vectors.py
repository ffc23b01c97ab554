"""Vector functions on arrays of numbers, computed in doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger components, 0 if the latter is."""
    top = total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(top == 0, F.lit(0.0)).otherwise(total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / top)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def combined(a: Column, b: Column, weights: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> Column:
    """Weighted cosine, inverse Euclidean and inverse Manhattan distance."""
    w = weights
    return w[0] * cosine(a, b) + w[1] / (1 + euclidean(a, b)) + w[2] / (1 + manhattan(a, b))
