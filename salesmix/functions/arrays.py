"""Vectors and row-major square matrices held in array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def array_scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def add_diag(matrix: Column, value: Column, p: int) -> Column:
    """Add ``value`` to each diagonal element of a p x p matrix."""
    return F.transform(
        matrix, lambda x, i: F.when(i % (p + 1) == 0, x + value).otherwise(x))


def diag_of(vector: Column) -> Column:
    """The diagonal matrix with ``vector`` on its diagonal."""
    return F.flatten(F.transform(
        vector,
        lambda x, i: F.transform(
            vector, lambda _, j: F.when(i == j, x).otherwise(F.lit(0.0)))))


def outer_diff(b: Column, m: Column) -> Column:
    """(b - m)(b - m)' as a row-major matrix."""
    diff = F.zip_with(b, m, lambda x, y: x - y)
    return F.flatten(F.transform(diff, lambda x: F.transform(diff, lambda y: x * y)))


def upper_triangle(vector: str, p: int) -> Column:
    """Products v[i] * v[j], j >= i, row by row.

    ``vector`` names a column; the expression stays as small for many elements as for
    few, where one product per pair would outgrow a generated method.
    """
    return F.expr(f"flatten(transform({vector}, (x, i) -> "
                  f"transform(slice({vector}, i + 1, {p}), y -> x * y)))")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def quadratic_form(matrix: Column, vector: Column, p: int) -> Column:
    """v' M v for a row-major p x p matrix."""
    rows = F.transform(
        vector, lambda x, i: x * dot(F.slice(matrix, i * p + 1, F.lit(p)), vector))
    return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x)


def from_columns(*cols: Column) -> Column:
    return F.array(*[c.cast("double") for c in cols])
