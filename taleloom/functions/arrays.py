"""Arithmetic on arrays of numbers and on matrices as arrays of rows, in the JVM.

A null array gives null; arrays of different lengths are an error where they meet; a sum of nothing is 0, a mean, maximum or variance of nothing null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.transform(a, f)


exp = _each(F.exp)
log = _each(F.ln)
sqrt = _each(F.sqrt)
tanh = _each(F.tanh)
relu = _each(lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
sigmoid = _each(lambda x: 1 / (1 + F.exp(-x)))
negative = _each(lambda x: -x)


def _paired(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    def both(a: Column, b: Column) -> Column:
        differ = F.raise_error(F.lit("arrays of different lengths")).cast("array<double>")
        return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))).when(a.isNull() | b.isNull(), None).otherwise(differ)

    return both


add = _paired(lambda x, y: x + y)
subtract = _paired(lambda x, y: x - y)
multiply = _paired(lambda x, y: x * y)
divide = _paired(F.try_divide)
power = _paired(F.pow)


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def maximum(a: Column) -> Column:
    return F.array_max(a)


def variance(a: Column) -> Column:
    """Of all values as a population."""
    middle = F.array_repeat(mean(a), F.size(a))
    return F.try_divide(total(F.zip_with(a, middle, lambda x, m: (x - m) * (x - m))), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def reshape(a: Column, columns: int) -> Column:
    """Rows of so many columns, in order; a rest is an error."""
    rows = F.transform(F.sequence(F.lit(1), F.size(a), F.lit(columns)), lambda i: F.slice(a, i, columns))
    whole = F.when(F.size(a) % columns == 0, F.lit(True)).otherwise(F.raise_error(F.lit("a rest is left")).cast("boolean"))
    return F.when(whole & (F.size(a) > 0), rows)


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(m, 1))), lambda j: F.transform(m, lambda row: F.element_at(row, j)))


def along(m: Column, axis: int, f: Callable[[Column], Column]) -> Column:
    """``f`` of every column (axis 0) or every row (axis 1) of a matrix."""
    return F.transform(transpose(m) if axis == 0 else m, f)


def matrix_vector(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))
