"""Vector functions on array columns, as expressions. Sums are in double.

Vectors of different length: null in lenient mode, an error in strict mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _paired(a: Column, b: Column, made: Column, strict: bool) -> Column:
    wrong = F.raise_error(F.lit("vectors differ in length")) if strict else F.lit(None)
    return F.when(F.size(a) == F.size(b), made).otherwise(wrong)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column, strict: bool = False) -> Column:
    return _paired(a, b, _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y))), strict)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: _double(x) * _double(x))))


def normalize(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    return F.when(norm(v) == 0, F.transform(v, _double)).otherwise(scale(v, F.lit(1.0) / norm(v)))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """0 if either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b, strict) / lengths)


def euclidean(a: Column, b: Column, strict: bool = False) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y)))
    return _paired(a, b, F.sqrt(_sum(squares)), strict)


def is_normalized(v: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def resize(v: Column, size: int | Column) -> Column:
    """Cut or padded with zeros to `size`, without normalising."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.slice(v, F.lit(1), F.least(F.size(v), size)), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(size - F.size(v), F.lit(0))))


def to_dimension(v: Column, size: int | Column) -> Column:
    """resize, then normalised if the length changed."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(v) == size, F.transform(v, _double)).otherwise(normalize(resize(v, size)))


def add(a: Column, b: Column, strict: bool = False) -> Column:
    return _paired(a, b, F.zip_with(a, b, lambda x, y: _double(x) + _double(y)), strict)


def subtract(a: Column, b: Column, strict: bool = False) -> Column:
    return _paired(a, b, F.zip_with(a, b, lambda x, y: _double(x) - _double(y)), strict)


def scale(v: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, int | float) else by
    return F.transform(v, lambda x: _double(x) * by)


def equal_within(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    near = F.zip_with(a, b, lambda x, y: F.abs(_double(x) - _double(y)) <= tolerance)
    return F.when(F.size(a) == F.size(b), F.forall(near, lambda x: x)).otherwise(F.lit(False))


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), size)


def random_vector(size: int, seed: int) -> Column:
    """Values in [-1, 1], the same for the same seed and partitioning."""
    return F.array(*[F.rand(seed + i) * 2 - 1 for i in range(size)])
