"""Dense-vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """L2-normalised copy; a zero vector stays zero."""
    scale = lambda length: F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
    return let(norm(a), scale)


def compress(a: Column, places: int = 3, scale: float = 100.0) -> Column:
    """Rounded and scaled components, as kept in small vector files."""
    return F.transform(a, lambda x: F.round(x.cast("double"), places) * scale)


def rescale(a: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / scale)
