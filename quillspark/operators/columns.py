"""Arithmetic of vectors as columns."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value evaluated once for a row: inside another lambda it would be evaluated for each element."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    """v over its length; null where it has none."""
    d = v.cast("array<double>")
    size = F.sqrt(dot(d, d))
    return once(F.when(size > 0, size), lambda n: F.when(n.isNotNull(), F.transform(d, lambda x: x / n)))
