"""Vector arithmetic as column expressions, in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    gap = lambda x, y: x.cast("double") - y.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: gap(x, y) * gap(x, y)), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def normalised(a: Column) -> Column:
    """Unit length in DOUBLE, then FLOAT; NULL for the zero vector, which has no direction."""
    n = F.sqrt(norm2(a))
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The public distance, smaller is better: squared L2, or one less the (cosine of the) inner product."""
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "ip":
        return F.lit(1.0) - inner_product(a, b)
    return F.lit(1.0) - inner_product(normalised(a), normalised(b))
