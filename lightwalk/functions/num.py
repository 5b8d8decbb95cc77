"""Number conventions of the model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds half up, also below zero: -2.5 gives -2."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def quantiles(rows: DataFrame, key: str, value: str, **places) -> DataFrame:
    """One row for each ``key`` with the value at each of the named places of its sorted values, from counts and running sums.

    ``places``: functions of the number of values; ``floor(n / 2)`` is the upper median. Values are counted before they
    are moved, and no group is collected.
    """
    counted = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    order, every = Window.partitionBy(key).orderBy(value), Window.partitionBy(key)
    ranked = counted.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(every)})
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("_upto") > place(F.col("_all")), F.col(value))).alias(name) for name, place in places.items()])


def piecewise(x: Column, table: list[tuple[float, float]]) -> Column:
    """Linear between the points of ``table`` (ascending), level beyond its ends."""
    out = F.when(x <= table[0][0], table[0][1])
    for (x0, y0), (x1, y1) in zip(table, table[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * (y1 - y0) / (x1 - x0))
    return out.when(x.isNotNull(), table[-1][1])
