"""Ordered data: interpolation between neighbours in time, and folds and windows along lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracketed(rows: DataFrame, wanted: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """``rows`` (``by``, ``at``, values) at the wanted ``m`` of each ``by``: linear between the two around it, level beyond the ends.

    A value that one neighbour lacks is the other's; what both lack is null. Each row knows its successor, and so the run of
    ``m`` that it answers for: an equi-join on ``by`` with a range, which no group has to fit into memory for.
    """
    order = Window.partitionBy(by).orderBy(at)
    step = lambda c: F.lead(c).over(order)
    first = F.row_number().over(order) == 1
    known = rows.withColumns({"_next": step(at), "_from": F.when(first, -(1 << 30)).otherwise(F.col(at)), **{f"_{v}": step(v) for v in values}})
    met = known.join(wanted, by).where((F.col("m") >= F.col("_from")) & (F.col("m") < F.coalesce("_next", F.lit(1 << 30))))
    t = F.when(F.col("_next").isNull() | (F.col("m") <= F.col(at)), 0.0).otherwise((F.col("m") - F.col(at)) / (F.col("_next") - F.col(at)))
    between = lambda v: F.when(F.col(f"_{v}").isNull() | (t == 0), F.coalesce(F.col(v), F.col(f"_{v}"))).otherwise(F.coalesce(F.col(v) + (F.col(f"_{v}") - F.col(v)) * t, F.col(f"_{v}")))
    return met.select(by, "m", *[between(v).alias(v) for v in values])


def on_grid(series: Column, minutes: Column, start: int = 300, step: int = 15) -> Column:
    """Value of an array sampled every ``step`` minutes from ``start``, between its two nearest elements, level beyond the ends."""
    last = F.size(series) - 1
    place = F.greatest(F.lit(0.0), F.least(last.cast("double"), (minutes - start) / F.lit(float(step))))
    i = F.floor(place).cast("int")
    a, b = F.get(series, i), F.get(series, F.least(i + 1, last))
    return a + (b - a) * (place - i)


def running(value: Column, by: list[str], order: list) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def islands(df: DataFrame, by: list[str], order: list, same: list[str]) -> DataFrame:
    """``df`` with ``island``: a number for each run of rows with equal ``same`` columns (nulls equal)."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.row_number().over(w) == 1
    for c in same:
        start = start | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_new", start.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def cut_lengths(lengths: Column, target: float) -> Column:
    """Piece number of each step of a polyline: a piece ends with the step that brings it to ``target``, unless that is the last."""
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("piece"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        total = a.sum + x
        full = total >= target
        return F.struct(F.when(full, 0.0).otherwise(total).alias("sum"), (a.piece + full.cast("int")).alias("piece"), F.concat(a.out, F.array(a.piece)).alias("out"))

    return F.aggregate(lengths, state, step, lambda a: a.out)


def kept_apart(hits: Column, span: float, more: str = "") -> Column:
    """Of struct(distance, delta, and the fields that ``more`` names with their types) in order: those kept when a hit nearer than ``span`` to the last kept one only replaces it if its delta is larger."""
    kind = f"array<struct<distance:double,delta:double{',' * bool(more)}{more}>>"

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        near = (F.size(a) > 0) & (x.distance - last.distance < span)
        swap = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(x))
        return F.when(near & (x.delta > last.delta), swap).when(near, a).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(hits, F.array().cast(kind), step)


def resampled(segments: DataFrame, key: str, step: float, ends: bool = False) -> DataFrame:
    """Points every ``step`` metres, the first after half of one, along chains of segments (key, seq, x1, y1, x2, y2), with the
    unit tangent (dx, dy). A chain too short for one gets its middle, with the direction from its first to its last point.
    ``ends``: also the ends of the segment that a point lies on (for a middle, of the chain)."""
    told = ["x1", "y1", "x2", "y2"] if ends else []
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    along = segments.withColumn("len", length)
    before = F.lag("end").over(Window.partitionBy(key).orderBy("seq"))  # not end - len: rounding would lose samples or double them
    along = along.withColumn("end", running(F.col("len"), [key], ["seq"])).withColumn("start", F.coalesce(before, F.lit(0.0)))
    # Sample k lies at step/2 + k*step; of a segment (start, end] those after its start, and the first segment's own start.
    low = F.greatest(F.lit(0), F.floor((F.col("start") - step / 2) / step) + 1)
    high = F.floor((F.col("end") - step / 2) / step)
    out = along.where((F.col("len") > 0) & (high >= low)).withColumn("k", F.explode(F.sequence(low, high)))
    t = (F.col("k") * step + step / 2 - F.col("start")) / F.col("len")
    wide, tall = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    placed = out.select(key, "k", (F.col("x1") + wide * t).alias("x"), (F.col("y1") + tall * t).alias("y"), (wide / F.col("len")).alias("dx"), (tall / F.col("len")).alias("dy"), *told)
    whole = along.groupBy(key).agg(F.max("end").alias("total"), *[F.min_by(c, "seq").alias(c) for c in ("x1", "y1")], *[F.max_by(c, "seq").alias(c) for c in ("x2", "y2")])
    span = F.when(length > 0, length).otherwise(1.0)
    middle = whole.where(F.col("total") < step / 2).select(key, F.lit(0).cast("long").alias("k"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), (wide / span).alias("dx"), (tall / span).alias("dy"), *told)
    return placed.unionByName(middle)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in this order, which must be total. Ranges are sorted apart, and begin where the rows of those before them end."""
    from ..sources.storage import materialize

    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    written = materialize(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "numbered")
    sizes = written.groupBy("_part").agg(F.count("*").alias("_size"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return written.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_size", "_before")
