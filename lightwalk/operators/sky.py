"""The sky's uneven light: for each instant, what each sector of the sky above a height adds to a level or an upright surface.

Numbers are fixed values of the CIE general sky: gradation (a, b) and indicatrix (c, d, e) of the types that lie at
ascending clearness.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clamp

#: (clearness, a, b, c, d, e)
TYPES = [
    (1.0, 4.0, -0.7, 0.0, -1.0, 0.0), (1.15, 1.1, -0.8, 0.0, -1.0, 0.0), (1.36, 0.0, -1.0, 0.0, -1.0, 0.0), (1.72, 0.0, -1.0, 5.0, -2.5, 0.3),
    (2.37, 0.0, -1.0, 10.0, -3.0, 0.45), (3.65, -1.0, -0.55, 5.0, -2.5, 0.3), (5.35, -1.0, -0.55, 10.0, -3.0, 0.45), (7.0, -1.0, -0.32, 10.0, -3.0, 0.45),
]
BANDS, SAMPLES = 45, 3  # of 2 degrees, for a level surface
WALL_BANDS, WALL_SAMPLES = 30, 8  # of 3 degrees, for an upright one


def gradation(a: Column, b: Column, cos_zenith: Column) -> Column:
    return a * F.exp(b / F.greatest(cos_zenith, F.lit(0.01))) + 1


def indicatrix(c: Column, d: Column, e: Column, chi: Column) -> Column:
    return c * (F.exp(d * chi) - F.exp(d * (math.pi / 2))) + e * F.cos(chi) * F.cos(chi) + 1


def type_place(epsilon: Column) -> Column:
    """Where a clearness lies among the types, 0 to 7: linear in its logarithm between neighbours."""
    steps = [clamp((F.ln(F.greatest(F.lit(1.0), epsilon)) - math.log(low[0])) / (math.log(high[0]) - math.log(low[0])), 0.0, 1.0) for low, high in zip(TYPES, TYPES[1:], strict=False)]
    return sum(steps, F.lit(0.0))


def tables(instants: DataFrame, bins: int = 32) -> DataFrame:
    """``instants`` (instant, altitude, azimuth, epsilon) with ``sky`` and ``wall``: for each sector, from the horizon up, the share of the open sky's light that comes from above that height.

    Rows are instants, types, sectors and bands; two neighbouring types blend. A level surface under the whole sky gets 1.
    """
    kinds = F.array(*[F.struct(F.lit(float(k)).alias("k"), *[F.lit(v).alias(n) for n, v in zip("abcde", t[1:], strict=True)]) for k, t in enumerate(TYPES)])
    typed = instants.select("instant", "altitude", "azimuth", type_place(F.coalesce("epsilon", F.lit(1.0))).alias("place"), F.explode(kinds).alias("t")).withColumn("share", F.greatest(F.lit(0.0), 1 - F.abs(F.col("place") - F.col("t.k")))).where("share > 0")
    a, b, c, d, e = (F.col(f"t.{n}") for n in "abcde")
    sun = math.pi / 2 - F.greatest(F.col("altitude"), F.lit(0.0))
    normal = gradation(a, b, F.lit(1.0)) * indicatrix(c, d, e, sun)

    def light(cos_z: Column, sin_z: Column, azimuth: Column) -> Column:
        chi = F.acos(clamp(F.cos(sun) * cos_z + F.sin(sun) * sin_z * F.cos(azimuth - F.col("azimuth")), -1.0, 1.0))
        return F.greatest(F.lit(0.0), gradation(a, b, cos_z) * indicatrix(c, d, e, chi) / normal)

    summed = lambda n, f: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda total, s: total + f(s))
    sectors, base = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))), typed.select("*")
    level = base.withColumn("sector", sectors).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    z = math.pi / 2 - F.radians((F.col("band") + 0.5) * (90 / BANDS))
    flat = summed(SAMPLES, lambda s: light(F.cos(z), F.sin(z), (F.col("sector") + (s + 0.5) / SAMPLES) * (2 * math.pi / bins)) * F.cos(z) * F.sin(z))
    level = level.withColumn("value", flat * (2 * math.pi / bins / SAMPLES * math.radians(90 / BANDS)))
    totals = level.groupBy("instant", F.col("t.k").alias("k")).agg(F.sum("value").alias("total"))
    upright = base.withColumn("sector", sectors).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(WALL_BANDS - 1))))
    zw = math.pi / 2 - F.radians((F.col("band") + 0.5) * (90 / WALL_BANDS))
    off = lambda s: (s + 0.5) * (math.pi / WALL_SAMPLES) - math.pi / 2
    steep = summed(WALL_SAMPLES, lambda s: light(F.cos(zw), F.sin(zw), F.col("sector") * (2 * math.pi / bins) + math.pi + off(s)) * F.sin(zw) * F.sin(zw) * F.cos(off(s)))
    upright = upright.withColumn("value", steep * (math.pi / WALL_SAMPLES * math.radians(90 / WALL_BANDS)))
    both = level.withColumn("kind", F.lit("sky")).unionByName(upright.withColumn("kind", F.lit("wall"))).withColumn("k", F.col("t.k"))
    shares = both.join(totals, ["instant", "k"]).groupBy("instant", "kind", "sector", "band").agg(F.sum(F.when(F.col("total") > 0, F.col("share") * F.col("value") / F.col("total")).otherwise(0.0)).alias("value"))
    above = F.sum("value").over(Window.partitionBy("instant", "kind", "sector").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0))
    rows = shares.withColumn("above", above)
    listed = F.concat(F.transform(F.array_sort(F.collect_list(F.struct("band", "above"))), lambda x: x.above), F.array(F.lit(0.0)))
    per = rows.groupBy("instant", "kind", "sector").agg(listed.alias("t"))
    whole = per.groupBy("instant").pivot("kind", ["sky", "wall"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("sector", "t"))), lambda x: x.t))
    return instants.join(whole, "instant")


def _read(table: Column, place: Column, last: int) -> Column:
    k = F.floor(place).cast("int")
    low, high = F.get(table, k), F.get(table, F.least(k + 1, F.lit(last)))
    return low + (high - low) * (place - k)


def factor(sky: Column, horizon: Column) -> Column:
    """Share of the open sky's light that reaches a point with this horizon (degrees in each sector); null where the sectors are not as many."""
    each = F.zip_with(sky, horizon, lambda t, h: _read(t, clamp(h.cast("double") / (90 / BANDS), 0.0, float(BANDS)), BANDS))
    return F.when(F.size(sky) == F.size(horizon), F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def wall_factor(wall: Column, sector: Column, degrees: Column) -> Column:
    """Share of the open sky's light on a level surface that the façade of a sector gets, above an obstacle of so many degrees."""
    return _read(F.get(wall, sector), clamp(degrees / (90 / WALL_BANDS), 0.0, float(WALL_BANDS)), WALL_BANDS)


def geometric_view(horizon: Column) -> Column:
    """The visible part of the vault alone."""
    n = F.size(horizon)
    cos = lambda h: F.cos(F.radians(clamp(h.cast("double"), 0.0, 90.0)))
    return F.when(n > 0, F.aggregate(horizon, F.lit(0.0), lambda a, h: a + cos(h) * cos(h)) / n).otherwise(0.0)
