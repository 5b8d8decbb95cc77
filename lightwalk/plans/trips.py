"""Ways through the street graph at the time of day, under the index of the sidewalks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import exposure
from ..operators import routing
from ..sources import adapters
from ..sources.adapters import table
from ..sources.storage import materialize
from . import skies
from .registry import query, r6


def exposures(spark, sf_dir, instants=None):
    """(sides, octant, index, work, sun, side): for both sidewalks of a street, walked in one of eight directions, the index of the better one at each step of the day.

    The better side has the least index and work, the left one of equals. ``sides`` numbers pairs of neighbouring rows.
    """
    ctx = skies.contexts(spark, skies.STEPS if instants is None else instants)
    sides = adapters.sides(spark, sf_dir)
    parts = skies.evaluated(sides, ctx).join(F.broadcast(ctx.select("instant", "azimuth")), "instant")  # one row for each step
    ways = parts.withColumn("octant", F.explode(F.sequence(F.lit(0), F.lit(7))))
    facing = F.greatest(F.lit(0.0), F.cos(F.col("azimuth") - F.col("octant") * (math.pi / 4))) * 0.7 + 0.3
    value = exposure.index({k: F.col(k) for k in (*exposure.WEIGHTS, "night", "night_share")} | {"glare": F.col("glare") * facing})
    seen = ways.select(F.floor(F.col("segment_id") / 2).alias("sides"), "octant", "instant", "side", "work", value.alias("index"), F.round(F.col("sun") * 100).cast("int").alias("sun"))
    best = seen.groupBy("sides", "octant", "instant").agg(F.min(F.struct((F.col("index") + F.col("work")).alias("dear"), "side", "index", "work", "sun")).alias("best"))
    day = best.groupBy("sides", "octant").agg(F.array_sort(F.collect_list(F.struct("instant", "best"))).alias("day"))
    return day.select("sides", "octant", *[F.col("day.best")[n].alias(n) for n in ("index", "work", "sun", "side")])


def streets(spark, sf_dir):
    """(edges, nodes): the street grid, each street with a pair of sidewalks, one street in eleven a crossing."""
    pairs = max(1, table(spark, sf_dir, "embeddings").count() // 2)
    s = F.col("segment_id")
    edge = F.col("src") * 2 + (F.col("dst") != F.col("src") + 1).cast("int")
    return adapters.edges(spark, sf_dir).select(edge.alias("edge"), "src", "dst", s.alias("segment"), (s % pairs).alias("sides"), "length", (s % 11 == 0).alias("crossing")), adapters.nodes(spark, sf_dir)


def trips(spark, sf_dir):
    """A trip for each supplier, at four weights of exposure and thirteen departures."""
    size, k = adapters.nodes(spark, sf_dir).count(), F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("trip"), (k * 101 % size).alias("start"), (k * 37 % size).alias("goal"), (k % 4 * 0.5).alias("alpha"), (F.lit(480) + k % 13 * 15).cast("int").alias("departure"))


def cell():
    """The cell of a node: a square of some 1,200 metres."""
    return F.concat_ws(":", F.floor((F.col("lon") - 2.345) / 0.0164).cast("string"), F.floor((F.col("lat") - 48.853) / 0.0108).cast("string"))


@query(None)
def sp1_sp2_sp3_sp6_routes(spark, sf_dir):
    """Every hop of every trip's way (no SQL: costs depend on the clock; a plain search is the test)."""
    edges, nodes = streets(spark, sf_dir)
    found = routing.routes(edges, nodes, materialize(exposures(spark, sf_dir), "exposures"), trips(spark, sf_dir), cell())
    return found.select("trip", "hop", "node", "edge", r6(F.col("seconds")).alias("seconds"), r6(F.col("cost")).alias("cost"), "index", "sun", "side")


@query(None)
def sp4_a27_departures(spark, sf_dir):
    """Each trip at every quarter hour of the next three hours, and what waiting gains."""
    edges, nodes = streets(spark, sf_dir)
    found = routing.departures(edges, nodes, materialize(exposures(spark, sf_dir), "exposures"), trips(spark, sf_dir), cell())
    return found.select("trip", "departure", r6(F.col("seconds")).alias("seconds"), r6(F.col("index")).alias("index"), "best", "gain", r6(F.col("peak")).alias("peak"))


@query(None)
def sp5_against_the_fastest(spark, sf_dir):
    """Each trip under its weight and under none: extra minutes, and points of the index saved."""
    edges, nodes = streets(spark, sf_dir)
    asked = trips(spark, sf_dir)
    both = asked.select((F.col("trip") * 2).alias("trip"), "start", "goal", "alpha", "departure").unionByName(asked.select((F.col("trip") * 2 + 1).alias("trip"), "start", "goal", F.lit(0.0).alias("alpha"), "departure"))
    found = routing.summary(routing.routes(edges, nodes, materialize(exposures(spark, sf_dir), "exposures"), both, cell()))
    own, fast = (found.where(F.col("trip") % 2 == k).select(F.floor(F.col("trip") / 2).alias("trip"), *[F.col(c).alias(f"{c}_{k}") for c in ("seconds", "meters", "index", "sun")]) for k in (0, 1))
    met = own.join(fast, "trip")
    return met.select("trip", r6(F.col("meters_0")).alias("meters"), r6((F.col("seconds_0") - F.col("seconds_1")) / 60).alias("extra_minutes"), r6(F.col("index_1") - F.col("index_0")).alias("points_saved"), r6(F.col("sun_0")).alias("sun"))
