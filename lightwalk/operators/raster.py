"""Grids of square cells as rows (row, col): polygons, crowns and masks on them, and rays across them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import half_up
from . import rays


@dataclass(frozen=True)
class Grid:
    """The frame of a grid: cells of ``res`` metres, from the origin of the plane."""

    res: float
    width: int
    height: int

    def cells(self, spark) -> DataFrame:
        return spark.range(self.width * self.height).select(F.floor(F.col("id") / self.width).cast("int").alias("row"), (F.col("id") % self.width).cast("int").alias("col"))

    def place(self, metres: Column) -> Column:
        """Row or column of a coordinate, cut towards zero: what lies less than a cell outside counts as the first cell."""
        return (metres / self.res).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (col >= 0) & (row < self.height) & (col < self.width)


def _edges(rings: Column) -> Column:
    """Edges of all rings, the last point joined to the first."""
    return F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), F.get(r, (i + 1) % F.size(r)).x.alias("x2"), F.get(r, (i + 1) % F.size(r)).y.alias("y2")))))


def filled(shapes: DataFrame, grid: Grid) -> DataFrame:
    """``shapes`` (``rings``: array of rings of struct(x, y), ...) once for each cell that they fill: an even-odd scan line through the middle of each row."""
    res = grid.res
    ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p.y)))
    low, high = F.greatest(F.lit(0), F.floor(F.array_min(ys) / res)), F.least(F.lit(grid.height - 1), F.ceil(F.array_max(ys) / res))
    by_row = shapes.where(low <= high).withColumn("_edges", _edges(F.col("rings"))).withColumn("row", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    y = (F.col("row") + 0.5) * res
    crosses = F.filter("_edges", lambda e: F.when(e.y1 <= y, e.y2 > y).otherwise(e.y2 <= y))
    at = F.array_sort(F.transform(crosses, lambda e: e.x1 + (y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1)))
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("_at") / 2).cast("int") - 1), lambda k: F.struct(F.get("_at", k * 2).alias("a"), F.get("_at", k * 2 + 1).alias("b")))
    spans = by_row.withColumn("_at", at).where(F.size("_at") >= 2).withColumn("_span", F.explode(pair))
    first, last = F.greatest(F.lit(0), half_up(F.col("_span.a") / res - 0.5)), F.least(F.lit(grid.width - 1), half_up(F.col("_span.b") / res - 0.5))
    return spans.where(first <= last).withColumn("col", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_edges", "_at", "_span")


def stamped(crowns: DataFrame, grid: Grid) -> DataFrame:
    """``crowns`` (x, y, radius, top, base, ...) once for each cell whose middle is in the disc, with ``rise``: how high the half ellipsoid is there above its base."""
    res = grid.res
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - F.col("radius")) / res)).cast("int"), F.least(F.lit(n - 1), F.ceil((F.col(c) + F.col("radius")) / res)).cast("int")))
    inside = (F.col("radius") > 0) & (F.col("top") > F.col("base")) & (F.col("x") + F.col("radius") >= 0) & (F.col("y") + F.col("radius") >= 0)
    inside &= (F.col("x") - F.col("radius") < grid.width * res) & (F.col("y") - F.col("radius") < grid.height * res)
    cells = crowns.where(inside).withColumn("row", span("y", grid.height)).withColumn("col", span("x", grid.width))
    dx, dy = (F.col("col") + 0.5) * res - F.col("x"), (F.col("row") + 0.5) * res - F.col("y")
    far, reach = dx * dx + dy * dy, F.col("radius") * F.col("radius")
    return cells.where(far <= reach).withColumn("rise", (F.col("top") - F.col("base")) * F.sqrt(1 - far / reach))


def surfaces(ground: DataFrame, buildings: DataFrame, canopy: DataFrame, crowns: DataFrame, grid: Grid) -> DataFrame:
    """``ground`` (row, col, ground) with surface, canopy_top, canopy_base, canopy_k; zero where there is none.

    Buildings (rings, height) raise the surface to the highest of them; canopy zones (rings, top, base, k) and crowns keep
    the highest top, the lowest base and the densest foliage. Largest and least are aggregated before the shuffle.
    """
    built = filled(buildings.where("height > 0"), grid).groupBy("row", "col").agg(F.max("height").alias("height"))
    zones = filled(canopy.where("top > base"), grid).select("row", "col", "top", "base", "k")
    trees = stamped(crowns, grid).select("row", "col", (F.col("base") + F.col("rise")).alias("top"), "base", "k")
    green = zones.unionByName(trees).groupBy("row", "col").agg(F.max("top").alias("top"), F.min("base").alias("base"), F.max("k").alias("k"))
    joined = ground.join(built, ["row", "col"], "left").join(green, ["row", "col"], "left")
    none = F.lit(0.0)
    return joined.select(
        "row", "col", "ground", (F.col("ground") + F.coalesce("height", none)).alias("surface"), F.coalesce(F.col("ground") + F.col("top"), none).alias("canopy_top"),
        F.coalesce(F.col("ground") + F.col("base"), none).alias("canopy_base"), F.coalesce("k", none).alias("canopy_k"),
    )


def chamfer(cells: DataFrame, mask: str) -> DataFrame:
    """``cells`` (row, col, ...) with ``d``: the 3-4 chamfer distance, in thirds of a cell, to the nearest cell whose ``mask`` is true; null where there is none.

    A shortest way is one run of diagonal steps and one of straight ones. So the distance is made along the rows, the
    columns and both diagonals one after the other: along a line it is the least of d - w * place so far, plus w * place,
    in both directions: running minima, which reach as far as the line does. Cells that are missing from the frame are
    passed through, but not returned.
    """
    frame = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).where("r0 is not null")
    full = frame.select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select("row", F.explode(F.sequence("c0", "c1")).alias("col"))
    d = full.join(cells.where(F.col(mask)).select("row", "col", F.lit(0).cast("long").alias("d")), ["row", "col"], "left")
    row, col = F.col("row"), F.col("col")
    for line, place, cost in ((row, col, 3), (col, row, 3), (row - col, row, 4), (row + col, row, 4)):
        # Both grow from their first row on: a frame that ends with the line would be gone through anew for each of its cells.
        ahead, behind = (Window.partitionBy("_line").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_place"), F.desc("_place")))
        way = F.col("_place") * cost
        along = d.withColumns({"_line": line, "_place": place.cast("long")})
        d = along.select("row", "col", F.least(F.min(F.col("d") - way).over(ahead) + way, F.min(F.col("d") + way).over(behind) - way).alias("d"))
    return cells.join(d, ["row", "col"])


def _steps(points: DataFrame, grid: Grid, dx: Column, dy: Column, step: float, count: Column) -> DataFrame:
    """Each point (x, y) once for each step along (dx, dy) that is on the grid: k, row, col."""
    walked = points.where(count >= 1).withColumn("k", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    placed = walked.withColumns({"row": grid.place(F.col("y") + dy * F.col("k")), "col": grid.place(F.col("x") + dx * F.col("k"))})
    return placed.where(grid.inside(F.col("row"), F.col("col")))


def sun_transmission(points: DataFrame, surface: DataFrame, grid: Grid, azimuth: float, altitude: float, highest: float | None = None, far: float = 450.0) -> DataFrame:
    """(key, transmission, blocker) of points (key, x, y, eye): a ray towards the sun is cut by a surface above it and dimmed by foliage it crosses.

    Rays are walked in tiles and end above what their tile holds; ``highest`` is taken for callers that know what nothing stands above.
    """
    if altitude <= 0:
        return points.select("key", F.lit(0.0).alias("transmission"), F.lit("sky").alias("blocker"))
    seen = rays.sunlit(points, surface, grid, [rays.Sun(azimuth, altitude)], far)
    shine = transmitted(F.col("cut")[0], F.col("depth")[0])
    blocker = F.when(F.col("cut")[0], "surface").when(shine < 0.98, "canopy").otherwise("sky")
    return seen.select("key", shine.alias("transmission"), blocker.alias("blocker"))


def transmitted(cut: Column, depth: Column) -> Column:
    """The share of light that comes through foliage (in millionths), none past a surface."""
    return F.when(cut, 0.0).otherwise(F.exp(-(depth / 1e6)))


def sky_view(points: DataFrame, surface: DataFrame, grid: Grid, azimuths: int = 32, radius: float = 150.0, bins: int = 32) -> DataFrame:
    """(key, svf, built, canopy, horizon) of points (key, x, y, eye): the highest angle of buildings, and of buildings and trees, in each direction."""
    seen = rays.skyline(points, surface, grid, azimuths, radius).withColumnsRenamed({"built": "tb", "green": "tc"})
    total = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0).cast("long"), lambda a, x: a + x)
    cos2 = lambda t: F.round(1 / (1 + t * t) * 1e9).cast("long")  # noqa: E731 the square of the cosine of an angle with tangent t, in billionths: sums do not depend on the order
    both = F.zip_with("tb", "tc", lambda b, c: F.greatest(b, c))
    sums = seen.select("key", "tb", total(F.col("tb"), cos2).alias("b"), total(both, cos2).alias("all"), total(F.col("leaf"), lambda x: x).alias("leaf"))
    b, every = F.col("b") / (1e9 * azimuths), F.col("all") / (1e9 * azimuths)
    opacity = 1 - F.exp(-F.col("leaf") / (1e6 * azimuths))
    of_bin = [[a for a in range(azimuths) if a * bins // azimuths == i] for i in range(bins)]
    mean = lambda own: sum((F.degrees(F.atan(F.col("tb")[a])) for a in own[1:]), F.degrees(F.atan(F.col("tb")[own[0]]))) / len(own)
    horizon = F.array(*[mean(own) for own in of_bin if own])
    return sums.select("key", (b - (b - every) * opacity).alias("svf"), b.alias("built"), F.greatest(F.lit(0.0), b - every).alias("canopy"), horizon.alias("horizon"))


def facade_distance(points: DataFrame, surface: DataFrame, grid: Grid, reach: float = 40.0) -> DataFrame:
    """(key, distance) of points (key, x, y, nx, ny): metres along (nx, ny) to the first cell two metres above the point's ground; ``reach`` where there is none, or the grid ends before."""
    own = surface.select("row", "col", F.col("ground").alias("own"))
    based = points.withColumns({"row": grid.place(F.col("y")), "col": grid.place(F.col("x"))}).join(own, ["row", "col"], "left").drop("row", "col").na.fill({"own": 0.0})
    count = int(reach // grid.res)
    met = _steps(based, grid, F.col("nx") * grid.res, F.col("ny") * grid.res, grid.res, F.lit(count)).join(surface, ["row", "col"]).where(F.col("surface") > F.col("own") + 2)
    first = met.groupBy("key").agg((F.min("k") * grid.res).alias("distance"))
    return points.select("key").join(first, "key", "left").select("key", F.coalesce("distance", F.lit(reach)).alias("distance"))


def widened(mask: DataFrame, grid: Grid, metres: float) -> DataFrame:
    """Cells (row, col) within a square of ``round(metres / res)`` cells around those of ``mask``, on the grid."""
    n = int(metres / grid.res + 0.5)
    rows = mask.select("col", F.explode(F.sequence(F.col("row") - n, F.col("row") + n)).alias("row")).distinct()
    wide = rows.select("row", F.explode(F.sequence(F.col("col") - n, F.col("col") + n)).alias("col")).distinct()
    return wide.where(grid.inside(F.col("row"), F.col("col")))


def measured_or_drawn(scan: DataFrame, drawn: DataFrame, built: DataFrame, side: int, probe: int = 64, least: float = 0.02, whole: float = 0.999, leaf: float = 0.265) -> DataFrame:
    """The surface of each block of ``side`` by ``side`` cells: as measured where a scan covers it, as drawn from vectors where it does not.

    ``scan``: (row, col, top, above), the height of what was hit and how far that is above the ground; null or no row where
    nothing was measured. ``drawn``: (row, col, ground, surface, canopy_top, canopy_base, canopy_k), which is also the frame.
    ``built``: (row, col), the widened outlines of buildings: what rises half a metre there is a building, elsewhere a crown.
    A probe of at most ``probe`` by ``probe`` cells of a block is looked at first; a block of which the probe or the whole has
    less than ``least`` measured is drawn ("vectors"). The gaps of one below ``whole`` are filled as drawn ("both"); above
    that nothing is filled, and a gap has neither ground nor anything on it ("measured"). Adds ``model`` and ``coverage``
    (of the probe, where that decided).
    """
    block = lambda c: F.floor(F.col(c) / side).cast("int").alias("b" + c)
    n = min(side, probe)
    sampled = F.array(*[F.lit(int((i + 0.5) * side / n)) for i in range(n)])
    in_probe = F.array_contains(sampled, F.pmod("row", F.lit(side))) & F.array_contains(sampled, F.pmod("col", F.lit(side)))
    count = lambda c: F.count(c).alias("n_" + c)
    frame = drawn.groupBy(block("row"), block("col")).agg(F.count("*").alias("cells"), F.count_if(in_probe).alias("probed"))
    share = lambda seen, of: F.coalesce(F.least("n_top", "n_above") / F.col(of), F.lit(0.0)).alias(seen)
    looked = scan.where(in_probe).groupBy(block("row"), block("col")).agg(count("top"), count("above"))
    asked = frame.join(looked, ["brow", "bcol"], "left").select("brow", "bcol", "cells", share("first", "probed"))
    # Only the scans of blocks that pass the probe are read whole.
    at = scan.select("row", "col", "top", "above", block("row"), block("col"))
    passed = at.join(asked.where(F.col("first") >= least).select("brow", "bcol"), ["brow", "bcol"], "left_semi")
    counted = passed.groupBy("brow", "bcol").agg(count("top"), count("above"))
    full = asked.join(counted, ["brow", "bcol"], "left").select("brow", "bcol", "first", share("full", "cells"))
    coverage = F.when(F.col("first") < least, F.col("first")).otherwise(F.col("full"))
    model = F.when(coverage < least, "vectors").when(coverage < whole, "both").otherwise("measured")
    told = full.select("brow", "bcol", coverage.alias("coverage"), model.alias("model"))
    met = drawn.withColumns({"brow": F.floor(F.col("row") / side).cast("int"), "bcol": F.floor(F.col("col") / side).cast("int")}).join(told, ["brow", "bcol"])
    met = met.join(passed.select("row", "col", "top", "above"), ["row", "col"], "left").join(built.select("row", "col", F.lit(True).alias("roof")).distinct(), ["row", "col"], "left")
    above = F.greatest(F.lit(0.0), F.col("above"))
    floor, high, none = F.col("top") - above, above >= 0.5, F.lit(0.0)
    seen = (F.col("model") != "vectors") & F.col("top").isNotNull() & F.col("above").isNotNull()
    roof, crown = F.col("roof") & high, F.col("roof").isNull() & high
    new = {
        "ground": floor, "surface": F.when(roof, floor + above).otherwise(floor), "canopy_top": F.when(crown, floor + above).otherwise(none),
        "canopy_base": F.when(crown, floor + above * 0.35).otherwise(none), "canopy_k": F.when(crown, leaf).otherwise(none),
    }
    return met.select("row", "col", *[F.when(seen, value).when(F.col("model") == "measured", none).otherwise(F.col(name)).alias(name) for name, value in new.items()], "model", "coverage")
