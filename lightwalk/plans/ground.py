"""Surface and rays: what stands on the grid, and how much sun and sky reaches a point."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.num import half_up
from ..operators import raster
from ..sources import adapters
from ..sources.storage import materialize
from .registry import query, r6

GRID = raster.Grid(10.0, 120, 80)
EYE, AZIMUTH, ALTITUDE = 1.6, 2.4, 0.55


def surface(spark, sf_dir):
    """The grid from buildings, canopy zones and crowns in leaf."""
    zones = adapters.parks(spark, sf_dir).select("rings", adapters.canopy_height(F.col("nature")).alias("top"), adapters.canopy_extinction(F.col("nature"), True).alias("k"))
    zones = zones.withColumn("base", F.col("top") * 0.2)
    crowns = adapters.crowns(adapters.trees(spark, sf_dir)).withColumn("k", F.when(F.col("evergreen"), adapters.CONIFER).otherwise(adapters.LEAF_ON))
    return raster.surfaces(adapters.ground(spark, GRID), adapters.buildings(spark, sf_dir), zones, crowns, GRID)


@query(
    "select row, col, ground, surface, round(canopy_top, 6) as canopy_top, round(canopy_base, 6) as canopy_base, canopy_k from surface",
    *adapters.SURFACE,
)
def ra1_ra5_j14_ra8_surface(spark, sf_dir):
    return surface(spark, sf_dir).select("row", "col", "ground", "surface", r6(F.col("canopy_top")).alias("canopy_top"), r6(F.col("canopy_base")).alias("canopy_base"), "canopy_k")


@query(
    """
    painted as (select c.row, c.col, max(lasting) as k from cells c join zones on lasting is not null and (c.row + 0.5E0)*10 >= y0 and (c.row + 0.5E0)*10 < y1 and c.col between floor(x0/10) and floor(x1/10) group by 1, 2),
    stamped as (select distinct c.row, c.col from cells c join crowns on evergreen and ((c.col + 0.5E0)*10 - x)*((c.col + 0.5E0)*10 - x) + ((c.row + 0.5E0)*10 - y)*((c.row + 0.5E0)*10 - y) <= radius*radius)
    select s.row, s.col, round(case when canopy_top > 0 then coalesce(p.k, case when t.row is not null then 0.3E0 end, canopy_k) else canopy_k end, 6) as canopy_k
    from surface s left join painted p on p.row = s.row and p.col = s.col left join stamped t on t.row = s.row and t.col = s.col
    """,
    *adapters.SURFACE,
)
def ra4_ra6_evergreens_painted(spark, sf_dir):
    """Foliage that stays is painted over what is there: trees first, then zones by ascending density, which may thin it out."""
    lasting = adapters.parks(spark, sf_dir).where(F.col("nature").isin("Forêt fermée de conifères", "Forêt fermée mixte"))
    zones = raster.filled(lasting.select("rings", adapters.canopy_extinction(F.col("nature"), False).alias("zone")), GRID).groupBy("row", "col").agg(F.max("zone").alias("zone"))
    trees = raster.stamped(adapters.crowns(adapters.trees(spark, sf_dir)).where("evergreen"), GRID).select("row", "col", F.lit(adapters.CONIFER).alias("tree")).distinct()
    met = surface(spark, sf_dir).join(zones, ["row", "col"], "left").join(trees, ["row", "col"], "left")
    k = F.when(F.col("canopy_top") > 0, F.coalesce("zone", "tree", "canopy_k")).otherwise(F.col("canopy_k"))
    return met.select("row", "col", r6(k).alias("canopy_k"))


@query(
    """
    scan as (select row, col, ground, case when (row*31 + col*17) % 100 < 90 then ((row*13 + col*29) % 400)/10E0 end as above from cells),
    share as (select avg(cast(above is not null as int)) as coverage from scan),
    mask as (select distinct c.row, c.col from cells c join buildings on (c.row + 0.5E0)*10 >= y0 and (c.row + 0.5E0)*10 < y1 and c.col between floor(x0/10) and floor(x1/10)),
    wide as (select distinct m.row + i as row, m.col + j as col from mask m, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j))
    select s.row, s.col, round(case when c.above is null then s.surface when c.above >= 0.5 and w.row is not null then s.ground + c.above else s.ground end, 6) as surface,
      round(case when c.above is null then s.canopy_top when c.above >= 0.5 and w.row is null then s.ground + c.above else 0 end, 6) as canopy_top,
      round(case when c.above is null then s.canopy_base when c.above >= 0.5 and w.row is null then s.ground + c.above*0.35E0 else 0 end, 6) as canopy_base,
      round(coverage, 6) as coverage
    from surface s join scan c on c.row = s.row and c.col = s.col left join wide w on w.row = s.row and w.col = s.col, share
    """,
    *adapters.SURFACE,
)
def ra7_w16_scanned_surface(spark, sf_dir):
    """A measured surface, split into buildings and canopy by the widened outlines of buildings; what was not measured comes from the vectors."""
    row, col = F.col("row"), F.col("col")
    scan = GRID.cells(spark).withColumn("above", F.when((row * 31 + col * 17) % 100 < 90, (row * 13 + col * 29) % 400 / 10.0))
    coverage = F.broadcast(scan.agg(F.avg(F.col("above").isNotNull().cast("int")).alias("coverage")))  # one row
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    mask = raster.filled(adapters.buildings(spark, sf_dir), GRID).select("row", "col").distinct()
    wide = mask.select("row", "col", around.alias("a")).select((row + F.col("a.i")).alias("row"), (col + F.col("a.j")).alias("col"), F.lit(True).alias("built")).distinct()
    met = surface(spark, sf_dir).join(scan, ["row", "col"]).join(wide, ["row", "col"], "left").crossJoin(coverage)
    above, high = F.col("above"), F.col("above") >= 0.5
    green = high & F.col("built").isNull()
    told = lambda old, new: r6(F.when(above.isNull(), F.col(old)).otherwise(new)).alias(old)
    return met.select(
        "row", "col", told("surface", F.col("ground") + F.when(high & F.col("built"), above).otherwise(0.0)), told("canopy_top", F.when(green, F.col("ground") + above).otherwise(0.0)),
        told("canopy_base", F.when(green, F.col("ground") + above * 0.35).otherwise(0.0)), r6(F.col("coverage")).alias("coverage"),
    )


SIDE, PROBE = 40, 16  # cells to a side of a block of the region, and of its probe
_SHARES = [1000, 900, 0, 12, 50, 1000]  # thousandths of a block's cells that the scan has


def scanned(spark, sf_dir):
    """A scan (row, col, top, above) from the values of the events of a cell; some blocks are covered, some have holes, one is empty."""
    key = (F.col("event_id") % (GRID.width * GRID.height)).alias("key")
    e = adapters.table(spark, sf_dir, "events").groupBy(key).agg(F.abs(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long"))).alias("cents"))
    row, col, cents = F.floor(F.col("key") / GRID.width).cast("int"), (F.col("key") % GRID.width).cast("int"), F.col("cents")
    block = (F.floor(row / SIDE) * (GRID.width // SIDE) + F.floor(col / SIDE)).cast("int")
    share = F.element_at(F.array(*map(F.lit, _SHARES)), block + 1)
    placed = e.select(row.alias("row"), col.alias("col"), (cents * 7919 % 1000 < share).alias("seen"), F.when(cents % 3 != 0, cents % 400 / 10.0).otherwise(0.0).alias("above"), (cents % 4 / 4.0).alias("bump"))
    seen = placed.where("seen").join(adapters.ground(spark, GRID), ["row", "col"])
    return seen.select("row", "col", (F.col("ground") + F.col("bump") + F.col("above")).alias("top"), "above")


@query(
    f"""
    e as (select event_id % 9600 as key, abs(sum(cast(floor(value*100 + 0.5) as bigint))) as cents from events group by 1),
    scan as (select c.row, c.col, case when cents % 3 <> 0 then (cents % 400)/10E0 else 0E0 end as above, c.ground + (cents % 4)/4E0 as floor_ from e join cells c on c.row = key // 120 and c.col = key % 120 where (cents*7919) % 1000 < {_SHARES}[1 + (c.row // 40)*3 + c.col // 40]),
    picked as (select unnest({[int((i + 0.5) * SIDE / PROBE) for i in range(PROBE)]}) as i),
    share as (select c.row // 40 as br, c.col // 40 as bc, count(s.row)/cast(count(*) as double) as whole, count(s.row) filter (c.row % 40 in (from picked) and c.col % 40 in (from picked))/{PROBE * PROBE}E0 as probe from cells c left join scan s using (row, col) group by 1, 2),
    model as (select br, bc, case when probe < 0.02 then probe else whole end as coverage, case when probe < 0.02 or whole < 0.02 then 'vectors' when whole < 0.999 then 'both' else 'measured' end as model from share),
    outline as (select distinct c.row, c.col from cells c join buildings on (c.row + 0.5E0)*10 >= y0 and (c.row + 0.5E0)*10 < y1 and c.col between floor(x0/10) and floor(x1/10)),
    wide as (select distinct m.row + i as row, m.col + j as col from outline m, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)),
    met as (select s.*, m.model, m.coverage, case when model <> 'vectors' then n.above end as above, n.floor_, w.row is not null as roof from surface s join model m on br = s.row // 40 and bc = s.col // 40 left join scan n on n.row = s.row and n.col = s.col left join wide w on w.row = s.row and w.col = s.col)
    select row, col, model, round(coverage, 6) as coverage, round(case when above is not null then floor_ when model = 'measured' then 0 else ground end, 6) as ground,
      round(case when above >= 0.5 and roof then floor_ + above when above is not null then floor_ when model = 'measured' then 0 else surface end, 6) as surface,
      round(case when above >= 0.5 and not roof then floor_ + above when above is not null or model = 'measured' then 0 else canopy_top end, 6) as canopy_top,
      round(case when above >= 0.5 and not roof then floor_ + above*0.35E0 when above is not null or model = 'measured' then 0 else canopy_base end, 6) as canopy_base,
      round(case when above >= 0.5 and not roof then 0.265E0 when above is not null or model = 'measured' then 0 else canopy_k end, 6) as canopy_k from met
    """,
    *adapters.SURFACE,
)
def ra7_measured_or_drawn(spark, sf_dir):
    """Block by block of the region: the measured surface where a probe and the whole are covered, its holes filled from the vectors, else the vectors."""
    wide = raster.widened(raster.filled(adapters.buildings(spark, sf_dir), GRID), GRID, 10.0)
    found = raster.measured_or_drawn(scanned(spark, sf_dir), surface(spark, sf_dir), wide, SIDE, PROBE)
    return found.select("row", "col", "model", *[r6(F.col(c)).alias(c) for c in ("coverage", "ground", "surface", "canopy_top", "canopy_base", "canopy_k")])


def _eyes(points, cells):
    """``points`` (key, x, y) with the height of the eye above the ground of their cell, and whether a roof is over it."""
    own = cells.select("row", "col", "ground", "surface")
    placed = points.withColumns({"row": GRID.place(F.col("y")), "col": GRID.place(F.col("x"))}).join(own, ["row", "col"], "left")
    eye = F.coalesce(F.col("ground") + EYE, F.lit(EYE))
    return placed.select("key", "x", "y", eye.alias("eye"), F.coalesce(F.col("surface") > eye, F.lit(False)).alias("indoors"))


_EYES = """
  eyes as (select p.key, p.x, p.y, coalesce(s.ground, 0) + 1.6E0 as eye, coalesce(s.surface > s.ground + 1.6E0, false) as indoors from {points} p left join surface s on s.row = trunc(p.y/10) and s.col = trunc(p.x/10)),
"""


@query(
    "keyed as (select point_id as key, x, y from points)," + _EYES.format(points="keyed")
    + f"""
    top as (select max(greatest(surface, canopy_top)) as highest from surface),
    ray as (select key, eye, k, trunc((x + sin({AZIMUTH}E0)*8*k)/10) as col, trunc((y + cos({AZIMUTH}E0)*8*k)/10) as row, eye + k*(tan({ALTITUDE}E0)*8) as z
      from (select *, unnest(range(1, cast(least(56, floor((highest - eye)/(tan({ALTITUDE}E0)*8))) as bigint) + 1)) as k from eyes, top)),
    met as (select key, max(cast(surface > z as int)) as cut, sum(case when canopy_top > z and canopy_base < z then cast(round(canopy_k*8*1e6) as bigint) else 0 end)/1e6 as depth from ray join surface using (row, col) group by key),
    shine as (select key, indoors, case when cut = 1 then 0 else exp(-coalesce(depth, 0)) end as t, cut from eyes left join met using (key))
    select key, indoors, round(t, 6) as transmission, case when cut = 1 then 'surface' when t < 0.98 then 'canopy' else 'sky' end as blocker from shine
    """,
    "points", *adapters.SURFACE,
)
def ra9_j10_j20_sun_transmission(spark, sf_dir):
    cells = materialize(surface(spark, sf_dir), "surface")
    eyes = _eyes(adapters.points(spark, sf_dir).select(F.col("point_id").alias("key"), "x", "y"), cells)
    highest = cells.agg(F.max(F.greatest("surface", "canopy_top"))).first()[0]
    found = raster.sun_transmission(eyes, cells, GRID, AZIMUTH, ALTITUDE, highest)
    return eyes.select("key", "indoors").join(found, "key").select("key", "indoors", r6(F.col("transmission")).alias("transmission"), "blocker")


@query(
    "keyed as (select node_id as key, (lon - 2.345E0)*{lon_m!r}E0 as x, (lat - 48.853E0)*{lat_m!r}E0 as y from nodes),".format(lon_m=adapters.PLANE.lon_m, lat_m=adapters.PLANE.lat_m) + _EYES.format(points="keyed")
    + """
    steps as (select key, a, k, eye, trunc((x + sin(a*(2*pi()/32))*10*k)/10) as col, trunc((y + cos(a*(2*pi()/32))*10*k)/10) as row from eyes, (select unnest(range(32)) as a), (select unnest(range(1, 16)) as k)),
    per as (select key, a, greatest(0, max((surface - eye)/(k*10E0))) as tb, greatest(0, max((canopy_top - eye)/(k*10E0))) as tc, sum(case when canopy_top > eye then cast(round(canopy_k*10*1e6) as bigint) else 0 end) as leaf from steps join surface using (row, col) group by 1, 2),
    every as (select key, a, coalesce(tb, 0) as tb, coalesce(tc, 0) as tc, coalesce(leaf, 0) as leaf from (select key, a from eyes, (select unnest(range(32)) as a)) left join per using (key, a)),
    s as (select key, sum(cast(round(1e9/(1 + tb*tb)) as bigint))/32e9 as built, sum(cast(round(1e9/(1 + greatest(tb, tc)*greatest(tb, tc))) as bigint))/32e9 as both_, sum(leaf)/32e6 as leaf, list(round(degrees(atan(tb)), 3) order by a) as horizon from every group by key)
    select key, round(built - (built - both_)*(1 - exp(-leaf)), 4) as svf, round(built, 4) as built, round(greatest(0, built - both_), 4) as canopy, horizon from s
    """,
    "nodes", *adapters.SURFACE,
)
def ra10_sky_view_factor(spark, sf_dir):
    cells = materialize(surface(spark, sf_dir), "surface")
    nodes = adapters.placed(adapters.nodes(spark, sf_dir)).select(F.col("node_id").alias("key"), "x", "y")
    found = raster.sky_view(_eyes(nodes, cells), cells, GRID)
    return found.select("key", *[F.round(c, 4).alias(c) for c in ("svf", "built", "canopy")], F.transform("horizon", lambda h: F.round(h, 3)).alias("horizon"))


@query(
    """
    walked as (select point_id, segment_id, p.x, p.y, n.nx, n.ny, n.way, coalesce(s.ground, 0) as own from points p left join surface s on s.row = trunc(p.y/10) and s.col = trunc(p.x/10), (values (0, 0E0, 1E0), (1, 0E0, -1E0)) n(way, nx, ny)),
    hit as (select point_id, way, min(k)*10E0 as d from walked w, (select unnest(range(1, 5)) as k) join surface s on s.row = trunc((w.y + w.ny*10*k)/10) and s.col = trunc((w.x + w.nx*10*k)/10) and s.surface > w.own + 2 group by 1, 2),
    every as (select w.segment_id, w.way, coalesce(d, 40) as d from walked w left join hit using (point_id, way)),
    med as (select segment_id, way, list_extract(list(d order by d), cast(count(*)//2 as int) + 1) as m from every group by 1, 2),
    wide as (select segment_id, max(case way when 0 then m end) as dl, max(case way when 1 then m end) as dr from med group by 1)
    select segment_id, dl, dr, case when dl >= 40 or dl - 2 < 1.25 or dl - 2 > 12.5 then 5E0 else greatest(0.5, least(dl - 2, 20)) end as left_offset,
      case when dr >= 40 or dr - 2 < 1.25 or dr - 2 > 12.5 then 5E0 else greatest(0.5, least(dr - 2, 20)) end as right_offset, case when dl < 40 and dr < 40 then floor((dl + dr)*10 + 0.5)/10 end as width from wide
    """,
    "points", *adapters.SURFACE,
)
def ra11_ra12_a16_g10_sidewalks_measured(spark, sf_dir):
    """Distances to the façades on both sides of each point of a street that runs east, their upper median, and the plausible offsets of the sidewalks."""
    cells = materialize(surface(spark, sf_dir), "surface")
    points = adapters.points(spark, sf_dir).select("point_id", "segment_id", "x", "y", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.lit(1.0).alias("ny")), F.struct(F.lit(1).alias("way"), F.lit(-1.0).alias("ny")))).alias("n"))
    walked = points.select(F.struct("point_id", "n.way").alias("key"), "segment_id", "x", "y", F.lit(0.0).alias("nx"), "n.ny")
    far = raster.facade_distance(walked.drop("segment_id"), cells, GRID)
    each = walked.select("key", "segment_id").join(far, "key").select("segment_id", F.col("key.way").alias("way"), "distance")
    # The upper median by counts of the few distances there are, not by a sorted list.
    counted = each.groupBy("segment_id", "way", "distance").agg(F.count("*").alias("n"))
    o, every = Window.partitionBy("segment_id", "way").orderBy("distance"), Window.partitionBy("segment_id", "way")
    middle = counted.withColumn("upto", F.sum("n").over(o)).withColumn("place", F.floor(F.sum("n").over(every) / 2)).where("upto > place").groupBy("segment_id", "way").agg(F.min("distance").alias("m"))
    wide = middle.groupBy("segment_id").agg(F.max(F.when(F.col("way") == 0, F.col("m"))).alias("dl"), F.max(F.when(F.col("way") == 1, F.col("m"))).alias("dr"))
    measured = (F.col("dl") < 40) & (F.col("dr") < 40)
    return wide.select("segment_id", "dl", "dr", sidewalk_offset(F.col("dl")).alias("left_offset"), sidewalk_offset(F.col("dr")).alias("right_offset"), F.when(measured, half_up((F.col("dl") + F.col("dr")) * 10) / 10).alias("width"))


def sidewalk_offset(distance, nominal: float = 5.0, reach: float = 40.0):
    """Two metres off the façade where that is plausible for the class of street, else the nominal offset."""
    measured = distance - 2
    plausible = (distance < reach) & (measured >= nominal * 0.25) & (measured <= nominal * 2.5)
    return F.when(plausible, F.greatest(F.lit(0.5), F.least(measured, F.lit(20.0)))).otherwise(nominal)


@query(
    f"""
    keyed as (select cast(row*120 + col as bigint) as key, (col + 0.5E0)*10 as x, (row + 0.5E0)*10 as y, ground + 1.6E0 as eye from surface where surface - ground <= 0.5 and canopy_top - ground <= 0.5),
    top as (select max(greatest(surface, canopy_top)) as highest from surface),
    ray as (select key, trunc((x + sin({AZIMUTH}E0)*8*k)/10) as col, trunc((y + cos({AZIMUTH}E0)*8*k)/10) as row, eye + k*(tan({ALTITUDE}E0)*8) as z
      from (select *, unnest(range(1, cast(least(56, floor((highest - eye)/(tan({ALTITUDE}E0)*8))) as bigint) + 1)) as k from keyed, top)),
    met as (select key, max(cast(surface > z as int)) as cut, sum(case when canopy_top > z and canopy_base < z then cast(round(canopy_k*8*1e6) as bigint) else 0 end)/1e6 as depth from ray join surface using (row, col) group by key)
    select key, round(case when cut = 1 then 0 else exp(-coalesce(depth, 0)) end, 6) as transmission from keyed left join met using (key)
    """,
    *adapters.SURFACE,
)
def f13_ra15_transmission_field(spark, sf_dir):
    """Every cell of open ground, as a pixel: how much of the sun it gets."""
    cells = materialize(surface(spark, sf_dir), "surface")
    open_ground = (F.col("surface") - F.col("ground") <= 0.5) & (F.col("canopy_top") - F.col("ground") <= 0.5)
    pixels = cells.where(open_ground).select((F.col("row") * 120 + F.col("col")).cast("long").alias("key"), ((F.col("col") + 0.5) * 10).alias("x"), ((F.col("row") + 0.5) * 10).alias("y"), (F.col("ground") + EYE).alias("eye"))
    highest = cells.agg(F.max(F.greatest("surface", "canopy_top"))).first()[0]
    return raster.sun_transmission(pixels, cells, GRID, AZIMUTH, ALTITUDE, highest).select("key", r6(F.col("transmission")).alias("transmission"))


assert math.isclose(GRID.res * 0.8, 8.0)
