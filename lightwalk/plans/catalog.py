"""One query for each operator, over the domain views, with the same in hand-written SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import astro, exposure, geo
from ..functions.num import half_up, quantiles
from ..operators import graph, series, spatial
from ..sources import adapters, storage
from ..sources.adapters import AREA, table
from .registry import query, r6

# --- astronomy and exposure ------------------------------------------------------------------------------------------


@query(
    """
    with d as (select event_id, epoch(date_trunc('second', ts))/86400E0 + 2440587.5E0 - 2451545.0E0 as n from events),
    e as (select event_id, n, radians(280.46E0 + 0.9856474E0*n) as l, radians(357.528E0 + 0.9856003E0*n) as g, radians(23.439E0 - 0.0000004E0*n) as eps from d),
    f as (select *, l + radians(1.915E0*sin(g) + 0.02E0*sin(2*g)) as lam from e),
    h as (select *, atan2(cos(eps)*sin(lam), cos(lam)) as ra, asin(sin(eps)*sin(lam)) as dec, radians(((18.697374558E0 + 24.06570982441908E0*n) % 24)*15 + 2.3522E0) as lst from f),
    p as (select *, lst - ra as ha, radians(48.8566E0) as phi from h)
    select event_id, round(asin(greatest(-1E0, least(1E0, sin(phi)*sin(dec) + cos(phi)*cos(dec)*cos(ha)))), 6) as altitude,
      round((atan2(-sin(ha)*cos(dec), sin(dec)*cos(phi) - cos(dec)*sin(phi)*cos(ha)) + 2*pi()) % (2*pi()), 6) as azimuth from p
    """
)
def m1_sun_position(spark, sf_dir):
    ms = F.unix_seconds(F.col("ts").cast("timestamp")) * 1000.0
    altitude, azimuth = astro.sun_position(ms, F.lit(48.8566), F.lit(2.3522))
    return table(spark, sf_dir, "events").select("event_id", r6(altitude).alias("altitude"), r6(azimuth).alias("azimuth"))


@query(
    """
    with a as (select p_partkey, radians(((p_partkey*37) % 9000)/100E0 - 5) as alt from part),
    m as (select *, case when degrees(alt) < -1 then alt else radians(degrees(alt) + 1.02E0/tan(radians(degrees(alt) + 10.3E0/(degrees(alt) + 5.11E0)))/60) end as seen,
      1/(sin(radians(greatest(degrees(alt), -0.5E0))) + 0.50572E0*pow(greatest(degrees(alt), -0.5E0) + 6.07995E0, -1.6364E0)) as am from a),
    t as (select *, case when am > 20 then 1/(10.4E0 + 0.718E0*am) when 6.6296E0 + 1.7513E0*am - 0.1202E0*am*am + 0.0065E0*am*am*am - 0.00013E0*am*am*am*am > 0
      then 1/(6.6296E0 + 1.7513E0*am - 0.1202E0*am*am + 0.0065E0*am*am*am - 0.00013E0*am*am*am*am) else 0.1E0 end as thick from m),
    k as (select *, case when alt > 0 then 133300*exp(-0.8662E0*4*am*thick) else 0 end as dn, case when alt > 0 then 400 + 13500*pow(greatest(sin(alt), 0.01E0), 0.6E0) else 0 end as dh from t)
    select p_partkey, round(seen, 6) as apparent, round(am, 6) as air_mass, round(dn, 3) as direct, round(dh, 3) as diffuse,
      round(case when dn > 0 and alt > 0 then greatest(1.5E0, least(8E0, -ln(dn/133300)/(0.8662E0*am*thick))) else 4 end, 6) as turbidity,
      round(((greatest(1, dh) + greatest(0, dn))/greatest(1, dh) + 1.041E0*pow(greatest(0, pi()/2 - alt), 3))/(1 + 1.041E0*pow(greatest(0, pi()/2 - alt), 3)), 6) as clearness,
      round(greatest(1, dh)*(case when alt > 0 then am else 40 end)/133300, 6) as brightness from k
    """
)
def m2_m8_clear_sky(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", F.radians(F.col("p_partkey") * 37 % 9000 / 100.0 - 5).alias("alt"))
    alt = F.col("alt")
    direct, diffuse = astro.clear_sky(alt)
    clearness, brightness = astro.perez(direct, diffuse, alt)
    return a.select(
        "p_partkey", r6(astro.refracted(alt)).alias("apparent"), r6(astro.air_mass(F.degrees(alt))).alias("air_mass"), F.round(direct, 3).alias("direct"), F.round(diffuse, 3).alias("diffuse"),
        r6(astro.linke_turbidity(direct, alt)).alias("turbidity"), r6(clearness).alias("clearness"), r6(brightness).alias("brightness"),
    )


@query(
    """
    select day, minutes, case when rain > 0 then round(least(1, pow(rain, 0.4E0)), 6) else 0 end as wet,
      round(case when beam is not null then beam*105 else 1000*pow(1 - cloud, 1.5E0) end, 6) as direct from hourly
    """,
    "hourly",
)
def m20_weather(spark, sf_dir):
    h = adapters.hourly(spark, sf_dir)
    direct = F.when(F.col("beam").isNotNull(), F.col("beam") * exposure.BEAM_EFFICACY).otherwise(F.pow(1 - F.col("cloud"), F.lit(1.5)) * 1000)
    return h.select("day", "minutes", r6(exposure.wetness(F.col("rain"))).alias("wet"), r6(direct).alias("direct"))


@query(
    """
    with u as (select p_partkey, p_size/5E0 as uv, ((p_partkey*7) % 101)/100E0 as t, ((p_partkey*13) % 101)/100E0 as svf, cast((p_partkey*3) % 90 as double) as deg, ((p_partkey*11) % 101)/100E0 as share from part),
    d as (select *, greatest(0, least(1, share*case when deg <= 0 then 0.02E0 when deg <= 10 then 0.02E0 + 0.13E0*deg/10 when deg <= 20 then 0.15E0 + 0.12E0*(deg - 10)/10 when deg <= 30 then 0.27E0 + 0.08E0*(deg - 20)/10
      when deg <= 45 then 0.35E0 + 0.08E0*(deg - 30)/15 when deg <= 60 then 0.43E0 + 0.05E0*(deg - 45)/15 when deg <= 90 then 0.48E0 + 0.04E0*(deg - 60)/30 else 0.52E0 end)) as direct from u),
    e as (select *, uv*(direct*t + (1 - direct)*svf) as here from d)
    select p_partkey, round(here, 6) as uv, case when here < 3 then 'faible' when here < 6 then 'modéré' when here < 8 then 'fort' when here < 11 then 'très fort' else 'extrême' end as label from e
    """
)
def m36_local_uv(spark, sf_dir):
    k = F.col("p_partkey")
    pct = lambda n: k * n % 101 / 100.0
    here = exposure.local_uv(F.col("p_size") / 5.0, pct(7), pct(13), (k * 3 % 90).cast("double"), pct(11))
    return table(spark, sf_dir, "part").select("p_partkey", r6(here).alias("uv"), exposure.uv_level(here).alias("label"))


@query(
    """
    s as (select *, coalesce(cast((transmission > 0.5E0) <> lag(transmission > 0.5E0) over (partition by series_id order by seq) as int), 0) as flip, greatest(0, least(1, transmission)) as t from samples)
    select series_id, count(*) as n, case when count(*) < 3 then 0 else round(least(1, sum(case when canopy then 4*t*(1 - t) else 0 end)/count(*) + 0.5E0*least(1, sum(flip)/((count(*) - 1)*4E0)/0.2E0)), 6) end as flicker
    from s group by series_id
    """,
    "samples",
)
def w3_m37_flicker(spark, sf_dir):
    grouped = adapters.samples(spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("seq", "transmission", "canopy"))).alias("s"))
    return grouped.select("series_id", F.size("s").cast("long").alias("n"), r6(exposure.flicker(F.col("s.transmission"), F.col("s.canopy"))).alias("flicker"))


# --- joins -----------------------------------------------------------------------------------------------------------

_VEIL = """
    case when d*d + (height - 1.6E0)*(height - 1.6E0) < 0.25E0 then 0 else flux/(2*pi())*greatest(0.05E0, case when g < 55 then 1 when g < 70 then 1 + 0.5E0*(g - 55)/15 when g < 85 then 1.5E0 - 1.25E0*(g - 70)/15
    else 0.25E0 - least(0.2E0, 0.2E0*(g - 85)/5) end)/(d*d + (height - 1.6E0)*(height - 1.6E0))*10*
    (case when cct <= 1800 then 0.19E0 when cct <= 2000 then 0.19E0 + 0.05E0*(cct - 1800)/200 when cct <= 2700 then 0.24E0 + 0.21E0*(cct - 2000)/700 when cct <= 3000 then 0.45E0 + 0.08E0*(cct - 2700)/300
    when cct <= 3500 then 0.53E0 + 0.1E0*(cct - 3000)/500 when cct <= 4000 then 0.63E0 + 0.09E0*(cct - 3500)/500 when cct <= 5000 then 0.72E0 + 0.15E0*(cct - 4000)/1000 when cct <= 6500 then 0.87E0 + 0.23E0*(cct - 5000)/1500 else 1.1E0 end)
    /pow(greatest(1.5E0, abs(degrees(atan2(height - 1.6E0, d)))), 2) end
"""


@query(
    f"""
    pairs as (select p.point_id, l.*, sqrt((l.x - p.x)*(l.x - p.x) + (l.y - p.y)*(l.y - p.y)) as d from points p join lamps l on abs(l.x - p.x) <= 80 and abs(l.y - p.y) <= 80),
    v as (select *, degrees(atan2(d, greatest(0.1E0, height - 1.6E0))) as g from pairs where d <= 80),
    s as (select point_id, count(*) as lamps, sum({_VEIL}) as veil from v group by point_id)
    select p.point_id, coalesce(s.lamps, 0) as lamps, round(coalesce(s.veil, 0), 4) as veil from points p left join s using (point_id)
    """,
    "points", "lamps",
)
def j1_radius_join_veil(spark, sf_dir):
    points = adapters.points(spark, sf_dir).select("point_id", "x", "y")
    lamps = adapters.lamps(spark, sf_dir).select("x", "y", (F.col("height") - exposure.EYE).alias("rise"), exposure.strength(F.col("flux"), F.col("cct")).alias("strength"))
    near = spatial.folded_within(points, lamps, "point_id", VEIL_REACH, _veiled, "point_id long, lamps long, veil double")
    sums = near.groupBy("point_id").agg(F.sum("lamps").alias("lamps"), F.sum("veil").alias("veil"))
    return points.join(sums, "point_id", "left").select("point_id", F.coalesce("lamps", F.lit(0)).alias("lamps"), F.round(F.coalesce("veil", F.lit(0.0)), 4).alias("veil"))


VEIL_REACH = 80.0


def _veiled(points, lamps):
    """Lamps and veil of points, some of them at a time: arrays of less than 128 kB, which are not asked of the system anew each time."""
    x, y, lx, ly, rise, strength = (f[c].to_numpy() for f, c in ((points, "x"), (points, "y"), (lamps, "x"), (lamps, "y"), (lamps, "rise"), (lamps, "strength")))
    step = max(1, 10_000 // len(lamps))
    parts = [exposure.veils(lx - x[i : i + step, None], ly - y[i : i + step, None], rise, strength, VEIL_REACH) for i in range(0, len(points), step)]
    n, veil = (np.concatenate(p) for p in zip(*parts, strict=True))
    return pd.DataFrame({"point_id": points["point_id"].to_numpy(), "lamps": n, "veil": veil})


@query("select distinct p.point_id from points p join sites s on p.x between s.x0 and s.x1 and p.y between s.y0 and s.y1", "points", "sites")
def j2_points_in_worksites(spark, sf_dir):
    return spatial.within_rings(adapters.points(spark, sf_dir).select("point_id", "x", "y"), adapters.sites(spark, sf_dir)).select("point_id")


@query(
    """
    seeded as (select distinct cast(floor(x/250 + 0.5E0) as bigint) as gx, cast(floor(y/250 + 0.5E0) as bigint) as gy from lamps),
    o as (select i, j from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j) where i <> 0 or j <> 0),
    grown as (select s.gx + o.i as gx, s.gy + o.j as gy from seeded s, o group by 1, 2 having count(*) >= 5)
    select point_id from points where (cast(floor(x/250 + 0.5E0) as bigint), cast(floor(y/250 + 0.5E0) as bigint)) in (select gx, gy from seeded union select gx, gy from grown)
    """,
    "points", "lamps",
)
def j3_a14_lamp_coverage(spark, sf_dir):
    cells = spatial.covered_cells(adapters.lamps(spark, sf_dir))
    return spatial.covered(adapters.points(spark, sf_dir).select("point_id", "x", "y"), cells).select("point_id")


@query(
    """
    q as (select point_id as seq, lon, lat, floor(lon*1e4 + 0.5E0) as qx, floor(lat*1e4 + 0.5E0) as qy from points)
    select min(seq) as seq, arg_min(lon, seq) as lon, arg_min(lat, seq) as lat, count(*) as vertices from q group by qx, qy
    """,
    "points",
)
def j6_quantised_nodes(spark, sf_dir):
    return spatial.quantised_nodes(adapters.points(spark, sf_dir).select(F.col("point_id").alias("seq"), "lon", "lat"), 4)


@query(
    """
    l as (select segment_id, sum(svf) as total from sides where side = 'L' group by 1), r as (select segment_id - 1 as segment_id, sum(svf) as total from sides where side = 'R' group by 1)
    select l.segment_id, l.total as left_svf, coalesce(r.total, l.total) as right_svf from l left join r using (segment_id)
    """,
    "sides",
)
def j7_right_side_or_left(spark, sf_dir):
    s = adapters.sides(spark, sf_dir)
    left = s.where("side = 'L'").groupBy("segment_id").agg(F.sum("svf").alias("left_svf"))
    right = s.where("side = 'R'").groupBy((F.col("segment_id") - 1).alias("segment_id")).agg(F.sum("svf").alias("right_svf"))
    return left.join(right, "segment_id", "left").select("segment_id", "left_svf", F.coalesce("right_svf", "left_svf").alias("right_svf"))


@query(
    """
    w as (select unnest(range(0, 1440, 20)) as m),
    n as (select *, lead(minutes) over o as m2, lead(cloud) over o as c2, lead(beam) over o as b2, row_number() over o as k from hourly window o as (partition by day order by minutes)),
    j as (select n.*, w.m, case when m2 is null or w.m <= minutes then 0E0 else (w.m - minutes)/cast(m2 - minutes as double) end as t from n join w on w.m >= case when k = 1 then -1 else minutes end and w.m < coalesce(m2, 99999))
    select day, cast(m as int) as m, round(case when c2 is null or t = 0 then coalesce(cloud, c2) else coalesce(cloud + (c2 - cloud)*t, c2) end, 6) as cloud,
      round(case when b2 is null or t = 0 then coalesce(beam, b2) else coalesce(beam + (b2 - beam)*t, b2) end, 6) as beam from j
    """,
    "hourly",
)
def j8_weather_between_hours(spark, sf_dir):
    hourly = adapters.hourly(spark, sf_dir)
    wanted = hourly.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(20))).alias("m"))
    return series.bracketed(hourly, wanted, "day", "minutes", ["cloud", "beam"]).select("day", "m", r6(F.col("cloud")).alias("cloud"), r6(F.col("beam")).alias("beam"))


@query(
    """
    m as (select unnest([240, 300, 307, 612, 847, 1319, 1320, 1400]) as minute), p as (select segment_id, sun, minute, greatest(0E0, least(68E0, (minute - 300)/15E0)) as f from sides, m)
    select segment_id, cast(minute as int) as minute, round(sun[cast(floor(f) as int) + 1] + (sun[least(69, cast(floor(f) as int) + 2)] - sun[cast(floor(f) as int) + 1])*(f - floor(f)), 6) as sun from p
    """,
    "sides",
)
def j9_series_at_minutes(spark, sf_dir):
    at = adapters.sides(spark, sf_dir).select("segment_id", "sun", F.explode(F.array(*map(F.lit, (240, 300, 307, 612, 847, 1319, 1320, 1400)))).alias("minute"))
    return at.select("segment_id", "minute", r6(series.on_grid(F.col("sun"), F.col("minute"))).alias("sun"))


@query(
    """
    p as (select point_id, greatest(0E0, least(119E0, x/10 - 0.5E0)) as fx, greatest(0E0, least(79E0, y/10 - 0.5E0)) as fy from points),
    c as (select point_id, least(119, floor(fx) + i) as col, least(79, floor(fy) + j) as row, (case i when 0 then 1 - (fx - floor(fx)) else fx - floor(fx) end)*(case j when 0 then 1 - (fy - floor(fy)) else fy - floor(fy) end) as w
      from p, (values (0), (1)) a(i), (values (0), (1)) b(j))
    select point_id, round(sum(w*((row*131 + col*71) % 97)), 6) as value from c group by point_id
    """,
    "points",
)
def j11_bilinear_raster(spark, sf_dir):
    cells = spark.range(80 * 120).select(F.floor(F.col("id") / 120).alias("row"), (F.col("id") % 120).alias("col"))
    raster = cells.withColumn("value", ((F.col("row") * 131 + F.col("col") * 71) % 97).cast("double"))
    found = spatial.bilinear(adapters.points(spark, sf_dir), raster, 10.0, 120, 80)
    return found.select("point_id", r6(F.col("value")).alias("value"))


@query(
    """
    arcs as (select src, dst from edges union all select dst, src from edges),
    reach(node_id, component) as (select node_id, node_id from nodes union select a.dst, r.component from reach r join arcs a on a.src = r.node_id),
    c as (select node_id, min(component) as component from reach group by 1), big as (select node_id from c where component in (select component from c group by 1 having count(*) >= 200)),
    d as (select p.point_id, n.node_id, sqrt(pow((n.lon - p.lon)*111320*cos(radians((n.lat + p.lat)/2)), 2) + pow((n.lat - p.lat)*111132, 2)) as distance from points p, nodes n semi join big using (node_id))
    select point_id, arg_min(node_id, (round(distance, 9), node_id)) as node_id, round(min(distance), 4) as distance from d group by 1
    """,
    "points", "nodes", "edges",
)
def j12_nearest_node(spark, sf_dir):
    """Each point's nearest node of a component of two hundred nodes at least: fragments of the network lead nowhere."""
    nodes = adapters.nodes(spark, sf_dir)
    labels = graph.components(nodes, adapters.edges(spark, sf_dir))
    large = labels.groupBy("component").agg(F.count("*").alias("n")).where("n >= 200").select("component")
    kept = nodes.join(labels.join(large, "component", "left_semi"), "node_id").select("node_id", "lon", "lat")
    found = spatial.nearest(adapters.points(spark, sf_dir), kept, "point_id", "node_id")
    return found.select("point_id", "node_id", F.round("distance", 4).alias("distance"))


@query("select o_orderkey as cell_key from orders o where not exists (select 1 from orders m where m.o_orderkey = o.o_orderkey and m.o_orderstatus = 'F' and cast(m.o_orderdate as date) >= date '1995-01-01')")
def j16_snk6_pending_cells(spark, sf_dir):
    """Cells that the manifest does not have as done since a date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_key"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"), F.to_date("o_orderdate").alias("date"))
    return storage.pending(orders.select("cell_key"), orders, "cell_key", "1995-01-01")


_SUMMER = "60 + 60*cast(make_timestamp({u}*1000000) >= last_day(make_date(year(make_timestamp({u}*1000000)), 3, 1)) - cast(extract(dow from last_day(make_date(year(make_timestamp({u}*1000000)), 3, 1))) as int) + interval 1 hour and make_timestamp({u}*1000000) < last_day(make_date(year(make_timestamp({u}*1000000)), {end}, 1)) - cast(extract(dow from last_day(make_date(year(make_timestamp({u}*1000000)), {end}, 1))) as int) + interval 1 hour as int)"


def _summer(u: str) -> str:
    """Paris time: summer from the last Sunday of March to that of October (before 1996, of September), at one in UTC."""
    return _SUMMER.format(u=u, end=f"case when year(make_timestamp({u}*1000000)) < 1996 then 9 else 10 end")


@query(
    f"""
    with w as (select o_orderkey as k, cast(epoch(o_orderdate) as bigint) + (o_orderkey*7 % 1440)*60 as wall from orders),
    g1 as (select k, wall, wall - 60*({_summer("wall")}) as g from w), g2 as (select k, wall, wall - 60*({_summer("g")}) as g from g1), g3 as (select k, wall, wall - 60*({_summer("g")}) as g from g2)
    select k as order_key, wall, g as utc, cast({_summer("g")} as bigint) as ahead from g3
    """
)
def m3_local_time(spark, sf_dir):
    """The instant at which clocks in Paris show a time, and how far ahead of UTC they are then."""
    wall = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400 + F.col("o_orderkey") * 7 % 1440 * 60
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), wall.alias("wall")).withColumn("utc", astro.local_to_utc(F.col("wall"), "Europe/Paris"))
    return at.withColumn("ahead", astro.offset_minutes(F.col("utc"), "Europe/Paris").cast("long"))


@query(
    """
    pairs as (select l.segment_id, l.svf + l.work as a, r.svf + r.work as b from sides l join sides r on l.segment_id % 2 = 0 and r.segment_id = l.segment_id + 1)
    select segment_id, case when b < a then 'R' else 'L' end as side, cast(least(a, b) as int) as cost from pairs
    """,
    "sides",
)
def j21_better_side(spark, sf_dir):
    s = adapters.sides(spark, sf_dir)
    pair = s.withColumn("pair", F.col("segment_id") - F.col("segment_id") % 2).withColumn("cost", F.col("svf") + F.col("work"))
    best = pair.groupBy("pair").agg(F.min(F.struct("cost", "side")).alias("best"), F.count("*").alias("n")).where("n = 2")
    return best.select(F.col("pair").alias("segment_id"), "best.side", "best.cost")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query(
    """
    select segment_id, side, cast(floor(cast(sum(cast(round(svf*1000) as bigint)) as double)/(10*count(*)) + 0.5E0) as bigint) as svf, cast(floor(cast(sum((point_id*41) % 1000) as double)/(10*count(*)) + 0.5E0) as bigint) as canopy, cast(least(65535, floor(cast(sum((point_id*53) % 90000) as double)/(10*count(*)) + 0.5E0)) as bigint) as veil, cast(floor(100E0*sum(cast(blocked as int))/count(*) + 0.5E0) as bigint) as blocked,
      max(case when 2*lit >= n then true else false end) as mostly_blocked from points join (select segment_id, count(*) as n, sum(cast(blocked as int)) as lit from points group by 1) using (segment_id) group by 1, 2
    """,
    "points",
)
def a1_a2_a3_a4_side_measures(spark, sf_dir):
    p = adapters.points(spark, sf_dir)
    both = p.groupBy("segment_id").agg((2 * F.sum(F.col("blocked").cast("int")) >= F.count("*")).alias("mostly_blocked"))
    thousandths = F.sum(F.round(F.col("svf") * 1000).cast("long"))  # whole numbers: their sum does not depend on the order
    k = F.col("point_id")  # canopy in thousandths, veil in thousandths of cd/m2: kept as hundredths, 65535 at most
    mean = lambda c: half_up(F.sum(c).cast("double") / (F.count("*") * 10))
    each = p.groupBy("segment_id", "side").agg(half_up(thousandths.cast("double") / (F.count("*") * 10)).alias("svf"), mean(k * 41 % 1000).alias("canopy"), F.least(F.lit(65535), mean(k * 53 % 90000)).alias("veil"), half_up(F.sum(F.col("blocked").cast("int")) * 100.0 / F.count("*")).alias("blocked"))
    return each.join(both, "segment_id")


@query("u as (select segment_id % 20 as street, unnest(horizon) as h, generate_subscripts(horizon, 1) as i from sides), m as (select street, i, cast(floor(avg(h) + 0.5E0) as bigint) as h from u group by 1, 2) select street, list(h order by i) as horizon from m group by street", "sides")
def a5_mean_horizon(spark, sf_dir):
    long = adapters.sides(spark, sf_dir).select((F.col("segment_id") % 20).alias("street"), F.posexplode("horizon").alias("i", "h"))
    means = long.groupBy("street", "i").agg(half_up(F.avg("h")).alias("h"))
    return means.groupBy("street").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x.h).alias("horizon"))


@query("u as (select side, unnest(sun) as s, unnest(flicker) as f, generate_subscripts(sun, 1) - 1 as step from sides) select side, cast(step as int) as step, cast(floor(avg(s) + 0.5E0) as bigint) as sun, cast(floor(avg(f) + 0.5E0) as bigint) as flicker, count(*) as n from u group by 1, 2", "sides")
def a6_sun_and_flicker_by_step(spark, sf_dir):
    """Mean transmission and flicker of each side of the streets at each step of the day, in percent."""
    long = adapters.sides(spark, sf_dir).select("side", F.posexplode(F.arrays_zip("sun", "flicker")).alias("step", "s"))
    return long.groupBy("side", "step").agg(half_up(F.avg("s.sun")).alias("sun"), half_up(F.avg("s.flicker")).alias("flicker"), F.count("*").alias("n"))


@query(
    """
    arcs as (select src, dst from edges union all select dst, src from edges),
    reach(node_id, component) as (select node_id, node_id from nodes union select a.dst, r.component from reach r join arcs a on a.src = r.node_id),
    c as (select node_id, min(component) as component from reach group by 1)
    select component, count(*) as nodes from c group by 1
    """,
    "nodes", "edges",
)
def a8_components(spark, sf_dir):
    return graph.components(adapters.nodes(spark, sf_dir), adapters.edges(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("nodes"))


@query(
    """
    s as (select series_id, seq, transmission, amount, canopy, case when lag(canopy) over o is distinct from canopy then 1 else 0 end as new from samples window o as (partition by series_id order by seq)),
    i as (select *, sum(new) over (partition by series_id order by seq) as island from s),
    g as (select series_id, island, bool_and(canopy) as canopy, sum(amount) as metres, round(avg(transmission), 6) as mean, count(*) as steps from i group by 1, 2)
    select series_id, cast(island as bigint) as island, canopy, metres, mean, steps from g where metres >= 12 or canopy
    """,
    "samples",
)
def a10_route_legs(spark, sf_dir):
    runs = series.islands(adapters.samples(spark, sf_dir), ["series_id"], ["seq"], ["canopy"])
    legs = runs.groupBy("series_id", "island").agg(F.bool_and("canopy").alias("canopy"), F.sum("amount").alias("metres"), r6(F.avg("transmission")).alias("mean"), F.count("*").alias("steps"))
    return legs.where("metres >= 12 or canopy")


@query("select series_id, round(sum(transmission*amount)/sum(amount), 6) as mean, sum(amount) as metres from samples group by 1", "samples")
def a11_weighted_means(spark, sf_dir):
    return adapters.samples(spark, sf_dir).groupBy("series_id").agg(r6(F.sum(F.col("transmission") * F.col("amount")) / F.sum("amount")).alias("mean"), F.sum("amount").alias("metres"))


@query(
    """
    select p_brand as brand, list_extract(list(p_retailprice order by p_retailprice), cast(floor(count(*)/2E0) as int) + 1) as median,
      list_extract(list(p_retailprice order by p_retailprice), cast(floor((count(*) - 1)*0.9E0) as int) + 1) as p90 from part group by 1
    """
)
def a15_a16_quantiles(spark, sf_dir):
    """Quantiles from the counts of each value and their running sum: no group's values are collected."""
    return quantiles(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_retailprice"), "brand", "p_retailprice", median=lambda n: F.floor(n / 2), p90=lambda n: F.floor((n - 1) * 0.9))


@query(
    """
    select l_returnflag as flag, count(*) as n, sum(cast(seen and truth as int)) as hit, round(avg(cast(seen = truth as int)), 6) as agreement,
      round(sum(cast(seen and truth as int))/cast(nullif(sum(cast(seen or truth as int)), 0) as double), 6) as iou, round(corr(l_extendedprice, l_quantity), 6) as r
    from (select *, l_quantity > 25 as seen, l_extendedprice > 50000 as truth from lineitem) group by 1
    """
)
def a19_a20_confusion(spark, sf_dir):
    seen, truth = F.col("l_quantity") > 25, F.col("l_extendedprice") > 50000
    one = lambda c: F.sum(c.cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), one(seen & truth).alias("hit"), r6(F.avg((seen == truth).cast("int"))).alias("agreement"),
        r6(one(seen & truth) / F.nullif(one(seen | truth), F.lit(0))).alias("iou"), r6(F.corr("l_extendedprice", "l_quantity")).alias("r"),
    )


@query(
    """
    with h as (select l_returnflag as flag, least(255, cast(floor(l_extendedprice/400) as int)) as bin, count(*) as n from lineitem group by 1, 2),
    c as (select flag, bin, sum(n) over o as below, sum(n*bin) over o as sum_below, sum(n) over (partition by flag) as total, sum(n*bin) over (partition by flag) as sum_all from h window o as (partition by flag order by bin)),
    v as (select flag, bin, case when below < total then cast(below as double)*(total - below)*pow(cast(sum_below as double)/below - cast(sum_all - sum_below as double)/(total - below), 2) else 0 end as between_classes from c),
    r as (select *, row_number() over (partition by flag order by between_classes desc, bin) as k from v)
    select flag, bin as threshold from r where k = 1
    """
)
def a21_otsu_threshold(spark, sf_dir):
    bins = F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 400)).cast("int")
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), bins.alias("bin")).agg(F.count("*").alias("n"))
    o, every = Window.partitionBy("flag").orderBy("bin"), Window.partitionBy("flag")
    weight = F.col("n") * F.col("bin")
    c = h.select("flag", "bin", F.sum("n").over(o).alias("below"), F.sum(weight).over(o).alias("low"), F.sum("n").over(every).alias("total"), F.sum(weight).over(every).alias("all"))
    above = F.col("total") - F.col("below")
    gap = F.col("low") / F.col("below") - (F.col("all") - F.col("low")) / above
    score = F.when(above > 0, F.col("below").cast("double") * above * gap * gap).otherwise(0.0)
    return c.withColumn("score", score).groupBy("flag").agg(F.min(F.struct((-F.col("score")).alias("s"), "bin")).alias("best")).select("flag", F.col("best.bin").alias("threshold"))


@query(
    """
    with r as (select p_brand, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as a, row_number() over (partition by p_brand order by p_size, p_partkey) as b from part)
    select p_brand as brand, round(1 - 6*sum(cast((a - b)*(a - b) as double))/(count(*)*(cast(count(*) as double)*count(*) - 1)), 6) as rho from r group by 1
    """
)
def a24_spearman(spark, sf_dir):
    rank = lambda c: F.row_number().over(Window.partitionBy("p_brand").orderBy(c, "p_partkey")).cast("long")  # noqa: E731 squares of ranks outgrow an int
    ranked = table(spark, sf_dir, "part").select("p_brand", (rank("p_retailprice") - rank("p_size")).alias("d"))
    n = F.count("*").cast("double")
    return ranked.groupBy(F.col("p_brand").alias("brand")).agg(r6(1 - F.sum((F.col("d") * F.col("d")).cast("double")) * 6 / (n * (n * n - 1))).alias("rho"))


# --- windows and folds -----------------------------------------------------------------------------------------------


@query(
    """
    l as (select series_id, list(amount order by seq) as lengths from samples group by 1),
    f(series_id, lengths, i, total, piece) as (select series_id, lengths, 1, case when lengths[1] >= 60 then 0 else lengths[1] end, 0 + cast(lengths[1] >= 60 as int) from l
      union all select series_id, lengths, i + 1, case when total + lengths[i + 1] >= 60 then 0 else total + lengths[i + 1] end, piece + cast(total + lengths[i + 1] >= 60 as int) from f where i < len(lengths))
    select series_id, cast(i as int) as step, cast(piece - cast(total = 0 as int) as int) as piece, lengths[i] as metres from f
    """,
    "samples",
)
def w1_pieces_of_60_metres(spark, sf_dir):
    lines = adapters.samples(spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("seq", "amount"))).alias("s"))
    cut = lines.select("series_id", F.arrays_zip(F.col("s.seq").alias("step"), series.cut_lengths(F.col("s.amount"), 60.0).alias("piece"), F.col("s.amount").alias("metres")).alias("x"))
    return cut.select("series_id", F.inline("x"))


@query(
    """
    e as (select series_id, seq, amount as len, coalesce(sum(amount) over (partition by series_id order by seq rows between unbounded preceding and 1 preceding), 0) as start from samples),
    k as (select series_id, start, len, unnest(range(cast(greatest(0, floor((start - 8)/16) + 1) as bigint), cast(floor((start + len - 8)/16) as bigint) + 1)) as k from e)
    select series_id, k, round((k*16 + 8 - start)/len*10, 6) as x, round(start + (k*16 + 8 - start), 6) as y from k
    union all select series_id, 0, 5E0, round(sum(len)/2, 6) from e group by series_id having sum(len) < 8
    """,
    "samples",
)
def w2_resampled(spark, sf_dir):
    """Chains that climb by the amount; x tells, in tenths, how far into its segment a sample lies (into the chain, where that is too short for a sample)."""
    s = adapters.samples(spark, sf_dir)
    at = series.running(F.col("amount"), ["series_id"], ["seq"])
    chain = s.select("series_id", "seq", F.lit(0.0).alias("x1"), (at - F.col("amount")).alias("y1"), F.lit(0.0).alias("x2"), at.alias("y2"))
    found = series.resampled(chain, "series_id", 16.0, ends=True)
    return found.select("series_id", "k", r6((F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * 10).alias("x"), r6(F.col("y")).alias("y"))


@query(
    """
    l as (select series_id, list({'d': cum, 'v': amount} order by seq) as h from (select *, sum(amount) over (partition by series_id order by seq rows unbounded preceding) as cum from samples) group by 1),
    f(series_id, h, i, kept) as (select series_id, h, 1, [h[1]] from l
      union all select series_id, h, i + 1, case when h[i + 1].d - kept[len(kept)].d < 40 then case when h[i + 1].v > kept[len(kept)].v then list_append(kept[1:len(kept) - 1], h[i + 1]) else kept end else list_append(kept, h[i + 1]) end from f where i < len(h))
    select series_id, k.d as distance, k.v as delta from (select series_id, unnest(kept) as k from f where i = len(h))
    """,
    "samples",
)
def w5_ramps_kept_apart(spark, sf_dir):
    s = adapters.samples(spark, sf_dir).withColumn("cum", series.running(F.col("amount"), ["series_id"], ["seq"]))
    hits = s.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("seq", "cum", "amount"))).alias("h"))
    shaped = F.transform("h", lambda x: F.struct(x.cum.alias("distance"), x.amount.alias("delta")))
    return hits.select("series_id", F.inline(series.kept_apart(shaped, 40.0)))


@query("select series_id, seq, sum(amount) over (partition by series_id order by seq rows unbounded preceding) as along from samples", "samples")
def w8_cumulative_distance(spark, sf_dir):
    return adapters.samples(spark, sf_dir).select("series_id", "seq", series.running(F.col("amount"), ["series_id"], ["seq"]).alias("along"))


@query(
    """
    b as (select user_id, fix_id, lon, lat, lag(lon) over o as lon0, lag(lat) over o as lat0 from (select user_id, event_id as fix_id, (2.345E0 + ((event_id*7919) % 10007)/10007E0*0.017E0) as lon, (48.853E0 + ((event_id*104729) % 10009)/10009E0*0.007E0) as lat from events) window o as (partition by user_id order by fix_id)),
    h as (select *, (degrees(atan2((lon - lon0)*111320*cos(radians((lat + lat0)/2)), (lat - lat0)*111132)) + 360) % 360 as heading from b),
    t as (select user_id, fix_id, heading, (((heading - lag(heading) over (partition by user_id order by fix_id) + 540) % 360 + 360) % 360) - 180 as turn from h)
    select user_id, fix_id, round(turn, 4) + 0E0 as turn, case when abs(turn) < 28 then 'straight' when abs(turn) < 55 then case when turn > 0 then 'slight_right' else 'slight_left' end
      when abs(turn) < 135 then case when turn > 0 then 'right' else 'left' end else case when turn > 0 then 'sharp_right' else 'sharp_left' end end as kind from t where turn is not null
    """,
    "lamps",
)
def w6_g5_turns(spark, sf_dir):
    o = Window.partitionBy("user_id").orderBy("fix_id")
    prev = lambda c: F.lag(c).over(o)
    h = adapters.fixes(spark, sf_dir).withColumn("heading", geo.bearing(prev("lon"), prev("lat"), F.col("lon"), F.col("lat")))
    t = h.withColumn("turn", geo.turn(F.col("heading"), prev("heading"))).where("turn is not null")
    return t.select("user_id", "fix_id", F.round("turn", 4).alias("turn"), geo.turn_kind(F.col("turn")).alias("kind"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 12")
def w12_last_twelve(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("k", newest).where("k <= 12").select("user_id", "event_id")


@query(
    """
    with p as (select (event_id // 100) as row, event_id % 100 as col, value > 0 as lit, event_type = 'click' as mask from events),
    m as (select row, col, max(cast(mask as int)) over (partition by row order by col range between 2 preceding and 2 following) as m, lit from p),
    d as (select row, col, max(m) over (partition by col order by row range between 2 preceding and 2 following) as dilated, lit from m),
    e as (select *, lead(lit) over (partition by row order by col) as r, lead(lit) over (partition by col order by row) as b from d)
    select row, col, cast(dilated as int) as dilated, coalesce(lit <> r, false) or coalesce(lit <> b, false) as edge from e
    """
)
def w15_w16_edges_and_dilation(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("row"), (F.col("event_id") % 100).alias("col"), (F.col("value") > 0).alias("lit"), (F.col("event_type") == "click").cast("int").alias("mask"))
    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    wide = p.withColumn("mask", F.max("mask").over(by_row.rangeBetween(-2, 2)))
    both = wide.withColumn("dilated", F.max("mask").over(by_col.rangeBetween(-2, 2)))
    differs = lambda w: F.coalesce(F.col("lit") != F.lead("lit").over(w), F.lit(False))
    return both.select("row", "col", "dilated", (differs(by_row) | differs(by_col)).alias("edge"))


# --- top-k, sets, tiles, storage, text -------------------------------------------------------------------------------


@query("select p_name as label from (select distinct p_name from part) where strpos(lower(p_name), 're') > 0 order by case when starts_with(lower(p_name), 're') then 0 else 1 end, length(p_name), p_name limit 6")
def t1_search(spark, sf_dir):
    name = F.lower("label")
    hits = table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct().where(F.instr(name, "re") > 0)
    return hits.orderBy(F.when(name.startswith("re"), 0).otherwise(1), F.length("label"), "label").limit(6)


@query("select p_brand, p_type, count(*) as n from part group by 1, 2 order by n desc, p_brand, p_type limit 10")
def t3_top_ten(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", "p_type").limit(10)


@query(
    """
    z as (select unnest(range(12, 17)) as zoom)
    select cast(zoom as int) as zoom, cast(floor((lon + 180)/360*pow(2, zoom)) as bigint) as tx, cast(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*pow(2, zoom)) as bigint) as ty, count(*) as points from points, z group by 1, 2, 3
    """,
    "points",
)
def g2_u4_tiles(spark, sf_dir):
    p = adapters.points(spark, sf_dir).select("lon", "lat", F.explode(F.sequence(F.lit(12), F.lit(16))).alias("zoom"))
    return p.groupBy("zoom", geo.tile_x(F.col("lon"), F.col("zoom")).alias("tx"), geo.tile_y(F.col("lat"), F.col("zoom")).alias("ty")).agg(F.count("*").alias("points"))


@query("select o_orderkey as cell_key, case when o_orderkey % 4 = 0 then 'new' else o_orderstatus end as status from orders union all select o_orderkey + 100000000, 'new' from orders where o_orderkey % 40 = 0")
def snk5_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_key"), F.col("o_orderstatus").alias("status"))
    again = old.where("cell_key % 4 = 0").select("cell_key", F.lit("new").alias("status"))
    fresh = old.where("cell_key % 40 = 0").select((F.col("cell_key") + 100000000).alias("cell_key"), F.lit("new").alias("status"))
    return storage.upserted(old, again.unionByName(fresh), "cell_key")


@query("select shard, name from (select user_id % 10 as shard, event_id as name, sum(1000 + event_id % 777) over (partition by user_id % 10 order by ts desc, event_id desc rows unbounded preceding) as total from events) where total <= 100000")
def snk9_cache_budget(spark, sf_dir):
    files = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("shard"), F.col("event_id").alias("name"), (1000 + F.col("event_id") % 777).alias("size"), F.col("ts").alias("modified"))
    return storage.within_budget(files, "shard", 100000).select("shard", "name")


# --- streams ---------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    known = spark.read.parquet(path)
    stream = spark.readStream.schema(known.schema)
    if any(f.endswith("/events.parquet") for f in known.inputFiles()):  # a single file: a stream watches its folder
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(path)


@query(None)
def st1_st5_tracking(spark, sf_dir):
    from ..streaming import tracking

    k = F.col("event_id")
    fixes = _events(spark, sf_dir).select("user_id", k.alias("fix_id"), F.col("ts").cast("timestamp").alias("ts"), adapters.lon(k).alias("lon"), adapters.lat(k).alias("lat"))
    route = tracking.Route([2.345 + 0.0005 * i for i in range(35)], [48.853 + 0.0002 * i for i in range(35)], [150.0, 420.0, 900.0, 1400.0], [90.0, 640.0, 1210.0])
    return tracking.drained(tracking.tracked(fixes, route), "fixes", storage.shared_folder(spark, "streams"))


@query(
    """
    with e as (select *, max(ts) over () as newest from events)
    select date_trunc('hour', ts) as start, event_type, count(*) as n from e group by 1, 2, newest having date_trunc('hour', ts) + interval 1 hour <= newest - interval 2 hour
    """
)
def st_windowed_events(spark, sf_dir):
    from ..streaming import tracking

    found = tracking.drained(tracking.windowed(_events(spark, sf_dir)), "windows", storage.shared_folder(spark, "streams"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
