"""Domain views over the generated tables: deterministic stand-ins for lamps, streets, points, weather and the like.

All literals are doubles and all keys integers, so that any engine computes the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import Plane, flat_distance
from ..functions.num import half_up
from .storage import dealt

#: The area that all positions fall in.
AREA = (2.345, 48.853, 2.362, 48.86)
PLANE = Plane(*AREA)
GRID_WIDTH = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon(k: Column) -> Column:
    return (k * 7919) % 10007 / F.lit(10007.0) * F.lit(0.017) + F.lit(2.345)


def lat(k: Column) -> Column:
    return (k * 104729) % 10009 / F.lit(10009.0) * F.lit(0.007) + F.lit(48.853)


def placed(df: DataFrame) -> DataFrame:
    """With metres x, y on the area's plane."""
    return df.withColumns({"x": PLANE.x(F.col("lon")), "y": PLANE.y(F.col("lat"))})


def lamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return placed(
        table(spark, sf_dir, "supplier").select(
            k.alias("lamp_id"), lon(k).alias("lon"), lat(k).alias("lat"),
            ((k * 37) % 8000 + 500).cast("double").alias("flux"), (k % 7 + 3).cast("double").alias("height"), ((k * 53) % 4700 + 1800).cast("double").alias("cct"),
        )
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksites as boxes: the ring's corners in metres."""
    k, half = F.col("p_partkey"), F.col("p_size") * 15.0 / 50.0 + 5.0
    base = placed(table(spark, sf_dir, "part").select(k.alias("site_id"), lon(k).alias("lon"), lat(k).alias("lat"), half.alias("half")))
    corner = lambda i, j: F.struct((F.col("x") + F.col("half") * i).alias("x"), (F.col("y") + F.col("half") * j).alias("y"))
    return base.select("site_id", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return placed(
        table(spark, sf_dir, "orders").select(
            k.alias("point_id"), F.col("o_custkey").alias("segment_id"), (k % 2).cast("int").alias("side"), lon(k).alias("lon"), lat(k).alias("lat"),
            ((k * 31) % 1000 / F.lit(1000.0)).alias("svf"), ((k * 17) % 100 < 15).alias("blocked"), F.col("o_orderdate").alias("at"),
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light transmission along series, in a total order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem")
    needed = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity")
    return dealt(needed, "l_orderkey", rows=lines.count()).select(
        F.col("l_orderkey").alias("series_id"), F.row_number().over(order).alias("seq"), (F.col("l_discount") * 10).alias("transmission"),
        (F.col("l_returnflag") == "R").alias("canopy"), F.col("l_quantity").alias("amount"),
    )


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored physics of sidewalks: sky view, series of sun and flicker (percent, every quarter hour from 5:00), horizon."""
    k = F.col("vec_id")
    series = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(68)), lambda i: ((k * a + i * b) % 101).cast("int"))
    horizon = F.transform(F.slice("embedding", 1, 32), lambda e: F.least(F.lit(90), half_up(F.abs(e.cast("double")) * 150)).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        k.alias("segment_id"), F.when(k % 2 == 0, "L").otherwise("R").alias("side"), ((k * 13) % 101).cast("int").alias("svf"), series(7, 13).alias("sun"),
        series(11, 5).alias("flicker"), horizon.alias("horizon"), ((k * 29) % 300).cast("int").alias("veil"), ((k * 7) % 101).cast("int").alias("work"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.sum(half_up(F.col("value") * 100).cast("long")).alias("cents"))
    known = F.col("hour") % 7 != 0
    return found.select(
        "day", (F.col("hour") * 60).alias("minutes"), ((F.col("n") * 37) % 101 / F.lit(100.0)).alias("cloud"), ((F.col("n") * 13) % 50 / F.lit(10.0)).alias("rain"),
        F.when(known, (F.abs(F.col("cents")) % 90000) / F.lit(100.0)).alias("beam"), F.when(known, (F.abs(F.col("cents")) % 30000) / F.lit(100.0)).alias("diffuse"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("node_id"), (k % GRID_WIDTH * F.lit(0.0004) + F.lit(2.345)).alias("lon"), (F.floor(k / GRID_WIDTH) * F.lit(0.0003) + F.lit(48.853)).alias("lat")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected grid edges (src < dst); the exposure of a segment is (src * 31) % 101."""
    n = nodes(spark, sf_dir)
    step = F.explode(F.array(F.when(F.col("node_id") % GRID_WIDTH < GRID_WIDTH - 1, 1), F.lit(GRID_WIDTH)))
    pairs = n.select("node_id", "lon", "lat", step.alias("step")).where("step is not null").withColumn("dst", F.col("node_id") + F.col("step"))
    other = n.select(F.col("node_id").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    a, b = F.col("node_id"), F.col("dst")
    kept = pairs.join(other, "dst").where((a * a * 31 + b * b * 17 + a * b * 7) % 101 >= 50)
    return kept.select(a.alias("src"), "dst", a.alias("segment_id"), flat_distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("length"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", k.alias("fix_id"), F.col("ts").cast("timestamp").alias("ts"), lon(k).alias("lon"), lat(k).alias("lat"))


#: The same views in ANSI SQL, written apart, for the oracle.
_LON = "(2.345E0 + ((cast({k} as bigint)*7919) % 10007)/10007E0*0.017E0)"
_LAT = "(48.853E0 + ((cast({k} as bigint)*104729) % 10009)/10009E0*0.007E0)"


def _xy(k: str) -> str:
    lo, la = _LON.format(k=k), _LAT.format(k=k)
    return f"{lo} as lon, {la} as lat, ({lo} - 2.345E0)*{PLANE.lon_m!r}E0 as x, ({la} - 48.853E0)*{PLANE.lat_m!r}E0 as y"


SQL = {
    "lamps": f"select s_suppkey as lamp_id, {_xy('s_suppkey')}, cast(500 + (s_suppkey*37) % 8000 as double) as flux, cast(3 + s_suppkey % 7 as double) as height, cast(1800 + (s_suppkey*53) % 4700 as double) as cct from supplier",
    "sites": f"select site_id, x - half as x0, x + half as x1, y - half as y0, y + half as y1 from (select p_partkey as site_id, {_xy('p_partkey')}, 5E0 + p_size*15E0/50E0 as half from part)",
    "points": f"select o_orderkey as point_id, o_custkey as segment_id, cast(o_orderkey % 2 as int) as side, {_xy('o_orderkey')}, ((o_orderkey*31) % 1000)/1000E0 as svf, (o_orderkey*17) % 100 < 15 as blocked, o_orderdate as at from orders",
    "samples": "select l_orderkey as series_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_shipdate, l_extendedprice) as int) as seq, l_discount*10 as transmission, l_returnflag = 'R' as canopy, l_quantity as amount from lineitem",
    "sides": "select vec_id as segment_id, case when vec_id % 2 = 0 then 'L' else 'R' end as side, cast((vec_id*13) % 101 as int) as svf, [cast((vec_id*7 + i*13) % 101 as int) for i in range(69)] as sun, [cast((vec_id*11 + i*5) % 101 as int) for i in range(69)] as flicker, [cast(least(90, floor(abs(cast(e as double))*150 + 0.5)) as int) for e in embedding[1:32]] as horizon, cast((vec_id*29) % 300 as int) as veil, cast((vec_id*7) % 101 as int) as work from embeddings",
    "hourly": "select day, hour*60 as minutes, ((n*37) % 101)/100E0 as cloud, ((n*13) % 50)/10E0 as rain, case when hour % 7 <> 0 then (abs(cents) % 90000)/100E0 end as beam, case when hour % 7 <> 0 then (abs(cents) % 30000)/100E0 end as diffuse from (select cast(ts as date) as day, cast(extract(hour from ts) as int) as hour, count(*) as n, cast(sum(cast(floor(value*100 + 0.5) as bigint)) as bigint) as cents from events group by 1, 2)",
    "nodes": "select c_custkey as node_id, 2.345E0 + (c_custkey % 40)*0.0004E0 as lon, 48.853E0 + (c_custkey // 40)*0.0003E0 as lat from customer",
    "edges": "select a.node_id as src, b.node_id as dst, a.node_id as segment_id, sqrt(pow((b.lon - a.lon)*111320*cos(radians((a.lat + b.lat)/2)), 2) + pow((b.lat - a.lat)*111132, 2)) as length from nodes a join nodes b on (b.node_id = a.node_id + 1 and a.node_id % 40 < 39) or b.node_id = a.node_id + 40 where (a.node_id*a.node_id*31 + b.node_id*b.node_id*17 + a.node_id*b.node_id*7) % 101 >= 50",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the definitions of the named views."""
    return "with recursive " + ", ".join(f"{n} as materialized ({SQL[n]})" for n in names) + sql


# --- ground: what stands on the grid ---------------------------------------------------------------------------------

#: Heights by kind of vegetation (else the default), foliage per metre, crown radii by stage, evergreen genera.
CANOPY_HEIGHT = {
    "Forêt fermée de feuillus": 20.0, "Forêt fermée de conifères": 22.0, "Forêt fermée mixte": 21.0, "Forêt ouverte": 12.0, "Peupleraie": 20.0, "Bois": 15.0,
    "Zone arborée": 12.0, "Haie": 3.0, "Verger": 4.0, "Vigne": 1.6, "Lande ligneuse": 1.5,
}
DEFAULT_CANOPY, LEAF_ON, LEAF_OFF, CONIFER = 12.0, 0.265, 0.075, 0.3
STAGE_RADIUS = {"Jeune (arbre)": 1.5, "Jeune (arbre)Adulte": 2.5, "Adulte": 4.0, "Mature": 5.5}
NATURES = [*CANOPY_HEIGHT, "Inconnue"]
GENERA = ["Platanus", "Quercus", "Tilia", "Pinus", "Laurus", "Acer"]


def looked_up(key: Column, table: dict, default) -> Column:
    """The value of a literal table, else the default."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def chosen(k: Column, names: list) -> Column:
    """One of the names by ``k`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names)).cast("int") + 1)


def canopy_height(nature: Column) -> Column:
    return looked_up(nature, CANOPY_HEIGHT, DEFAULT_CANOPY)


def canopy_extinction(nature: Column, leaf_on: bool) -> Column:
    """Foliage per metre: conifers all year, mixed woods half and half, all others by season."""
    bare = LEAF_ON if leaf_on else LEAF_OFF
    return F.when(nature == "Forêt fermée de conifères", CONIFER).when(nature == "Forêt fermée mixte", (CONIFER + bare) / 2).otherwise(bare)


def ground(spark: SparkSession, grid) -> DataFrame:
    return grid.cells(spark).withColumn("ground", (30 + (F.col("row") * 7 + F.col("col") * 3) % 5).cast("double"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select(F.col("site_id").alias("building_id"), F.array("ring").alias("rings"), (F.col("site_id") % 30 + 6).cast("double").alias("height"))


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    base = placed(table(spark, sf_dir, "supplier").select(k.alias("park_id"), lon(k * 3 + 1).alias("lon"), lat(k * 3 + 1).alias("lat"), chosen(k, NATURES).alias("nature"), (k % 20 + 10).cast("double").alias("half")))
    corner = lambda i, j: F.struct((F.col("x") + F.col("half") * i).alias("x"), (F.col("y") + F.col("half") * j).alias("y"))
    return base.select("park_id", "nature", F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("rings"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as their register has them: some without height, trunk or a place in the ground."""
    k = F.col("c_custkey")
    return placed(
        table(spark, sf_dir, "customer").select(
            k.alias("tree_id"), lon(k * 5 + 2).alias("lon"), lat(k * 5 + 2).alias("lat"), F.when(k % 11 == 0, "Trou").otherwise("Arbre").alias("spot"), (k * 7 % 60 - 3).cast("double").alias("height"),
            F.when(k % 4 != 0, (k * 13 % 250).cast("double")).alias("girth"), chosen(k, [*STAGE_RADIUS, "?"]).alias("stage"), F.when(k % 3 == 0, "Alignement").otherwise("Jardin").alias("domain"),
            chosen(k, GENERA).alias("genus"), F.when(k % 12 == 1, "ilex").otherwise("robur").alias("species"),
        )
    )


def crowns(trees: DataFrame) -> DataFrame:
    """``trees`` with radius, top and base of the crown; those without a height go."""
    top = F.least(F.col("height"), F.lit(45.0))
    wide = F.when(F.col("girth") > 5, F.col("girth") / 3.141592653589793 * 0.11 + 0.6).otherwise(looked_up(F.col("stage"), STAGE_RADIUS, 3.0))
    radius = F.greatest(F.lit(1.0), F.least(wide, F.lit(9.0), top * 0.5))
    evergreen = F.col("genus").isin("Pinus", "Laurus") | ((F.col("genus") == "Quercus") & F.col("species").contains("ilex"))
    alive = trees.where((F.col("spot") == "Arbre") & (F.col("height") > 0))
    return alive.select("tree_id", "x", "y", radius.alias("radius"), top.alias("top"), (top * F.when(F.col("domain") == "Alignement", 0.42).otherwise(0.28)).alias("base"), evergreen.alias("evergreen"))


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(key: str, table: dict, default) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}E0" for k, v in table.items()) + f" else {default}E0 end"


SQL |= {
    "cells": "select cast(r as int) as row, cast(c as int) as col, cast(30 + (r*7 + c*3) % 5 as double) as ground from (select unnest(range(80)) as r), (select unnest(range(120)) as c)",
    "buildings": f"select site_id as building_id, x0, x1, y0, y1, cast(site_id % 30 + 6 as double) as height from ({SQL['sites']})",
    "parks": f"select park_id, nature, x - half as x0, x + half as x1, y - half as y0, y + half as y1 from (select s_suppkey as park_id, {_xy('(s_suppkey*3 + 1)')}, {_list(NATURES)}[1 + s_suppkey % {len(NATURES)}] as nature, cast(10 + s_suppkey % 20 as double) as half from supplier)",
    "trees": f"select c_custkey as tree_id, {_xy('(c_custkey*5 + 2)')}, case when c_custkey % 11 = 0 then 'Trou' else 'Arbre' end as spot, cast((c_custkey*7) % 60 - 3 as double) as height, case when c_custkey % 4 <> 0 then cast((c_custkey*13) % 250 as double) end as girth, {_list([*STAGE_RADIUS, '?'])}[1 + c_custkey % {len(STAGE_RADIUS) + 1}] as stage, case when c_custkey % 3 = 0 then 'Alignement' else 'Jardin' end as domain, {_list(GENERA)}[1 + c_custkey % {len(GENERA)}] as genus, case when c_custkey % 12 = 1 then 'ilex' else 'robur' end as species from customer",
    "crowns": "select tree_id, x, y, greatest(1E0, least(case when girth > 5 then 0.6E0 + 0.11E0*girth/pi() else " + _case("stage", STAGE_RADIUS, 3.0) + " end, 9E0, least(height, 45)*0.5E0)) as radius, least(height, 45E0) as top, least(height, 45E0)*(case when domain = 'Alignement' then 0.42E0 else 0.28E0 end) as base, genus in ('Pinus', 'Laurus') or (genus = 'Quercus' and species = 'ilex') as evergreen from trees where spot = 'Arbre' and height > 0",
    "zones": "select *, " + _case("nature", CANOPY_HEIGHT, DEFAULT_CANOPY) + " as top, case nature when 'Forêt fermée de conifères' then 0.3E0 when 'Forêt fermée mixte' then (0.3E0 + 0.265E0)/2 else 0.265E0 end as k, case nature when 'Forêt fermée de conifères' then 0.3E0 when 'Forêt fermée mixte' then (0.3E0 + 0.075E0)/2 end as lasting from parks",
    "surface": """
      select c.row, c.col, c.ground, c.ground + coalesce(b.height, 0) as surface, coalesce(c.ground + g.top, 0) as canopy_top, coalesce(c.ground + g.base, 0) as canopy_base, coalesce(g.k, 0) as canopy_k
      from cells c left join (select c.row, c.col, max(height) as height from cells c join buildings on (c.row + 0.5E0)*10 >= y0 and (c.row + 0.5E0)*10 < y1 and c.col between floor(x0/10) and floor(x1/10) group by 1, 2) b using (row, col)
      left join (select row, col, max(top) as top, min(base) as base, max(k) as k from (
        select c.row, c.col, top, top*0.2E0 as base, k from cells c join zones on (c.row + 0.5E0)*10 >= y0 and (c.row + 0.5E0)*10 < y1 and c.col between floor(x0/10) and floor(x1/10)
        union all select c.row, c.col, base + (top - base)*sqrt(1 - (((c.col + 0.5E0)*10 - x)*((c.col + 0.5E0)*10 - x) + ((c.row + 0.5E0)*10 - y)*((c.row + 0.5E0)*10 - y))/(radius*radius)), base, case when evergreen then 0.3E0 else 0.265E0 end
          from cells c join crowns on ((c.col + 0.5E0)*10 - x)*((c.col + 0.5E0)*10 - x) + ((c.row + 0.5E0)*10 - y)*((c.row + 0.5E0)*10 - y) <= radius*radius where top > base) group by 1, 2) g using (row, col)
    """,
}
#: Views that the surface is made of, in order.
SURFACE = ("cells", "sites", "buildings", "parks", "zones", "trees", "crowns", "surface")


# --- ways: tagged lines ------------------------------------------------------------------------------------------------

HIGHWAYS = ["residential", "footway", "primary", "service", "steps", "tertiary", "pedestrian", "living_street", "cycleway", "track"]


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four vertices in metres, with tags as columns (null: absent)."""
    k = F.col("p_partkey")
    base = placed(table(spark, sf_dir, "part").select(k.alias("way_id"), "p_brand", lon(k * 11 + 3).alias("lon"), lat(k * 11 + 3).alias("lat")))
    w = F.col("way_id")
    vertex = lambda i: F.struct((F.col("x") + (w % 25 + 6) * i).alias("x"), (F.col("y") + (w % 7 * (i * i)) % 11).alias("y"))
    tag = lambda n, **at: _first([(w % n == int(r[1:]), F.lit(v)) for r, v in at.items()])
    return base.select(
        "way_id", chosen(w, HIGHWAYS).alias("highway"), tag(23, r0="no").alias("foot"), tag(29, r0="private").alias("access"), tag(20, r3="parking_aisle").alias("service"),
        tag(13, r0="yes", r1="building_passage", r2="passage").alias("tunnel"), tag(17, r0="no", r1="yes").alias("covered"), tag(31, r0="yes").alias("indoor"),
        F.when(w % 10 == 1, tag(3, r0="crossing", r1="sidewalk")).alias("footway"), tag(37, r0="zebra").alias("crossing"),
        F.when(w % 5 == 0, F.concat((w % 30).cast("string"), F.lit(" m"))).when(w % 5 == 1, "wide").alias("width"), F.when(w % 4 != 0, F.concat(F.lit("Rue "), "p_brand")).alias("name"),
        tag(6, r0="left", r1="right", r2="both", r3="separate").alias("sidewalk"), F.array(*[vertex(i) for i in range(4)]).alias("line"),
    )


def _first(cases: list) -> Column:
    out = F.lit(None).cast("string")
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


SQL |= {
    "ways": f"select way_id, {_list(HIGHWAYS)}[1 + way_id % 10] as highway, case when way_id % 23 = 0 then 'no' end as foot, case when way_id % 29 = 0 then 'private' end as access, case when way_id % 20 = 3 then 'parking_aisle' end as service, case way_id % 13 when 0 then 'yes' when 1 then 'building_passage' when 2 then 'passage' end as tunnel, case way_id % 17 when 0 then 'no' when 1 then 'yes' end as covered, case when way_id % 31 = 0 then 'yes' end as indoor, case when way_id % 10 = 1 then case way_id % 3 when 0 then 'crossing' when 1 then 'sidewalk' end end as footway, case when way_id % 37 = 0 then 'zebra' end as crossing, case way_id % 5 when 0 then (way_id % 30) || ' m' when 1 then 'wide' end as width, case when way_id % 4 <> 0 then 'Rue ' || p_brand end as name, case way_id % 6 when 0 then 'left' when 1 then 'right' when 2 then 'both' when 3 then 'separate' end as sidewalk, x, y from (select p_partkey as way_id, p_brand, {_xy('(p_partkey*11 + 3)')} from part)",
    "vertices": "select way_id, cast(i as int) as i, x + (6 + way_id % 25)*i as x, y + ((way_id % 7)*i*i) % 11 as y from ways, (select unnest(range(4)) as i)",
    "hops": "select a.way_id, b.i as i, a.x as x1, a.y as y1, b.x as x2, b.y as y2, sqrt((b.x - a.x)*(b.x - a.x) + (b.y - a.y)*(b.y - a.y)) as len from vertices a join vertices b on b.way_id = a.way_id and b.i = a.i + 1",
    "dots": "select way_id, k, x1 + (x2 - x1)*(2 + 4*k - start)/len as x, y1 + (y2 - y1)*(2 + 4*k - start)/len as y, (x2 - x1)/len as dx, (y2 - y1)/len as dy from (select *, unnest(range(cast(greatest(0, floor((start - 2)/4) + 1) as bigint), cast(floor((upto - 2)/4) as bigint) + 1)) as k from (select *, coalesce(lag(upto) over (partition by way_id order by i), 0) as start from (select *, sum(len) over (partition by way_id order by i rows unbounded preceding) as upto from hops)))",
}
WAYS = ("ways", "vertices", "hops", "dots")
