"""Cells of a region: which there are, what a route needs of them, how their graphs join, and what is written about them."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.num import half_up
from ..operators import spatial
from ..sources import adapters
from ..sources.adapters import AREA, table
from ..sources.region import Region, write_region
from ..sources.storage import shared_folder
from .registry import query, r6

ZOOM, SEGMENTS = 17, 1 << 16
REGION = [(2.3462, 48.8535), (2.3601, 48.8540), (2.3588, 48.8597), (2.3530, 48.8561), (2.3475, 48.8590), (2.3462, 48.8535)]


def _span():
    side = 2**ZOOM
    x = lambda lon: math.floor((lon + 180) / 360 * side)
    y = lambda lat: math.floor((1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * side)
    return x(AREA[0]), x(AREA[2]), y(AREA[3]), y(AREA[1])


X0, X1, Y0, Y1 = _span()


def region_cells(spark):
    """All cells of the region's box: key, ordinal, first segment id, box."""
    z = F.lit(ZOOM)
    xy = spark.range(X0, X1 + 1).select(F.col("id").alias("tx")).withColumn("ty", F.explode(F.sequence(F.lit(Y0).cast("long"), F.lit(Y1).cast("long"))))
    ordinal = (F.col("tx") - X0) * (Y1 - Y0 + 1) + (F.col("ty") - Y0)
    return xy.select(
        geo.cell_key(z, F.col("tx"), F.col("ty")).alias("cell_key"), "tx", "ty", ordinal.alias("ordinal"), (ordinal * SEGMENTS).alias("id_base"),
        geo.tile_west(F.col("tx"), z).alias("west"), geo.tile_north(F.col("ty") + 1, z).alias("south"), geo.tile_west(F.col("tx") + 1, z).alias("east"), geo.tile_north(F.col("ty"), z).alias("north"),
    )


_CELLS = f"""
    cells_ as (select '{ZOOM}-' || tx || '-' || ty as cell_key, tx, ty, (tx - {X0})*{Y1 - Y0 + 1} + (ty - {Y0}) as ordinal, ((tx - {X0})*{Y1 - Y0 + 1} + (ty - {Y0}))*{SEGMENTS} as id_base, tx/pow(2, {ZOOM})*360 - 180 as west, degrees(atan(sinh(pi()*(1 - 2*(ty + 1)/pow(2, {ZOOM}))))) as south, (tx + 1)/pow(2, {ZOOM})*360 - 180 as east, degrees(atan(sinh(pi()*(1 - 2*ty/pow(2, {ZOOM}))))) as north
      from (select unnest(range({X0}, {X1 + 1})) as tx), (select unnest(range({Y0}, {Y1 + 1})) as ty)),
    ring as (select * from (values {", ".join(f"({k}, {x}E0, {y}E0)" for k, (x, y) in enumerate(REGION))}) v(i, x, y)),
    sides_ as (select a.i, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from ring a join ring b on b.i = a.i + 1)
"""


@query(
    "whole as (select 1)," + _CELLS.replace("cells_ as", "grid as")
    + f""",
    held as (select cast(floor((lon + 180)/360*pow(2, {ZOOM})) as bigint) as tx, cast(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*pow(2, {ZOOM})) as bigint) as ty, count(*) as points from points group by 1, 2),
    cells_ as (select g.*, coalesce(points, 0) as points from grid g left join held using (tx, ty) where g.tx between (select min(tx) from held) and (select max(tx) from held) and g.ty between (select min(ty) from held) and (select max(ty) from held)),
    c as (select cell_key, x, y, row_number() over (partition by cell_key order by o) as o from (select cell_key, west as x, south as y, 1 as o from cells_ union all select cell_key, east, south, 2 from cells_ union all select cell_key, east, north, 3 from cells_ union all select cell_key, west, north, 4 from cells_)),
    e as (select a.cell_key, a.x as cx1, a.y as cy1, b.x as cx2, b.y as cy2 from c a join c b on b.cell_key = a.cell_key and b.o = a.o % 4 + 1),
    vertex as (select distinct cell_key from cells_ join ring on x between west and east and y between south and north),
    corner as (select distinct cell_key from (select cell_key, o, count(*) as n from c join sides_ on (y1 > y) <> (y2 > y) and x < (x2 - x1)*(y - y1)/(y2 - y1) + x1 group by 1, 2) where n % 2 = 1),
    crossing as (select distinct cell_key from e join sides_ on ((cx2 - cx1)*(y1 - cy1) - (cy2 - cy1)*(x1 - cx1))*((cx2 - cx1)*(y2 - cy1) - (cy2 - cy1)*(x2 - cx1)) < 0 and ((x2 - x1)*(cy1 - y1) - (y2 - y1)*(cx1 - x1))*((x2 - x1)*(cy2 - y1) - (y2 - y1)*(cx2 - x1)) < 0)
    select cell_key, ordinal, id_base, points, round(west, 6) as west, round(south, 6) as south, round(east, 6) as east, round(north, 6) as north,
      west <= (select max(x) from ring) and east >= (select min(x) from ring) and south <= (select max(y) from ring) and north >= (select min(y) from ring) as overlaps, cell_key in (from vertex) as vertex_inside, cell_key in (from corner) as corner_inside, cell_key in (from crossing) as crossed,
      cell_key in (from vertex) or cell_key in (from corner) or cell_key in (from crossing) as touches from cells_
    """,
    "points",
)
def g2_g3_f4_f5_f7_f8_cells_of_region(spark, sf_dir):
    """Which cells of the points' box a region touches, and how many points each holds: a vertex of its ring in the cell, a corner of the cell in the ring, or crossing edges."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(*[point(F.lit(x), F.lit(y)) for x, y in REGION])
    c = {k: F.col(k) for k in ("west", "south", "east", "north")}
    corners = F.array(point(c["west"], c["south"]), point(c["east"], c["south"]), point(c["east"], c["north"]), point(c["west"], c["north"]), point(c["west"], c["south"]))
    edges = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    xs, ys = [x for x, _ in REGION], [y for _, y in REGION]
    z, p = F.lit(ZOOM), adapters.points(spark, sf_dir)
    held = p.groupBy(geo.tile_x(F.col("lon"), z).alias("tx"), geo.tile_y(F.col("lat"), z).alias("ty")).agg(F.count("*").alias("points"))
    bounds = F.broadcast(held.agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "tx"), ("x1", F.max, "tx"), ("y0", F.min, "ty"), ("y1", F.max, "ty"))]))  # one row
    within = region_cells(spark).crossJoin(bounds).where("tx between x0 and x1 and ty between y0 and y1").join(held, ["tx", "ty"], "left")
    box = within.withColumn("points", F.coalesce("points", F.lit(0)).cast("long")).withColumns({"ring": ring, "corners": corners})
    told = box.withColumns({
        "overlaps": (c["west"] <= max(xs)) & (c["east"] >= min(xs)) & (c["south"] <= max(ys)) & (c["north"] >= min(ys)), "vertex_inside": F.exists("ring", lambda p: p.x.between(c["west"], c["east"]) & p.y.between(c["south"], c["north"])),
        "corner_inside": F.exists("corners", lambda p: spatial.in_ring(p.x, p.y, F.col("ring"))), "crossed": F.exists(edges(F.col("ring")), lambda e: F.exists(edges(F.col("corners")), lambda k: spatial.edges_cross(e, k))),
    })
    return told.select("cell_key", "ordinal", "id_base", "points", *[r6(v).alias(k) for k, v in c.items()], "overlaps", "vertex_inside", "corner_inside", "crossed", (F.col("vertex_inside") | F.col("corner_inside") | F.col("crossed")).alias("touches"))


@query(
    "c_ as (select 1)," + _CELLS
    + """,
    q as (select a.point_id, a.lon as x1, a.lat as y1, b.lon as x2, b.lat as y2 from points a join points b on a.point_id % 2 = 0 and b.point_id = a.point_id + 1),
    b as (select point_id, least(x1, x2) - greatest(0.01E0, abs(x1 - x2)*0.2E0) as w, greatest(x1, x2) + greatest(0.01E0, abs(x1 - x2)*0.2E0) as e, least(y1, y2) - greatest(0.007E0, abs(y1 - y2)*0.2E0) as s, greatest(y1, y2) + greatest(0.007E0, abs(y1 - y2)*0.2E0) as n from q)
    select point_id, count(*) as cells, count(*) <= 14 as allowed, min(ordinal) as first_cell from b join cells_ on west <= e and east >= w and south <= n and north >= s group by 1
    """,
    "points",
)
def j17_t4_route_corridors(spark, sf_dir):
    """The cells around the straight way of each route, a fifth wider; more than fourteen are too many."""
    p = adapters.points(spark, sf_dir).select("point_id", "lon", "lat")
    ends = p.where("point_id % 2 = 0").join(p.select((F.col("point_id") - 1).alias("point_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "point_id")

    def reach(a, b, least):
        margin = F.greatest(F.lit(least), F.abs(F.col(a) - F.col(b)) * 0.2)
        return F.least(a, b) - margin, F.greatest(a, b) + margin

    (w, e), (s, n) = reach("lon", "lon2", 0.01), reach("lat", "lat2", 0.007)
    boxed = ends.select("point_id", w.alias("w"), e.alias("e"), s.alias("s"), n.alias("n"))
    # The cells of a box are a range of tiles: they are told from its corners, and met by an equi-join.
    z = F.lit(ZOOM)
    x = lambda c: F.greatest(F.lit(X0), F.least(F.lit(X1), geo.tile_x(F.col(c), z)))
    y = lambda c: F.greatest(F.lit(Y0), F.least(F.lit(Y1), geo.tile_y(F.col(c), z)))
    tiles = boxed.withColumn("tx", F.explode(F.sequence(x("w"), x("e")))).withColumn("ty", F.explode(F.sequence(y("n"), y("s"))))
    met = tiles.join(region_cells(spark).select("tx", "ty", "ordinal"), ["tx", "ty"])
    return met.groupBy("point_id").agg(F.count("*").alias("cells"), (F.count("*") <= 14).alias("allowed"), F.min("ordinal").alias("first_cell"))


@query(
    """
    part as (select src % 3 as cell, src, dst, segment_id, length from edges),
    local as (select cell, node_id from part join nodes on node_id in (src, dst) group by 1, 2), num as (select cell, node_id, row_number() over (partition by cell order by node_id) - 1 as local_id from local),
    key as (select cell, local_id, floor(lon*1e6 + 0.5E0) as qx, floor(lat*1e6 + 0.5E0) as qy, cell*1000000 + local_id as seq from num join nodes using (node_id)), g as (select qx, qy, min(seq) as id from key group by 1, 2)
    select p.cell, a.id as a, b.id as b, p.cell*65536 + p.segment_id as segment, round(p.length, 6) as length from part p join num na on na.cell = p.cell and na.node_id = p.src join num nb on nb.cell = p.cell and nb.node_id = p.dst
      join key ka on ka.cell = p.cell and ka.local_id = na.local_id join key kb on kb.cell = p.cell and kb.local_id = nb.local_id join g a on a.qx = ka.qx and a.qy = ka.qy join g b on b.qx = kb.qx and b.qy = kb.qy
    """,
    "nodes", "edges",
)
def j18_u1_stitched_graph(spark, sf_dir):
    """Graphs of several cells, each numbered by itself, as one: nodes at one coordinate are one node, segment ids start at their cell's first."""
    nodes = adapters.nodes(spark, sf_dir)
    part = adapters.edges(spark, sf_dir).withColumn("cell", F.col("src") % 3)
    ends = part.select("cell", F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(nodes, "node_id")
    local = ends.withColumn("local", F.row_number().over(Window.partitionBy("cell").orderBy("node_id")).cast("long") - 1)  # the nodes of one cell
    keyed = local.select("cell", "node_id", half_up(F.col("lon") * 1e6).alias("qx"), half_up(F.col("lat") * 1e6).alias("qy"), (F.col("cell") * 1000000 + F.col("local")).alias("seq"))
    named = keyed.join(keyed.groupBy("qx", "qy").agg(F.min("seq").alias("id")), ["qx", "qy"]).select("cell", "node_id", "id")
    end = lambda c, n: named.select("cell", F.col("node_id").alias(c), F.col("id").alias(n))
    return part.join(end("src", "a"), ["cell", "src"]).join(end("dst", "b"), ["cell", "dst"]).select("cell", "a", "b", (F.col("cell") * SEGMENTS + F.col("segment_id")).alias("segment"), r6(F.col("length")).alias("length"))


@query(
    """
    r as (select site_id, [round(x0, 6), round(x1, 6)] as xs, (x1 - x0)*(y1 - y0) as area, 5 as vertices, floor(x0*1e6 + 0.5E0) as qx, floor(y0*1e6 + 0.5E0) as qy from sites),
    twice as (select * from r union all select * from r where site_id % 3 = 0)
    select min(site_id) as site_id, count(*) as copies, round(any_value(area), 5) as area, cast(qx as bigint) as x, cast(qy as bigint) as y from twice group by qx, qy, vertices
    """,
    "sites",
)
def u3_g16_g17_distinct_buildings(spark, sf_dir):
    """Buildings that several cells have, once: by the first vertex to six digits and the number of vertices; with the area that the ring winds around."""
    s = adapters.sites(spark, sf_dir)
    both = s.unionByName(s.where("site_id % 3 = 0"))
    first = F.col("ring")[0]
    q = lambda c: half_up(c * 1e6)
    keyed = both.select("site_id", q(first.x).alias("qx"), q(first.y).alias("qy"), F.size("ring").alias("n"), spatial.signed_area(F.col("ring")).alias("area"))
    return keyed.groupBy("qx", "qy", "n").agg(F.min("site_id").alias("site_id"), F.count("*").alias("copies"), F.round(F.first("area"), 5).alias("area")).select("site_id", "copies", "area", F.col("qx").alias("x"), F.col("qy").alias("y"))


@query(
    """
    with m as (select o_orderkey % 40 as cell, count(*) as segments, count(*) filter (o_orderstatus = 'F') as done, max(cast(o_orderdate as date)) as newest from orders group by 1)
    select 'cell-' || lpad(cast(cell as varchar), 2, '0') as cell_key, segments, segments*192 as bytes, case when segments*192 >= 1e6 then cast(floor(segments*192/1e6 + 0.5E0) as bigint) || ' Mo' else cast(floor(segments*192/1e3 + 0.5E0) as bigint) || ' ko' end as size, done = segments as complete, newest,
      cast(sum(segments) over () as bigint) as region_segments, 'tiles/' || cell || '/' || (cell*7 % 11) || '.bin' as url from m
    """
)
def snk4_a29_g15_region_index(spark, sf_dir):
    """The index of a region: a line for each cell, the totals of all, and what a copy to take along would weigh."""
    from ..functions import words

    m = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 40).alias("cell")).agg(F.count("*").alias("segments"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max(F.to_date("o_orderdate")).alias("newest"))
    bytes_ = F.col("segments") * 192
    url = F.replace(F.replace(F.lit("tiles/{x}/{y}.bin"), F.lit("{x}"), F.col("cell").cast("string")), F.lit("{y}"), (F.col("cell") * 7 % 11).cast("string"))
    total = F.sum("segments").over(Window.partitionBy())  # a row for each cell of the region
    return m.select(F.format_string("cell-%02d", "cell").alias("cell_key"), "segments", bytes_.alias("bytes"), words.bytes_text(bytes_).alias("size"), (F.col("done") == F.col("segments")).alias("complete"), "newest", total.alias("region_segments"), url.alias("url"))


@query("select site_id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || printf('%.5f', x) || ',' || printf('%.5f', y) || ']},\"properties\":{\"id\":' || site_id || '}}' as feature from (select site_id, (x0 + x1)/2 as x, (y0 + y1)/2 as y from sites)", "sites")
def snk3_geojson_features(spark, sf_dir):
    """A line of GeoJSON for each site, coordinates to five digits."""
    ring = F.col("ring")
    mid = lambda f: (F.array_min(F.transform(ring, lambda p: p[f])) + F.array_max(F.transform(ring, lambda p: p[f]))) / 2
    text = F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%.5f,%.5f]},"properties":{"id":%d}}', mid("x"), mid("y"), F.col("site_id"))
    return adapters.sites(spark, sf_dir).select("site_id", text.alias("feature"))


#: A window over the region: west, south, east, north.
WINDOW = (2.3495, 48.8542, 2.3568, 48.8581)


@query(
    "whole as (select 1)," + _CELLS
    + f""",
    held as (select {ZOOM} || '-' || cast(floor((lon + 180)/360*pow(2, {ZOOM})) as bigint) || '-' || cast(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*pow(2, {ZOOM})) as bigint) as cell_key, count(*) as n, sum(cast(round(svf*1000) as bigint)) as svf, max(point_id) as last from points group by 1),
    w as (select *, west <= {WINDOW[2]}E0 and east >= {WINDOW[0]}E0 and south <= {WINDOW[3]}E0 and north >= {WINDOW[1]}E0 as wanted from cells_)
    select w.cell_key, coalesce(n, 0) as declared, wanted, false as failed, case when wanted then n end as read, case when wanted then cast(svf as bigint) end as svf, case when wanted and n is not null then ordinal*{1 << 32} + last end as last_id from w left join held using (cell_key)
    """,
    "points",
)
def src17_src19_cells_on_demand(spark, sf_dir):
    """The points written by cell with an index beside them; a window is opened, for which only its cells are read. A row for each cell of the index."""
    z, bits = F.lit(ZOOM), 32
    base = shared_folder(spark, "regions/points")
    cells = region_cells(spark).withColumn("id_base", F.shiftleft("ordinal", bits))
    points = adapters.points(spark, sf_dir).withColumn("cell_key", geo.cell_key(z, geo.tile_x(F.col("lon"), z), geo.tile_y(F.col("lat"), z)))
    write_region(points.select(F.col("point_id").alias("local"), "svf", "cell_key"), cells, base, "2024-01-10")
    region = Region(spark, base, "local long, svf double", bits)
    wanted = region.cells_in(*WINDOW)
    rows, failed = region.read(wanted)
    seen = rows.groupBy("cell_key").agg(F.count("*").alias("read"), F.sum(F.round(F.col("svf") * 1000).cast("long")).alias("svf"), F.max("id").alias("last_id"))
    told = region.index().join(wanted.select("cell_key", F.lit(True).alias("w")), "cell_key", "left").join(failed.select("cell_key", F.lit(True).alias("f")), "cell_key", "left").join(seen, "cell_key", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return told.select("cell_key", F.col("rows").alias("declared"), flag("w").alias("wanted"), flag("f").alias("failed"), "read", "svf", "last_id")
