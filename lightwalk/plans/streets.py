"""Streets from tagged lines, and what registers of trees, lamps, worksites and the like say, made uniform."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags, words
from ..functions.geo import flat_distance
from ..functions.num import half_up
from ..operators import series, spatial
from ..sources import adapters
from ..sources.adapters import WAYS, table
from .registry import query, r6

_WALKABLE = "not (coalesce(foot = 'no', false) or coalesce(access in ('private', 'no'), false) or coalesce(highway = 'service' and service = 'parking_aisle', false) or (coalesce(tunnel = 'yes', false) and highway not in ('footway', 'path', 'pedestrian', 'steps')))"
_OFFSET = "case when highway in ('footway', 'steps', 'pedestrian', 'cycleway', 'track', 'service') then 0E0 when try_cast(regexp_extract(width, '^\\s*(\\d+\\.?\\d*)', 1) as double) > 2 and try_cast(regexp_extract(width, '^\\s*(\\d+\\.?\\d*)', 1) as double) < 60 then least(14, try_cast(regexp_extract(width, '^\\s*(\\d+\\.?\\d*)', 1) as double)/2) else case highway when 'primary' then 9E0 when 'tertiary' then 6.5E0 when 'living_street' then 4E0 else 5E0 end end"


@query(
    f"""
    t as (select *, coalesce(footway = 'crossing', false) or crossing is not null as crosses from ways)
    select way_id, {_WALKABLE} as walkable, case when coalesce(tunnel in ('yes', 'covered', 'passage'), false) or coalesce(indoor = 'yes', false) then 2 when coalesce(tunnel = 'building_passage', false) or coalesce(covered <> 'no', false) then 1 else 0 end as cover,
      crosses as crossing, {_OFFSET} as sidewalk_offset, highway in ('primary', 'tertiary', 'pedestrian') as overview,
      case when crosses then 'traversée piétonne' else case highway when 'footway' then 'trottoir / cheminement' when 'pedestrian' then 'voie piétonne' when 'steps' then 'escalier' when 'living_street' then 'zone de rencontre' when 'residential' then 'rue' when 'service' then 'voie de desserte' when 'cycleway' then 'piste cyclable' when 'tertiary' then 'rue' when 'primary' then 'grand axe' else 'voie' end end as label,
      case sidewalk when 'left' then false when 'right' then true when 'separate' then true when 'both' then false end as absent_left, case sidewalk when 'left' then true when 'right' then false when 'separate' then true when 'both' then false end as absent_right
    from t
    """,
    "ways",
)
def f1_f2_f3_f11_g9_m40_tags(spark, sf_dir):
    w = adapters.ways(spark, sf_dir)
    absent = tags.declared_absent()
    return w.select(
        "way_id", tags.walkable().alias("walkable"), tags.cover_kind().alias("cover"), tags.is_crossing().alias("crossing"), tags.nominal_offset().alias("sidewalk_offset"),
        tags.has("highway", *tags.OVERVIEW).alias("overview"), tags.highway_label(tags.is_crossing()).alias("label"), absent.left.alias("absent_left"), absent.right.alias("absent_right"),
    )


def hops(ways):
    """Steps of lines: (way_id, seq, x1, y1, x2, y2)."""
    return ways.select("way_id", F.posexplode(F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))).alias("seq", "h")).select(
        "way_id", (F.col("seq") + 1).alias("seq"), F.col("h.a.x").alias("x1"), F.col("h.a.y").alias("y1"), F.col("h.b.x").alias("x2"), F.col("h.b.y").alias("y2")
    )


def steps_of_pieces(ways):
    """``hops`` with their length and the number of the piece of 30 metres or a little more that they belong to."""
    h = hops(ways).withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    lines = h.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2", "len"))).alias("s"))  # the steps of one line
    return lines.select("way_id", F.inline(F.arrays_zip("s", series.cut_lengths(F.col("s.len"), 30.0).alias("piece")))).select("way_id", "s.*", F.col("piece").cast("long").alias("piece"))


@query(
    f"""
    w as (select way_id from ways where {_WALKABLE}), l as (select way_id, list(len order by i) as lens from hops semi join w using (way_id) group by 1),
    f(way_id, lens, i, total, piece) as (select way_id, lens, 1, case when lens[1] >= 30 then 0 else lens[1] end, cast(0 as bigint) from l
      union all select way_id, lens, i + 1, case when total + lens[i + 1] >= 30 then 0 else total + lens[i + 1] end, piece + cast(total = 0 as int) from f where i < 3),
    s as (select h.*, piece from hops h join f on f.way_id = h.way_id and f.i = h.i),
    p as (select way_id, piece, sum(len) as metres, count(*) as steps, max(cast(x1 between 200 and 900 and y1 between 100 and 600 or x2 between 200 and 900 and y2 between 100 and 600 as int)) = 1 as inside from s group by 1, 2)
    select way_id, piece, round(metres, 6) as metres, steps, inside from p where metres >= 0.1
    """,
    *WAYS,
)
def w1_f4_f9_pieces_of_30_metres(spark, sf_dir):
    """Walkable lines cut into pieces of 30 metres or a little more, without slivers; a piece is inside a box if a vertex is."""
    cut = steps_of_pieces(adapters.ways(spark, sf_dir).where(tags.walkable()))
    box = lambda x, y: F.col(x).between(200, 900) & F.col(y).between(100, 600)
    pieces = cut.groupBy("way_id", "piece").agg(F.sum("len").alias("metres"), F.count("*").alias("steps"), F.max(box("x1", "y1") | box("x2", "y2")).alias("inside"))
    return pieces.where("metres >= 0.1").select("way_id", "piece", r6(F.col("metres")).alias("metres"), "steps", "inside")


@query(
    f"""
    o as (select way_id, {_OFFSET} as d from ways)
    select way_id, k, side, round(x - dy*d*side, 6) as x, round(y + dx*d*side, 6) as y, round(degrees(atan2(dx, dy)), 4) as heading from dots join o using (way_id), (values (1), (-1)) s(side)
    """,
    *WAYS,
)
def w2_ra13_points_on_both_sides(spark, sf_dir):
    """A point every four metres on each side of the axis, at the nominal offset of the class."""
    ways = adapters.ways(spark, sf_dir)
    dots = series.resampled(hops(ways), "way_id", 4.0).join(ways.select("way_id", tags.nominal_offset().alias("d")), "way_id").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    shift = F.col("d") * F.col("side")
    return dots.select("way_id", "k", "side", r6(F.col("x") - F.col("dy") * shift).alias("x"), r6(F.col("y") + F.col("dx") * shift).alias("y"), F.round(F.degrees(F.atan2("dx", "dy")), 4).alias("heading"))


@query(
    f"""
    k as (select round(sum(sqrt(pow((x2 - x1)/{adapters.PLANE.lon_m!r}E0*111320*cos(radians(48.853E0 + (y1 + y2)/2/{adapters.PLANE.lat_m!r}E0)), 2) + pow((y2 - y1)/{adapters.PLANE.lat_m!r}E0*111132, 2)))/1000, 6) as kilometres from hops join (select way_id from ways where {_WALKABLE}) using (way_id))
    select kilometres, cast((select count(*) from lamps) as bigint) as lamps, (select count(*) from lamps)/kilometres >= 40 as mapped from k
    """,
    *WAYS, "lamps",
)
def f12_f19_lighting_is_mapped(spark, sf_dir):
    """Whether there are so many lamps to a walkable kilometre that their register can be trusted."""
    h = hops(adapters.ways(spark, sf_dir).where(tags.walkable()))
    degree = lambda x, y: (F.col(x) / adapters.PLANE.lon_m + adapters.AREA[0], F.col(y) / adapters.PLANE.lat_m + adapters.AREA[1])
    metres = flat_distance(*degree("x1", "y1"), *degree("x2", "y2"))
    length = h.agg(F.round(F.sum(metres) / 1000, 6).alias("kilometres"))
    lamps = adapters.lamps(spark, sf_dir).agg(F.count("*").alias("lamps"))
    return length.crossJoin(lamps).select("kilometres", "lamps", (F.coalesce(F.col("kilometres") > 0, F.lit(False)) & (F.col("lamps") / F.col("kilometres") >= 40)).alias("mapped"))


NEAR, PARALLEL, SHARE = 14.0, 35.0, 0.5  # metres, degrees; the share of samples is our own choice


def _is_sidewalk():
    return tags.has("highway", "footway") & tags.has("footway", "sidewalk")


def _axes_and_sidewalks(ways):
    dots = series.resampled(hops(ways), "way_id", 4.0)
    kinds = ways.select("way_id", "name", _is_sidewalk().alias("is_sidewalk"), (tags.nominal_offset() > 0).alias("is_axis"))
    return dots.join(kinds.where("is_axis"), "way_id"), dots.join(kinds.where("is_sidewalk"), "way_id")


def _covered(axis, walk, by):
    """For each group ``by`` of samples of axes (k, x, y, dx, dy): whether mapped sidewalks run along it on the left and on the right."""
    others = walk.select("x", "y", F.col("dx").alias("odx"), F.col("dy").alias("ody"))
    asked = axis.select(*by, "k", "x", "y", "dx", "dy", F.explode(F.array(F.lit(True), F.lit(False))).alias("on_left"))
    turn = lambda o: F.col("dx") * (o["oy"] - F.col("y")) - F.col("dy") * (o["ox"] - F.col("x"))
    near = spatial.nearest_within(asked, others, [*by, "k", "on_left"], NEAR, lambda o: _parallel(o) & ((turn(o) > 0) == F.col("on_left")))
    met = near.groupBy(*by).agg(F.sum(F.col("on_left").cast("int")).alias("l"), F.sum((~F.col("on_left")).cast("int")).alias("r"))
    size = axis.groupBy(*by).agg(F.count("*").alias("n"))
    return size.join(met, by, "left").select(*by, *[(F.coalesce(c, F.lit(0)) >= F.col("n") * SHARE).alias(name) for c, name in (("l", "left"), ("r", "right"))])


def _parallel(other):
    import math

    return F.abs(F.col("dx") * other["odx"] + F.col("dy") * other["ody"]) >= math.cos(math.radians(PARALLEL))


_MATCH = f"""
    axis as (select d.*, name from dots d join ways using (way_id) where {_OFFSET} > 0), walk as (select d.* from dots d join ways using (way_id) where highway = 'footway' and footway = 'sidewalk'),
    near as (select a.way_id, a.k, a.name, w.way_id as walk_id, w.k as walk_k, case when a.dx*(w.y - a.y) - a.dy*(w.x - a.x) > 0 then 1 else -1 end as side, sqrt((w.x - a.x)*(w.x - a.x) + (w.y - a.y)*(w.y - a.y)) as d
      from axis a join walk w on w.x between a.x - 14 and a.x + 14 and w.y between a.y - 14 and a.y + 14 and abs(a.dx*w.dx + a.dy*w.dy) >= cos(radians(35)) where (w.x - a.x)*(w.x - a.x) + (w.y - a.y)*(w.y - a.y) <= 196),
"""


@query(
    _MATCH
    + """
    n as (select way_id, count(*) as n from axis group by 1),
    c as (select way_id, count(distinct case side when 1 then k end) as l, count(distinct case side when -1 then k end) as r from near group by 1),
    e as (select way_id, coalesce(l, 0) >= n*0.5E0 as l, coalesce(r, 0) >= n*0.5E0 as r from n left join c using (way_id)),
    t as (select e.*, sidewalk is not null as declared, case when sidewalk in ('right', 'separate') then true when sidewalk is not null then false end as dl, case when sidewalk in ('left', 'separate') then true when sidewalk is not null then false end as dr from e join ways using (way_id))
    select l as "left", r as "right", count(*) as ways, count(*) filter (declared) as declared, count(*) filter (declared and dl = l and dr = r) as agree from t group by 1, 2
    """,
    *WAYS,
)
def j4_a30_sidewalk_coverage(spark, sf_dir):
    """Which streets have sidewalks mapped as lines of their own, by side: a sample of the axis meets parallel samples close by; against what their tags declare."""
    ways = adapters.ways(spark, sf_dir)
    covered = _covered(*_axes_and_sidewalks(ways), ["way_id"])
    told = covered.join(ways.select("way_id", tags.declared_absent().alias("told")), "way_id")
    declared = F.col("told").isNotNull()
    agree = declared & (F.col("told.left") == F.col("left")) & (F.col("told.right") == F.col("right"))
    return told.groupBy("left", "right").agg(F.count("*").alias("ways"), F.count_if(declared).alias("declared"), F.count_if(agree).alias("agree"))


@query(
    _MATCH
    + """
    best as (select walk_id, walk_k, name from (select *, row_number() over (partition by walk_id, walk_k order by d, way_id, k) as r from near where name is not null) where r = 1),
    votes as (select walk_id, name, count(*) as n from best group by 1, 2), all_ as (select walk_id, count(*) as total from best group by 1),
    r as (select *, row_number() over (partition by walk_id order by n desc, name) as r from votes)
    select walk_id as way_id, name, round(n/cast(total as double), 6) as share from r join all_ using (walk_id) where r = 1
    """,
    *WAYS,
)
def j5_parent_street(spark, sf_dir):
    """The name of the street that a sidewalk runs along: each sample votes for the nearest parallel axis with a name."""
    return parent_streets(adapters.ways(spark, sf_dir))


def parent_streets(ways):
    """(way_id, name, share) of mapped sidewalks."""
    axis, walk = _axes_and_sidewalks(ways)
    named = axis.where("name is not null").select("x", "y", F.col("way_id").alias("axis_id"), F.col("k").alias("axis_k"), "name", F.col("dx").alias("odx"), F.col("dy").alias("ody"))
    near = spatial.nearest_within(walk.select("way_id", "k", "x", "y", "dx", "dy"), named, ["way_id", "k"], NEAR, _parallel, copied="points")
    votes = near.groupBy("way_id", "name").agg(F.count("*").alias("n"))
    won = votes.groupBy("way_id").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return won.select("way_id", "name", r6(F.col("n") / F.col("total")).alias("share"))


_CARDINAL = "['nord', 'nord-est', 'est', 'sud-est', 'sud', 'sud-ouest', 'ouest', 'nord-ouest'][1 + cast(floor(((degrees(atan2({e}, {n})) + 360) % 360)/45 + 0.5E0) as int) % 8]"


@query(
    _MATCH
    + f"""
    best as (select walk_id, walk_k, name from (select *, row_number() over (partition by walk_id, walk_k order by d, way_id, k) as r from near where name is not null) where r = 1),
    votes as (select walk_id, name, count(*) as n from best group by 1, 2), parent as (select walk_id, name from (select *, row_number() over (partition by walk_id order by n desc, name) as r from votes) where r = 1),
    w as (select *, {_OFFSET} as off, case when sidewalk in ('right', 'separate') then true when sidewalk is not null then false end as dl, case when sidewalk in ('left', 'separate') then true when sidewalk is not null then false end as dr from ways where {_WALKABLE}),
    l as (select way_id, list(len order by i) as lens from hops semi join w using (way_id) group by 1),
    f(way_id, lens, i, total, piece) as (select way_id, lens, 1, case when lens[1] >= 30 then 0 else lens[1] end, cast(0 as bigint) from l
      union all select way_id, lens, i + 1, case when total + lens[i + 1] >= 30 then 0 else total + lens[i + 1] end, piece + cast(total = 0 as int) from f where i < 3),
    s as (select h.*, piece, sum(len) over o as upto from hops h join f on f.way_id = h.way_id and f.i = h.i window o as (partition by h.way_id, piece order by h.i rows unbounded preceding)),
    g as (select *, coalesce(lag(upto) over (partition by way_id, piece order by i), 0) as start from s),
    d as (select way_id, piece, k, x1 + (x2 - x1)*(2 + 4*k - start)/len as x, y1 + (y2 - y1)*(2 + 4*k - start)/len as y, (x2 - x1)/len as dx, (y2 - y1)/len as dy from (select *, unnest(range(cast(greatest(0, floor((start - 2)/4) + 1) as bigint), cast(floor((upto - 2)/4) as bigint) + 1)) as k from g)),
    m as (select a.way_id, a.piece, count(distinct case when a.dx*(v.y - a.y) - a.dy*(v.x - a.x) > 0 then a.k end) as l, count(distinct case when a.dx*(v.y - a.y) - a.dy*(v.x - a.x) <= 0 then a.k end) as r
      from d a join w using (way_id) join walk v on off > 0 and v.x between a.x - 14 and a.x + 14 and v.y between a.y - 14 and a.y + 14 and abs(a.dx*v.dx + a.dy*v.dy) >= cos(radians(35)) where (v.x - a.x)*(v.x - a.x) + (v.y - a.y)*(v.y - a.y) <= 196 group by 1, 2),
    n as (select way_id, piece, count(*) as n, round(sum(dx), 6) as east, round(sum(dy), 6) as north from d group by 1, 2),
    p as (select way_id, piece, sum(len) as metres from s group by 1, 2),
    c as (select p.*, n.n, east, north, off, highway, tunnel, covered, indoor, footway, crossing, case when highway = 'footway' and footway = 'sidewalk' then coalesce(w.name, parent.name) else w.name end as name,
        off > 0 and (coalesce(l, 0) >= n.n*0.5E0 or coalesce(dl, false)) as cl, off > 0 and (coalesce(r, 0) >= n.n*0.5E0 or coalesce(dr, false)) as cr
      from p join n using (way_id, piece) join w using (way_id) left join m using (way_id, piece) left join parent on parent.walk_id = way_id where metres >= 0.1)
    select way_id, piece, name, highway, case when coalesce(tunnel in ('yes', 'covered', 'passage'), false) or coalesce(indoor = 'yes', false) then 2 when coalesce(tunnel = 'building_passage', false) or coalesce(covered <> 'no', false) then 1 else 0 end as cover,
      coalesce(footway = 'crossing', false) or crossing is not null as crossing, round(metres, 6) as metres, n as samples, off = 0 or cl or cr as shared, cl or cr as halved,
      case when not cl then {_CARDINAL.format(e="-north", n="east")} end as left_side, case when cl or (off > 0 and not cr) then {_CARDINAL.format(e="north", n="-east")} end as right_side
    from c where not (cl and cr)
    """,
    *WAYS,
)
def ra14_segments(spark, sf_dir):
    """Every piece of every walkable way as a segment with its sidewalks."""
    return segments(adapters.ways(spark, sf_dir)).withColumn("metres", r6(F.col("metres")))


def segments(ways):
    """Walkable ways cut into pieces, each with the sidewalks that it stands for: way_id, piece, name, highway, cover, crossing, metres, samples, shared, halved, left_side, right_side.

    Where sidewalks are mapped along a piece of an axis, or declared to be, that side is theirs: a piece whose both sides are
    goes, one with one of them keeps the other (halved). Ways without a roadway have one side only, which both share: it
    stands as the left one. A mapped sidewalk without a name takes its street's. Sides are named by the sky that they face.
    """
    own = ways.where(tags.walkable())
    steps = steps_of_pieces(own).withColumn("at", F.struct("way_id", "piece"))
    samples = series.resampled(steps, "at", 4.0).select("at.*", "k", "x", "y", "dx", "dy")
    _, walk = _axes_and_sidewalks(ways)
    axis = tags.nominal_offset() > 0
    by = ["way_id", "piece"]
    met = _covered(samples.join(own.where(axis).select("way_id"), "way_id"), walk, by).withColumnsRenamed({"left": "met_left", "right": "met_right"})
    parents = parent_streets(ways).select("way_id", F.col("name").alias("parent"))
    told = own.select("way_id", "highway", F.when(_is_sidewalk(), 1).alias("sidewalk_"), "name", tags.cover_kind().alias("cover"), tags.is_crossing().alias("crossing"), axis.alias("axis"), tags.declared_absent().alias("told"))
    sizes = samples.groupBy(*by).agg(F.count("*").alias("samples"), F.round(F.sum("dx"), 6).alias("east"), F.round(F.sum("dy"), 6).alias("north"))
    pieces = steps.groupBy(*by).agg(F.sum("len").alias("metres")).where("metres >= 0.1")
    whole = pieces.join(sizes, by).join(told, "way_id").join(met, by, "left").join(parents, "way_id", "left")
    taken = lambda side: F.col("axis") & (F.coalesce(f"met_{side}", F.lit(False)) | F.coalesce(F.col(f"told.{side}"), F.lit(False)))
    kept = whole.withColumns({"cl": taken("left"), "cr": taken("right")}).where("not (cl and cr)")
    facing_left, facing_right = words.cardinal(-F.col("north"), F.col("east")), words.cardinal(F.col("north"), -F.col("east"))
    return kept.select(
        *by, F.when(F.col("sidewalk_") == 1, F.coalesce("name", "parent")).otherwise(F.col("name")).alias("name"), "highway", "cover", "crossing", "metres", "samples", (~F.col("axis") | F.col("cl") | F.col("cr")).alias("shared"),
        (F.col("cl") | F.col("cr")).alias("halved"), F.when(~F.col("cl"), facing_left).alias("left_side"), F.when(F.col("cl") | (F.col("axis") & ~F.col("cr")), facing_right).alias("right_side"),
    )


@query(
    """
    v as (select e.*, row_number() over (order by src, dst) as e from edges e),
    p as (select e, 0 as i, n.lon, n.lat from v join nodes n on n.node_id = v.src union all select e, 1, n.lon, n.lat from v join nodes n on n.node_id = v.dst),
    q as (select e, i, floor(lon*1e6 + 0.5E0) as qx, floor(lat*1e6 + 0.5E0) as qy from p), f as (select qx, qy, min(2*e + i) as first from q group by 1, 2), ids as (select qx, qy, cast(row_number() over (order by first) - 1 as bigint) as id from f)
    select a.id as a, b.id as b, v.segment_id, round(v.length, 6) as length from v join q qa on qa.e = v.e and qa.i = 0 join q qb on qb.e = v.e and qb.i = 1 join ids a on a.qx = qa.qx and a.qy = qa.qy join ids b on b.qx = qb.qx and b.qy = qb.qy where a.id <> b.id
    """,
    "nodes", "edges",
)
def a7_j6_street_graph(spark, sf_dir):
    """Nodes where vertices share a coordinate of six digits, numbered by first appearance; edges between them, self-loops gone."""
    nodes = adapters.nodes(spark, sf_dir)
    e = series.numbered(adapters.edges(spark, sf_dir), ["src", "dst"], "e")
    end = lambda c: e.join(nodes.withColumnRenamed("node_id", c), c).select("e", half_up(F.col("lon") * 1e6).alias("qx"), half_up(F.col("lat") * 1e6).alias("qy"))
    a, b = end("src"), end("dst")
    seen = a.withColumn("at", F.col("e") * 2).unionByName(b.withColumn("at", F.col("e") * 2 + 1)).groupBy("qx", "qy").agg(F.min("at").alias("first"))
    ids = series.numbered(seen, ["first"], "id").select("qx", "qy", "id")
    named = lambda side, name: side.join(ids, ["qx", "qy"]).select("e", F.col("id").alias(name))
    return e.join(named(a, "a"), "e").join(named(b, "b"), "e").where("a != b").select("a", "b", "segment_id", r6(F.col("length")).alias("length"))


# --- registers made uniform ------------------------------------------------------------------------------------------


@query("select tree_id, round(radius, 6) as radius, round(top, 6) as top, round(base, 6) as base, evergreen from crowns", "trees", "crowns")
def src4_g12_tree_crowns(spark, sf_dir):
    return adapters.crowns(adapters.trees(spark, sf_dir)).select("tree_id", *[r6(F.col(c)).alias(c) for c in ("radius", "top", "base")], "evergreen")


@query(
    """
    with r as (select s_suppkey as k, case s_suppkey % 5 when 0 then null when 1 then 'abc' when 2 then '-4' else cast((s_suppkey*997) % 90000 as varchar) end as flux, case when s_suppkey % 3 = 0 then cast(s_suppkey % 900 as varchar) end as power,
      case when s_suppkey % 4 <> 0 then cast(s_suppkey % 45 as varchar) end as height, ['Candélabre', 'Console', 'Borne ', 'Totem'][1 + s_suppkey % 4] as kind, ['Sodium haute pression', 'Sodium basse pression', 'Iodures métalliques', 'Diode', 'Fluorescent', null][1 + s_suppkey % 6] as family,
      case when s_suppkey % 7 = 0 then cast((s_suppkey*313) % 9000 as varchar) end as cct from supplier),
    n as (select *, case when try_cast(flux as double) > 0 then try_cast(flux as double) end as f, case when try_cast(power as double) > 0 then try_cast(power as double) end as p, try_cast(height as double) as h, try_cast(cct as double) as c, lower(coalesce(family, '')) as fam from r),
    l as (select k as lamp_id, coalesce(least(f, 60000), least(p*95, 60000), 0E0) as flux, case when h >= 0.1 and h <= 30 then h else case trim(kind) when 'Candélabre' then 6E0 when 'Console' then 5E0 when 'Borne' then 0.9E0 else 5E0 end end as height,
      case when c >= 1500 and c <= 8000 then c when fam like '%sodium basse%' then 1800E0 when fam like '%sodium%' then 2000E0 when fam like '%iodure%' then 3000E0 when fam like '%fluorescent%' then 4000E0 when fam like '%diode%' then 3000E0 else 2800E0 end as cct from n)
    select * from l where flux > 0
    """
)
def src6_g14_lamps(spark, sf_dir):
    """A register whose fields are all text: flux, else from power; plausible heights, else by mount; colour, else by technology."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    r = table(spark, sf_dir, "supplier").select(
        k.alias("lamp_id"), F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "abc").when(k % 5 == 2, "-4").otherwise(text(k * 997 % 90000)).alias("flux"), F.when(k % 3 == 0, text(k % 900)).alias("power"),
        F.when(k % 4 != 0, text(k % 45)).alias("height"), adapters.chosen(k, ["Candélabre", "Console", "Borne ", "Totem"]).alias("kind"),
        adapters.chosen(k, ["Sodium haute pression", "Sodium basse pression", "Iodures métalliques", "Diode", "Fluorescent", None]).alias("family"), F.when(k % 7 == 0, text(k * 313 % 9000)).alias("cct"),
    )
    c = F.col
    made = r.select("lamp_id", tags.luminous_flux(c("flux"), c("power")).alias("flux"), tags.mounting_height(c("height"), c("kind")).alias("height"), tags.colour_temperature(c("cct"), c("family")).alias("cct"))
    return made.where("flux > 0")


@query(
    """
    with t as (select c_custkey as id, case when c_custkey % 9 = 0 then 'way' else 'node' end as type, case when c_custkey % 2 = 0 then 'street_lamp' else 'stop' end as highway, case when c_custkey % 3 = 0 then cast(c_custkey % 200 as varchar) end as power,
      case when c_custkey % 8 = 0 then 'x' when c_custkey % 8 = 4 then '7.5' end as height, ['wall_mounted', 'bollard', 'CEILING', 'suspended', 'pole', null][1 + c_custkey % 6] as support from customer)
    select id as lamp_id, coalesce(case when try_cast(power as double) > 0 then try_cast(power as double)*95 end, 4348E0) as flux, coalesce(case when try_cast(height as double) > 0 then try_cast(height as double) end, case when support like 'wall%' then 5E0 when support = 'bollard' then 0.9E0 when support = 'CEILING' then 4E0 when support = 'suspended' then 5.5E0 else 6E0 end) as height, 2800E0 as cct
    from t where type = 'node' and highway = 'street_lamp'
    """
)
def src7_g14_mapped_lamps(spark, sf_dir):
    """Lamps of a map, which mostly lack attributes: tags are a map, defaults are medians."""
    k = F.col("c_custkey")
    made = F.map_filter(
        F.create_map(
            F.lit("highway"), F.when(k % 2 == 0, "street_lamp").otherwise("stop"), F.lit("lamp_power"), F.when(k % 3 == 0, (k % 200).cast("string")),
            F.lit("height"), F.when(k % 8 == 0, "x").when(k % 8 == 4, "7.5"), F.lit("support"), adapters.chosen(k, ["wall_mounted", "bollard", "CEILING", "suspended", "pole", None]),
        ), lambda _, v: v.isNotNull(),
    )
    nodes = table(spark, sf_dir, "customer").select(k.alias("lamp_id"), F.when(k % 9 == 0, "way").otherwise("node").alias("type"), made.alias("tags"))
    t = lambda key: F.try_element_at("tags", F.lit(key))
    lamps = nodes.where((F.col("type") == "node") & (t("highway") == "street_lamp"))
    mount = adapters.looked_up(tags.mount_of(F.coalesce(t("support"), t("lamp_mount"))), tags.MOUNT_HEIGHT, 5.0)
    flux = F.coalesce(tags.positive(t("lamp_flux")), tags.positive(t("lamp_power")) * 95, F.lit(4348.0))
    return lamps.select("lamp_id", flux.alias("flux"), F.coalesce(tags.positive(t("height")), mount).alias("height"), F.coalesce(tags.positive(t("lamp_colour_temperature")), F.lit(2800.0)).alias("cct"))


@query(
    """
    select p_partkey as site_id, cast(r as int) as ring, cast(case when p_partkey % 6 = 0 then 3 else 5 end as int) as points from part, (values (0), (1)) v(r)
    where (r = 0 or p_partkey % 5 = 0) and cast(p_partkey % 200 as int) <= 120 and cast(p_partkey % 200 + p_partkey % 60 as int) >= 120 and p_partkey % 3 <> 1 and p_partkey % 6 <> 0
    """
)
def src8_worksites_of_a_day(spark, sf_dir):
    """Worksites open on a day that bite into a sidewalk; the outer rings of their shapes, of four points at least."""
    k, start = F.col("p_partkey"), F.lit("2024-01-01").cast("date")
    point = lambda i: F.struct(F.lit(float(i)).alias("x"), F.lit(float(i * i)).alias("y"))
    ring = F.when(k % 6 == 0, F.array(*map(point, range(3)))).otherwise(F.array(*map(point, range(5))))
    polygon = F.array(ring, F.array(*map(point, range(4))))  # an outer ring and a hole
    sites = table(spark, sf_dir, "part").select(
        k.alias("site_id"), F.date_add(start, (k % 200).cast("int")).alias("begins"), F.date_add(start, (k % 200 + k % 60).cast("int")).alias("ends"),
        F.when(k % 3 == 1, F.array(F.lit("EMPRISE_CHAUSSEE"))).otherwise(F.array(F.lit("EMPRISE_CHAUSSEE"), F.lit("EMPRISE_TROTTOIR"))).alias("where_"), F.when(k % 5 == 0, F.array(polygon, polygon)).otherwise(F.array(polygon)).alias("polygons"),
    )
    day = F.date_add(start, 120)
    open_ = sites.where((F.col("begins") <= day) & (F.col("ends") >= day) & F.array_contains("where_", "EMPRISE_TROTTOIR"))
    outer = open_.select("site_id", F.posexplode(F.transform("polygons", lambda p: p[0])).alias("ring", "points"))
    return outer.where(F.size("points") >= 4).select("site_id", "ring", F.size("points").alias("points"))


@query("select distinct nature, top as height, case nature when 'Forêt fermée de conifères' then 0.3E0 when 'Forêt fermée mixte' then (0.3E0 + 0.265E0)/2 else 0.265E0 end as in_leaf, case nature when 'Forêt fermée de conifères' then 0.3E0 when 'Forêt fermée mixte' then (0.3E0 + 0.075E0)/2 else 0.075E0 end as bare, lasting is not null as evergreen from zones", "parks", "zones")
def g13_vegetation(spark, sf_dir):
    n = F.col("nature")
    natures = adapters.parks(spark, sf_dir).select("nature").distinct()
    return natures.select("nature", adapters.canopy_height(n).alias("height"), adapters.canopy_extinction(n, True).alias("in_leaf"), adapters.canopy_extinction(n, False).alias("bare"), n.isin("Forêt fermée de conifères", "Forêt fermée mixte").alias("evergreen"))


@query(
    """
    with c as (select p_partkey as k, case when p_partkey % 3 = 0 then p_retailprice/3 end as mean, case when p_partkey % 4 = 0 then cast(p_size as double) end as median, case when p_partkey % 5 = 0 then cast(p_size as double)/20 end as most, case when p_partkey % 7 = 0 then cast(p_size + 2 as double) end as other from part)
    select k as building_id, round(case when mean > 1 and mean < 400 then mean when median > 1 and median < 400 then median when most > 1 and most < 400 then most when other > 1 and other < 400 then other else 15 end, 6) as height,
      case when k % 2 = 0 then 'city' else 'region' end as source from c where not (k % 2 = 1 and k % 9 = 0)
    """
)
def src1_src2_src3_g11_buildings(spark, sf_dir):
    """Two registers of buildings with different fields, one chosen for each building; light constructions of the second are left out."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    fields = [F.when(k % 3 == 0, F.col("p_retailprice") / 3), F.when(k % 4 == 0, size), F.when(k % 5 == 0, size / 20), F.when(k % 7 == 0, size + 2)]
    rows = table(spark, sf_dir, "part").select(k.alias("building_id"), r6(tags.building_height(fields)).alias("height"), F.when(k % 9 == 0, True).alias("light"))
    registers = {"city": rows.where("building_id % 2 = 0"), "region": rows.where("building_id % 2 = 1").where(~F.coalesce("light", F.lit(False)))}
    chosen = [r.select("building_id", "height", F.lit(name).alias("source")) for name, r in registers.items()]
    return chosen[0].unionByName(chosen[1])


@query("select cast(day as date) as day, event_type as camera, n from (select cast(ts as date) as day, first(event_type order by ts, event_id) as event_type, count(*) as n from events group by 1)")
def src12_flight_dates(spark, sf_dir):
    """Flights, one for each date: the first that is met; newest first."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("camera"), F.count("*").alias("n"))
    return e.orderBy(F.desc("day"))


@query("select event_id, round(0.2126E0*(event_id % 256) + 0.7152E0*((event_id*7) % 256) + 0.0722E0*((event_id*13) % 256), 6) as luminance, cast(floor(0.2126E0*(event_id % 256) + 0.7152E0*((event_id*7) % 256) + 0.0722E0*((event_id*13) % 256) + 0.5E0) as bigint) as level from events")
def src11_luminance(spark, sf_dir):
    k = F.col("event_id")
    light = luminance(k % 256, k * 7 % 256, k * 13 % 256)
    return table(spark, sf_dir, "events").select("event_id", r6(light).alias("luminance"), half_up(light).alias("level"))


def luminance(red, green, blue):
    return red * 0.2126 + green * 0.7152 + blue * 0.0722


@query(
    """
    box as (select highway, min(v.x) as x0, max(v.x) as x1, min(v.y) as y0, max(v.y) as y1 from vertices v join ways using (way_id) group by 1)
    select highway, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1, true as known from box
    """,
    *WAYS,
)
def src20_src21_open_dataset(spark, sf_dir):
    """A part of the dataset by its key, with its box; an unknown key is an error, not an empty table."""
    w = adapters.ways(spark, sf_dir)
    boxes = w.select("highway", F.explode("line").alias("p")).groupBy("highway").agg(*[r6(f(F.col(f"p.{c}"))).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))])
    known = F.when(F.col("highway").isin(*adapters.HIGHWAYS), True).otherwise(F.raise_error(F.concat(F.lit("unknown: "), F.col("highway"))))
    return boxes.select("highway", "x0", "y0", "x1", "y1", known.cast("boolean").alias("known"))



@query(
    """
    k as (select way_id, case when coalesce(tunnel in ('yes', 'covered', 'passage'), false) or coalesce(indoor = 'yes', false) then 2 when coalesce(tunnel = 'building_passage', false) or coalesce(covered <> 'no', false) then 1 else 0 end as cover, (way_id*17) % 101/100E0 as svf, (way_id*29) % 101/100E0 as t from ways)
    select way_id, cover, case cover when 1 then least(svf, 0.18E0) when 2 then least(svf, 0.05E0) else svf end as svf, case cover when 1 then least(t, 0.12E0) when 2 then least(t, 0.02E0) else t end as transmission from k
    """,
    "ways",
)
def j19_caps_under_cover(spark, sf_dir):
    """Under a roof a point sees no more sky and gets no more sun than its degree of cover allows: a lookup in a table of two rows."""
    caps = F.broadcast(spark.createDataFrame([(1, 0.18, 0.12), (2, 0.05, 0.02)], "cover int, svf_cap double, sun_cap double"))
    k = F.col("way_id")
    w = adapters.ways(spark, sf_dir).select("way_id", tags.cover_kind().alias("cover"), (k * 17 % 101 / 100.0).alias("svf"), (k * 29 % 101 / 100.0).alias("transmission"))
    return w.join(caps, "cover", "left").select("way_id", "cover", F.least("svf", F.coalesce("svf_cap", F.lit(1.0))).alias("svf"), F.least("transmission", F.coalesce("sun_cap", F.lit(1.0))).alias("transmission"))
