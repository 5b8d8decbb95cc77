"""Properties of sun, sky and exposure, and of the joins and folds, on small inputs."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lightwalk.functions import astro, exposure, geo
from lightwalk.functions import tags, words
from lightwalk.functions.num import half_up, quantiles
from lightwalk.operators import graph, raster, rays, series, sky, spatial
from lightwalk.sources import storage
from lightwalk.streaming import tracking


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_m1_noon_altitudes_of_the_year(spark):
    rows = [("2026-06-21", 64.6), ("2026-12-21", 17.7), ("2026-03-20", 41.1)]
    for day, want in rows:
        start = datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000
        noon = spark.range(600, 840).select((F.col("id") * 60000.0 + start).alias("ms"))
        altitude, azimuth = astro.sun_position(F.col("ms"), F.lit(48.8566), F.lit(2.3522))
        top = noon.select(F.degrees(altitude).alias("alt"), F.degrees(azimuth).alias("az"), "ms").orderBy(F.desc("alt")).first()
        assert abs(top.alt - want) < 0.6 and abs(top.az - 180) < 3


def test_m2_refraction_and_m4_air_mass(spark):
    r = one(spark, low=F.degrees(astro.refracted(F.lit(0.0))), deep=astro.refracted(F.lit(-0.1)), zenith=astro.air_mass(F.lit(90.0)), third=astro.air_mass(F.lit(30.0)), edge=astro.air_mass(F.lit(1.0)))
    assert 0.4 < r.low < 0.7 and r.deep == -0.1 and abs(r.zenith - 1) < 0.01 and abs(r.third - 2) < 0.02 and 24 < r.edge < 30


def test_m7_turbidity_round_trip(spark):
    for t in (2.0, 4.0, 6.0):
        direct, _ = astro.clear_sky(F.lit(0.6), t)
        assert abs(one(spark, t=astro.linke_turbidity(direct, F.lit(0.6))).t - t) < 1e-6


def parts(spark, **over):
    """One row with the parts of the index of a scenario."""
    degrees = over.pop("altitude", 50)
    base = {"transmission": 0.5, "svf": 0.5, "flicker": 0.0, "veil": 0.0, "wet": 0.0, "azimuth": math.pi, "heading": None, "horizon": [20] * 16, "cloud": 0.0} | over
    c = {k: F.lit(v).cast("double") if k != "horizon" else F.array(*map(F.lit, v)) for k, v in base.items()}
    altitude = F.lit(math.radians(degrees))
    sky = exposure.sky_conditions(altitude, c.pop("cloud"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return exposure.measured(spark.range(1), c | sky | {"altitude": altitude}, [])


def index_of(spark, **over):
    return parts(spark, **over).select(exposure.index({k: F.col(k) for k in (*exposure.WEIGHTS, "night", "night_share")}).alias("i")).first().i


def test_index_is_bounded_and_rises_with_sun(spark):
    for degrees in (-10, 0, 5, 30, 60):
        seen = [index_of(spark, altitude=degrees, transmission=t) for t in (0.0, 0.5, 1.0)]
        assert all(0 <= v <= 100 for v in seen) and seen == sorted(seen)


def test_wet_streets_and_sun_in_the_face_are_worse(spark):
    dry, wet = (parts(spark, altitude=10, wet=w, transmission=1.0).first() for w in (0.0, 1.0))
    assert wet.reverb > dry.reverb and wet.glare >= dry.glare
    ahead, behind = (parts(spark, altitude=10, heading=h, transmission=1.0).first().glare for h in (math.pi, 0.0))
    assert abs(behind - 0.3 * ahead) < 1e-9


def test_sky_tables_reduce_to_known_cases(spark):
    rows = [(0, 0.7, 2.0, 1.0), (1, 0.7, 2.0, 1.36), (2, 0.4, 1.0, 7.0), (3, 0.4, 1.0, None)]
    made = sky.tables(spark.createDataFrame(rows, "instant int, altitude double, azimuth double, epsilon double"))
    flat, street = [0] * 32, [40] * 32
    read = lambda h: made.select("instant", sky.factor(F.col("sky"), F.array(*map(F.lit, h))).alias("f"), sky.wall_factor(F.col("wall"), F.lit(3), F.lit(0.0)).alias("w"))
    assert all(abs(r.f - 1) < 1e-9 for r in read(flat).collect())  # the whole sky
    by = {r.instant: r for r in read(street).collect()}
    assert abs(by[1].f - math.cos(math.radians(40)) ** 2) < 0.005 and abs(by[1].w - 0.5) < 0.005  # an even sky
    assert by[0].f > by[1].f and abs(by[3].f - by[0].f) < 1e-9  # an overcast one is brightest at the top; no clearness: overcast
    assert all(r.f is None for r in read([0] * 16).collect())  # other sectors than the tables have


def test_glare_peaks_low_and_night_blends(spark):
    rows = spark.range(1, 90).select(F.radians(F.col("id").cast("double")).alias("a"), F.col("id").alias("deg"))
    direct, _ = astro.clear_sky(F.col("a"))
    load = exposure.glare(F.lit(1.0), F.col("a"), F.lit(None).cast("double"), F.lit(None).cast("double"), direct, F.lit(0.0))
    top = rows.select("deg", load.alias("g")).orderBy(F.desc("g")).first()
    assert 5 <= top.deg <= 20 and 0.9 < top.g <= 1
    r = one(spark, day=exposure.night_share(F.lit(math.radians(3))), dusk=exposure.night_share(F.lit(math.radians(-2))), night=exposure.night_share(F.lit(math.radians(-7))))
    assert (r.day, r.night) == (0, 1) and abs(r.dusk - 0.5) < 1e-9


def test_lamp_veil_peaks_at_a_distance(spark):
    rows = spark.range(0, 60).select(F.col("id").cast("double").alias("d"))
    best = rows.select("d", exposure.veil(F.lit(8000.0), F.lit(8.0), F.lit(3000.0), F.col("d")).alias("v")).orderBy(F.desc("v")).first()
    assert 5 <= best.d <= 20


def test_rounding_and_quantiles(spark):
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,), (-0.5,)], "x double").select(half_up(F.col("x"))).collect()] == [-2, 3, 0]
    rows = spark.createDataFrame([(1, float(x)) for x in (4, 1, 3, 2)] + [(2, 5.0), (2, 5.0), (2, 7.0)], "k int, x double")
    got = {r.k: (r.m, r.q) for r in quantiles(rows, "k", "x", m=lambda n: F.floor(n / 2), q=lambda n: F.floor((n - 1) * 0.9)).collect()}
    assert got[2] == (5.0, 5.0)
    r = rows.sparkSession.createDataFrame([got[1]], "m double, q double").first()
    assert (r.m, r.q) == (3.0, 3.0)


def test_tiles_and_bearings(spark):
    r = one(spark, x=geo.tile_x(F.lit(2.35), F.lit(12)), y=geo.tile_y(F.lit(48.86), F.lit(12)), north=geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), east=geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), turn=geo.turn(F.lit(10.0), F.lit(350.0)))
    assert (r.x, r.y) == (2074, 1409) and abs(r.north) < 1e-6 and abs(r.east - 90) < 1e-6 and r.turn == 20


def test_radius_join_keeps_the_edge(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double")
    others = spark.createDataFrame([(1, 80.0, 0.0), (2, 80.001, 0.0), (3, -60.0, -50.0)], "o long, x double, y double")
    assert {r.o for r in spatial.radius_join(points, others, 80.0).collect()} == {1, 3}


def test_points_in_rings_and_repartitioned(spark):
    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (50.0, 50.0), (0.0, 100.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 50.0, 20.0), (2, 50.0, 80.0), (3, 10.0, 60.0), (4, 200.0, 1.0)], "p long, x double, y double")
    assert {r.p for r in spatial.within_rings(points.repartition(5), rings).collect()} == {1, 3}


def test_nearest_looks_as_far_as_it_must(spark):
    points = spark.createDataFrame([(1, 2.35, 48.85), (2, 10.0, 48.85), (3, 2.3501, 48.8501)], "p long, lon double, lat double")
    nodes = spark.createDataFrame([(7, 2.3502, 48.8502), (8, 2.36, 48.85)], "n long, lon double, lat double")
    assert {r.p: r.n for r in spatial.nearest(points, nodes, "p", "n").collect()} == {1: 7, 2: 8, 3: 7}


def test_bracketed_clamps_and_fills(spark):
    rows = spark.createDataFrame([("d", 60, 1.0), ("d", 120, None), ("d", 180, 4.0)], "day string, minutes int, v double")
    wanted = spark.createDataFrame([("d", m) for m in (0, 60, 90, 150, 180, 999)], "day string, m int")
    assert {r.m: r.v for r in series.bracketed(rows, wanted, "day", "minutes", ["v"]).collect()} == {0: 1.0, 60: 1.0, 90: 1.0, 150: 4.0, 180: 4.0, 999: 4.0}


def test_resampling_starts_after_half_a_step(spark):
    line = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 10.0, 0.0, 10.0, 0.0), (1, 3, 10.0, 0.0, 10.0, 7.0)], "id int, seq int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.k, r.x, r.y) for r in series.resampled(line, "id", 4.0).collect())
    assert got == [(0, 2.0, 0.0), (1, 6.0, 0.0), (2, 10.0, 0.0), (3, 10.0, 4.0)]


def test_components_take_the_smallest_node(spark):
    nodes = spark.range(0, 50).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(3, 30)] + [(40, 41), (42, 42)], "src long, dst long")
    got = {r.node_id: r.component for r in graph.components(nodes, edges).collect()}
    assert got[30] == 3 and got[41] == 40 and got[42] == 42 and got[0] == 0


def test_upsert_and_budget(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r.k, r.v) for r in storage.upserted(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    files = spark.createDataFrame([(0, f"f{i}", 10, i) for i in range(5)], "s int, name string, size long, modified int")
    assert {r.name for r in storage.within_budget(files, "s", 25).collect()} == {"f4", "f3"}


def test_tracking_is_monotone_and_announces_once():
    route = tracking.Route([2.35 + 0.0001 * i for i in range(60)], [48.85] * 60, [200.0, 400.0])
    assert tracking.advanced(100.0, 90.0) == 100.0 and tracking.advanced(100.0, 60.0) == 60.0 and tracking.advanced(None, 5.0) == 5.0
    along, off, k = route.snap(2.3555, 48.85, None)
    assert abs(along - 55 * route.length[0]) < 0.5 and off < 0.1 and k in (54, 55)
    assert route.snap(2.3555, 48.85, 3)[2] == 27  # the window's last segment
    said: set[str] = set()
    sunny, warned = tracking.Route([2.35 + 0.0001 * i for i in range(60)], [48.85] * 60, [200.0], [40.0, 60.0]), set()
    assert [sunny.warning(x, warned) for x in (5.0, 12.0, 12.5, 35.0, 45.0, 61.0)] == [None, 30, None, 25, None, None]  # thirty metres ahead, once each
    here = (2.35, 48.85)
    assert tracking.heading_of(90.0, 10.0, None, here) == 90.0 and tracking.heading_of(None, 10.0, (2.0, 48.0), here) == 10.0 and tracking.heading_of(float("nan"), None, None, here) is None
    assert abs(tracking.heading_of(None, None, (2.349, 48.85), here) - 90) < 1e-6
    assert [route.announcement(x, said) for x in (0.0, 21.0, 30.0, 185.0, 186.0, 150.0)] == [None, 180, None, None, None, None]  # the farthest threshold reached counts, as in the guidance that this follows


@pytest.mark.parametrize("name", ["segment_index_at", "st1_st5_tracking", "st_windowed_events", "m3_local_time"])
def test_queries_run(spark, name):
    from lightwalk.plans import catalog, registry, skies  # noqa: F401 the modules register their queries

    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


# --- surface, rays, streets ------------------------------------------------------------------------------------------


def inside(x, y, rings):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 <= y < y2) or (y2 <= y < y1):
                hits += x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x
    return hits % 2 == 1


def test_ra2_polygons_with_holes_fill_the_cells_that_their_middle_row_crosses(spark):
    grid = raster.Grid(1.0, 30, 20)
    outer = [(2.3, 1.2), (25.1, 3.4), (14.2, 9.1), (27.7, 18.3), (3.9, 16.6), (9.4, 8.2)]
    hole = [(6.2, 12.1), (12.8, 12.4), (11.9, 15.2), (6.6, 14.7)]
    shapes = spark.createDataFrame([(1, [outer, hole])], "id int, rings array<array<struct<x:double,y:double>>>")
    got = {(r.row, r.col) for r in raster.filled(shapes, grid).collect()}
    want = set()
    for row in range(20):  # between each two crossings of the row's middle, the cells from and to those that the crossings round to
        edges = [e for ring in ([*outer], [*hole]) for e in zip(ring, [*ring[1:], ring[0]], strict=True)]
        at = sorted(x1 + (row + 0.5 - y1) / (y2 - y1) * (x2 - x1) for (x1, y1), (x2, y2) in edges if (y1 <= row + 0.5) != (y2 <= row + 0.5))
        for a, b in zip(at[::2], at[1::2], strict=True):
            want |= {(row, col) for col in range(max(0, math.floor(a)), min(29, math.floor(b)) + 1)}
    assert got == want
    assert {(row, col) for row in range(20) for col in range(30) if inside(col + 0.5, row + 0.5, [outer, hole])} <= got
    assert raster.filled(shapes.where("false"), grid).count() == 0


def wall(spark, grid, height):
    """Flat ground with a wall in column 10 and a hedge in column 5 of some rows."""
    cells = grid.cells(spark).withColumns({"ground": F.lit(0.0), "surface": F.when(F.col("col") == 10, height).otherwise(0.0)})
    hedge = (F.col("col") == 5) & (F.col("row") >= 5)
    return cells.withColumns({"canopy_top": F.when(hedge, 4.0).otherwise(0.0), "canopy_base": F.when(hedge, 0.5).otherwise(0.0), "canopy_k": F.when(hedge, 0.3).otherwise(0.0)})


def test_ra9_rays_stop_at_walls_and_dim_in_hedges(spark):
    grid = raster.Grid(1.0, 20, 10)
    points = spark.createDataFrame([("shade", 9.5, 2.5, 1.6), ("far", 0.5, 2.5, 1.6), ("beyond", 15.5, 2.5, 1.6), ("hedge", 3.5, 7.5, 1.6)], "key string, x double, y double, eye double")
    east, low = math.pi / 2, math.atan(0.5)
    got = {r.key: (r.transmission, r.blocker) for r in raster.sun_transmission(points, wall(spark, grid, 5.0), grid, east, low, 5.0).collect()}
    assert got["shade"] == (0.0, "surface") and got["beyond"] == (1.0, "sky") and got["far"] == (1.0, "sky")
    assert 0.5 < got["hedge"][0] < 0.98 and got["hedge"][1] == "canopy"
    assert {r.transmission for r in raster.sun_transmission(points, wall(spark, grid, 5.0), grid, east, -0.1, 5.0).collect()} == {0.0}


def test_ra10_sky_is_whole_in_the_open_and_ra11_finds_the_wall(spark):
    grid = raster.Grid(1.0, 20, 10)
    points = spark.createDataFrame([("a", 2.5, 2.5, 1.6), ("b", 8.5, 2.5, 1.6)], "key string, x double, y double, eye double")
    bare = {r.key: r for r in raster.sky_view(points, wall(spark, grid, 0.0).withColumns({"canopy_top": F.lit(0.0), "canopy_k": F.lit(0.0)}), grid, 16, 15.0, 16).collect()}
    assert all(abs(r.svf - 1) < 1e-9 and r.horizon == [0.0] * 16 for r in bare.values())
    near = {r.key: r for r in raster.sky_view(points, wall(spark, grid, 8.0), grid, 16, 15.0, 16).collect()}
    assert near["b"].svf < near["a"].svf < 1 and max(near["b"].horizon) == near["b"].horizon[4]  # the wall is in the east
    ahead = points.select("key", "x", "y", F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"))
    assert {r.key: r.distance for r in raster.facade_distance(ahead, wall(spark, grid, 8.0), grid, 6.0).collect()} == {"a": 6.0, "b": 2.0}


def test_tags_and_words(spark):
    rows = [("service", None, "parking_aisle", None, None, "8 m"), ("footway", None, None, "yes", "left", None), ("primary", "no", None, None, None, "70"), ("primary", None, None, "building_passage", "separate", "20")]
    w = spark.createDataFrame(rows, "highway string, foot string, service string, tunnel string, sidewalk string, width string")
    w = w.withColumns({c: F.lit(None).cast("string") for c in ("access", "covered", "indoor", "footway", "crossing")})
    got = w.select(tags.walkable().alias("w"), tags.cover_kind().alias("c"), tags.nominal_offset().alias("o"), tags.declared_absent().alias("d")).collect()
    assert [r.w for r in got] == [False, True, False, True] and [r.c for r in got] == [0, 2, 0, 1] and [r.o for r in got] == [0.0, 0.0, 9.0, 10.0]
    assert [tuple(r.d) if r.d else None for r in got] == [None, (False, True, False), None, (True, True, True)]
    r = one(spark, n=words.normalised(F.lit("  Rue de l’Œuf — Sévigné n°7 ")), d=words.duration(F.lit(719.7)), m=words.metres(F.lit(1234.0)), c=words.cardinal(F.lit(-1.0), F.lit(0.0)), k=words.clock(F.lit(847.4)))
    assert r.n == "rue de l uf sevigne n 7" and r.d == "12 min 00 s" and r.m == "1.2 km" and r.c == "ouest" and r.k == "14:07"


def test_numbers_of_rows_are_dense_over_ranges(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = [r.n for r in series.numbered(rows, ["k"], "n").orderBy("k").collect()]
    assert got == list(range(5000))


def test_short_lines_are_sampled_in_their_middle(spark):
    line = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 0.0)], "id int, seq int, x1 double, y1 double, x2 double, y2 double")
    r = series.resampled(line, "id", 4.0).first()
    assert (r.x, r.y, r.dx, r.dy) == (0.5, 0.0, 1.0, 0.0)


def test_rays_in_small_tiles_equal_a_walk_over_the_whole_grid(spark):
    rng, grid = random.Random(7), raster.Grid(2.0, 40, 30)
    cells = {(r, c): (float(rng.randrange(3)), float(rng.choice([0, 0, 0, 6, 15])), float(rng.choice([0, 0, 9]))) for r in range(30) for c in range(40) if rng.random() < 0.95}
    rows = [(r, c, g, g + h, g + t if t else 0.0, g + 2.0 if t else 0.0, 0.2 if t else 0.0) for (r, c), (g, h, t) in cells.items()]
    surface = spark.createDataFrame(rows, "row int, col int, ground double, surface double, canopy_top double, canopy_base double, canopy_k double")
    # A third of the points in one place, some outside of the grid.
    places = [(i, rng.uniform(-4, 84), rng.uniform(-4, 64), 1.6) for i in range(60)] + [(100 + i, 41.3, 22.7, 1.6) for i in range(30)]
    points = spark.createDataFrame(places, "key int, x double, y double, eye double")
    suns = [rays.Sun(0.7, 0.2), rays.Sun(3.9, 0.6), rays.Sun(2.0, 0.3, 1.35), rays.Sun(1.0, -0.1)]

    def cast(x, y, eye, sun):
        if sun.altitude <= 0:
            return True, 0
        depth, rise = 0, math.tan(sun.altitude) * 1.6
        for k in range(1, int(30 // 1.6) + 1):
            row, col = int((y + math.cos(sun.azimuth) * 1.6 * k) / 2), int((x + math.sin(sun.azimuth) * 1.6 * k) / 2)
            g, h, t = cells.get((row, col), (0.0, -99.0, 0.0))
            if g + h * sun.scale > eye + k * rise:
                return True, 0
            depth += 320000 if t and g + t > eye + k * rise > g + 2 else 0
        return False, depth

    found = rays.sunlit(points, surface, grid, suns, 30.0, tile=8, at_once=5)
    got = {r.key: [(c, 0 if c else d) for c, d in zip(r.cut, r.depth, strict=True)] for r in found.collect()}
    assert got == {key: [cast(x, y, eye, s) for s in suns] for key, x, y, eye in places}
    assert len({t for c in got.values() for t in c}) > 4
    whole = {r.key: r for r in rays.skyline(points, surface, grid, 8, 20.0).collect()}
    assert {r.key: r for r in rays.skyline(points, surface, grid, 8, 20.0, tile=5, at_once=7).collect()} == whole
    assert max(whole[0].built + whole[1].built) > 0
    assert rays.sunlit(points.where("false"), surface, grid, suns).count() == 0
    assert {tuple(r.cut) for r in rays.sunlit(points, surface.where("false"), grid, suns).collect()} == {(False, False, False, True)}
