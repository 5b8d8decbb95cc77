"""What only shows on larger tables: numbers that outgrow their type, and work that outgrows a task."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lightwalk.functions import exposure
from lightwalk.operators import graph, raster, routing, spatial
from lightwalk.plans import catalog, reports, suns
from lightwalk.sources import storage
from lightwalk.streaming import tracking


def test_a24_squares_of_ranks_outgrow_an_int(spark, tmp_path):
    """One brand of 46,500 parts, dearest last and smallest last: ranks lie up to 46,499 apart."""
    k = F.col("id")
    spark.range(46_500).select(k.alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), k.cast("double").alias("p_retailprice"), (46_500 - k).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    assert [(r.brand, r.rho) for r in catalog.a24_spearman(spark, str(tmp_path)).collect()] == [("Brand#1", -1.0)]


def test_components_dealt_in_small_parts_equal_those_of_one(spark):
    """Chains whose numbers jump about, so that parts of a few edges meet in many nodes; an edge to a node that is not known joins nothing."""
    rng = random.Random(5)
    names = rng.sample(range(10_000), 300)
    pairs = [(names[i], names[i + 1]) for i in range(299) if i % 60 != 59] + [(names[0], 20_000), (20_000, names[150]), (names[7], names[7])]
    nodes = spark.createDataFrame([(n,) for n in names], "node_id long")
    got = {r.node_id: r.component for r in graph.components(nodes, spark.createDataFrame(pairs, "src long, dst long"), at_once=10).collect()}
    assert got == {n: min(names[i // 60 * 60 : i // 60 * 60 + 60]) for i, n in enumerate(names)}


def test_trips_without_a_way_are_told_before_the_search(spark):
    nodes = spark.createDataFrame([(n, 2.35 + n / 1e4, 48.85) for n in range(8)], "node_id long, lon double, lat double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5), (6, 7)], "src long, dst long")
    trips = spark.createDataFrame([(1, 2, 0, 0.0, 600), (2, 0, 4, 0.0, 600), (3, 1, 1, 0.0, 600), (4, 3, 0, 0.0, 600), (5, 0, 99, 0.0, 600), (6, 7, 6, 0.0, 600)], "trip long, start long, goal long, alpha double, departure int")
    kept, asked = routing.connected(edges, nodes, trips)
    assert {r.trip for r in asked.collect()} == {1, 6} and {r.node_id for r in kept.collect()} == {0, 1, 2, 6, 7}


def test_a25_a_surface_without_open_ground_fits_no_sun(spark):
    """Where every cell is built up there is no pixel to score: no rows, as in the SQL, and no error."""
    cells = spark.range(9).select((F.col("id") % 3).cast("int").alias("row"), F.floor(F.col("id") / 3).cast("int").alias("col"), F.lit(30.0).alias("ground"), F.lit(42.0).alias("surface"), *[F.lit(0.0).alias(c) for c in ("canopy_top", "canopy_base", "canopy_k")])
    image = spark.createDataFrame([(0, 90)], "key long, lum long")
    found = suns.fitted(spark, cells, image, datetime.date(2024, 6, 21))
    assert found.count() == 0 and found.columns == ["stage", "minutes", "scale", "n", "r", "shade", "overlap", "best"]
    bare = cells.withColumn("surface", F.col("ground"))
    assert suns.fitted(spark, bare, image.where("false"), datetime.date(2024, 6, 21)).count() == 0


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 50)
    assert storage.dealt(rows, "k", at_once=40).rdd.getNumPartitions() == 25 and storage.dealt(rows, "k", at_once=1000) is rows
    assert storage.dealt(rows, "k", rows=400, at_once=100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_q10_the_first_reach_with_something_in_it_and_its_smallest_lamp(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 500.0, 0.0), (4, -3.0, 9.0)], "p long, x double, y double")
    lamps = spark.createDataFrame([(7, 3.0, 3.0), (9, 1.0, 1.0), (5, 8.0, 0.0), (6, 118.0, -18.0), (2, 518.1, 0.0), (8, -12.0, 18.0)], "o long, x double, y double")
    got = {(r.p, r.o, r.reach) for r in spatial.first_within(points, lamps, "p", "o", [3.0, 9.0, 18.0]).collect()}
    assert got == {(1, 7, 3.0), (2, 6, 18.0), (4, 7, 9.0)}


def test_chamfer_along_a_long_line_keeps_running_minima(spark):
    """One row of 3,000 cells: a frame that ends with the line is gone through anew for each cell, so none may be left in the plan."""
    cells = spark.range(3000).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.col("id").isin(0, 2000).alias("edge"))
    found = raster.chamfer(cells, "edge")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {r.col: r.d for r in found.collect()} == {c: 3 * min(c, abs(2000 - c)) for c in range(3000)}


def test_the_nearest_that_matches_is_found_in_a_crowd(spark):
    """Many others close together, some far off, on a lattice with ties: narrow cells first, and no others lost that lie as far as the reach."""
    rng = random.Random(3)
    at = lambda wide: (rng.randrange(wide) / 4, rng.randrange(wide) / 4)
    points = [(k, *at(120 if k % 5 else 4000), k % 3) for k in range(150)]
    others = [(k, k % 3, *at(40 if k % 4 else 400)) for k in range(2000)]
    p = spark.createDataFrame(points, "p long, x double, y double, kind int")
    o = spark.createDataFrame(others, "o long, sort int, x double, y double")
    want = {}
    for k, x, y, kind in points:
        met = [(math.hypot(ox - x, oy - y), i) for i, sort, ox, oy in others if sort == kind]
        want |= {k: min(met)} if min(met)[0] <= 14 else {}
    assert 50 < len(want) < 150
    for copied in ("points", "others"):
        got = spatial.nearest_within(p, o, ["p"], 14.0, lambda n: n["sort"] == F.col("kind"), copied)
        assert {r.p: (r.distance, r.o) for r in got.collect()} == want
    assert spatial.nearest_within(p, o.where("false"), ["p"], 14.0, lambda n: n["sort"] == F.col("kind")).count() == 0


def test_veils_in_blocks_add_up_to_those_of_the_pairs(spark):
    """Points and lamps of a cell dealt to several tasks; lamps below the eye, at it and where nothing is within reach."""
    rng = random.Random(7)
    p = spark.createDataFrame([(k, rng.random() * 150, rng.random() * 90 + (0 if k % 9 else 500)) for k in range(120)], "point_id long, x double, y double")
    lamps = spark.createDataFrame([(rng.random() * 150, rng.random() * 90, rng.random() * 8000, rng.choice([0.9, 1.6, 1.65, 6.0]), rng.random() * 5000 + 1500) for _ in range(200)], "x double, y double, flux double, height double, cct double")
    pairs = spatial.radius_join(p, lamps, 80.0).groupBy("point_id").agg(F.count("*").alias("n"), F.sum(exposure.veil(F.col("flux"), F.col("height"), F.col("cct"), F.col("distance"))).alias("v"))
    want = {r.point_id: (r.n, r.v) for r in pairs.collect()}
    told = lamps.select("x", "y", (F.col("height") - exposure.EYE).alias("rise"), exposure.strength(F.col("flux"), F.col("cct")).alias("strength"))
    rows = spatial.folded_within(p, told, "point_id", 80.0, catalog._veiled, "point_id long, lamps long, veil double", at_once=7)
    got = {r.point_id: (r.n, r.v) for r in rows.groupBy("point_id").agg(F.sum("lamps").alias("n"), F.sum("veil").alias("v")).collect() if r.n}
    assert got.keys() == want.keys() and len(want) < 120
    assert all(got[k][0] == n and math.isclose(got[k][1], v, rel_tol=1e-9) for k, (n, v) in want.items())


def test_costly_rows_are_spread_by_their_number(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert storage.spread(rows, "id", at_once=10).rdd.getNumPartitions() == 10
    assert storage.spread(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_offsets_of_many_fixes_are_those_of_each(spark):
    """All fixes of a user at once, and the segment chosen among those around the last one."""
    rng = random.Random(2)
    route = tracking.Route([2.35 + 0.0003 * i for i in range(60)], [48.85 + 0.0002 * (i % 7) for i in range(60)], [100.0])
    fixes = [(2.35 + rng.random() * 0.02, 48.85 + rng.random() * 0.001) for _ in range(50)]
    along, off = route.offsets(*(np.array(c) for c in zip(*fixes, strict=True)))
    assert along.shape == off.shape == (50, 59)
    for n, (lon, lat) in enumerate(fixes):
        for hint in (None, 0, 30, 58):
            k = route.nearest(off[n], hint)
            assert route.snap(lon, lat, hint) == (along[n, k], off[n, k], k)
            assert hint is None or hint - tracking.BACK <= k < hint + tracking.AHEAD


def test_points_meet_rings_without_a_table_that_every_task_holds(spark):
    corner = lambda x, y: F.struct((F.col("id") * 30.0 + x).alias("x"), F.lit(float(y)).alias("y"))
    rings = spark.range(20).select(F.array(corner(0, 0), corner(10, 0), corner(10, 40), corner(0, 40), corner(0, 0)).alias("ring"))
    points = spark.range(600).select(F.col("id").alias("p"), (F.col("id") + 0.5).alias("x"), F.lit(20.0).alias("y"))
    found = spatial.within_rings(points, rings)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.p for r in found.collect()} == {k for k in range(600) if k % 30 < 10}


def _squares(seed):
    """Two drawn grids a degree apart, with trips in both: nodes, edges, exposures, trips."""
    from test_routing import drawn

    nodes, edges, exposures, trips = drawn(seed)
    more_nodes, more_edges, _, more_trips = drawn(seed + 1, side=4)
    nodes += [(n + 1000, lon + 1, lat) for n, lon, lat in more_nodes]
    edges += [(e + 10_000, a + 1000, b + 1000, s + 50, sides, m, c) for e, a, b, s, sides, m, c in more_edges]
    return nodes, edges, exposures, trips + [(t + 100, a + 1000, b + 1000, *rest) for t, a, b, *rest in more_trips]


def test_a_small_component_is_searched_once_and_a_large_one_by_rounds(spark, monkeypatch):
    """The same ways whether all components are cut into cells, one of two is, or none; rounds are only gone for those that are, and arcs only dealt for their own trips."""
    from test_routing import frames, plain

    nodes, edges, exposures, trips = _squares(11)
    cell = F.concat_ws(":", F.floor(F.col("lon") / 0.0011).cast("string"), F.floor(F.col("lat") / 0.0011).cast("string"))
    asked = spark.createDataFrame(trips, "trip long, start long, goal long, alpha double, departure int")
    want = {t: [(w[0], w[1], round(w[4], 6)) for w in plain(nodes, edges, exposures, a, b, alpha, at)] for t, a, b, alpha, at in trips}
    assert sum(len(w) > 3 for t, w in want.items() if t < 100) > 5 and any(w for t, w in want.items() if t >= 100)
    rounds, real = [], routing._round
    monkeypatch.setattr(routing, "_round", lambda entries, arcs: rounds.append({r.trip for r in entries.select("trip").distinct().collect()}) or real(entries, arcs))
    for whole, searched in ((0, lambda t: True), (20, lambda t: t < 100), (5_000, None)):
        rounds.clear()
        got = {t: [] for t in want}
        for r in routing.routes(*frames(spark, nodes, edges, exposures), asked, cell, trips_a_task=5, whole=whole).orderBy("trip", "hop").collect():
            got[r.trip].append((r.src, r.node, round(r.cost, 6)))
        assert got == want
        assert set().union(*rounds) == {t for t in want if searched and searched(t) and want[t]}


def test_sudden_changes_along_a_route_are_told_by_a_frame(spark):
    """Means around each step's end against a loop over the whole route, with steps longer than the span and without length; no join of a route with itself."""
    rng = random.Random(9)
    steps = [(r, q + 1, rng.choice([0.0, 3.0, 7.0, 16.0, 60.0]), rng.randrange(100)) for r in range(4) for q in range(30)]
    at, rows = {}, []
    for r, q, length, index in steps:
        at[r] = at.get(r, 0.0) + length
        rows.append((r, q, at[r], length, index))
    found = reports.sudden(spark.createDataFrame(rows, "route_id long, seq int, upto double, len double, index int"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.route_id, x.seq): (x.run_in, x.before, x.run_out, x.after, x.after_it) for x in found.collect()}
    for r, q, upto, _, _ in rows:
        want = []
        for a, b in ((upto - 40, upto), (upto, upto + 40)):
            parts = [(max(0.0, min(b, u) - max(a, u - n)), i) for s, _, u, n, i in rows if s == r]
            run = sum(m for m, _ in parts)
            want += [run, sum(m * i for m, i in parts) / run if run else None]
        assert got[r, q] == (*want, q < 30)
