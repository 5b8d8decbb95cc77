"""Ways through drawn graphs against a plain search that settles the whole graph in order of cost."""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lightwalk.operators import routing

SPEED, PENALTY = 1.35, 25.0
STEPS = 69


def frames(spark, nodes, edges, exposures):
    e = spark.createDataFrame(edges, "edge long, src long, dst long, segment long, sides long, length double, crossing boolean")
    n = spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    x = spark.createDataFrame([(s, o, i, w, u, d) for (s, o), (i, w, u, d) in exposures.items()], "sides long, octant int, index array<int>, work array<int>, sun array<int>, side array<string>")
    return e, n, x


def octant(a, b):
    east, north = (b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2)) * 111320, (b[1] - a[1]) * 111132
    turn = math.degrees(math.atan2(east, north)) / 45
    return int(math.copysign(math.floor(abs(turn) + 0.5), turn)) % 8


def plain(nodes, edges, exposures, start, goal, alpha, departure):
    """(src, node, edge, seconds so far, cost, index) of each hop; none without a way."""
    at = {n: (lon, lat) for n, lon, lat in nodes}
    whole, out = defaultdict(float), defaultdict(list)
    for _, _, _, segment, _, length, _ in edges:
        whole[segment] += length
    for edge, a, b, segment, sides, length, crossing in edges:
        for u, v in ((a, b), (b, a)) if a != b else ():
            share = length / whole[segment] if crossing and whole[segment] > 0 else 0.0
            out[u].append((v, edge, length / SPEED + share * PENALTY, exposures.get((sides, octant(at[u], at[v])))))
    heap, known = [(0.0, float(departure), start, -1, None, None)], {}
    while heap:
        cost, clock, node, src, edge, index = heapq.heappop(heap)
        if node in known:
            continue
        known[node] = (cost, clock, src, edge, index)
        for v, edge, seconds, seen in out[node]:
            index, work = 0, 0
            if seen:
                step = min(max(int((clock + seconds / 120 - 300) // 15), 0), STEPS - 1)
                index, work = seen[0][step], seen[1][step]
            heapq.heappush(heap, (cost + seconds * (1 + 2 * work / 100) * (1 + alpha * index / 100), clock + seconds / 60, v, node, edge, index if seen else None))
    hops, node = [], goal
    while node != start and node in known:
        cost, clock, src, edge, index = known[node]
        hops.append((src, node, edge, (clock - departure) * 60, cost, index))
        node = src
    return hops[::-1]


def constant(byid, work=None):
    return {(s, o): ([v] * STEPS, [(work or {}).get(s, 0)] * STEPS, [50] * STEPS, ["L"] * STEPS) for s, v in byid.items() for o in range(8)}


NODES = [(0, 2.35, 48.85), (1, 2.3501, 48.8501), (2, 2.3502, 48.8499), (3, 2.3505, 48.85), (9, 2.36, 48.86)]
TWO_WAYS = [(0, 0, 1, 0, 0, 100.0, False), (1, 0, 2, 4, 4, 100.0, False), (2, 1, 3, 1, 1, 100.0, False), (3, 2, 3, 2, 2, 130.0, False)]


def ways(spark, exposures, trips, cells=0.0001, edges=TWO_WAYS, nodes=NODES):
    cell = F.concat_ws(":", F.floor(F.col("lon") / cells).cast("string"), F.floor(F.col("lat") / cells).cast("string"))
    asked = spark.createDataFrame(trips, "trip long, start long, goal long, alpha double, departure int")
    found = defaultdict(list)
    for r in routing.routes(*frames(spark, nodes, edges, exposures), asked, cell, trips_a_task=3).orderBy("trip", "hop").collect():
        found[r.trip].append(r)
    return found


def test_two_ways(spark):
    """Streets 0 to 3 as they are, under works (10 to 13), and all exposed (20 to 23): one relaxation for all."""
    nodes = [(n + 100 * k, lon + 0.1 * k, lat) for k in range(4) for n, lon, lat in NODES]
    edges = [(e + 10 * k, a + 100 * k, b + 100 * k, s + 10 * k, s + 10 * k, m, c) for k in range(3) for e, a, b, s, _, m, c in TWO_WAYS]
    edges += [(40, 300, 301, 50, 50, 60.0, True), (41, 301, 303, 50, 50, 40.0, True)]
    exposures = constant({0: 0, 1: 90, 2: 0, 4: 0}) | constant({10: 0, 11: 0, 12: 0, 14: 0}, {11: 100}) | constant({20: 100, 21: 100, 22: 100, 24: 100})
    trips = [(1, 0, 3, 0.0, 600), (2, 0, 3, 3.0, 600), (3, 0, 9, 0.0, 600), (4, 3, 3, 0.0, 600), (5, 0, 77, 0.0, 600), (6, 3, 0, 3.0, 600), (7, 100, 103, 0.0, 600), (8, 200, 203, 6.0, 600), (9, 300, 303, 0.0, 600)]
    found = ways(spark, exposures, trips, 0.0001, edges, nodes)
    assert set(found) == {1, 2, 6, 7, 8, 9}  # no way to an island, to an unknown node, or to where one is
    assert round(sum(r.length for r in found[1])) == 200  # unweighted, the shortest
    assert round(sum(r.length for r in found[2])) == 230  # weighted, the sheltered one
    assert [r.node for r in found[6]] == [2, 0]
    assert [r.hop for r in found[2]] == [1, 2] and found[1][-1].seconds == pytest.approx(200 / SPEED) and found[1][0].sun == 50
    assert round(sum(r.length for r in found[7])) == 230 and found[7][-1].seconds == pytest.approx(230 / SPEED)  # works cost, they do not delay
    assert found[8][-1].cost == pytest.approx(200 / SPEED * 7)  # the most exposed net is still passable
    assert found[9][0].seconds == pytest.approx(60 / SPEED + 0.6 * PENALTY) and found[9][0]["index"] is None  # a crossing's penalty is shared


def drawn(seed, side=9):
    rng = random.Random(seed)
    nodes = [(k, 2.35 + 0.0004 * (k % side) + 0.0001 * rng.random(), 48.85 + 0.0003 * (k // side) + 0.0001 * rng.random()) for k in range(side * side)]
    edges = []
    for k in range(side * side):
        for j in ((k + 1) if k % side < side - 1 else None, k + side, k + side + 1):
            if j is not None and j < side * side and rng.random() < 0.75:
                edges.append((len(edges), *rng.sample((k, j), 2), rng.randrange(40), rng.randrange(12), rng.choice([20.0, 35.0, 50.0]) + rng.choice([0.0, rng.random()]), rng.random() < 0.2))
    edges += [(len(edges), 3, 3, 1, 1, 10.0, False), (len(edges) + 1, edges[0][1], edges[0][2], 2, 2, 1.0, False)]  # a loop, and a second edge between two nodes
    exposures = {(s, o): ([rng.choice([0, 100, rng.randrange(101)]) for _ in range(STEPS)], [rng.choice([0, 0, 100]) for _ in range(STEPS)], [1] * STEPS, ["R"] * STEPS) for s in range(10) for o in range(8)}
    trips = [(t, rng.randrange(side * side), rng.randrange(side * side), rng.choice([0.0, 0.5, 1.5, 4.0]), rng.choice([299, 313, 314, 480, 1310, 1400])) for t in range(24)]
    return nodes, edges, exposures, trips


@pytest.mark.parametrize("seed,cells", [(1, 0.0011), (2, 1.0)])
def test_ways_equal_a_plain_search_under_costs_that_change_by_the_minute(spark, seed, cells):
    nodes, edges, exposures, trips = drawn(seed)
    found = ways(spark, exposures, trips, cells, edges, nodes)
    some = 0
    for trip, start, goal, alpha, departure in trips:
        want = plain(nodes, edges, exposures, start, goal, alpha, departure)
        got = found.get(trip, [])
        assert [(r.src, r.node) for r in got] == [(w[0], w[1]) for w in want]
        assert [r.cost for r in got] == pytest.approx([w[4] for w in want]) and [r["index"] for r in got] == [w[5] for w in want]
        assert [r.seconds for r in got] == pytest.approx([w[3] for w in want])
        some += len(got) > 3
    assert some > 10


def test_departures_equal_searches_apart(spark):
    nodes, edges, exposures, trips = drawn(4, side=5)
    trips = [(*t[:4], d) for t, d in zip(trips[:8], [480, 485, 1300, 1180, 1320, 700, 600, 300], strict=True)]
    cell = F.concat_ws(":", F.floor(F.col("lon") / 0.001).cast("string"), F.floor(F.col("lat") / 0.001).cast("string"))
    asked = spark.createDataFrame(trips, "trip long, start long, goal long, alpha double, departure int")
    got = defaultdict(dict)
    for r in routing.departures(*frames(spark, nodes, edges, exposures), asked, cell).collect():
        got[r.trip][r.departure] = r
    length = {e[0]: e[5] for e in edges}
    for trip, start, goal, alpha, departure in trips:
        times = [m for m in range(departure, departure + 181, 15) if m <= 1320]
        want = {}
        for m in times if len(times) > 1 else ():
            hops = plain(nodes, edges, exposures, start, goal, alpha, m)
            total = sum(length[h[2]] for h in hops)
            if hops:
                want[m] = sum((h[5] or 0) * length[h[2]] for h in hops) / total if total else 0.0
        assert set(got[trip]) == set(want)
        if want:
            now, least = want[min(want)], min(want.values())
            assert {m: r["index"] for m, r in got[trip].items()} == pytest.approx(want)
            assert [m for m, r in sorted(got[trip].items()) if r.best] == [min(m for m in want if want[m] == least)]
            for r in got[trip].values():
                assert r.gain == math.floor(now - least + 0.5) and r.peak == pytest.approx(max(1, *want.values()))


def test_routes_of_empty_tables(spark):
    nodes, edges, exposures, _ = drawn(1, side=3)
    assert not ways(spark, exposures, [], edges=edges, nodes=nodes)
    assert not ways(spark, exposures, [(1, 0, 5, 0.0, 600)], edges=[], nodes=nodes)
