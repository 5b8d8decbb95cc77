"""Segments of streets, the distance transform, local time and resumed cells."""

from __future__ import annotations

import datetime
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lightwalk.functions import astro
from lightwalk.operators import raster
from lightwalk.plans import streets
from lightwalk.sources import storage

WAY = "way_id long, highway string, foot string, access string, service string, tunnel string, covered string, indoor string, footway string, crossing string, width string, name string, sidewalk string, line array<struct<x:double,y:double>>"


def way(i, line, highway="residential", footway=None, name=None, sidewalk=None, **tags):
    rest = {k: tags.get(k) for k in ("foot", "access", "service", "tunnel", "covered", "indoor")}
    return (i, highway, *rest.values(), footway, None, None, name, sidewalk, line)


def drawn(seed):
    """Straight streets of multiples of four metres, some with mapped sidewalks on one side or both, some with declared ones."""
    rng, rows = random.Random(seed), []
    for i in range(30):
        x, y, length = 200.0 * (i % 6), 200.0 * (i // 6), 4.0 * rng.randrange(6, 30)
        turn = rng.random() < 0.5
        at = lambda a, b, x=x, y=y, turn=turn: (x + b, y + a) if turn else (x + a, y + b)
        rows.append(way(i, [at(0.0, 0.0), at(length, 0.0)], name=f"Rue {i}", sidewalk=rng.choice([None, None, None, "left", "right", "both", "separate"])))
        for k, side in enumerate(rng.choice([(), (), (1,), (-1,), (1, -1)])):
            rows.append(way(100 + 2 * i + k, [at(0.0, 6.0 * side), at(length, 6.0 * side)], "footway", "sidewalk"))
    return rows


def test_ra14_reversing_every_way_swaps_the_sides(spark):
    rows = drawn(3)
    swapped = {"left": "right", "right": "left"}
    back = [(*r[:-2], swapped.get(r[-2], r[-2]), r[-1][::-1]) for r in rows]
    a, b = ({r.way_id: r for r in streets.segments(spark.createDataFrame(x, WAY)).collect()} for x in (rows, back))
    assert set(a) == set(b) and len(a) < len(rows)  # doubled axes go, the same ones
    for i, r in a.items():
        other = b[i]
        assert (r.metres, r.samples, r.shared, r.halved, r.name) == (other.metres, other.samples, other.shared, other.halved, other.name)
        if r.shared and not r.halved:  # no roadway: one side, which is the left one of the way it is drawn
            assert r.left_side and r.right_side is None
        else:
            assert (r.left_side, r.right_side) == (other.right_side, other.left_side)
    counts = [(sum(r.left_side is not None for r in x.values() if r.halved), sum(r.right_side is not None for r in x.values() if r.halved)) for x in (a, b)]
    assert counts[0] == counts[1][::-1] and min(counts[0]) > 0
    assert sum(not r.shared for r in a.values()) > 0


def test_ra14_keeps_the_side_that_is_not_mapped(spark):
    rows = [
        way(1, [(0.0, 0.0), (60.0, 0.0)], name="Rue A"), way(2, [(0.0, 6.0), (60.0, 6.0)], "footway", "sidewalk"),  # a sidewalk on the left
        way(3, [(0.0, 300.0), (60.0, 300.0)], name="Rue B", sidewalk="separate"), way(4, [(0.0, 600.0), (20.0, 600.0), (40.0, 600.0), (70.0, 600.0)], name="Rue C"),
        way(5, [(0.0, 900.0), (0.05, 900.0)], name="sliver"), way(6, [(0.0, 950.0), (30.0, 950.0)], foot="no"), way(7, [(0.0, 990.0), (1.0, 990.0)], "steps", covered="yes"),
    ]
    got = {(r.way_id, r.piece): r for r in streets.segments(spark.createDataFrame(rows, WAY)).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 0), (4, 1), (7, 0)}
    assert (got[1, 0].left_side, got[1, 0].right_side, got[1, 0].halved, got[1, 0].shared) == (None, "sud", True, True)
    assert got[2, 0].name == "Rue A" and got[2, 0].shared and not got[2, 0].halved
    assert [got[4, k].metres for k in (0, 1)] == [40.0, 30.0] and (got[4, 0].left_side, got[4, 0].right_side) == ("nord", "sud")
    assert got[7, 0].samples == 1 and got[7, 0].cover == 1


def test_w14_distances_equal_two_sweeps_at_any_distance(spark):
    rng, height, width = random.Random(14), 50, 90
    farthest, masks = 0, [{(3, 4), (3, 5), (44, 80)}, {(rng.randrange(height), rng.randrange(width)) for _ in range(6)}]
    for mask in masks:
        d = [[0 if (r, c) in mask else 1 << 28 for c in range(width)] for r in range(height)]
        for rows, cols, s in ((range(height), range(width), -1), (range(height - 1, -1, -1), range(width - 1, -1, -1), 1)):
            for r in rows:
                for c in cols:
                    for dr, dc, cost in ((0, s, 3), (s, 0, 3), (s, s, 4), (s, -s, 4)):
                        if 0 <= r + dr < height and 0 <= c + dc < width:
                            d[r][c] = min(d[r][c], d[r + dr][c + dc] + cost)
        cells = spark.createDataFrame([(r, c, (r, c) in mask) for r in range(height) for c in range(width)], "row int, col int, edge boolean")
        got = {(r.row, r.col): r.d for r in raster.chamfer(cells, "edge").collect()}
        assert got == {(r, c): d[r][c] for r in range(height) for c in range(width)}
        farthest = max(farthest, *got.values())
    assert farthest > 120  # some lie forty cells off
    bare = cells.where("not edge")
    assert {r.d for r in raster.chamfer(bare, "edge").collect()} == {None} and raster.chamfer(bare.where("false"), "edge").count() == 0
    one = raster.chamfer(cells.where(F.expr("(row, col) in ((3, 7), (9, 9))")).withColumn("edge", F.col("row") == 3), "edge")
    assert {(r.row, r.col): r.d for r in one.collect()} == {(3, 7): 0, (9, 9): 4 * 2 + 3 * 4}


def test_m3_clock_times_become_instants_also_around_the_change(spark):
    paris = ZoneInfo("Europe/Paris")
    walls = [datetime.datetime(2024, m, d, h, n) for m, d in ((1, 15), (3, 30), (3, 31), (7, 1), (10, 27), (12, 31)) for h in (0, 1, 2, 3, 12, 23) for n in (0, 30, 59)]
    seconds = [int(w.replace(tzinfo=datetime.UTC).timestamp()) for w in walls]
    rows = spark.createDataFrame([(s,) for s in seconds], "s long").select("s", astro.local_to_utc(F.col("s"), "Europe/Paris").alias("u"), astro.offset_minutes(F.col("s"), "Europe/Paris").alias("o"))
    offset = lambda u: datetime.datetime.fromtimestamp(u, paris).utcoffset().total_seconds() / 60
    for r in rows.collect():
        guess = r.s
        for _ in range(3):
            guess = r.s - int(offset(guess)) * 60
        assert (r.u, r.o) == (guess, offset(r.s))


def test_snk6_a_run_that_was_killed_goes_on_and_ends_as_an_unbroken_one(spark, tmp_path):
    cells = spark.createDataFrame([(f"12-{k:03d}",) for k in range(10)], "cell string")
    made: list[list[str]] = []

    def compute(fail=(), die_after=None):
        def run(some):
            keys = sorted(r.cell for r in some.collect())
            if die_after is not None and len(made) >= die_after:
                raise KeyboardInterrupt
            made.append(keys)
            if set(keys) & set(fail):
                raise ValueError("broken")
            return some.select("cell", F.explode(F.sequence(F.lit(1), F.length("cell"))).alias("v"))

        return run

    def run(folder, date="2024-07-01", **how):
        made.clear()
        return storage.build_by_cell(cells, "cell", date, compute(**how), f"file://{tmp_path}/{folder}", f"file://{tmp_path}/{folder}-manifest", at_once=4)

    read = lambda folder: sorted(tuple(r) for r in spark.read.schema("v int, cell string").parquet(f"{tmp_path}/{folder}").collect())
    whole = run("whole")
    assert {(r.cell, r.status, r.rows) for r in whole.collect()} == {(f"12-{k:03d}", "ok", 6) for k in range(10)} and [len(k) for k in made] == [4, 4, 2]
    with pytest.raises(KeyboardInterrupt):
        run("killed", die_after=1)
    assert len(read("killed")) == 24
    again = run("killed")
    assert [len(k) for k in made] == [4, 2]  # what was done is not done again
    assert read("killed") == read("whole") and {r.status for r in again.collect()} == {"ok"}
    broken = {r.cell: r.status for r in run("broken", fail=("12-005",)).collect()}
    assert [c for c, s in broken.items() if s != "ok"] == ["12-005"] and len(broken) == 10  # its companions are there
    run("broken")
    assert made == [["12-005"]] and read("broken") == read("whole")
    run("whole", date="2024-07-02")
    assert [len(k) for k in made] == [4, 4, 2] and read("killed") == read("whole")  # another day: all of them, in place of the old ones
