"""Cells on demand, and the choice of a measured or a drawn surface."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from lightwalk.operators import raster
from lightwalk.plans import suns
from lightwalk.sources.region import Region, write_region

BOXES = [(f"c{i}", i << 16, 2.0 + i * 0.1, 48.8, 2.1 + i * 0.1, 48.9) for i in range(5)]


@pytest.fixture()
def region(spark, tmp_path):
    cells = spark.createDataFrame(BOXES, "cell_key string, id_base long, west double, south double, east double, north double")
    rows = spark.range(40).select((F.col("id") % 10).alias("local"), F.concat(F.lit("way "), "id").alias("name"), F.concat(F.lit("c"), F.floor(F.col("id") / 10)).alias("cell_key"))
    write_region(rows, cells, f"file://{tmp_path}/r", "2024-01-10")
    return Region(spark, f"file://{tmp_path}/r", "local long, name string"), f"{tmp_path}/r"


def test_only_cells_of_the_window_are_read(region):
    found, _ = region
    assert {r.cell_key for r in found.cells_in(2.05, 48.85, 2.15, 48.86).collect()} == {"c0", "c1"}
    assert {r.cell_key for r in found.cells_in(2.1, 48.9, 2.1, 49.0).collect()} == {"c0", "c1"}  # touching counts
    rows, failed = found.read(found.cells_in(2.05, 48.85, 2.15, 48.86))
    assert {r.id for r in rows.collect()} == {*range(10), *range(65536, 65546)} and failed.count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell_key" in plan and "c2" not in plan
    empty, failed = found.read(found.cells_in(2.45, 48.85, 2.46, 48.86))  # declared, without rows
    assert empty.count() == 0 and failed.count() == 0


def test_a_broken_cell_is_told_and_leaves_the_others(region):
    found, folder = region
    for path in glob.glob(f"{folder}/cells/cell_key=c1/*.parquet"):
        os.remove(os.path.join(os.path.dirname(path), "." + os.path.basename(path) + ".crc"))
        with open(path, "r+b") as f:
            f.seek(0)
            f.write(b"\0" * os.path.getsize(path))
    for path in glob.glob(f"{folder}/cells/cell_key=c2/*.parquet"):
        os.remove(path)
    rows, failed = found.read(found.index())
    assert {r.cell_key: (r.declared, r.found) for r in failed.collect()} == {"c1": (10, 0), "c2": (10, 0)}
    assert {r.cell_key for r in rows.collect()} == {"c0", "c3"} and rows.count() == 20
    ids = found.spark.createDataFrame([(3,), (65537,), (3 * 65536 + 9,), (99 << 16,)], "id long")
    at = {r.id: (r.declared, r.row.name if r.row else None) for r in found.at(ids).collect()}
    assert at == {3: (True, "way 3"), 65537: (True, None), 3 * 65536 + 9: (True, "way 39"), 99 << 16: (False, None)}


def test_a_region_that_is_not_there_is_empty(spark, tmp_path):
    none = Region(spark, f"file://{tmp_path}/none", "local long, name string")
    rows, failed = none.read(none.index())
    assert none.index().count() == rows.count() == failed.count() == 0


def test_ra7_chooses_block_by_block(spark):
    """Three blocks of four by four cells: covered but for a cell, with holes, and empty; a fourth that only the probe finds empty."""
    cells = [(r, c) for r in range(4) for c in range(16)]
    drawn = spark.createDataFrame([(r, c, 30.0, 36.0, 0.0, 0.0, 0.0) for r, c in cells], "row int, col int, ground double, surface double, canopy_top double, canopy_base double, canopy_k double")
    measured = {(r, c) for r, c in cells if (c < 4 and (r, c) != (1, 1)) or (4 <= c < 8 and r < 2) or (r, c) in {(0, 12), (0, 13)}}
    scan = spark.createDataFrame([(r, c, 31.0 + r * 4, r * 4.0) if (r, c) in measured else (r, c, None, None) for r, c in cells], "row int, col int, top double, above double")
    built = spark.createDataFrame([(3, 0)], "row int, col int")
    found = raster.measured_or_drawn(scan, drawn, built, 4, probe=2, least=0.02, whole=0.9).collect()
    got = {(r.row, r.col): r for r in found}
    assert len(found) == 64 and {c // 4: r.model for (_, c), r in got.items()} == {0: "measured", 1: "both", 2: "vectors", 3: "vectors"}
    assert (got[3, 0].ground, got[3, 0].surface, got[3, 0].canopy_top) == (31.0, 43.0, 0.0)  # a roof
    crown = got[3, 1]
    assert (crown.surface, crown.canopy_top, round(crown.canopy_base, 6), crown.canopy_k) == (31.0, 43.0, 35.2, 0.265)
    assert (got[0, 0].surface, got[0, 0].canopy_top) == (31.0, 0.0)
    assert got[1, 1].surface == 0.0 and got[3, 5].surface == got[0, 9].surface == got[0, 12].surface == 36.0
    assert (got[1, 5].surface, got[1, 5].canopy_top) == (31.0, 35.0)


def test_widened_is_a_square(spark):
    mask = spark.createDataFrame([(0, 0), (5, 5)], "row int, col int")
    got = {(r.row, r.col) for r in raster.widened(mask, raster.Grid(1.0, 8, 8), 2.0).collect()}
    assert got == {(r, c) for r in range(8) for c in range(8) if max(r, c) <= 2 or max(abs(r - 5), abs(c - 5)) <= 2}


def test_low_suns_are_left_out(spark):
    import datetime

    winter = suns.positions(spark, datetime.date(2024, 1, 30), [0, 500, 510, 780, 1080, 1260])
    assert set(winter) == {780} | {m for m in (510,) if m in winter} and abs(winter[780][0] - 3.14159) < 0.1
    assert all(altitude > suns.LOW for _, altitude in winter.values())
