"""Rays over a grid, walked in tiles: a task holds the cells of one tile with a margin as wide as its rays are long.

Points go to the tile that they lie in, cells to every tile whose margin they are in, so what is shuffled grows with points
plus cells, not with their rays. A tile with many points is dealt to several tasks by a hash of the key, each with the same
cells: none has many more than ``at_once`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 16
_CELL = ["row", "col", "ground", "surface", "canopy_top", "canopy_base", "canopy_k"]


@dataclass(frozen=True)
class Sun:
    """Where the sun stands, and by what the heights of buildings are multiplied under it."""

    azimuth: float
    altitude: float
    scale: float = 1.0


class Frame:
    """The cells of one tile and its margin as arrays; a cell that the grid lacks holds nothing."""

    def __init__(self, cells: pd.DataFrame, row0: int, col0: int, side: int, res: float):
        self.row0, self.col0, self.side, self.res = row0, col0, side, res
        at = (cells["row"].to_numpy(np.int64) - row0) * side + cells["col"].to_numpy(np.int64) - col0
        self.ground, self.surface, self.top, self.base = (np.full(side * side, empty) for empty in (0.0, -np.inf, -np.inf, np.inf))
        self.k = np.zeros(side * side)
        for array, name in ((self.ground, "ground"), (self.surface, "surface"), (self.top, "canopy_top"), (self.base, "canopy_base"), (self.k, "canopy_k")):
            array[at] = cells[name].to_numpy(np.float64)

    def built(self, scale: float) -> np.ndarray:
        return self.surface if scale == 1.0 else self.ground + (self.surface - self.ground) * scale

    def at(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the arrays, and which points have one. Coordinates are cut towards zero, as those of the grid are."""
        row, col = np.trunc(y / self.res) - self.row0, np.trunc(x / self.res) - self.col0
        held = (row >= 0) & (col >= 0) & (row < self.side) & (col < self.side)
        return np.where(held, row * self.side + col, 0).astype(np.int64), held


def leafage(k: np.ndarray, metres: float) -> np.ndarray:
    """Foliage along a step in whole millionths, so that sums do not depend on their order."""
    return np.floor(k * metres * 1e6 + 0.5).astype(np.int64)


def in_tiles(points: DataFrame, surface: DataFrame, grid, reach: float, walk: Callable[[pd.DataFrame, Frame], pd.DataFrame], schema: T.StructType, tile: int = 256, at_once: int = 8_192) -> DataFrame:
    """``walk`` over the points (key, x, y, eye) of each tile and the cells within ``reach`` metres of it."""
    margin, res = math.ceil(reach / grid.res) + 2, grid.res
    tile_of = lambda metres: F.floor(metres / res / tile).cast("long")
    placed = points.select("key", "x", "y", "eye", tile_of(F.col("y")).alias("tr"), tile_of(F.col("x")).alias("tc"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    parts = placed.groupBy("tr", "tc").agg(F.ceil(F.count("*") / at_once).cast("long").alias("parts"))
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    same = lambda a, b, *names: a.join(b, [a[n].eqNullSafe(b[n]) for n in names]).drop(*[b[n] for n in names])
    dealt = same(placed, salted, "tr", "tc", "salt").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts"))).select("key", "x", "y", "eye", "tr", "tc", "part")
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile)))
    around = surface.select(*_CELL).withColumn("tr", near("row")).withColumn("tc", near("col"))
    cells = around.join(parts, ["tr", "tc"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    side = tile + 2 * margin

    def task(key: tuple, some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if some.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        row, col = (0 if k is None or k != k else int(k) for k in key[:2])
        return walk(some, Frame(held, row * tile - margin, col * tile - margin, side, res))

    by = ("tr", "tc", "part")
    return dealt.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(task, schema)


def sunlit(points: DataFrame, surface: DataFrame, grid, suns: Iterable[Sun], far: float = 450.0, **dealing: int) -> DataFrame:
    """(key, cut, depth) of points (key, x, y, eye): for each sun whether a surface is above the ray, and else the foliage it crosses in millionths.

    Every point is walked towards every sun; rays end where they are above all that the tile holds. Under a sun that is not
    up everything is cut.
    """
    suns, step = list(suns), grid.res * 0.8
    schema = T.StructType([points.schema["key"], T.StructField("cut", T.ArrayType(T.BooleanType())), T.StructField("depth", T.ArrayType(T.LongType()))])

    def walk(some: pd.DataFrame, frame: Frame) -> pd.DataFrame:
        x, y, eye = (some[c].to_numpy(np.float64) for c in ("x", "y", "eye"))
        cut, depth = np.zeros((len(some), len(suns)), bool), np.zeros((len(some), len(suns)), np.int64)
        leaves = leafage(frame.k, step)
        for s, sun in enumerate(suns):
            if sun.altitude <= 0:
                cut[:, s] = True
                continue
            built, rise = frame.built(sun.scale), math.tan(sun.altitude) * step
            dx, dy = math.sin(sun.azimuth) * step, math.cos(sun.azimuth) * step
            highest = max(built.max(), frame.top.max())
            count = np.minimum(float(far // step), np.floor((highest - eye) / rise)) if highest > -np.inf else np.zeros(len(some))
            live, k = np.flatnonzero(count >= 1), 1
            while live.size:
                place, held = frame.at(x[live] + dx * k, y[live] + dy * k)
                ray = eye[live] + k * rise
                wall = held & (built[place] > ray)
                through = held & (frame.top[place] > ray) & (frame.base[place] < ray)
                depth[live, s] += np.where(through, leaves[place], 0)
                cut[live[wall], s] = True
                k += 1
                live = live[~wall & (count[live] >= k)]
        return pd.DataFrame({"key": some["key"], "cut": list(cut), "depth": list(depth)})

    return in_tiles(points, surface, grid, far, walk, schema, **dealing)


def skyline(points: DataFrame, surface: DataFrame, grid, azimuths: int, radius: float, **dealing: int) -> DataFrame:
    """(key, built, green, leaf) of points (key, x, y, eye): in each direction the largest tangent of surfaces and of crowns above the eye, and the foliage above it in millionths."""
    res, steps = grid.res, int(radius // grid.res)
    doubles, longs = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
    schema = T.StructType([points.schema["key"], T.StructField("built", doubles), T.StructField("green", doubles), T.StructField("leaf", longs)])

    def walk(some: pd.DataFrame, frame: Frame) -> pd.DataFrame:
        x, y, eye = (some[c].to_numpy(np.float64) for c in ("x", "y", "eye"))
        built, green, leaf = (np.zeros((len(some), azimuths), t) for t in (np.float64, np.float64, np.int64))
        leaves = leafage(frame.k, res)
        for a in range(azimuths):
            angle = a * (2 * math.pi / azimuths)
            dx, dy = math.sin(angle) * res, math.cos(angle) * res
            for k in range(1, steps + 1):
                place, held = frame.at(x + dx * k, y + dy * k)
                d, top = k * res, frame.top[place]
                built[:, a] = np.fmax(built[:, a], np.where(held, (frame.surface[place] - eye) / d, 0.0))
                green[:, a] = np.fmax(green[:, a], np.where(held, (top - eye) / d, 0.0))
                leaf[:, a] += np.where(held & (top > eye), leaves[place], 0)
        return pd.DataFrame({"key": some["key"], "built": list(built), "green": list(green), "leaf": list(leaf)})

    return in_tiles(points, surface, grid, radius, walk, schema, **dealing)
