"""Streams of position fixes: keyed state that follows a route, and windows over events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import PLANE_LAT, PLANE_LON

#: Fixes whose offsets from all segments are made at once.
AT_ONCE = 2_000
OUT = "user_id long, fix_id long, along double, offset double, off_route boolean, announced int, bearing double, sunlight_in int, minutes double"
STATE = "hint int, progress double, said string, bearing double, lon double, lat double"
#: How far the search window reaches around the last place, tolerance for noise, distance off the route, announcements, warning of sunlight, the computed day.
BACK, AHEAD, NOISE, OFF_ROUTE, ANNOUNCE, WARN, DAY = 4, 25, 25.0, 35.0, (180, 60, 18), 30.0, (300.0, 1320.0)


class Route:
    """A polyline with its manoeuvres, and with the places where one steps from shade into sun (metres from the start)."""

    def __init__(self, lon: list[float], lat: list[float], manoeuvres: list[float], sunlit: list[float] = ()):
        self.lon, self.lat, self.manoeuvres, self.sunlit = np.array(lon), np.array(lat), sorted(manoeuvres), list(sunlit)
        scale = np.cos(np.radians((self.lat[1:] + self.lat[:-1]) / 2))
        self.length = np.hypot(np.diff(self.lon) * PLANE_LON * scale, np.diff(self.lat) * PLANE_LAT)
        self.start = np.append(0.0, np.cumsum(self.length)[:-1])

    def offsets(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each fix (row) and segment: metres along the route and metres off, at the nearest place of the segment."""
        east = np.array([PLANE_LON * math.cos(math.radians(v)) for v in lat])[:, None]
        lon, lat = lon[:, None], lat[:, None]
        ax, ay = (self.lon[:-1] - lon) * east, (self.lat[:-1] - lat) * PLANE_LAT
        bx, by = (self.lon[1:] - lon) * east, (self.lat[1:] - lat) * PLANE_LAT
        dx, dy = bx - ax, by - ay
        t = np.clip(-(ax * dx + ay * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0, 1)
        return self.start + t * self.length, np.hypot(ax + t * dx, ay + t * dy)

    def nearest(self, off: np.ndarray, hint: int | None) -> int:
        """The segment nearest among those around the last one (the first of equals)."""
        low, high = (0, len(off)) if hint is None else (max(0, hint - BACK), min(len(off), hint + AHEAD))
        return low + int(off[low:high].argmin())

    def snap(self, lon: float, lat: float, hint: int | None) -> tuple[float, float, int]:
        """Metres along, metres off, and the segment."""
        along, off = self.offsets(np.array([lon]), np.array([lat]))
        k = self.nearest(off[0], hint)
        return float(along[0, k]), float(off[0, k]), k

    def announcement(self, along: float, said: set[str]) -> int | None:
        """The first of the thresholds, from the farthest on, that is reached for the next manoeuvre, once each: after the farthest was said, nothing more is for this manoeuvre."""
        ahead = [(i, m) for i, m in enumerate(self.manoeuvres) if m > along + 8]
        i, at = ahead[0] if ahead else (len(self.manoeuvres) - 1, self.manoeuvres[-1])
        step = next((a for a in ANNOUNCE if max(0.0, at - along) <= a), None)
        if step is None or f"{i}:{step}" in said:
            return None
        said.update(f"{i}:{a}" for a in ANNOUNCE if a >= step)
        return step


    def warning(self, along: float, said: set[str]) -> int | None:
        """Metres, in fives, to the first place within ``WARN`` metres ahead where the sun begins, once for each place."""
        for k, at in enumerate(self.sunlit):
            if 0 <= at - along <= WARN and f"sun:{k}" not in said:
                said.add(f"sun:{k}")
                return math.floor((at - along) / 5 + 0.5) * 5
        return None


def heading_of(told: float | None, last: float | None, before: tuple[float, float] | None, here: tuple[float, float]) -> float | None:
    """The sensor's heading; at rest the last one; before there was any, the direction from the last fix."""
    if told is not None and math.isfinite(told):
        return told
    if last is not None or before is None:
        return last
    east = (here[0] - before[0]) * PLANE_LON * math.cos(math.radians((here[1] + before[1]) / 2))
    return (math.degrees(math.atan2(east, (here[1] - before[1]) * PLANE_LAT)) + 360) % 360


def advanced(progress: float | None, measured: float) -> float:
    """Progress never falls by noise; a larger step back is believed."""
    return measured if progress is None or measured > progress or progress - measured > NOISE else progress


def tracked(fixes: DataFrame, route: Route) -> DataFrame:
    """Fixes (user_id, fix_id, ts, lon, lat, and heading if there is one; a stream) followed along ``route``, one state for each user, in order of time within a batch.

    Off the route nothing is announced. ``minutes`` is the time of day that the fix is judged by, within the computed day.
    """
    fixes = fixes if "heading" in fixes.columns else fixes.withColumn("heading", F.lit(None).cast("double"))

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hint, progress, said, bearing, *place = state.get if state.exists else (None, None, "", None, None, None)
        known, before = set(filter(None, said.split(","))), None if place[0] is None else tuple(place)
        rows = []
        fixes = pd.concat(list(frames)).sort_values(["ts", "fix_id"])
        for at in range(0, len(fixes), AT_ONCE):
            part = fixes.iloc[at : at + AT_ONCE]
            lon, lat, clock = part["lon"].to_numpy(np.float64), part["lat"].to_numpy(np.float64), part["ts"].dt
            minutes = np.minimum(np.maximum(clock.hour * 60 + clock.minute + clock.second / 60, DAY[0]), DAY[1]).tolist()
            along, offs = route.offsets(lon, lat)
            for n, (fix, east, north, heading) in enumerate(zip(part["fix_id"].tolist(), lon.tolist(), lat.tolist(), part["heading"].tolist(), strict=True)):
                hint = route.nearest(offs[n], hint)
                measured, off = float(along[n, hint]), float(offs[n, hint])
                progress, on = advanced(progress, measured), off <= OFF_ROUTE
                bearing = heading_of(None if heading is None or heading != heading else float(heading), bearing, before, (east, north))
                before = (east, north)
                rows.append((key[0], fix, progress, off, not on, route.announcement(progress, known) if on else None, bearing, route.warning(progress, known) if on else None, minutes[n]))
        state.update((hint, progress, ",".join(sorted(known)), bearing, *before))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        yield out.astype({"announced": "Int32", "sunlight_in": "Int32", "bearing": "Float64"})

    return fixes.groupBy("user_id").applyInPandasWithState(follow, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in event-time windows; what comes later than ``late`` is left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drained(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote below ``folder``."""
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")
