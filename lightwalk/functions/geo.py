"""Geography: a local metric plane, slippy tiles, bearings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per degree of the query plane.
PLANE_LON, PLANE_LAT = 111320.0, 111132.0


def metres_per_degree(lat: float) -> tuple[float, float]:
    """Of longitude and of latitude, by the usual series. Fixed values."""
    phi = math.radians(lat)
    lon_m = 111412.84 * math.cos(phi) - 93.5 * math.cos(3 * phi) + 0.118 * math.cos(5 * phi)
    lat_m = 111132.92 - 559.82 * math.cos(2 * phi) + 1.175 * math.cos(4 * phi) - 0.0023 * math.cos(6 * phi)
    return lon_m, lat_m


class Plane:
    """Metres east and north of a bounding box's south-west corner, at the scale of its middle."""

    def __init__(self, west: float, south: float, east: float, north: float):
        self.west, self.south, self.east, self.north = west, south, east, north
        self.lon_m, self.lat_m = metres_per_degree((south + north) / 2)

    def x(self, lon: Column) -> Column:
        return (lon - self.west) * self.lon_m

    def y(self, lat: Column) -> Column:
        return (lat - self.south) * self.lat_m

    def padded(self, metres: float) -> tuple[float, float, float, float]:
        d_lon, d_lat = metres / self.lon_m, metres / self.lat_m
        return self.west - d_lon, self.south - d_lat, self.east + d_lon, self.north + d_lat


def flat_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the query plane at the middle latitude."""
    scale = F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot((lon2 - lon1) * PLANE_LON * scale, (lat2 - lat1) * PLANE_LAT)


def tile_x(lon: Column, zoom: Column) -> Column:
    side = F.pow(F.lit(2.0), zoom)
    return F.greatest(F.lit(0), F.least(side - 1, F.floor((lon + 180) / 360 * side))).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    side, rad = F.pow(F.lit(2.0), zoom), F.radians(lat)
    y = F.floor((1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * side)
    return F.greatest(F.lit(0), F.least(side - 1, y)).cast("long")


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees from north, clockwise, 0 to 360."""
    east = (lon2 - lon1) * PLANE_LON * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(east, (lat2 - lat1) * PLANE_LAT)) + 360, F.lit(360.0))


def turn(to: Column, since: Column) -> Column:
    """Signed degrees from one bearing to another, -180 to 180."""
    return F.pmod(to - since + 540, F.lit(360.0)) - 180


def turn_kind(delta: Column, threshold: float = 28.0) -> Column:
    size, right = F.abs(delta), delta > 0
    side = F.when(right, "right").otherwise("left")
    return F.when(size < threshold, "straight").when(size < 55, F.concat(F.lit("slight_"), side)).when(size < 135, side).otherwise(F.concat(F.lit("sharp_"), side))


def tile_west(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def tile_north(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh((1 - y / F.pow(F.lit(2.0), zoom) * 2) * math.pi)))


def cell_key(zoom: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("-", zoom.cast("string"), x.cast("string"), y.cast("string"))
