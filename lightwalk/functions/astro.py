"""Sun and clear sky as Column expressions. Numbers are fixed values of the published formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import clamp

EXTRATERRESTRIAL_LUX = 133300.0
TURBIDITY = 4.0


def offset_minutes(utc: Column, zone: str) -> Column:
    """Minutes by which a zone's clocks are ahead at an instant (seconds since 1970)."""
    return (F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(utc), zone)) - utc) / 60


def local_to_utc(wall: Column, zone: str) -> Column:
    """The instant (seconds) at which a zone's clocks show a time, given as the seconds that it would be in UTC.

    The offset depends on the instant, which is found by three rounds: of an hour that is shown twice the later one, as is
    what they settle on.
    """
    guess = wall
    for _ in range(3):
        guess = wall - (offset_minutes(guess, zone) * 60).cast("long")
    return guess


def sun_position(epoch_ms: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Altitude and azimuth (from north, clockwise) in radians; low-precision almanac."""
    days = epoch_ms / 86400000.0 + 2440587.5 - 2451545.0
    mean = F.radians(280.46 + days * 0.9856474)
    anomaly = F.radians(357.528 + days * 0.9856003)
    ecliptic = mean + F.radians(F.sin(anomaly) * 1.915 + F.sin(anomaly * 2) * 0.02)
    tilt = F.radians(23.439 - days * 0.0000004)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = (days * 24.06570982441908 + 18.697374558) % 24
    hour = F.radians(sidereal * 15 + lon) - ascension
    phi = F.radians(lat)
    up = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour)
    east = -F.sin(hour) * F.cos(declination)
    north = F.sin(declination) * F.cos(phi) - F.cos(declination) * F.sin(phi) * F.cos(hour)
    return F.asin(clamp(up, -1.0, 1.0)), (F.atan2(east, north) + 2 * math.pi) % (2 * math.pi)


def refracted(altitude: Column) -> Column:
    """Apparent altitude; left alone from a degree below the horizon."""
    h = F.degrees(altitude)
    lift = F.lit(1.02) / F.tan(F.radians(h + F.lit(10.3) / (h + 5.11))) / 60
    return F.when(h < -1, altitude).otherwise(F.radians(h + lift))


def air_mass(degrees: Column) -> Column:
    h = F.greatest(degrees, F.lit(-0.5))
    return 1 / (F.sin(F.radians(h)) + F.pow(h + 6.07995, F.lit(-1.6364)) * 0.50572)


def rayleigh_thickness(m: Column) -> Column:
    inverse = m * 1.7513 + 6.6296 - m * m * 0.1202 + m * m * m * 0.0065 - m * m * m * m * 0.00013
    return F.when(m > 20, 1 / (m * 0.718 + 10.4)).when(inverse > 0, 1 / inverse).otherwise(0.1)


def clear_sky(altitude: Column, turbidity: float = TURBIDITY) -> tuple[Column, Column]:
    """Illuminance: direct normal and diffuse horizontal, in lux."""
    m = air_mass(F.degrees(altitude))
    direct = F.exp(m * rayleigh_thickness(m) * (-0.8662 * turbidity)) * EXTRATERRESTRIAL_LUX
    diffuse = (F.pow(F.greatest(F.sin(altitude), F.lit(0.01)), F.lit(0.6)) * 13500 + 400) * (0.55 + 0.45 * (turbidity / TURBIDITY))
    up = altitude > 0
    return F.when(up, direct).otherwise(0.0), F.when(up, diffuse).otherwise(0.0)


def linke_turbidity(direct_lux: Column, altitude: Column) -> Column:
    m = air_mass(F.degrees(altitude))
    depth = m * rayleigh_thickness(m) * 0.8662
    known = (direct_lux > 0) & (altitude > 0) & (depth > 0)
    return F.when(known, clamp(-F.ln(direct_lux / EXTRATERRESTRIAL_LUX) / depth, 1.5, 8.0)).otherwise(TURBIDITY)


def perez(direct: Column, diffuse: Column, altitude: Column) -> tuple[Column, Column]:
    """Clearness and brightness of the sky."""
    zenith = F.greatest(F.lit(0.0), math.pi / 2 - altitude)
    cube = zenith * zenith * zenith * 1.041
    base = F.greatest(F.lit(1.0), diffuse)
    clearness = ((base + F.greatest(F.lit(0.0), direct)) / base + cube) / (1 + cube)
    m = F.when(altitude > 0, air_mass(F.degrees(altitude))).otherwise(40.0)
    return clearness, base * m / EXTRATERRESTRIAL_LUX
