"""The exposure model: from stored physics, sun and weather to an index of 0 to 100, as Column expressions.

Numbers are fixed values of the model.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sky as sky_tables
from . import astro
from .num import clamp, finite, half_up, piecewise

WEIGHTS = {"sun": 0.34, "sky": 0.18, "bright": 0.16, "reverb": 0.14, "glare": 0.10, "flicker": 0.08}
EYE = 1.6  # metres
LUX_REFERENCE, WALL_ALBEDO, GROUND_ALBEDO = 90000.0, 0.45, 0.18
SKY_SATURATION, MAX_DIFFUSE, REVERB_SATURATION, GLARE_SATURATION, VEIL_SATURATION = 25000.0, 45000.0, 8000.0, 128000.0, 2.5
BEAM_EFFICACY, DIFFUSE_EFFICACY = 105.0, 120.0
BEAM_COLOUR = [(0, 1900), (2, 2400), (5, 2900), (10, 3600), (20, 4600), (30, 5100), (50, 5600), (90, 5800)]
LAMP_MELANOPIC = [(1800, 0.19), (2000, 0.24), (2700, 0.45), (3000, 0.53), (3500, 0.63), (4000, 0.72), (5000, 0.87), (6500, 1.1)]
DAYLIGHT_MELANOPIC = [(4000, 0.68), (5000, 0.83), (5500, 0.9), (6500, 1.0), (7500, 1.11), (10000, 1.29), (15000, 1.45), (25000, 1.58)]
UV_DIRECT = [(0, 0.02), (10, 0.15), (20, 0.27), (30, 0.35), (45, 0.43), (60, 0.48), (90, 0.52)]
LEVELS = [(0, "Abrité"), (20, "Ombragé"), (40, "Modéré"), (60, "Exposé"), (80, "Très exposé"), (100, "Plein soleil")]
UV_LEVELS = [(3, "faible"), (6, "modéré"), (8, "fort"), (11, "très fort")]

zero, one = lambda: F.lit(0.0), lambda: F.lit(1.0)


def wetness(rain_mm: Column) -> Column:
    return F.when(finite(rain_mm) & (rain_mm > 0), F.least(one(), F.pow(rain_mm, F.lit(0.4)))).otherwise(0.0)


def sky_conditions(altitude: Column, cloud: Column, beam: Column, diffuse: Column) -> dict[str, Column]:
    """Light of the sky: measured where there is a beam, else the clear sky dimmed by cloud."""
    up = F.greatest(F.sin(altitude), zero())
    measured = finite(beam)
    m_direct = F.greatest(zero(), beam) * BEAM_EFFICACY
    m_diffuse = F.least(F.lit(MAX_DIFFUSE), F.greatest(zero(), F.coalesce(diffuse, zero())) * DIFFUSE_EFFICACY)
    clear_direct, clear_diffuse = astro.clear_sky(altitude)
    c = clamp(F.coalesce(cloud, zero()), 0.0, 1.0)
    clear_global = clear_direct * up + clear_diffuse
    c_direct = clear_direct * F.pow(1 - c, F.lit(1.5))
    c_diffuse = F.least(F.lit(MAX_DIFFUSE), F.greatest(zero(), clear_global * (1 - F.pow(c, F.lit(3.4)) * 0.75) - c_direct * up))
    direct, spread = F.when(measured, m_direct).otherwise(c_direct), F.when(measured, m_diffuse).otherwise(c_diffuse)
    whole = F.when(measured, m_direct * up + m_diffuse).otherwise(clear_global)
    epsilon, brightness = astro.perez(direct, spread, altitude)
    return {"direct": direct, "diffuse": spread, "up": up, "share": F.when(whole > 0, direct * up / whole).otherwise(0.0), "measured": measured, "epsilon": epsilon, "brightness": brightness}


def horizon_at(horizon: Column, azimuth: Column) -> Column:
    """Height of the horizon (degrees in the array) towards an azimuth, in radians, between the two nearest bins."""
    n = F.size(horizon)
    place = F.pmod(azimuth / (2 * math.pi) * n, n.cast("double"))
    i = F.floor(place).cast("int")
    low, high = F.get(horizon, i), F.get(horizon, (i + 1) % n)
    return F.radians(low + (high - low) * (place - i))


def walls_of(horizon: Column) -> Column:
    """What the façade of each bin is at any instant: its share of the view, the tangent of its height, and the height (degrees) of the one across, seen from its middle."""
    n = F.size(horizon)

    def wall(h: Column, i: Column) -> Column:
        beta = F.radians(h.cast("double"))
        across = F.get(horizon, ((i + F.floor(n / 2)) % n).cast("int")).cast("double")
        return F.struct((1 - F.cos(beta) * F.cos(beta)).alias("share"), F.tan(beta).alias("tan"), F.degrees(F.atan(F.tan(F.radians(across)) / 2)).alias("across"))

    return F.transform(horizon, wall)


def reverberation(walls: Column, toward: Column, altitude: Column, facing: Column, direct: Column, diffuse: Column, wall: Column | None = None, albedo: float = WALL_ALBEDO) -> Column:
    """struct(view, lux, sunlit): sums over the façades all around (``walls``: see ``walls_of``).

    ``toward``: tangent of the horizon below the sun; ``facing``: how much each wall faces the sun, of the instant alone;
    ``wall``: the instant's table of upright surfaces, without which a wall sees half an even sky.
    """
    sun, beam = F.when(altitude > 0, F.tan(altitude)).otherwise(0.0), direct * F.cos(altitude)

    def add(sums: Column, i: Column) -> Column:
        w, towards = F.get(walls, i), F.get(facing, i)
        half = F.cos(F.radians(w.across))
        reach = half * half * 0.5 if wall is None else sky_tables.wall_factor(wall, i, w.across)
        lit = F.when((towards > 0) & (altitude > 0) & (w.tan > 0), clamp(1 - F.greatest(zero(), toward - sun / F.greatest(towards, F.lit(0.05))) / w.tan, 0.0, 1.0)).otherwise(0.0)
        light = (reach * diffuse + F.when(lit > 0, beam * towards * lit).otherwise(0.0)) * albedo
        return F.struct((sums.view + w.share).alias("view"), (sums.lux + w.share * light).alias("lux"), (sums.sunlit + w.share * lit).alias("sunlit"))

    none = F.struct(zero().alias("view"), zero().alias("lux"), zero().alias("sunlit"))
    return F.aggregate(F.sequence(F.lit(0), F.size(walls) - 1), none, add)


def melanopic(direct: Column, diffuse: Column, altitude: Column, share: Column) -> Column:
    beam, sky = piecewise(F.degrees(altitude), BEAM_COLOUR), clamp(share, 0.0, 1.0) * 9500 + 6500
    return F.greatest(zero(), direct) * piecewise(beam, DAYLIGHT_MELANOPIC) + F.greatest(zero(), diffuse) * piecewise(sky, DAYLIGHT_MELANOPIC)


def position_index(degrees: Column) -> Column:
    s = clamp(degrees, 0.0, 80.0)
    return F.exp(s * 0.03398 + s * s * 0.00021)


def _glare_peak() -> float:
    """The largest glare load of a clear sky, on quarter degrees."""

    def load(deg: float) -> float:
        m = 1 / (math.sin(math.radians(deg)) + 0.50572 * (deg + 6.07995) ** -1.6364)
        inverse = 6.6296 + 1.7513 * m - 0.1202 * m**2 + 0.0065 * m**3 - 0.00013 * m**4
        thick = 1 / (10.4 + 0.718 * m) if m > 20 else 1 / inverse if inverse > 0 else 0.1
        direct = astro.EXTRATERRESTRIAL_LUX * math.exp(-0.8662 * astro.TURBIDITY * m * thick)
        s = min(80.0, deg)
        return min(1.0, direct / GLARE_SATURATION) / math.exp(0.03398 * s + 0.00021 * s * s) ** 2

    return max(load(k / 4) for k in range(1, 361))


GLARE_PEAK = _glare_peak()


def fresnel(altitude: Column) -> Column:
    return F.pow(1 - F.greatest(zero(), F.sin(altitude)), F.lit(5.0)) * 0.98 + 0.02


def glare(transmission: Column, altitude: Column, azimuth: Column, heading: Column, direct: Column, wet: Column) -> Column:
    p = position_index(F.degrees(altitude))
    load = F.least(one(), direct / GLARE_SATURATION) / (p * p)
    load = load * (1 + clamp(wet, 0.0, 1.0) * fresnel(altitude))
    facing = F.when(finite(azimuth) & finite(heading), F.greatest(zero(), F.cos(azimuth - heading)) * 0.7 + 0.3).otherwise(1.0)
    return F.when((altitude > 0) & (transmission > 0), F.least(one(), transmission * load / GLARE_PEAK * facing)).otherwise(0.0)


def night(veil: Column) -> Column:
    return F.when(finite(veil) & (veil > 0), F.least(one(), F.pow(veil / VEIL_SATURATION, F.lit(0.6)))).otherwise(0.0)


def night_share(altitude: Column) -> Column:
    d = F.degrees(altitude)
    return F.when(d <= -6, 1.0).when(d >= 2, 0.0).otherwise((2 - d) / 8)


def facing_walls(azimuth: Column, bins: int | Column = 32) -> Column:
    """How much the wall of each bin faces the sun."""
    n = F.lit(bins) if isinstance(bins, int) else bins
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: -F.cos(azimuth - i * (2 * math.pi) / n))


def measured(df: DataFrame, c: dict[str, Column], keep: list[str]) -> DataFrame:
    """``df`` with the parts of the index, each intermediate result a column that is computed once.

    ``c``: transmission, svf, flicker (0 to 1), horizon (degrees), veil; altitude, azimuth, heading, direct, diffuse, up,
    share, wet; ``facing`` (else made from the azimuth); ``sky`` and ``wall``, the instant's tables (else an even sky);
    ``walls`` (else made from the horizon).
    """
    altitude, up, wet = c["altitude"], c["up"], clamp(c["wet"], 0.0, 1.0)
    facing = c.get("facing", facing_walls(c["azimuth"], F.size(c["horizon"])))
    tables = c.get("sky") is not None
    base = df.withColumns({
        "transmission_": c["transmission"], "flicker_": c["flicker"], "svf_": c["svf"], "veil_": c["veil"], "toward": F.tan(horizon_at(c["horizon"], c["azimuth"])),
        "reach": F.coalesce(sky_tables.factor(c["sky"], c["horizon"]), c["svf"]) if tables else c["svf"],
    })
    base = base.withColumn("walls", reverberation(c["walls"] if "walls" in c else walls_of(c["horizon"]), F.col("toward"), altitude, facing, c["direct"], c["diffuse"], c.get("wall")))
    t, svf, walls, n = F.col("transmission_"), F.col("svf_"), F.col("walls"), F.size(c["horizon"])
    direct, diffuse = t * c["direct"] * up, F.col("reach") * c["diffuse"]
    ground_sun = F.when(altitude > 0, clamp(1 - F.col("toward") / (F.tan(altitude) * 2), 0.0, 1.0)).otherwise(0.0)
    bounces = 1 / F.greatest(F.lit(0.4), 1 - clamp(1 - svf, 0.0, 1.0) * (0.5 * (WALL_ALBEDO + GROUND_ALBEDO)))
    lit = base.withColumns({"bounces": bounces, "ground_sunlit": ground_sun, "ground_direct": (t + ground_sun) * 0.5 * c["direct"] * up})
    ground = (F.col("ground_direct") + diffuse) * (1 - wet * 0.3) * GROUND_ALBEDO / math.pi * F.col("bounces")
    wall_luminance = F.when(walls.view > 0, walls.lux / walls.view / math.pi).otherwise(0.0) * F.col("bounces")
    total = direct + diffuse + walls.lux / n * F.col("bounces")
    light = lit.withColumns({"ground_luminance": ground, "wall_luminance": wall_luminance, "lux": total, "eye_lux": melanopic(direct, diffuse, altitude, c["share"]), "level_lux": direct + diffuse})
    surface = F.col("wall_luminance") + F.col("ground_luminance") * 0.5 + wet * fresnel(altitude) * F.col("ground_direct") / math.pi * F.col("bounces")
    return light.select(
        *keep, F.when(altitude > 0, t * c["share"]).otherwise(0.0).alias("sun"), (F.col("reach") * F.least(one(), F.pow(c["diffuse"] / SKY_SATURATION, F.lit(0.7)))).alias("sky"),
        F.least(one(), F.pow(F.col("eye_lux") / LUX_REFERENCE, F.lit(0.6))).alias("bright"), F.least(one(), F.pow(F.greatest(zero(), surface) / REVERB_SATURATION, F.lit(0.7))).alias("reverb"),
        glare(t, altitude, c["azimuth"], c["heading"], c["direct"], c["wet"]).alias("glare"), (F.col("flicker_") * c["share"]).alias("flicker"), night(F.col("veil_")).alias("night"), night_share(altitude).alias("night_share"),
        (walls.sunlit / n).alias("sunlit_walls"), "wall_luminance", "ground_luminance", "ground_sunlit", "lux", svf.alias("svf"),
        F.when(F.col("level_lux") > 0, F.col("eye_lux") / F.col("level_lux") * F.col("lux")).otherwise(0.0).alias("melanopic_lux"),
    )


def score(parts: DataFrame) -> Column:
    """The weighted parts, at dusk blended with the night's, 0 to 1."""
    day = sum((F.col(k) * w for k, w in WEIGHTS.items()), zero())
    return day * (1 - F.col("night_share")) + F.col("night") * F.col("night_share")


def index(parts: dict[str, Column]) -> Column:
    day = sum((parts[k] * w for k, w in WEIGHTS.items()), zero())
    share = parts["night_share"]
    blended = F.when(share > 0, day * (1 - share) + parts["night"] * share).otherwise(day)
    return clamp(half_up(F.round(blended * 100, 6)).cast("double"), 0.0, 100.0).cast("int")


def level(value: Column) -> Column:
    out = F.lit(LEVELS[0][1])
    for least, label in LEVELS[1:]:
        out = F.when(value >= least, label).otherwise(out)
    return out


def veil(flux: Column, height: Column, cct: Column, distance: Column, eye: float = EYE) -> Column:
    """Veiling luminance of one lamp at a distance."""
    rise = height - eye
    reach = distance * distance + rise * rise
    g = F.degrees(F.atan2(distance, F.greatest(F.lit(0.1), rise)))
    shape = F.when(g < 55, 1.0).when(g < 70, (g - 55) * 0.5 / 15 + 1).when(g < 85, 1.5 - (g - 70) * 1.25 / 15).otherwise(0.25 - F.least(F.lit(0.2), (g - 85) * 0.2 / 5))
    theta = F.greatest(F.lit(1.5), F.abs(F.degrees(F.atan2(rise, distance))))
    ratio = F.coalesce(piecewise(cct, LAMP_MELANOPIC), F.lit(0.53))
    return F.when(reach < 0.25, 0.0).otherwise(flux / (2 * math.pi) * F.greatest(F.lit(0.05), shape) / reach * 10 * ratio / (theta * theta))


def strength(flux: Column, cct: Column) -> Column:
    """What a lamp alone gives to its veil."""
    return flux / (2 * math.pi) * 10 * F.coalesce(piecewise(cct, LAMP_MELANOPIC), F.lit(0.53))


def veils(east: np.ndarray, north: np.ndarray, rise: np.ndarray, strength: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point (row): how many lamps lie within ``radius``, and the sum of ``veil`` over them, from their offsets in metres, rise above the eye and strength."""
    far = np.sqrt(east * east + north * north)
    within = far <= radius
    n = within.sum(axis=1)
    at = np.flatnonzero(within)
    row = np.repeat(np.arange(len(far)), n)
    col = at - row * far.shape[1]
    d, h, s = far.ravel()[at], rise[col], strength[col]
    g = np.arctan(d / np.maximum(0.1, h)) * (180 / math.pi)
    shape = np.minimum(1 + np.maximum(g - 55, 0) / 30, np.maximum(1.5 - (g - 70) / 12, 0.25 - (g - 85) / 25))
    theta = 90 - g
    low = rise < 0.1
    if low.any():
        low = low[col]
        theta[low] = np.abs(np.degrees(np.arctan2(h[low], d[low])))
    theta = np.maximum(1.5, theta)
    reach = d * d + h * h
    value = s * np.maximum(0.05, shape) / (np.maximum(reach, 0.25) * theta * theta)
    value[reach < 0.25] = 0.0
    return n, np.bincount(row, value, len(far))


def local_uv(uv: Column, transmission: Column, svf: Column, degrees: Column, share: Column) -> Column:
    direct = F.when(~finite(degrees), 0.45).otherwise(F.when(finite(share), clamp(piecewise(degrees, UV_DIRECT) * clamp(share, 0.0, 1.0), 0.0, 1.0)).otherwise(piecewise(degrees, UV_DIRECT)))
    return F.when(finite(uv) & (uv > 0), uv * (direct * transmission + (1 - direct) * svf)).otherwise(0.0)


def uv_fallback(altitude: Column) -> Column:
    """UV from the height of the sun alone."""
    return F.when(altitude > 0, F.pow(F.sin(altitude), F.lit(1.4)) * 8.5).otherwise(0.0)


def uv_level(uv: Column) -> Column:
    out = F.lit("extrême")
    for below, label in reversed(UV_LEVELS):
        out = F.when(uv < below, label).otherwise(out)
    return out


def flicker(transmissions: Column, canopy: Column, step: float = 4.0) -> Column:
    """Alternation of light and shade along a side, from arrays in walking order; under three points none."""
    n = F.size(transmissions)
    changes = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: (F.get(transmissions, i) > 0.5) != (F.get(transmissions, i - 1) > 0.5)))
    alternation = F.least(one(), changes / ((n - 1) * step) / 0.2)
    t = lambda x: clamp(x.v, 0.0, 1.0)
    dapple = F.aggregate(F.zip_with(transmissions, canopy, lambda v, c: F.struct(v.alias("v"), c.alias("c"))), zero(), lambda a, x: a + F.when(x.c, t(x) * (1 - t(x)) * 4).otherwise(0.0)) / n
    return F.when(n < 3, 0.0).otherwise(F.least(one(), dapple + alternation * 0.5))
