"""When was an aerial image taken? Candidate suns are cast over the surface, and the shade of one of them explains the image."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import astro
from ..operators import raster, rays
from ..sources import adapters
from ..sources.adapters import table
from ..sources.storage import materialize
from .ground import EYE, GRID, surface
from .registry import query, r6

#: The sweep (from, to, step, then how far and how fine around the best), offsets of the profile, heights tried, the least altitude, what counts as better for certain.
FROM, TO, COARSE, AROUND, FINE = 360, 1260, 10, 15, 2
OFFSETS = [-180, -120, -60, -30, -10, 0, 10, 30, 60, 120, 180]
SCALES = [0.8, 0.9, 1.0, 1.1, 1.2, 1.35]
LOW, CERTAIN = 0.05, 0.005
#: The minute of the day at which the stand-in of an image was taken; and where, by which clocks.
TAKEN, LAT, LON, ZONE = 684, 48.8566, 2.3522, "Europe/Paris"

_SCORE = "n, round(case when n > 1 and sqrt(n*stt - st*st)*sqrt(n*sll - sl*sl) > 1e-9 then (n*stl - st*sl)/(sqrt(n*stt - st*st)*sqrt(n*sll - sl*sl)) else 0 end, 6) as r, round(shaded/cast(n as double), 6) as shade"


def positions(spark, day: datetime.date, minutes: list[int]) -> dict[int, tuple[float, float]]:
    """Azimuth and apparent altitude at minutes of a day by the clocks of the zone, of suns that are not low: a row for each minute asked."""
    wall = spark.createDataFrame([(m, (day - datetime.date(1970, 1, 1)).days * 86400 + m * 60) for m in minutes], "minutes int, wall long")
    # Instants become rows of their own: written into the formulas, which name them often, they would fill pages of code.
    utc = spark.createDataFrame(wall.select("minutes", astro.local_to_utc(F.col("wall"), ZONE).alias("utc")).collect(), "minutes int, utc long")
    seen = spark.createDataFrame(utc.select("minutes", *[c.alias(n) for c, n in zip(astro.sun_position(F.col("utc") * 1000.0, F.lit(LAT), F.lit(LON)), ("altitude", "azimuth"), strict=True)]).collect(), "minutes int, altitude double, azimuth double")
    found = seen.select("minutes", F.round("azimuth", 9).alias("azimuth"), F.round(astro.refracted(F.col("altitude")), 9).alias("altitude")).where(F.col("altitude") > LOW)
    return {r.minutes: (r.azimuth, r.altitude) for r in found.collect()}


def open_ground(cells: DataFrame, scale: float = 1.0) -> DataFrame:
    """Pixels (key, x, y, eye, rise) without crowns and without buildings of ``scale`` times their height."""
    rise = F.col("surface") - F.col("ground")
    free = cells.where((rise * scale <= 0.5) & (F.col("canopy_top") - F.col("ground") <= 0.5))
    return free.select((F.col("row") * GRID.width + F.col("col")).cast("long").alias("key"), ((F.col("col") + 0.5) * GRID.res).alias("x"), ((F.col("row") + 0.5) * GRID.res).alias("y"), (F.col("ground") + EYE).alias("eye"), rise.alias("rise"))


def scores(pixels: DataFrame, cells: DataFrame, image: DataFrame, suns: list[rays.Sun]) -> DataFrame:
    """(i, n, r, shade, overlap) of each sun: how the light that reaches open ground goes with the luminance of the image, the share of it in shade, and the share that is lit or not as under the first sun.

    Sums are of whole millionths and are made before the shuffle. ``image``: (key, lum as a whole number).
    """
    seen = rays.sunlit(pixels.select("key", "x", "y", "eye"), cells, GRID, suns).join(image, "key").join(pixels.select("key", "rise"), "key")
    light = F.transform(F.arrays_zip("cut", "depth"), lambda s: F.round(raster.transmitted(s.cut, s.depth) * 1e6).cast("long"))
    lit = F.col("t") > 500_000
    each = seen.withColumn("light", light).select("lum", "rise", (F.col("light")[0] > 500_000).alias("first"), F.posexplode("light").alias("i", "t"))
    scale = F.element_at(F.array(*[F.lit(s.scale) for s in suns]), F.col("i") + 1)
    t, lum = F.col("t").cast("decimal(38,0)"), F.col("lum").cast("decimal(38,0)")
    sums = each.where(F.col("rise") * scale <= 0.5).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("t").alias("st"), F.sum("lum").alias("sl"), F.sum(t * t).cast("double").alias("stt"), F.sum(lum * lum).cast("double").alias("sll"), F.sum(t * lum).cast("double").alias("stl"),
        F.count_if(~lit).alias("shaded"), F.count_if(lit == F.col("first")).alias("same"),
    )
    n, st, sl = F.col("n"), F.col("st").cast("double"), F.col("sl").cast("double")
    spread = F.sqrt(n * F.col("stt") - st * st) * F.sqrt(n * F.col("sll") - sl * sl)
    r = F.when((n > 1) & (spread > 1e-9), (n * F.col("stl") - st * sl) / spread).otherwise(0.0)
    return sums.select("i", "n", r6(r).alias("r"), r6(F.col("shaded") / n).alias("shade"), r6(F.col("same") / n).alias("overlap"))


def _best(found: list, value) -> object:
    """The first of the rows with the largest ``r``."""
    return max(found, key=lambda row: (row.r, -value(row)))


def fitted(spark, cells: DataFrame, image: DataFrame, day: datetime.date) -> DataFrame:
    """(stage, minutes, scale, n, r, shade, overlap, best) of every sun that was tried.

    First a coarse sweep of the day, then a fine one around its best minute; the better of both wins, at equal r the coarse one. Around the winner a
    profile, whose agreement should break down on both sides, and the heights of buildings under it. Each stage is one walk
    over the surface for all its suns, all pixels, and a row for each sun comes back. A day without a sun gives no row, nor does a
    surface without open ground.
    """
    schema = "stage string, minutes int, scale double, i int"
    pixels = materialize(open_ground(cells), "pixels")

    def tried(stage: str, names: list[tuple[int, float]], at: dict[int, tuple[float, float]], ground: DataFrame = pixels) -> DataFrame:
        suns = [rays.Sun(*at[m], scale) for m, scale in names]
        told = spark.createDataFrame([(stage, m, scale, i) for i, (m, scale) in enumerate(names)], schema)
        return materialize(told.join(scores(ground, cells, image, suns), "i").drop("i"), stage)

    at = positions(spark, day, list(range(FROM, TO + 1, COARSE)))
    nothing = spark.createDataFrame([], "stage string, minutes int, scale double, n long, r double, shade double, overlap double, best boolean")
    if not at or pixels.isEmpty():
        return nothing
    coarse = tried("coarse", [(m, 1.0) for m in sorted(at)], at)
    swept = coarse.collect()
    if not swept:  # no pixel of the image is open ground
        return nothing
    first = _best(swept, lambda row: row.minutes)
    at |= positions(spark, day, [m for m in range(first.minutes - AROUND, first.minutes + AROUND + 1, FINE)])
    fine = tried("fine", [(m, 1.0) for m in range(first.minutes - AROUND, first.minutes + AROUND + 1, FINE) if m in at], at)
    second = _best(fine.collect(), lambda row: row.minutes)
    won = second if second.r > first.r else first
    at |= positions(spark, day, [won.minutes + o for o in OFFSETS])
    profile = tried("profile", [(won.minutes, 1.0), *[(won.minutes + o, 1.0) for o in OFFSETS if o and won.minutes + o in at]], at)
    heights = tried("height", [(won.minutes, s) for s in SCALES], at, open_ground(cells, min(SCALES)))
    height = _best(heights.collect(), lambda row: row.scale)
    whole = next(row.r for row in heights.collect() if row.scale == 1.0)
    chosen = height.scale if height.scale != 1.0 and height.r - whole > CERTAIN else 1.0
    best = F.when(F.col("stage") == "height", F.col("scale") == chosen).otherwise((F.col("minutes") == won.minutes) & ((F.col("stage") == "profile") | (F.col("stage") == ("fine" if won is second else "coarse"))))
    overlap = F.when(F.col("stage") == "profile", F.col("overlap"))
    return coarse.unionByName(fine).unionByName(profile).unionByName(heights).withColumns({"overlap": overlap, "best": best})


def flight(spark, sf_dir: str) -> datetime.date | None:
    """The day of the newest flight."""
    return table(spark, sf_dir, "events").agg(F.to_date(F.max("ts")).alias("day")).first().day


def image(spark, sf_dir: str, cells: DataFrame, sun: rays.Sun) -> DataFrame:
    """(key, lum) of open ground: its light under a sun, and grain from the values of the events of a pixel."""
    key = (F.col("event_id") % (GRID.width * GRID.height)).cast("long").alias("key")
    grain = table(spark, sf_dir, "events").groupBy(key).agg((F.abs(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long"))) % 60).alias("grain"))
    lit = rays.sunlit(open_ground(cells, min(SCALES)).select("key", "x", "y", "eye"), cells, GRID, [sun])
    light = F.floor(raster.transmitted(F.col("cut")[0], F.col("depth")[0]) * 150 + 0.5).cast("long")
    return lit.join(grain, "key", "left").select("key", (light + 40 + F.coalesce("grain", F.lit(0))).alias("lum"))


def _cast(suns: str, name: str) -> str:
    """SQL: the light of every open pixel under each row (minutes, scale, altitude, azimuth) of a table."""
    return f"""
    {name}_ray as (select key, rise, minutes, scale, trunc((x + sin(azimuth)*8E0*k)/10) as col, trunc((y + cos(azimuth)*8E0*k)/10) as row, eye + k*(tan(altitude)*8E0) as z
      from (select p.*, s.*, unnest(range(1, cast(least(56, floor((highest - eye)/(tan(altitude)*8E0))) as bigint) + 1)) as k from keyed p, {suns} s, top)),
    {name}_met as (select key, minutes, scale, max(cast(s.ground + (s.surface - s.ground)*scale > z as int)) as cut, sum(case when canopy_top > z and canopy_base < z then cast(round(canopy_k*8*1e6) as bigint) else 0 end)/1e6 as depth
      from {name}_ray r join surface s using (row, col) group by 1, 2, 3),
    {name} as materialized (select p.key, p.rise, s.minutes, s.scale, case when cut = 1 then 0 else exp(-coalesce(depth, 0)) end as light from keyed p cross join {suns} s left join {name}_met m on m.key = p.key and m.minutes = s.minutes and m.scale = s.scale)"""


def _scored(stage: str, light: str) -> str:
    return f"""
    {stage} as materialized (select minutes, scale, {_SCORE} from (select minutes, scale, count(*) as n, sum(t) as st, sum(lum) as sl, sum(cast(t as hugeint)*t)::double as stt, sum(lum*lum)::double as sll, sum(t*lum)::double as stl, count(*) filter (t <= 500000) as shaded
      from (select minutes, scale, cast(round(light*1e6) as bigint) as t, lum from {light} join image using (key) where rise*scale <= 0.5) group by 1, 2) group by all)"""


@query(
    f"""
    flight as (select cast(max(ts) as date) as day from events),
    dst as (select day, day >= make_date(year(day), 3, 31) - cast(dayofweek(make_date(year(day), 3, 31)) as int) and day < make_date(year(day), 10, 31) - cast(dayofweek(make_date(year(day), 10, 31)) as int) as summer from flight),
    t0 as (select cast(m as int) as minutes, (epoch(day) + m*60 - case when summer then 7200 else 3600 end)/86400E0 + 2440587.5E0 - 2451545.0E0 as n from dst, (select unnest(range(1440)) as m)),
    t1 as (select minutes, n, radians(280.46E0 + 0.9856474E0*n) as l, radians(357.528E0 + 0.9856003E0*n) as g, radians(23.439E0 - 0.0000004E0*n) as eps from t0),
    t2 as (select *, l + radians(1.915E0*sin(g) + 0.02E0*sin(2*g)) as lam from t1),
    t3 as (select *, atan2(cos(eps)*sin(lam), cos(lam)) as ra, asin(sin(eps)*sin(lam)) as dec, radians(((18.697374558E0 + 24.06570982441908E0*n) % 24)*15 + {LON}E0) as lst from t2),
    t4 as (select minutes, lst - ra as ha, dec, radians({LAT}E0) as phi from t3),
    t5 as (select minutes, asin(greatest(-1E0, least(1E0, sin(phi)*sin(dec) + cos(phi)*cos(dec)*cos(ha)))) as alt, (atan2(-sin(ha)*cos(dec), sin(dec)*cos(phi) - cos(dec)*sin(phi)*cos(ha)) + 2*pi()) % (2*pi()) as azimuth from t4),
    sun as materialized (select minutes, 1E0 as scale, round(azimuth, 9) as azimuth, round(case when degrees(alt) < -1 then alt else radians(degrees(alt) + 1.02E0/tan(radians(degrees(alt) + 10.3E0/(degrees(alt) + 5.11E0)))/60) end, 9) as altitude from t5),
    up as materialized (select * from sun where altitude > {LOW}E0),
    keyed as materialized (select cast(row*120 + col as bigint) as key, (col + 0.5E0)*10 as x, (row + 0.5E0)*10 as y, ground + 1.6E0 as eye, surface - ground as rise from surface where (surface - ground)*0.8E0 <= 0.5 and canopy_top - ground <= 0.5),
    top as (select max(greatest(ground + (surface - ground)*1.35E0, canopy_top)) as highest from surface),
    taken as (select * from sun where minutes = {TAKEN}),
    """
    + _cast("taken", "shot")
    + f""",
    grain as (select event_id % 9600 as key, abs(sum(cast(floor(value*100 + 0.5) as bigint))) % 60 as grain from events group by 1),
    image as materialized (select key, cast(floor(light*150 + 0.5) as bigint) + 40 + cast(coalesce(grain, 0) as bigint) as lum from shot left join grain using (key)),
    one as (select * from up where minutes between {FROM} and {TO} and (minutes - {FROM}) % {COARSE} = 0),
    """
    + _cast("one", "swept")
    + ","
    + _scored("coarse", "swept")
    + f""",
    first as (select minutes, r from coarse order by r desc, minutes limit 1),
    two as (select up.* from up, first where up.minutes between first.minutes - {AROUND} and first.minutes + {AROUND} and (up.minutes - first.minutes + {AROUND}) % {FINE} = 0),
    """
    + _cast("two", "around")
    + ","
    + _scored("fine", "around")
    + f""",
    second as (select minutes, r from fine order by r desc, minutes limit 1),
    won as (select case when s.r > f.r then s.minutes else f.minutes end as minutes, s.r > f.r as finer from first f, second s),
    three as (select up.* from up, won where up.minutes - won.minutes in ({", ".join(map(str, OFFSETS))})),
    """
    + _cast("three", "offset_")
    + ","
    + _scored("profile", "offset_")
    + f""",
    same as (select o.minutes, round(avg(cast((cast(round(o.light*1e6) as bigint) > 500000) = (cast(round(w.light*1e6) as bigint) > 500000) as int)), 6) as overlap from offset_ o join won on true join offset_ w on w.key = o.key and w.minutes = won.minutes where o.rise <= 0.5 group by 1),
    four as (select up.minutes, s.scale, up.azimuth, up.altitude from up join won using (minutes), (select unnest([{", ".join(f"{s}E0" for s in SCALES)}]) as scale) s),
    """
    + _cast("four", "scaled")
    + ","
    + _scored("height", "scaled")
    + f""",
    tall as (select case when b.scale <> 1 and b.r - w.r > {CERTAIN} then b.scale else 1E0 end as scale from (select scale, r from height order by r desc, scale limit 1) b, (select r from height where scale = 1) w)
    select 'coarse' as stage, c.minutes, scale, n, c.r, shade, null::double as overlap, c.minutes = won.minutes and not finer as best from coarse c, won
    union all select 'fine', c.minutes, scale, n, c.r, shade, null, c.minutes = won.minutes and finer from fine c, won
    union all select 'profile', c.minutes, scale, n, c.r, shade, overlap, c.minutes = won.minutes from profile c join same using (minutes), won
    union all select 'height', h.minutes, h.scale, n, h.r, shade, null, h.scale = tall.scale from height h, tall
    """,
    *adapters.SURFACE,
)
def a25_a26_a33_a34_real_suns(spark, sf_dir):
    """The minute of the newest flight by its shadows, what is left of the agreement at other minutes, and whether other heights of buildings explain the image better."""
    day = flight(spark, sf_dir)
    if day is None:
        return spark.createDataFrame([], "stage string, minutes int, scale double, n long, r double, shade double, overlap double, best boolean")
    cells = materialize(surface(spark, sf_dir), "surface")
    taken = positions(spark, day, [TAKEN])[TAKEN]
    return fitted(spark, cells, materialize(image(spark, sf_dir, cells, rays.Sun(*taken)), "image"), day)
