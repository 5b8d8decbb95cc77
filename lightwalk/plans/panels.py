"""What the panels show: projections over the evaluated sides, days and scales."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import astro, exposure, words
from ..functions.num import half_up
from ..operators import spatial
from ..sources import adapters
from ..sources.adapters import table
from . import skies
from .registry import query, r6

_INDEX = skies.flagship_sql(skies.CONTEXTS) + f", i as (select segment_id, side, instant, cast(least(100, greatest(0, floor(round({skies._SCORE}, 6) + 0.5E0))) as int) as index, sun_, glare, flick, reverb from e8) "


def indexed(spark, sf_dir):
    """Sides at the five instants with their parts, their index, and ``pair``: the street that they are the two sides of."""
    parts = skies.evaluated(adapters.sides(spark, sf_dir), skies.contexts(spark))
    value = exposure.index({k: F.col(k) for k in (*exposure.WEIGHTS, "night", "night_share")})
    return parts.withColumns({"index": value, "pair": F.col("segment_id") - F.col("segment_id") % 2})


@query(
    _INDEX
    + """
    , p as (select l.segment_id as pair, l.instant, l.index as li, r.index as ri from i l join i r on l.segment_id % 2 = 0 and r.segment_id = l.segment_id + 1 and r.instant = l.instant),
    b as (select *, least(li, ri) as best, greatest(li, ri) as worst, case when li <= ri then 'L' else 'R' end as side, case when li <= ri then 'R' else 'L' end as other from p)
    select pair, cast(instant as int) as instant, best, worst, case when worst - best < 8 then 'Les deux trottoirs se valent (écart de ' || (worst - best) || ' point' || case when worst - best > 1 then 's' else '' end || ').'
      else 'Marchez côté ' || side || ' — ' || best || ' contre ' || worst || ' côté ' || other || ', soit ' || (worst - best) || ' points de moins.' end as advice from b
    """,
    "sides",
)
def q1_better_side_advice(spark, sf_dir):
    sides = indexed(spark, sf_dir).select("pair", "instant", "side", "index")
    both = sides.groupBy("pair", "instant").agg(F.min(F.struct("index", "side")).alias("best"), F.max(F.struct("index", F.when(F.col("side") == "R", 1).otherwise(0).alias("o"), "side")).alias("worst"), F.count("*").alias("n")).where("n = 2")
    best, worst = F.col("best.index"), F.col("worst.index")
    gap = worst - best
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    other = F.when(F.col("best.side") == "L", "R").otherwise("L")
    same = text("Les deux trottoirs se valent (écart de ", gap, " point", F.when(gap > 1, "s").otherwise(""), ").")
    advice = F.when(gap < 8, same).otherwise(text("Marchez côté ", F.col("best.side"), " — ", best, " contre ", worst, " côté ", other, ", soit ", gap, " points de moins."))
    return both.select("pair", "instant", best.alias("best"), worst.alias("worst"), advice.alias("advice"))


@query(
    _INDEX
    + """
    , s as (select i.*, svf from i join sides using (segment_id)),
    u as (select segment_id, instant, side, 'Indice' as measure, cast(index as varchar) as shown from s union all select segment_id, instant, side, 'Soleil direct', cast(floor(round(sun_*100, 6) + 0.5E0) as bigint) || ' %' from s union all select segment_id, instant, side, 'Éblouissement de face', cast(floor(round(glare*100, 6) + 0.5E0) as bigint) || ' %' from s
      union all select segment_id, instant, side, 'Scintillement', cast(floor(round(flick*100, 6) + 0.5E0) as bigint) || ' %' from s union all select segment_id, instant, side, 'Réverbération', cast(floor(round(reverb*100, 6) + 0.5E0) as bigint) || ' %' from s union all select segment_id, instant, side, 'Ouverture au ciel', svf || ' %' from s)
    select segment_id, cast(instant as int) as instant, side, measure, shown from u
    """,
    "sides",
)
def q2_measures_as_text(spark, sf_dir):
    s = indexed(spark, sf_dir)
    pct = lambda c: F.concat(half_up(F.round(F.col(c) * 100, 6)).cast("string"), F.lit(" %"))
    rows = [("Indice", F.col("index").cast("string")), ("Soleil direct", pct("sun")), ("Éblouissement de face", pct("glare")), ("Scintillement", pct("flicker")), ("Réverbération", pct("reverb")), ("Ouverture au ciel", pct("svf"))]
    measures = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("shown")) for n, v in rows]))
    return s.select("segment_id", "instant", "side", measures.alias("m")).select("segment_id", "instant", "side", "m.*")


@query(
    _INDEX
    + """
    , v as (select segment_id - segment_id % 2 as pair, instant, mode, max(case side when 'L' then v end) as l, max(case side when 'R' then v end) as r from (
        select segment_id, instant, side, 'index' as mode, cast(index as double) as v from i union all select segment_id, instant, side, 'sun', sun_*100 from i union all select segment_id, instant, side, 'glare', glare*100 from i union all select segment_id, instant, side, 'reverb', reverb*100 from i) group by 1, 2, 3),
    c as (select *, cast(floor(round(l, 6) + 0.5E0) as bigint) as lr, cast(floor(round(r, 6) + 0.5E0) as bigint) as rr, least(l, r) as best, greatest(l, r) as worst from v where l is not null and r is not null)
    select pair, cast(instant as int) as instant, mode, lr as left_value, rr as right_value, cast(floor(round(best, 6) + 0.5E0) as bigint) as best, cast(floor(round(worst, 6) + 0.5E0) as bigint) as worst,
      lr is distinct from lag(lr) over o or rr is distinct from lag(rr) over o as repaint from c window o as (partition by pair, mode order by instant)
    """,
    "sides",
)
def f16_f17_f18_shown_values(spark, sf_dir):
    """What a mode shows of both sides, the better and the worse of them, and whether it must be painted anew since the instant before."""
    modes = {"index": F.col("index").cast("double"), "sun": F.col("sun") * 100, "glare": F.col("glare") * 100, "reverb": F.col("reverb") * 100}
    long = indexed(spark, sf_dir).select("pair", "instant", "side", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("v")) for m, v in modes.items()])).alias("m")).select("pair", "instant", "side", "m.*")
    both = long.groupBy("pair", "instant", "mode").agg(*[F.max(F.when(F.col("side") == s, F.col("v"))).alias(n) for s, n in (("L", "l"), ("R", "r"))]).where("l is not null and r is not null")
    whole = lambda c: half_up(F.round(c, 6))
    shown = both.select("pair", "instant", "mode", whole(F.col("l")).alias("left_value"), whole(F.col("r")).alias("right_value"), whole(F.least("l", "r")).alias("best"), whole(F.greatest("l", "r")).alias("worst"))
    o = Window.partitionBy("pair", "mode").orderBy("instant")
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(o))
    return shown.withColumn("repaint", changed("left_value") | changed("right_value"))


@query(
    skies.flagship_sql(skies.STEPS) + f" select segment_id, side, cast(instant as int) as step, cast(least(100, greatest(0, floor(round({skies._SCORE}, 6) + 0.5E0))) as int) as index from e8",
    "sides",
)
def q3_day_profile(spark, sf_dir):
    """The index of both sides at every step of the day."""
    parts = skies.evaluated(adapters.sides(spark, sf_dir), skies.contexts(spark, skies.STEPS))
    value = exposure.index({k: F.col(k) for k in (*exposure.WEIGHTS, "night", "night_share")})
    return parts.select("segment_id", "side", F.col("instant").alias("step"), value.alias("index"))


_SUN = """
    n as (select *, (epoch(day) + minutes*60)/86400E0 + 2440587.5E0 - 2451545.0E0 as n from st),
    l as (select *, radians(280.46E0 + 0.9856474E0*n) + radians(1.915E0*sin(radians(357.528E0 + 0.9856003E0*n)) + 0.02E0*sin(2*radians(357.528E0 + 0.9856003E0*n))) as lam, radians(23.439E0 - 0.0000004E0*n) as eps, radians(((18.697374558E0 + 24.06570982441908E0*n) % 24)*15 + 2.3522E0) as lst, radians(48.8566E0) as phi from n),
    h as (select *, asin(sin(eps)*sin(lam)) as dec, lst - atan2(cos(eps)*sin(lam), cos(lam)) as ha from l),
    s as (select day, step, minutes, degrees(asin(sin(phi)*sin(dec) + cos(phi)*cos(dec)*cos(ha))) as altitude, degrees((atan2(-sin(ha)*cos(dec), sin(dec)*cos(phi) - cos(dec)*sin(phi)*cos(ha)) + 2*pi()) % (2*pi())) as azimuth from h)
"""


@query(
    "with st as (select day, cast(i as int) as step, cast(300 + i*15 as int) as minutes from (select distinct cast(ts as date) as day from events), (select unnest(range(69)) as i))," + _SUN
    + """
    , g as (select *, cast(floor(round(azimuth, 6) + 0.5E0) as bigint) as za, cast(floor(round(altitude, 6) + 0.5E0) as bigint) as al, least(1, altitude/3)*(1 - 0.55E0*0.25E0) as strength, greatest(0E0, least(1E0, altitude/45)) as warmth from s)
    select day, step, minutes, lpad(cast(minutes // 60 as varchar), 2, '0') || ':' || lpad(cast(minutes % 60 as varchar), 2, '0') as clock, round(altitude, 5) as altitude, round(azimuth, 5) as azimuth, altitude = max(altitude) over (partition by day) as noon,
      za is distinct from lag(za) over o or al is distinct from lag(al) over o as relit, case when altitude <= 0 then 0 else round(strength, 4) end as ring, cast(floor(round(138 + 112*warmth, 6) + 0.5E0) as bigint) as green, cast(floor(round(43 + 197*warmth, 6) + 0.5E0) as bigint) as blue,
      round(0.3E0*pow(0.75E0, 2.5E0)*least(1E0, sin(radians(altitude))*6), 4) as veil, case when altitude <= 0 then 0 else round(8.5E0*pow(sin(radians(altitude)), 1.4E0), 4) end as uv
    from g window o as (partition by day order by step)
    """
)
def m15_m16_a28_q6_q7_day_of_sun(spark, sf_dir):
    """The steps of each day of the table with the sun over the city: the highest one is solar noon; light is set anew when a rounded angle changes; strengths of the sun's ring and of shadows; UV by height alone."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    steps = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(68))).alias("step")).withColumn("minutes", F.col("step") * 15 + 300)
    altitude, azimuth = astro.sun_position(F.unix_date("day") * 86400000.0 + F.col("minutes") * 60000.0, F.lit(48.8566), F.lit(2.3522))
    s = steps.withColumns({"altitude": F.degrees(altitude), "azimuth": F.degrees(azimuth)})
    angle = lambda c: half_up(F.round(c, 6))
    o, highest = Window.partitionBy("day").orderBy("step"), F.max("altitude").over(Window.partitionBy("day"))  # the steps of one day
    relit = ~angle(F.col("azimuth")).eqNullSafe(F.lag(angle(F.col("azimuth"))).over(o)) | ~angle(F.col("altitude")).eqNullSafe(F.lag(angle(F.col("altitude"))).over(o))
    up, cloud = F.col("altitude") > 0, F.lit(0.25)
    warmth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("altitude") / 45))
    high = F.sin(F.radians("altitude"))
    return s.select(
        "day", "step", "minutes", words.clock(F.col("minutes")).alias("clock"), F.round("altitude", 5).alias("altitude"), F.round("azimuth", 5).alias("azimuth"), (F.col("altitude") == highest).alias("noon"), relit.alias("relit"),
        F.when(up, F.round(F.least(F.lit(1.0), F.col("altitude") / 3) * (1 - cloud * 0.55), 4)).otherwise(0.0).alias("ring"), angle(warmth * 112 + 138).alias("green"), angle(warmth * 197 + 43).alias("blue"),
        F.round(F.pow(1 - cloud, F.lit(2.5)) * 0.3 * F.least(F.lit(1.0), high * 6), 4).alias("veil"), F.when(up, F.round(exposure.uv_fallback(F.radians("altitude")), 4)).otherwise(0.0).alias("uv"),
    )


@query(
    """
    d as (select day, list(minutes order by minutes) as minutes, list(round(cloud, 6) order by minutes) as cloud from hourly group by 1)
    select day, len(minutes) as hours, minutes, cloud, case date_diff('day', date '2024-01-10', day) when 0 then 'aujourd''hui' when 1 then 'demain' when 2 then 'après-demain' else ['dimanche', 'lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi', 'samedi'][1 + dayofweek(day)] || ' ' || day(day) end as label,
      abs(date_diff('day', date '2024-01-10', day)) > 7 as stale, strftime(day, '%m-%d') between '04-15' and '11-05' as in_leaf, day = coalesce((select max(day) from d where day = date '2024-01-12'), (select min(day) from d)) as shown,
      case when cloud[13]*100 < 11.5 then 'ciel dégagé' when cloud[13]*100 < 39.5 then 'peu nuageux' when cloud[13]*100 < 69.5 then 'nuageux' when cloud[13]*100 < 89.5 then 'très nuageux' else 'couvert' end || ' (' || cast(floor(cloud[13]*100 + 0.5E0) as bigint) || ' %)' as sky
    from d where len(minutes) >= 13
    """,
    "hourly",
)
def a13_q4_q5_q13_f14_m39_days(spark, sf_dir):
    """Hourly rows by day, with the day's label as seen from a date, whether it is stale, whether trees are in leaf, the day that is shown (the chosen one, else the first), and its sky at noon."""
    today, chosen = F.lit("2024-01-10").cast("date"), "2024-01-12"
    h = adapters.hourly(spark, sf_dir).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("minutes", F.round("cloud", 6).alias("cloud")))).alias("h"))  # 24 rows a day
    first = F.broadcast(h.agg(F.coalesce(F.max(F.when(F.col("day") == F.lit(chosen).cast("date"), F.col("day"))), F.min("day")).alias("first")))
    month = F.date_format("day", "MM-dd")
    d = h.where(F.size("h") >= 13).crossJoin(first)
    return d.select(
        "day", F.size("h").cast("long").alias("hours"), F.col("h.minutes").alias("minutes"), F.col("h.cloud").alias("cloud"), words.day_label(F.col("day"), today).alias("label"), (F.abs(F.datediff("day", today)) > 7).alias("stale"),
        month.between("04-15", "11-05").alias("in_leaf"), (F.col("day") == F.col("first")).alias("shown"), words.sky_label(F.col("h")[12].cloud).alias("sky"),
    )


@query(
    """
    with v as (select p_partkey as k, (p_partkey*37) % 1101/10E0 as x from part), u as (select *, x/10 as uv from v)
    select k as value_id, case when x >= 100 then '#f7e463' when x >= 80 then '#e8663d' when x >= 60 then '#d9a441' when x >= 40 then '#4aa3a2' when x >= 20 then '#2b6b8f' else '#1a2b4a' end as colour, case when uv >= 11 then '#f7e463' when uv >= 8 then '#e8663d' when uv >= 6 then '#d9a441' when uv >= 3 then '#4aa3a2' else '#1a2b4a' end as uv_colour,
      cast(floor(case when x <= 20 then 26 + 17*x/20 when x <= 40 then 43 + 31*(x - 20)/20 when x <= 60 then 74 + 143*(x - 40)/20 when x <= 80 then 217 + 15*(x - 60)/20 when x <= 100 then 232 + 15*(x - 80)/20 else 247 end + 0.5E0) as int) as red,
      ['nord', 'nord-est', 'est', 'sud-est', 'sud', 'sud-ouest', 'ouest', 'nord-ouest'][1 + cast(floor(((degrees(atan2(sin(radians(k)), cos(radians(k)))) + 360) % 360)/45 + 0.5E0) as int) % 8] as cardinal,
      case when x*1000 >= 1000 then printf('%.1f', round(x, 1)) || ' km' else cast(floor(x*1000/5 + 0.5E0)*5 as bigint) || ' m' end as metres, case when x*2e7 >= 1e9 then printf('%.1f', round(x*2e7/1e9, 1)) || ' Go' when x*2e7 >= 1e6 then cast(floor(x*2e7/1e6 + 0.5E0) as bigint) || ' Mo' else cast(floor(x*2e7/1e3 + 0.5E0) as bigint) || ' ko' end as bytes,
      case when x*90 < 60 then printf('%.1f', round(x*90, 1)) || ' s' when floor(floor(x*90 + 0.5E0)/60) < 60 then cast(floor(floor(x*90 + 0.5E0)/60) as bigint) || ' min ' || lpad(cast(cast(floor(x*90 + 0.5E0) as bigint) % 60 as varchar), 2, '0') || ' s' else cast(floor(floor(floor(x*90 + 0.5E0)/60)/60) as bigint) || ' h ' || lpad(cast(cast(floor(floor(x*90 + 0.5E0)/60) as bigint) % 60 as varchar), 2, '0') end as duration,
      round(case when z <= 15 then 0.8E0 + (2 - 0.8E0)*(pow(1.6E0, z - 12) - 1)/(pow(1.6E0, 3) - 1) when z <= 17 then 2 + 2.5E0*(pow(1.6E0, z - 15) - 1)/(pow(1.6E0, 2) - 1) else 4.5E0 + 4.5E0*(pow(1.6E0, z - 17) - 1)/(pow(1.6E0, 2) - 1) end, 6) as line_width, round(5*pow(2E0, z)/102900, 6) as line_offset
    from (select *, 12 + k % 8 as z from u)
    """
)
def m38_q9_q11_g8_shown_text(spark, sf_dir):
    """Colours by step and by ramp, the name of a direction, sizes as text, width and offset of lines by zoom."""
    k = F.col("p_partkey")
    v = table(spark, sf_dir, "part").select(k.alias("value_id"), (k * 37 % 1101 / 10.0).alias("x"), (F.lit(12) + k % 8).alias("z"))
    x, z = F.col("x"), F.col("z")
    angle = F.radians(F.col("value_id").cast("double"))
    return v.select(
        "value_id", words.colour(x).alias("colour"), words.colour(x / 10, words.UV_SCALE).alias("uv_colour"), words.ramp(x).red.alias("red"), words.cardinal(F.sin(angle), F.cos(angle)).alias("cardinal"), words.metres(x * 1000).alias("metres"),
        words.bytes_text(x * 2e7).alias("bytes"), words.duration(x * 90).alias("duration"), r6(exponential(z, 1.6, [(12, 0.8), (15, 2.0), (17, 4.5), (19, 9.0)])).alias("line_width"), r6(F.pow(F.lit(2.0), z) * 5 / 102900).alias("line_offset"),
    )


def exponential(zoom, base: float, stops: list[tuple[float, float]]):
    """Between stops of zoom, growing by powers of ``base``."""
    out = F.lit(stops[-1][1])
    for (a, low), (b, high) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(zoom <= b, F.lit(low) + (F.pow(F.lit(base), zoom - a) - 1) * ((high - low) / (base ** (b - a) - 1))).otherwise(out)
    return out


@query(
    """
    c as (select p.point_id, l.lamp_id, case when abs(l.x - p.x) <= 3 and abs(l.y - p.y) <= 3 then 3 when abs(l.x - p.x) <= 9 and abs(l.y - p.y) <= 9 then 9 else 18 end as reach from points p join lamps l on l.x between p.x - 18 and p.x + 18 and l.y between p.y - 18 and p.y + 18 where abs(l.x - p.x) <= 18 and abs(l.y - p.y) <= 18),
    r as (select *, row_number() over (partition by point_id order by reach, lamp_id) as r from c) select point_id, lamp_id, cast(reach as int) as reach from r where r = 1
    """,
    "points", "lamps",
)
def q10_hit_test(spark, sf_dir):
    """The first thing in a square around a place that grows from 3 to 9 to 18 until something is in it."""
    points = adapters.points(spark, sf_dir).select("point_id", "x", "y")
    found = spatial.first_within(points, adapters.lamps(spark, sf_dir).select("lamp_id", "x", "y"), "point_id", "lamp_id", [3.0, 9.0, 18.0])
    return found.select("point_id", "lamp_id", F.col("reach").cast("int").alias("reach"))
