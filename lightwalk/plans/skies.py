"""Sky tables of several instants, and the index of every side at each of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import astro, exposure
from ..operators import series, sky
from ..sources import adapters
from ..sources.storage import materialize, spread
from .registry import query, r6



def instants(spark, sf_dir):
    """Eight parts of the day; height of the sun (some below the horizon) and clearness, over all sky types, by how many events they have."""
    n = adapters.table(spark, sf_dir, "events").groupBy(F.floor(F.hour("ts") / 3).cast("int").alias("instant")).agg(F.count("*").alias("n"))
    return n.select("instant", F.radians(F.col("n") * 7 % 64 - 3.0).alias("altitude"), F.radians(F.col("instant") * 45.0).alias("azimuth"), (F.col("n") % 600 / F.lit(100.0) + 1.05).alias("epsilon"))


_SKY_SQL = (
    "kinds as (select * from (values "
    + ", ".join(f"({k}, {t[0]}E0, {t[1]}E0, {t[2]}E0, {t[3]}E0, {t[4]}E0, {t[5]}E0)" for k, t in enumerate(sky.TYPES))
    + """) v(k, eps, a, b, c, d, e)),
    spot as (select i.*, (select sum(greatest(0E0, least(1E0, (ln(greatest(1E0, i.epsilon)) - ln(l.eps))/(ln(h.eps) - ln(l.eps))))) from kinds l join kinds h on h.k = l.k + 1) as place from instants i),
    ty as (select s.*, k.k, a, b, c, d, e, 1 - abs(place - k.k) as share, pi()/2 - greatest(altitude, 0) as zs from spot s join kinds k on abs(place - k.k) < 1),
    cellsky as (
      select ty.*, 'sky' as kind, sector, band, pi()/2 - radians((band + 0.5E0)*2) as z, (sector + (s + 0.5E0)/3)*2*pi()/32 as az, 0E0 as off, 2*pi()/32/3*radians(2) as w from ty, (select unnest(range(32)) as sector), (select unnest(range(45)) as band), (select unnest(range(3)) as s)
      union all select ty.*, 'wall', sector, band, pi()/2 - radians((band + 0.5E0)*3), 2*pi()*sector/32 + pi() + ((s + 0.5E0)*pi()/8 - pi()/2), (s + 0.5E0)*pi()/8 - pi()/2, pi()/8*radians(3) from ty, (select unnest(range(32)) as sector), (select unnest(range(30)) as band), (select unnest(range(8)) as s)),
    chis as (select *, acos(greatest(-1E0, least(1E0, cos(zs)*cos(z) + sin(zs)*sin(z)*cos(az - azimuth)))) as chi from cellsky),
    lit as (select instant, k, share, kind, sector, band, w*greatest(0E0, (1 + a*exp(b/greatest(cos(z), 0.01E0)))*(1 + c*(exp(d*chi) - exp(d*pi()/2)) + e*cos(chi)*cos(chi))/((1 + a*exp(b))*(1 + c*(exp(d*zs) - exp(d*pi()/2)) + e*cos(zs)*cos(zs))))
      *case kind when 'sky' then cos(z)*sin(z) else sin(z)*sin(z)*cos(off) end as v from chis),
    totals as (select instant, k, sum(v) as total from lit where kind = 'sky' group by 1, 2),
    bands as (select instant, kind, sector, band, sum(share*v/total) as v from lit join totals using (instant, k) group by 1, 2, 3, 4),
    above as (select instant, kind, sector, band, sum(v) over (partition by instant, kind, sector order by band desc) as v from bands union all select distinct instant, kind, sector, case kind when 'sky' then 45 else 30 end, 0E0 from bands)
    """
)
_INSTANTS_SQL = "instants as (select instant, radians(n*7 % 64 - 3E0) as altitude, radians(instant*45E0) as azimuth, 1.05E0 + n % 600/100E0 as epsilon from (select cast(extract(hour from ts) as int) // 3 as instant, count(*) as n from events group by 1)), "


@query("with " + _INSTANTS_SQL + _SKY_SQL + "select cast(instant as int) as instant, kind, cast(sector as int) as sector, cast(band as int) as band, round(v, 7) as above from above")
def m9_m12_sky_tables(spark, sf_dir):
    made = sky.tables(instants(spark, sf_dir))
    one = lambda kind: made.select("instant", F.lit(kind).alias("kind"), F.posexplode(kind).alias("sector", "t")).select("instant", "kind", "sector", F.posexplode("t").alias("band", "above"))
    return one("sky").unionByName(one("wall")).select("instant", "kind", "sector", "band", F.round("above", 7).alias("above"))


@query(
    _INSTANTS_SQL + _SKY_SQL
    + """,
    h as (select segment_id, svf/100E0 as svf, unnest(horizon) as h, generate_subscripts(horizon, 1) - 1 as sector from sides),
    f as (select segment_id, any_value(svf) as svf, l.instant, sum(l.v + (u.v - l.v)*(h/2E0 - floor(h/2E0))) as factor, avg(cos(radians(h))*cos(radians(h))) as geometric from h join above l on l.kind = 'sky' and l.sector = h.sector and l.band = floor(h/2E0)
      join above u on u.kind = 'sky' and u.instant = l.instant and u.sector = h.sector and u.band = least(45, floor(h/2E0) + 1) group by segment_id, l.instant)
    select segment_id, cast(instant as int) as instant, round(factor, 6) as factor, round(geometric, 6) as geometric, round(coalesce(factor, svf), 6) as reach from f
    """,
    "sides",
)
def m13_m14_m22_sky_reach(spark, sf_dir):
    made = F.broadcast(sky.tables(instants(spark, sf_dir)).select("instant", "sky"))  # a row for each instant
    met = adapters.sides(spark, sf_dir).crossJoin(made)
    reach = sky.factor(F.col("sky"), F.col("horizon"))
    return met.select("segment_id", "instant", r6(reach).alias("factor"), r6(sky.geometric_view(F.col("horizon"))).alias("geometric"), r6(F.coalesce(reach, F.col("svf") / 100.0)).alias("reach"))


# --- the flagship: every side at several instants --------------------------------------------------------------------

#: Minutes of the day, cloud, rain in mm, heading in degrees (none: the worst case), measured beam and diffuse light in W/m2.
CONTEXTS = [(420, 0.1, 0.0, None, None, None), (847, 0.25, 0.0, None, None, None), (1080, 0.6, 1.5, 200.0, None, None), (1200, 0.0, 0.0, 280.0, 310.0, 90.0), (1290, 0.3, 0.4, None, None, None)]
MIDNIGHT = 1719792000000  # 2024-07-01 00:00 UTC


#: The day by quarter hours from 5:00, under a quarter of cloud.
STEPS = [(300 + 15 * k, 0.25, 0.0, None, None, None) for k in range(69)]
_WRITTEN: dict = {}


def contexts(spark, instants=None):
    """One row for each instant (minutes, cloud, rain, heading, beam, diffuse; CONTEXTS by default): sun, sky, its tables, and all that does not depend on the side.

    Written once in an application and read by every query that asks for the same instants.
    """
    rows = [(k, *c) for k, c in enumerate(CONTEXTS if instants is None else instants)]
    key = (spark.sparkContext.applicationId, tuple(rows))
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(_contexts(spark, rows), "contexts")
    return _WRITTEN[key]


def _contexts(spark, rows):
    base = spark.createDataFrame(rows, "instant int, minutes int, cloud double, rain double, heading double, beam double, spread double")
    altitude, azimuth = astro.sun_position(F.col("minutes") * 60000.0 + float(MIDNIGHT), F.lit(48.8566), F.lit(2.3522))
    placed = base.withColumns({"altitude": altitude, "azimuth": azimuth, "heading": F.radians("heading"), "wet": exposure.wetness(F.col("rain"))})
    lit = materialize(placed.withColumns(exposure.sky_conditions(F.col("altitude"), F.col("cloud"), F.col("beam"), F.col("spread"))), "instants")  # a few rows, read twice
    made = sky.tables(lit.select("instant", "altitude", "azimuth", "epsilon"))
    facing = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: -F.cos(F.col("azimuth") - i * (2 * math.pi / 32)))
    return lit.withColumn("facing", facing).join(made.select("instant", "sky", "wall"), "instant")


def evaluated(sides, contexts, sent=500):
    """Every side at every instant, with the parts of the index.

    Up to ``sent`` instants go to the sides, a table of some 25 kB for each; more of them meet the sides in a join by day
    part, so that none has to fit into a task's memory at once. What belongs to a side alone is made once, before they meet.
    """
    sides = spread(sides, "segment_id").withColumn("walls_", exposure.walls_of(F.col("horizon")))
    if contexts.count() <= sent:
        met = sides.crossJoin(F.broadcast(contexts))
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(contexts.count() // sent)))
        met = sides.withColumn("part_", parts).join(contexts.withColumn("part_", F.floor(F.col("instant") / sent).cast("int")), "part_")
    m = F.col("minutes")
    c = {k: F.col(k) for k in ("altitude", "azimuth", "heading", "wet", "direct", "diffuse", "up", "share", "horizon", "sky", "wall", "facing")} | {
        "walls": F.col("walls_"),
        "transmission": series.on_grid(F.col("sun"), m) / 100.0, "flicker": series.on_grid(F.col("flicker"), m) / 100.0, "svf": F.col("svf") / 100.0, "veil": F.col("veil") / 100.0,
    }
    return exposure.measured(met, c, ["segment_id", "side", "work", "instant"])


_FLAGSHIP = (
    "raw as (select * from (values "
    + "{values}"
    + """) v(instant, minutes, cloud, rain, heading, beam, spread)),
    s1 as (select *, (1719792000 + minutes*60)/86400E0 + 2440587.5E0 - 2451545.0E0 as n from raw),
    s2 as (select *, radians(280.46E0 + 0.9856474E0*n) + radians(1.915E0*sin(radians(357.528E0 + 0.9856003E0*n)) + 0.02E0*sin(2*radians(357.528E0 + 0.9856003E0*n))) as lam, radians(23.439E0 - 0.0000004E0*n) as eps, radians(((18.697374558E0 + 24.06570982441908E0*n) % 24)*15 + 2.3522E0) as lst, radians(48.8566E0) as phi from s1),
    s3 as (select *, asin(sin(eps)*sin(lam)) as dec, lst - atan2(cos(eps)*sin(lam), cos(lam)) as ha from s2),
    s4 as materialized (select instant, minutes, cloud, rain, heading, beam, spread, asin(sin(phi)*sin(dec) + cos(phi)*cos(dec)*cos(ha)) as altitude, (atan2(-sin(ha)*cos(dec), sin(dec)*cos(phi) - cos(dec)*sin(phi)*cos(ha)) + 2*pi()) % (2*pi()) as azimuth from s3),
    s5 as (select *, greatest(0E0, sin(altitude)) as up, 1/(sin(radians(greatest(degrees(altitude), -0.5E0))) + 0.50572E0*pow(greatest(degrees(altitude), -0.5E0) + 6.07995E0, -1.6364E0)) as am, case when rain > 0 then least(1, pow(rain, 0.4E0)) else 0E0 end as wet from s4),
    s6 as (select *, 6.6296E0 + 1.7513E0*am - 0.1202E0*am*am + 0.0065E0*am*am*am - 0.00013E0*am*am*am*am as inv from s5),
    s7 as (select *, case when altitude > 0 then 133300*exp(-0.8662E0*4*am*(case when am > 20 then 1/(10.4E0 + 0.718E0*am) when inv > 0 then 1/inv else 0.1E0 end)) else 0 end as cdn, case when altitude > 0 then 400 + 13500*pow(greatest(sin(altitude), 0.01E0), 0.6E0) else 0 end as cdh from s6),
    s8 as (select *, case when beam is not null then greatest(0E0, beam)*105 else cdn*pow(1 - cloud, 1.5E0) end as direct, cdn*up + cdh as whole_clear from s7),
    s9 as (select *, case when beam is not null then least(45000E0, greatest(0E0, spread)*120) else least(45000E0, greatest(0E0, whole_clear*(1 - 0.75E0*pow(cloud, 3.4E0)) - direct*up)) end as diffuse from s8),
    s10 as (select *, case when beam is not null then direct*up + diffuse else whole_clear end as whole, ((greatest(1E0, diffuse) + direct)/greatest(1E0, diffuse) + 1.041E0*pow(greatest(0E0, pi()/2 - altitude), 3))/(1 + 1.041E0*pow(greatest(0E0, pi()/2 - altitude), 3)) as epsilon from s9),
    ctx as materialized (select *, case when whole > 0 then direct*up/whole else 0 end as share from s10),
    instants as (select instant, altitude, azimuth, epsilon from ctx), """
    + _SKY_SQL
    + """,
    bins as (select segment_id, unnest(horizon) as h, generate_subscripts(horizon, 1) - 1 as i, [horizon[1 + (g + 16) % 32] for g in range(32)] as across from sides),
    b1 as (select segment_id, i, h, degrees(atan(tan(radians(across[i + 1]))/2)) as seen from bins),
    toward as materialized (select s.segment_id, c.instant, tan(radians(s.horizon[1 + (cast(floor(p) as int) % 32)] + (s.horizon[1 + (cast(floor(p) as int) + 1) % 32] - s.horizon[1 + (cast(floor(p) as int) % 32)])*(p - floor(p)))) as side from sides s, (select instant, azimuth/(2*pi())*32 as p from ctx) c),
    tab as materialized (select instant, sector, list(v order by band) filter (kind = 'sky') as st, list(v order by band) filter (kind = 'wall') as wt from above group by 1, 2),
    b2 as materialized (select segment_id, instant, sum(st[cast(floor(h/2E0) as int) + 1] + (st[least(45, cast(floor(h/2E0) as int) + 1) + 1] - st[cast(floor(h/2E0) as int) + 1])*(h/2E0 - floor(h/2E0))) as reach,
        sum((1 - pow(cos(radians(h)), 2))) as view_,
        sum((1 - pow(cos(radians(h)), 2))*0.45E0*((wt[cast(floor(seen/3) as int) + 1] + (wt[least(30, cast(floor(seen/3) as int) + 1) + 1] - wt[cast(floor(seen/3) as int) + 1])*(seen/3 - floor(seen/3)))*diffuse + case when -cos(azimuth - 2*pi()*i/32) > 0 and altitude > 0 and h > 0
          then direct*cos(altitude)*(-cos(azimuth - 2*pi()*i/32))*greatest(0E0, least(1E0, 1 - greatest(0E0, side - tan(altitude)/greatest(-cos(azimuth - 2*pi()*i/32), 0.05E0))/tan(radians(h)))) else 0 end)) as lux
      from b1 join toward using (segment_id) join ctx using (instant) join tab on tab.instant = ctx.instant and tab.sector = b1.i group by 1, 2),
    e1 as (select s.segment_id, s.side, c.*, b.reach, case when view_ > 0 then lux/view_/pi() else 0 end as wall_luminance, t.side as toward, s.svf/100E0 as svf, s.veil/100E0 as veil, greatest(0E0, least(68E0, (c.minutes - 300)/15E0)) as f, s.sun, s.flicker
      from sides s join b2 b using (segment_id) join ctx c on c.instant = b.instant join toward t on t.segment_id = s.segment_id and t.instant = c.instant),
    e2 as (select *, (sun[cast(floor(f) as int) + 1] + (sun[least(69, cast(floor(f) as int) + 2)] - sun[cast(floor(f) as int) + 1])*(f - floor(f)))/100 as tr, (flicker[cast(floor(f) as int) + 1] + (flicker[least(69, cast(floor(f) as int) + 2)] - flicker[cast(floor(f) as int) + 1])*(f - floor(f)))/100 as fl from e1),
    e3 as (select *, tr*direct*up as lit_direct, reach*diffuse as lit_diffuse, case when altitude > 0 then greatest(0E0, least(1E0, 1 - toward/(2*tan(altitude)))) else 0 end as gsun, 0.02E0 + 0.98E0*pow(1 - up, 5) as fresnel, 1/greatest(0.4E0, 1 - 0.315E0*(1 - svf)) as bounces from e2),
    e4 as (select *, (0.5E0*tr + 0.5E0*gsun)*direct*up as ground_direct from e3),
    e5 as (select *, (wall_luminance + 0.5E0*(0.18E0*(1 - 0.3E0*wet)*(ground_direct + lit_diffuse)/pi()) + wet*fresnel*ground_direct/pi())*bounces as surface, degrees(altitude) as deg, share*9500 + 6500 as skyk,
      exp(0.03398E0*greatest(0E0, least(80E0, degrees(altitude))) + 0.00021E0*pow(greatest(0E0, least(80E0, degrees(altitude))), 2)) as p from e4),
    e6 as (select *, case when deg <= 0 then 1900 when deg <= 2 then 1900 + 250*deg when deg <= 5 then 2400 + 500*(deg - 2)/3 when deg <= 10 then 2900 + 700*(deg - 5)/5 when deg <= 20 then 3600 + 1000*(deg - 10)/10 when deg <= 30 then 4600 + 500*(deg - 20)/10 when deg <= 50 then 5100 + 500*(deg - 30)/20 else 5600 + 200*(deg - 50)/40 end as beamk from e5),
    e7 as (select *, {ratio_beam} as rb, {ratio_sky} as rs from e6),
    e8 as (select segment_id, side, instant, case when altitude > 0 then tr*share else 0 end as sun_, reach*least(1, pow(diffuse/25000, 0.7E0)) as sky_, least(1, pow((lit_direct*rb + lit_diffuse*rs)/90000, 0.6E0)) as bright, least(1, pow(greatest(0E0, surface)/8000, 0.7E0)) as reverb,
      case when altitude > 0 and tr > 0 then least(1, tr*(least(1, direct/128000)/(p*p)*(1 + wet*fresnel)/{peak!r}E0)*(case when heading is null then 1 else 0.3E0 + 0.7E0*greatest(0E0, cos(azimuth - heading)) end)) else 0 end as glare, fl*share as flick,
      case when veil > 0 then least(1, pow(veil/2.5E0, 0.6E0)) else 0 end as night, case when deg <= -6 then 1 when deg >= 2 then 0 else (2 - deg)/8 end as dark from e7)
    """
)


def _piecewise_sql(x: str, table: list) -> str:
    parts = " ".join(f"when {x} <= {x1} then {y0}E0 + ({y1}E0 - {y0}E0)*({x} - {x0})/{x1 - x0}E0" for (x0, y0), (x1, y1) in zip(table, table[1:], strict=False))
    return f"case when {x} <= {table[0][0]} then {table[0][1]}E0 {parts} else {table[-1][1]}E0 end"


_FLAGSHIP = _FLAGSHIP.replace("{ratio_beam}", _piecewise_sql("beamk", exposure.DAYLIGHT_MELANOPIC)).replace("{ratio_sky}", _piecewise_sql("skyk", exposure.DAYLIGHT_MELANOPIC)).replace("{peak!r}", repr(exposure.GLARE_PEAK))


def flagship_sql(instants) -> str:
    """The parts of the index (e8) at these instants, in the order of their fields."""
    told = lambda v, form: "null" if v is None else form.format(v)
    rows = [f"({k}, {m}, {c}E0, {r}E0, {told(h, 'radians({}E0)')}, {told(b, '{}E0')}, {told(d, '{}E0')})" for k, (m, c, r, h, b, d) in enumerate(instants)]
    return _FLAGSHIP.replace("{values}", ", ".join(rows))


_SCORE = "100*((0.34E0*sun_ + 0.18E0*sky_ + 0.16E0*bright + 0.14E0*reverb + 0.1E0*glare + 0.08E0*flick)*(1 - dark) + night*dark)"


@query(
    flagship_sql(CONTEXTS)
    + "select segment_id, side, cast(instant as int) as instant, round(sun_, 5) as sun, round(sky_, 5) as sky, round(bright, 5) as bright, round(reverb, 5) as reverb, round(glare, 5) as glare, round(flick, 5) as flicker, "
    + f"round({_SCORE}, 3) as score from e8",
    "sides",
)
def m21_m32_j15_components(spark, sf_dir):
    """The parts of the index, and the blended score, at five instants: clear, cloudy, wet, measured and at dusk."""
    parts = evaluated(adapters.sides(spark, sf_dir), contexts(spark))
    return parts.select("segment_id", "side", "instant", *[F.round(c, 5).alias(c) for c in exposure.WEIGHTS], F.round(exposure.score(parts) * 100, 3).alias("score"))


@query(
    flagship_sql(CONTEXTS)
    + f", i as (select segment_id, side, cast(instant as int) as instant, cast(least(100, greatest(0, floor(round({_SCORE}, 6) + 0.5E0))) as int) as index from e8) "
    + "select *, case when index >= 100 then 'Plein soleil' when index >= 80 then 'Très exposé' when index >= 60 then 'Exposé' when index >= 40 then 'Modéré' when index >= 20 then 'Ombragé' else 'Abrité' end as level from i",
    "sides",
)
def segment_index_at(spark, sf_dir):
    """The index of every side at five instants, and its level."""
    parts = evaluated(adapters.sides(spark, sf_dir), contexts(spark))
    value = exposure.index({k: F.col(k) for k in (*exposure.WEIGHTS, "night", "night_share")})
    return parts.select("segment_id", "side", "instant", value.alias("index")).withColumn("level", exposure.level(F.col("index")))
