"""Finding places by name, links to routes, and what is said on the way."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import words
from ..functions.num import half_up
from ..sources import adapters
from ..sources.adapters import table
from .registry import query, r6

_STREETS = """
    ns as (select case when src % 3 = 0 then 'Rue de l''Étoile ' || (src % 17) when src % 3 = 1 then 'Allée Sévigné ' || (src % 13) else 'Quai ' || (src % 11) end as name, n.lon, n.lat from edges e join nodes n on n.node_id = e.src),
    streets as (select name as label, round(sum(cast(round(lon*1e7) as bigint))/count(*)/1e7, 6) as lon, round(sum(cast(round(lat*1e7) as bigint))/count(*)/1e7, 6) as lat, count(*) as edges from ns group by 1),
    norm as (select *, trim(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', ' ', 'g')) as hay from streets)
"""


def streets(spark, sf_dir):
    """Streets by name, at the mean of the nodes that their edges start from."""
    k = F.col("src")
    text = lambda head, n: F.concat(F.lit(head), (k % n).cast("string"))
    name = F.when(k % 3 == 0, text("Rue de l'Étoile ", 17)).when(k % 3 == 1, text("Allée Sévigné ", 13)).otherwise(text("Quai ", 11))
    met = adapters.edges(spark, sf_dir).join(adapters.nodes(spark, sf_dir).withColumnRenamed("node_id", "src"), "src").select(name.alias("label"), "lon", "lat")
    mean = lambda c: r6(F.sum(F.round(F.col(c) * 1e7).cast("long")) / F.count("*") / 1e7).alias(c)  # noqa: E731 whole numbers: the sum does not depend on the order
    return met.groupBy("label").agg(mean("lon"), mean("lat"), F.count("*").alias("edges"))


def searched(places, text: str, limit: int = 6):
    """Places whose normalised label has the normalised text in it, those that begin with it first, then the shorter ones; nothing for fewer than two letters."""
    needle = words.normalised(F.lit(text))
    hay = words.normalised(F.col("label"))
    hits = places.where((F.length(needle) >= 2) & (F.instr(hay, needle) > 0)).withColumns({"_mid": (F.instr(hay, needle) > 1).cast("int"), "_len": F.length(hay)})
    return hits.orderBy("_mid", "_len", "label").limit(limit).drop("_mid", "_len")


def merged(local, remote, limit: int = 7):
    """Local hits, then remote ones (``rank``: their order) whose normalised label is new, the first of each; so many in all."""
    keyed = remote.withColumn("_key", words.normalised(F.col("label")))
    new = keyed.join(local.select(words.normalised(F.col("label")).alias("_key")).distinct(), "_key", "left_anti")
    once = new.groupBy("_key").agg(F.min(F.struct("rank", "label", "source")).alias("b")).select("b.*")
    both = local.select("rank", "label", "source").withColumn("_remote", F.lit(0)).unionByName(once.withColumn("_remote", F.lit(1)))
    return both.orderBy("_remote", "rank").limit(limit).drop("_remote")


@query("w_ as (select 1)," + _STREETS + "select label, lon, lat, edges, hay as normalised from norm", "nodes", "edges")
def a9_g6_street_names(spark, sf_dir):
    return streets(spark, sf_dir).withColumn("normalised", words.normalised(F.col("label")))


@query("w_ as (select 1)," + _STREETS + "select label, lon, lat, edges from norm where strpos(hay, 'sevig') > 0 order by case when starts_with(hay, 'sevig') then 0 else 1 end, length(hay), label limit 6", "nodes", "edges")
def t1_search_without_accents(spark, sf_dir):
    return searched(streets(spark, sf_dir), "Sévig")


@query(
    "w_ as (select 1)," + _STREETS
    + """
    , loc as (select row_number() over (order by case when starts_with(hay, 'rue') then 0 else 1 end, length(hay), label) as rank, label, hay from norm where strpos(hay, 'rue') > 0 qualify rank <= 6),
    rem as (select p_partkey as rank, case when p_partkey % 2 = 0 then 'RUE DE L’ETOILE ' || (p_partkey % 19) else p_name end as label from part),
    new as (select rank, label, trim(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', ' ', 'g')) as hay from rem),
    once as (select rank, label from new where hay not in (select hay from loc) qualify row_number() over (partition by hay order by rank) = 1),
    a as (select 0 as o, rank, label, 'réseau' as source from loc union all select 1, rank, label, 'adresse' from once)
    select rank, label, source from a order by o, rank limit 7
    """,
    "nodes", "edges",
)
def t2_j13_merged_suggestions(spark, sf_dir):
    few = searched(streets(spark, sf_dir), "rue")  # six rows
    mid = (F.instr(words.normalised(F.col("label")), F.lit("rue")) > 1).cast("int")
    local = few.withColumn("rank", F.row_number().over(Window.orderBy(mid, F.length(words.normalised(F.col("label"))), "label")).cast("long")).withColumn("source", F.lit("réseau"))
    k = F.col("p_partkey")
    answers = table(spark, sf_dir, "part").select(k.alias("rank"), F.when(k % 2 == 0, F.concat(F.lit("RUE DE L’ETOILE "), (k % 19).cast("string"))).otherwise(F.col("p_name")).alias("label"), F.lit("adresse").alias("source"))  # what a service would answer
    return merged(local, answers)


@query(
    """
    r as (select s_suppkey as link_id, lon, lat, case when s_suppkey % 3 = 0 then null else s_name end as label, cast((s_suppkey*7) % 90 as int) as priority, s_suppkey % 4 = 0 as navigating from (select *, 2.345E0 + ((s_suppkey*7919) % 10007)/10007E0*0.017E0 as lon, 48.853E0 + ((s_suppkey*104729) % 10009)/10009E0*0.007E0 as lat from supplier)),
    w as (select *, printf('%.5f', lon) || ',' || printf('%.5f', lat) || '|' || coalesce(label, '') as place from r)
    select link_id, 'de=' || replace(replace(replace(place, ',', '%2C'), '|', '%7C'), '#', '%23') || '&p=' || priority || case when navigating then '&nav=1' else '' end as link, cast(printf('%.5f', lon) as double) as lon, cast(printf('%.5f', lat) as double) as lat,
      coalesce(label, printf('%.5f', lat) || ', ' || printf('%.5f', lon)) as label, case when priority between 0 and 60 then priority end as priority, navigating from w
    """,
    "lamps",
)
def g7_route_links(spark, sf_dir):
    """Places written into a link and read from it again; what is out of range is ignored."""
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(
        k.alias("link_id"), adapters.lon(k).alias("lon"), adapters.lat(k).alias("lat"), F.when(k % 3 != 0, F.col("s_name")).alias("label"), (k * 7 % 90).cast("int").alias("priority"), (k % 4 == 0).alias("navigating")
    )
    place = F.concat(F.format_string("%.5f,%.5f|", "lon", "lat"), F.coalesce("label", F.lit("")))
    written = r.select("link_id", F.concat(F.lit("de="), F.url_encode(place), F.lit("&p="), F.col("priority").cast("string"), F.when(F.col("navigating"), "&nav=1").otherwise("")).alias("link"))
    url = F.concat(F.lit("https://host/?"), F.col("link"))
    read = lambda name: F.parse_url(url, F.lit("QUERY"), F.lit(name))
    text = F.url_decode(read("de"))
    at = lambda i: F.split(F.split(text, r"\|")[0], ",")[i].try_cast("double")
    told = F.substring_index(text, "|", -1)
    p = read("p").try_cast("int")
    return written.select("link_id", "link", at(0).alias("lon"), at(1).alias("lat"), F.when(told != "", told).otherwise(F.format_string("%.5f, %.5f", at(1), at(0))).alias("label"), F.when(p.between(0, 60), p).alias("priority"), F.coalesce(read("nav") == "1", F.lit(False)).alias("navigating"))


@query(
    """
    with m as (select event_id as k, ['depart', 'straight', 'slight_left', 'right', 'sharp_left', 'crossing', 'arrive'][1 + event_id % 7] as kind, (event_id*37) % 1500 as remaining, case when event_id % 3 <> 0 then 'Rue ' || (event_id % 9) end as name, case when event_id % 4 = 0 then 'nord' end as side, (event_id*13) % 90 as off from events),
    l as (select *, case kind when 'depart' then 'Départ' when 'straight' then 'Continuez' when 'slight_left' then 'Légèrement à gauche' when 'right' then 'Tournez à droite' when 'sharp_left' then 'Tournez franchement à gauche' when 'crossing' then 'Traversez' else 'Vous êtes arrivé' end as label from m),
    d as (select *, case when remaining >= 1000 then printf('%.1f', round(remaining/1000E0, 1)) || ' kilomètres' else cast(case when remaining >= 100 then floor(remaining/50E0 + 0.5)*50 else floor(remaining/10E0 + 0.5)*10 end as bigint) || ' mètres' end as far from l)
    select k as event_id, case when name is null or kind = 'arrive' then label when kind = 'crossing' then label || ' vers ' || name else label || ' — ' || name end as shown, case kind when 'depart' then '↑' when 'straight' then '↑' when 'slight_left' then '↖' when 'right' then '→' when 'sharp_left' then '↰' when 'crossing' then '⇅' else '◎' end as arrow,
      case kind when 'depart' then 5 when 'arrive' then 5 when 'crossing' then 4 when 'straight' then 1 when 'slight_left' then 2 else 3 end as rank,
      case when kind = 'arrive' then 'Vous êtes arrivé.' when kind = 'depart' then 'Départ.' else case when remaining <= 20 then label else 'Dans ' || far || ', ' || lower(label[1]) || label[2:] end || case when name is null then '' when kind = 'crossing' then ' vers ' || name else ', ' || name end || case when side is null then '' else ', trottoir ' || side end || '.' end as said,
      case when off > 35 then 'À ' || cast(floor(off/5E0 + 0.5)*5 as bigint) || ' m de l''itinéraire' else case when remaining >= 1000 then printf('%.1f', round(remaining/1000E0, 1)) || ' km' else cast(floor(remaining/5E0 + 0.5)*5 as bigint) || ' m' end || ' · ' || cast(floor(remaining/1.35E0/60 + 0.5) as bigint) || ' min' end as progress
    from d
    """
)
def g5_g18_q8_spoken_guidance(spark, sf_dir):
    """A manoeuvre as it is shown and said, and what is left of the way; off the route, how far."""
    k = F.col("event_id")
    kinds = ["depart", "straight", "slight_left", "right", "sharp_left", "crossing", "arrive"]
    m = table(spark, sf_dir, "events").select(
        "event_id", adapters.chosen(k, kinds).alias("kind"), (k * 37 % 1500).alias("remaining"), F.when(k % 3 != 0, F.concat(F.lit("Rue "), (k % 9).cast("string"))).alias("name"), F.when(k % 4 == 0, "nord").alias("side"), (k * 13 % 90).alias("off")
    )
    kind, left, name = F.col("kind"), F.col("remaining"), F.col("name")
    whole = lambda c: half_up(c).cast("string")
    progress = F.when(F.col("off") > 35, F.concat(F.lit("À "), (half_up(F.col("off") / 5) * 5).cast("string"), F.lit(" m de l'itinéraire"))).otherwise(F.concat(words.metres(left), F.lit(" · "), whole(left / 1.35 / 60), F.lit(" min")))
    return m.select("event_id", words.manoeuvre(kind, name).alias("shown"), words.arrow(kind).alias("arrow"), words.rank(kind).alias("rank"), words.phrase(kind, left, name, F.col("side")).alias("said"), progress.alias("progress"))
