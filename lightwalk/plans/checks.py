"""Audits: how well modelled shade agrees with an image, and what a dataset holds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import raster
from ..sources import adapters
from ..sources.adapters import table
from .registry import query, r6

_IMAGE = "image as (select cast(event_id % 8 as int) as site, event_id as k, event_id // 100 as row, event_id % 100 as col, ((event_id*29) % 101)/100E0 as field, cast(least(255, 40 + floor(1.2E0*((event_id*29) % 101)) + (event_id*7) % 60) as int) as lum from events),"


def image(spark, sf_dir):
    """An image of 100 columns: the modelled share of sun of each pixel, and its luminance."""
    k = F.col("event_id")
    share = k * 29 % 101
    lum = F.least(F.lit(255), F.floor(share * 1.2) + 40 + k * 7 % 60).cast("int")
    return table(spark, sf_dir, "events").select((k % 8).cast("int").alias("site"), k.alias("k"), F.floor(k / 100).alias("row"), (k % 100).alias("col"), (share / 100.0).alias("field"), lum.alias("lum"))


_RECORD = (
    _IMAGE
    + """
    c as (select site, count(*) as n, avg(cast(lum as double)) filter (field > 0.5) as sun, avg(cast(lum as double)) filter (field <= 0.5) as shadow, avg(cast(field <= 0.5 as int)) as shade,
      case when sqrt(count(*)*sum(field*field) - sum(field)*sum(field))*sqrt(count(*)*sum(cast(lum as double)*lum) - cast(sum(lum) as double)*sum(lum)) > 1e-9 then (count(*)*sum(field*lum) - sum(field)*sum(lum))/(sqrt(count(*)*sum(field*field) - sum(field)*sum(field))*sqrt(count(*)*sum(cast(lum as double)*lum) - cast(sum(lum) as double)*sum(lum))) else 0 end as r from image group by 1),
    s as (select i.site, sqrt(sum(pow(lum - case when field > 0.5 then sun else shadow end, 2))/greatest(1, any_value(n) - 2)) as spread, avg(cast((field > 0.5) = (lum >= (sun + shadow)/2) as int)) as agreement,
      sum(cast(field <= 0.5 and lum < (sun + shadow)/2 as int))/cast(greatest(1, sum(cast(field <= 0.5 or lum < (sun + shadow)/2 as int))) as double) as iou from image i join c using (site) group by 1),
    h as (select site, lum, count(*) as n from image group by 1, 2), w as (select site, lum, sum(n) over o as below, sum(n*lum) over o as low, sum(n) over (partition by site) as total, sum(n*lum) over (partition by site) as all_ from h window o as (partition by site order by lum)),
    t as (select site, arg_max(lum, (v, -lum)) as threshold from (select *, case when below < total then cast(below as double)*(total - below)*pow(cast(all_ - low as double)/(total - below) - cast(low as double)/below, 2) else -1 end as v from w) group by 1),
    m as (select i.site, any_value(threshold) as threshold, avg(cast(lum as double)) filter (lum < threshold) as dark, avg(cast(lum as double)) filter (lum >= threshold) as light, count(*) as n from image i join t using (site) group by 1),
    o as (select i.site, any_value(threshold) as threshold, (any_value(light) - any_value(dark))/greatest(1, sqrt(sum(pow(lum - case when lum < threshold then dark else light end, 2))/greatest(1, any_value(n) - 2))) as ceiling from image i join m using (site) group by 1),
    rec as (select c.site, c.n, r, shade, agreement, iou, sun - shadow as contrast, spread, (sun - shadow)/greatest(1, spread) as separability, threshold, ceiling, (sun - shadow)/greatest(1, spread)/greatest(0.01, ceiling) as reach from c join s using (site) join o using (site))
    """
)


def records(spark, sf_dir):
    """One record of agreement for each site."""
    i, lum = image(spark, sf_dir), F.col("lum").cast("double")
    lit = F.col("field") > 0.5
    n, x, y = F.count("*"), F.sum("field"), F.sum(lum)
    bottom = F.sqrt(n * F.sum(F.col("field") * F.col("field")) - x * x) * F.sqrt(n * F.sum(lum * lum) - y * y)
    r = F.when(bottom > 1e-9, (n * F.sum(F.col("field") * lum) - x * y) / bottom).otherwise(0.0)
    c = i.groupBy("site").agg(n.alias("n"), F.avg(F.when(lit, lum)).alias("sun"), F.avg(F.when(~lit, lum)).alias("shadow"), F.avg((~lit).cast("int")).alias("shade"), r.alias("r"))
    few = F.broadcast(c.select("site", "n", "sun", "shadow"))  # a row for each site
    seen = F.col("lum") >= (F.col("sun") + F.col("shadow")) / 2
    one = lambda b: F.sum(b.cast("int"))
    own = F.when(lit, F.col("sun")).otherwise(F.col("shadow"))
    s = i.join(few, "site").groupBy("site").agg(
        F.sqrt(F.sum(F.pow(lum - own, F.lit(2.0))) / F.greatest(F.lit(1), F.first("n") - 2)).alias("spread"), F.avg((lit == seen).cast("int")).alias("agreement"), (one(~lit & ~seen) / F.greatest(F.lit(1), one(~lit | ~seen))).alias("iou")
    )
    h = i.groupBy("site", "lum").agg(F.count("*").alias("m"))
    o, every = Window.partitionBy("site").orderBy("lum"), Window.partitionBy("site")  # 256 rows a site
    mass = F.col("m") * F.col("lum")
    w = h.select("site", "lum", "m", F.sum("m").over(o).alias("below"), F.sum(mass).over(o).alias("low"), F.sum("m").over(every).alias("total"), F.sum(mass).over(every).alias("all"))
    above = F.col("total") - F.col("below")
    gap = (F.col("all") - F.col("low")) / above - F.col("low") / F.col("below")
    between = F.when(above > 0, F.col("below").cast("double") * above * gap * gap).otherwise(-1.0)
    t = w.groupBy("site").agg(F.max_by("lum", F.struct(between.alias("v"), (-F.col("lum")).alias("l"))).alias("threshold"))
    # Both classes' means and squares from the histogram: the image is not read again.
    split = h.join(t, "site").withColumns({"dark_": F.col("lum") < F.col("threshold"), "l": F.col("lum").cast("double")})
    part = lambda f: (F.sum(F.when(F.col("dark_"), f)), F.sum(F.when(~F.col("dark_"), f)))
    (n0, n1), (s0, s1), (q0, q1) = part(F.col("m")), part(F.col("m") * F.col("l")), part(F.col("m") * F.col("l") * F.col("l"))
    spread = F.sqrt((q0 - s0 * s0 / n0 + q1 - s1 * s1 / n1) / F.greatest(F.lit(1), n0 + n1 - 2))
    best = split.groupBy("site").agg(F.first("threshold").alias("threshold"), ((s1 / n1 - s0 / n0) / F.greatest(F.lit(1.0), spread)).alias("ceiling"))
    contrast = F.col("sun") - F.col("shadow")
    separability = contrast / F.greatest(F.lit(1.0), F.col("spread"))
    return c.join(s, "site").join(best, "site").select("site", "n", "r", "shade", "agreement", "iou", contrast.alias("contrast"), "spread", separability.alias("separability"), "threshold", "ceiling", (separability / F.greatest(F.lit(0.01), F.col("ceiling"))).alias("reach"))


_ROUNDED = ("r", "shade", "agreement", "iou", "contrast", "spread", "separability", "ceiling", "reach")


@query("with " + _RECORD + "select site, n, threshold, " + ", ".join(f"round({c}, 5) as {c}" for c in _ROUNDED) + ", r < 0.5 as weak, (case when contrast < 55 then ['contrast'] else [] end) || (case when shade < 0.12 or shade > 0.6 then ['shade'] else [] end) as reasons from rec")
def a19_a22_a35_f15_score_records(spark, sf_dir):
    """Correlation, agreement, overlap, contrast, spread, separability and its ceiling for each site, and why a site is not suited."""
    reasons = F.filter(F.array(F.when(F.col("contrast") < 55, "contrast"), F.when((F.col("shade") < 0.12) | (F.col("shade") > 0.6), "shade")), lambda x: x.isNotNull())
    return records(spark, sf_dir).select("site", "n", "threshold", *[F.round(c, 5).alias(c) for c in _ROUNDED], (F.col("r") < 0.5).alias("weak"), reasons.alias("reasons"))


@query(
    "with " + _RECORD
    + """
    select count(*) as sites, list_extract(list(round(r, 6) order by r), cast(count(*)//2 as int) + 1) as median_r, round(min(r), 6) as least_r, round(max(r), 6) as most_r, arg_min(site, (r, site)) as worst, list_extract(list(round(agreement, 6) order by agreement), cast(count(*)//2 as int) + 1) as median_agreement,
      round(avg(reach), 6) as mean_reach, list_extract(list(round(separability/ceiling, 6) order by separability/ceiling), cast(count(*)//2 as int) + 1) as median_ratio from rec
    """
)
def a36_campaign(spark, sf_dir):
    """The campaign over all sites: upper medians, extremes, the worst site."""
    rec = records(spark, sf_dir)
    middle = lambda c: F.element_at(F.array_sort(F.collect_list(F.round(c, 6))), (F.floor(F.count("*") / 2) + 1).cast("int"))  # noqa: E731 a row for each site
    return rec.agg(
        F.count("*").alias("sites"), middle(F.col("r")).alias("median_r"), F.round(F.min("r"), 6).alias("least_r"), F.round(F.max("r"), 6).alias("most_r"), F.min_by("site", F.struct("r", "site")).alias("worst"),
        middle(F.col("agreement")).alias("median_agreement"), F.round(F.avg("reach"), 6).alias("mean_reach"), middle(F.col("separability") / F.col("ceiling")).alias("median_ratio"),
    )


OFFSETS = [-180, -120, -60, -30, -10, 0, 10, 30, 60, 120, 180]


@query(
    "with " + _IMAGE
    + """
    f as (select i.*, o, (((k*29 + 101000 + o*3) % 101)/100E0) as moved from image i, (select unnest([-180, -120, -60, -30, -10, 0, 10, 30, 60, 120, 180]) as o)),
    r as (select site, o, round(corr(moved, lum), 6) as r, avg(cast((field > 0.5) = (moved > 0.5) as int)) as overlap from f group by 1, 2),
    d as (select site, max(r) filter (o = 0) as r0, arg_max(o, (r, -o)) as best, max(r) as best_r, list(r order by o) as profile, greatest(0, max(r) filter (abs(o) = 120)) as shifted, arg_max(overlap, (r, -o)) filter (abs(o) = 120) as overlap from r group by 1)
    select site, cast(best as int) as best, best_r, best_r - r0 > 0.005 as significant, profile, round(1 - shifted/greatest(1e-6, r0), 5) as collapse, round(overlap, 6) as overlap, round((1 - shifted/greatest(1e-6, r0))/greatest(0.01, 1 - overlap), 5) as normalised from d
    """
)
def a25_a26_a33_a34_candidate_suns(spark, sf_dir):
    """Correlation with the field of every candidate time: the best one, whether it is better for certain, the whole profile, and what remains under a decoy sun two hours off."""
    moved = (F.col("k") * 29 + 101000 + F.col("o") * 3) % 101 / 100.0
    f = image(spark, sf_dir).withColumn("o", F.explode(F.array(*map(F.lit, OFFSETS)))).withColumn("moved", moved)
    r = f.groupBy("site", "o").agg(r6(F.corr("moved", "lum")).alias("r"), F.avg(((F.col("field") > 0.5) == (F.col("moved") > 0.5)).cast("int")).alias("overlap"))
    key, decoy = F.struct("r", (-F.col("o")).alias("o")), F.abs("o") == 120
    d = r.groupBy("site").agg(
        F.max(F.when(F.col("o") == 0, F.col("r"))).alias("r0"), F.max_by("o", key).alias("best"), F.max("r").alias("best_r"), F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x.r).alias("profile"),
        F.greatest(F.lit(0.0), F.max(F.when(decoy, F.col("r")))).alias("shifted"), F.max_by("overlap", F.when(decoy, key)).alias("overlap"),
    )
    collapse = 1 - F.col("shifted") / F.greatest(F.lit(1e-6), F.col("r0"))
    return d.select("site", "best", "best_r", (F.col("best_r") - F.col("r0") > 0.005).alias("significant"), "profile", F.round(collapse, 5).alias("collapse"), r6(F.col("overlap")).alias("overlap"), F.round(collapse / F.greatest(F.lit(0.01), 1 - F.col("overlap")), 5).alias("normalised"))


BLOCK, SHIFT = 25, (3, 5)  # cells to a side of a patch of light; how far the image lies from the model


def patches(spark, sf_dir):
    """(row, col, lit, lum): patches of light where their events add up to an even number, and an image of them that lies a few cells off."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).cast("int").alias("row"), (F.col("event_id") % 100).cast("int").alias("col"), "event_id", "value")
    at = lambda c, by=0: F.floor((F.col(c) + by) / BLOCK).cast("int")
    blocks = e.groupBy(at("row").alias("br"), at("col").alias("bc")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) % 2 == 0).alias("lit"))
    placed = e.withColumns({"br": at("row"), "bc": at("col"), "sr": at("row", SHIFT[0]), "sc": at("col", SHIFT[1])})
    moved = blocks.select(F.col("br").alias("sr"), F.col("bc").alias("sc"), F.col("lit").alias("bright"))
    met = placed.join(blocks, ["br", "bc"]).join(moved, ["sr", "sc"], "left")
    return met.select("row", "col", "lit", (F.when(F.coalesce("bright", F.lit(False)), 180).otherwise(60) + F.col("event_id") % 20).alias("lum"))


@query(
    f"""
    with e0 as (select cast(event_id // 100 as int) as row, cast(event_id % 100 as int) as col, event_id, value from events),
    b as (select row // {BLOCK} as br, col // {BLOCK} as bc, sum(cast(round(value*100) as bigint)) % 2 = 0 as lit from e0 group by 1, 2),
    i as (select e0.row, e0.col, b.lit, case when coalesce(m.lit, false) then 180 else 60 end + event_id % 20 as lum from e0 join b on b.br = row // {BLOCK} and b.bc = col // {BLOCK} left join b m on m.br = (row + {SHIFT[0]}) // {BLOCK} and m.bc = (col + {SHIFT[1]}) // {BLOCK}),
    mid as (select (avg(cast(lum as double)) filter (lit) + avg(cast(lum as double)) filter (not lit))/2 as mid from i),
    m as (select row, col, lit, lum >= mid as seen from i, mid),
    e as (select row, col, coalesce(lit <> lead(lit) over r, false) or coalesce(lit <> lead(lit) over c, false) as model, coalesce(seen <> lead(seen) over r, false) or coalesce(seen <> lead(seen) over c, false) as observed from m window r as (partition by row order by col), c as (partition by col order by row)),
    d as (select a.row, a.col, min(4*least(abs(a.row - b.row), abs(a.col - b.col)) + 3*abs(abs(a.row - b.row) - abs(a.col - b.col))) as d from (select * from e where model) a, (select * from e where observed) b group by 1, 2),
    x as (select d/3E0*0.5E0 as err from d)
    select count(*) as edges, case when count(*) >= 50 then round(list_extract(list(err order by err), cast(floor((count(*) - 1)*0.5E0) as int) + 1), 6) end as median, case when count(*) >= 50 then round(list_extract(list(err order by err), cast(floor((count(*) - 1)*0.9E0) as int) + 1), 6) end as p90, case when count(*) >= 50 then round(avg(cast(err <= 2 as int)), 6) end as within_2m,
      round(max(err), 6) as farthest from x
    """
)
def a23_w14_w15_edge_accuracy(spark, sf_dir):
    """How far the edges of modelled shade lie from those in the image, by the 3-4 chamfer distance at any distance, half a metre to a cell."""
    i = patches(spark, sf_dir)
    lum = F.col("lum").cast("double")
    mid = F.broadcast(i.agg(((F.avg(F.when(F.col("lit"), lum)) + F.avg(F.when(~F.col("lit"), lum))) / 2).alias("mid")))  # one row
    m = i.crossJoin(mid).select("row", "col", "lit", (F.col("lum") >= F.col("mid")).alias("seen"))
    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    edge = lambda c: F.coalesce(F.col(c) != F.lead(c).over(by_row), F.lit(False)) | F.coalesce(F.col(c) != F.lead(c).over(by_col), F.lit(False))
    e = m.select("row", "col", edge("lit").alias("model"), edge("seen").alias("observed"))
    # Distances are few different numbers: quantiles come from their counts.
    counts = raster.chamfer(e, "observed").where("model and d is not null").groupBy("d").agg(F.count("*").alias("n"))
    o = Window.orderBy("d")
    ranked = counts.withColumns({"upto": F.sum("n").over(o), "total": F.sum("n").over(Window.partitionBy())})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q), F.col("d") / 3 * 0.5))
    enough = F.sum("n") >= 50
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.when(enough, r6(at(0.5))).alias("median"), F.when(enough, r6(at(0.9))).alias("p90"), F.when(enough, r6(F.sum(F.when(F.col("d") / 3 * 0.5 <= 2, F.col("n")).otherwise(0)) / F.sum("n"))).alias("within_2m"),
        r6(F.max(F.col("d") / 3 * 0.5)).alias("farthest"),
    )


@query(
    """
    s as (select segment_id, ['residential', 'footway', 'primary', 'steps'][1 + segment_id % 4] as class, segment_id % 9 <> 0 as known, case when segment_id % 5 = 0 then 0 else veil end as veil, segment_id % 3 = 0 as two_sided, segment_id % 11 = 0 as crossing, case when segment_id % 7 = 0 then 4E0 + segment_id % 9 end as width from sides)
    select class, count(*) as total, count(*) filter (not known) as unknown, count(*) filter (known and veil <= 1) as dark, round(100*count(*) filter (veil <= 1)/cast(count(*) as double), 4) as dark_share, count(*) filter (two_sided) as two_sided, count(*) filter (crossing) as crossings, count(width) as measured,
      count(*)*22 + (count(*) + count(*) filter (two_sided))*(2*69 + 32) + 4*count(*) filter (two_sided) as bytes, round((count(*)*22 + (count(*) + count(*) filter (two_sided))*(2*69 + 32) + 4*count(*) filter (two_sided))/cast(sum(count(*)*22 + (count(*) + count(*) filter (two_sided))*(2*69 + 32) + 4*count(*) filter (two_sided)) over () as double), 6) as share,
      rank() over (order by count(*) filter (not known) desc, class) as place
    from s group by class
    """,
    "sides",
)
def a17_a18_a29_tallies(spark, sf_dir):
    """What a dataset holds by class of street: lit, dark and unknown, two-sided, crossings, measured; its bytes and their share."""
    k = F.col("segment_id")
    s = adapters.sides(spark, sf_dir).select(
        adapters.chosen(k, ["residential", "footway", "primary", "steps"]).alias("class"), (k % 9 != 0).alias("known"), F.when(k % 5 == 0, 0).otherwise(F.col("veil")).alias("veil"), (k % 3 == 0).alias("two"), (k % 11 == 0).alias("crossing"), F.when(k % 7 == 0, k % 9 + 4.0).alias("width")
    )
    n, two = F.count("*"), F.count_if("two")
    bytes_ = n * 22 + (n + two) * (2 * 69 + 32) + two * 4
    t = s.groupBy("class").agg(
        n.alias("total"), F.count_if(~F.col("known")).alias("unknown"), F.count_if(F.col("known") & (F.col("veil") <= 1)).alias("dark"), F.round(F.count_if(F.col("veil") <= 1) * 100 / n, 4).alias("dark_share"),
        two.alias("two_sided"), F.count_if("crossing").alias("crossings"), F.count("width").alias("measured"), bytes_.alias("bytes"),
    )
    # A few classes: one window over all of them.
    return t.withColumns({"share": r6(F.col("bytes") / F.sum("bytes").over(Window.partitionBy())), "place": F.rank().over(Window.orderBy(F.desc("unknown"), "class")).cast("long")})


@query(
    """
    s as (select segment_id, list_filter([case when len(sun) <> 69 then 'sun' end, case when len(flicker) <> 69 then 'flicker' end, case when len(horizon) <> 32 then 'horizon' end, case when segment_id % 50 = 7 then 'length' end], lambda x: x is not null) as faults from (select segment_id, case when segment_id % 40 = 3 then sun[1:60] else sun end as sun, flicker, case when segment_id % 60 = 5 then horizon[1:16] else horizon end as horizon from sides))
    select * from s where len(faults) > 0
    """,
    "sides",
)
def f10_completeness(spark, sf_dir):
    """Sides whose series are not as long as the day or whose length is not above zero, with what is wrong."""
    k = F.col("segment_id")
    broken = adapters.sides(spark, sf_dir).select("segment_id", F.when(k % 40 == 3, F.slice("sun", 1, 60)).otherwise(F.col("sun")).alias("sun"), "flicker", F.when(k % 60 == 5, F.slice("horizon", 1, 16)).otherwise(F.col("horizon")).alias("horizon"), F.when(k % 50 == 7, 0.0).otherwise(12.0).alias("length"))
    tests = [("sun", F.size("sun") != 69), ("flicker", F.size("flicker") != 69), ("horizon", F.size("horizon") != 32), ("length", ~(F.col("length") > 0))]
    faults = F.filter(F.array(*[F.when(bad, n) for n, bad in tests]), lambda x: x.isNotNull())
    return broken.select("segment_id", faults.alias("faults")).where(F.size("faults") > 0)


@query(
    "with a as (select p_partkey as id, p_size*p_retailprice/100 as area from part), b as (select least(63, greatest(0, cast(floor(log2(greatest(1, area))*4) as int))) as bucket, count(*) as n from a where area >= 40 group by 1), c as (select bucket, sum(n) over (order by bucket desc) as kept, sum(n) over () as total from b) select cast(bucket as int) as bucket, cast(kept as bigint) as kept, case when total > 500 then case when bucket = (select max(bucket) from c where kept >= 500) then pow(2E0, bucket/4E0) end else 40E0 end as floor from c"
)
def w13_area_histogram(spark, sf_dir):
    """Areas in buckets of a quarter of an octave, from the largest down: the smallest area that still keeps 500 of them."""
    area = F.col("p_size") * F.col("p_retailprice") / 100
    b = table(spark, sf_dir, "part").where(area >= 40).groupBy(F.least(F.lit(63), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.lit(1.0), area)) * 4))).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    c = b.select("bucket", F.sum("n").over(Window.orderBy(F.desc("bucket"))).alias("kept"), F.sum("n").over(Window.partitionBy()).alias("total"))  # 64 rows at most
    last = F.max(F.when(F.col("kept") >= 500, F.col("bucket"))).over(Window.partitionBy())
    floor = F.when(F.col("total") > 500, F.when(F.col("bucket") == last, F.pow(F.lit(2.0), F.col("bucket") / 4))).otherwise(40.0)
    return c.select("bucket", "kept", floor.alias("floor"))

