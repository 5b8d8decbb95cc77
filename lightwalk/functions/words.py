"""What is shown and said: labels, colours, numbers as text. Names and colours are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import half_up

CARDINALS = ["nord", "nord-est", "est", "sud-est", "sud", "sud-ouest", "ouest", "nord-ouest"]
SCALE = [(0, "#1a2b4a"), (20, "#2b6b8f"), (40, "#4aa3a2"), (60, "#d9a441"), (80, "#e8663d"), (100, "#f7e463")]
UV_SCALE = [(0, "#1a2b4a"), (3, "#4aa3a2"), (6, "#d9a441"), (8, "#e8663d"), (11, "#f7e463")]
MANOEUVRES = {
    "depart": ("Départ", "↑"), "straight": ("Continuez", "↑"), "slight_left": ("Légèrement à gauche", "↖"), "slight_right": ("Légèrement à droite", "↗"), "left": ("Tournez à gauche", "←"),
    "right": ("Tournez à droite", "→"), "sharp_left": ("Tournez franchement à gauche", "↰"), "sharp_right": ("Tournez franchement à droite", "↱"), "crossing": ("Traversez", "⇅"), "arrive": ("Vous êtes arrivé", "◎"),
}
RANK = {"depart": 5, "arrive": 5, "crossing": 4, "sharp_left": 3, "sharp_right": 3, "left": 3, "right": 3, "slight_left": 2, "slight_right": 2, "straight": 1}
WEEKDAYS = ["dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi"]


def cardinal(east: Column, north: Column) -> Column:
    degrees = F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, CARDINALS)), (half_up(degrees / 45) % 8).cast("int") + 1)


def colour(value: Column, scale: list[tuple[float, str]] = SCALE) -> Column:
    """The colour of the last step that is reached."""
    out = F.lit(scale[0][1])
    for least, name in scale[1:]:
        out = F.when(value >= least, name).otherwise(out)
    return out


def ramp(value: Column, scale: list[tuple[float, str]] = SCALE) -> Column:
    """struct(red, green, blue): linear between the steps."""
    rgb = [(at, [int(name[k : k + 2], 16) for k in (1, 3, 5)]) for at, name in scale]

    def channel(i: int) -> Column:
        out = F.lit(float(rgb[0][1][i]))
        for (a, low), (b, high) in zip(rgb, rgb[1:], strict=False):
            out = F.when(value > a, F.lit(float(low[i])) + (F.least(value, F.lit(float(b))) - a) * ((high[i] - low[i]) / (b - a))).otherwise(out)
        return half_up(out).cast("int")

    return F.struct(*[channel(i).alias(n) for i, n in enumerate(("red", "green", "blue"))])


def clock(minutes: Column) -> Column:
    total = half_up(minutes)
    return F.format_string("%02d:%02d", F.floor(total / 60), F.pmod(total, F.lit(60)))


def fixed(x: Column, digits: int = 1) -> Column:
    """With so many digits behind the point."""
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def metres(x: Column) -> Column:
    return F.when(x >= 1000, F.concat(fixed(x / 1000), F.lit(" km"))).otherwise(F.concat((half_up(x / 5) * 5).cast("string"), F.lit(" m")))


def bytes_text(x: Column) -> Column:
    return F.when(x >= 1e9, F.concat(fixed(x / 1e9), F.lit(" Go"))).when(x >= 1e6, F.concat(half_up(x / 1e6).cast("string"), F.lit(" Mo"))).otherwise(F.concat(half_up(x / 1e3).cast("string"), F.lit(" ko")))


def duration(seconds: Column) -> Column:
    total = half_up(seconds)
    minutes = F.floor(total / 60)
    return F.when(seconds < 60, F.concat(fixed(seconds), F.lit(" s"))).when(minutes < 60, F.format_string("%d min %02d s", minutes, F.pmod(total, F.lit(60)))).otherwise(F.format_string("%d h %02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60))))


def sky_label(cloud: Column) -> Column:
    p = half_up(cloud * 100)
    name = F.when(p < 12, "ciel dégagé").when(p < 40, "peu nuageux").when(p < 70, "nuageux").when(p < 90, "très nuageux").otherwise("couvert")
    return F.concat(name, F.lit(" ("), p.cast("string"), F.lit(" %)"))


def _looked(kind: Column, i: int) -> Column:
    out = F.lit(MANOEUVRES["straight"][i])
    for k, v in MANOEUVRES.items():
        out = F.when(kind == k, v[i]).otherwise(out)
    return out


def manoeuvre(kind: Column, name: Column) -> Column:
    """The text of a manoeuvre on the screen."""
    label = _looked(kind, 0)
    return F.when(name.isNull() | (kind == "arrive"), label).when(kind == "crossing", F.concat(label, F.lit(" vers "), name)).otherwise(F.concat(label, F.lit(" — "), name))


def arrow(kind: Column) -> Column:
    return _looked(kind, 1)


def rank(kind: Column) -> Column:
    out = F.lit(0)
    for k, v in RANK.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def spoken_distance(x: Column) -> Column:
    return F.when(x >= 1000, F.concat(fixed(x / 1000), F.lit(" kilomètres"))).otherwise(F.concat(F.when(x >= 100, half_up(x / 50) * 50).otherwise(half_up(x / 10) * 10).cast("string"), F.lit(" mètres")))


def phrase(kind: Column, remaining: Column, name: Column, side: Column) -> Column:
    """The sentence that is said for a manoeuvre: how far, what, where, on which side."""
    label = _looked(kind, 0)
    lower = F.concat(F.lower(F.substring(label, 1, 1)), F.substring(label, 2, 100))
    action = F.when(remaining <= 20, label).otherwise(F.concat(F.lit("Dans "), spoken_distance(remaining), F.lit(", "), lower))
    street = F.when(name.isNull(), "").when(kind == "crossing", F.concat(F.lit(" vers "), name)).otherwise(F.concat(F.lit(", "), name))
    return F.when(kind == "arrive", "Vous êtes arrivé.").when(kind == "depart", "Départ.").otherwise(F.concat(action, street, F.when(side.isNull(), "").otherwise(F.concat(F.lit(", trottoir "), side)), F.lit(".")))


def day_label(day: Column, today: Column) -> Column:
    days = F.datediff(day, today)
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day))
    return F.when(days == 0, "aujourd'hui").when(days == 1, "demain").when(days == 2, "après-demain").otherwise(F.concat(name, F.lit(" "), F.dayofmonth(day).cast("string")))


#: Letters with marks, and what is left of them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzAAAAAACEEEEIIIINOOOOOUUUUY"


def normalised(text: Column) -> Column:
    """Without marks and case, with single blanks in place of all but Latin letters and digits."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, MARKED, PLAIN)), "[^a-z0-9]+", " "))


def shortened(text: Column) -> Column:
    """The first three parts of an address."""
    return F.trim(F.substring_index(text, ",", 3))
