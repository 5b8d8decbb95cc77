"""Predicates and lookups over the tags of streets, buildings, lamps and vegetation. Names and numbers are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.adapters import looked_up
from .num import finite

OFFSET = {
    "primary": 9.0, "primary_link": 9.0, "secondary": 8.0, "secondary_link": 8.0, "tertiary": 6.5, "tertiary_link": 6.5, "residential": 5.0, "unclassified": 5.0, "living_street": 4.0, "road": 5.0,
    "footway": 0.0, "path": 0.0, "steps": 0.0, "pedestrian": 0.0, "cycleway": 0.0, "track": 0.0, "service": 0.0,
}
LABELS = {
    "footway": "trottoir / cheminement", "pedestrian": "voie piétonne", "path": "sentier", "steps": "escalier", "living_street": "zone de rencontre", "residential": "rue",
    "service": "voie de desserte", "cycleway": "piste cyclable", "tertiary": "rue", "secondary": "avenue", "primary": "grand axe",
}
OVERVIEW = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "pedestrian"]
MOUNT_HEIGHT = {"Candélabre": 6.0, "Console": 5.0, "Projecteur": 8.0, "Plafond": 4.0, "Suspension": 5.5, "Applique": 3.5, "Borne": 0.9, "Sol": 0.15, "Mât": 9.0}

has = lambda c, *v: F.coalesce(F.col(c), F.lit("")).isin(*v)


def walkable() -> Column:
    barred = has("foot", "no") | has("access", "private", "no") | (has("highway", "service") & has("service", "parking_aisle"))
    return ~(barred | (has("tunnel", "yes") & ~has("highway", "footway", "path", "pedestrian", "steps")))


def cover_kind() -> Column:
    """0 open, 1 under a roof open at its ends, 2 closed in."""
    return F.when(has("tunnel", "yes", "covered", "passage") | has("indoor", "yes"), 2).when(has("tunnel", "building_passage") | ~has("covered", "", "no"), 1).otherwise(0)


def is_crossing() -> Column:
    return has("footway", "crossing") | has("highway", "crossing") | F.col("crossing").isNotNull()


def leading_number(text: Column) -> Column:
    """The number that a text begins with, null where there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d+\.?\d*)", 1).try_cast("double")


def nominal_offset() -> Column:
    """Metres from the axis to the sidewalk: by class, or half of a plausible width."""
    base, width = looked_up(F.col("highway"), OFFSET, 5.0), leading_number(F.col("width"))
    return F.when(base == 0, 0.0).when((width > 2) & (width < 60), F.least(width / 2, F.lit(14.0))).otherwise(base)


def highway_label(crossing: Column) -> Column:
    return F.when(crossing, "traversée piétonne").otherwise(looked_up(F.col("highway"), LABELS, "voie"))


def declared_absent() -> Column:
    """struct(left, right, separate): sides that a street is declared to have no sidewalk of its own on; null without a declaration."""
    told = lambda a, b, c: F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(c).alias("separate"))
    return F.when(has("sidewalk", "left"), told(False, True, False)).when(has("sidewalk", "right"), told(True, False, False)).when(has("sidewalk", "separate"), told(True, True, True)).when(has("sidewalk", "both"), told(False, False, False))


def positive(text: Column) -> Column:
    """A text as a number, if that is finite and above zero."""
    n = text.try_cast("double")
    return F.when(finite(n) & (n > 0), n)


def luminous_flux(flux: Column, power: Column) -> Column:
    return F.coalesce(F.least(positive(flux), F.lit(60000.0)), F.least(positive(power) * 95, F.lit(60000.0)), F.lit(0.0))


def mounting_height(declared: Column, kind: Column) -> Column:
    n = positive(declared)
    return F.when((n >= 0.1) & (n <= 30), n).otherwise(looked_up(F.trim(kind), MOUNT_HEIGHT, 5.0))


def colour_temperature(declared: Column, family: Column) -> Column:
    n, f = positive(declared), F.lower(F.coalesce(family, F.lit("")))
    told = F.when(f.contains("sodium basse"), 1800.0).when(f.contains("sodium"), 2000.0).when(f.contains("iodure") | f.contains("cosmopolis"), 3000.0)
    return F.when((n >= 1500) & (n <= 8000), n).otherwise(told.when(f.contains("fluorescent"), 4000.0).when(f.contains("diode"), 3000.0).otherwise(2800.0))


def mount_of(support: Column) -> Column:
    m = F.lower(F.coalesce(support, F.lit("")))
    any_of = lambda *w: m.rlike("|".join(w))
    return F.when(any_of("wall", "bent_mast"), "Console").when(any_of("bollard", "ground"), "Borne").when(any_of("ceiling"), "Plafond").when(any_of("suspend", "catenary"), "Suspension").otherwise("Candélabre")


def building_height(candidates: list[Column], fallback: float = 15.0) -> Column:
    """The first plausible one of several heights."""
    return F.coalesce(*[F.when((c > 1) & (c < 400), c) for c in candidates], F.lit(fallback))
