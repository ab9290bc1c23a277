"""Scalar expressions: money, sizes, promotions, places and similarities. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Pack units in base units (grams, millilitres, pieces). Fixed values.
UNITS = {"kg": ("g", 1000), "g": ("g", 1), "gr": ("g", 1), "l": ("ml", 1000), "liter": ("ml", 1000), "ml": ("ml", 1), "unit": ("unit", 1), "pcs": ("unit", 1)}
_SIZE = r"(?i)(?:([0-9]+)\s*[*x×]\s*)?([0-9]+(?:\.[0-9]+)?)\s*(kg|gr|g|liter|ml|l|unit|pcs)\b"


def agorot(amount: Column) -> Column:
    """A decimal amount as whole hundredths."""
    return F.round(amount * 100).cast("long")


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division of non-negative values; null if b is 0."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.when(b != 0, F.call_function("div", a, b))


def unit_price(price: Column, total: Column, base_unit: Column) -> Column:
    """Price in hundredths of the currency, times 1000: per 100 g or ml, or per piece."""
    return div(price * F.when(base_unit == "unit", 1000).otherwise(100_000), total)


def parse_size(name: Column) -> Column:
    """struct(packs, total, base_unit) of the size in a product's name; nulls if it states none."""
    unit = F.lower(F.regexp_extract(name, _SIZE, 3))
    factor = F.create_map(*[F.lit(x) for k, (_, n) in UNITS.items() for x in (k, n)])
    base = F.create_map(*[F.lit(x) for k, (b, _) in UNITS.items() for x in (k, b)])
    packs = F.coalesce(F.expr("int(1)") * F.regexp_extract(name, _SIZE, 1).try_cast("int"), F.lit(1))
    total = F.round(F.regexp_extract(name, _SIZE, 2).try_cast("double") * factor[unit] * packs).cast("long")
    return F.when(unit != "", F.struct(packs.alias("packs"), total.alias("total"), base[unit].alias("base_unit")))


def promo_cost(q: Column, p: Column, kind: Column, n: Column, t: Column) -> Column:
    """What q units at shelf price p cost under a promotion: n_for_t, x_plus_y (n paid, t free), fixed_price t, percent_off n.

    Only complete groups earn a reward; the cost is never more than the shelf price.
    """
    group = n + t
    cost = F.when(kind == "n_for_t", div(q, n) * t + F.pmod(q, n) * p).when(kind == "x_plus_y", (q - div(q, group) * t) * p).when(kind == "fixed_price", q * t).when(kind == "percent_off", div(q * p * (100 - n), 100)).otherwise(q * p)
    return F.least(cost, q * p)


def limited_promo_cost(q: Column, p: Column, kind: Column, n: Column, t: Column, least: Column, most: Column) -> Column:
    """`promo_cost` that needs `least` units and reaches no further than `most` (null: all); the rest costs the shelf price."""
    part = F.least(q, F.coalesce(most, q))
    return F.when(q >= least, promo_cost(part, p, kind, n, t) + (q - part) * p).otherwise(q * p)


#: The same in SQL, for a quantity {q} and a price {p}.
PROMO_SQL = """CASE WHEN {q} < min_qty THEN {q} * {p} ELSE ({q} - least({q}, coalesce(max_qty, {q}))) * {p} + least(least({q}, coalesce(max_qty, {q})) * {p},
    CASE kind WHEN 'n_for_t' THEN least({q}, coalesce(max_qty, {q})) // n * t + least({q}, coalesce(max_qty, {q})) % n * {p} WHEN 'x_plus_y' THEN (least({q}, coalesce(max_qty, {q})) - least({q}, coalesce(max_qty, {q})) // (n + t) * t) * {p}
    WHEN 'fixed_price' THEN least({q}, coalesce(max_qty, {q})) * t ELSE least({q}, coalesce(max_qty, {q})) * {p} * (100 - n) // 100 END) END"""


def travel(mode: Column, metres: Column) -> Column:
    """Hundredths for one store and back: a car by distance and time, transit two fares and time, delivery a fee."""
    return F.when(mode == "car", div(2 * metres * 100, 1000) + div(metres, 500) * 10).when(mode == "transit", 1200 + div(metres, 250) * 10).otherwise(2500).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.lower(F.substring(text, i, F.lit(3)))))).otherwise(F.array().cast("array<string>"))


def jaccard_permille(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays, in whole thousandths."""
    return div(1000 * F.size(F.array_intersect(a, b)).cast("long"), F.size(F.array_union(a, b)).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def list_needs(text: Column) -> Column:
    """array of struct(qty, need): comma-separated needs, each with an optional leading quantity, whole or not."""
    number = r"^([0-9]+(?:\.[0-9]+)?)\s+"
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.coalesce(F.regexp_extract(x, number, 1).try_cast("decimal(12,3)"), F.lit(1)).alias("qty"), F.regexp_replace(x, number, "").alias("need")))


def band(confidence: Column, accept: int = 900, reject: int = 600) -> Column:
    """accept, review or reject, by confidence in thousandths."""
    return F.when(confidence >= accept, "accept").when(confidence >= reject, "review").otherwise("reject")
