"""Product names: cleaning, sizes from fields or names, barcodes, attributes, substitution rules. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trolley.functions.columns import UNITS, div, parse_size

#: Abbreviations in names and what they stand for. Fixed values.
ABBREVIATIONS = {"ש.ז.": "שמן זית", "מהד'": "מהדרין", "ק\"ג": "קילוגרם", "גר'": "גרם", "מ\"ל": "מיליליטר", "יח'": "יחידה"}
#: States of a product. Fixed values.
STATES = ["fresh", "frozen", "chilled", "canned"]
ATTRIBUTES = "category_path string, product_type string, brand string, is_private_label boolean, fat_pct double, state string, flavor string, kosher string, diet_flags array<string>, pack_size long, unit string"
#: What a name says for and against a diet, in any case: phrases that grant it, and such that deny it once those are taken out. Fixed values.
DIETS = {
    "dairy_free": (r"(?:dairy|milk|lactose)[ -]free|non[ -]dairy|without (?:milk|dairy)|parve", r"milk|cheese|yogurt|butter|dairy|lactose"),
    "gluten_free": (r"gluten[ -]free|without gluten|ללא גלוטן", r"gluten|wheat|barley|rye"),
    "kosher": (r"\bkosher|mehadrin|מהדרין", r"non[ -]kosher"),
    "vegan": (r"\bvegan|plant[ -]based", r"non[ -]vegan|not vegan|milk|cheese|egg|meat"),
}
#: What turns the word behind it around. Fixed values.
_NOT = r"(?:non|not)[ -]"
#: Departments whose goods are bought as exact articles unless the user says otherwise. Fixed values.
EXACT = ["cosmetics", "baby", "cleaning"]


def clean_name(name: Column) -> Column:
    """Lower case, abbreviations written out, marks other than letters, digits, %, ., * and x dropped, white space single."""
    out = F.lower(name)
    for short, full in ABBREVIATIONS.items():
        out = F.replace(out, F.lit(short), F.lit(full))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}%.*']+", " "), r" +", " "))


def size_of(name: Column, quantity: Column, unit: Column) -> Column:
    """struct(packs, total, base_unit): from the quantity fields where both are valid, else from the name."""
    key = F.lower(F.trim(unit))
    factor = F.create_map(*[F.lit(x) for k, (_, n) in UNITS.items() for x in (k, n)])[key]
    base = F.create_map(*[F.lit(x) for k, (b, _) in UNITS.items() for x in (k, b)])[key]
    field = F.when((quantity > 0) & factor.isNotNull(), F.struct(F.lit(1).alias("packs"), F.round(quantity * factor).cast("long").alias("total"), base.alias("base_unit")))
    return F.coalesce(field, parse_size(name))


def unit_price_of(price: Column, total: Column, base_unit: Column, weighed: Column) -> Column:
    """struct(value, per, estimated): thousandths of a hundredth per 100 g or ml, per piece, or per kg of weighed goods, which is an estimate."""
    per = F.when(weighed, F.lit("kg")).when(base_unit == "unit", F.lit("unit")).otherwise(F.concat(F.lit("100 "), base_unit))
    scale = F.when(weighed, 1_000_000).when(base_unit == "unit", 1000).otherwise(100_000)
    return F.struct(div(price * scale, total).alias("value"), per.alias("per"), weighed.alias("estimated"))


def internal_barcode(barcode: Column) -> Column:
    """Codes that a chain gives itself: they start with 2, or are too short for a public article number."""
    return barcode.rlike("^2[0-9]{4,}$") | (F.length(barcode) < 8)


def weighed(barcode: Column, unit: Column) -> Column:
    """Goods sold by weight: an internal code and a price per kilogram."""
    return barcode.rlike("^2[0-9]{4,}$") & (F.lower(unit) == "kg")


def attributes(json: Column) -> Column:
    """The attribute record of a product; a state outside STATES is null."""
    x = F.from_json(json, ATTRIBUTES)
    return x.withField("state", F.when(x["state"].isin(STATES), x["state"]))


def diet_state(name: Column, tag: str) -> Column:
    """yes, no or unverified: whether a name grants a diet. A denied grant (non-vegan) is no; what it does not speak of is unverified, not absent."""
    grants, denies = DIETS[tag]
    text = F.lower(name)
    denied = text.rlike(f"{_NOT}(?:{grants})")
    rest = F.regexp_replace(text, grants if tag in ("dairy_free", "gluten_free") else r"(?:dairy|milk|lactose)[ -]free|non[ -]dairy|without (?:milk|dairy)", " ")
    return F.when(denied | rest.rlike(denies), "no").when(text.rlike(grants), "yes").otherwise("unverified")


def diet_tags(name: Column) -> Column:
    """array of struct(tag, state) of every diet."""
    return F.array(*[F.struct(F.lit(tag).alias("tag"), diet_state(name, tag).alias("state")) for tag in DIETS])


def fat_percent(name: Column) -> Column:
    """The whole percentage of fat that a name states, or null."""
    return F.regexp_extract(F.lower(name), r"([0-9]+) ?% ?fat", 1).try_cast("long")


def private_label(name: Column) -> Column:
    """Whether a name says that the chain's own brand stands behind it."""
    return F.lower(name).rlike(r"\b(?:house brand|own label|private label)\b")


def state_of(name: Column) -> Column:
    """The first state of STATES that a name states, or null."""
    found = F.regexp_extract(F.lower(name), rf"\b({'|'.join(STATES)})\b", 1)
    return F.when(found != "", found)


def explain(a: Column, b: Column) -> Column:
    """struct(same, different, unverified): keys of two maps by whether both values are known, and equal."""
    keys = F.sort_array(F.array_union(F.map_keys(a), F.map_keys(b)))
    known = lambda k: F.element_at(a, k).isNotNull() & F.element_at(b, k).isNotNull()
    equal = lambda k: F.element_at(a, k) == F.element_at(b, k)
    return F.struct(F.filter(keys, lambda k: known(k) & equal(k)).alias("same"), F.filter(keys, lambda k: known(k) & ~equal(k)).alias("different"), F.filter(keys, lambda k: ~known(k)).alias("unverified"))


def allowed(different: Column, unverified: Column, soft: Column) -> Column:
    """Whether all that differs, or may differ, is among the attributes that the user leaves open."""
    return F.forall(F.concat(different, unverified), lambda k: F.array_contains(soft, k))


def default_level(user: Column, department: Column) -> Column:
    """What the user chose before, else the department's default, else any_brand."""
    return F.coalesce(user, F.when(department.isin(EXACT), "exact"), F.lit("any_brand"))
