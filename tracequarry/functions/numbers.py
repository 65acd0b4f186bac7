"""Number claims: complete dates, quantities with units and ranges, and number words, in one canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, LEFT, RIGHT, either, matches, normalised, whole

# Names of months, nouns and units that go with a number, number words and factors of metric units.
MONTHS = "january february march april may june july august september october november december".split()
SHORT = ["jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept", "sep", "oct", "nov", "dec"]
MONTH = either([*MONTHS, *SHORT])
DAY = "0?[1-9]|[12][0-9]|3[01]"
ISO = f"{LEFT}([0-9]{{4}})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01]){RIGHT}"
GAP = f"(?:,{BLANK}*|{BLANK}+)"
MONTH_FIRST = f"(?i){LEFT}({MONTH})\\.?{BLANK}+({DAY})(?:st|nd|rd|th)?{GAP}([0-9]{{4}}){RIGHT}"
DAY_FIRST = f"(?i){LEFT}({DAY})(?:st|nd|rd|th)?{BLANK}+({MONTH})\\.?{GAP}([0-9]{{4}}){RIGHT}"
NOUNS = "second minute hour day week month year user customer case degree".split()
NOUN = "seconds?|minutes?|hours?|days?|weeks?|months?|years?|people|users?|customers?|cases?|degrees?"
UNIT = (
    "%|percent|percentage points?|milligrams?|kilograms?|grams?|milliliters?|millilitres?|liters?|litres?|kilometers?|kilometres?"
    "|centimeters?|centimetres?|millimeters?|millimetres?|meters?|metres?|mg|kg|km|ml|cl|cm|mm|g|l|k|m|b|thousand|million|billion|" + NOUN
)
MONEY = f"(?:[$€£₩]{BLANK}*)?"
AMOUNT = MONEY + r"[0-9][0-9,]*(?:\.[0-9]+)?"
NUMBER = f"(?i){AMOUNT}(?:{BLANK}*(?:-|–|—|to){BLANK}*{AMOUNT})?(?:{BLANK}*(?:{UNIT}))?(?![a-z%])"
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
WORD = f"(?i){LEFT}(?:({either(TENS)})(?:(?:-|{BLANK})({either(w for w, n in ONES.items() if 1 <= n <= 9)}))?|({either(ONES)})){BLANK}+(percent|{NOUN}){RIGHT}"
#: Names and signs of metric units, singular, with their factor to the base.
METRIC = {
    **{n: ("g", f) for f, names in ((1e-3, "mg milligram"), (1.0, "g gram"), (1e3, "kg kilogram")) for n in names.split()},
    **{n: ("l", f) for f, names in ((1e-3, "ml milliliter millilitre"), (1e-2, "cl"), (1.0, "l liter litre")) for n in names.split()},
    **{n: ("m", f) for f, names in ((1e-3, "mm millimeter millimetre"), (1e-2, "cm centimeter centimetre"), (1.0, "meter metre"), (1e3, "km kilometer kilometre")) for n in names.split()},
}
SIDE = r"^([$€£₩]?)\s*([0-9]+(?:\.[0-9]+)?)\s*(.*)$"


def literal_map(items: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in items.items() for x in pair])


def plain_number(value: Column) -> Column:
    """Twelve significant digits, shortest form."""
    text = F.format_string("%.11e", value).try_cast("decimal(38,18)").cast("string")
    short = bound(text, lambda t: F.when(F.contains(t, F.lit(".")), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t))
    return F.when((value == F.floor(value)) & (value < 1e12), value.cast("long").cast("string")).otherwise(F.coalesce(short, value.cast("string")))


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once: a lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quantity_side(side: Column) -> Column:
    groups = F.struct(F.regexp_extract(side, SIDE, 1).alias("currency"), F.regexp_extract(side, SIDE, 2).alias("number"), F.trim(F.regexp_extract(side, SIDE, 3)).alias("unit"))
    return bound(groups, lambda g: F.when(g["number"] == "", F.regexp_replace(side, r"\s+", "")).when(g["unit"] == "", F.concat(g["currency"], plain_number(g["number"].try_cast("double")))).otherwise(with_unit(g)))


def with_unit(g: Column) -> Column:
    single = F.regexp_replace(g["unit"], f"{LEFT}({either(NOUNS)})s{RIGHT}", "$1")
    money, unit = g["currency"] != "", g["unit"]
    times = F.when(unit.isin("thousand", "k"), 1e3).when((unit == "million") | (unit == "m") & money, 1e6).when((unit == "billion") | (unit == "b") & money, 1e9)
    kinds = literal_map({n: F.struct(F.lit(b).alias("base"), F.lit(f).alias("factor")) for n, (b, f) in METRIC.items()})

    def told(x: Column) -> Column:
        value = g["number"].try_cast("double") * F.coalesce(x["times"], x["metric"]["factor"], F.lit(1.0))
        return F.concat(g["currency"], plain_number(value), F.when(x["times"].isNotNull(), "").otherwise(F.coalesce(x["metric"]["base"], x["single"])))

    return bound(single, lambda s: bound(F.struct(times.alias("times"), F.try_element_at(kinds, F.regexp_replace(s, "s$", "")).alias("metric"), s.alias("single")), told))


def where_held(word: str, pattern: str, new: str):
    return lambda t: F.when(F.contains(t, F.lit(word)), F.regexp_replace(t, pattern, new)).otherwise(t)


def quantity(raw: Column) -> Column:
    """Canonical form of one quantity or range."""
    token = F.replace(normalised(raw), F.lit(","), F.lit(""))
    for word, pattern, new in (("percentage", whole("percentage points?"), "pp"), ("percent", whole("percent"), "%"), ("to", r"\s+to\s+", "-")):
        token = bound(token, where_held(word, pattern, new))
    sides = F.filter(F.transform(F.split(token, "-"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(sides, quantity_side), "-")


def dates(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    number = literal_map({m[:3]: i for i, m in enumerate(MONTHS, 1)})
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((year, "y"), (month, "m"), (day, "d"))])
    as_month = lambda x: F.coalesce(x.try_cast("int"), F.try_element_at(number, F.lower(F.left(x, F.lit(3)))))
    iso = lambda x: F.concat(x["y"].cast("int").cast("string"), F.lit("-"), F.lpad(as_month(x["m"]).cast("string"), 2, "0"), F.lit("-"), F.lpad(x["d"].cast("int").cast("string"), 2, "0"))
    return F.when(text.rlike(pattern), F.transform(parts, iso)).otherwise(F.array().cast("array<string>"))


def claims(text: Column) -> Column:
    """Distinct claims of a text: dates, then digits, then words, each in order of appearance."""
    nothing = F.array().cast("array<string>")
    dated = text.rlike("[0-9]{4}")
    once = F.when(dated, F.regexp_replace(text, ISO, "  ")).otherwise(text)
    twice = F.when(dated, F.regexp_replace(once, MONTH_FIRST, "  ")).otherwise(text)
    rest = F.when(dated, F.regexp_replace(twice, DAY_FIRST, "  ")).otherwise(text)
    found = F.when(dated, F.array_distinct(F.concat(dates(text, ISO, 1, 2, 3), dates(once, MONTH_FIRST, 3, 1, 2), dates(twice, DAY_FIRST, 3, 2, 1)))).otherwise(nothing)
    digits = F.when(text.rlike("[0-9]"), F.filter(F.transform(matches(rest, NUMBER), quantity), lambda x: x != "")).otherwise(nothing)
    tens, ones = literal_map(TENS), literal_map(ONES)
    groups = F.arrays_zip(*[F.regexp_extract_all(rest, F.lit(WORD), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3, 4)])
    value = lambda x: F.coalesce(F.try_element_at(tens, F.lower(x["g1"])) + F.coalesce(F.try_element_at(ones, F.lower(x["g2"])), F.lit(0)), F.try_element_at(ones, F.lower(x["g3"])))
    spelled = F.when(rest.rlike(WORD), F.transform(groups, lambda x: quantity(F.concat(value(x).cast("string"), F.lit(" "), x["g4"])))).otherwise(nothing)
    return F.array_distinct(F.concat(found, digits, spelled))
