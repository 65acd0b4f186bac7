"""Text kernel: native Column builders with the string semantics of the trace format (Unicode blanks, ASCII word edges)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, wherever a pattern below has BLANK.
#: The intersection lets one comparison rule out most characters.
BLANK = r"[\s\x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
#: Word edges that know ASCII letters only.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def whole(words: str) -> str:
    return f"{LEFT}(?:{words}){RIGHT}"


def either(terms) -> str:
    return "|".join(terms)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def normalised(text: Column) -> Column:
    """Lower case, straight apostrophes, plain dashes, single blanks."""
    return compact(F.translate(F.lower(text), "’–—", "'--"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: astral characters count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def uri_component(text: Column) -> Column:
    """Percent-encoding of a URI component; form encoding differs in a few marks."""
    out = F.url_encode(text)
    for code, mark in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; the pattern runs a second time only over texts that have one."""
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def flat(text: Column) -> Column:
    return compact(F.coalesce(text, F.lit("")))


def excerpt(flat: Column, terms: Column) -> Column:
    """Up to 150 characters of a compacted text around the first of terms that it holds; a dash for an empty one."""
    low = F.lower(flat)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t))), lambda p: p > 0))

    def cut(at: Column) -> Column:
        start, end = F.greatest(at - 1 - 54, F.lit(0)), F.least(F.length(flat), at - 1 + 96)
        around = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < F.length(flat), "…").otherwise(""))
        return F.when(at.isNotNull(), around).otherwise(F.when(F.length(flat) > 150, F.concat(F.substring(flat, 1, 147), F.lit("…"))).otherwise(flat))

    return F.when(flat == "", F.lit("—")).otherwise(F.get(F.transform(F.array(at), cut), F.lit(0)))
