"""Ranked vocabularies of certainty and scope, polarity and action words, and the highest term that a text asserts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEFT, RIGHT, either, matches, whole

# The words of each rank, and those of the other lists, up to FAMILY.
CERTAINTY = {
    0: "uncertain unconfirmed preliminary pending may might could possibly possible appears suggests estimated approximately".split(),
    1: "likely indicates supports expected".split(),
    2: "shows demonstrates will".split(),
    3: "confirmed proves proven guarantees definitely certainly".split(),
}
SCOPE = {0: ["a few", "few", "some"], 1: ["several"], 2: ["many"], 3: ["most"], 4: ["all", "every", "always", "none", "never"]}
#: Weak words and "likely", not the other words of rank 1.
HEDGES = "uncertain unconfirmed preliminary pending may might could possibly possible appears suggests estimated approximately likely".split()
CONTRASTS = "and but however although yet nevertheless whereas while".split()
#: The order decides which of two forms that start together is taken.
NEGATIONS = ["not", "no", "never", "without", "cannot", "can't", "won't", "isn't", "aren't", "doesn't", "don't", "didn't", "must not", "do not"]
ACTIONS = "sent emailed contacted published posted deleted purchased bought booked deployed executed transferred submitted released shared".split()
RESTRICTIONS = ["do not", "don't", "must not", "never", "draft only", "human approval", "approval required", "before approval", "no external action", "without approval"]
STOP_WORDS = "a an and are as at be before by for from in is it of on or that the this to with".split()
FAMILY = {"number": "evidence", "certainty": "meaning", "quantifier": "meaning", "negation": "meaning", "guardrail": "authority", "coverage": "meaning", "custom": "meaning"}
SEVERITY = {"clean": 0, "low": 1, "medium": 2, "high": 3}
#: So many characters before an action are looked at for a negation, which reaches over so many words.
BEFORE, REACH = 80, 3


def denied(before: Column) -> Column:
    """Does what stands before a term, the last 18 characters of it, end in a negation?"""
    return F.right(before, F.lit(18)).rlike(f"{LEFT}(?:not|no|never) +(?:been +)?$")


def hedged(before: Column, after: Column) -> Column:
    """Does a hedge stand in the term's clause with no contrast between? The nearest hedge on either side decides."""
    stop = f"(?:(?!{whole(either(CONTRASTS))})[^.!?;])*"
    return before.rlike(f"{whole(either(HEDGES))}{stop}$") | after.rlike(f"^{stop}{whole(either(HEDGES))}")


def asserted(normal: Column, term: str, rank: int, hedges: bool) -> Column:
    """Does the term's first place in a normalised text count? Later places are not looked at."""
    here = whole(term)
    before = F.regexp_extract(normal, f"(?s)^(.*?){here}", 1)
    counts = F.contains(normal, F.lit(term)) & normal.rlike(here) & ~denied(before)  # most terms are absent: a plain search tells so first
    if hedges and rank >= 2:
        counts &= ~hedged(before, F.regexp_extract(normal, f"(?s)^.*?{here}(.*)$", 1))
    return counts


def highest(normal: Column, lexicon: dict[int, list[str]], hedges: bool = False) -> Column:
    """struct(term, rank) of the highest asserted term, the first listed among equals; null if there is none."""
    ladder = [F.when(asserted(normal, term, rank, hedges), F.struct(F.lit(term).alias("term"), F.lit(rank).alias("rank"))) for rank in sorted(lexicon, reverse=True) for term in lexicon[rank]]
    return F.when(normal.rlike(whole(either(t for ts in lexicon.values() for t in ts))), F.coalesce(*ladder))


def certainty(normal: Column) -> Column:
    return highest(normal, CERTAINTY, True)


def scope(normal: Column) -> Column:
    return highest(normal, SCOPE)


def negations(normal: Column) -> Column:
    return F.array_distinct(matches(normal, whole(either(NEGATIONS))))


def completed_actions(normal: Column) -> Column:
    """Past-tense actions that no negation among the 80 characters before denies: the last one does, unless a mark, a contrast or more than three words stand between."""
    verb, negation = whole(either(ACTIONS)), whole(either(NEGATIONS))
    nothing = F.array().cast("array<string>")
    texts = F.transform(F.regexp_extract_all(normal, F.lit(verb), F.lit(0)), lambda x, i: F.struct(F.get(F.split(normal, verb, -1), i).alias("gap"), x.alias("action")))

    def asserted_after(before: Column) -> Column:
        between = F.regexp_extract(before, f"(?s)^.*{negation}(.*)$", 1)
        words = F.size(F.filter(F.split(between, r"\s+"), lambda w: w != ""))
        return ~before.rlike(negation) | between.rlike(r"[.!?;,:]|" + whole("and|but|however")) | (words > REACH)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        first = F.greatest(start - BEFORE, F.lit(0))
        keep = asserted_after(F.substring(normal, first + 1, start - first))
        return F.struct((start + F.length(x["action"])).alias("at"), F.when(keep, F.concat(state["kept"], F.array(x["action"]))).otherwise(state["kept"]).alias("kept"))

    walked = F.aggregate(texts, F.struct(F.lit(0).alias("at"), nothing.alias("kept")), step, lambda state: state["kept"])
    return F.when(normal.rlike(verb), F.array_distinct(F.when(normal.rlike(negation), walked).otherwise(matches(normal, verb)))).otherwise(nothing)


def restricts(normal: Column) -> Column:
    return normal.rlike(whole(either(RESTRICTIONS)))


def guardrail_words(normal: Column, edged: bool = False) -> Column:
    """Words of an instruction that a later stage should keep: no stop words, no numbers, no very short ones (edged: of any letters)."""
    words = F.split(F.regexp_replace(normal, r"(?iu)[^a-zÀ-ɏ0-9\s'-]", " "), r"\s+")
    keep = lambda w: (w != "") & ~w.rlike("^[0-9]") & ~w.isin(*STOP_WORDS) & ((F.length(w) > 2) if edged else F.when(w.rlike(r"[^\x00-\x7F]"), F.length(w) >= 2).otherwise(F.length(w) > 2))
    return F.array_distinct(F.filter(words, keep))


def tokens(normal: Column) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return F.split(normal, "[^A-Za-z0-9_]+")


#: Where an ASCII word starts or ends, like \b of engines that know ASCII words only.
EDGE = f"(?:{LEFT}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){RIGHT})"


def retained(normal: Column, own: Column, words: Column, edged: bool = False) -> Column:
    """Those of words that a normalised text holds: whole words if ASCII, else any place (edged: between edges of ASCII words, whatever their letters). own: a column of the text's tokens."""
    edge = lambda w, left, right: F.concat(F.lit(left + r"\Q"), w, F.lit(r"\E" + right))
    other = lambda w: F.rlike(normal, edge(w, EDGE, EDGE)) if edged else w.rlike(r"[^\x00-\x7F]") | F.rlike(normal, edge(w, LEFT, RIGHT))
    held = lambda w: F.when(w.rlike("^[A-Za-z0-9_]+$"), F.array_contains(own, w)).otherwise(other(w))
    return F.filter(words, lambda w: F.contains(normal, w) & held(w))
