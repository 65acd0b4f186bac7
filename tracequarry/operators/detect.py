"""Detectors over edges: what changed between a text and the one it was handed on from.

An edge is (run_id, edge_index, p, c, guardrail, ...): p and c are structs (id, label, text, normal, sig) of
both ends. Chains, graphs and span trees differ only in how their edges are made. All detectors run in one projection after
the one exchange that brings a run's stages together.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import excerpt, flat, normalised
from .signals import SIGNALS, wanted_of, with_signals

ISSUES = ["run_id", "edge_index", "issue_id", "type", "family", "severity", "title", "explanation", "from_label", "to_label", "before", "after", "ord"]
JUDGE = "semantic-judge"
LEAST_LETTERS, LEAST_COVERED, LEAST_RETAINED = 20, 0.3, 0.3


@dataclass(frozen=True)
class Rule:
    """A domain rule as Column expressions: when(edge) decides, the rest is the finding. edge offers p, c and guardrail."""

    id: str
    family: str
    when: Callable[[Column, Column, Column], Column]
    severity: str = "medium"
    title: str = "Domain rule matched"
    explanation: str = "A domain rule flagged this handoff."
    finding: str = "1"


def checked_rules(rules) -> tuple[Rule, ...]:
    """Rules with unique, non-blank ids of their own, known families and severities; anything else is an error."""
    seen: set[str] = set()
    for r in rules:
        if not r.id.strip() or r.id in seen or r.id == JUDGE:
            raise ValueError(f"rule id {r.id!r} is blank, reserved or repeated")
        if r.family not in ("evidence", "meaning", "authority") or r.severity not in ("low", "medium", "high") or not r.title.strip() or not r.explanation.strip():
            raise ValueError(f"rule {r.id!r} has an unknown family or severity, or a blank text")
        seen.add(r.id)
    return tuple(rules)


def rank_of(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def severity_of(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low").otherwise("clean")


def none() -> Column:
    return F.array().cast("array<string>")


def quoted(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit("“"), t, F.lit("”"))), ", ")


#: The order in which detectors speak of one edge; domain rules come between the built-in ones and the judge.
ORD = {"gone": 0, "number": 0, "certainty": 1, "quantifier": 2, "negation": 3, "rule": 4, "judge": 999, "acted": 1000, "lost": 1000, "script": 1001}


@dataclass(frozen=True)
class Finding:
    """One kind of finding: where it is made and how severe it is are worked out for each edge, its texts only for findings, and only if they are read."""

    code: str
    when: Column
    severity: Column | str
    title: str
    explanation: Column | str
    before: Column | None = None
    after: Column | None = None
    kind: str | None = None
    family: str | None = None
    rule: str | None = None
    at: int | None = None


def number_drift(p: Column, c: Column) -> Finding:
    old, new = p["sig"]["numbers"], c["sig"]["numbers"]
    gone, added = F.array_except(old, new), F.array_except(new, old)
    say = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("no number")
    text = F.concat(F.lit("Numbers went from "), say(old), F.lit(" to "), say(new), F.lit("; compare ranges, units and rounding."))
    pick = lambda x, y: F.when(F.size(x) > 0, x).otherwise(y)
    return Finding("number", p["number_set"] != c["number_set"], "high", "Numeric claim changed", text, pick(gone, old), pick(added, new))


def inflation(p: Column, c: Column, field: str, kind: str, title: str, least: int, top: int) -> Finding:
    old, new = p["sig"][field], c["sig"][field]
    was, rank = p[f"{field}_rank"], c[f"{field}_rank"]
    rises = rank.isNotNull() & F.when(was.isNotNull(), rank > was).otherwise(rank >= least)
    text = F.when(old.isNotNull(), F.concat(F.lit("Wording rose from “"), old["term"], F.lit("” to “"), new["term"], F.lit("”."))).otherwise(F.concat(F.lit("“"), new["term"], F.lit("” appears; the stage before had no such qualifier.")))
    before = F.when(old.isNotNull(), F.array(old["term"])).otherwise(none())
    return Finding(kind, rises, F.when(rank == top, "high").otherwise("medium"), title, text, before, F.array(new["term"]))


def certainty_drift(p: Column, c: Column) -> Finding:
    return inflation(p, c, "certainty", "certainty", "Confidence was inflated", 2, 3)


def scope_drift(p: Column, c: Column) -> Finding:
    return inflation(p, c, "scope", "quantifier", "Scope became broader", 3, 4)


def negation_loss(p: Column, c: Column) -> Finding:
    old = p["sig"]["negations"]
    text = F.concat(F.lit("Before the handoff the text had "), quoted(old), F.lit("; after it nothing is negated."))
    return Finding("negation", (p["n_negations"] > 0) & (c["n_negations"] == 0), "high", "A negative condition disappeared", text, old)


def missing_content(p: Column, c: Column) -> Finding:
    text = F.when(p["blank"], "The earlier stage has no text to compare with.").otherwise("The later stage has no text to verify.")
    return Finding("gone", p["blank"] | c["blank"], "high", "Stage content is missing", text, kind="coverage")


def with_kept(edges: DataFrame, edged: bool = False) -> DataFrame:
    """Add kept_before: how many of the instruction's words the earlier end holds. Where it has the same instruction this is known already."""
    again = F.size(lexicon.retained(F.col("p.normal"), lexicon.tokens(F.col("p.normal")), F.col("c.words"), edged))
    return edges.withColumn("kept_before", F.when(F.col("p.guardrail").eqNullSafe(F.col("c.guardrail")), F.col("p.n_kept")).otherwise(again))


def breaches(p: Column, c: Column, kept_before: Column) -> tuple[Column, Finding, Finding]:
    """Which breach an edge has, acted or lost, and what is said of it. A completed action comes before a dropped instruction."""
    n, words, kept = c["n_words"], c["words"], c["kept"]
    share = lambda x: F.when(n > 0, x / n).otherwise(1.0)
    done = c["sig"]["actions"]
    which = F.when(c["there"], F.when(c["blocks"] & (c["n_actions"] > 0), "acted").when((n >= 2) & (share(kept_before) >= LEAST_RETAINED) & (share(c["n_kept"]) < LEAST_RETAINED), "lost"))
    acted = F.concat(F.lit("The instruction holds back external actions, yet this stage reports “"), F.element_at(done, 1), F.lit("”."))
    lost = F.concat(F.round(share(c["n_kept"]) * 100).cast("int").cast("string"), F.lit("% of the instruction's words are left after this handoff."))
    said = F.col("breach")
    return which, Finding("acted", said == "acted", "high", "Protected action appears completed", acted, words, done, kind="guardrail"), Finding("lost", said == "lost", "medium", "Guardrail was not carried forward", lost, words, kept, kind="guardrail")


def uncovered(text: Column) -> Column:
    """Mostly letters that the English lexicons don't cover."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (letters >= LEAST_LETTERS) & (F.regexp_count(text, F.lit("(?iu)(?=[a-zÀ-ɏ])\\p{L}")) / letters < LEAST_COVERED)


def uncovered_script(labels: Column) -> Finding:
    text = F.concat(F.lit("Mostly in a script that the lexicons do not cover: "), F.array_join(labels, ", "), F.lit("; quiet results are no proof of safety here."))
    return Finding("script", labels.isNotNull(), "low", "Language outside detector coverage", text, kind="coverage")


#: What detectors ask of either end, whatever they say of it: its texts and signals, and for the question whether there is a finding only short values. The words of an
#: instruction that the earlier end keeps are only counted.
SIDE = ["id", "label", "text", "normal", *SIGNALS, "number_set", "certainty_rank", "scope_rank", "n_negations", "n_actions", "blank", "guardrail", "n_kept"]
LATER = [*SIDE, "there", "words", "n_words", "blocks", "kept"]


def sides(stages: DataFrame, kinds=None, edged: bool = False) -> DataFrame:
    """Stages with what detectors of these kinds ask of an edge's ends (SIDE, LATER, and unc, a text outside the lexicons' scripts), worked out once for each distinct text and instruction."""
    asks = lambda kind: kinds is None or kind in kinds
    more = {}
    if asks("coverage"):
        more["unc"] = lambda text, normal, own: uncovered(text)
    if asks("number"):
        more["number_set"] = lambda text, normal, own: F.array_join(F.array_sort(own("numbers")), "\x00")
    if asks("guardrail"):
        more["guard_normal"] = lambda text, normal, own: normalised(F.coalesce("guardrail", F.lit("")))
        more["there"] = lambda text, normal, own: own("guard_normal") != ""
        more["words"] = lambda text, normal, own: lexicon.guardrail_words(own("guard_normal"), edged)
        more["blocks"] = lambda text, normal, own: lexicon.restricts(own("guard_normal"))
        more["tokens"] = lambda text, normal, own: lexicon.tokens(normal)
        more["kept"] = lambda text, normal, own: F.when(own("there"), lexicon.retained(normal, own("tokens"), own("words"), edged)).otherwise(none())
        more["n_words"] = lambda text, normal, own: F.size(own("words"))
        more["n_kept"] = lambda text, normal, own: F.size(own("kept"))
    more |= {"certainty_rank": lambda text, normal, own: own("certainty")["rank"], "scope_rank": lambda text, normal, own: own("scope")["rank"], "n_negations": lambda text, normal, own: F.size(own("negations")), "n_actions": lambda text, normal, own: F.size(own("actions"))} if wanted_of(kinds) else {}
    out = with_signals(stages, kinds=kinds, by=["guardrail"] if asks("guardrail") else [], more=more)
    none_yet = {"unc": F.lit(False), "number_set": F.lit(""), "there": F.lit(False), "blocks": F.lit(False), "words": none(), "kept": none(), **{n: F.lit(0) for n in ("n_words", "n_kept", "certainty_rank", "scope_rank", "n_negations", "n_actions")}}
    return out.select("*", (F.col("text") == "").alias("blank"), *[v.alias(k) for k, v in none_yet.items() if k not in more])


def end_of(names, prefix: str = "") -> Column:
    """One end of an edge: columns as a struct, the signals once more as its sig."""
    return F.struct(*[F.col(f"{prefix}{n}").alias(n) for n in names if n not in SIGNALS], F.struct(*[F.col(f"{prefix}{n}").alias(n) for n in SIGNALS]).alias("sig"))


def chain_edges(stages: DataFrame, kinds=None, edged: bool = False) -> DataFrame:
    """Edges of chains: stages (run_id, stage_index, id, label, text, guardrail) next to each other. Texts are worked out by text, edges by run_id: an exchange each.

    Each column of the earlier end is handed on by itself, so that what nothing asks for is not carried.
    """
    order = Window.partitionBy("run_id").orderBy("stage_index")
    run = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = sides(stages.withColumn("text", F.coalesce("text", F.lit(""))), kinds, edged)
    out = [F.lag(n).over(order).alias(f"p_{n}") for n in SIDE] + [F.lag(F.lit(True)).over(order).alias("later")]
    labels = F.lit(None).cast("array<string>")
    if kinds is None or "coverage" in kinds:
        out.append(F.collect_list(F.when(F.col("unc"), F.struct("stage_index", "label"))).over(run).alias("unc_stages"))
        labels = F.when(F.size("unc_stages") > 0, F.when(F.col("stage_index") - 1 == F.greatest(F.lit(0), F.get("unc_stages", F.lit(0))["stage_index"] - 1), F.transform("unc_stages", lambda x: x["label"])))
    both = own.select("run_id", "stage_index", *LATER, *out)
    edges = both.filter("later").withColumn("edge_index", (F.col("stage_index") - 1).cast("int"))
    return edges.select("run_id", "edge_index", end_of(SIDE, "p_").alias("p"), end_of(LATER).alias("c"), "guardrail", labels.alias("coverage_labels"))


def edge_issues(edges: DataFrame, rules=(), built_in: bool = True, scan: str = "run", judge: DataFrame | None = None, kinds=None, edged: bool = False) -> DataFrame:
    """Issues of edges, one row each, in the columns ISSUES; of certain kinds only where these are named, so that nothing else is worked out.

    scan="run" reports only a run's first guardrail breach, whatever hides behind it; scan="edge" reports each. Without built_in
    only missing content and rules are reported. judge: findings (run_id, edge_index, severity, title, explanation, and pos for their order) made elsewhere.
    """
    p, c = F.col("p"), F.col("c")
    rules = checked_rules(rules)
    speaks = lambda kind: built_in and (kinds is None or kind in kinds)
    last = []
    if speaks("guardrail"):
        edges = with_kept(edges, edged)
        which, *last = breaches(p, c, F.col("kept_before"))
        edges = edges.withColumn("breach", which)
        if scan == "run":
            first = F.min(F.when(F.col("breach").isNotNull(), F.col("edge_index"))).over(Window.partitionBy("run_id"))
            edges = edges.withColumn("first_breach", first).withColumn("breach", F.when(F.col("edge_index") == F.col("first_breach"), F.col("breach")))
    if speaks("coverage"):
        last.append(uncovered_script(F.col("coverage_labels")))
    gone = missing_content(p, c)
    usual = [f(p, c) for kind, f in (("number", number_drift), ("certainty", certainty_drift), ("quantifier", scope_drift), ("negation", negation_loss)) if speaks(kind)]
    usual += [Finding(f"rule {r.id}", r.when(p, c, F.col("guardrail")), r.severity, r.title, r.explanation, kind="custom", family=r.family, rule=f"{r.id}-{r.finding}", at=ORD["rule"] + i) for i, r in enumerate(rules)]
    every = [gone, *usual, *last]
    as_column = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    told = lambda n: F.struct(F.lit(n).alias("n"), as_column(every[n].severity).alias("severity"))
    present = [F.when(F.coalesce(f.when, F.lit(False)) & (~F.coalesce(gone.when, F.lit(False)) if 0 < n <= len(usual) else F.lit(True)), told(n)) for n, f in enumerate(every)]
    rows = edges.withColumn("x", F.explode(F.filter(F.array(*present), lambda x: x.isNotNull()))).withColumn("severity", F.col("x.severity")).withColumn("n", F.col("x.n"))
    # Which finding it is says the rest; the branches read only what their own finding needs.
    chosen = lambda pick, kind: F.coalesce(*[F.when(F.col("n") == n, as_column(pick(f)).cast(kind)) for n, f in enumerate(every) if pick(f) is not None], F.lit(None).cast(kind))
    terms = lambda pick: F.coalesce(chosen(pick, "array<string>"), none())
    rows = rows.select(
        "run_id", "edge_index", p["label"].alias("from_label"), c["label"].alias("to_label"), flat(p["text"]).alias("pt"), flat(c["text"]).alias("ct"), chosen(lambda f: F.lit(ORD[f.code] if f.at is None else f.at), "int").alias("ord"),
        chosen(lambda f: f.kind or f.code, "string").alias("type"), chosen(lambda f: f.family or lexicon.FAMILY[f.kind or f.code], "string").alias("family"), "severity", chosen(lambda f: f.title, "string").alias("title"), chosen(lambda f: f.explanation, "string").alias("explanation"),
        terms(lambda f: f.before).alias("before_terms"), terms(lambda f: f.after).alias("after_terms"), chosen(lambda f: f.rule, "string").alias("rule"),
    )
    if judge is not None:
        ends = edges.select("run_id", "edge_index", p["label"].alias("from_label"), c["label"].alias("to_label"), flat(p["text"]).alias("pt"), flat(c["text"]).alias("ct"))
        own = judge.select("run_id", "edge_index", F.lit(ORD["judge"]).alias("ord"), F.lit("custom").alias("type"), F.lit("meaning").alias("family"), "severity", "title", "explanation", none().alias("before_terms"), none().alias("after_terms"), F.concat(F.lit(f"{JUDGE}-"), F.row_number().over(Window.partitionBy("run_id", "edge_index").orderBy(*(["pos"] if "pos" in judge.columns else ["severity", "title", "explanation"]))).cast("string")).alias("rule"))
        rows = rows.unionByName(ends.join(own, ["run_id", "edge_index"]))
    name = F.when(F.col("rule").isNotNull(), F.concat(F.lit("custom-"), "rule")).otherwise(F.concat("type", F.lit("-"), "title"))
    return rows.select(
        "run_id", "edge_index", F.concat(F.col("edge_index").cast("string"), F.lit("-"), name).alias("issue_id"), "type", "family", "severity", "title", "explanation",
        "from_label", "to_label", excerpt(F.col("pt"), F.col("before_terms")).alias("before"), excerpt(F.col("ct"), F.col("after_terms")).alias("after"), "ord",
    )


def analyse(stages: DataFrame, rules=(), built_in: bool = True, judge: DataFrame | None = None, kinds=None, edged: bool = False) -> DataFrame:
    """Issues of whole chains. kinds: only findings of these types are worked out, besides those of rules and judge; null for all. edged: as in lexicon.retained."""
    if kinds is not None and (unknown := set(kinds) - set(lexicon.FAMILY)):
        raise ValueError(f"no such kinds: {sorted(unknown)}")
    asked = kinds if built_in else ()  # rules and judge ask for no signals
    found = edge_issues(chain_edges(stages, asked, edged), rules, built_in, "run", judge, kinds, edged)
    return found if kinds is None or "coverage" in kinds else found.filter("type <> 'coverage'")


def in_order(issues: DataFrame) -> DataFrame:
    """Add pos, from 1: by edge, then severity, then the order in which detectors speak."""
    order = Window.partitionBy("run_id").orderBy("edge_index", F.desc(rank_of(F.col("severity"))), "ord", "issue_id")
    return issues.withColumn("pos", F.row_number().over(order))


def pandas_findings(edges: DataFrame, rule_id: str, evaluate: Callable) -> DataFrame:
    """Findings of a Python rule, in Arrow batches: evaluate(pandas frame of from_text, to_text, guardrail) gives for each row a list of (severity, title, explanation)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for (run_id, at), found in zip(zip(pdf["run_id"], pdf["edge_index"]), evaluate(pdf)):
                for n, (severity, title, explanation) in enumerate(found, 1):
                    if severity not in ("low", "medium", "high") or not title.strip() or not explanation.strip():
                        raise ValueError(f"rule {rule_id}: bad finding")
                    out.append((run_id, at, f"{at}-custom-{rule_id}-{n}", severity, title.strip(), explanation.strip()))
            yield pd.DataFrame(out, columns=["run_id", "edge_index", "issue_id", "severity", "title", "explanation"])

    flat = edges.select("run_id", "edge_index", F.col("p.text").alias("from_text"), F.col("c.text").alias("to_text"), F.coalesce("guardrail", F.lit("")).alias("guardrail"))
    kind = edges.schema["run_id"].dataType.simpleString()
    return flat.mapInPandas(run, f"run_id {kind}, edge_index int, issue_id string, severity string, title string, explanation string")
