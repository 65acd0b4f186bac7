"""Signal snapshots: what one text claims, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, numbers
from ..functions.text import normalised, trimmed


#: What each kind of finding looks at; kinds that aren't listed look at none of the signals.
NEEDS = {"number": ["numbers"], "certainty": ["certainty"], "quantifier": ["scope"], "negation": ["negations"], "guardrail": ["actions"]}
TERM = "struct<term:string,rank:int>"


#: Shorter texts, which may be on very many rows and cost little, are dealt over so many groups.
SHORT, DEALT = 40, 16


SIGNALS = ["numbers", "certainty", "scope", "negations", "actions"]


def wanted_of(kinds) -> set[str]:
    return {n for k in (NEEDS if kinds is None else kinds) for n in NEEDS.get(k, [])}


def snapshot(text: Column, normal: Column, kinds=None) -> dict[str, Column]:
    """All signals, or those that findings of these kinds need; the others are null."""
    makers = {"numbers": (numbers.claims, text, "array<string>"), "certainty": (lexicon.certainty, normal, TERM), "scope": (lexicon.scope, normal, TERM), "negations": (lexicon.negations, normal, "array<string>"), "actions": (lexicon.completed_actions, normal, "array<string>")}
    return {name: f(x) if name in wanted_of(kinds) else F.lit(None).cast(kind) for name, (f, x, kind) in makers.items()}


def with_signals(stages: DataFrame, text: str = "text", kinds=None, by=(), more=None) -> DataFrame:
    """Add normal (the normalised text) and SIGNALS; text is trimmed. more: further columns, name to what makes it of (text, normal, any made before) and the columns by.

    A text that many rows share is worked out once: equal texts (and columns by) come together by one exchange, and what the first row says is handed
    on to the others, column by column, so that what nothing reads is neither made nor carried. Where there is nothing to work out, no row moves.
    """
    more = more or {}
    if not wanted_of(kinds) and not more:
        plain = stages.withColumn(text, trimmed(F.col(text))).withColumn("normal", normalised(F.col(text)))
        return plain.select("*", *[v.alias(k) for k, v in snapshot(F.col(text), F.col("normal"), kinds).items()])
    salt = F.when(F.coalesce(F.length(text), F.lit(0)) < SHORT, F.pmod(F.hash("run_id"), F.lit(DEALT))).otherwise(0)
    same = Window.partitionBy("text_hash", text, *by).orderBy("text_hash")
    own = stages.withColumn("text_hash", F.xxhash64(text, *by, salt)).withColumn("new", F.row_number().over(same) == 1)
    new, made = F.col("new"), lambda x: F.col(f"{x}_1")
    own = own.withColumn("text_1", F.when(new, trimmed(F.col(text)))).withColumn("normal_1", F.when(new, normalised(F.col("text_1"))))
    own = own.select("*", *[F.when(new, v).alias(f"{k}_1") for k, v in snapshot(made("text"), made("normal"), kinds).items()])
    for name, f in more.items():
        own = own.withColumn(f"{name}_1", F.when(new, f(made("text"), made("normal"), made)))
    names = ["text", "normal", *SIGNALS, *more]
    handed = [F.first(f"{n}_1").over(same.rowsBetween(Window.unboundedPreceding, 0)).alias(text if n == "text" else n) for n in names]
    return own.select(*[c for c in stages.columns if c not in (text, *names)], *handed)


def signals(stages: DataFrame) -> DataFrame:
    """One row a stage: numbers, certainty and its rank, scope and its rank, negations, completed actions."""
    s = with_signals(stages)
    return s.select("run_id", "stage_index", "label", "numbers", F.col("certainty.term").alias("certainty"), F.col("certainty.rank").alias("certainty_rank"), F.col("scope.term").alias("scope"), F.col("scope.rank").alias("scope_rank"), "negations", "actions")
