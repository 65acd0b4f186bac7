"""Per-run and per-transition roll-ups of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import in_order, rank_of, severity_of

RANK = {"low": 1, "medium": 2, "high": 3}


def threshold_rank(threshold: str) -> int:
    if threshold not in RANK:
        raise ValueError("threshold is low, medium or high")
    return RANK[threshold]


def run_summary(stages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a run: stages, issues, severity, first_break (least edge with an issue), outputs from there on."""
    sizes = stages.groupBy("run_id").agg(F.count("*").alias("n_stages"))
    found = issues.groupBy("run_id").agg(F.count("*").alias("n"), F.max(rank_of(F.col("severity"))).alias("rank"), F.min("edge_index").alias("first_break"))
    out = sizes.join(found, "run_id", "left")
    return out.select("run_id", "n_stages", F.coalesce("n", F.lit(0)).alias("n_issues"), severity_of(F.coalesce("rank", F.lit(0))).alias("severity"), "first_break", F.when(F.col("first_break").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("n_stages") - F.col("first_break") - 1)).cast("long").alias("contaminated"))


def transitions(stages: DataFrame) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy("stage_index")
    own = stages.select("run_id", (F.col("stage_index") - 1).cast("int").alias("edge_index"), F.lag("label").over(order).alias("from_label"), F.col("label").alias("to_label"), F.lag("id").over(order).alias("from_id"), F.col("id").alias("to_id"))
    return own.filter("from_id is not null or edge_index >= 0")


def transition_rollup(stages: DataFrame, issues: DataFrame) -> DataFrame:
    """Every transition with its count of issues and highest severity, quiet ones too."""
    found = issues.groupBy("run_id", "edge_index").agg(F.count("*").alias("n"), F.max(rank_of(F.col("severity"))).alias("rank"))
    out = transitions(stages).join(found, ["run_id", "edge_index"], "left")
    return out.select("run_id", "edge_index", "from_label", "to_label", F.coalesce("n", F.lit(0)).alias("issue_count"), severity_of(F.coalesce("rank", F.lit(0))).alias("severity"))


def chain_states(stages: DataFrame, issues: DataFrame) -> DataFrame:
    """Each stage: clean, verified (before the break), first-break or downstream."""
    first = issues.groupBy("run_id").agg((F.min("edge_index") + 1).alias("b"))
    state = F.when(F.col("b").isNull(), "clean").when(F.col("stage_index") < F.col("b"), "verified").when(F.col("stage_index") == F.col("b"), "first-break").otherwise("downstream")
    return stages.select("run_id", "stage_index", "label").join(first, "run_id", "left").select("run_id", "stage_index", "label", state.alias("state"))


def family_counts(issues: DataFrame) -> DataFrame:
    """Per run and family: issues and their types in order of appearance."""
    own = in_order(issues).groupBy("run_id", "family").agg(F.count("*").alias("n_issues"), F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("t"))
    return own.select("run_id", "family", "n_issues", F.array_join(F.array_distinct(F.transform("t", lambda x: x["type"])), ",").alias("issue_types"))


def family_agreement(stages: DataFrame, issues: DataFrame) -> DataFrame:
    """How many of the three families speak at the first break."""
    first = F.min("edge_index").over(Window.partitionBy("run_id"))
    active = issues.withColumn("f", first).filter("edge_index = f").groupBy("run_id").agg(F.min("edge_index").alias("edge_index"), F.count_distinct("family").alias("n"))
    runs = stages.select("run_id").distinct().join(active, "run_id", "left")
    return runs.select("run_id", F.coalesce("n", F.lit(0)).alias("active"), F.lit(3).alias("total"), F.col("edge_index").alias("first_break"))


def primary_issue(issues: DataFrame) -> DataFrame:
    return in_order(issues).filter("pos = 1").drop("pos")


def blocking(issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """Edges at or above a severity."""
    edges = issues.groupBy("run_id", "edge_index").agg(F.max(rank_of(F.col("severity"))).alias("rank"))
    return edges.filter(F.col("rank") >= threshold_rank(threshold)).select("run_id", "edge_index", severity_of(F.col("rank")).alias("severity"))


def gate_decision(stages: DataFrame, issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """allow or block, the first blocking transition (else the last transition as the one reported on)."""
    first = blocking(issues, threshold).groupBy("run_id").agg(F.min("edge_index").alias("blocking_edge"))
    runs = stages.groupBy("run_id").agg((F.count("*") - 2).cast("int").alias("last")).join(first, "run_id", "left")
    return runs.select("run_id", F.when(F.col("blocking_edge").isNull(), "allow").otherwise("block").alias("decision"), F.lit(threshold).alias("threshold"), "blocking_edge", F.coalesce("blocking_edge", "last").alias("reported_edge"))


def run_until_block(stages: DataFrame, issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """What a serial run would have kept: stages up to and with the first blocked one."""
    first = blocking(issues, threshold).groupBy("run_id").agg(F.min("edge_index").alias("b"))
    return stages.join(first, "run_id", "left").filter("b is null or stage_index <= b + 1").withColumn("blocked", F.coalesce(F.col("stage_index") == F.col("b") + 1, F.lit(False))).drop("b")


def rollback_prefix(stages: DataFrame, issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """What a recovery keeps: stages up to the failed transition's source, of frozen runs only."""
    first = blocking(issues, threshold).groupBy("run_id").agg(F.min("edge_index").alias("b"))
    return stages.join(first, "run_id").filter("stage_index <= b").drop("b")


def review_counts(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts (run_id, issue_id, verdict): confirmed, dismissed and total of each run."""
    own = issues.select("run_id", "issue_id").join(verdicts.select("run_id", "issue_id", "verdict"), ["run_id", "issue_id"], "left")
    return own.groupBy("run_id").agg(F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "dismissed").alias("dismissed"), F.count("*").alias("total"))


def rule_parity(saved: DataFrame, given: DataFrame) -> DataFrame:
    """Per session: do a snapshot's rule ids equal the given ones?"""
    ids = lambda df, name: df.groupBy("session_id").agg(F.array_sort(F.collect_list("rule_id")).alias(name))
    both = ids(saved, "a").join(ids(given, "b"), "session_id", "full")
    return both.select("session_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))
