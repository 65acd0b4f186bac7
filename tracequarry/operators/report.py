"""Reports of chains: modules, recovery plans, identities and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import chain_fingerprint, long_id, short_id
from ..functions.text import trimmed, uri_component
from .detect import in_order, rank_of, severity_of
from .rollup import gate_decision, review_counts, run_summary, threshold_rank, transitions

VERSION = "0.5"
# What people see for an issue's type.
LABELS = {"number": "NUMBER DRIFT", "certainty": "CONFIDENCE", "quantifier": "SCOPE", "negation": "NEGATION", "guardrail": "GUARDRAIL", "coverage": "COVERAGE", "custom": "CUSTOM RULE"}


def edge_ids(stages: DataFrame) -> DataFrame:
    t = transitions(stages)
    return t.select("run_id", "edge_index", F.concat(uri_component(F.col("from_id")), F.lit("->"), uri_component(F.col("to_id"))).alias("edge_id"))


def run_ids(stages: DataFrame) -> DataFrame:
    """Content identity of each run: guardrail and stages, nothing else."""
    own = stages.groupBy("run_id").agg(F.max("guardrail").alias("guardrail"), F.array_sort(F.collect_list(F.struct("stage_index", "id", "label", "text"))).alias("s"))
    return own.withColumn("f", chain_fingerprint(F.coalesce("guardrail", F.lit("")), F.col("s"))).select("run_id", short_id(F.col("f")).alias("id"), long_id(F.col("f")).alias("fingerprint"))


def plural(n, word: str):
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def module_rows(stages: DataFrame, issues: DataFrame) -> DataFrame:
    """Seven rows a run: module, status and its number of findings."""
    by = lambda f: F.count_if(F.col("family") == f).alias(f)
    counts = issues.groupBy("run_id").agg(*map(by, ("evidence", "meaning", "authority")))
    guard = stages.groupBy("run_id").agg((F.max(F.length(trimmed(F.coalesce("guardrail", F.lit(""))))) > 0).alias("guarded"))
    s = run_summary(stages, issues).join(counts, "run_id", "left").join(guard, "run_id").fillna(0, ["evidence", "meaning", "authority"])
    broken = F.col("first_break").isNotNull()
    steps = F.when(broken, F.when(F.col("guarded"), 5).otherwise(4)).otherwise(0)
    row = lambda i, name, n, fixed=None: F.struct(F.lit(i).alias("position"), F.lit(name).alias("module"), (F.lit(fixed) if fixed else F.when(n > 0, "flagged").otherwise("complete")).alias("status"), n.cast("long").alias("finding_count"))
    modules = [row(1, "trace-collector", F.lit(0), "complete"), row(2, "claim-lineage", F.lit(0), "complete"), row(3, "evidence-sentinel", F.col("evidence")), row(4, "meaning-sentinel", F.col("meaning")), row(5, "authority-firewall", F.col("authority")), row(6, "contamination-tracer", F.lit(0), "complete"), row(7, "recovery-orchestrator", steps, "ready")]
    return s.select("run_id", F.explode(F.array(*modules)).alias("m")).select("run_id", "m.*")


def at_edge(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (run_id, edge_index) with the labels and texts of both ends."""
    side = lambda n, d: stages.select("run_id", (F.col("stage_index") - d).cast("int").alias("edge_index"), F.col("label").alias(f"{n}_label"), F.col("text").alias(f"{n}_text"))
    return edges.join(side("from", 0), ["run_id", "edge_index"]).join(side("to", 1), ["run_id", "edge_index"])


def recovery_actions(stages: DataFrame, failed: DataFrame) -> DataFrame:
    """failed (run_id, edge_index) to the ordered steps of each recovery; the policy step only where there is an instruction."""
    guard = stages.groupBy("run_id").agg(F.max(trimmed(F.coalesce("guardrail", F.lit("")))).alias("guardrail"))
    own = at_edge(stages, failed).join(guard, "run_id")
    to = F.col("to_label")
    step = lambda i, name, owner, text, blocks: F.struct(F.lit(i).alias("position"), F.lit(name).alias("action"), (F.lit(owner) if isinstance(owner, str) else owner).alias("owner"), text.alias("instruction"), F.lit(blocks).alias("blocking"))
    steps = F.array(
        step(1, "freeze", "Runtime", F.concat(F.lit("Hold back all output from "), to, F.lit(" on until it is reviewed.")), True),
        step(2, "restore", "Lineage controller", F.concat(F.lit("Retry from “"), "from_text", F.lit("”.")), True),
        F.when(F.col("guardrail") != "", step(3, "reattach-policy", "Authority firewall", F.concat(F.lit("Retry under “"), "guardrail", F.lit("”.")), True)),
        step(4, "retry", to, F.concat(F.lit("Start again at "), to, F.lit("; what came before stands.")), False),
        step(5, "approve", "Human reviewer", F.lit("Compare the repaired text with its source and approve it."), True),
    )
    return own.select("run_id", "edge_index", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("a")).select("run_id", "edge_index", "a.*")


def report_text(stages: DataFrame, issues: DataFrame) -> DataFrame:
    """A plain-text report a run."""
    s = run_summary(stages, issues)
    first = at_edge(stages, s.filter("first_break is not null").select("run_id", F.col("first_break").alias("edge_index"))).select("run_id", F.concat("from_label", F.lit(" → "), "to_label").alias("at"))
    line = F.concat(F.col("pos").cast("string"), F.lit(". ["), F.upper("severity"), F.lit("] "), "title", F.lit(" — "), "from_label", F.lit(" → "), "to_label", F.lit("\n   "), "explanation")
    lines = in_order(issues).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("ls"))
    own = s.join(first, "run_id", "left").join(lines, "run_id", "left")
    body = F.when(F.col("ls").isNull(), "No change was found.").otherwise(F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    text = F.concat(F.lit("TRACE REPORT\nFirst mutation: "), F.coalesce("at", F.lit("No mutation detected")), F.lit("\nOutputs after first mutation: "), F.col("contaminated").cast("string"), F.lit("\n\n"), body, F.lit("\n\nHeuristic; check what matters against the source."))
    return own.select("run_id", text.alias("report"))


def share_line(stages: DataFrame, issues: DataFrame) -> DataFrame:
    s = run_summary(stages, issues)
    text = F.when(F.col("first_break").isNull(), F.concat(plural(F.col("n_stages"), "stage"), F.lit(", no mutation"))).otherwise(F.concat(plural(F.col("n_issues"), "issue"), F.lit(", first break at handoff "), (F.col("first_break") + 1).cast("string"), F.lit(", "), plural(F.col("contaminated"), "output"), F.lit(" affected")))
    return s.select("run_id", text.alias("line"))


def receipt(stages: DataFrame, issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First break, outputs behind it, distinct signal types, reviewed and total, share reviewed (100 without issues)."""
    joined = issues.join(verdicts.select("run_id", "issue_id", "verdict"), ["run_id", "issue_id"], "left")
    own = joined.groupBy("run_id").agg(F.count_distinct("type").alias("signal_types"), F.count("verdict").alias("reviewed"))
    s = run_summary(stages, issues).join(own, "run_id", "left").fillna(0, ["signal_types", "reviewed"])
    share = F.when(F.col("n_issues") == 0, 100).otherwise(F.round(100 * F.col("reviewed") / F.col("n_issues"))).cast("int")
    return s.select("run_id", "first_break", "contaminated", "signal_types", "reviewed", F.col("n_issues").alias("total"), share.alias("review_percent"))


def gate_response(stages: DataFrame, issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """The gate's answer a run as JSON."""
    d = gate_decision(stages, issues, threshold).join(run_ids(stages), "run_id").join(run_summary(stages, issues), "run_id")
    body = F.to_json(F.struct("decision", "threshold", F.col("blocking_edge").alias("blockingTransitionIndex"), F.col("reported_edge").alias("transition"), F.col("id").alias("runId"), F.col("severity").alias("overallSeverity"), F.col("n_issues").alias("issues")), {"ignoreNullFields": "false"})
    return d.select("run_id", body.alias("response"))


def replay_frames(signals: DataFrame, issues: DataFrame) -> DataFrame:
    """Each stage with its number of claims and the issues of the handoff that led to it."""
    into = issues.groupBy("run_id", (F.col("edge_index") + 1).alias("stage_index")).agg(F.count("*").alias("n"), F.max(rank_of(F.col("severity"))).alias("r"))
    own = signals.join(into, ["run_id", "stage_index"], "left")
    return own.select("run_id", "stage_index", "label", F.size("negations").alias("n_negations"), F.coalesce("n", F.lit(0)).alias("incoming_issues"), F.coalesce("r", F.lit(0)).alias("incoming_rank"))


def chain_report(stages: DataFrame, issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """One row a run: identity, severity, first break, agreement and decision. Issues are read once: by edge, then by run, in the same exchange."""
    mask = F.when(F.col("family") == "evidence", 1).when(F.col("family") == "meaning", 2).otherwise(4)
    edges = issues.groupBy("run_id", "edge_index").agg(F.count("*").alias("n"), F.max(rank_of(F.col("severity"))).alias("rank"), F.bit_or(mask).alias("families"))
    found = edges.groupBy("run_id").agg(
        F.sum("n").alias("n"), F.max("rank").alias("rank"), F.min("edge_index").alias("first_break"), F.bit_count(F.min_by("families", "edge_index")).alias("active"),
        F.min(F.when(F.col("rank") >= threshold_rank(threshold), F.col("edge_index"))).alias("blocking_edge"),
    )
    own = stages.groupBy("run_id").agg(F.count("*").alias("n_stages"), F.max("guardrail").alias("guardrail"), F.array_sort(F.collect_list(F.struct("stage_index", "id", "label", "text"))).alias("s"))
    f = chain_fingerprint(F.coalesce("guardrail", F.lit("")), F.col("s"))
    out = own.withColumn("f", f).join(found, "run_id", "left")
    contaminated = F.when(F.col("first_break").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("n_stages") - F.col("first_break") - 1)).cast("long")
    return out.select(
        "run_id", "n_stages", F.coalesce("n", F.lit(0)).alias("n_issues"), severity_of(F.coalesce("rank", F.lit(0))).alias("severity"), "first_break", contaminated.alias("contaminated"),
        short_id(F.col("f")).alias("id"), long_id(F.col("f")).alias("fingerprint"), F.coalesce("active", F.lit(0)).cast("long").alias("active"),
        F.when(F.col("blocking_edge").isNull(), "allow").otherwise("block").alias("decision"), "blocking_edge", F.lit(VERSION).alias("version"),
    )


def label_of(kind):
    """An issue type's label; null for what is no type."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), kind)


def issue_names(issues: DataFrame) -> DataFrame:
    """Labels of a run's distinct issue types in the order in which they turn up."""
    first = in_order(issues).groupBy("run_id", "type").agg(F.min("pos").alias("pos"))
    return first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("t")).select("run_id", F.array_join(F.transform("t", lambda x: label_of(x["type"])), " + ").alias("names"))


def reviewed_text(stages: DataFrame, issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The plain-text report and, below it, what people said about its issues."""
    own = report_text(stages, issues).join(review_counts(issues, verdicts), "run_id", "left")
    said = F.when(F.coalesce(F.col("confirmed") + F.col("dismissed"), F.lit(0)) > 0, F.concat(F.lit("\nReviewed: "), F.col("confirmed").cast("string"), F.lit(" confirmed, "), F.col("dismissed").cast("string"), F.lit(" dismissed"))).otherwise("\nReviewed: pending")
    return own.select("run_id", F.concat("report", said).alias("report"))


def recovery_text(stages: DataFrame, issues: DataFrame) -> DataFrame:
    """A recovery plan a run as text: identity, last good stage, where to start again and the numbered steps."""
    s = run_summary(stages, issues).select("run_id", F.col("first_break").alias("edge_index"))
    failed = s.filter("edge_index is not null")
    ends = at_edge(stages, failed).select("run_id", "from_label", "to_label")
    line = F.concat(F.lit(" ["), "owner", F.lit("] "), "action", F.lit("\n   "), "instruction")
    steps = recovery_actions(stages, failed).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), x["l"])), "\n")
    whole = F.concat(F.lit("RECOVERY PLAN\nRun: "), "id", F.lit("\nLast verified: "), "from_label", F.lit("\nRestart at: "), "to_label", F.lit("\n\n"), body)
    own = s.join(run_ids(stages).select("run_id", "id"), "run_id").join(ends, "run_id", "left").join(steps, "run_id", "left")
    return own.select("run_id", F.when(F.col("edge_index").isNull(), "RECOVERY PLAN\nNo rollback is required.").otherwise(whole).alias("recovery"))


def report_json(stages: DataFrame, issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The whole report a run as one JSON object, for df.write.text or json: identity, instruction, stages, ordered issues with their verdicts."""
    found = in_order(issues).join(verdicts.select("run_id", "issue_id", "verdict"), ["run_id", "issue_id"], "left")
    one = F.struct("pos", "edge_index", "issue_id", label_of(F.col("type")).alias("label"), "family", "severity", "title", "explanation", "before", "after", "verdict")
    found = found.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("issues"))
    own = stages.groupBy("run_id").agg(F.max("guardrail").alias("guardrail"), F.array_sort(F.collect_list(F.struct("stage_index", "id", "label", "text"))).alias("stages"))
    f = chain_fingerprint(F.coalesce("guardrail", F.lit("")), F.col("stages"))
    out = own.withColumn("id", short_id(f)).join(found, "run_id", "left")
    body = F.struct("id", F.lit(VERSION).alias("version"), F.coalesce("guardrail", F.lit("")).alias("guardrail"), "stages", F.coalesce("issues", F.array().cast(found.schema["issues"].dataType)).alias("issues"))
    return out.select("run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))
