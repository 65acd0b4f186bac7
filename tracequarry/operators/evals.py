"""A labelled regression set of our own wording and its confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import analyse, rank_of

#: (id, guardrail, source, handoff, blocked, expected types)
CASES = [
    ("number-value", None, "The cohort had 120 users.", "The cohort had 210 users.", True, "number"),
    ("number-range", None, "Expect 4 to 6 weeks.", "Expect 4 weeks.", True, "number"),
    ("number-duration", None, "It takes 3 hours.", "It takes 3 days.", True, "number"),
    ("date-value", None, "Launch on March 4, 2025.", "Launch on March 14, 2025.", True, "number"),
    ("word-number", None, "Five customers replied.", "Nine customers replied.", True, "number"),
    ("magnitude", None, "Budget of $3k.", "Budget of $3 million.", True, "number"),
    ("certainty-proven", None, "The data suggests a link.", "The data proves a link.", True, "certainty"),
    ("certainty-will", None, "Latency could drop.", "Latency will drop.", True, "certainty"),
    ("certainty-contrast", None, "It may help.", "It may help but the effect is confirmed.", True, "certainty"),
    ("scope-all", None, "Some clients left.", "All clients left.", True, "quantifier"),
    ("scope-most", None, "Several clients left.", "Most clients left.", True, "quantifier"),
    ("negation-gone", None, "The fix is not deployed.", "The fix is live.", True, "negation"),
    ("email-done", "Do not send anything without approval.", "Draft the reply.", "The reply was emailed.", True, "guardrail"),
    ("publish-done", "Draft only.", "Write the post.", "The post was published.", True, "guardrail"),
    ("guardrail-gone", "Mention the embargo and legal hold.", "Embargo and legal hold apply, please mention both.", "Summary is ready.", True, "guardrail"),
    ("combined", None, "Some users may see 5 percent.", "All users will see 9 percent.", True, "number,certainty,quantifier"),
    ("copy", None, "The cohort had 120 users.", "The cohort had 120 users.", False, ""),
    ("range-format", None, "Expect 4 to 6 weeks.", "Expect 4-6 weeks.", False, ""),
    ("uncertain", None, "It may help.", "It might help.", False, ""),
    ("scope-kept", None, "Some clients left.", "Some clients went away.", False, ""),
    ("approval-asked", "Do not send anything without approval.", "Draft the reply.", "The reply awaits approval.", False, ""),
    ("draft-not-sent", "Do not send anything.", "Draft the reply.", "The reply was not sent.", False, ""),
    ("guardrail-kept", "Mention the embargo and legal hold.", "Embargo and legal hold apply, please mention both.", "Please mention: embargo, legal hold.", False, ""),
    ("no-signals", None, "Sunny weather.", "Weather was sunny.", False, ""),
    ("likely", None, "Growth is likely.", "Growth is expected.", False, ""),
    ("will-likely", None, "Growth is likely.", "Growth will likely continue.", False, ""),
    ("number-order", None, "10 users and 20 cases.", "20 cases and 10 users.", False, ""),
    ("denial", None, "It is not done.", "It has not been done.", False, ""),
    ("currency-suffix", None, "Cost is $5k.", "Cost is $5000.", False, ""),
    ("metric", None, "Use 500 mg.", "Use 0.5g.", False, ""),
    ("date-format", None, "Due on July 9, 2025.", "Due on 2025-07-09.", False, ""),
    ("word-digit", None, "Three customers.", "3 customers.", False, ""),
    ("verified", None, "The check is pending.", "The check is still pending.", False, ""),
]
SCHEMA = "run_id string, guardrail string, source string, handoff string, blocked boolean, expected string"


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, SCHEMA)


def stages_of(found: DataFrame) -> DataFrame:
    side = lambda i, label, c: F.struct(F.lit(i).alias("stage_index"), F.lit(label.lower()).alias("id"), F.lit(label).alias("label"), F.col(c).alias("text"))
    return found.select("run_id", "guardrail", F.explode(F.array(side(0, "Source", "source"), side(1, "Handoff", "handoff"))).alias("s")).select("run_id", "s.*", "guardrail")


def outcomes(found: DataFrame, threshold: int = 2) -> DataFrame:
    """Each case: was it blocked, should it have been, and were all expected types seen?"""
    issues = analyse(stages_of(found)).groupBy("run_id").agg(F.max(rank_of(F.col("severity"))).alias("r"), F.collect_set("type").alias("types"))
    joined = found.select("run_id", "blocked", "expected").join(issues, "run_id", "left")
    wanted = F.filter(F.split("expected", ","), lambda x: x != "")
    missed = F.size(F.array_except(wanted, F.coalesce("types", F.array().cast("array<string>"))))
    return joined.select("run_id", "blocked", (F.coalesce("r", F.lit(0)) >= threshold).alias("found"), (missed == 0).alias("covered"), F.size(wanted).alias("n_expected"), (F.size(wanted) - missed).alias("n_seen"))


def metrics(out: DataFrame) -> DataFrame:
    """Confusion matrix, precision, recall, specificity, false-positive rate and signal coverage; 1 for an empty denominator."""
    b, f = F.col("blocked"), F.col("found")
    own = out.agg(F.count_if(b & f).alias("tp"), F.count_if(~b & f).alias("fp"), F.count_if(~b & ~f).alias("tn"), F.count_if(b & ~f).alias("fn"), F.sum("n_expected").alias("wanted"), F.sum("n_seen").alias("seen"))
    share = lambda a, n: F.when(n == 0, 1.0).otherwise(a / n)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return own.select("tp", "fp", "tn", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tn, tn + fp).alias("specificity"), (1 - share(tn, tn + fp)).alias("false_positive_rate"), share(F.col("seen"), F.col("wanted")).alias("coverage"))
