"""Tool policies: who may call what, approvals and idempotency, decided set-wise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

LISTS = ("allowed", "denied", "approval_required", "side_effect")


def matches_tool(name: Column, patterns: Column) -> Column:
    """Does a tool match a pattern: *, a prefix with a trailing *, or the name itself, whatever the case?"""
    own = F.lower(trimmed(name))

    def one(p: Column) -> Column:
        q = F.lower(trimmed(p))
        return (q == "*") | F.when(q.endswith("*"), own.startswith(F.substring(q, F.lit(1), F.length(q) - 1))).otherwise(own == q)

    return F.coalesce(F.exists(patterns, one), F.lit(False))


def invalid_policies(policies: DataFrame) -> DataFrame:
    """Policies with a blank pattern or an unknown mode."""
    blank = lambda c: F.coalesce(F.exists(c, lambda p: p.isNull() | (trimmed(p) == "")), F.lit(False))
    bad = F.array(*[F.when(blank(c), F.lit(f"blank-{c}")) for c in LISTS], F.when(~F.coalesce(F.col("default_mode").isin("allow", "require-approval", "deny"), F.lit(True)), F.lit("mode")))
    return policies.select("policy_id", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("code"))


def decisions(intents: DataFrame, policies: DataFrame, approvals: DataFrame) -> DataFrame:
    """intents (intent_id, session_id, seq, policy_id, tool_name, side_effect, token, approved_by, has_source, frozen) to decision and reason.

    policies: policy_id, allowed, denied, approval_required, side_effect, default_mode. approvals: token, valid (null: the verifier failed). A token
    is consumed by the first intent of its session that it lets through; a later one is blocked. Policies without an approval for a token ask for one.
    """
    pol = policies.select("policy_id", *LISTS, F.coalesce("default_mode", F.lit("require-approval")).alias("default_mode"))
    m = lambda c: matches_tool(F.col("tool_name"), F.col(c))
    effect = F.coalesce("acts", F.lit(False)) | F.col("acts_by_policy")
    own = intents.withColumnRenamed("side_effect", "acts").join(pol, "policy_id", "left").join(approvals.select("token", F.lit(True).alias("known"), "valid"), "token", "left")
    own = own.withColumn("acts_by_policy", m("side_effect")).withColumn("is_allowed", m("allowed")).withColumn("is_denied", m("denied")).withColumn("asks", m("approval_required"))
    needs = F.col("asks") | effect & ~F.col("is_allowed") & (F.col("default_mode") == "require-approval")
    own = own.withColumn("needs", needs)
    stop = (~F.col("has_source")) | F.col("frozen") | F.col("is_denied") | (effect & (F.col("default_mode") == "deny") & ~F.col("is_allowed"))
    usable = F.col("needs") & ~stop & F.col("token").isNotNull() & (trimmed(F.col("token")) != "") & (trimmed(F.coalesce("approved_by", F.lit(""))) != "") & F.coalesce(F.col("valid"), F.lit(False))
    turn = F.sum(F.when(usable, 1).otherwise(0)).over(Window.partitionBy("session_id", "token").orderBy("seq", "intent_id").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("used", F.coalesce(turn, F.lit(0)))
    ladder = [
        (~F.col("has_source"), "blocked", "no-source"), (F.col("frozen"), "blocked", "frozen"), (F.col("is_denied"), "blocked", "denied"),
        (effect & (F.col("default_mode") == "deny") & ~F.col("is_allowed"), "blocked", "side-effect-denied"), (~F.col("needs"), "allowed", "policy"),
        (F.col("token").isNull() | (trimmed(F.col("token")) == "") | (trimmed(F.coalesce("approved_by", F.lit(""))) == ""), "approval-required", "no-token"), (F.col("used") > 0, "blocked", "token-consumed"), (F.col("known").isNull(), "approval-required", "no-verifier"),
        (F.col("valid").isNull(), "blocked", "verifier-failed"), (~F.col("valid"), "approval-required", "refused"),
    ]
    decision, reason = F.lit("allowed"), F.lit("approved")
    for when, d, r in reversed(ladder):
        decision, reason = F.when(when, d).otherwise(decision), F.when(when, r).otherwise(reason)
    return own.select("intent_id", "session_id", "tool_name", decision.alias("decision"), reason.alias("reason"))


def idempotency_conflicts(requests: DataFrame) -> DataFrame:
    """requests (session_id, key, fingerprint): keys that came with more than one content."""
    return requests.filter("key is not null").groupBy("session_id", "key").agg(F.count("*").alias("n_requests"), F.count_distinct("fingerprint").alias("n_contents")).filter("n_contents > 1")
