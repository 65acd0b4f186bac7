"""What live sessions do, set-wise: registered tools, idempotent executions, judges and modes, snapshots and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import json_string
from ..functions.text import trimmed
from . import detect
from .rollup import run_until_block
from .session import snapshot_faults

MODES = ("deterministic", "hybrid", "semantic")
REQUEST = ("session_id", "seq")


def blank(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit(""))) == ""


def registry_faults(tools: DataFrame) -> DataFrame:
    """tools (name, action, side_effect) to (name, code): a blank name or action, no word on side effects, a name that is there twice."""
    own = tools.withColumn("name", trimmed(F.coalesce("name", F.lit(""))))
    codes = F.array(F.when(F.col("name") == "", F.lit("name")), F.when(blank(F.col("action")), F.lit("action")), F.when(F.col("side_effect").isNull(), F.lit("side-effect")))
    rows = own.select("name", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))
    twice = own.filter("name <> ''").groupBy("name").count().filter("count > 1").select("name", F.lit("repeated").alias("code"))
    return rows.unionByName(twice)


def registered(requests: DataFrame, tools: DataFrame) -> DataFrame:
    """requests (tool_name, ...) with the action and side_effect of the tool of exactly this trimmed name; known is false without one. The registry must be sound: see registry_faults."""
    own = tools.select(trimmed(F.col("name")).alias("tool_name"), trimmed(F.col("action")).alias("action"), "side_effect", F.lit(True).alias("known"))
    return requests.withColumn("tool_name", trimmed(F.coalesce("tool_name", F.lit("")))).join(own, "tool_name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def operation_fingerprint(tool: Column, action: Column, value: Column) -> Column:
    """SHA-256 over {action, input, toolName} with keys in order; the tool's name in lower case."""
    part = lambda name, c: F.concat(F.lit(f'"{name}":'), json_string(c))
    return F.sha2(F.concat(F.lit("{"), part("action", trimmed(action)), F.lit(","), part("input", value), F.lit(","), part("toolName", F.lower(trimmed(tool))), F.lit("}")), 256)


def tool_executions(requests: DataFrame, result: Column | None = None, restored: DataFrame | None = None) -> DataFrame:
    """One row a request: outcome, executed_seq (the request whose execution answers it) and result.

    requests: session_id, seq (one each in its session), tool_name, action, input (text), idempotency_key (null or blank: none), known, decision (what the policy says
    where it is asked), fails (does the tool's own code fail). result: an expression over these columns, evaluated where a tool runs.
    restored: session_id, idempotency_key, fingerprint of executions saved before, whose results are gone.

    The first request of a key that the policy lets through is executed and answers for all later ones of equal content, whether it worked or not; later ones of other
    content are conflicts. Blocked requests leave no record. A restored key is never executed again. Keyed requests are folded to one row a key first.
    """
    own = requests.withColumn("idempotency_key", F.nullif(trimmed(F.coalesce("idempotency_key", F.lit(""))), F.lit("")))
    own = own.withColumn("fingerprint", operation_fingerprint(F.col("tool_name"), F.col("action"), F.col("input")))
    own = own.withColumn("result", (F.lit(None) if result is None else result).cast("string"))
    told = F.when(~F.col("known"), "error-unregistered").when(F.col("decision") != "allowed", F.col("decision")).when(F.coalesce("fails", F.lit(False)), "failed").otherwise("completed")
    own = own.withColumn("told", told)
    runs = F.col("told").isin("failed", "completed")
    # Without a key nothing is shared: these rows take no exchange.
    free = own.filter("idempotency_key is null").select(*REQUEST, F.col("told").alias("outcome"), F.when(runs, F.col("seq")).alias("executed_seq"), F.when(F.col("told") == "completed", F.col("result")).alias("result"))
    keyed, key = own.filter("idempotency_key is not null"), ["session_id", "idempotency_key"]
    first = keyed.filter(runs).groupBy(*key).agg(F.min_by(F.struct("seq", "fingerprint", "told", "result"), "seq").alias("first"))
    both = keyed.join(first, key, "left")
    if restored is None:
        both = both.withColumn("saved", F.lit(None).cast("string"))
    else:
        both = both.join(restored.select(*key, F.col("fingerprint").alias("saved")), key, "left")
    later = F.col("first").isNotNull() & (F.col("seq") > F.col("first.seq"))
    same = F.col("first.fingerprint") == F.col("fingerprint")
    outcome = (
        F.when(~F.col("known"), "error-unregistered").when(F.col("saved").isNotNull(), F.when(F.col("saved") == F.col("fingerprint"), "error-result-gone").otherwise("error-key-conflict"))
        .when(later, F.when(~same, "error-key-conflict").otherwise(F.concat(F.lit("shared-"), F.col("first.told")))).otherwise(F.col("told"))
    )
    answered = outcome.isin("completed", "failed", "shared-completed", "shared-failed")
    shared = both.select(*REQUEST, outcome.alias("outcome"), F.when(answered, F.col("first.seq")).alias("executed_seq"), F.when(outcome.isin("completed", "shared-completed"), F.col("first.result")).alias("result"))
    return free.unionByName(shared)


def executions(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The records that a snapshot saves: session_id, idempotency_key, fingerprint and status of every keyed request that ran."""
    ran = outcomes.filter("executed_seq = seq").select(*REQUEST, F.col("outcome").alias("status"))
    own = requests.withColumn("idempotency_key", trimmed("idempotency_key")).filter("idempotency_key <> ''")
    return own.join(ran, list(REQUEST)).select("session_id", "idempotency_key", operation_fingerprint(F.col("tool_name"), F.col("action"), F.col("input")).alias("fingerprint"), "status")


def judged(answers: DataFrame, mode: str = "hybrid", on_failure: str = "block") -> DataFrame:
    """A judge's answers (run_id, edge_index, error, findings array of severity, title, explanation) as the findings that analyse() takes.

    An error, or one bad finding, makes the whole answer a failure: high where failures block, else low. Empty answers say nothing.
    """
    if mode not in MODES[1:] or on_failure not in ("block", "warn"):
        raise ValueError("mode is hybrid or semantic, on_failure block or warn")
    bad = F.exists("findings", lambda f: f.isNull() | ~F.coalesce(f["severity"].isin("low", "medium", "high"), F.lit(False)) | blank(f["title"]) | blank(f["explanation"]))
    why = F.coalesce(F.col("error"), F.when(F.coalesce(bad, F.lit(False)), F.lit("bad finding")))
    rest = "a person has to look at this handoff before it goes on." if on_failure == "block" else "nothing else looks at meaning here." if mode == "semantic" else "only the built-in detectors looked at this handoff."
    lost = F.struct(F.lit("high" if on_failure == "block" else "low").alias("severity"), F.lit("Judge unavailable").alias("title"), F.concat(F.lit("The judge failed ("), why, F.lit(f"): {rest}")).alias("explanation"))
    sound = F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), trimmed(f["title"]).alias("title"), trimmed(f["explanation"]).alias("explanation")))
    return answers.select("run_id", "edge_index", F.posexplode(F.when(why.isNotNull(), F.array(lost)).otherwise(sound)).alias("pos", "f")).select("run_id", "edge_index", "pos", "f.*")


def by_mode(stages: DataFrame, mode: str, rules=(), judge: DataFrame | None = None) -> DataFrame:
    """Issues of a mode: deterministic asks no judge, hybrid adds its findings, semantic leaves only rules, the judge and missing content. judge: see judged()."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode != "deterministic" and judge is None:
        raise ValueError(f"mode {mode} needs a judge")
    return detect.analyse(stages, rules, built_in=mode != "semantic", judge=None if mode == "deterministic" else judge)


def snapshots(stages: DataFrame, issues: DataFrame, threshold: str = "medium") -> DataFrame:
    """One row a session that took the stages one by one until one was blocked: its stages so far, frozen, recovery_index and event_seq (one event a stage)."""
    taken = run_until_block(stages, issues, threshold)
    own = taken.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stage_index", "id"))).alias("s"), F.max("blocked").alias("frozen"), F.count("*").alias("event_seq"))
    return own.select(
        F.col("run_id").alias("session_id"), F.lit("1.0").alias("version"), F.lit(threshold).alias("threshold"), F.transform("s", lambda x: x["id"]).alias("stage_ids"), "frozen",
        F.when(F.col("frozen"), F.size("s") - 2).alias("recovery_index"), "event_seq",
    )


def new_session_id() -> Column:
    """SES- and 20 hexadecimal digits, others in each run and each attempt of a task: store the rows before they are used twice."""
    return F.concat(F.lit("SES-"), F.upper(F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(20))))


def checkpoint(snapshots: DataFrame, path: str) -> None:
    """Append snapshots to a store in a shared folder; older ones stay."""
    snapshots.write.mode("append").parquet(path)


def resume(spark: SparkSession, path: str, session_ids: DataFrame | None = None) -> DataFrame:
    """Each session's newest snapshot of a store, by event_seq; of the given session_id rows only, null beyond the id for one that is not there. See restored() for what may come back."""
    every = spark.read.parquet(path)
    rest = [c for c in every.columns if c != "session_id"]
    newest = every.groupBy("session_id").agg(F.max_by(F.struct(*rest), "event_seq").alias("s")).select("session_id", "s.*")
    return newest if session_ids is None else session_ids.select("session_id").distinct().join(newest, "session_id", "left")


def restored(saved: DataFrame, rules: DataFrame) -> DataFrame:
    """saved (see snapshot_faults) and rules (session_id, rule_id: given at the restart) to (session_id, accepted, codes): sound snapshots whose rule ids are those given come back."""
    given = rules.groupBy("session_id").agg(F.array_sort(F.collect_list(trimmed("rule_id"))).alias("given"))
    none = F.array().cast("array<string>")
    other = saved.join(given, "session_id", "left").filter(F.array_sort(F.transform(F.coalesce("rule_ids", none), trimmed)) != F.coalesce("given", none)).select("session_id", F.lit("other-rules").alias("code"))
    codes = snapshot_faults(saved).unionByName(other).groupBy("session_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return saved.select("session_id").join(codes, "session_id", "left").select("session_id", F.col("codes").isNull().alias("accepted"), F.array_join(F.coalesce("codes", none), ",").alias("codes"))


def events(decided: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Events of operations (session_id, seq, op, outcome, stage_id, event_seq of session.gate_replay) for an append sink: type, session_id, sequence, agent and message.

    Errors and replayed answers emit nothing; what is emitted counts from 1 on in each session, or from start (session_id, event_sequence) of a restored one.
    """
    kind = F.create_map(*[F.lit(x) for pair in {"recorded": "source-recorded", "allowed": "handoff-allowed", "blocked": "handoff-blocked", "reset": "session-reset"}.items() for x in pair])
    own = decided.withColumn("type", F.try_element_at(kind, F.col("outcome"))).filter("type is not null")
    own = own.withColumn("sequence", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).cast("long"))
    if start is not None:
        own = own.join(start.select("session_id", "event_sequence"), "session_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("event_sequence", F.lit(0)))
    return own.select("session_id", "sequence", "type", F.col("stage_id").alias("agent"), F.concat_ws(" ", "type", "stage_id").alias("message"))


def admitted(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests (request_id, tenant, token) and keys (tenant, digest: SHA-256 of the key) to (request_id, tenant, admitted, code). Keys are kept and compared as digests only."""
    own = requests.withColumn("tenant", F.nullif(trimmed(F.coalesce("tenant", F.lit(""))), F.lit(""))).withColumn("token", F.nullif(F.coalesce("token", F.lit("")), F.lit("")))
    known = keys.select("tenant", F.lower("digest").alias("digest"))
    code = F.when(F.col("tenant").isNull() | F.col("token").isNull(), "required").when(~F.coalesce(F.sha2("token", 256) == F.col("digest"), F.lit(False)), "invalid")
    return own.join(known, "tenant", "left").select("request_id", "tenant", code.isNull().alias("admitted"), code.alias("code"))
