"""Queries of live sessions, exports and span details, added to those of the catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import detect, graph, policy, report, runtime, session
from ..sources import otlp, payloads, samples
from . import sql
from .catalog import BLOCK, FIRST, HANGS, RUN_ID, TOOLS_D, VER, G, J, O, intents, nodes_of, operations, orders, query, verdicts
from .views import duck, view

# Tools

#: Every event type but one is a registered tool.
TOOLS = [("click", "open", True), ("view", "look", False), ("add_to_cart", "collect", True), ("purchase", "pay", True), ("login", "enter", False), ("search", "look up", False)]


def tools(spark) -> DataFrame:
    return spark.createDataFrame(TOOLS[1:], "name string, action string, side_effect boolean")


def tool_values(rows) -> str:
    return "(VALUES " + ", ".join(f"('{n}', '{a}', {str(s).lower()})" for n, a, s in rows) + ") t(name, action, side_effect)"


def tool_requests(spark, sf_dir) -> DataFrame:
    """Each event asks for its type's tool, three in four under one of 20 keys of the user; what the policy says comes from the decisions."""
    asked, policies, approvals = intents(spark, sf_dir)
    said = policy.decisions(asked, policies, approvals).select(F.col("intent_id").alias("seq"), "decision")
    key = F.when(F.col("seq") % 4 != 0, F.concat(F.lit("k"), (F.col("seq") % 20).cast("string")))
    own = asked.select("session_id", "seq", "tool_name", (F.col("seq") % 3).cast("string").alias("input"), key.alias("idempotency_key"), (F.col("seq") % 17 == 0).alias("fails")).join(said, "seq")
    return runtime.registered(own, tools(spark))


ASKED = TOOLS_D.rsplit("SELECT intent_id", 1)
ASKED_SQL = ASKED[0].rstrip() + ", dec AS (SELECT intent_id" + ASKED[1] + f"""),
rq AS (SELECT m.session_id, m.intent_id AS seq, m.tool_name, t.action, t.name IS NOT NULL AS known, m.intent_id % 3 AS input, CASE WHEN m.intent_id % 4 <> 0 THEN concat('k', m.intent_id % 20) END AS key, m.intent_id % 17 = 0 AS fails, decision
  FROM m JOIN dec ON dec.intent_id = m.intent_id LEFT JOIN {tool_values(TOOLS[1:])} ON t.name = m.tool_name),
tl AS (SELECT *, CASE WHEN NOT known THEN 'error-unregistered' WHEN decision <> 'allowed' THEN decision WHEN fails THEN 'failed' ELSE 'completed' END AS told FROM rq),
fs AS (SELECT session_id, key, seq AS fseq, tool_name AS ftool, input AS finput, told AS ftold FROM tl WHERE key IS NOT NULL AND told IN ('completed', 'failed') QUALIFY row_number() OVER (PARTITION BY session_id, key ORDER BY seq) = 1),
ex AS (SELECT tl.*, fseq, ftold, CASE WHEN known AND fseq < seq THEN CASE WHEN ftool = tool_name AND finput = input THEN concat('shared-', ftold) ELSE 'error-key-conflict' END ELSE told END AS outcome FROM tl LEFT JOIN fs ON fs.session_id = tl.session_id AND fs.key = tl.key)"""


@query(f"SELECT user_id AS session_id, event_id AS seq, event_type AS tool_name, action, side_effect, name IS NOT NULL AS known FROM events LEFT JOIN {tool_values(TOOLS[1:])} ON name = event_type")
def tool_registry(spark, sf_dir):
    return tool_requests(spark, sf_dir).select("session_id", "seq", "tool_name", "action", "side_effect", "known")


@query(ASKED_SQL + " SELECT session_id, seq, outcome, CASE WHEN outcome IN ('completed', 'failed') THEN seq WHEN outcome LIKE 'shared-%' THEN fseq END AS executed_seq, CASE outcome WHEN 'completed' THEN concat('ran ', seq) WHEN 'shared-completed' THEN concat('ran ', fseq) END AS result FROM ex")
def tool_executions(spark, sf_dir):
    return runtime.tool_executions(tool_requests(spark, sf_dir), result=F.concat(F.lit("ran "), F.col("seq").cast("string")))


@query(ASKED_SQL + " SELECT session_id, seq, CASE WHEN NOT known THEN 'error-unregistered' WHEN key IS NULL THEN told WHEN fseq IS NULL THEN told WHEN tool_name = ftool AND input = finput THEN 'error-result-gone' ELSE 'error-key-conflict' END AS outcome FROM (SELECT ex.*, f.ftool, f.finput FROM ex LEFT JOIN fs f ON f.session_id = ex.session_id AND f.key = ex.key) y")
def restored_executions(spark, sf_dir):
    """The same requests once more, to sessions restored from what the first ones saved: no key that ran runs again."""
    asked = tool_requests(spark, sf_dir)
    saved = runtime.executions(asked, runtime.tool_executions(asked))
    return runtime.tool_executions(asked, restored=saved).select("session_id", "seq", "outcome")


@query("SELECT event_type AS name, 'repeated' AS code FROM events GROUP BY event_type HAVING count(DISTINCT event_id % 2) > 1 UNION ALL SELECT DISTINCT event_type, 'side-effect' FROM events WHERE event_id % 2 = 1 AND event_type LIKE 'p%' UNION ALL SELECT DISTINCT event_type, 'action' FROM events WHERE event_id % 2 = 0 AND event_type LIKE 'c%'")
def registry_faults(spark, sf_dir):
    """A registry with two entries a type: odd ones of p- lack a word on effects, even ones of c- an action."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name"), (F.col("event_id") % 2).alias("half")).distinct()
    odd = F.col("half") == 1
    return runtime.registry_faults(ev.select("name", F.when(~odd & F.col("name").startswith("c"), " ").otherwise("act").alias("action"), F.when(~(odd & F.col("name").startswith("p")), F.lit(False)).alias("side_effect")))


# Judges and modes


def answers(st: DataFrame) -> DataFrame:
    """A judge's answer to each handoff, by the stage's number: two findings, a failure, a finding without a title, none."""
    finding = lambda s, t: F.struct(F.lit(s).alias("severity"), F.lit(t).alias("title"), F.lit("A reviewer model objects.").alias("explanation"))
    n = F.col("stage_index") % 4
    none = F.array().cast("array<struct<severity:string,title:string,explanation:string>>")
    found = F.when(n == 1, F.array(finding("medium", "Tone moved"), finding("high", "Meaning moved"))).when(n == 3, F.array(finding("low", " "))).otherwise(none)
    return st.filter("stage_index > 0").select("run_id", (F.col("stage_index") - 1).cast("int").alias("edge_index"), F.when(n == 2, "timeout").alias("error"), found.alias("findings"))


JUDGED = """jd AS (SELECT run_id, CAST(stage_index - 1 AS INT) AS edge_index, u.* FROM st, (VALUES (1, 0, 'medium', 'Tone moved'), (1, 1, 'high', 'Meaning moved'), (2, 0, '{0}', 'Judge unavailable'), (3, 0, '{0}', 'Judge unavailable')) u(n, pos, severity, title) WHERE stage_index > 0 AND stage_index % 4 = n)"""


@query(f"WITH st AS ({duck('order')}), {JUDGED.format('low')} SELECT run_id, edge_index, CAST(pos AS INT) AS pos, severity, title FROM jd")
def judge_answers(spark, sf_dir):
    return runtime.judged(answers(view(spark, sf_dir, "order")), on_failure="warn").select("run_id", "edge_index", "pos", "severity", "title")


JUDGE_ROWS = "SELECT run_id, concat(edge_index, '-custom-semantic-judge-', pos + 1) AS issue_id, severity FROM jd"
BUILT_ROWS = "SELECT run_id, concat(edge_index, '-', type, '-', title) AS issue_id, severity FROM iss"


@query(O + f", {JUDGED.format('high')} SELECT 'deterministic' AS mode, * FROM ({BUILT_ROWS}) a UNION ALL SELECT 'hybrid', * FROM ({BUILT_ROWS} UNION ALL {JUDGE_ROWS}) b UNION ALL SELECT 'semantic', * FROM ({JUDGE_ROWS} UNION ALL {BUILT_ROWS} WHERE title = 'Stage content is missing') c")
def analysis_modes(spark, sf_dir):
    st = view(spark, sf_dir, "order")
    out = None
    for mode in runtime.MODES:
        judge = None if mode == "deterministic" else runtime.judged(answers(st), mode)
        one = runtime.by_mode(st, mode, judge=judge).select(F.lit(mode).alias("mode"), "run_id", "issue_id", "severity")
        out = one if out is None else out.unionByName(one)
    return out


# Snapshots, events, access


@query(O + BLOCK + " SELECT st.run_id AS session_id, string_agg(id, ',' ORDER BY stage_index) AS stage_ids, max(b) IS NOT NULL AS frozen, max(b) AS recovery_index, count(*) AS event_seq FROM st LEFT JOIN blk ON blk.run_id = st.run_id WHERE b IS NULL OR stage_index <= b + 1 GROUP BY st.run_id")
def session_snapshots(spark, sf_dir):
    return runtime.snapshots(*orders(spark, sf_dir)).select("session_id", F.array_join("stage_ids", ",").alias("stage_ids"), "frozen", "recovery_index", "event_seq")


def saved_sessions(spark, sf_dir) -> DataFrame:
    """A saved session for each user; the user's number says what is wrong with it."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id")).distinct()
    hit = lambda k: F.col("session_id") % 23 == k
    good = F.sha2(F.col("session_id").cast("string"), 256)
    record = lambda key, f, name, third: F.struct(F.lit(key).alias("key"), f.alias("fingerprint"), third.alias(name))
    return u.select(
        "session_id", F.when(hit(1), "2.0").otherwise("1.0").alias("version"), F.when(hit(2), " ").otherwise("run").alias("run_name"), F.when(hit(3), "severe").otherwise("medium").alias("threshold"), F.when(hit(4), "guess").otherwise("hybrid").alias("mode"),
        F.when(~hit(5), hit(6) | hit(7)).alias("frozen"), F.when(hit(7), 2).when(hit(8), 0).alias("recovery_index"), F.when(hit(9), F.array(F.lit("a"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("stage_ids"),
        F.when(hit(10), -1).otherwise(3).cast("long").alias("event_seq"), F.when(hit(11), F.array(F.lit("r1"), F.lit("r1"))).when(hit(12), F.array(F.lit("r1"), F.lit("r3"))).otherwise(F.array(F.lit("r2"), F.lit("r1"))).alias("rule_ids"),
        F.array(F.when(hit(13), "zz").otherwise(F.upper(good))).alias("approvals"), F.array(record("k", good, "status", F.when(hit(14), "lost").otherwise("completed")), record("l", good, "status", F.lit("pending"))).alias("executions"),
        F.when(hit(15), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))).alias("judged"), F.array(record("h", good, "stage_id", F.when(hit(16), "z").otherwise("b"))).alias("handoffs"),
    )


FAULTS = "ft AS (SELECT DISTINCT user_id AS session_id, code FROM events JOIN (VALUES (1, 'version'), (2, 'run-name'), (3, 'threshold'), (4, 'mode'), (5, 'frozen'), (6, 'recovery'), (7, 'recovery-range'), (8, 'recovery'), (9, 'stages'), (10, 'event-seq'), (11, 'rules'), (13, 'approvals'), (14, 'executions'), (15, 'judged'), (16, 'handoffs'){0}) v(k, code) ON user_id % 23 = k)"


@query("WITH " + FAULTS.format("") + " SELECT session_id, code FROM ft")
def snapshot_faults(spark, sf_dir):
    return session.snapshot_faults(saved_sessions(spark, sf_dir))


@query("WITH " + FAULTS.format(", (11, 'other-rules'), (12, 'other-rules')") + ", g AS (SELECT session_id, string_agg(code, ',' ORDER BY code) AS codes FROM ft GROUP BY session_id) SELECT u.session_id, codes IS NULL AS accepted, coalesce(codes, '') AS codes FROM (SELECT DISTINCT user_id AS session_id FROM events) u LEFT JOIN g ON g.session_id = u.session_id")
def snapshot_restore(spark, sf_dir):
    saved = saved_sessions(spark, sf_dir)
    return runtime.restored(saved, saved.select("session_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("rule_id")))


@query(O + BLOCK + " SELECT st.run_id AS session_id, CAST(stage_index + 1 AS BIGINT) AS sequence, CASE WHEN stage_index = 0 THEN 'source-recorded' WHEN b IS NULL OR stage_index < b + 1 THEN 'handoff-allowed' ELSE 'handoff-blocked' END AS type FROM st LEFT JOIN blk ON blk.run_id = st.run_id WHERE b IS NULL OR stage_index <= b + 1")
def session_events(spark, sf_dir):
    return runtime.events(session.gate_replay(operations(spark, sf_dir))).select("session_id", "sequence", "type")


@query("SELECT event_id AS request_id, CASE WHEN user_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS tenant, user_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0 AND user_id % 4 <> 0 AS admitted, CASE WHEN user_id % 7 = 0 OR event_id % 5 = 0 THEN 'required' WHEN event_id % 3 = 0 OR user_id % 4 = 0 THEN 'invalid' END AS code FROM events")
def tenant_access(spark, sf_dir):
    """Every seventh user gives no name, every fifth request no token, every third a wrong one; every fourth user has no key."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("user_id") % 7 == 0, " ").otherwise(F.col("user_id").cast("string"))
    right = F.concat(F.lit("key-"), F.col("user_id").cast("string"))
    keys = ev.select("user_id").distinct().filter("user_id % 4 <> 0").select(F.col("user_id").cast("string").alias("tenant"), F.sha2(right, 256).alias("digest"))
    return runtime.admitted(ev.select(F.col("event_id").alias("request_id"), name.alias("tenant"), F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 3 == 0, "guess").otherwise(right).alias("token")), keys)


# Exports


LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.LABELS.items()) + " END"
IN_ORDER = f"io AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY edge_index, {sql.RANK} DESC, ord) AS pos FROM iss)"


@query(O + f", {IN_ORDER}, t AS (SELECT run_id, {LABEL} AS l, min(pos) AS p FROM io GROUP BY run_id, type) SELECT run_id, string_agg(l, ' + ' ORDER BY p) AS names FROM t GROUP BY run_id")
def issue_labels(spark, sf_dir):
    return report.issue_names(orders(spark, sf_dir)[1])


@query(O + f""", h AS ({RUN_ID}), k AS (SELECT summ.run_id, f.text AS ft, f.label AS fl, t.label AS tl, trim(coalesce(t.guardrail, '')) AS g FROM summ JOIN st f ON f.run_id = summ.run_id AND f.stage_index = first_break JOIN st t ON t.run_id = summ.run_id AND t.stage_index = first_break + 1),
x AS (SELECT run_id, fl, tl, concat('. [Runtime] freeze', chr(10), '   Hold back all output from ', tl, ' on until it is reviewed.') AS a, concat('. [Lineage controller] restore', chr(10), '   Retry from “', ft, '”.') AS b, CASE WHEN g <> '' THEN concat('. [Authority firewall] reattach-policy', chr(10), '   Retry under “', g, '”.') END AS c,
  concat('. [', tl, '] retry', chr(10), '   Start again at ', tl, '; what came before stands.') AS d, concat('. [Human reviewer] approve', chr(10), '   Compare the repaired text with its source and approve it.') AS e FROM k),
y AS (SELECT run_id, fl, tl, list_filter([a, b, c, d, e], lambda s: s IS NOT NULL) AS ls FROM x)
SELECT summ.run_id, CASE WHEN ls IS NULL THEN concat('RECOVERY PLAN', chr(10), 'No rollback is required.') ELSE concat('RECOVERY PLAN', chr(10), 'Run: RUN-', upper(left(f, 16)), chr(10), 'Last verified: ', fl, chr(10), 'Restart at: ', tl, chr(10), chr(10), array_to_string(list_transform(ls, lambda s, i: concat(i, s)), chr(10))) END AS recovery
FROM summ JOIN h ON h.run_id = summ.run_id LEFT JOIN y ON y.run_id = summ.run_id""")
def recovery_text(spark, sf_dir):
    return report.recovery_text(*orders(spark, sf_dir))


@query()
def reviewed_text(spark, sf_dir):
    st, found = orders(spark, sf_dir)
    return report.reviewed_text(st, found, verdicts(found))


@query(O + f", h AS ({RUN_ID}), {IN_ORDER}, v AS (SELECT run_id, string_agg(concat({LABEL}, '/', severity, '/', coalesce({VER}, '-')), ',' ORDER BY pos) AS issues FROM io GROUP BY run_id), s AS (SELECT run_id, string_agg(text, '|' ORDER BY stage_index) AS texts FROM st GROUP BY run_id) SELECT summ.run_id, concat('RUN-', upper(left(f, 16))) AS id, texts, coalesce(issues, '') AS issues FROM summ JOIN h ON h.run_id = summ.run_id JOIN s ON s.run_id = summ.run_id LEFT JOIN v ON v.run_id = summ.run_id")
def report_json(spark, sf_dir):
    """The exported object, parsed again."""
    st, found = orders(spark, sf_dir)
    own = report.report_json(st, found, verdicts(found)).withColumn("r", F.from_json("report", "id string, stages array<struct<text:string>>, issues array<struct<label:string,severity:string,verdict:string>>"))
    issues = F.transform("r.issues", lambda i: F.concat(i["label"], F.lit("/"), i["severity"], F.lit("/"), F.coalesce(i["verdict"], F.lit("-"))))
    return own.select("run_id", "r.id", F.array_join(F.transform("r.stages", lambda s: s["text"]), "|").alias("texts"), F.array_join(issues, ",").alias("issues"))


GRAPH_ID = f"hg AS {HANGS.replace('CAST(fi AS VARCHAR)', 'concat(chr(34), fi, chr(34))')}, gid AS (SELECT st.run_id, sha256(concat('{{\"blockAtOrAbove\":\"medium\",\"guardrail\":', {J.format('coalesce(max(guardrail), ' + chr(39) * 2 + ')')}, ',\"nodes\":[', string_agg(concat('{{\"id\":', {J.format('id')}, ',\"inheritedClaims\":{{\"$undefined\":true}},\"label\":', {J.format('label')}, ',\"parentIds\":[', coalesce(ps, ''), '],\"text\":', {J.format('text')}, '}}'), ',' ORDER BY stage_index), '],\"schema\":\"trace-graph/1\"}}')) AS f FROM st LEFT JOIN hg ON hg.run_id = st.run_id AND hg.ti = st.stage_index GROUP BY st.run_id)"


@query(FIRST + f""", {GRAPH_ID}, d AS (SELECT f.run_id, string_agg(id, ',' ORDER BY id) AS ds FROM first f JOIN st ON st.run_id = f.run_id AND st.stage_index >= f.ti GROUP BY f.run_id), c AS (SELECT run_id, count(*) AS n FROM iss GROUP BY run_id)
SELECT runs.run_id, CASE WHEN edge_id IS NULL THEN 'allow' ELSE 'block' END AS decision, edge_id AS blocking_edge, concat('GRUN-', upper(left(gid.f, 16))) AS id, coalesce(c.n, 0) AS issues, CASE WHEN edge_id IS NULL THEN 'not-required' ELSE 'review-required' END AS status, ps AS verified_parents, ds AS contaminated
FROM runs JOIN gid ON gid.run_id = runs.run_id LEFT JOIN first f ON f.run_id = runs.run_id LEFT JOIN {HANGS} h ON h.run_id = f.run_id AND h.ti = f.ti LEFT JOIN d ON d.run_id = runs.run_id LEFT JOIN c ON c.run_id = runs.run_id""")
def graph_gate_response(spark, sf_dir):
    """The answer, parsed again."""
    own = graph.gate_response(nodes_of(spark, sf_dir))
    at = lambda p: F.get_json_object("response", f"$.{p}")
    return own.select("run_id", at("decision").alias("decision"), at("blockingEdgeId").alias("blocking_edge"), at("runId").alias("id"), at("issues").cast("long").alias("issues"), at("recovery.status").alias("status"), at("recovery.verifiedParents").alias("verified_parents"), at("recovery.contaminated").alias("contaminated"))


@query("SELECT doc_id, CASE WHEN f = '' THEN '—' WHEN hit > 0 THEN concat(CASE WHEN s > 0 THEN '…' ELSE '' END, substring(f, s + 1, least(length(f), hit - 1 + 96) - s), CASE WHEN hit - 1 + 96 < length(f) THEN '…' ELSE '' END) WHEN length(f) > 150 THEN concat(left(f, 147), '…') ELSE f END AS excerpt FROM (SELECT *, greatest(hit - 1 - 54, 0) AS s FROM (SELECT *, coalesce(list_min(list_filter([instr(lower(f), 'must'), instr(lower(f), 'never')], lambda p: p > 0)), 0) AS hit FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS f FROM documents) a) b) c")
def excerpt(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.excerpt(tx.flat(F.col("text")), F.array(F.lit("Must"), F.lit("never"))).alias("excerpt"))


# Span details

#: An encoded value of each event and what it decodes to: one text for both engines.
VALUES = """CASE event_id % 9 WHEN 0 THEN concat('{"stringValue":"', event_type, ' \\"q\\""}') WHEN 1 THEN '{"boolValue":true}' WHEN 2 THEN concat('{"intValue":"', CAST(event_id AS STRING), '"}') WHEN 3 THEN concat('{"intValue":', CAST(event_id AS STRING), '}')
  WHEN 4 THEN concat('{"arrayValue":{"values":[{"stringValue":"', event_type, '"},{"boolValue":false},{"arrayValue":{}}]}}') WHEN 5 THEN concat('{"kvlistValue":{"values":[{"key":"k","value":{"intValue":"', CAST(event_id AS STRING), '"}}]}}') WHEN 6 THEN '{"bytesValue":"AAE="}'
  WHEN 7 THEN '{"other":1}' ELSE 'broken' END"""
DECODED = """CASE event_id % 9 WHEN 0 THEN concat('"', event_type, ' \\"q\\""') WHEN 1 THEN 'true' WHEN 2 THEN concat('"', event_id, '"') WHEN 3 THEN CAST(event_id AS VARCHAR) WHEN 4 THEN concat('["', event_type, '",false,[]]') WHEN 5 THEN concat('{"k":"', event_id, '"}') WHEN 6 THEN '"AAE="' END"""


def encoded(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", VALUES.replace('\\"', '\\\\"') + " AS raw")


@query(f"SELECT event_id, {DECODED} AS value FROM events")
def otlp_anyvalue(spark, sf_dir):
    return encoded(spark, sf_dir).select("event_id", otlp.decoded(F.col("raw")).alias("value"))


TEXTS = """CASE event_id % 9 WHEN 0 THEN concat(event_type, ' "q"') WHEN 1 THEN 'true' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN CAST(event_id AS VARCHAR) WHEN 4 THEN concat(event_type, chr(10), 'false') WHEN 5 THEN CAST(event_id AS VARCHAR) WHEN 6 THEN 'AAE=' END"""


@query(f"SELECT event_id, {TEXTS} AS text FROM events")
def otlp_text(spark, sf_dir):
    return encoded(spark, sf_dir).select("event_id", otlp.text_of(F.col("raw")).alias("text"))


@query(f"SELECT event_id, pos, key, CASE WHEN pos IN (1, 2) THEN '\"v\"' ELSE {DECODED} END AS value, CASE WHEN key = '' THEN 'blank-key' WHEN pos = 2 THEN 'repeated-key' WHEN pos = 0 AND event_id % 9 >= 7 THEN 'bad-value' END AS code FROM events, (VALUES (0, 'first'), (1, 'second'), (2, 'second'), (3, '')) v(pos, key)")
def otlp_attributes(spark, sf_dir):
    one = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    v = F.lit('{"stringValue":"v"}')
    rows = encoded(spark, sf_dir).select(F.col("event_id").alias("payload_id"), F.lit(0).alias("input_index"), F.array(one("first", F.col("raw")), one("second", v), one(" second ", v), one(" ", F.col("raw"))).alias("attributes"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("resource_attributes"))
    return otlp.attributes_of(rows).select(F.col("payload_id").alias("event_id"), "pos", "key", "value", "code")


def linked_payloads(spark, sf_dir) -> DataFrame:
    """One payload a block of events: span n links to span n // 2, to the one before, to one of another trace and to one that is not there; times go round, and every third block lacks one."""
    st = view(spark, sf_dir, "event")
    hexed = lambda c: F.lpad(F.hex(c + 1), 16, "0")
    n, trace = F.col("stage_index"), F.lpad(F.lit("a"), 32, "0")
    link = lambda t, s: F.struct(t.alias("traceId"), s.alias("spanId"))
    links = F.array(link(trace, hexed(F.floor(n / 2))), link(trace, hexed(F.greatest(n - 1, F.lit(0)))), link(F.lpad(F.lit("b"), 32, "0"), hexed(F.lit(0))), link(trace, hexed(F.lit(900))))
    time = F.when(~((F.length("run_id") % 3 == 0) & (n == 1)), (n * 7 % 5 + 100).cast("string"))
    span = F.struct("stage_index", trace.alias("traceId"), hexed(n).alias("spanId"), F.col("label").alias("name"), time.alias("startTimeUnixNano"), links.alias("links"))
    rows = st.groupBy("run_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return rows.select(F.col("run_id").alias("payload_id"), F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))


HEX = "lower(lpad(printf('%X', {0} + 1), 16, '0'))"


@query(f"WITH st AS ({duck('event')}) SELECT run_id AS payload_id, {HEX.format('stage_index')} AS span, CAST(0 AS INT) AS pos, {HEX.format('stage_index // 2')} AS linked FROM st UNION ALL SELECT run_id, {HEX.format('stage_index')}, 1, {HEX.format('stage_index - 1')} FROM st WHERE stage_index > 0 AND stage_index - 1 <> stage_index // 2")
def span_links(spark, sf_dir):
    return otlp.span_links(otlp.flattened(linked_payloads(spark, sf_dir))).select("payload_id", "span", "pos", "linked")


@query(f"WITH st AS ({duck('event')}), t AS (SELECT *, CASE WHEN NOT (length(run_id) % 3 = 0 AND max(stage_index) OVER (PARTITION BY run_id) >= 1) THEN stage_index * 7 % 5 END AS began FROM st) SELECT run_id AS payload_id, {HEX.format('stage_index')} AS span, CAST(row_number() OVER (PARTITION BY run_id ORDER BY began, stage_index) - 1 AS INT) AS pos FROM t")
def span_order(spark, sf_dir):
    return otlp.span_order(otlp.flattened(linked_payloads(spark, sf_dir))).select("payload_id", "span", "pos")


# Built by hand


@query("SELECT * FROM (VALUES ('harvest', 1, 'number', 'high'), ('harvest', 1, 'quantifier', 'high'), ('harvest', 1, 'negation', 'high'), ('refund', 1, 'guardrail', 'high'), ('refund', 1, 'negation', 'high')) t(run_id, edge_index, type, severity)")
def builtin_traces(spark, sf_dir):
    """What the detectors say of the made-up traces."""
    return detect.analyse(samples.stages(spark)).select("run_id", "edge_index", "type", "severity")


@query("SELECT * FROM (VALUES (0, 'a', ''), (1, 'b', 'a'), (2, 'c', 'a'), (3, 'd', 'b,c')) t(node_pos, id, parents)")
def builder_graph(spark, sf_dir):
    g = payloads.Graph("built").node(" a ", "A", "one").node("b", "B", "two", ["a"]).node("c", "C", "three", ["a "]).node("d", "D", "four", ["b", "c"], {"b": "two"})
    return g.to_frame(spark).select("node_pos", "id", F.array_join("parent_ids", ",").alias("parents"))


# Broken payloads


def staged(*stages, **more) -> str:
    return json.dumps({"stages": [dict(zip(("id", "label", "text"), s)) for s in stages], **more})


def logged(*events) -> str:
    return json.dumps({"events": [dict(zip(("sequence", "type", "agentId", "agentName", "content", "timestamp"), e)) for e in events]})


def noded(*nodes, **more) -> str:
    return json.dumps({"schemaVersion": "1.1", "nodes": [dict(zip(("id", "label", "text", "parentIds", "inheritedClaims"), n)) for n in nodes], **more})


A, B = ("a", "A", "x"), ("b", "B", "y")
SRC, HAND = (0, "source", "a", "A", "x"), (1, "handoff", "b", "B", "y")
#: A chain payload and what is wrong with it.
CHAINS = [
    (staged(A, B), []), ("nope", ["not-json payload"]), (staged(A, B, schemaVersion="2.0"), ["version payload"]), (staged(A, B, events=[]), ["stages-or-events payload"]), ('{"runName":"x"}', ["stages-or-events payload"]), (staged(A), ["too-few-stages payload"]),
    (staged(A, ("b", " ", "")), ["blank-label stages[1]", "blank-text stages[1]"]), (staged(A, A), ["repeated-id stages[1]"]), (staged((" ", "A", "x"), B), ["blank-id stages[0]"]), (staged(A, B, blockAtOrAbove="severe"), ["threshold payload"]),
    (staged(("a", "A" * 201, "x"), B), ["long-label stages[0]"]), (staged(A, B, runName="r" * 201), ["long-run-name payload"]), (staged(*[(f"s{i}", "A", "x") for i in range(51)]), ["too-many-stages payload"]), (staged(A, B, guardrail="g" * 20001), ["long-guardrail payload"]),
    (staged(("a" * 129, "A", "x"), B), ["long-id stages[0]"]), (logged(SRC, HAND), []), (logged((0, "handoff", "a", "A", "x"), HAND), ["no-source events"]), (logged(SRC, (1, "source", "b", "B", "y")), ["second-source events"]), (logged(SRC, (0, "handoff", "b", "B", "y")), ["repeated-sequence events"]),
    (logged(SRC, (1, "note", "b", "B", "y")), ["type events[1]"]), (logged((-1, *SRC[1:]), HAND), ["sequence events[0]"]), (logged(SRC, (1, "handoff", " ", "", " ")), ["blank-agent-id events[1]", "blank-agent-name events[1]", "blank-content events[1]"]), (logged((*SRC, "t" * 129), HAND), ["long-timestamp events[0]"]),
    (staged((None, "A", "x"), (None, "B", "y")), []), (logged(HAND, SRC), []),
]
ROOT = (*A, [])
#: The same of graphs.
GRAPHS = [
    (noded(ROOT, (*B, ["a"])), []), ("[", ["not-json payload"]), (noded(ROOT, (*B, ["a"]), schemaVersion="1.0"), ["version payload"]), ('{"schemaVersion":"1.1"}', ["no-nodes payload"]), (noded(ROOT), ["too-few-nodes payload"]), (noded((*A, ["b"]), (*B, ["a"])), ["no-root payload", "cycle a", "cycle b"]),
    (noded(ROOT, (*B, ["a"]), (*B, ["a"])), ["repeated-id payload"]), (noded(ROOT, (*B, ["z"])), ["missing-parent b"]), (noded(ROOT, (*B, ["b"])), ["own-parent b", "cycle b"]), (noded(ROOT, (*B, ["a", "a "])), ["repeated-parent b"]), (noded(ROOT, (*B, ["a"], {"z": "q"})), ["claim-for-non-parent b"]),
    (noded(ROOT, ("b", "B", " ", ["a"])), ["blank-field b"]), (noded(ROOT, (*B, ["a"], {"a": " "})), ["blank-claim b"]), (noded(ROOT, (*B, [" "])), ["empty-parent b", "missing-parent b"]), (noded(ROOT, ("b", "B" * 201, "y", ["a"])), ["long-label b"]), (noded(*[(f"n{i}", "A", "x", ["n0"] if i else []) for i in range(51)]), ["too-many-nodes payload"]),
    (noded(ROOT, (*B, ["a"]), guardrail="g" * 20001), ["long-guardrail payload"]), (noded(ROOT, (*B, ["a"]), ("c", "C", "z", ["b", "d"]), ("d", "D", "z", ["c"])), ["cycle c", "cycle d"]),
]


def planted(spark, sf_dir, cases) -> DataFrame:
    """Each customer sends one of the cases."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("run_id"), F.element_at(F.array(*[F.lit(v) for v, _ in cases]), (F.col("c_custkey") % len(cases) + 1).cast("int")).alias("value"))


def expected(cases) -> str:
    rows = ", ".join(f"({i}, '{f.split(' ')[0]}', '{f.split(' ')[1]}')" for i, (_, found) in enumerate(cases) for f in found)
    return f"SELECT CAST(c_custkey AS VARCHAR) AS run_id, code, location FROM customer JOIN (VALUES {rows}) v(k, code, location) ON c_custkey % {len(cases)} = k"


@query(expected(CHAINS))
def chain_fault_codes(spark, sf_dir):
    return payloads.chain(planted(spark, sf_dir, CHAINS))[1]


@query(expected(GRAPHS))
def graph_fault_codes(spark, sf_dir):
    return payloads.graph(planted(spark, sf_dir, GRAPHS))[1]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS run_id, CASE n_nationkey % 4 WHEN 1 THEN 400 WHEN 2 THEN 413 WHEN 3 THEN 400 ELSE 200 END AS status FROM nation")
def oversize_status(spark, sf_dir):
    """Sound payloads, one text over 500,000 characters, payloads over two megabytes, and texts too long in all."""
    n = F.col("n_nationkey") % 4
    text = F.repeat(F.lit("x"), F.when(n == 1, 500_001).when(n == 2, 2_000_001).when(n == 3, 400_000).otherwise(5).cast("int"))
    stage = lambda i: F.struct(F.lit(i).alias("id"), F.lit("L").alias("label"), F.when((n == 2) | ((n == 1) & (F.lit(i) != "a")), "short").otherwise(text).alias("text"))
    body = F.struct(F.when(n == 2, text).alias("note"), F.array(*map(stage, "abcd")).alias("stages"))
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("run_id"), F.to_json(body).alias("value"))
    return payloads.status(own, payloads.chain(own)[1])
