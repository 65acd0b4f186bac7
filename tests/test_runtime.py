"""Live sessions: executions against a serial replay, restored ones, judges, modes, snapshots, events, builders."""

import random

import pytest
from pyspark.sql import functions as F

import tracequarry as tq
from tracequarry.operators import detect, report, runtime, session
from tracequarry.sources import otlp, payloads, samples

ASKED = "session_id string, seq long, tool_name string, action string, input string, idempotency_key string, known boolean, decision string, fails boolean"


def serial(rows, saved=()):
    """Request by request, with a table of records, as a session does it."""
    records, out = {k: (f, "gone", None) for k, f in saved}, {}
    for session_id, seq, tool, action, value, key, known, decision, fails in sorted(rows, key=lambda r: (r[0], r[1])):
        content, at = (tool.strip().lower(), action.strip(), value), (session_id, (key or "").strip())
        if not known:
            out[session_id, seq] = ("error-unregistered", None)
        elif at[1] and at in records:
            old, status, ran = records[at]
            out[session_id, seq] = ("error-key-conflict", None) if old != content else ("error-result-gone", None) if status == "gone" else ("shared-" + status, ran)
        elif decision != "allowed":
            out[session_id, seq] = (decision, None)
        else:
            status = "failed" if fails else "completed"
            out[session_id, seq] = (status, seq)
            if at[1]:
                records[at] = (content, status, seq)
    return out


def made(seed, n=400):
    r = random.Random(seed)
    pick = r.choice
    return [(pick("ab"), i, pick(["Pay", "pay ", "look"]), pick(["do", " do"]), pick(["1", "2", None]), pick([None, "", " ", "k1", "k1 ", "k2", "k3", "k4"]), r.random() > 0.05, pick(["allowed", "allowed", "blocked", "approval-required"]), r.random() < 0.2) for i in range(n)]


def told(frame):
    return {(r["session_id"], r["seq"]): (r["outcome"], r["executed_seq"]) for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_executions_are_those_of_a_serial_session(spark, seed):
    rows = made(seed)
    got = runtime.tool_executions(spark.createDataFrame(rows, ASKED), result=F.col("input"))
    assert told(got) == serial(rows)
    by_seq = {r[1]: r for r in rows}
    for r in got.collect():
        ran = r["outcome"] in ("completed", "shared-completed")
        assert r["result"] == (by_seq[r["executed_seq"]][4] if ran else None)


def test_restored_executions_never_run_again(spark):
    rows = made(4)
    asked = spark.createDataFrame(rows, ASKED)
    outcomes = runtime.tool_executions(asked)
    saved = runtime.executions(asked, outcomes)
    first = {(r[0], r[5].strip()): (r[2].strip().lower(), r[3].strip(), r[4]) for r in rows if (r[5] or "").strip() and serial(rows)[r[0], r[1]][1] == r[1]}
    assert saved.count() == len(first) and {(r["session_id"], r["idempotency_key"]) for r in saved.collect()} == set(first)
    assert told(runtime.tool_executions(asked, restored=saved)) == serial(rows, first.items())


def test_no_requests(spark):
    assert runtime.tool_executions(spark.createDataFrame([], ASKED)).count() == 0


def test_registry(spark):
    tools = spark.createDataFrame([("pay", "pay out", True), (" pay", "again", True), ("", "x", False), ("look", " ", None)], "name string, action string, side_effect boolean")
    assert sorted(map(tuple, runtime.registry_faults(tools).collect())) == [("", "name"), ("look", "action"), ("look", "side-effect"), ("pay", "repeated")]
    asked = spark.createDataFrame([("pay",), ("Pay",), (None,)], "tool_name string")
    assert {r["tool_name"]: r["known"] for r in runtime.registered(asked, tools.limit(1)).collect()} == {"pay": True, "Pay": False, "": False}


def test_judges(spark):
    kind = "run_id string, edge_index int, error string, findings array<struct<severity:string,title:string,explanation:string>>"
    rows = [("a", 0, None, [("low", " T ", "e")]), ("a", 1, "timeout", [("low", "T", "e")]), ("a", 2, None, [("low", "T", "e"), ("worst", "T", "e")]), ("a", 3, None, [("low", "T", " ")]), ("a", 4, None, []), ("a", 5, None, None), ("a", 6, None, [(None, "T", "e")])]
    got = {r["edge_index"]: (r["severity"], r["title"]) for r in runtime.judged(spark.createDataFrame(rows, kind)).collect()}
    lost = ("high", "Judge unavailable")
    assert got == {0: ("low", "T"), 1: lost, 2: lost, 3: lost, 6: lost}
    assert {r["severity"] for r in runtime.judged(spark.createDataFrame(rows, kind), "semantic", "warn").collect()} == {"low"}
    with pytest.raises(ValueError):
        runtime.judged(spark.createDataFrame(rows, kind), "deterministic")


def test_modes(spark):
    st = samples.stages(spark)
    judge = spark.createDataFrame([("calm", 0, 1, "low", "B", "e"), ("calm", 0, 0, "high", "Z", "e")], "run_id string, edge_index int, pos int, severity string, title string, explanation string")
    ids = lambda mode: {r["issue_id"] for r in runtime.by_mode(st, mode, judge=judge).filter("run_id = 'calm'").collect()}
    assert ids("deterministic") == set() and ids("hybrid") == ids("semantic") == {"0-custom-semantic-judge-1", "0-custom-semantic-judge-2"}
    first = runtime.by_mode(st, "hybrid", judge=judge).filter("issue_id = '0-custom-semantic-judge-1'").first()
    assert first["title"] == "Z"  # in the judge's own order
    assert runtime.by_mode(st, "semantic", judge=judge).filter("run_id <> 'calm'").count() == 0
    for bad in ("hybrid", "guess"):
        with pytest.raises(ValueError):
            runtime.by_mode(st, bad)


def test_snapshots_and_events(spark):
    st = samples.stages(spark)
    found = detect.analyse(st)
    got = {r["session_id"]: (len(r["stage_ids"]), r["frozen"], r["recovery_index"], r["event_seq"]) for r in runtime.snapshots(st, found).collect()}
    assert got == {"harvest": (3, True, 1, 3), "refund": (3, True, 1, 3), "calm": (2, False, None, 2)}
    kind = "session_id string, seq long, op string, agent_id string, content string, idempotency_key string, blocked boolean"
    ops = [("s", 0, "record-source", "src", "t", None, False), ("s", 1, "handoff", "x", "u", "k", False), ("s", 2, "handoff", "x", "u", "k", False), ("s", 3, "handoff", "y", "v", None, True), ("s", 4, "handoff", "z", "w", None, False), ("s", 5, "reset", None, None, None, False)]
    out = runtime.events(session.gate_replay(spark.createDataFrame(ops, kind)), spark.createDataFrame([("s", 10)], "session_id string, event_sequence long"))
    assert [(r["sequence"], r["type"]) for r in out.orderBy("sequence").collect()] == [(11, "source-recorded"), (12, "handoff-allowed"), (13, "handoff-blocked"), (14, "session-reset")]


def test_snapshot_store(spark, tmp_path):
    kind, at = "session_id string, event_seq long, stage_ids array<string>", f"file://{tmp_path}/store"
    runtime.checkpoint(spark.createDataFrame([("a", 1, ["s"]), ("b", 4, ["s", "t"])], kind), at)
    runtime.checkpoint(spark.createDataFrame([("a", 2, ["s", "u"])], kind), at)
    newest = lambda f: {r["session_id"]: (r["event_seq"], r["stage_ids"]) for r in f.collect()}
    assert newest(runtime.resume(spark, at)) == {"a": (2, ["s", "u"]), "b": (4, ["s", "t"])}
    assert newest(runtime.resume(spark, at, spark.createDataFrame([("a",), ("c",)], "session_id string"))) == {"a": (2, ["s", "u"]), "c": (None, None)}
    ids = [r[0] for r in spark.range(50).select(runtime.new_session_id()).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 24 and i[4:] == i[4:].upper() for i in ids)


def test_long_sessions_come_in_many_batches(spark):
    """One session of more rows than a batch holds, others around it, out of order."""
    rows = [("b", i, "r", i * 1000) for i in range(25_000)] + [(t, i, "r", i * 1000) for t in "ac" for i in range(3)]
    random.Random(5).shuffle(rows)
    asked = spark.createDataFrame([(t, i, n) for t, i, _, n in rows], "tenant string, request_id long, now_ms long")
    got = {(r["tenant"], r["request_id"]): (r["allowed"], r["retry_after_ms"]) for r in session.rate_limit(asked, quota=2, window=5000).collect()}
    assert len(got) == len(rows) and got["a", 2] == (False, 3000)
    for i in range(25_000):
        assert got["b", i] == ((True, 0) if i % 5 < 2 else (False, 5000 - i % 5 * 1000))


def test_recovery_text(spark):
    st = samples.stages(spark)
    got = {r["run_id"]: r["recovery"] for r in report.recovery_text(st, detect.analyse(st)).collect()}
    assert got["calm"] == "RECOVERY PLAN\nNo rollback is required."
    assert "Last verified: Triage\nRestart at: Payer\n\n1. [Runtime] freeze" in got["refund"] and "\n5. [Human reviewer] approve" in got["refund"]


def test_builders(spark):
    assert tq.Chain is payloads.Chain
    for wrong in (lambda: payloads.Graph("g").node("a", " ", "c"), lambda: payloads.Graph("g").node("a", "b", "c").node(" a", "b", "c")):
        with pytest.raises(payloads.TraceError):
            wrong()
    rows = payloads.Graph("g", "keep").node("a", "A", "one").node("b", "B", "two", ["a "], {" a": "one "}).to_frame(spark).orderBy("node_pos").collect()
    assert rows[1]["parent_ids"] == ["a"] and rows[1]["inherited_claims"] == {"a": "one"} and rows[0]["guardrail"] == "keep"


@pytest.mark.parametrize("raw, wanted", [
    ('{"stringValue":"a\\u0000\\"b\\\\"}', '"a\\u0000\\"b\\\\"'), (' { "stringValue" : "x" } ', '"x"'), ('{"stringValue":"x","boolValue":true}', '"x"'), ('{"boolValue":false}', "false"), ('{"doubleValue":1.5}', "1.5"),
    ('{"kvlistValue":{"values":[{"key":"a","value":{"arrayValue":{"values":[{"stringValue":"é"}]}}}]}}', '{"a":["é"]}'), ('{"arrayValue":{"values":[{}]}}', None), ("null", None), (None, None), ("", None), ("{", None),
])
def test_any_values(spark, raw, wanted):
    assert spark.createDataFrame([(raw,)], "raw string").select(otlp.decoded(F.col("raw")).alias("v")).first()["v"] == wanted


def test_exports():
    for name in tq.__all__:
        assert getattr(tq, name) is not None
    assert tq.analyse is detect.analyse and tq.chain_report is report.chain_report and "Graph" in tq.__all__
    with pytest.raises(AttributeError):
        tq.nothing
