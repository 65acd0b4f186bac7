"""Detectors, graphs, policies, sessions and payloads over small literal frames."""

import json

import pytest
from pyspark.sql import functions as F

from tracequarry.functions.numbers import claims
from tracequarry.operators import detect, evals, graph, policy, session
from tracequarry.sources import payloads


def test_regression_set(spark):
    m = evals.metrics(evals.outcomes(evals.cases(spark))).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (16, 0, 17, 0)
    assert m["precision"] == m["recall"] == m["specificity"] == m["coverage"] == 1.0


@pytest.fixture(scope="module")
def claimed(spark):
    texts = ["12abc", "21st", "3rd", "v2.0beta", "500 gallons", "$5k-10k", "12 to 18 days", "5 meters", "5m", "1234567890123", "-80 degrees", "GPT-4", "in 2024,", "twenty-one users", "three percent", "2 percentage points",
             "March 5, 2024", "5th Mar. 2024", "2024-02-31", "2024-13-01", "$2 million", "$2m", "1,500 g", "1.5 kg", "", "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", claims(F.col("t")).alias("c")).collect()
    return {r["t"]: r["c"] for r in rows}


@pytest.mark.parametrize("text, wanted", [
    ("12abc", ["1"]), ("21st", ["2"]), ("3rd", []), ("500 gallons", ["500"]), ("$5k-10k", ["$5000", "10000"]), ("12 to 18 days", ["12-18day"]), ("5 meters", ["5m"]), ("5m", ["5m"]), ("1234567890123", ["1234567890120"]),
    ("-80 degrees", ["80degree"]), ("GPT-4", ["4"]), ("in 2024,", ["2024"]), ("twenty-one users", ["21user"]), ("three percent", ["3%"]), ("2 percentage points", ["2pp"]), ("March 5, 2024", ["2024-03-05"]),
    ("5th Mar. 2024", ["2024-03-05"]), ("2024-02-31", ["2024-02-31"]), ("$2 million", ["$2000000"]), ("$2m", ["$2000000"]), ("1,500 g", ["1500g"]), ("1.5 kg", ["1500g"]), ("", []), ("none", []),
])
def test_claims(claimed, text, wanted):
    assert claimed[text] == wanted


def chain(spark, *texts, guardrail=None):
    return spark.createDataFrame([("r", i, f"s{i}", f"S{i}", t, guardrail) for i, t in enumerate(texts)], "run_id string, stage_index int, id string, label string, text string, guardrail string")


def test_missing_content_hides_the_other_detectors(spark):
    found = detect.analyse(chain(spark, "It may take 5 days.", " ", None)).collect()
    assert {(r["edge_index"], r["title"]) for r in found} == {(0, "Stage content is missing"), (1, "Stage content is missing")}


def test_shuffled_rows_change_nothing(spark):
    st = chain(spark, "It may take 5 days.", "It will take 6 days.", "All was sent.", guardrail="Do not send without approval.")
    own = lambda df: sorted((r["issue_id"], r["severity"]) for r in detect.analyse(df).collect())
    assert own(st) == own(st.orderBy(F.rand(1)).repartition(3)) != []


def test_rules_are_checked():
    with pytest.raises(ValueError):
        detect.checked_rules([detect.Rule("a", "evidence", None), detect.Rule("a", "meaning", None)])
    with pytest.raises(ValueError):
        detect.checked_rules([detect.Rule("a", "none", None)])


NODES = "run_id string, node_pos int, id string, label string, text string, parent_ids array<string>, guardrail string"


def nodes(spark, *rows):
    return spark.createDataFrame([("g", i, n, n.upper(), text, parents, None) for i, (n, text, parents) in enumerate(rows)], NODES)


def test_graph_states_follow_the_first_blocking_edge(spark):
    own = nodes(spark, ("a", "We may ship 5 boxes.", []), ("b", "We may ship 5 boxes.", ["a"]), ("c", "We may ship 9 boxes.", ["a"]), ("d", "We may ship 9 boxes.", ["b", "c"]))
    edges = graph.graph_edges(own)
    first = graph.first_blocking_edge(edges, graph.graph_issues(edges))
    assert first.first()["edge_id"] == "a->c"
    assert {r["id"]: r["state"] for r in graph.graph_states(own, first).collect()} == {"a": "verified", "b": "verified", "c": "first-break", "d": "downstream"}
    assert graph.validated(own).count() == 0


def test_graph_faults(spark):
    own = nodes(spark, ("a", "x", []), ("b", "x", ["c"]), ("c", "x", ["b", "lost"]))
    assert {"missing-parent", "cycle"} <= {r["code"] for r in graph.validated(own).collect()}


def test_tool_patterns(spark):
    df = spark.createDataFrame([(" Send_Mail ", ["send*"]), ("read", ["*"]), ("read", ["Read"]), ("reader", ["read"]), ("x", [])], "n string, p array<string>")
    assert [r[0] for r in df.select(policy.matches_tool(F.col("n"), F.col("p"))).collect()] == [True, True, True, False, False]


OPS = [(1, "record-source", "a", "s", None, False), (2, "handoff", "b", "t", "k", False), (3, "handoff", "b", "t", "k", False), (4, "handoff", "b", "u", "k", False), (5, "handoff", "b", "v", None, True), (6, "handoff", "c", "w", None, False), (7, "reset", None, None, None, False), (8, "handoff", "b", "v2", None, False)]
OUT = ["recorded", "allowed", "replayed-allowed", "error-key-conflict", "blocked", "error-frozen", "reset", "allowed"]
OP_SCHEMA = "session_id string, seq long, op string, agent_id string, content string, idempotency_key string, blocked boolean"


def test_gate_replay(spark):
    ops = spark.createDataFrame([("s", *o) for o in OPS], OP_SCHEMA)
    out = session.gate_replay(ops).orderBy("seq").collect()
    assert [r["outcome"] for r in out] == OUT
    assert out[4]["stage_id"] == out[7]["stage_id"] == "b-2"


def test_gate_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from tracequarry.streaming import gate

    got = []
    for part in (OPS[:5], OPS[5:]):
        spark.createDataFrame([("s", *o) for o in part], OP_SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(OP_SCHEMA).json(str(tmp_path / "in"))
        gate.to_parquet(gate.gate_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = [r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == OUT


def test_rate_limit(spark):
    req = spark.createDataFrame([("t", 1, 0), ("t", 2, 1), ("t", 3, 60_000), ("u", 4, 1)], "tenant string, request_id long, now_ms long")
    assert {r["request_id"]: r["allowed"] for r in session.rate_limit(req, quota=1).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_chain_payloads(spark):
    ev = lambda n, kind, agent: {"sequence": n, "type": kind, "agentId": agent, "agentName": agent.upper(), "content": f"c{n}"}
    rows = {
        "events": {"events": [ev(3, "handoff", "b"), ev(1, "source", "a"), ev(2, "handoff", "b")]}, "both": {"events": [], "stages": []}, "version": {"schemaVersion": "9", "stages": [{"label": "x", "text": "y"}] * 2},
        "stages": {"stages": [{"label": "x", "text": "y"}, {"label": "z", "text": "w"}]}, "second": {"events": [ev(1, "source", "a"), ev(2, "source", "b")]},
    }
    own = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()] + [("junk", "{")], "run_id string, value string")
    sound, faults = payloads.chain(own)
    got = {}
    for r in sound.orderBy("run_id", "stage_index").collect():
        got.setdefault(r["run_id"], []).append(r["id"])
    assert got == {"events": ["a", "b", "b-2"], "stages": ["stage-1", "stage-2"]}
    assert {r["run_id"] for r in faults.collect()} == {"both", "version", "second", "junk"}


def test_nearest_selected_span_at_any_depth(spark):
    from tracequarry.sources import otlp

    rows = [("p", "t", f"s{i}", f"s{i - 1}" if i else None, i in (0, 5)) for i in range(200)]
    rows += [("p", "c", f"c{i}", f"c{(i + 1) % 3}", False) for i in range(3)] + [("p", "c", "tail", "c0", False), ("p", "c", "top", "tail", True), ("p", "c", "leaf", "top", False), ("p", "c", "lost", "nowhere", False)]
    frame = spark.createDataFrame(rows, "payload_id string, trace string, span string, parent string, selected boolean")
    up = {(t, s): (p, x) for _, t, s, p, x in rows}
    wanted = {}
    for t, s in up:
        at, seen = up[t, s][0], set()
        while at is not None and at not in seen and (t, at) in up and not up[t, at][1]:
            seen.add(at)
            at = up[t, at][0]
        wanted[t, s] = at if at is not None and up.get((t, at), (None, False))[1] else None
    assert wanted["t", "s199"] == "s5" and wanted["c", "leaf"] == "top" and wanted["c", "top"] is None
    got = otlp.nearest_selected(frame).collect()
    assert len(got) == len(rows) and {(r["trace"], r["span"]): r["ancestor"] for r in got} == wanted
