"""All registered trace queries, far negations, nested span texts, cycles of spans, kinds of findings."""

import json
import os

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from tracequarry.functions import lexicon
from tracequarry.operators import detect, graph
from tracequarry.plans import catalog, live  # noqa: F401
from tracequarry.sources import otlp

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_runs(spark, name):
    """At the smallest size, against its SQL where it has one."""
    frame = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert difference(frame, duck(SF), catalog.SQL[name]) == ""
    else:
        assert frame.count() >= 0


def told(text):
    """Completed actions in plain Python, by the rule of the last negation in the 80 characters before."""
    import re

    def whole(words):
        return re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])")

    out = []
    for m in whole(lexicon.ACTIONS).finditer(text):
        before = text[max(0, m.start() - 80) : m.start()]
        last = list(whole(lexicon.NEGATIONS).finditer(before))
        between = before[last[-1].end() :] if last else ""
        if not last or re.search(r"[.!?;,:]", between) or whole(["and", "but", "however"]).search(between) or len(between.split()) > 3:
            out.append(m[0])
    return list(dict.fromkeys(out))


def test_completed_actions(spark):
    texts = ["not " + "x" * 45 + " sent", "not " + "x" * 90 + " sent", "not yet been fully sent", "not yet been quite fully sent", "not paid, sent", "not sent but published", "never sent published posted it", "", "sent sent", "do not " + "y" * 30 + " " + "z" * 39 + " deleted",
             "no mail was sent and none was deleted", "resent notsent", "cannot be released without tests shared", "é not 😀 sent"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lexicon.completed_actions(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == [told(t) for t in texts]
    assert got[0]["a"] == [] and got[1]["a"] == ["sent"]


@pytest.mark.parametrize("value, wanted", [
    ({"stringValue": "  plain "}, "plain"), ({"stringValue": " "}, None), ({"stringValue": '[{"role":"user","parts":[{"content":"a"},{"text":"b"}]}]'}, "a\nb"), ({"stringValue": "{broken}"}, "{broken}"), ({"stringValue": "[]"}, "[]"), ({"stringValue": '{"id":"x"}'}, '{"id":"x"}'),
    ({"stringValue": '{"text":"in","note":"out"}'}, "in"), ({"stringValue": '{"text":"","note":"out","other":["p",{"name":"n","q":2.0}]}'}, "out\np\n2"), ({"intValue": "5"}, "5"), ({"boolValue": True}, "true"), ({"doubleValue": 1.5}, "1.5"),
    ({"arrayValue": {"values": [{"stringValue": "x"}, {"kvlistValue": {"values": [{"key": "content", "value": {"stringValue": '{"message":{"output_text":"deep"}}'}}, {"key": "z", "value": {"stringValue": "lost"}}]}}]}}, "x\ndeep"), ({"stringValue": 5}, None), ({}, None), ("junk", None),
])
def test_span_texts(spark, value, wanted):
    raw = value if isinstance(value, str) else json.dumps(value)
    assert spark.createDataFrame([(raw,)], "v string").select(otlp.text_of(F.col("v"))).first()[0] == wanted


def test_depth_of_span_texts():
    nested = "deep"
    for _ in range(12):
        nested = [nested]
    assert otlp.texts_in(nested) == ["deep"] and otlp.texts_in([nested]) == []


def test_a_cycle_above_an_output_is_a_fault(spark):
    def span(n, parent, text=None):
        own = [{"key": "gen_ai.completion", "value": {"stringValue": text}}] if text else []
        return {"traceId": "a" * 32, "spanId": f"{n:016x}", "parentSpanId": f"{parent:016x}" if parent else "", "name": f"s{n}", "startTimeUnixNano": str(n), "attributes": own + [{"key": "gen_ai.prompt", "value": {"stringValue": "source"}}]}

    rows = {"loop": [span(1, 2), span(2, 1), span(3, 1, "out")], "harmless": [span(1, 2), span(2, 1), span(3, 0, "out")], "broken": [span(1, 2, "x"), span(2, 1, "y")]}
    frame = spark.createDataFrame([(k, json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": v}]}]})) for k, v in rows.items()], "payload_id string, value string")
    nodes, faults = otlp.to_nodes(frame)
    assert {(r["payload_id"], r["code"]) for r in faults.collect()} == {("loop", "parent-cycle")}
    assert {r["run_id"].split("/")[0] for r in nodes.collect()} == {"harmless", "broken"}


def test_kinds_of_findings(spark):
    st = spark.createDataFrame([("r", 0, "a", "A", "It may take 5 days; do not send.", "No external action."), ("r", 1, "b", "B", "It will take 6 days, all was sent.", "No external action."), ("r", 2, "c", "C", None, "No external action.")], "run_id string, stage_index int, id string, label string, text string, guardrail string")
    every = {(r["type"], r["edge_index"], r["before"], r["after"]) for r in detect.analyse(st).collect()}
    for kind in lexicon.FAMILY:
        assert {(r["type"], r["edge_index"], r["before"], r["after"]) for r in detect.analyse(st, kinds=[kind]).collect()} == {x for x in every if x[0] == kind}
    with pytest.raises(ValueError):
        detect.analyse(st, kinds=["none"])


def test_shapes_of_many_runs(spark):
    rows = [(f"g{g}", n, str(n), [str(n - 1)] if n else []) for g in range(700) for n in range(5)] + [("loop", 0, "a", ["b"]), ("loop", 1, "b", ["a"]), ("fan", 0, "r", []), ("fan", 1, "y", ["r"]), ("fan", 2, "x", ["r"]), ("fan", 3, "z", ["x", "y"])]
    nodes = spark.createDataFrame(rows, "run_id string, node_pos int, id string, parent_ids array<string>").repartition(7)
    got = {(r["run_id"], r["id"]): (r["topo_index"], r["depth"], sorted(r["below"])) for r in graph.shaped(nodes).collect()}
    assert len(got) == len(rows) and all(got[f"g{g}", str(n)] == (n, n, [str(x) for x in range(n, 5)]) for g in range(700) for n in range(5))
    assert got["loop", "a"] == (None, None, ["a", "b"]) and got["fan", "x"] == (2, 1, ["x", "z"]) and got["fan", "z"] == (3, 2, ["z"])
