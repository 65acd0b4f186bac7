"""What keeps detectors in proportion to their input: equal texts worked out once, nothing made or carried that nobody reads, and the same findings all the same."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tracequarry.operators import detect, signals

STAGES = "run_id string, stage_index int, id string, label string, text string, guardrail string"


def plan(frame) -> str:
    with redirect_stdout(io.StringIO()) as out:
        frame.explain()
    return out.getvalue()


def rows(*runs):
    return [(f"r{i}", n, f"s{n}", f"S{n}", text, guardrail) for i, run in enumerate(runs) for n, (text, guardrail) in enumerate(run)]


def test_equal_texts_are_worked_out_once(spark):
    """Counted by a Python function among the columns that each distinct text gets."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1 if text is not None else 0)
        return text

    texts = ["It may take 5 days; the order was not sent before." + str(i % 3) for i in range(60)]
    st = spark.createDataFrame([(f"r{i}", 0, "a", "A", t, None) for i, t in enumerate(texts)], STAGES)
    got = signals.with_signals(st, more={"seen": lambda text, normal, own: counted(text)}).select("text", "seen", "numbers").collect()
    assert len(got) == 60 and all(r["seen"] == r["text"] and r["numbers"] for r in got) and calls.value == 3


def test_rules_and_texts_ask_for_no_signals(spark):
    """Rules and judges read texts only: no pattern of the lexicons is in their plans."""
    st = spark.createDataFrame(rows([("It may ship.", None), ("It will ship.", None)]), STAGES)
    rule = detect.Rule("r", "evidence", lambda p, c, g: c["text"].contains("will"))
    found = detect.analyse(st, (rule,), built_in=False)
    assert [r["issue_id"] for r in found.filter("type = 'custom'").collect()] == ["0-custom-r-1"]
    assert "confirmed" not in plan(found) and "confirmed" in plan(detect.analyse(st, (rule,)))


def test_what_is_said_is_not_made_where_only_severity_is_read(spark):
    st = spark.createDataFrame(rows([("It may take 5 days.", None), ("It will take 6 days.", None)]), STAGES)
    found = detect.analyse(st)
    assert "Numbers went from" in plan(found) and "Numbers went from" not in plan(found.groupBy("run_id").agg(F.max("severity")))


def test_an_instruction_that_changes_within_a_run(spark):
    """The earlier end is asked for the words of the later end's instruction."""
    keep, other = "Keep boxes dry always.", "Paint fences green today."
    st = spark.createDataFrame(rows([("Fences are green.", keep), ("Boxes are wet.", other)], [("Fences are blue.", other), ("Nothing.", other)], [("Fences are blue.", None), ("Nothing.", other)]), STAGES)
    found = {(r["run_id"], r["title"], r["before"], r["after"]) for r in detect.analyse(st, kinds=["guardrail"]).filter("type = 'guardrail'").collect()}
    lost = "Guardrail was not carried forward"
    assert found == {("r0", lost, "Fences are green.", "Boxes are wet.")}


def test_no_text_and_no_label_in_the_way(spark):
    st = spark.createDataFrame(rows([(None, None), (" ", "Keep boxes dry."), ("5 boxes", None)], [("x", None)]), STAGES)
    assert {(r["run_id"], r["edge_index"], r["title"]) for r in detect.analyse(st).collect()} == {("r0", 0, "Stage content is missing"), ("r0", 1, "Stage content is missing")}


def test_words_between_ascii_edges(spark):
    """By its SQL, first_break takes words of other letters between ASCII edges; detectors by themselves take them anywhere."""
    guard = "Éierchen éon elleierpa la."
    st = spark.createDataFrame(rows([(guard, guard), ("Çaux êonon éauxè éonauxê.", guard), ("Éierchen.", guard)]), STAGES)
    assert detect.analyse(st).filter("type = 'guardrail'").count() == 0
    assert [r["edge_index"] for r in detect.analyse(st, edged=True).filter("type = 'guardrail'").collect()] == [0]
