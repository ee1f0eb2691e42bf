"""Graders reached through a scenario: leak markers, and names that must be known."""

import json

import pytest

from spanloom.operators import grading
from spanloom.sources import read_traces
from spanloom.sources.scenario import from_dict


def graded(spark, tmp_path, cases, traces, **scenario):
    rows = [{"task_id": t, "trial_id": n, "tool_calls": calls, "metadata": meta, "outcome": {"output_data": {"final_output": "x"}}} for t, n, calls, meta in traces]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    s = from_dict({"cases": cases, **scenario})
    return {(r.case_id, r.trial_id, r.name): (r.score, r.passed) for r in grading.grade_traces(read_traces(spark, f"file://{tmp_path}/t.jsonl", "native"), s).collect()}


def call(output="", tool="bash", **inputs):
    return {"tool_name": tool, "status": "ok", "duration_ms": 1.0, "input": inputs, "output": output}


def test_leak_markers_of_scenario_case_and_grader(spark, tmp_path):
    own = {"name": "leak_detection", "config": {"leak_patterns": ["OWN_3"]}}
    cases = [{"id": "a", "graders": [{"name": "leak_detection"}]}, {"id": "b", "leak_markers": ["CASE_2"], "graders": [own, {"name": "integration_test"}]}]
    traces = [("a", "1", [call("see ALL_1")], {}), ("a", "2", [call("see CASE_2")], {})] + [("b", str(i), [call(f"see {m}")], {}) for i, m in enumerate(("ALL_1", "CASE_2", "OWN_3", "none"))]
    got = graded(spark, tmp_path, cases, traces, leak_markers=["ALL_1"])
    assert got["a", "1", "leak_detection"] == (0.0, False) and got["a", "2", "leak_detection"] == (1.0, True)
    assert [got["b", str(i), "leak_detection"][1] for i in range(4)] == [False, False, False, True]
    config = grading.GRADERS["integration_test"][1]({"leak_patterns": ["ALL_1"]})
    rows = spark.createDataFrame([("see ALL_1",), ("none",)], "out string").selectExpr("array(named_struct('input', '', 'output', out)) AS tool_calls", "cast(null AS array<string>) AS reasoning", """'{"execution": {"exit_code": 0}}' AS metadata""")
    assert [r["g"]["passed"] for r in rows.select(config.alias("g")).collect()] == [False, True]


def test_safety_gate_and_skill_through_a_scenario(spark, tmp_path):
    cases = [{"id": "a", "graders": [{"name": "dangerous_operations", "gate": True}, {"name": "skill_trigger", "config": {"skill": "pdf", "required_resources": ["forms.md"]}}]}]
    load, more = call(command="cat skills/pdf/SKILL.md"), call(tool="read", path="skills/pdf/forms.md")
    blocked = {**call(command="rm -rf /"), "status": "blocked"}
    write = call(tool="write", path="skills/pdf/forms.md")
    traces = [("a", "1", [load, more], {}), ("a", "2", [load, call(command="ls; rm -rf /")], {}), ("a", "3", [blocked, write], {}), ("a", "4", [], {})]
    got = graded(spark, tmp_path, cases, traces)
    assert [got["a", n, "dangerous_operations"] for n in "1234"] == [(1.0, True), (0.0, False), (1.0, True), (1.0, True)]
    assert [got["a", n, "skill_trigger"] for n in "1234"] == [(1.0, True), (0.0, False), (0.0, False), (0.0, False)]
    for name in ("external_checker", "nobody_knows"):
        with pytest.raises(ValueError, match=name):
            graded(spark, tmp_path, [{"id": "a", "graders": [{"name": name}]}], traces)
