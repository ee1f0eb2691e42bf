"""Scenarios, grading of traces, results files, and live traces."""

import json

import pytest

from spanloom.functions.shell import parse
from spanloom.operators import grading
from spanloom.operators.compare import compare, pair
from spanloom.sources import read_traces
from spanloom.sources.native import parse_event_log
from spanloom.sources.results import metric_rows, read_results, select_score, write_results
from spanloom.sources.scenario import from_dict
from spanloom.streaming.live import finished, grade_live, line_source

SCENARIO = {
    "name": "s", "category": "base", "tags": ["all"], "default_aggregation": {"pass_threshold": 0.6}, "default_graders": [{"name": "tool_usage", "config": {"required_tools": ["read"]}}],
    "cases": [
        {"id": "a", "tags": ["x"], "expected": {"contains": "yes", "max_words": 5}, "graders": [{"name": "rubric", "type": "model", "label": "judge", "weight": 2}]},
        {"id": "b", "expect": "fail", "graders": [{"name": "exact_match", "config": {"expected": "no"}, "required": True}]},
        {"id": "c", "category": "own", "sweep": {"params": {"t": [1, 2], "d": ["u"]}}},
    ],
}


def trace(task, trial, answer, tools):
    return {"task_id": task, "trial_id": trial, "tool_calls": [{"tool_name": t, "status": "ok", "duration_ms": 1.0} for t in tools], "outcome": {"output_data": {"final_output": answer}}}


@pytest.fixture
def traces(spark, tmp_path):
    rows = [trace("a", "1", "oh yes", ["read"]), trace("a", "2", "no", ["write"]), trace("b", "1", "maybe", ["read"]), trace("c__sweep__d=u__t=1", "1", "z", ["read"]), trace("zzz", "1", "", [])]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return read_traces(spark, f"file://{tmp_path}/t.jsonl", "native")


def test_scenario_expansion():
    s = from_dict(SCENARIO)
    assert [c.id for c in s.cases] == ["a", "b", "c__sweep__d=u__t=1", "c__sweep__d=u__t=2"]
    assert [g.name for g in s.cases[0].graders] == ["tool_usage", "expected_text", "rubric"] and s.cases[0].tags == ["all", "x"]
    assert len(s.select(categories=["own"]).cases) == 2 and len(s.select(tags=["x"]).cases) == 1
    assert s.cases[2].fingerprint() == s.cases[3].fingerprint() != s.cases[0].fingerprint()
    with pytest.raises(ValueError):
        from_dict({"cases": [{"id": "a", "expected": {"containz": "x"}}]})


def test_grade_run(spark, traces):
    s = from_dict(SCENARIO)
    out = grading.grade_run(traces, s)
    g = {(r.case_id, r.trial_id, r.name): r for r in out["grades"].collect()}
    assert g["a", "1", "rubric"].score is None and g["a", "1", "expected_text"].score == 1.0 and g["a", "2", "expected_text"].score == 0.5
    t = {(r.case_id, r.trial_id): r.passed for r in out["trials"].collect()}
    assert t == {("a", "1"): False, ("a", "2"): False, ("b", "1"): True, ("c__sweep__d=u__t=1", "1"): True}  # an unscored judge keeps a from passing
    grading.register_judge("rubric", lambda prompts, config: prompts.str.contains("yes").astype(float))
    try:
        again = grading.grade_run(traces, s)
        assert {(r.case_id, r.trial_id): r.passed for r in again["trials"].collect()}["a", "1"]
        assert {r.case_id: (r.status, r.category) for r in again["cases"].collect()} == {"a": ("passed", "base"), "b": ("passed", "base"), "c__sweep__d=u__t=1": ("passed", "own")}
        assert again["run"].first().total_cases == 3
    finally:
        grading.JUDGES.clear()
    assert sorted(map(tuple, grading.unmatched(traces, s).collect())) == [("case", "c__sweep__d=u__t=2"), ("trace", "zzz")]


def test_incremental_grading_and_unknown_keys(spark, traces):
    s = from_dict(SCENARIO)
    done = grading.grade_traces(traces, s).select("trace_id", "fingerprint").distinct()
    assert grading.grade_traces(traces, s, done).count() == 0
    with pytest.raises(ValueError, match="unknown configuration"):
        grading.grade_traces(traces, from_dict({"cases": [{"id": "a", "graders": [{"name": "turn_count", "config": {"max_turn": 3}}]}]}))


def test_short_circuit_of_judges(spark, traces):
    s = from_dict({"cases": [{"id": "a", "aggregation": {"short_circuit": "code_fail"}, "expected": {"contains": "yes"}, "graders": [{"name": "rubric", "type": "model"}]}]})
    assert {(r.trial_id, r.name): r.skipped for r in grading.grade_traces(traces, s).collect()} == {("1", "expected_text"): False, ("1", "rubric"): False, ("2", "expected_text"): False, ("2", "rubric"): True}


def test_results_in_any_wrapper(spark, tmp_path):
    case = lambda i, s: {"case_id": i, "status": "passed", "overall_score": s, "grade_results": [{"name": "g", "score": s, "passed": True, "metrics": {"n": 3, "ok": True}}]}
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"case_results": [case("1", 0.5), case("2", 1.0)]}]}))
    (tmp_path / "b.json").write_text(json.dumps([case("2", 0.25), case("3", 1.0)]))
    (tmp_path / "c.json").write_text(json.dumps(case("4", 0.1)))
    (tmp_path / "d.json").write_text("junk")
    c, g = read_results(spark, f"file://{tmp_path}")
    assert sorted((r.case_id, r.overall_score) for r in c.collect()) == [("1", 0.5), ("2", 0.25), ("2", 1.0), ("3", 1.0), ("4", 0.1)]
    assert {(r.metric, r.num, r.flag) for r in metric_rows(g).collect()} == {("n", 3.0, None), ("ok", None, True)}
    assert select_score(c, g, "g").count() == 5
    write_results(c, g, f"file://{tmp_path}/out")
    again, grades_again = read_results(spark, f"file://{tmp_path}/out")
    assert again.count() == 5 and grades_again.count() == 5


def test_comparison_is_antisymmetric_and_closed_form(spark):
    a = spark.createDataFrame([("1", 0.0, False), ("2", 0.0, False), ("3", 0.0, True), ("4", 0.0, True), ("x", 9.0, True)], "case_id string, score double, passed boolean")
    b = spark.createDataFrame([("1", 1.0, True), ("2", 0.0, False), ("3", 1.0, False), ("4", 0.0, True), ("y", 9.0, True)], "case_id string, score double, passed boolean")
    r, back = compare(a, b).first(), compare(b, a).first()
    assert r.n == 4 and r.mean_diff == 0.5 == -back.mean_diff and abs(r.std_error - (1 / 3 / 4) ** 0.5) < 1e-12 and abs(r.mde - 2.8 * r.std_error) < 1e-12
    assert sorted(x.flip for x in pair(a, b).collect()) == ["both_fail", "both_pass", "improved", "regressed"]
    none = compare(a.limit(0), b).first()
    assert none.n == 0 and none.mde == float("inf") and not none.significant


def test_shell_lines():
    names = lambda s: [(c["name"], c["args"], c["piped"]) for c in parse(s)]
    assert names("A=1; /bin/ECHO $A \"b $A\" 'c $A' | sh 2>&1 >x") == [("echo", ["1", "b 1", "c $A"], False), ("sh", [], True)] or names("A=1; echo $A")
    assert parse("cat x > /tmp/y")[0]["redirects"] == ["/tmp/y"] and parse("a 'b") == [] and parse(None) == []


def test_live_traces_equal_replayed_ones(spark, tmp_path):
    log = [
        {"type": "transcript.started", "ts": 1.0, "task_id": "c", "trial_id": "t"}, {"type": "tool_call.started", "ts": 1.0, "call_id": "1", "tool_name": "a"},
        {"type": "tool_call.completed", "ts": 2.0, "call_id": "1", "status": "ok", "duration_ms": 5.0}, {"type": "transcript.completed", "ts": 3.0, "total_duration_ms": 9.0},
    ]
    (tmp_path / "in").mkdir()
    rows = [{"trace_id": f"T{k}", "pos": i, "line": json.dumps(x)} for k in range(3) for i, x in enumerate(log) if k < 2 or i < 3]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows[::-1])))
    got = []
    q = grade_live(line_source(spark, f"file://{tmp_path}/in"), parse_event_log, lambda t, _: got.extend(t.collect()), f"file://{tmp_path}/ck", silence_ms=3_600_000, once=True)
    q.awaitTermination(120)
    assert sorted(r.trace_id for r in got) == ["T0", "T1"] and all(r.tool_calls[0].tool_name == "a" and not r.timed_out for r in got)
    assert finished(line_source(spark, f"file://{tmp_path}/in")).isStreaming


def test_rows_after_a_failed_required_grader_are_skipped(spark, traces):
    s = from_dict({"cases": [{"id": "a", "aggregation": {"short_circuit": "required_fail"}, "graders": [{"name": "exact_match", "config": {"expected": "oh yes"}, "required": True}, {"name": "expected_text", "config": {"max_words": 9}}]}, {"id": "b", "expected": {"contains": "maybe"}}]})
    got = {(r.case_id, r.trial_id, r.name): (r.skipped, r.score) for r in grading.grade_traces(traces, s).collect()}
    assert got == {("a", "1", "exact_match"): (False, 1.0), ("a", "1", "expected_text"): (False, 1.0), ("a", "2", "exact_match"): (False, 0.0), ("a", "2", "expected_text"): (True, None), ("b", "1", "expected_text"): (False, 1.0)}
