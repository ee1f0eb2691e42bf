"""Offline grading: traces and a scenario to grades, trials, cases and a run.

Graders are registered factories of columns over a trace row (answer, tool_calls, ...).  All plans
are columns of one projection.  Judges are callables on Arrow batches; without one their grade is unscored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scenario import Case, Grader, Scenario, case_specs
from . import checkers, coding_graders as code, content_graders as content, image_graders as image, judges, process_graders as process, rollup, safety_graders as safety
from .lookups import bounded

#: name -> (scope, factory of a struct column (score, passed, ...) from a config)
GRADERS: dict[str, tuple[str, Callable[[Mapping], Column]]] = {}
JUDGES: dict[str, Callable[[pd.Series, Mapping], pd.Series]] = {}


def register_grader(name: str, scope: str = "outcome"):
    """Register a factory ``config -> Column`` under a name."""

    def put(f: Callable[[Mapping], Column]):
        GRADERS[name] = (scope, f)
        return f

    return put


def register_judge(name: str, f: Callable[[pd.Series, Mapping], pd.Series]) -> None:
    """Register a judge: (prompts, config) to scores from 0 to 1, null where it can't tell."""
    JUDGES[name] = f


def _only(config: Mapping, **names: str) -> dict:
    """Arguments from a config; a key that a grader doesn't know is an error."""
    unknown = set(config) - set(names)
    if unknown:
        raise ValueError(f"unknown configuration keys: {sorted(unknown)}")
    return {names[k]: v for k, v in config.items()}


def _named(*keys: str, **renamed: str) -> dict[str, str]:
    return {k: k for k in keys} | renamed


calls, answer = (lambda: F.col("tool_calls")), (lambda: F.col("answer"))

register_grader("tool_usage", "transcript")(lambda c: process.tool_usage(calls(), **_only(c, required_tools="required", forbidden_tools="forbidden", max_tool_calls="max_calls", max_retries="max_retries")))
register_grader("cost_budget", "transcript")(lambda c: process.cost_budget(calls(), **_only(c, max_cost_usd="max_usd", max_tokens="max_tokens", cost_per_tool="price", count_cached_tokens="count_cached")))
register_grader("latency_budget", "transcript")(lambda c: process.latency_budget(calls(), F.col("duration_ms"), **_only(c, max_total_ms="max_total_ms", max_per_tool_ms="max_call_ms")))
register_grader("efficiency", "both")(lambda c: process.efficiency(calls(), F.coalesce(F.length(answer()) > 0, F.lit(False)), **_only(c, expected_tool_count="expected_calls")))
register_grader("loop_detection", "transcript")(lambda c: process.loop_detection(calls(), **_only(c, max_single_tool_calls="max_single", max_exact_repetitions="max_exact", max_sequence_repeats="max_sequence", ignore_tools="ignore", check_output_repetition="check_output", include_llm_calls="include_llm")))
register_grader("turn_count", "transcript")(lambda c: process.turn_count(calls(), **_only(c, **_named("max_turns", "min_turns", "scoring", "count", "threshold"))))
register_grader("state_delta", "transcript")(lambda c: process.state_delta(calls(), **_only(c, **_named("readonly", "forbid", "require", "max_changes"))))
register_grader("self_correction", "both")(lambda c: process.self_correction(calls(), **_only(c, **_named("max_retries", "require_recovery"))))
register_grader("leak_detection", "transcript")(lambda c: process.leaks(transcript_text(), _markers(c), **_only(_without(c, "markers", "leak_patterns"), invalidate="invalidate")))
register_grader("dangerous_operations", "transcript")(lambda c: safety.dangerous_calls(calls(), **_only(c, min_severity="fail_at", max_operations="allowed", allow="allow", categories="categories", count_attempts="attempts")))
register_grader("skill_trigger", "transcript")(lambda c: safety.skill_loaded(calls(), **_only(c, skill="skill", should_trigger="should_trigger", acceptable_skills="acceptable", required_resources="resources")))
register_grader("exact_match")(lambda c: _exact(c))
register_grader("expected_text")(lambda c: content.expected_block(answer(), **c))
register_grader("json_schema")(lambda c: content.json_schema(content_json(), **_only(c, **_named("schema", "strict", "threshold", "allow_additional"))))
register_grader("structure_check")(lambda c: content.structure(answer(), **_only(c, format="fmt", required_keys="required", required_elements="elements", schema="schema", extract_from_text="extract")))
register_grader("style_convention")(lambda c: content.style(answer(), **_only(c, **_named("max_words", "min_words", "max_lines", "required_phrases", "forbidden_phrases", "required_sections", "markdown", "min_lines", "min_length", "max_length", "section_order", "case_sensitive", "required_patterns", "forbidden_patterns", "markdown_checks", "naming_conventions"))))
register_grader("sql_syntax")(lambda c: content.sql_syntax(_sql(), **_only(c, allowed_statements="allowed", forbidden_keywords="forbidden")))
register_grader("query_quality")(lambda c: content.query_quality(_sql(), **_only(c, severity_weights="weights", threshold="threshold")))
register_grader("reasoning_trace", "both")(lambda c: content.reasoning_trace(F.concat_ws("\n", answer(), F.array_join(F.coalesce("reasoning", F.array().cast("array<string>")), "\n")), **_only(c, **_named("indicators", "threshold"))))
register_grader("external_checker", "both")(lambda c: checkers.external_checker(F.to_json(F.struct("trace_id", "task_id", "trial_id", "prompt", "answer", "tool_calls", "reasoning", "metadata")), c))
register_grader("exit_code_check")(lambda c: code.exit_code(_meta("execution.exit_code").try_cast("int"), **_only(c, expected="expected")))
register_grader("test_runner")(lambda c: code.output_patterns(_meta("execution.stdout"), **_only(c, pass_patterns="must", fail_patterns="must_not")))
register_grader("integration_test")(lambda c: _unleaked(code.integration_test(_meta("execution.stdout"), _meta("execution.exit_code").try_cast("int"), **_only(_without(c, "leak_patterns"), threshold="threshold")), _markers(c)))
register_grader("lint")(lambda c: code.lint(_meta("lint.stdout"), **_only(c, max_errors="max_errors")))
register_grader("type_check")(lambda c: code.type_check(_meta("types.stdout"), **_only(c, max_errors="max_errors")))
register_grader("security_scan")(lambda c: code.security_scan(answer(), _meta("bandit"), **_only(c, severity_threshold="fail_at", blocked_patterns="blocked")))
register_grader("diff_size")(lambda c: code.diff_size(_meta("diff"), **_only(c, max_lines_added="max_added", max_lines_removed="max_removed", max_total_changes="max_total")))
register_grader("semantic_match")(lambda c: content.semantic_match(_vector("embedding"), _vector("reference_embedding"), **_only(c, threshold="threshold")))
register_grader("aesthetic_score")(lambda c: image.aesthetic_score(_meta("aesthetic").try_cast("double"), **_only(c, max_score="top", min_score="least")))
register_grader("safety_check")(lambda c: image.safety_check(_from_meta("safety", "map<string,double>"), c.get("thresholds") or {"nsfw": 0.5}, _meta("blocked").try_cast("boolean"), bool(c.get("expect_blocked"))))
register_grader("human_review")(lambda c: image.human_review(_from_meta("review", "map<string,double>"), c.get("criteria") or ["overall"], *c.get("scale", (1.0, 5.0))))
register_grader("pairwise_comparison")(lambda c: image.pairwise_comparison(_meta("preference"), _meta("confidence").try_cast("double"), **_only(c, expected="expected")))
for _name, _make in (("image_assertions", image.image_assertions), ("technical_quality", image.technical_quality)):
    register_grader(_name)(lambda c, make=_make: make(F.unbase64(_meta("image_base64")), **c))
for _name, _make in (("edit_locality", image.edit_locality), ("edit_preservation", image.edit_preservation)):
    register_grader(_name)(lambda c, make=_make: make(F.unbase64(_meta("original_base64")), F.unbase64(_meta("image_base64")), **c))


def _without(config: Mapping, *names: str) -> dict:
    return {k: v for k, v in config.items() if k not in names}


def _markers(config: Mapping) -> list[str]:
    return list(dict.fromkeys([*(config.get("leak_patterns") or ()), *(config.get("markers") or ())]))


def _unleaked(graded: Column, markers: list[str]) -> Column:
    """The grade, or 0 where the transcript holds a marker."""
    if not markers:
        return graded
    clean = process.leaks(transcript_text(), markers)["passed"]
    return F.struct(F.when(clean, graded["score"]).otherwise(0.0).alias("score"), (clean & graded["passed"]).alias("passed"))


def _from_meta(path: str, kind: str) -> Column:
    return F.from_json(_meta(path), kind)


def _vector(path: str) -> Column:
    return _from_meta(path, "array<double>")


def _meta(path: str) -> Column:
    return F.get_json_object("metadata", f"$.{path}")


def _sql() -> Column:
    from ..functions.scalars import sql_in_text

    return F.coalesce(sql_in_text(answer()), answer())


def content_json() -> Column:
    from ..functions.scalars import json_in_text

    return json_in_text(answer())


def transcript_text() -> Column:
    """All that a trace's calls and reasoning say, for substring search."""
    parts = F.transform("tool_calls", lambda c: F.concat_ws(" ", c["input"], c["output"]))
    return F.concat_ws("\n", F.array_join(parts, "\n"), F.array_join(F.coalesce("reasoning", F.array().cast("array<string>")), "\n"))


def _exact(c: Mapping) -> Column:
    if ("expected" in c) == ("expected_json" in c):
        return unscored()
    as_json = "expected_json" in c
    want = c["expected_json"] if as_json else c["expected"]
    text = want if isinstance(want, str) and not as_json else json.dumps(want)
    return content.exact_match(answer(), F.lit(text), fold=bool(c.get("ignore_case")), as_json=as_json)


def unscored() -> Column:
    return F.struct(F.lit(None).cast("double").alias("score"), F.lit(False).alias("passed"), F.lit(None).cast("string").alias("error"))


def _judge(g: Grader) -> Column:
    """A judge's verdict on the answer and the evidence; unscored where none is registered or it fails."""
    ask = JUDGES.get(g.name)
    if ask is None:
        if g.name not in judges.CRITERIA and not g.config.get("criteria"):
            return unscored()
        return judges.judged(g.name, g.config, answer(), calls(), F.col("reasoning"), F.col("prompt"))
    config, threshold = dict(g.config), float(g.config.get("threshold", 0.7))

    @F.pandas_udf("score double, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"score": pd.Series(ask(prompts, config), dtype="float64", index=prompts.index), "error": None})
        except Exception as e:  # a judge that fails measures nothing, and its grades say why
            return pd.DataFrame({"score": pd.Series([None] * len(prompts), dtype="float64"), "error": f"{type(e).__name__}: {e}"[:500]})

    asked = run(F.concat_ws("\n\n", answer(), evidence()))
    # the judge's answer is bound once, so it isn't asked for each field
    return F.transform(F.array(asked), lambda x: F.struct(x["score"].alias("score"), F.coalesce(x["score"] >= threshold, F.lit(False)).alias("passed"), x["error"].alias("error")))[0]


def evidence(limit: int = 40) -> Column:
    """Numbered calls with their outputs, errors and empty results marked, for a judge to read."""
    from ..functions.scalars import compact, is_empty_result

    shown = F.filter(F.col("tool_calls"), lambda c: ~c["tool_name"].startswith("llm."))
    line = F.transform(F.slice(shown, 1, limit), lambda c, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), c["tool_name"], F.when(c["status"] == "error", " [ERROR]").otherwise(""), F.when(is_empty_result(c["output"]), " [EMPTY RESULT]").otherwise(F.concat(F.lit(" -> "), compact(c["output"]))),
    ))
    more = F.size(shown) - limit
    return F.concat(F.array_join(line, "\n"), F.when(more > 0, F.concat(F.lit("\n("), more.cast("string"), F.lit(" more)"))).otherwise(""))


#: The graders that look for a case's own leak markers.
LEAK_GRADERS = ("leak_detection", "integration_test")


def grade_column(g: Grader, leak_markers: Sequence[str] = ()) -> tuple[str, Column]:
    """(scope, struct column) of a grader; a code grader that nobody registered is an error."""
    if g.type == "model":
        return {"trajectory_judge": "transcript", "groundedness": "both"}.get(g.name, "outcome"), _judge(g)
    if g.name not in GRADERS:
        raise ValueError(f"no grader of the name {g.name!r} is registered")
    scope, make = GRADERS[g.name]
    if g.name in LEAK_GRADERS:
        return scope, make({**g.config, "leak_patterns": [*leak_markers, *(g.config.get("leak_patterns") or ())]})
    return scope, make(g.config)


def _plan(case: Case) -> Column:
    """All grades of a case as an array of structs, in the order they run: code graders, then judges."""
    out = []
    ordered = sorted(case.graders, key=lambda g: g.type == "model")
    for pos, g in enumerate(ordered):
        scope, graded = grade_column(g, case.leak_markers)
        out.append(F.struct(
            F.lit(pos).alias("pos"), F.lit(g.name).alias("name"), F.lit(g.label).alias("label"), F.lit(scope).alias("grader_scope"), F.lit(g.type).alias("grader_type"), F.lit(g.weight).alias("weight"), F.lit(g.required).alias("required"),
            F.lit(g.gate).alias("gate"), F.lit(False).alias("skipped"), graded["score"].alias("score"), F.coalesce(graded["passed"], F.lit(False)).alias("passed"),
            (graded["error"] if g.type == "model" else F.lit(None).cast("string")).alias("error"),
        ))
    return F.array(*out)


def grade_traces(traces: DataFrame, scenario: Scenario, done: DataFrame | None = None) -> DataFrame:
    """Grades of every trace whose task is a case, all plans in one pass: cases of one fingerprint share a plan.

    Lossy traces are left out where a grader needs the outcome.  Of ``done(trace_id, fingerprint)`` traces graded
    under the same fingerprint are skipped.
    """
    specs = case_specs(traces.sparkSession, scenario).select("case_id", "fingerprint", "expect")
    d = traces.join(bounded(specs), traces["task_id"] == specs["case_id"])
    if done is not None:
        d = d.join(done.select("trace_id", "fingerprint"), ["trace_id", "fingerprint"], "left_anti")
    plans = {c.fingerprint(): c for c in scenario.cases if c.graders}
    if not plans:
        raise ValueError("no case has a grader")
    chosen, mode = [], []
    for fp, case in plans.items():
        mine = F.col("fingerprint") == fp
        mode.append(F.when(mine, F.lit(case.short_circuit)))
        if any(grade_column(g)[0] in ("outcome", "both") for g in case.graders):
            mine = mine & F.col("supports_outcome")
        chosen.append(F.when(mine, _plan(case)))
    keys = ("trace_id", "case_id", "trial_id", "expect", "fingerprint")
    out = d.select(*keys, F.coalesce(*mode).alias("mode"), F.explode(F.coalesce(*chosen)).alias("g")).select(*keys, "mode", "g.*")
    return _short_circuited(out, {c.short_circuit for c in plans.values()}).drop("mode")


def _short_circuited(grades: DataFrame, modes: set[str]) -> DataFrame:
    """Skip what a trace's mode says: rows after a failed required one, or judges where code graders decided."""
    skip = F.lit(False)
    if "required_fail" in modes:
        before = Window.partitionBy("trace_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        failed = F.max((F.col("required") & ~F.col("passed")).cast("int")).over(before)
        skip = skip | ((F.col("mode") == "required_fail") & (F.coalesce(failed, F.lit(0)) == 1))
    if modes & {"code_fail", "code_pass"}:
        whole, is_code = Window.partitionBy("trace_id"), F.col("grader_type") == "code"
        ok, n = F.min(F.when(is_code, F.col("passed").cast("int"))).over(whole), F.count(F.when(is_code, 1)).over(whole)
        skip = skip | (~is_code & (n > 0) & (((F.col("mode") == "code_fail") & (ok == 0)) | ((F.col("mode") == "code_pass") & (ok == 1))))
    if modes <= {"disabled"}:
        return grades
    return grades.withColumn("_skip", F.coalesce(skip, F.lit(False))).withColumns({"skipped": F.col("skipped") | F.col("_skip"), "score": F.when(~F.col("_skip"), F.col("score"))}).drop("_skip")


def trials(grades: DataFrame, scenario: Scenario, traces: DataFrame) -> DataFrame:
    """Trial rows: score and verdict of each graded trace, negative cases turned round.

    An agent that was blocked has passed a negative case; a trace that names an error counts as one that went wrong.
    """
    out = None
    for threshold, required in {(c.threshold, tuple(c.required_graders)) for c in scenario.cases}:
        fps = [c.fingerprint() for c in scenario.cases if (c.threshold, tuple(c.required_graders)) == (threshold, required)]
        part = rollup.grade_rollup(grades.where(F.col("fingerprint").isin(fps)), threshold, required, ("trace_id", "case_id", "trial_id", "expect"))
        out = part if out is None else out.unionByName(part)
    told = traces.select("trace_id", "duration_ms", F.coalesce("blocked", F.lit(False)).alias("blocked"), "error")
    t = rollup.invert_negative(out.join(told, "trace_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("trial_id", "trace_id"))
    wrong = F.col("error").isNotNull()
    return t.withColumns({"trial_number": number, "passed": F.when(wrong, False).otherwise(F.col("passed")), "score": F.when(~wrong, F.col("score"))})


def grade_run(traces: DataFrame, scenario: Scenario) -> dict[str, DataFrame]:
    """grades, trials, cases and the run's row."""
    g = grade_traces(traces, scenario)
    t = trials(g, scenario, traces)
    c = rollup.case_rollup(t).join(bounded(case_specs(traces.sparkSession, scenario).select("case_id", "category", "tags")), "case_id", "left")
    return {"grades": g, "trials": t, "cases": c, "run": rollup.run_rollup(c)}


def unmatched(traces: DataFrame, scenario: Scenario) -> DataFrame:
    """(side, case_id): tasks that are no case, and cases without a trace."""
    specs = case_specs(traces.sparkSession, scenario).select("case_id")
    tasks = traces.select(F.col("task_id").alias("case_id")).distinct()
    return tasks.join(bounded(specs), "case_id", "left_anti").select(F.lit("trace").alias("side"), "case_id").unionByName(specs.join(tasks, "case_id", "left_anti").select(F.lit("case").alias("side"), "case_id"))
