"""Judges with criteria: what a model is shown, and how its structured answer becomes a grade.

The model itself is a callable ``ask(prompts, schema) -> answers`` over a batch, an answer being a mapping (or JSON)
with criteria_scores, tags and overall_reasoning.  Without one, or where it fails, a grade is unscored and says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions.scalars import compact, is_empty_result
from .process_graders import glob_regex

# The criteria of judges that are given none, and how much of a trace they are shown.
CRITERIA = {
    "trajectory_judge": ("plan_soundness", "completeness", "non_redundancy", "tool_choice"),
    "groundedness": ("claim_support", "no_fabrication", "faithful_use"),
    "rubric": (),
    "vlm_judge": ("quality",),
    "edit_correctness": ("instruction_followed",),
}
EVIDENCE = {"max_tool_calls": 40, "max_output_chars": 600, "max_input_chars": 200, "exclude_tools": ["llm.*"], "evidence_tools": []}
TRAJECTORY = {"max_tool_calls": 60, "max_output_chars": 400, "max_input_chars": 300, "max_reasoning_steps": 40, "include_outcome": True, "expected_key_steps": []}
PASS = 0.7

_ASK: dict[str, Callable] = {}


def register_model(name: str, ask: Callable[[Sequence[str], Mapping], Sequence]) -> None:
    """Register the model that judges of a name ask; "*" serves all."""
    _ASK[name] = ask


def criteria_of(name: str, config: Mapping) -> list[dict]:
    """The criteria with weights: the configured ones, else the judge's own."""
    given = config.get("criteria") or [{"name": c} for c in CRITERIA.get(name, ())]
    given = [{"name": c} if isinstance(c, str) else dict(c) for c in given]
    return [{"weight": 1.0, "description": c["name"].replace("_", " "), **c} for c in given]


def answer_schema(criteria: Sequence[Mapping], tags: Sequence[str] = ()) -> dict:
    """The JSON schema of an answer: a score for each criterion, a summary, tags out of a vocabulary."""
    score = {"type": "number", "minimum": 0, "maximum": 1}
    names = [c["name"] for c in criteria]
    return {
        "type": "object", "required": ["criteria_scores", "overall_reasoning"], "properties": {
            "criteria_scores": {"type": "object", "required": names, "additionalProperties": False, "properties": {n: {"type": "object", "properties": {"score": score, "reasoning": {"type": "string"}}} for n in names}},
            "overall_score": score, "overall_reasoning": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string", **({"enum": list(tags)} if tags else {})}},
        },
    }


def _lines(calls: Column, most: int, in_chars: int, out_chars: int) -> Column:
    cut = lambda x, n: F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)
    line = lambda c, i: F.concat_ws(
        "", (i + 1).cast("string"), F.lit(". "), c["tool_name"], F.lit("("), cut(F.coalesce(c["input"], F.lit("")), in_chars), F.lit(")"),
        F.when(c["status"] == "error", F.concat(F.lit(" [ERROR] "), cut(F.coalesce(c["error"], F.lit("")), out_chars))).when(is_empty_result(c["output"]), " [EMPTY RESULT]").otherwise(F.concat(F.lit(" -> "), cut(compact(c["output"]), out_chars))),
    )
    more = F.size(calls) - most
    return F.concat(F.array_join(F.transform(F.slice(calls, 1, most), line), "\n"), F.when(more > 0, F.concat(F.lit("\n("), more.cast("string"), F.lit(" more)"))).otherwise(""))


def evidence_calls(calls: Column, include: Sequence[str] = (), exclude: Sequence[str] = ("llm.*",)) -> Column:
    """The calls that count as evidence, by shell-style patterns of their names."""
    out = calls
    if include:
        out = F.filter(out, lambda c: c["tool_name"].rlike("|".join(map(glob_regex, include))))
    if exclude:
        out = F.filter(out, lambda c: ~c["tool_name"].rlike("|".join(map(glob_regex, exclude))))
    return out


def content(name: str, config: Mapping, answer: Column, calls: Column, reasoning: Column) -> Column:
    """What a judge is shown: the answer, the answer with evidence, or how the agent worked."""
    if name == "groundedness":
        c = EVIDENCE | {k: config[k] for k in EVIDENCE if k in config}
        seen = _lines(evidence_calls(calls, c["evidence_tools"], c["exclude_tools"]), c["max_tool_calls"], c["max_input_chars"], c["max_output_chars"])
        return F.when(answer.isNotNull(), F.concat(F.lit("ANSWER\n"), answer, F.lit("\n\nEVIDENCE\n"), seen))
    if name == "trajectory_judge":
        c = TRAJECTORY | {k: config[k] for k in TRAJECTORY if k in config}
        steps = F.array_join(F.slice(F.coalesce(reasoning, F.array().cast("array<string>")), 1, c["max_reasoning_steps"]), "\n")
        parts = [F.lit("CALLS\n"), _lines(calls, c["max_tool_calls"], c["max_input_chars"], c["max_output_chars"]), F.lit("\n\nREASONING\n"), steps]
        if c["expected_key_steps"]:
            parts += [F.lit("\n\nEXPECTED STEPS\n" + "\n".join(f"- {s}" for s in c["expected_key_steps"]))]
        if c["include_outcome"]:
            parts += [F.lit("\n\nOUTCOME\n"), F.coalesce(answer, F.lit(""))]
        return F.when((F.size(calls) > 0) | (F.length(steps) > 0), F.concat(*parts))
    return answer


def prompt(name: str, config: Mapping, shown: Column, task: Column) -> Column:
    """The question: criteria with weights and guidance, the task, and what is to be judged."""
    rules = "\n".join(
        f"- {c['name']} (weight {c['weight']}): {c['description']}" + ("".join(f"; {k}: {v}" for k, v in (c.get("score_guidance") or {}).items())) for c in criteria_of(name, config)
    )
    about = config.get("context_template")
    context = F.replace(F.lit(about), F.lit("{prompt}"), F.coalesce(task, F.lit(""))) if about else F.coalesce(F.concat(F.lit("Task: "), task), F.lit("No task given."))
    head = f"{config.get('role') or 'Judge the content below by each criterion on its own, from 0 (fails) to 1 (meets it fully).'}\n\nCRITERIA\n{rules}\n\nCONTEXT\n"
    return F.concat(F.lit(head), context, F.lit("\n\nCONTENT\n"), shown, F.lit("\n\nAnswer with JSON of the given schema."))


def verdict(answer, criteria: Sequence[Mapping], tags: Sequence[str] = ()) -> dict:
    """A structured answer as (score, tags, reasoning): the weighted mean, 0 for a criterion it leaves out."""
    data = json.loads(answer) if isinstance(answer, str) else dict(answer)
    scores = data.get("criteria_scores") or {}

    def one(c: Mapping) -> float:
        got = scores.get(c["name"])
        got = got.get("score") if isinstance(got, Mapping) else got
        return min(1.0, max(0.0, float(got))) if isinstance(got, int | float) else 0.0

    total = sum(float(c["weight"]) for c in criteria)
    score = data.get("overall_score") if not scores else sum(one(c) * float(c["weight"]) for c in criteria) / total if total > 0 else None
    return {"score": None if score is None else float(score), "tags": [t for t in data.get("tags") or [] if t in tags], "reasoning": data.get("overall_reasoning"), "error": None}


_RESULT = "score double, tags array<string>, reasoning string, error string"


def judged(name: str, config: Mapping, answer: Column, calls: Column, reasoning: Column, task: Column) -> Column:
    """The grade of a judge: (score, passed, tags, reasoning, error)."""
    criteria, tags = criteria_of(name, config), list(config.get("allowed_tags") or config.get("tags") or ())
    least, schema = float(config.get("pass_threshold", config.get("threshold", PASS))), answer_schema(criteria, config.get("allowed_tags") or config.get("tags") or ())
    ask = _ASK.get(name) or _ASK.get("*")

    @F.pandas_udf(_RESULT)
    def run(prompts: pd.Series) -> pd.DataFrame:
        none = {"score": None, "tags": [], "reasoning": None}
        shown = [p for p in prompts if p is not None]
        try:
            if not criteria:
                raise ValueError("no criteria")
            if ask is None:
                raise LookupError("no model is registered")
            answers = iter(ask(shown, schema)) if shown else iter(())
        except Exception as e:
            return pd.DataFrame([none | {"error": f"{type(e).__name__}: {e}"[:500]} for _ in prompts])
        rows = []
        for p in prompts:
            if p is None:
                rows.append(none | {"error": "nothing to judge"})
                continue
            try:
                rows.append(verdict(next(answers), criteria, tags))
            except Exception as e:  # one bad answer leaves one grade unscored
                rows.append(none | {"error": f"{type(e).__name__}: {e}"[:500]})
        return pd.DataFrame(rows, columns=["score", "tags", "reasoning", "error"])

    got = run(prompt(name, config, content(name, config, answer, calls, reasoning), task))
    return F.transform(F.array(got), lambda x: F.struct(x["score"].alias("score"), F.coalesce(x["score"] >= least, F.lit(False)).alias("passed"), x["tags"].alias("tags"), x["reasoning"].alias("reasoning"), x["error"].alias("error")))[0]
