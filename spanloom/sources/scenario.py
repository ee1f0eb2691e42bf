"""Scenarios: cases, graders and aggregation rules as plain objects and as a small table of case specs."""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import short_hash

# The keys of a case's expected block.
EXPECTED = ("contains", "not_contains", "matches", "not_matches", "equals", "equals_json", "json_schema", "similar_to", "min_length", "max_length", "min_words", "max_words")


@dataclass
class Grader:
    name: str
    label: str = ""
    weight: float = 1.0
    required: bool = False
    gate: bool = False
    type: str = "code"
    config: dict = field(default_factory=dict)


@dataclass
class Case:
    id: str
    expect: str = "pass"
    graders: list[Grader] = field(default_factory=list)
    category: str = ""
    stage: str = ""
    tags: list[str] = field(default_factory=list)
    trials: int = 1
    input: dict = field(default_factory=dict)
    threshold: float = 0.7
    required_graders: list[str] = field(default_factory=list)
    short_circuit: str = "disabled"
    leak_markers: list[str] = field(default_factory=list)

    def spec(self) -> str:
        """All that grading depends on, as JSON with sorted keys."""
        keep = {k: v for k, v in self.__dict__.items() if k not in ("id", "trials", "input", "tags", "category", "stage")}
        return json.dumps(keep | {"graders": [g.__dict__ for g in self.graders]}, sort_keys=True)

    def fingerprint(self) -> str:
        return short_hash(self.spec())


@dataclass
class Scenario:
    name: str
    cases: list[Case]

    def select(self, ids=(), categories=(), stages=(), tags=()) -> Scenario:
        """The cases that meet all conditions given; tags: any of them."""
        keep = [c for c in self.cases if (not ids or c.id in ids) and (not categories or c.category in categories) and (not stages or c.stage in stages) and (not tags or set(tags) & set(c.tags))]
        return Scenario(self.name, keep)

    def split(self) -> tuple[Scenario, Scenario]:
        """(the cases that should pass, the negative ones)."""
        return tuple(Scenario(self.name, [c for c in self.cases if (c.expect == "fail") is negative]) for negative in (False, True))

    def as_dict(self) -> dict:
        """The scenario as ``from_dict`` reads it, defaults and sweeps resolved into its cases."""

        def case(c: Case) -> dict:
            own = {k: getattr(c, k) for k in ("id", "expect", "category", "stage", "tags", "trials", "input", "leak_markers") if getattr(c, k)}
            rules = {"pass_threshold": c.threshold, "required_graders": c.required_graders, "short_circuit": c.short_circuit}
            return {**own, "aggregation": rules, "graders": [dict(g.__dict__) for g in c.graders]}

        return {"name": self.name, "cases": [case(c) for c in self.cases]}


def save(scenario: Scenario, path: str) -> None:
    """Write a scenario as YAML that ``load`` reads back to the same cases."""
    import yaml

    Path(path).write_text(yaml.safe_dump(scenario.as_dict(), sort_keys=False, allow_unicode=True), encoding="utf-8")


def coding_suite(name: str, cases: Mapping[str, Mapping], graders: tuple[Mapping, ...] = ({"name": "exit_code_check"},)) -> Scenario:
    """A scenario of coding tasks: ``cases`` by id with prompt and files (path to content); an exit code decides where nothing else does."""
    made = [{"id": i, "input": {"prompt": c.get("prompt", ""), "files": [{"path": p, "content": t} for p, t in (c.get("files") or {}).items()]}, "tags": list(c.get("tags") or []), "graders": list(c.get("graders") or graders)} for i, c in cases.items()]
    return from_dict({"name": name, "cases": made})


def _grader(d: Mapping) -> Grader:
    unknown = set(d) - {"name", "type", "label", "weight", "required", "gate", "creates", "config"}
    if unknown or not d.get("name"):
        raise ValueError(f"not a grader: {dict(d)!r}")
    return Grader(d["name"], d.get("label", ""), float(d.get("weight", 1.0)), bool(d.get("required")), bool(d.get("gate")), d.get("type", "code"), dict(d.get("config") or {}))


def expected_graders(block: Mapping) -> list[Grader]:
    """The graders that an expected block stands for."""
    unknown = set(block) - set(EXPECTED)
    if unknown:
        raise ValueError(f"unknown keys in expected: {sorted(unknown)}")
    out = []
    if "equals" in block:
        out.append(Grader("exact_match", "expected.equals", config={"expected": block["equals"]}))
    if "equals_json" in block:
        out.append(Grader("exact_match", "expected.equals_json", config={"expected_json": block["equals_json"]}))
    if "json_schema" in block:
        out.append(Grader("json_schema", "expected.json_schema", config={"schema": block["json_schema"]}))
    if "similar_to" in block:
        out.append(Grader("rubric", "expected.similar_to", type="model", config={"reference": block["similar_to"]}))
    text = {k: v for k, v in block.items() if k not in ("equals", "equals_json", "json_schema", "similar_to")}
    if text:
        out.append(Grader("expected_text", "expected.text", config={k: [v] if k.endswith(("contains", "matches")) and isinstance(v, str) else v for k, v in text.items()}))
    return out


def _sweep(case: dict, params: Mapping[str, list]) -> list[dict]:
    """A case for each combination of the parameters, keys in order; ids say which."""
    names = sorted(params)
    if not names:
        return [case]
    out = []
    for values in itertools.product(*(params[n] for n in names)):
        given = dict(zip(names, values))
        inputs = dict(case.get("input") or {})
        inputs["params"] = {**(inputs.get("params") or {}), **given}
        out.append({**case, "id": f"{case['id']}__sweep__" + "__".join(f"{k}={v}" for k, v in given.items()), "input": inputs})
    return out


def from_dict(d: Mapping) -> Scenario:
    """Parse a scenario: default graders, then those of the expected block, then a case's own; sweeps expanded."""
    rules, cases = d.get("default_aggregation") or {}, []
    for raw in d.get("cases") or []:
        own = {**rules, **(raw.get("aggregation") or {})}
        for c in _sweep(dict(raw), ((raw.get("sweep") or d.get("sweep") or {}).get("params") or {})):
            graders = [_grader(g) for g in d.get("default_graders") or []] + expected_graders(c.get("expected") or {}) + [_grader(g) for g in c.get("graders") or []]
            markers = list(dict.fromkeys([*(d.get("leak_markers") or []), *(c.get("leak_markers") or [])]))
            cases.append(Case(
                str(c["id"]), c.get("expect", "pass"), graders, c.get("category") or d.get("category") or "", c.get("stage") or "", list(dict.fromkeys([*(d.get("tags") or []), *(c.get("tags") or [])])),
                int(c.get("trials") or (d.get("defaults") or {}).get("trials") or 1), dict(c.get("input") or {}), float(own.get("pass_threshold", 0.7)), list(own.get("required_graders") or []), own.get("short_circuit") or "disabled", markers,
            ))
    twice = {c.id for c in cases if sum(x.id == c.id for x in cases) > 1}
    if twice:
        raise ValueError(f"repeated case ids: {sorted(twice)}")
    return Scenario(d.get("name", ""), cases)


def load(path: str) -> Scenario:
    """A scenario file, YAML or JSON."""
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def load_dir(folder: str) -> list[Scenario]:
    """All scenario files below a folder, those whose names begin with an underscore left out."""
    return [load(str(p)) for p in sorted(Path(folder).rglob("*.y*ml")) if not p.name.startswith("_")]


def case_specs(spark: SparkSession, scenario: Scenario) -> DataFrame:
    """(case_id, expect, category, stage, tags, trials, fingerprint): one row per case of a scenario."""
    rows = [(c.id, c.expect, c.category, c.stage, c.tags, c.trials, c.fingerprint()) for c in scenario.cases]
    return spark.createDataFrame(rows, "case_id string, expect string, category string, stage string, tags array<string>, trials int, fingerprint string")


def model_variants(scenarios: list[Scenario], models: list[str]) -> list[tuple[str, Scenario]]:
    """(label, scenario) of each scenario with each model."""
    return [(f"{s.name}:{m}" if len(scenarios) > 1 else m, s) for s in scenarios for m in models]
