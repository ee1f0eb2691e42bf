"""JSON Schema, formats, naming, judges with criteria, programs as graders, row comparison, deep trees."""

import sys
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions.json_schema import errors, is_plain
from spanloom.operators import checkers, content_graders as content, judges
from spanloom.operators.grading import grade_run, grade_traces
from spanloom.operators.lookups import bounded, nearest_ancestor
from spanloom.operators.process_graders import canonical
from spanloom.operators.text_formats import problems, schema_share, structure
from spanloom.schemas import TRACE_FIELDS
from spanloom.sources import agents, files
from spanloom.sources.scenario import Case, Grader, Scenario

ok = lambda value, schema: not list(errors(value, schema))


@pytest.mark.parametrize("schema, good, bad", [
    ({"type": ["string", "null"]}, ["a", None], [1]), ({"type": "integer"}, [1, 2.0], [1.5, True, "1"]), ({"enum": [1, "a", [True]]}, [1.0, "a", [True]], [True, [1]]), ({"const": {"a": 1}}, [{"a": 1}], [{"a": True}]),
    ({"items": {"type": "number"}, "minItems": 1, "uniqueItems": True}, [[1, 2]], [[], [1, 1.0], ["x"]]), ({"items": [{"type": "string"}], "additionalItems": False}, [["a"], []], [["a", 1], [1]]),
    ({"contains": {"minimum": 5}}, [[1, 6], "no array"], [[1, 2]]), ({"properties": {"a": {"type": "string"}}, "additionalProperties": False, "required": ["a"]}, [{"a": "x"}], [{}, {"a": 1}, {"a": "x", "b": 1}]),
    ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, [{"x1": 1, "y": "s"}], [{"x1": "s"}, {"y": 1}]), ({"dependencies": {"a": ["b"]}}, [{"a": 1, "b": 1}, {}], [{"a": 1}]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [1, 2.5], [3, 1.5]), ({"anyOf": [{"type": "string"}, {"minimum": 2}]}, ["a", 2], [1]), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1], [3]), ({"not": {"type": "null"}}, [1], [None]),
    ({"if": {"minimum": 10}, "then": {"multipleOf": 5}, "else": {"const": 1}}, [10, 1], [11, 2]), ({"definitions": {"n": {"type": "object", "properties": {"next": {"$ref": "#/definitions/n"}, "v": {"type": "integer"}}}}, "$ref": "#/definitions/n"}, [{"next": {"next": {"v": 1}}}], [{"next": {"next": {"v": "x"}}}]),
    ({"format": "date"}, ["2024-02-29", 5], ["2023-02-29"]), ({"format": "ipv4"}, ["1.2.3.4"], ["1.2.3.256"]), ({"format": "email"}, ["a@b"], ["a b@c"]), ({"format": "regex"}, ["a+"], ["(("]), ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}], [{"abc": 1}]),
    (False, [], [1]), (True, [1], []), ({"$ref": "#/nowhere"}, [], [1]), ({"minLength": 2, "pattern": "^a"}, ["ab", 7], ["a", "ba"]),
])
def test_schema_rules(schema, good, bad):
    assert all(ok(x, schema) for x in good) and not any(ok(x, schema) for x in bad)


def test_schema_grader_by_columns_and_by_batches(spark):
    d = spark.createDataFrame([('{"a": 1, "b": [1, "x"]}',), ('{"a": "q"}',), ("nope",), (None,)], "t string")
    plain = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}
    full = {**plain, "properties": {**plain["properties"], "b": {"items": {"type": "integer"}}}}
    assert is_plain(plain) and not is_plain(full) and not is_plain({"type": ["a"]})
    rows = d.select(content.json_schema(F.col("t"), plain).alias("p"), content.json_schema(F.col("t"), full, False).alias("f"), content.json_schema(F.col("t"), plain, allow_additional=False).alias("x")).collect()
    assert [r.p.passed for r in rows] == [True, False, False, False] and [round(r.f.score, 3) for r in rows] == [0.667, 0.333, 0.0, 0.0] and [r.x.passed for r in rows] == [False] * 4
    assert schema_share("{}", {"required": ["a"], "properties": {"a": {}, "b": {}}}) == pytest.approx(1 / 3)


def test_formats(spark):
    assert problems("a: 1\nb: [x]", "yaml", ["a", "c"]) == ["key: c"] and problems("x = 1", "toml", ["x"]) == [] and problems("x = ", "toml") == ["parse: TOMLDecodeError"]
    assert problems("<a><b/></a>", "xml", elements=["b", "c"]) == ["element: c"] and problems("<a><b></a>", "xml")[0].startswith("parse") and problems("<!DOCTYPE a><a/>", "xml")[0].startswith("parse")
    assert problems('text ```json\n{"k": 1}\n``` more', "json", ["k"]) == [] and problems("", "json") == ["empty"] and problems('{"k": "s"}', "json", schema={"properties": {"k": {"type": "integer"}}}) == ["schema: $.k type"]
    d = spark.createDataFrame([("a: 1",), (None,)], "t string")
    assert [r[0].passed for r in d.select(structure(F.col("t"), "yaml", ["a"])).collect()] == [True, False]
    with pytest.raises(ValueError):
        structure(F.col("t"), "ini")


def test_style_groups(spark):
    code = "def goodName():\n    pass\ndef _Private(): pass\nMAX_N = 1\nbad_var = 2\nclass Thing: pass\n"
    md = "# A\n\n## B\n- x\n[l](http://a.b) <http://c.d>\n```\ny\n```\n"
    d = spark.createDataFrame([(code, md)], "c string, m string")
    s = lambda col, **k: content.style(F.col(col), **k)["score"]
    r = d.select(
        s("c", naming_conventions={"functions": "camelCase", "variables": "snake_case", "classes": "PascalCase", "constants": "UPPER_SNAKE_CASE"}).alias("a"), s("c", naming_conventions={"functions": "snake_case"}).alias("b"),
        s("m", markdown_checks={"require_code_blocks": True, "max_heading_level": 2, "require_lists": True, "no_bare_urls": True}).alias("c"), s("m", markdown_checks={"max_heading_level": 1}).alias("d"),
        s("m", required_sections=["b", "a"], section_order=True, required_patterns=["^- x$"], forbidden_patterns=["^zz"]).alias("e"), s("m", required_phrases=["X"], case_sensitive=True, min_lines=3, max_length=10).alias("f"),
        content.misnamed(F.col("c"), "functions", "snake_case").alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, round(r.e, 3), r.f, r.g) == (1.0, 0.0, 1.0, 0.0, 0.667, 0.0, ["goodName"])


def traces(spark, rows):
    ddl = ", ".join(f"{k} {t}" for k, t in TRACE_FIELDS.items())
    call = lambda pos, name, status="ok", out="o": tuple({"pos": pos, "tool_name": name, "status": status, "input": '{"a": 1}', "output": out}.get(k) for k in CALL_KEYS)
    return spark.createDataFrame([tuple({"tool_calls": [call(1, "Read"), call(2, "llm.generation"), call(3, "Bash", "error", None)], "supports_outcome": True, "prompt": "do", **r}.get(k) for k in TRACE_FIELDS) for r in rows], ddl)


CALL_KEYS = ["pos", "tool_name", "status", "duration_ms", "ts", "call_id", "input", "output", "error", "cost_usd", "input_tokens", "output_tokens", "tokens", "cached_tokens", "tool_type", "turn_index", "agent_name", "model", "state_delta"]


def test_judges_with_criteria(spark, monkeypatch):
    seen = []

    def ask(prompts, schema):
        assert schema["properties"]["criteria_scores"]["required"]
        return [{"criteria_scores": {"claim_support": {"score": 1}, "no_fabrication": 0.5}, "tags": ["x", "made-up"], "overall_reasoning": "why"} if "good" in p else "not json" for p in prompts]

    monkeypatch.setattr(judges, "_ASK", {"*": ask})
    d = traces(spark, [{"trace_id": "1", "task_id": "c", "trial_id": "1", "answer": "good"}, {"trace_id": "2", "task_id": "c", "trial_id": "2", "answer": "bad"}, {"trace_id": "3", "task_id": "c", "trial_id": "3", "answer": None}])
    got = d.select("trace_id", judges.judged("groundedness", {"allowed_tags": ["x"]}, F.col("answer"), F.col("tool_calls"), F.col("reasoning"), F.col("prompt")).alias("g")).collect()
    g = {r.trace_id: r.g for r in got}
    assert (g["1"].score, g["1"].passed, g["1"].tags, g["1"].reasoning, g["1"].error) == (0.5, False, ["x"], "why", None)  # the criterion left out counts 0
    assert g["2"].score is None and g["2"].error.startswith("JSONDecodeError") and g["3"].error == "nothing to judge"
    shown = d.where("trace_id = '1'").select(judges.content("groundedness", {}, F.col("answer"), F.col("tool_calls"), F.col("reasoning"))).first()[0]
    assert "1. Read" in shown and "llm." not in shown and "[ERROR]" in shown and not seen
    monkeypatch.setattr(judges, "_ASK", {})
    none = d.select(judges.judged("rubric", {"criteria": ["q"]}, F.col("answer"), F.col("tool_calls"), F.col("reasoning"), F.col("prompt")).alias("g")).first().g
    assert none.score is None and "no model" in none.error


def test_programs_as_graders(spark, monkeypatch):
    run = lambda code, **k: checkers.check([sys.executable, "-c", code], "{}", {}, **k)
    assert run("print('{\"score\": 0.25, \"tags\": [\"t\"]}')") == {"score": 0.25, "passed": True, "tags": ["t"], "error": None}
    assert run("import sys; sys.exit(3)")["score"] == 0.0 and run("import os; os.kill(os.getpid(), 9)")["tags"] == ["checker_crashed"]
    assert run("import time; time.sleep(9)", timeout=0.3)["tags"] == ["checker_timeout"] and checkers.check(["/no/such"], "", {})["tags"] == ["checker_missing"]
    assert run("print('{\"unscored\": true}')")["score"] is None
    config = {"command": [sys.executable, "-c", "import json,sys; sys.exit(json.load(sys.stdin)['answer'] != 'good')"]}
    scenario = Scenario(name="s", cases=[Case(id="c", graders=[Grader(name="external_checker", config=config)])])
    d = traces(spark, [{"trace_id": "1", "task_id": "c", "trial_id": "1", "answer": "good"}, {"trace_id": "2", "task_id": "c", "trial_id": "2", "answer": "bad"}])
    with pytest.raises(ValueError, match="external_checker"):
        grade_traces(d, scenario)
    monkeypatch.setattr(checkers, "_ALLOWED", [True])
    assert {r.trace_id: (r.score, r.passed) for r in grade_traces(d, scenario).collect()} == {"1": (1.0, True), "2": (0.0, False)}


def test_blocked_and_failed_traces_reach_trials(spark):
    scenario = Scenario(name="s", cases=[Case(id="c", expect="fail", graders=[Grader(name="exact_match", config={"expected": "no"})])])
    d = traces(spark, [{"trace_id": "1", "task_id": "c", "trial_id": "1", "answer": "no", "blocked": True}, {"trace_id": "2", "task_id": "c", "trial_id": "2", "answer": "no", "error": "lost"}])
    rows = {r.trace_id: r for r in grade_run(d, scenario)["trials"].collect()}
    assert rows["1"].passed and not rows["2"].passed and rows["2"].error == "lost" and rows["1"].error is None


def test_rows_by_rank_are_the_same_at_any_partitioning(spark):
    e = spark.range(50_000).selectExpr("id % 20000 AS k", "CAST(id % 7 AS STRING) AS x")
    a = e.withColumn("x", F.when(F.col("k") % 911 == 0, F.concat(F.lit("z"), "x")).otherwise(F.col("x")))
    want = None
    for parts in (4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            for _ in range(2):
                got = sorted(map(tuple, content.compare_ranked(a.repartition(3), e, ["k"]).collect()))
                assert want in (None, got)
                want = got
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted((str(k), str(k), x) for k, x in ((i % 20000, str(i % 7)) for i in range(50_000)))
    plain = sorted((str(k), str(k), f"z{x}" if k % 911 == 0 else x) for k, x in ((i % 20000, str(i % 7)) for i in range(50_000)))
    assert [r[0] for r in want] == [n + 1 for n, (p, q) in enumerate(zip(plain, order)) if p[2] != q[2]]
    hot = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS v")
    assert content.compare_ranked(hot, hot).count() == 0
    assert {(r.kind, r.row_number) for r in content.compare_ranked(hot.limit(5), hot.limit(7)).where("kind = 'missing'").collect()} == {("missing", 6), ("missing", 7)}


def test_keyed_rows_with_nulls_and_repeats(spark):
    d = spark.createDataFrame([(None, 1), (1, 1), (1, 2), (2, 5)], "k int, x int")
    assert content.compare_keyed(d, d, ["k"]).count() == 0
    last = spark.createDataFrame([(1, 2, 2), (1, 1, 1)], "k int, x int, o int"), spark.createDataFrame([(1, 1, 1), (1, 9, 2)], "k int, x int, o int")
    assert [tuple(r) for r in content.compare_keyed(*last, ["k"], order="o").collect()] == [(1, "x", "mismatch", "2", "9")]


def test_canonical_counts_spaced_json(spark):
    d = spark.createDataFrame([('{"b":"x,:\\"y","a":[1,2]}',), ("plain, text",)], "j string")
    whole = d.select(canonical(F.col("j"), 60).alias("c"), canonical(F.col("j"), 9).alias("s")).collect()
    assert whole[0].c == '{"a": [1, 2], "b": "x,:\\"y"}' and whole[0].s == '{"a": [1,' and whole[1].c == "plain, text"


def test_deep_trees_are_quick(spark):
    n = 600
    rows = [("f", i, f"e{i}", f"e{i - 1}" if i else None) for i in range(n)] + [("f", n, "dead", "e3"), ("f", n + 1, "end", f"e{n - 1}"), ("g", 0, "a", "b"), ("g", 1, "b", "a")]
    began = time.time()
    got = agents.active_branch(spark.createDataFrame(rows, "file string, pos int, id string, parent_id string")).collect()
    assert {r.id for r in got if r.file == "f"} == {f"e{i}" for i in range(n)} | {"end"} and {r.id for r in got if r.file == "g"} == {"a", "b"}
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, i == 0) for i in range(64)], "id string, parent string, hit boolean")
    assert {r.ancestor for r in nearest_ancestor(nodes, F.col("hit")).where("id <> 'n0'").collect()} == {"n0"}
    assert time.time() - began < 90


def test_broadcast_bounds(spark):
    with pytest.raises(ValueError):
        bounded(spark.range(20), 10)
    with pytest.raises(ValueError):
        bounded(spark.createDataFrame([("x" * 2000,)], "t string"), 10, 1000)
    assert bounded(spark.range(3)).count() == 3 and files.detect(F.lit("x")) is not None


def test_scenario_sink_split_and_suite(tmp_path):
    from spanloom.sources.scenario import coding_suite, from_dict, load, save

    s = from_dict({"name": "n", "default_graders": [{"name": "exact_match", "config": {"expected": "é"}}], "cases": [{"id": "a", "tags": ["x"], "trials": 3}, {"id": "b", "expect": "fail", "aggregation": {"pass_threshold": 0.5}, "leak_markers": ["m"]}]})
    save(s, str(tmp_path / "s.yaml"))
    assert load(str(tmp_path / "s.yaml")) == s
    assert [[c.id for c in x.cases] for x in s.split()] == [["a"], ["b"]]
    suite = coding_suite("c", {"t1": {"prompt": "p", "files": {"a.py": "x"}}, "t2": {"graders": [{"name": "lint"}]}})
    assert [c.graders[0].name for c in suite.cases] == ["exit_code_check", "lint"] and suite.cases[0].input["files"] == [{"path": "a.py", "content": "x"}]


def test_yaml_prices(spark, tmp_path):
    from spanloom.sources.store import read_prices

    (tmp_path / "p.yaml").write_text("m:\n  input: 1\n  output: 2.5\nn: {prompt: 3}\n")
    assert sorted(map(tuple, read_prices(spark, f"file://{tmp_path}/p.yaml").collect())) == [("m", 1.0, 2.5, None), ("n", 3.0, None, None)]
