"""Spans and steps are joined by sorting and merging: no reader gathers them at the driver for a broadcast."""

import json

import pytest

from spanloom.sources import agents, files, openai_agents, otlp

SPANS = [
    {"object": "trace.span", "trace_id": "t", "id": "boss", "span_data": {"type": "agent", "name": "b"}},
    {"object": "trace.span", "trace_id": "t", "id": "x", "parent_id": "boss", "span_data": {"type": "function", "name": "f"}},
]
OTLP = {"spans": [{"traceId": "t", "spanId": "a", "name": "b", "attributes": {"openinference.span.kind": "AGENT"}}, {"traceId": "t", "spanId": "x", "parentSpanId": "a", "name": "f", "attributes": {"openinference.span.kind": "TOOL"}}]}
STEP = {"step_id": 1, "source": "agent", "message": "m", "tool_calls": [{"tool_call_id": "c", "function_name": "f", "arguments": {}}], "observation": {"results": [{"source_call_id": "c", "content": "r"}]}}
ATIF = {"schema_version": "ATIF-v1.4", "session_id": "t", "agent": {"name": "b"}, "steps": [STEP]}
FORMATS = {
    "openai_agents": (openai_agents.parse_openai_agents, "\n".join(json.dumps(s) for s in SPANS)),
    "otlp": (otlp.parse_otlp, json.dumps(OTLP)),
    "atif": (agents.parse_atif, json.dumps(ATIF)),
}


@pytest.mark.parametrize("name", FORMATS)
def test_no_broadcast(spark, tmp_path, name):
    parse, text = FORMATS[name]
    spark.createDataFrame([("file", text)], "file string, content string").write.parquet(f"{tmp_path}/made")
    d = parse(files.json_values(spark.read.parquet(f"{tmp_path}/made")))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    (t,) = d.collect()
    assert [c.tool_name for c in t.tool_calls] == (["llm.generation", "f"] if name == "atif" else ["f"])
    assert t.tool_calls[-1].agent_name == (None if name == "atif" else "b")
