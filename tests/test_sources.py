"""Readers on small hand-made files of every format, and round trips of the native ones."""

import json

import pytest

from spanloom.schemas import explode_calls, explode_state
from spanloom.sources import read_traces
from spanloom.sources.native import read_event_log, read_native, write_event_log, write_native


def put(path, name, text):
    (path / name).write_text(text if isinstance(text, str) else "\n".join(json.dumps(x) for x in text))
    return f"file://{path}"


NATIVE = {
    "protocol_version": "2.0", "task_id": "case1", "trial_id": "t1", "run_id": "r", "input": {"prompt": "do it", "params": {}}, "metadata": {"a": 1},
    "tool_calls": [
        {"call_id": "1", "tool_name": "fs.read", "input": {"p": "x"}, "output": {"ok": 1}, "status": "ok", "duration_ms": 5.0, "timestamp": 1704067200.5, "cost": {"total_usd": 0.5}, "tokens": {"input_tokens": 3, "output_tokens": 4, "total_tokens": 0}},
        {"call_id": "2", "tool": "sh", "args": {"c": "ls"}, "result": "none", "error": "boom", "duration_ms": 1.0, "timestamp": 1704067201.0, "state_delta": [{"kind": "file", "op": "update", "target": "a"}]},
    ],
    "reasoning_steps": ["think"], "outcome": {"output_data": {"final_output": "done"}, "artifacts": []}, "timing": {"start_time": "2024-01-01T00:00:00", "total_duration_ms": 6.0},
}


def test_native_document(spark, tmp_path):
    path = put(tmp_path, "a.json", json.dumps(NATIVE, indent=1))
    put(tmp_path, "checkpoint.json", "{}")
    put(tmp_path, "b.json", json.dumps({"no": "trace"}))
    (t,) = read_traces(spark, path).collect()
    assert (t.task_id, t.trial_id, t.prompt, t.answer, t.reasoning, t.started, t.supports_outcome) == ("case1", "t1", "do it", "done", ["think"], 1704067200.0, True)
    a, b = t.tool_calls
    assert (a.tool_name, a.status, a.tokens, a.cost_usd, json.loads(a.input)) == ("fs.read", "ok", 7, 0.5, {"p": "x"})
    assert (b.tool_name, b.status, b.error, b.output, b.state_delta[0].op) == ("sh", "error", "boom", "none", "update")


def test_native_round_trips(spark, tmp_path):
    path = put(tmp_path, "a.json", json.dumps(NATIVE))
    first = read_native(spark, path).cache()
    write_native(first, f"{path}/out")
    write_event_log(first, f"{path}/log")
    again = read_native(spark, f"{path}/out")
    log = read_traces(spark, f"{path}/log", "event_log", recursive=True)
    calls = lambda d: [tuple(r) for r in explode_calls(d).orderBy("pos").select("pos", "tool_name", "status", "duration_ms", "ts", "call_id", "error", "cost_usd", "tokens").collect()]
    assert calls(again) == calls(first) == calls(log)
    assert [r.supports_outcome for r in log.collect()] == [False]
    assert explode_state(log).count() == explode_state(first).count() == 1


def test_event_log_pairs_calls(spark, tmp_path):
    path = put(tmp_path, "x.jsonl", [
        {"type": "transcript.started", "ts": 1.0, "task_id": "c", "trial_id": "t", "input": {"prompt": "p"}}, {"type": "tool_call.started", "ts": 1.0, "call_id": "1", "tool_name": "old", "input": {"a": 1}},
        {"type": "tool_call.started", "ts": 2.0, "call_id": "1", "tool_name": "new", "input": {"a": 2}}, {"type": "tool_call.completed", "ts": 3.0, "call_id": "1", "tool_name": "new", "status": "ok", "duration_ms": 7.0},
        {"type": "reasoning.step", "index": 1, "step": "b"}, {"type": "reasoning.step", "index": 0, "step": "a"}, {"type": "transcript.completed", "ts": 4.0, "total_duration_ms": 9.0},
    ])
    put(tmp_path, "y.jsonl", [{"type": "tool_call.started"}])
    (t,) = read_event_log(spark, path).collect()
    assert (t.reasoning, t.duration_ms, len(t.tool_calls), t.tool_calls[0].ts, json.loads(t.tool_calls[0].input)) == (["a", "b"], 9.0, 1, 2.0, {"a": 2})


def span(i, parent, name, kind, a, start, end, code=1):
    attrs = [{"key": "openinference.span.kind", "value": {"stringValue": kind}}] + [{"key": k, "value": v} for k, v in a.items()]
    return {"traceId": "T", "spanId": i, "parentSpanId": parent, "name": name, "startTimeUnixNano": str(int(start * 1e9)), "endTimeUnixNano": str(int(end * 1e9)), "attributes": attrs, "status": {"code": code}}


@pytest.mark.parametrize("wrap", [lambda s: {"resourceSpans": [{"scopeSpans": [{"spans": s}]}]}, lambda s: {"spans": s}, lambda s: s])
def test_otlp(spark, tmp_path, wrap):
    text, num = lambda x: {"stringValue": x}, lambda x: {"intValue": str(x)}
    spans = [
        span("a", "", "planner", "AGENT", {"input.value": text("hi"), "input.value2": text("x")}, 1704067200, 1704067210),
        span("b", "a", "gen", "LLM", {"llm.model_name": text("m"), "llm.token_count.prompt": num(10), "llm.token_count.completion": num(5), "output.value": text('{"content": "bye"}')}, 1704067201, 1704067203),
        span("c", "b", "look", "TOOL", {"tool.name": text("search"), "tool.parameters": text('{"q": 1}')}, 1704067204, 1704067205, 2),
        span("d", "a", "find", "RETRIEVER", {"retrieval.documents.10.document.content": text("z"), "retrieval.documents.2.document.content": text("y")}, 1704067206, 1704067207),
        span("e", "a", "chain", "CHAIN", {}, 1704067206, 1704067207),
    ]
    (t,) = read_traces(spark, put(tmp_path, "o.json", json.dumps(wrap(spans)))).collect()
    assert (t.prompt, t.answer, t.duration_ms, t.started) == ("hi", "bye", 10000.0, 1704067200.0)
    assert [(c.tool_name, c.status, c.tokens, c.agent_name, c.duration_ms) for c in t.tool_calls] == [("llm.generation", "ok", 15, "planner", 2000.0), ("search", "error", None, "planner", 1000.0), ("find", "ok", None, "planner", 1000.0)]
    assert json.loads(t.tool_calls[2].output) == {"document_count": 2, "documents": ["y", "z"]}


def test_pi_session_keeps_the_active_branch(spark, tmp_path):
    msg = lambda i, p, m: {"type": "message", "id": i, "parentId": p, "message": m}
    path = put(tmp_path, "s.jsonl", [
        {"type": "session", "id": "S", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z"}, msg("1", None, {"role": "user", "content": "go", "timestamp": 1704067200000}),
        msg("2", "1", {"role": "assistant", "content": [{"type": "text", "text": "dead end"}], "timestamp": 1704067201000}),
        msg("3", "1", {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "ok"}, {"type": "toolCall", "id": "k", "name": "write", "arguments": {"path": "/w/a.txt"}}], "usage": {"input": 3, "output": 2, "cost": {"total": 0.1}}, "timestamp": 1704067202000}),
        msg("4", "3", {"role": "toolResult", "toolCallId": "k", "toolName": "write", "content": [{"type": "text", "text": "wrote"}], "timestamp": 1704067204000}),
        msg("5", "4", {"role": "toolResult", "toolCallId": "zz", "toolName": "bash", "content": "bad", "isError": True, "timestamp": 1704067205000}),
        msg("6", "5", {"role": "assistant", "content": [{"type": "text", "text": "all done"}], "timestamp": 1704067206000}),
    ])
    (t,) = read_traces(spark, path).collect()
    assert (t.trial_id, t.prompt, t.answer, t.duration_ms) == ("S", "go", "all done", 6000.0)
    assert [(c.tool_name, c.status, c.turn_index, c.duration_ms) for c in t.tool_calls] == [("llm.generation", "ok", 1, None), ("write", "ok", 1, 2000.0), ("bash", "error", 1, None), ("llm.generation", "ok", 2, None)]
    assert (t.tool_calls[1].state_delta[0].op, t.tool_calls[1].state_delta[0].target) == ("create", "a.txt")


def test_codex_stream(spark, tmp_path):
    item = lambda k, **i: {"type": f"item.{k}", "item": i}
    path = put(tmp_path, "c.jsonl", [
        {"type": "thread.started", "thread_id": "TH"}, {"type": "turn.started"}, item("started", id="1", type="command_execution", command="ls"), item("completed", id="2", type="file_change", changes=[{"path": "x", "kind": "add"}], status="completed"),
        item("completed", id="1", type="command_execution", command="ls", aggregated_output="a", exit_code=1, status="failed"), item("started", id="3", type="mcp_tool_call", server="db", tool="q"), item("completed", id="4", type="agent_message", text="bye"),
        {"type": "turn.completed", "usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 5}},
    ])
    (t,) = read_traces(spark, path).collect()
    assert (t.trial_id, t.answer) == ("TH", "bye")
    assert [(c.tool_name, c.status, c.error) for c in t.tool_calls] == [("shell", "error", "failed"), ("apply_patch", "ok", None), ("db.q", "error", "incomplete"), ("llm.generation", "ok", None)]
    assert (t.tool_calls[3].input_tokens, t.tool_calls[3].tokens, t.tool_calls[1].state_delta[0].op) == (6, 15, "create")


def test_claude_stream(spark, tmp_path):
    path = put(tmp_path, "k.jsonl", [
        {"type": "system", "cwd": "/w", "session_id": "Z"}, {"type": "user", "message": {"content": "please"}},
        {"type": "assistant", "message": {"model": "m", "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "t"}, {"type": "tool_use", "id": "u1", "name": "Edit", "input": {"file_path": "/w/f"}}, {"type": "tool_use", "id": "u2", "name": "Task", "input": {"subagent_type": "scout"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "content": [{"type": "text", "text": "fine"}]}]}},
        {"type": "assistant", "parent_tool_use_id": "u2", "message": {"content": [{"type": "tool_use", "id": "u3", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u3", "content": "no", "is_error": True}]}}, {"type": "rate_limit_event"}, {"type": "result", "result": "end", "total_cost_usd": 0.25, "num_turns": 2, "duration_ms": 50},
    ])
    (t,) = read_traces(spark, path).collect()
    assert (t.trial_id, t.prompt, t.answer, t.duration_ms, t.reasoning) == ("Z", "please", "end", 50.0, ["hm"])
    assert [(c.tool_name, c.status, c.cost_usd, c.agent_name) for c in t.tool_calls] == [("llm.generation", "ok", None, None), ("Edit", "ok", None, None), ("Task", "ok", None, None), ("llm.generation", "ok", 0.25, None), ("Bash", "error", None, "scout")]
    assert t.tool_calls[1].state_delta[0].target == "f" and json.loads(t.metadata) == {"num_turns": 2, "rate_limit_events": 1}


def test_atif_with_sub_agent(spark, tmp_path):
    sub = {"schema_version": "ATIF-v1", "session_id": "sub", "agent": {"name": "helper"}, "steps": [{"step_id": 1, "source": "agent", "message": "inner"}]}
    top = {
        "schema_version": "ATIF-v1", "session_id": "S", "agent": {"name": "boss", "version": "1", "model_name": "m"}, "subagent_trajectories": [sub],
        "steps": [
            {"step_id": 1, "source": "user", "message": "q", "timestamp": "2024-01-01T00:00:00Z"}, {"step_id": 2, "source": "agent", "is_copied_context": True, "message": "old"},
            {"step_id": 3, "source": "agent", "message": "call", "timestamp": "2024-01-01T00:00:05Z", "metrics": {"prompt_tokens": 10, "cached_tokens": 4, "completion_tokens": 1}, "tool_calls": [{"tool_call_id": "1", "function_name": "f", "arguments": {"a": 1}}],
             "observation": {"results": [{"source_call_id": "1", "content": "x"}, {"source_call_id": "1", "content": "y", "subagent_trajectory_ref": [{"session_id": "sub"}, {"session_id": "S"}]}]}},
            {"step_id": 4, "source": "agent", "message": "end", "llm_call_count": 0},
        ],
    }
    (t,) = read_traces(spark, put(tmp_path, "trajectory.json", json.dumps(top))).collect()
    assert (t.prompt, t.answer, t.duration_ms) == ("q", "end", 5000.0)
    assert [(c.tool_name, c.output, c.agent_name) for c in t.tool_calls] == [("llm.generation", "call", None), ("f", "x\ny", None), ("llm.generation", "inner", "helper")]
    assert t.tool_calls[0].input_tokens == 6


def test_openai_agents_spans(spark, tmp_path):
    span = lambda i, p, k, a, b, **data: {"object": "trace.span", "trace_id": "T", "id": i, "parent_id": p, "started_at": f"2024-01-01T00:00:{a:02d}Z", "ended_at": f"2024-01-01T00:00:{b:02d}Z", "span_data": {"type": k, **data}}
    path = put(tmp_path, "o.jsonl", [
        span("a", None, "agent", 0, 9, name="boss"), span("t", "a", "turn", 0, 8, turn=2), span("g", "t", "generation", 1, 3, model="m", output="hello", usage={"input_tokens": 3, "output_tokens": 4}),
        {**span("f", "g", "function", 4, 5, name="look", input="x", mcp_data={"server": "s"}), "error": {"message": "bad"}}, span("h", "a", "handoff", 5, 5, from_agent="boss", to_agent="aide"), span("q", "a", "guardrail", 6, 6, name="safe", triggered=True),
    ])
    (t,) = read_traces(spark, path).collect()
    assert (t.answer, t.duration_ms, t.reasoning, json.loads(t.metadata)) == ("hello", 4000.0, ["Handoff: boss -> aide"], {"guardrails": [{"name": "safe", "triggered": True}]})
    assert [(c.tool_name, c.status, c.tokens, c.turn_index, c.agent_name, c.tool_type) for c in t.tool_calls] == [("llm.generation", "ok", 7, 2, "boss", "llm"), ("look", "error", None, 2, "boss", "mcp")]


def test_a_mixed_folder_and_nothing(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps(NATIVE))
    put(tmp_path, "c.jsonl", [{"type": "thread.started", "thread_id": "TH"}])
    path = put(tmp_path, "junk.txt", "not json")
    assert sorted(r.source_format for r in read_traces(spark, path).collect()) == ["codex", "native"]
    (tmp_path / "e").mkdir()
    assert read_traces(spark, put(tmp_path / "e", "junk.txt", "not json")).count() == 0
