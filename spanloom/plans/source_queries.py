"""Queries over the trace formats: events are written as files of each format, read back, and checked against events.

A user's day is a trace, its events are calls.  The files' texts are made here, a row each, as a scan would give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import content_graders as content
from ..schemas import explode_state
from ..sources import agents, files, native, openai_agents, otlp, results
from . import views as v
from .registry import query


def _js(**fields: Column) -> Column:
    return F.to_json(F.struct(*[x.alias(k) for k, x in fields.items()]))


def _calls(spark, sf_dir) -> DataFrame:
    """Calls with whole milliseconds, a second's place in their day and an id of their own."""
    c = v.tool_calls(spark, sf_dir)
    return c.select("case_id", "trial_id", "pos", "tool_name", "status", F.floor("duration_ms").cast("long").alias("ms"), "input", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("cid"), F.col("pos").cast("long").alias("sec"))


def _written(c: DataFrame, line: Column, head: Column | None = None, tail: Column | None = None, joiner: str = "\n") -> DataFrame:
    """(file, content): each trace's head, its calls' lines in order, and its tail."""
    lines = c.groupBy("case_id", "trial_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"), F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"))
    parts = [p for p in (head, F.array_join(F.transform("x", lambda x: x["line"]), joiner), tail) if p is not None]
    return lines.select(F.col("trial_id").alias("file"), F.concat_ws("\n" if joiner == "\n" else "", *parts).alias("content"))


def _flat(traces: DataFrame, *fields: str) -> DataFrame:
    """One row per call with its trace's prompt and answer."""
    d = traces.select("trial_id", "prompt", "answer", F.explode("tool_calls").alias("c"))
    return d.select("trial_id", "prompt", "answer", F.col("c.pos").alias("pos"), *[F.col(f"c.{f}").alias(f) for f in fields])


_C = v.CALLS + """, t AS (SELECT *, CAST(floor(duration_ms) AS BIGINT) AS ms, count(*) OVER (PARTITION BY trial_id) AS n, first_value(tool_name) OVER (PARTITION BY trial_id ORDER BY pos) AS first_tool,
  last_value(tool_name) OVER (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_tool FROM calls)"""


# --- native ----------------------------------------------------------------------------------------------------------


def _native_files(spark, sf_dir) -> DataFrame:
    """Documents whose calls name their tool, input and output now by the current names, now by the legacy ones."""
    c = _calls(spark, sf_dir)
    odd = F.col("pos") % 2 == 1
    one = F.struct(
        F.when(odd, F.col("tool_name")).alias("tool_name"), F.when(~odd, F.col("tool_name")).alias("tool"), F.when(F.col("status") == "error", F.struct(F.lit("boom").alias("message"))).alias("error"),
        F.col("ms").cast("double").alias("duration_ms"), F.col("cid").alias("call_id"), F.when(odd, F.struct(F.col("pos").alias("p"))).alias("input"), F.when(~odd, F.struct(F.col("pos").alias("p"))).alias("args"),
        F.struct(F.col("ms").alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(1).alias("cache_read_tokens")).alias("tokens"),
        F.when(F.col("tool_name") == "purchase", F.array(F.struct(F.lit("file").alias("kind"), F.lit("create").alias("op"), F.concat(F.lit("out/"), "cid").alias("target")))).alias("state_delta"),
    )
    d = c.groupBy("case_id", "trial_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("c")))).alias("x"), F.sum("ms").alias("total"), F.count(F.lit(1)).alias("n"))
    doc = _js(
        task_id=F.col("case_id").cast("string"), trial_id=F.col("trial_id"), input=F.struct(F.concat(F.lit("do "), F.col("n").cast("string")).alias("prompt")), tool_calls=F.transform("x", lambda x: x["c"]),
        outcome=F.struct(F.struct(F.concat(F.lit("did "), F.col("n").cast("string")).alias("final_output")).alias("output_data"), (F.col("n") == 1).alias("blocked")), timing=F.struct(F.col("total").cast("double").alias("total_duration_ms")),
    )
    return d.select(F.col("trial_id").alias("file"), doc.alias("content"))


@query("q80_native_documents", f"""WITH {_C} SELECT trial_id, 'do ' || n AS prompt, 'did ' || n AS answer, CAST(pos AS BIGINT) AS pos, tool_name, status, CAST(ms AS DOUBLE) AS duration_ms, '{{"p":' || pos || '}}' AS input,
  ms + 3 AS tokens, CASE WHEN status = 'error' THEN 'boom' END AS error FROM t""")
def q80(spark, sf_dir):
    d = native.parse_native(files.json_values(_native_files(spark, sf_dir)))
    return _flat(d, "tool_name", "status", "duration_ms", "input", "tokens", "error")


@query("q81_native_traces", f"""WITH {_C} SELECT CAST(case_id AS VARCHAR) AS task_id, trial_id, CAST(sum(ms) AS DOUBLE) AS duration_ms, count(*) AS calls, count(*) = 1 AS blocked,
  count(*) FILTER (tool_name = 'purchase') AS changes FROM t GROUP BY ALL""")
def q81(spark, sf_dir):
    d = native.parse_native(files.json_values(_native_files(spark, sf_dir)))
    changes = F.aggregate(F.transform("tool_calls", lambda c: F.coalesce(F.size("tool_calls") * 0 + F.size(F.coalesce(c["state_delta"], F.array())), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return d.select("task_id", "trial_id", "duration_ms", F.size("tool_calls").cast("long").alias("calls"), "blocked", changes.cast("long").alias("changes"))


@query("q82_state_changes", f"""WITH {_C} SELECT trial_id, CAST(pos AS BIGINT) AS pos, 'file' AS kind, 'create' AS op, 'out/c' || pos AS target FROM t WHERE tool_name = 'purchase'""")
def q82(spark, sf_dir):
    d = native.parse_native(files.json_values(_native_files(spark, sf_dir))).withColumn("trace_id", F.col("trial_id"))
    return explode_state(d).select(F.col("trace_id").alias("trial_id"), "pos", "kind", "op", "target")


def _log_files(spark, sf_dir) -> DataFrame:
    """Event logs: starts come before ends, one start is repeated (its last input counts), a line is no JSON."""
    at, c = F.col("sec").cast("double"), _calls(spark, sf_dir)
    start = lambda p: _js(type=F.lit("tool_call.started"), ts=at, call_id=F.col("cid"), tool_name=F.col("tool_name"), input=F.struct(p.alias("p")))
    done = _js(type=F.lit("tool_call.completed"), ts=at, call_id=F.col("cid"), status=F.col("status"), duration_ms=F.col("ms").cast("double"), output=F.struct(F.col("pos").alias("o")))
    head = _js(type=F.lit("transcript.started"), ts=F.lit(0.0), task_id=F.col("case_id").cast("string"), trial_id=F.col("trial_id"), input=F.struct(F.col("trial_id").alias("prompt")))
    tail = F.concat_ws("\n", F.lit("not json"), _js(type=F.lit("reasoning.step"), index=F.lit(1), step=F.lit("second")), _js(type=F.lit("reasoning.step"), index=F.lit(0), step=F.lit("first")), _js(type=F.lit("transcript.completed"), total_duration_ms=F.col("total").cast("double")))
    return _written(c, F.concat_ws("\n", start(F.lit(-1)), start(F.col("pos")), done), head, tail)


@query("q83_event_logs", f"""WITH {_C} SELECT trial_id, trial_id AS prompt, CAST(NULL AS VARCHAR) AS answer, CAST(pos AS BIGINT) AS pos, tool_name, status, CAST(ms AS DOUBLE) AS duration_ms, '{{"p":' || pos || '}}' AS input, '{{"o":' || pos || '}}' AS output FROM t""")
def q83(spark, sf_dir):
    return _flat(native.parse_event_log(files.json_lines(_log_files(spark, sf_dir))), "tool_name", "status", "duration_ms", "input", "output")


@query("q84_event_log_traces", f"""WITH {_C} SELECT CAST(case_id AS VARCHAR) AS task_id, trial_id, CAST(sum(ms) AS DOUBLE) AS duration_ms, 'first|second' AS reasoning, FALSE AS supports_outcome FROM t GROUP BY ALL""")
def q84(spark, sf_dir):
    d = native.parse_event_log(files.json_lines(_log_files(spark, sf_dir)))
    return d.select("task_id", "trial_id", "duration_ms", F.array_join("reasoning", "|").alias("reasoning"), "supports_outcome")


@query("q85_event_log_sink", f"""WITH {_C} SELECT trial_id, 'do ' || n AS prompt, CAST(NULL AS VARCHAR) AS answer, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY ms, pos) AS BIGINT) AS pos, tool_name, status, CAST(ms AS DOUBLE) AS duration_ms FROM t""")
def q85(spark, sf_dir):
    """Documents to an event log and back: a completed call stands at the time at which it ended."""
    traces = native.parse_native(files.json_values(_native_files(spark, sf_dir)))
    lines = native.events(traces).select(F.col("trace_id").alias("file"), F.col("seq").alias("pos"), F.try_parse_json("line").alias("v"))
    return _flat(native.parse_event_log(lines), "tool_name", "status", "duration_ms")


# --- spans -----------------------------------------------------------------------------------------------------------


@query("q86_otlp_spans", f"""WITH {_C} SELECT trial_id, 'ask ' || first_tool AS prompt, 'end ' || last_tool AS answer, CAST(pos AS BIGINT) AS pos, CASE WHEN tool_name = 'signup' THEN 'llm.generation' ELSE tool_name END AS tool_name, status,
  ms AS duration_ms, CASE WHEN tool_name = 'signup' THEN ms + 5 END AS tokens, 'agent' || case_id AS agent_name, CASE WHEN status = 'error' THEN 'bad' END AS error FROM t""")
def q86(spark, sf_dir):
    """Resource spans: an agent above a chain above tools and models; a call's agent is two levels up."""
    c = _calls(spark, sf_dir)
    first = Window.partitionBy("trial_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumns({"a": F.first("tool_name").over(first), "z": F.last("tool_name").over(first)})
    attr = lambda k, value, kind="stringValue": F.concat(F.lit(f'{{"key":"{k}","value":{{"{kind}":'), value, F.lit("}}"))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    nano = lambda s: F.concat(F.lit('"'), (F.lit(1_700_000_000_000_000_000) + s).cast("string"), F.lit('"'))

    def span(id_, parent, name, start, end, attrs, more=None):
        return F.concat(F.lit('{"traceId":"'), F.col("trial_id"), F.lit('","spanId":"'), id_, F.lit('","parentSpanId":"'), parent, F.lit('","name":"'), name, F.lit('","startTimeUnixNano":'), nano(start), F.lit(',"endTimeUnixNano":'), nano(end), F.lit(',"attributes":['), F.concat_ws(",", *attrs), F.lit("]"), more if more is not None else F.lit(""), F.lit("}"))

    model, at = F.col("tool_name") == "signup", F.col("sec") * 1_000_000_000
    own = span(
        F.col("cid"), F.lit("chain"), F.col("tool_name"), at, at + F.col("ms") * 1_000_000,
        [attr("openinference.span.kind", F.when(model, '"LLM"').otherwise('"TOOL"')), F.when(model, attr("llm.token_count.prompt", F.col("ms").cast("string"), "intValue")), F.when(model, attr("llm.token_count.completion", F.lit("5"), "intValue"))],
        F.when(F.col("status") == "error", ',"status":{"code":2,"message":"bad"}').otherwise(',"status":{"code":1}'),
    )
    top = span(F.lit("top"), F.lit(""), F.concat(F.lit("agent"), F.col("case_id").cast("string")), F.lit(0), F.lit(1), [attr("openinference.span.kind", F.lit('"AGENT"')), attr("input.value", text(F.concat(F.lit("ask "), "a"))), attr("output.value", text(F.concat(F.lit("end "), "z")))])
    chain = span(F.lit("chain"), F.lit("top"), F.lit("chain"), F.lit(0), F.lit(1), [attr("openinference.span.kind", F.lit('"CHAIN"'))])
    own = F.when(F.col("pos") == 1, F.concat_ws(",", top, chain, own)).otherwise(own)
    made = _written(c, own, F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":['), F.lit("]}]}]}"), ",")
    d = _flat(otlp.parse_otlp(files.json_values(made)), "tool_name", "status", "duration_ms", "tokens", "agent_name", "error")
    return d.withColumn("duration_ms", F.round("duration_ms").cast("long"))


@query("q87_openai_agents_spans", f"""WITH {_C} SELECT trial_id, CAST(NULL AS VARCHAR) AS prompt, CAST(pos AS BIGINT) AS pos, CASE WHEN tool_name = 'signup' THEN 'llm.generation' ELSE tool_name END AS tool_name, status,
  CASE WHEN tool_name = 'signup' THEN ms + 5 END AS tokens, 7 AS turn_index, 'boss' AS agent_name FROM t""")
def q87(spark, sf_dir):
    c, model = _calls(spark, sf_dir), F.col("tool_name") == "signup"
    when = lambda s: F.date_format(F.timestamp_seconds(s + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    data = F.struct(F.when(model, "generation").otherwise("function").alias("type"), F.when(~model, F.col("tool_name")).alias("name"), F.when(model, F.struct(F.col("ms").alias("input_tokens"), F.lit(5).alias("output_tokens"))).alias("usage"))
    line = _js(object=F.lit("trace.span"), trace_id=F.col("trial_id"), id=F.lpad("cid", 12, "0"), parent_id=F.lit("turn"), started_at=when(F.col("sec")), ended_at=when(F.col("sec") + 1), error=F.when(F.col("status") == "error", F.struct(F.lit("bad").alias("message"))), span_data=data)
    turn = _js(object=F.lit("trace.span"), trace_id=F.col("trial_id"), id=F.lit("turn"), parent_id=F.lit("boss"), span_data=F.struct(F.lit("turn").alias("type"), F.lit(7).alias("turn")))
    boss = _js(object=F.lit("trace.span"), trace_id=F.col("trial_id"), id=F.lit("boss"), span_data=F.struct(F.lit("agent").alias("type"), F.lit("boss").alias("name")))
    return _flat(openai_agents.parse_openai_agents(files.json_values(_written(c, line, boss, turn))), "tool_name", "status", "tokens", "turn_index", "agent_name").drop("answer")


# --- sessions --------------------------------------------------------------------------------------------------------

_TURNS = """SELECT trial_id, 'go' AS prompt, 'say ' || n AS answer, CAST(2 * pos - 1 AS BIGINT) AS pos, 'llm.generation' AS tool_name, 'ok' AS status, '' AS output, ms + 2 AS tokens, CAST(pos AS INTEGER) AS turn_index FROM t
  UNION ALL SELECT trial_id, 'go', 'say ' || n, CAST(2 * pos AS BIGINT), tool_name, status, 'r' || pos, NULL, CAST(pos AS INTEGER) FROM t"""


def _pi_messages(c: DataFrame) -> tuple[Column, Column, Column]:
    """(assistant message, tool result, last words) as structs; the last call's message also says something."""
    call = F.struct(F.lit("toolCall").alias("type"), F.col("cid").alias("id"), F.col("tool_name").alias("name"), F.struct(F.col("pos").alias("p")).alias("arguments"))
    asked = F.struct(F.lit("assistant").alias("role"), F.array(call).alias("content"), F.struct(F.col("ms").alias("input"), F.lit(2).alias("output"), (F.col("ms") + 2).alias("totalTokens")).alias("usage"))
    got = F.struct(F.lit("toolResult").alias("role"), F.col("cid").alias("toolCallId"), F.concat(F.lit("r"), F.col("pos").cast("string")).alias("content"), (F.col("status") == "error").alias("isError"))
    return asked, got, F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("say "), F.col("n").cast("string")).alias("content"))


@query("q88_pi_sessions", f"""WITH {_C}, u AS ({_TURNS}) SELECT * FROM u UNION ALL SELECT DISTINCT trial_id, 'go', 'say ' || n, CAST(2 * n + 1 AS BIGINT), 'llm.generation', 'ok', 'say ' || n, NULL, CAST(n + 1 AS INTEGER) FROM t""")
def q88(spark, sf_dir):
    """Sessions with an abandoned branch after the second entry, which the path of the last entry leaves out."""
    c = _calls(spark, sf_dir)
    asked, got, last = _pi_messages(c)
    entry = lambda id_, parent, m: _js(type=F.lit("message"), id=id_, parentId=parent, message=m)
    p = F.col("pos").cast("string")
    before = F.when(F.col("pos") == 1, F.lit("u")).otherwise(F.concat(F.lit("r"), (F.col("pos") - 1).cast("string")))
    dead = entry(F.concat(F.lit("x"), p), F.lit("u"), F.struct(F.lit("assistant").alias("role"), F.lit("never said").alias("content")))
    lines = F.concat_ws("\n", F.when(F.col("pos") == 1, dead), entry(F.concat(F.lit("a"), p), before, asked), entry(F.concat(F.lit("r"), p), F.concat(F.lit("a"), p), got))
    head = F.concat_ws("\n", _js(type=F.lit("session"), id=F.col("trial_id"), cwd=F.lit("/w")), entry(F.lit("u"), F.lit(None).cast("string"), F.struct(F.lit("user").alias("role"), F.lit("go").alias("content"))))
    tail = entry(F.lit("end"), F.concat(F.lit("r"), F.col("n").cast("string")), last)
    return _flat(agents.parse_pi(files.json_lines(_written(c, lines, head, tail))), "tool_name", "status", "output", "tokens", "turn_index")


@query("q89_pi_streams", f"""WITH {_C}, u AS ({_TURNS}) SELECT * FROM u UNION ALL SELECT DISTINCT trial_id, 'go', 'say ' || n, CAST(2 * n + 1 AS BIGINT), 'llm.generation', 'ok', 'say ' || n, NULL, CAST(n + 1 AS INTEGER) FROM t""")
def q89(spark, sf_dir):
    c = _calls(spark, sf_dir)
    asked, got, last = _pi_messages(c)
    frame = lambda m, kind="message_end": _js(type=F.lit(kind), message=m)
    user = F.struct(F.lit("user").alias("role"), F.lit("go").alias("content"))
    made = _written(c, F.concat_ws("\n", frame(asked, "message_start"), frame(asked), frame(got)), frame(user), frame(last))
    return _flat(agents.parse_pi_stream(files.json_lines(made)), "tool_name", "status", "output", "tokens", "turn_index")


@query("q90_codex_streams", f"""WITH {_C} SELECT trial_id, CAST(NULL AS VARCHAR) AS prompt, 'say ' || n AS answer, CAST(pos AS BIGINT) AS pos, CASE WHEN tool_name = 'purchase' THEN 'apply_patch' ELSE 'shell' END AS tool_name, status,
  CASE WHEN status = 'error' THEN 'failed' END AS error, CAST(NULL AS BIGINT) AS tokens FROM t
  UNION ALL SELECT DISTINCT trial_id, NULL, 'say ' || n, CAST(n + 1 AS BIGINT), 'llm.generation', 'ok', NULL, CAST(30 AS BIGINT) FROM t""")
def q90(spark, sf_dir):
    c = _calls(spark, sf_dir)
    patch = F.col("tool_name") == "purchase"
    bad = F.col("status") == "error"
    item = F.struct(
        F.col("cid").alias("id"), F.when(patch, "file_change").otherwise("command_execution").alias("type"), F.when(bad, "failed").otherwise("completed").alias("status"), F.when(~patch, F.col("tool_name")).alias("command"),
        F.when(patch, F.array(F.struct(F.lit("add").alias("kind"), F.lit("f").alias("path")))).alias("changes"),
    )
    line = F.concat_ws("\n", _js(type=F.lit("item.started"), item=item), _js(type=F.lit("item.completed"), item=item))
    said = F.struct(F.lit("m").alias("id"), F.lit("agent_message").alias("type"), F.concat(F.lit("say "), F.col("n").cast("string")).alias("text"))
    tail = F.concat_ws("\n", _js(type=F.lit("item.completed"), item=said), _js(type=F.lit("turn.completed"), usage=F.struct(F.lit(20).alias("input_tokens"), F.lit(8).alias("cached_input_tokens"), F.lit(10).alias("output_tokens"))))
    head = F.concat_ws("\n", _js(type=F.lit("thread.started"), thread_id=F.col("trial_id")), F.lit('{"type":"turn.started"}'))
    return _flat(agents.parse_codex(files.json_lines(_written(c, line, head, tail))), "tool_name", "status", "error", "tokens")


@query("q91_claude_streams", f"""WITH {_C} SELECT trial_id, 'go' AS prompt, 'say ' || n AS answer, CAST(2 * pos - 1 AS BIGINT) AS pos, 'llm.generation' AS tool_name, 'ok' AS status, ms + 6 AS tokens, CAST(pos AS INTEGER) AS turn_index, CASE WHEN pos = n THEN 0.5 END::DOUBLE AS cost_usd FROM t
  UNION ALL SELECT trial_id, 'go', 'say ' || n, CAST(2 * pos AS BIGINT), tool_name, status, NULL, CAST(pos AS INTEGER), NULL FROM t""")
def q91(spark, sf_dir):
    c = _calls(spark, sf_dir)
    use = F.struct(F.lit("tool_use").alias("type"), F.col("cid").alias("id"), F.col("tool_name").alias("name"), F.struct(F.col("pos").alias("p")).alias("input"))
    usage = F.struct(F.col("ms").alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(2).alias("cache_read_input_tokens"), F.lit(3).alias("cache_creation_input_tokens"))
    said = _js(type=F.lit("assistant"), session_id=F.col("trial_id"), message=F.struct(F.array(use).alias("content"), usage.alias("usage")))
    got = F.struct(F.lit("tool_result").alias("type"), F.col("cid").alias("tool_use_id"), F.lit("out").alias("content"), (F.col("status") == "error").alias("is_error"))
    line = F.concat_ws("\n", said, _js(type=F.lit("user"), message=F.struct(F.array(got).alias("content"))))
    head = F.concat_ws("\n", _js(type=F.lit("system"), session_id=F.col("trial_id"), cwd=F.lit("/w")), _js(type=F.lit("user"), message=F.struct(F.lit("go").alias("content"))))
    tail = _js(type=F.lit("result"), result=F.concat(F.lit("say "), F.col("n").cast("string")), total_cost_usd=F.lit(0.5), num_turns=F.col("n"))
    return _flat(agents.parse_claude(files.json_values(_written(c, line, head, tail))), "tool_name", "status", "tokens", "turn_index", "cost_usd")


@query("q92_atif_trajectories", f"""WITH {_C} SELECT trial_id, 'go' AS prompt, 'at ' || n AS answer, CAST(2 * pos - 1 AS BIGINT) AS pos, 'llm.generation' AS tool_name, 'at ' || pos AS output, ms + 9 AS tokens, CAST(pos + 1 AS INTEGER) AS turn_index FROM t
  UNION ALL SELECT trial_id, 'go', 'at ' || n, CAST(2 * pos AS BIGINT), tool_name, 'x' || pos || chr(10) || 'y', NULL, CAST(pos + 1 AS INTEGER) FROM t""")
def q92(spark, sf_dir):
    """Trajectories: a step is a turn; a call's two observations are joined by a line break."""
    c = _calls(spark, sf_dir)
    p = F.col("pos").cast("string")
    seen = lambda x: F.struct(F.col("cid").alias("source_call_id"), x.alias("content"))
    step = _js(
        step_id=F.col("pos") + 1, source=F.lit("agent"), message=F.concat(F.lit("at "), p), tool_calls=F.array(F.struct(F.col("cid").alias("tool_call_id"), F.col("tool_name").alias("function_name"), F.struct(F.col("pos").alias("p")).alias("arguments"))),
        observation=F.struct(F.array(seen(F.concat(F.lit("x"), p)), seen(F.lit("y"))).alias("results")), metrics=F.struct((F.col("ms") + 4).alias("prompt_tokens"), F.lit(4).alias("cached_tokens"), F.lit(5).alias("completion_tokens")),
    )
    head = F.concat(F.lit('{"schema_version":"ATIF-v1.4","session_id":"'), F.col("trial_id"), F.lit('","agent":{"name":"me"},"steps":[{"step_id":1,"source":"user","message":"go"},'))
    return _flat(agents.parse_atif(files.json_values(_written(c, step, head, F.lit("]}"), ","))), "tool_name", "output", "tokens", "turn_index")


# --- telling formats apart, results, rows ------------------------------------------------------------------------------

_HEADS = {
    "native": '{"task_id":"a","trial_id":"b"}', "event_log": '{"type":"transcript.started"}', "otlp": '{"resourceSpans":[]}', "atif": '{"schema_version":"ATIF-v1.4"}', "openai_agents": '{"object":"trace.span"}', "pi": '{"type":"session"}',
    "codex": '{"type":"thread.started"}', "pi_stream": '{"type":"agent_start"}', "claude": '{"type":"assistant"}', "unknown": "plain words",
}


@query("q93_formats_told", f"SELECT event_id, {list(_HEADS)}[event_id % {len(_HEADS)} + 1] AS format FROM events")
def q93(spark, sf_dir):
    e = v.read(spark, sf_dir, "events")
    text = F.element_at(F.array(*[F.lit(x) for x in _HEADS.values()]), (F.col("event_id") % len(_HEADS) + 1).cast("int"))
    return e.select("event_id", files.detect(F.concat(text, F.when(F.col("event_id") % 3 == 0, "\n{}").otherwise(""))).alias("format"))


@query("q94_results_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderstatus = 'F' AS passed, CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed' END AS status, o_totalprice AS overall_score,
  CASE o_orderkey % 3 WHEN 0 THEN o_totalprice + 1 WHEN 1 THEN o_totalprice + 2 ELSE o_totalprice END AS best_score FROM orders""")
def q94(spark, sf_dir):
    """Results files in every wrapper: a bare case, a list, results, case_results within results."""
    o = v.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    case = _js(
        case_id=F.col("o_orderkey").cast("string"), passed=F.col("o_orderstatus") == "F", overall_score=F.col("o_totalprice"),
        trial_metrics=F.struct(F.when(k == 0, F.col("o_totalprice") + 1).alias("best_of_k"), F.when(k == 1, F.col("o_totalprice") + 2).alias("score_max")),
    )
    d = o.groupBy((F.col("o_orderkey") / 4).cast("long").alias("g")).agg(F.array_join(F.collect_list(case), ",").alias("x"), F.count(F.lit(1)).alias("n"))
    list_ = F.concat(F.lit("["), "x", F.lit("]"))
    form = F.when(F.col("n") == 1, F.col("x")).when(F.col("g") % 3 == 0, list_).when(F.col("g") % 3 == 1, F.concat(F.lit('{"results":'), list_, F.lit("}"))).otherwise(F.concat(F.lit('{"results":[{"case_results":'), list_, F.lit("}]}")))
    rows = results.case_values(files.json_values(d.select(F.col("g").cast("string").alias("file"), form.alias("content"))))
    return results.cases(rows).select("case_id", "passed", "status", "overall_score", "best_score")


@query("q95_compare_rows_positions", """SELECT CAST(n AS BIGINT) AS row_number, 'x' AS "column", 'mismatch' AS kind FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE o_orderkey % 9 = 0
  UNION ALL SELECT count(*) + 1, '*', 'extra' FROM orders""")
def q95(spark, sf_dir):
    """Two tables in their own order: the values of every ninth key differ, and one row is too many."""
    o = v.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("x"))
    a = o.withColumn("x", F.when(F.col("at") % 9 == 0, F.col("x") + 100).otherwise(F.col("x"))).unionByName(o.agg((F.max("at") + 1).alias("at"), F.lit(0.0).alias("x")))
    return content.compare_positions(a, o, "at").select("row_number", "column", "kind")


@query("q96_compare_rows_keyed_odd", """SELECT p_size AS k, 'mismatch' AS kind, 'x' AS "column" FROM part GROUP BY 1 HAVING max(p_partkey) % 2 = 0""")
def q96(spark, sf_dir):
    """Repeated keys: the last row of a key by ``x`` counts; null keys meet each other."""
    e = v.read(spark, sf_dir, "part").select(F.col("p_size").alias("k"), F.col("p_partkey").alias("o"), F.col("p_partkey").alias("x"))
    e = e.unionByName(e.limit(1).select(F.lit(None).cast(e.schema["k"].dataType).alias("k"), F.lit(1).cast("long").alias("o"), F.lit(1).cast("long").alias("x")))
    a = e.withColumn("x", F.when(F.col("o") % 2 == 0, F.col("x") + 10**6).otherwise(F.col("x")))
    return content.compare_keyed(a, e, ["k"], order="o").select("k", "kind", "column")
