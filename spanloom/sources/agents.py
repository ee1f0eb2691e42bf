"""Session files of coding agents to traces: pi sessions and streams, codex streams, Claude streams, ATIF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.partitions import merged
from ..schemas import assemble, call, first_text, floored, get, items
from .files import json_lines, json_values, whole_files

# What editing tools do to files.
EDIT_TOOLS = {"write": "create", "edit": "update", "multiedit": "update", "notebookedit": "update", "create": "create", "str_replace": "update"}
FAILED = ("failed", "error", "declined", "cancelled", "incomplete")


def content_text(v: Column, path: str) -> Column:
    """The text of a content value: itself, or its text blocks by line, images as a mark."""
    value = get(v, path, "variant")
    blocks = F.transform(items(v, path), lambda b: F.when(F.try_variant_get(b, "$.type", "string") == "image", "[image]").otherwise(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")))))
    return F.when(F.schema_of_variant(value) == "STRING", get(v, path)).when(F.size(blocks) > 0, F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n"))


def edits(tool: Column, input_: Column, status: Column, cwd: Column) -> Column:
    """The state change of a successful file edit, its path relative to the working folder."""
    ops = F.create_map(*[F.lit(x) for kv in EDIT_TOOLS.items() for x in kv])
    path = F.coalesce(*[F.get_json_object(input_, f"$.{k}") for k in ("file_path", "path", "notebook_path")])
    inside = F.concat(F.rtrim(cwd), F.lit("/"))
    target = F.when(F.startswith(path, inside), F.substr(path, F.length(inside) + 1)).otherwise(path)
    null = F.lit(None).cast("string")
    change = F.array(F.struct(F.lit("file").alias("kind"), F.try_element_at(ops, F.lower(tool)).alias("op"), target.alias("target"), null.alias("before"), null.alias("after")))
    return F.when((status == "ok") & path.isNotNull() & F.try_element_at(ops, F.lower(tool)).isNotNull(), change)


def _first_last(d: DataFrame, first: dict[str, tuple], last: dict[str, tuple], *more: Column) -> DataFrame:
    """Per trace the first or last of values where a condition holds, by pos."""
    picks = [F.min_by(x, F.when(c & x.isNotNull(), F.col("pos"))).alias(k) for k, (c, x) in first.items()]
    picks += [F.max_by(x, F.when(c & x.isNotNull(), F.col("pos"))).alias(k) for k, (c, x) in last.items()]
    return d.groupBy(F.col("file").alias("trace_id")).agg(*picks, *more)


def _stamp(x: Column) -> Column:
    """Epoch seconds of an ISO text or of milliseconds."""
    n = x.try_cast("double")
    return F.coalesce(F.when(n > 1e11, n / 1000).otherwise(n), F.unix_micros(F.try_to_timestamp(x)) / 1e6)


# --- pi ------------------------------------------------------------------------------------------------------------


@F.pandas_udf(ArrayType(StringType()))
def _path_up(leaf: pd.Series, ids: pd.Series, parents: pd.Series) -> pd.Series:
    """The ids from each leaf up to its root; a cycle ends where it closes, of repeated ids the last counts."""

    def walk(at, ids, parents) -> list[str]:
        above, path = dict(zip(ids, parents)), {}
        while at in above and at not in path:
            path[at] = None
            at = above[at]
        return list(path)

    return pd.Series([walk(*x) for x in zip(leaf, ids, parents)])


def active_branch(entries: DataFrame) -> DataFrame:
    """Entries on the path from each session's last entry up to its root by ``parent_id``; all where there is no tree.

    A session was one file's text, so its ids fit in one row: the path is one walk, whatever its depth.
    """
    keyed = entries.where("id IS NOT NULL").select("file", "id", "parent_id", "pos")
    node = F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("parent_id", F.lit("")).alias("up"))))
    trees = keyed.groupBy("file").agg(F.max_by("id", "pos").alias("leaf"), node.alias("nodes"))
    path = _path_up("leaf", F.transform("nodes", lambda n: n["id"]), F.transform("nodes", lambda n: n["up"]))
    marked = trees.select("file", F.explode(path).alias("id"))
    return entries.join(marked, ["file", "id"], "left_semi").unionByName(entries.where("id IS NULL"))


def _pi(messages: DataFrame, head: DataFrame | None, source: str) -> DataFrame:
    """Traces from rows (file, pos, m): an assistant message is a model call and its tool calls; results close calls."""
    m = F.col("m")
    role, d = get(m, "$.role"), messages
    d = d.withColumn("role", role).withColumn("turn", F.sum((role == "assistant").cast("int")).over(Window.partitionBy("file").orderBy("pos")))
    stamp = _stamp(get(m, "$.timestamp"))
    said = d.where("role = 'assistant'")
    stop = get(m, "$.stopReason")
    model_calls = said.select(F.col("file").alias("trace_id"), "pos", F.lit(-1).alias("i"), *call(
        tool_name=F.lit("llm.generation"), status=F.when(stop.isin("error", "aborted"), "error"), ts=stamp, error=F.when(stop.isin("error", "aborted"), F.coalesce(get(m, "$.errorMessage"), stop)), output=content_text(m, "$.content"), cost_usd=get(m, "$.usage.cost.total", "double"),
        input_tokens=get(m, "$.usage.input", "long"), output_tokens=get(m, "$.usage.output", "long"), tokens=get(m, "$.usage.totalTokens", "long"), tool_type=F.lit("llm"), turn_index=F.col("turn"), model=get(m, "$.model"),
    ))
    blocks = said.select("file", "pos", "turn", stamp.alias("asked"), F.posexplode(items(m, "$.content")).alias("i", "b")).where(get(F.col("b"), "$.type") == "toolCall")
    asked = blocks.select("file", "pos", "i", "turn", "asked", get(F.col("b"), "$.id").alias("id"), get(F.col("b"), "$.name").alias("name"), F.to_json(get(F.col("b"), "$.arguments", "variant")).alias("args"))
    got = d.where("role = 'toolResult'").select("file", F.col("pos").alias("r_pos"), get(m, "$.toolCallId").alias("id"), get(m, "$.toolName").alias("r_name"), content_text(m, "$.content").alias("out"), F.coalesce(get(m, "$.isError", "boolean"), F.lit(False)).alias("bad"), stamp.alias("answered"), F.col("turn").alias("r_turn"))
    both = asked.join(got, ["file", "id"], "full_outer")  # a result without a call is a call of its own
    cwd = head.select("file", get(F.col("h"), "$.cwd").alias("cwd")) if head is not None else None
    both = both.join(cwd, "file", "left") if cwd is not None else both.withColumn("cwd", F.lit(None).cast("string"))
    status = F.when(F.col("bad"), "error").otherwise("ok")
    tools = both.select(F.col("file").alias("trace_id"), F.coalesce("pos", "r_pos").alias("pos"), F.coalesce("i", F.lit(0)).alias("i"), *call(
        tool_name=F.coalesce("name", "r_name"), status=status, duration_ms=floored((F.col("answered") - F.col("asked")) * 1000), ts=F.coalesce("asked", "answered"), call_id=F.col("id"), input=F.col("args"), output=F.col("out"),
        error=F.when(F.col("bad"), F.col("out")), tool_type=F.lit("tool"), turn_index=F.coalesce("turn", "r_turn"), state_delta=edits(F.coalesce("name", "r_name"), F.col("args"), status, F.col("cwd")),
    ))
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    traces = _first_last(d, {"prompt": (user, content_text(m, "$.content")), "started": (F.lit(True), stamp)}, {"answer": (bot, first_text(content_text(m, "$.content"))), "_end": (F.lit(True), stamp)})
    traces = traces.withColumn("duration_ms", F.when(F.col("_end") >= F.col("started"), (F.col("_end") - F.col("started")) * 1000))
    traces = traces.join(head.select(F.col("file").alias("trace_id"), get(F.col("h"), "$.id").alias("trial_id")), "trace_id", "left") if head is not None else traces.withColumn("trial_id", F.col("trace_id"))
    return assemble(model_calls.unionByName(tools), traces.withColumns({"task_id": F.col("trial_id"), "source_format": F.lit(source), "supports_outcome": F.lit(True)}), "pos", "i")


def parse_pi(lines: DataFrame, active_only: bool = True) -> DataFrame:
    """pi session files: a header line, then entries that form a tree."""
    v = F.col("v")
    head = lines.where(get(v, "$.type") == "session").groupBy("file").agg(F.min_by(F.to_json("v"), "pos").alias("h")).select("file", F.parse_json("h").alias("h"))
    entries = lines.where(get(v, "$.type") != "session").select("file", "pos", get(v, "$.id").alias("id"), get(v, "$.parentId").alias("parent_id"), get(v, "$.type").alias("type"), F.to_json(get(v, "$.message", "variant")).alias("m"))
    entries = active_branch(entries) if active_only else entries
    return _pi(entries.where("type = 'message'").select("file", "pos", F.try_parse_json("m").alias("m")), head, "pi")


def parse_pi_stream(lines: DataFrame) -> DataFrame:
    """pi streams: only message_end frames carry messages."""
    return _pi(lines.where(get(F.col("v"), "$.type") == "message_end").select("file", "pos", get(F.col("v"), "$.message", "variant").alias("m")), None, "pi_stream")


# --- codex ---------------------------------------------------------------------------------------------------------


def parse_codex(lines: DataFrame) -> DataFrame:
    """codex streams: the last state of each item at the place of its first; a turn's end is a model call."""
    v = F.col("v")
    d = lines.withColumn("kind", get(v, "$.type")).withColumn("turn", F.sum((get(v, "$.type") == "turn.started").cast("int")).over(Window.partitionBy("file").orderBy("pos")))
    it = d.where(F.col("kind").startswith("item.")).select("file", "pos", "turn", "kind", get(v, "$.item.id").alias("id"), F.to_json(get(v, "$.item", "variant")).alias("item"))
    it = it.groupBy("file", "id").agg(F.min("pos").alias("pos"), F.min("turn").alias("turn"), F.max_by("item", "pos").alias("item"), F.max_by("kind", "pos").alias("kind")).withColumn("i", F.try_parse_json("item"))
    i = F.col("i")
    kind = F.coalesce(get(i, "$.type"), get(i, "$.item_type"))
    status = get(i, "$.status")
    open_ = F.col("kind") != "item.completed"
    failed = status.isin(*FAILED) | (F.coalesce(get(i, "$.exit_code", "int"), F.lit(0)) != 0) | open_
    name = F.when(kind == "command_execution", "shell").when(kind == "file_change", "apply_patch").when(kind == "mcp_tool_call", F.concat_ws(".", get(i, "$.server"), get(i, "$.tool"))).when(kind == "web_search", "web_search").when(kind == "todo_list", "todo")
    ops = F.create_map(*[F.lit(x) for x in ("add", "create", "update", "update", "delete", "delete")])
    null = F.lit(None).cast("string")
    changes = F.transform(items(i, "$.changes"), lambda c: F.struct(F.lit("file").alias("kind"), F.try_element_at(ops, F.try_variant_get(c, "$.kind", "string")).alias("op"), F.try_variant_get(c, "$.path", "string").alias("target"), null.alias("before"), null.alias("after")))
    tools = it.where(name.isNotNull()).select(F.col("file").alias("trace_id"), "pos", *call(
        tool_name=name, status=F.when(failed, "error").otherwise("ok"), call_id=F.col("id"), input=F.when(kind == "command_execution", F.to_json(F.struct(get(i, "$.command").alias("command")))).when(kind == "web_search", F.to_json(F.struct(get(i, "$.query").alias("query")))).otherwise(F.to_json(get(i, "$.arguments", "variant"))),
        output=F.coalesce(get(i, "$.aggregated_output"), F.to_json(get(i, "$.result", "variant"))), error=F.when(failed, F.coalesce(get(i, "$.error.message"), F.when(open_, "incomplete"), status, F.lit("failed"))), tool_type=F.lit("tool"), turn_index=F.col("turn"), state_delta=F.when((kind == "file_change") & ~failed, changes),
    ))
    cached = F.coalesce(get(v, "$.usage.cached_input_tokens", "long"), F.lit(0))
    ends = d.where(F.col("kind").isin("turn.completed", "turn.failed")).select(F.col("file").alias("trace_id"), "pos", *call(
        tool_name=F.lit("llm.generation"), status=F.when(F.col("kind") == "turn.failed", "error"), error=F.when(F.col("kind") == "turn.failed", F.coalesce(get(v, "$.error.message"), F.lit("turn failed"))), input_tokens=floored(get(v, "$.usage.input_tokens", "long") - cached), output_tokens=get(v, "$.usage.output_tokens", "long"),
        tokens=get(v, "$.usage.input_tokens", "long") + get(v, "$.usage.output_tokens", "long"), cached_tokens=cached, tool_type=F.lit("llm"), turn_index=F.col("turn"),
    ))
    said = get(v, "$.type") == "item.completed"
    traces = _first_last(d, {"trial_id": (F.col("kind") == "thread.started", get(v, "$.thread_id"))}, {"answer": (said & (F.coalesce(get(v, "$.item.type"), get(v, "$.item.item_type")).isin("agent_message", "assistant_message")), get(v, "$.item.text"))},
        F.transform(F.array_sort(F.collect_list(F.when(said & (get(v, "$.item.type") == "reasoning"), F.struct("pos", get(v, "$.item.text").alias("text"))))), lambda x: x["text"]).alias("reasoning"))
    return assemble(tools.unionByName(ends), traces.withColumns({"task_id": F.col("trial_id"), "source_format": F.lit("codex"), "supports_outcome": F.lit(True)}), "pos")


# --- Claude --------------------------------------------------------------------------------------------------------


def parse_claude(values: DataFrame) -> DataFrame:
    """Claude streams: an assistant message is a model call and its tool uses; user messages bring the results."""
    v = F.col("v")
    d = values.withColumn("kind", get(v, "$.type"))
    d = d.withColumn("turn", F.sum((F.col("kind") == "assistant").cast("int")).over(Window.partitionBy("file").orderBy("pos")))
    said = d.where("kind = 'assistant'")
    last = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("pos"))) == 1
    result = d.where("kind = 'result'").groupBy(F.col("file").alias("trace_id")).agg(F.max_by(F.to_json("v"), "pos").alias("r")).select("trace_id", F.parse_json("r").alias("r"))
    r = F.col("r")
    llm = said.select(F.col("file").alias("trace_id"), "pos", F.lit(-1).alias("i"), *call(
        tool_name=F.lit("llm.generation"), output=content_text(v, "$.message.content"), input_tokens=get(v, "$.message.usage.input_tokens", "long"), output_tokens=get(v, "$.message.usage.output_tokens", "long"),
        cached_tokens=F.coalesce(get(v, "$.message.usage.cache_read_input_tokens", "long"), F.lit(0)) + F.coalesce(get(v, "$.message.usage.cache_creation_input_tokens", "long"), F.lit(0)), tool_type=F.lit("llm"), turn_index=F.col("turn"), model=get(v, "$.message.model"),
    ))
    llm = llm.withColumn("_last", last).join(result.select("trace_id", get(r, "$.total_cost_usd", "double").alias("_cost")), "trace_id", "left").withColumn("cost_usd", F.when(F.col("_last"), F.col("_cost"))).drop("_last", "_cost")
    b = F.col("b")
    blocks = said.select("file", "pos", "turn", get(v, "$.parent_tool_use_id").alias("parent"), F.posexplode(items(v, "$.message.content")).alias("i", "b"))
    uses = blocks.where(get(b, "$.type") == "tool_use").select("file", "pos", "i", "turn", "parent", get(b, "$.id").alias("id"), get(b, "$.name").alias("name"), F.to_json(get(b, "$.input", "variant")).alias("input"))
    res = d.where("kind = 'user'").select("file", F.posexplode(items(v, "$.message.content")).alias("_i", "b")).where(get(b, "$.type") == "tool_result")
    res = res.select("file", get(b, "$.tool_use_id").alias("id"), content_text(b, "$.content").alias("out"), F.coalesce(get(b, "$.is_error", "boolean"), F.lit(False)).alias("bad")).dropDuplicates(["file", "id"])
    tasks = uses.where("name IN ('Task', 'Agent')").select("file", F.col("id").alias("parent"), F.coalesce(F.get_json_object("input", "$.subagent_type"), F.get_json_object("input", "$.description")).alias("agent"))
    cwd = d.where("kind = 'system'").groupBy("file").agg(F.min_by(get(v, "$.cwd"), "pos").alias("cwd"))
    status = F.when(F.col("bad"), "error").otherwise("ok")
    tools = uses.join(res, ["file", "id"], "left").join(tasks, ["file", "parent"], "left").join(cwd, "file", "left").select(F.col("file").alias("trace_id"), "pos", "i", *call(
        tool_name=F.col("name"), status=status, call_id=F.col("id"), input=F.col("input"), output=F.col("out"), error=F.when(F.col("bad"), F.col("out")), tool_type=F.lit("tool"), turn_index=F.col("turn"), agent_name=F.col("agent"), state_delta=edits(F.col("name"), F.col("input"), status, F.col("cwd")),
    ))
    thought = blocks.where(get(b, "$.type") == "thinking").groupBy(F.col("file").alias("trace_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", get(b, "$.thinking").alias("t")))), lambda x: x["t"]).alias("reasoning"))
    limits = F.count_if(F.col("kind") == "rate_limit_event").alias("rate_limit_events")
    traces = _first_last(d, {"prompt": (F.col("kind") == "user", F.when(F.schema_of_variant(get(v, "$.message.content", "variant")) == "STRING", get(v, "$.message.content"))), "trial_id": (F.lit(True), get(v, "$.session_id"))}, {"_said": (F.col("kind") == "assistant", first_text(content_text(v, "$.message.content")))}, limits)
    traces = traces.join(result, "trace_id", "left").join(thought, "trace_id", "left").select(
        "trace_id", F.coalesce("trial_id", "trace_id").alias("trial_id"), F.col("trial_id").alias("task_id"), "prompt", first_text(get(r, "$.result"), F.col("_said")).alias("answer"), get(r, "$.duration_ms", "double").alias("duration_ms"), "reasoning",
        F.lit("claude").alias("source_format"), F.lit(True).alias("supports_outcome"), F.to_json(F.struct(get(r, "$.num_turns", "int").alias("num_turns"), "rate_limit_events")).alias("metadata"),
    )
    return assemble(llm.unionByName(tools), traces, "pos", "i")


# --- ATIF ----------------------------------------------------------------------------------------------------------


def parse_atif(values: DataFrame, max_depth: int = 8) -> DataFrame:
    """ATIF trajectories: steps are turns, observations join calls, embedded sub-agents stand at the turn that calls them."""
    v = F.col("v")
    top = values.where(get(v, "$.schema_version").startswith("ATIF")).select(F.col("file").alias("trace_id"), "v", F.lit(None).cast("string").alias("agent"), F.array(F.lit(0)).alias("at"), F.array(F.coalesce(get(v, "$.session_id"), F.lit(""))).alias("seen"))
    levels, level = [top], top
    for _ in range(max_depth):
        subs = level.where(F.size(items(v, "$.subagent_trajectories")) > 0).select("trace_id", "at", "seen", F.posexplode(items(v, "$.steps")).alias("n", "s"), items(v, "$.subagent_trajectories").alias("embedded"))
        refs = subs.select("trace_id", F.concat("at", F.array(F.col("n"))).alias("at"), "seen", "embedded", F.explode(F.flatten(F.transform(items(F.col("s"), "$.observation.results"), lambda o: F.coalesce(F.try_variant_get(o, "$.subagent_trajectory_ref", "array<variant>"), F.array().cast("array<variant>"))))).alias("ref"))
        refs = refs.withColumn("id", get(F.col("ref"), "$.session_id")).where(~F.array_contains("seen", F.col("id")))
        down = refs.select("trace_id", "at", F.concat("seen", F.array("id")).alias("seen"), F.explode(F.filter("embedded", lambda e: F.try_variant_get(e, "$.session_id", "string") == F.col("id"))).alias("v"))
        level = down.select("trace_id", "v", get(v, "$.agent.name").alias("agent"), "at", "seen")
        if level.limit(1).count() == 0:  # one job over all partitions; take() would go through them in turns
            break
        levels.append(level)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    s = F.col("s")
    steps = every.select("trace_id", "agent", "at", get(v, "$.agent.model_name").alias("default_model"), F.posexplode(items(v, "$.steps")).alias("n", "s")).where(~F.coalesce(get(s, "$.is_copied_context", "boolean"), F.lit(False)))
    steps = steps.withColumns({"at": F.concat("at", F.array(F.col("n"))), "source": get(s, "$.source"), "turn": get(s, "$.step_id", "int"), "ts": _stamp(get(s, "$.timestamp"))})
    cached = F.coalesce(get(s, "$.metrics.cached_tokens", "long"), F.lit(0))
    said = steps.where((F.col("source") == "agent") & (F.coalesce(get(s, "$.llm_call_count", "int"), F.lit(1)) != 0))
    llm = said.select("trace_id", "at", F.lit(-1).alias("i"), *call(
        tool_name=F.lit("llm.generation"), ts=F.col("ts"), output=content_text(s, "$.message"), cost_usd=get(s, "$.metrics.cost_usd", "double"), input_tokens=floored(get(s, "$.metrics.prompt_tokens", "long") - cached), output_tokens=get(s, "$.metrics.completion_tokens", "long"),
        cached_tokens=cached, tool_type=F.lit("llm"), turn_index=F.col("turn"), agent_name=F.col("agent"), model=F.coalesce(get(s, "$.model_name"), "default_model"),
    ))
    b = F.col("b")
    asked = steps.select("trace_id", "at", "agent", "turn", "ts", "s", F.posexplode(items(s, "$.tool_calls")).alias("i", "b")).select("trace_id", "at", "i", "agent", "turn", "ts", get(b, "$.tool_call_id").alias("id"), get(b, "$.function_name").alias("name"), F.to_json(get(b, "$.arguments", "variant")).alias("input"))
    seen = steps.select("trace_id", "at", F.posexplode(items(s, "$.observation.results")).alias("k", "b")).select("trace_id", "at", "k", get(b, "$.source_call_id").alias("id"), content_text(b, "$.content").alias("out"))
    seen = seen.groupBy("trace_id", "at", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "out"))), lambda x: x["out"]), "\n").alias("out"))
    tools = asked.join(merged(seen), ["trace_id", "at", "id"], "left").select("trace_id", "at", "i", *call(tool_name=F.col("name"), ts=F.col("ts"), call_id=F.col("id"), input=F.col("input"), output=F.col("out"), tool_type=F.lit("tool"), turn_index=F.col("turn"), agent_name=F.col("agent")))
    root = steps.where(F.size("at") == 2)
    ends = root.groupBy("trace_id").agg(
        F.min("ts").alias("started"), ((F.max("ts") - F.min("ts")) * 1000).alias("duration_ms"), F.min_by(content_text(s, "$.message"), F.when(F.col("source") == "user", F.col("n"))).alias("prompt"), F.max_by(first_text(content_text(s, "$.message")), F.when((F.col("source") == "agent") & first_text(content_text(s, "$.message")).isNotNull(), F.col("n"))).alias("answer"),
        F.filter(F.transform(F.array_sort(F.collect_list(F.struct("n", get(s, "$.reasoning_content").alias("t")))), lambda x: x["t"]), lambda x: x.isNotNull()).alias("reasoning"),
    )
    traces = top.select("trace_id", get(v, "$.session_id").alias("trial_id"), get(v, "$.session_id").alias("task_id"), F.to_json(F.struct(get(v, "$.agent.name").alias("agent"), get(v, "$.agent.version").alias("version"))).alias("metadata")).join(merged(ends), "trace_id", "left")
    return assemble(llm.unionByName(tools), traces.withColumns({"source_format": F.lit("atif"), "supports_outcome": F.lit(True)}), "at", "i")


# --- readers -------------------------------------------------------------------------------------------------------


def read_pi(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    return parse_pi(json_lines(whole_files(spark, path)), active_only)


def read_pi_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse_pi_stream(json_lines(whole_files(spark, path)))


def read_codex(spark: SparkSession, path: str) -> DataFrame:
    return parse_codex(json_lines(whole_files(spark, path)))


def read_claude(spark: SparkSession, path: str) -> DataFrame:
    return parse_claude(json_values(whole_files(spark, path)))


def read_atif(spark: SparkSession, path: str) -> DataFrame:
    return parse_atif(json_values(whole_files(spark, path, recursive=True)))
