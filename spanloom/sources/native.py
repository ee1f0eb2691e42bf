"""Native traces: JSON documents and JSONL event logs, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schemas import CALL_FIELDS, assemble, call, first_text, get, items
from .files import json_lines, json_values, whole_files

# The order of event types at one time.
EVENT_ORDER = ("transcript.started", "tool_call.started", "tool_call.completed", "reasoning.step", "outcome.set", "transcript.completed")


def _error(v: Column, path: str) -> Column:
    return first_text(get(v, f"{path}.message"), get(v, path))


def _changes(v: Column, path: str) -> Column:
    return F.transform(items(v, path), lambda s: F.struct(*[F.try_variant_get(s, f"$.{k}", "string").alias(k) for k in ("kind", "op", "target", "before", "after")]))


def _call_fields(v: Column) -> list[Column]:
    """A call's fields, legacy names accepted."""
    return call(
        tool_name=first_text(get(v, "$.tool_name"), get(v, "$.tool")), status=get(v, "$.status"), duration_ms=get(v, "$.duration_ms", "double"), ts=F.coalesce(get(v, "$.timestamp", "double"), get(v, "$.ts", "double")), call_id=get(v, "$.call_id"),
        input=F.coalesce(get(v, "$.input"), get(v, "$.args")), output=F.coalesce(get(v, "$.output"), get(v, "$.result")), error=_error(v, "$.error"), cost_usd=get(v, "$.cost.total_usd", "double"),
        input_tokens=get(v, "$.tokens.input_tokens", "long"), output_tokens=get(v, "$.tokens.output_tokens", "long"), tokens=get(v, "$.tokens.total_tokens", "long"),
        cached_tokens=F.coalesce(get(v, "$.tokens.cache_read_tokens", "long"), F.lit(0)) + F.coalesce(get(v, "$.tokens.cache_creation_tokens", "long"), F.lit(0)),
        tool_type=get(v, "$.tool_type"), turn_index=F.coalesce(get(v, "$.turn_index", "int"), get(v, "$.metadata.turn_index", "int")), agent_name=F.coalesce(get(v, "$.agent_name"), get(v, "$.metadata.agent_name")),
        model=get(v, "$.metadata.model"), state_delta=_changes(v, "$.state_delta"),
    )


def _answer(v: Column) -> Column:
    """The final output if it is a text, else the first text artifact's content."""
    texts = F.filter(items(v, "$.outcome.artifacts"), lambda a: (F.try_variant_get(a, "$.artifact_type", "string") == "text") | (F.try_variant_get(a, "$.type", "string") == "text"))
    final = get(v, "$.outcome.output_data.final_output", "variant")
    return first_text(F.when(F.schema_of_variant(final) == "STRING", get(v, "$.outcome.output_data.final_output")), F.try_variant_get(F.get(texts, F.lit(0)), "$.content", "string"))


def parse_native(values: DataFrame) -> DataFrame:
    """Traces from ``(file, pos, v)``; values without task_id and trial_id are no traces."""
    v = F.col("v")
    d = values.where(get(v, "$.task_id").isNotNull() & get(v, "$.trial_id").isNotNull()).withColumn("trace_id", F.concat_ws("#", "file", F.col("pos").cast("string")))
    calls = d.select("trace_id", F.posexplode(items(v, "$.tool_calls")).alias("i", "c")).select("trace_id", "i", *_call_fields(F.col("c")))
    traces = d.select(
        "trace_id", get(v, "$.task_id").alias("task_id"), get(v, "$.trial_id").alias("trial_id"), get(v, "$.run_id").alias("run_id"), F.lit("native").alias("source_format"), get(v, "$.input.prompt").alias("prompt"), _answer(v).alias("answer"),
        F.unix_micros(F.try_to_timestamp(get(v, "$.timing.start_time"))).cast("double").alias("_us"), get(v, "$.timing.total_duration_ms", "double").alias("duration_ms"), F.try_variant_get(v, "$.reasoning_steps", "array<string>").alias("reasoning"),
        F.lit(True).alias("supports_outcome"), F.to_json(get(v, "$.metadata", "variant")).alias("metadata"), F.coalesce(get(v, "$.outcome.blocked", "boolean"), F.lit(False)).alias("blocked"), first_text(_error(v, "$.error"), get(v, "$.metadata.error")).alias("error"),
    ).withColumn("started", F.col("_us") / 1e6)
    return assemble(calls, traces, "i")


def read_native(spark: SparkSession, path: str) -> DataFrame:
    return parse_native(json_values(whole_files(spark, path)))


def parse_event_log(lines: DataFrame) -> DataFrame:
    """Traces from the events ``(file, pos, v)`` of JSONL logs.

    A completed call takes its input from the last start of its id; of other events the first counts; outputs
    of the outcome are not in the log, so it can't support outcome graders.
    """
    v, kind = F.col("v"), get(F.col("v"), "$.type")
    d = lines.withColumn("kind", kind).withColumn("trace_id", F.col("file"))
    first = lambda k, path, t="string": F.min_by(F.when(F.col("kind") == k, get(v, path, t)), F.when(F.col("kind") == k, F.col("pos")))
    traces = d.groupBy("trace_id").agg(
        first("transcript.started", "$.task_id").alias("task_id"), first("transcript.started", "$.trial_id").alias("trial_id"), first("transcript.started", "$.run_id").alias("run_id"), first("transcript.started", "$.input.prompt").alias("prompt"),
        first("transcript.started", "$.ts", "double").alias("started"), first("transcript.completed", "$.total_duration_ms", "double").alias("duration_ms"), F.coalesce(first("outcome.set", "$.blocked", "boolean"), F.lit(False)).alias("blocked"), F.min_by("kind", "pos").alias("_head"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "reasoning.step", F.struct(get(v, "$.index", "long").alias("i"), "pos", get(v, "$.step").alias("step"))))).alias("_steps"),
    )
    traces = traces.where("_head = 'transcript.started'").withColumns({"reasoning": F.transform("_steps", lambda s: s["step"]), "source_format": F.lit("event_log"), "supports_outcome": F.lit(False)})
    done = d.where("kind = 'tool_call.completed'").select("trace_id", "pos", get(v, "$.call_id").alias("id"), *_call_fields(v))
    last = F.row_number().over(Window.partitionBy("trace_id", "id").orderBy(F.desc("pos")))
    begun = d.where("kind = 'tool_call.started'").select("trace_id", "pos", get(v, "$.call_id").alias("id"), get(v, "$.tool_name").alias("s_name"), get(v, "$.tool_type").alias("s_type"), get(v, "$.input").alias("s_input"), get(v, "$.ts", "double").alias("s_ts"), get(v, "$.turn_index", "int").alias("s_turn"), get(v, "$.agent_name").alias("s_agent"))
    begun = begun.withColumn("_n", last).where("_n = 1").drop("_n", "pos")
    calls = done.join(begun, ["trace_id", "id"], "left").withColumns({
        "tool_name": F.coalesce("tool_name", "s_name"), "tool_type": F.coalesce("s_type", "tool_type"), "input": F.coalesce("s_input", "input"), "ts": F.coalesce("s_ts", "ts"), "turn_index": F.coalesce("s_turn", "turn_index"), "agent_name": F.coalesce("s_agent", "agent_name"),
    })
    return assemble(calls, traces, "pos")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_log(json_lines(whole_files(spark, path)))


def events(traces: DataFrame) -> DataFrame:
    """(trace_id, seq, line): the JSONL event log of each trace, ordered by time, then kind, then place."""
    t = F.coalesce("started", F.lit(0.0))
    js = lambda *c: F.to_json(F.struct(*c))
    row = lambda ts, kind, pos, line: F.struct(ts.alias("ts"), F.lit(EVENT_ORDER.index(kind)).alias("kind"), pos.cast("long").alias("pos"), line.alias("line"))
    name = lambda k: F.lit(k).alias("type")
    end = t + F.coalesce("duration_ms", F.lit(0.0)) / 1000
    begun = F.transform("tool_calls", lambda c: row(F.coalesce(c["ts"], t), "tool_call.started", c["pos"], js(name("tool_call.started"), F.coalesce(c["ts"], t).alias("ts"), *[c[k].alias(k) for k in ("call_id", "tool_name", "tool_type", "input", "turn_index", "agent_name")])))
    done = F.transform("tool_calls", lambda c: row(F.coalesce(c["ts"], t) + F.coalesce(c["duration_ms"], F.lit(0.0)) / 1000, "tool_call.completed", c["pos"], js(
        name("tool_call.completed"), (F.coalesce(c["ts"], t) + F.coalesce(c["duration_ms"], F.lit(0.0)) / 1000).alias("ts"), *[c[k].alias(k) for k in ("call_id", "tool_name", "status", "duration_ms", "output", "error", "state_delta")],
        F.struct(c["cost_usd"].alias("total_usd")).alias("cost"), F.struct(c["input_tokens"].alias("input_tokens"), c["output_tokens"].alias("output_tokens"), c["tokens"].alias("total_tokens"), c["cached_tokens"].alias("cache_read_tokens")).alias("tokens"))))
    steps = F.transform(F.coalesce("reasoning", F.array().cast("array<string>")), lambda s, i: row(t, "reasoning.step", i, js(name("reasoning.step"), t.alias("ts"), i.alias("index"), s.alias("step"))))
    one = F.array(
        row(t, "transcript.started", F.lit(0), js(name("transcript.started"), t.alias("ts"), "task_id", "trial_id", "run_id", F.struct("prompt").alias("input"))),
        row(end, "outcome.set", F.lit(0), js(name("outcome.set"), end.alias("ts"), F.coalesce("blocked", F.lit(False)).alias("blocked"))),
        row(end, "transcript.completed", F.lit(0), js(name("transcript.completed"), end.alias("ts"), F.col("duration_ms").alias("total_duration_ms"), F.size("tool_calls").alias("tool_call_count"))),
    )
    return traces.select("trace_id", F.posexplode(F.array_sort(F.concat(one, begun, done, steps))).alias("seq", "e")).select("trace_id", "seq", "e.line")


def write_native(traces: DataFrame, path: str) -> None:
    """One JSON document per trace and line, in a form that ``read_native`` takes."""
    calls = F.transform("tool_calls", lambda c: F.struct(
        *[c[k].alias(k) for k in CALL_FIELDS if k not in ("ts", "cost_usd", "input_tokens", "output_tokens", "tokens", "cached_tokens", "model")], c["ts"].alias("timestamp"), F.struct(c["cost_usd"].alias("total_usd")).alias("cost"),
        F.struct(c["input_tokens"].alias("input_tokens"), c["output_tokens"].alias("output_tokens"), c["tokens"].alias("total_tokens"), c["cached_tokens"].alias("cache_read_tokens")).alias("tokens"), F.struct(c["model"].alias("model")).alias("metadata")))
    traces.select(
        "task_id", "trial_id", "run_id", F.struct("prompt").alias("input"), calls.alias("tool_calls"), F.col("reasoning").alias("reasoning_steps"), F.struct(F.struct(F.col("answer").alias("final_output")).alias("output_data"), "blocked").alias("outcome"), "error",
        F.struct(F.timestamp_micros((F.col("started") * 1e6).cast("long")).cast("string").alias("start_time"), F.col("duration_ms").alias("total_duration_ms")).alias("timing"),
    ).write.json(path)


def write_event_log(traces: DataFrame, path: str) -> None:
    """JSONL logs, the events of a trace together and in order, a folder for each trace."""
    rows = events(traces).repartition("trace_id").sortWithinPartitions("trace_id", "seq")
    rows.select(F.regexp_replace("trace_id", r'[/\\:*?"<>|\s#]', "_").alias("trace"), "line").write.partitionBy("trace").text(path)
