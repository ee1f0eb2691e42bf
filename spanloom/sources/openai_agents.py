"""Spans of the OpenAI agents SDK, as JSON lines or live, to traces.

A span: trace_id, id, parent_id, started_at, ended_at, error, span_data {type, ...}.  Turn and agent spans give
context to what lies below them; handoffs become reasoning, guardrails metadata; function spans are tool calls,
generation and response spans model calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.partitions import cut, merged
from ..operators.lookups import nearest_ancestor
from ..schemas import assemble, call, first_text, floored, get
from .files import json_values, whole_files

# Span types that are model calls.
MODEL_SPANS = ("generation", "response")


def parse_openai_agents(values: DataFrame) -> DataFrame:
    """Traces of spans ``(file, pos, v)``; spans without ids are left out, of repeated ones the last counts."""
    v = F.col("v")
    d = values.select(
        "pos", get(v, "$.trace_id").alias("trace_id"), first_text(get(v, "$.id"), get(v, "$.span_id")).alias("id"), get(v, "$.parent_id").alias("parent"), F.to_json("v").alias("span"), get(v, "$.span_data.type").alias("kind"),
        (F.unix_micros(F.try_to_timestamp(get(v, "$.started_at"))) / 1e6).alias("start"), (F.unix_micros(F.try_to_timestamp(get(v, "$.ended_at"))) / 1e6).alias("end"),
    ).where("trace_id IS NOT NULL AND id IS NOT NULL")
    names = [c for c in d.columns if c not in ("trace_id", "id")]
    d = d.groupBy("trace_id", "id").agg(F.max_by(F.struct(*names), "pos").alias("x")).select("trace_id", "id", "x.*").withColumn("s", F.parse_json("span"))
    s, key = F.col("s"), F.concat_ws("/", "trace_id", "id")
    nodes = cut(d.select(key.alias("id"), F.when(F.col("parent").isNotNull(), F.concat_ws("/", "trace_id", "parent")).alias("parent"), "kind"))  # else every walk would parse the spans anew
    turn = nearest_ancestor(nodes, F.col("kind") == "turn").select(F.col("id").alias("_key"), F.col("ancestor").alias("_turn"))
    agent = nearest_ancestor(nodes, F.col("kind") == "agent").select(F.col("id").alias("_key"), F.col("ancestor").alias("_agent"))
    turns = d.where("kind = 'turn'").select(key.alias("_turn"), get(s, "$.span_data.turn", "int").alias("turn_index"), get(s, "$.span_data.agent_name").alias("turn_agent"))
    agents = d.where("kind = 'agent'").select(key.alias("_agent"), get(s, "$.span_data.name").alias("agent_name"))
    made = d.where(F.col("kind").isin(*MODEL_SPANS, "function")).withColumn("_key", key).join(merged(turn), "_key", "left").join(merged(agent), "_key", "left").join(merged(turns), "_turn", "left").join(merged(agents), "_agent", "left")
    is_model = F.col("kind") != "function"
    error = first_text(get(s, "$.error.message"), get(s, "$.error"))
    calls = made.select("trace_id", F.coalesce("start", F.lit(0.0)).alias("_start"), F.col("id").alias("_id"), *call(
        tool_name=F.when(is_model, F.concat(F.lit("llm."), F.col("kind"))).otherwise(first_text(get(s, "$.span_data.name"), F.lit("unknown_tool"))), duration_ms=floored((F.col("end") - F.col("start")) * 1000), ts=F.col("start"), call_id=F.col("id"),
        input=get(s, "$.span_data.input"), output=get(s, "$.span_data.output"), error=error, input_tokens=F.when(is_model, get(s, "$.span_data.usage.input_tokens", "long")), output_tokens=F.when(is_model, get(s, "$.span_data.usage.output_tokens", "long")),
        tool_type=F.when(is_model, "llm").when(get(s, "$.span_data.mcp_data", "variant").isNotNull(), "mcp").otherwise("function"), turn_index=F.col("turn_index"), agent_name=F.coalesce("turn_agent", "agent_name"), model=first_text(get(s, "$.span_data.model"), get(s, "$.span_data.response.model")),
    ))
    is_call = F.col("kind").isin(*MODEL_SPANS, "function")
    hand = F.when(F.col("kind") == "handoff", F.struct("start", F.concat(F.lit("Handoff: "), get(s, "$.span_data.from_agent"), F.lit(" -> "), get(s, "$.span_data.to_agent")).alias("t")))
    guard = F.when(F.col("kind") == "guardrail", F.struct(get(s, "$.span_data.name").alias("name"), F.coalesce(get(s, "$.span_data.triggered", "boolean"), F.lit(False)).alias("triggered")))
    output = get(s, "$.span_data.output")
    traces = d.groupBy("trace_id").agg(
        F.min(F.when(is_call, F.col("start"))).alias("started"), ((F.max(F.when(is_call, F.col("end"))) - F.min(F.when(is_call, F.col("start")))) * 1000).alias("duration_ms"),
        F.max_by(output, F.when(F.col("kind").isin(*MODEL_SPANS) & output.isNotNull(), F.struct("start", "id"))).alias("answer"), F.transform(F.array_sort(F.collect_list(hand)), lambda h: h["t"]).alias("reasoning"), F.to_json(F.struct(F.collect_list(guard).alias("guardrails"))).alias("metadata"),
    )
    traces = traces.withColumns({"trial_id": F.col("trace_id"), "task_id": F.col("trace_id"), "source_format": F.lit("openai_agents"), "supports_outcome": F.lit(True)})
    return assemble(calls, traces, "_start", "_id")


def read_openai_agents(spark: SparkSession, path: str) -> DataFrame:
    return parse_openai_agents(json_values(whole_files(spark, path)))
