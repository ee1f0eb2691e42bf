"""The nested record of a trace, as Spark DDL, and how calls are put together into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .functions.partitions import merged

STATE_CHANGE = "struct<kind:string,op:string,target:string,before:string,after:string>"
CALL_FIELDS = {
    "tool_name": "string", "status": "string", "duration_ms": "double", "ts": "double", "call_id": "string", "input": "string", "output": "string", "error": "string",
    "cost_usd": "double", "input_tokens": "long", "output_tokens": "long", "tokens": "long", "cached_tokens": "long", "tool_type": "string", "turn_index": "int",
    "agent_name": "string", "model": "string", "state_delta": f"array<{STATE_CHANGE}>",
}
CALL = "struct<pos:long," + ",".join(f"{k}:{t}" for k, t in CALL_FIELDS.items()) + ">"
TRACE_FIELDS = {
    "trace_id": "string", "task_id": "string", "trial_id": "string", "run_id": "string", "source_format": "string", "prompt": "string", "answer": "string",
    "started": "double", "duration_ms": "double", "tool_calls": f"array<{CALL}>", "reasoning": "array<string>", "supports_outcome": "boolean", "metadata": "string",
    "blocked": "boolean", "error": "string",
}


def get(v: Column, path: str, kind: str = "string") -> Column:
    """A value out of a variant; null where it is missing or of another type."""
    return F.try_variant_get(v, path, kind)


def items(v: Column, path: str) -> Column:
    """An array of variants out of a variant; empty where it is missing."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def floored(x: Column) -> Column:
    """``x``, at least 0; null stays null."""
    return F.when(x < 0, 0).otherwise(x)


def call(**fields: Column) -> list[Column]:
    """The columns of one call per row, missing fields null, with the rules that hold for every format.

    A total of 0 or none is the sum of its parts; an ok call with an error is an error.
    """
    c = {k: fields.get(k, F.lit(None)).cast(t) for k, t in CALL_FIELDS.items()}
    parts = F.coalesce(c["input_tokens"], F.lit(0)) + F.coalesce(c["output_tokens"], F.lit(0)) + F.coalesce(c["cached_tokens"], F.lit(0))
    any_part = c["input_tokens"].isNotNull() | c["output_tokens"].isNotNull()
    c["tokens"] = F.when(F.coalesce(c["tokens"], F.lit(0)) == 0, F.when(any_part, parts)).otherwise(c["tokens"])
    status = F.coalesce(F.nullif(c["status"], F.lit("")), F.lit("ok"))
    c["status"] = F.when(c["error"].isNotNull() & (status == "ok"), "error").otherwise(status)
    return [x.alias(k) for k, x in c.items()]


def assemble(calls: DataFrame, traces: DataFrame, *order: str) -> DataFrame:
    """Traces with their calls, in order, as one array: ``calls`` has trace_id, the order columns and call fields."""
    key = F.struct(*order, *[F.col(k) for k in CALL_FIELDS])
    rows = calls.groupBy("trace_id").agg(F.array_sort(F.collect_list(key)).alias("_calls"))
    numbered = F.transform("_calls", lambda c, i: F.struct((i + 1).cast("long").alias("pos"), *[c[k].alias(k) for k in CALL_FIELDS]))
    d = traces.join(merged(rows.select("trace_id", numbered.alias("tool_calls"))), "trace_id", "left")
    d = d.withColumn("tool_calls", F.coalesce("tool_calls", F.array().cast(f"array<{CALL}>")))
    return d.select(*[(F.col(k) if k in d.columns else F.lit(None)).cast(t).alias(k) for k, t in TRACE_FIELDS.items()])


def explode_calls(traces: DataFrame) -> DataFrame:
    """One row per call with its trace's ids."""
    return traces.select("trace_id", "task_id", "trial_id", F.explode("tool_calls").alias("c")).select("trace_id", "task_id", "trial_id", "c.*")


def explode_state(traces: DataFrame) -> DataFrame:
    """One row per state change."""
    return explode_calls(traces).select("trace_id", "pos", "call_id", F.explode("state_delta").alias("s")).select("trace_id", "pos", "call_id", "s.*")
