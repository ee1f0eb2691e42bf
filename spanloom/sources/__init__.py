"""Readers of traces, results and scenarios.  ``read_traces`` tells formats apart file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import agents, native, openai_agents, otlp
from .files import detect, json_lines, json_values, whole_files

PARSERS = {
    "native": (native.parse_native, json_values), "event_log": (native.parse_event_log, json_lines), "otlp": (otlp.parse_otlp, json_values), "pi": (agents.parse_pi, json_lines),
    "pi_stream": (agents.parse_pi_stream, json_lines), "codex": (agents.parse_codex, json_lines), "claude": (agents.parse_claude, json_values), "atif": (agents.parse_atif, json_values),
    "openai_agents": (openai_agents.parse_openai_agents, json_values),
}


def read_traces(spark: SparkSession, path: str, fmt: str | None = None, recursive: bool = False) -> DataFrame:
    """Traces of a file or folder in one format, or in any mixture of them; files of no known format are left out."""
    files = whole_files(spark, path, recursive)
    if fmt:
        parse, values = PARSERS[fmt]
        return parse(values(files))
    known = files.withColumn("format", detect(F.col("content")))
    there, out = {r["format"] for r in known.select("format").distinct().collect()}, None
    for name, (parse, values) in PARSERS.items():
        if name in there:
            part = parse(values(known.where(F.col("format") == name).drop("format")))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else native.parse_native(json_values(files.limit(0)))
