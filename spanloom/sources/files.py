"""Text files as rows, and what format they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import get

SKIPPED = ("checkpoint.json", "manifest.json")


def whole_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, content) of text files; dotfiles, checkpoints and manifests are left out."""
    d = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    d = d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("_name"), F.col("value").alias("content"))
    return d.where(~F.col("_name").isin(*SKIPPED) & ~F.col("_name").startswith(".")).drop("_name")


def json_lines(files: DataFrame) -> DataFrame:
    """(file, pos, v): the JSON values of each line of ``files(file, content)``; lines that aren't JSON are skipped."""
    rows = files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line"))
    return rows.select("file", "pos", F.try_parse_json("line").alias("v")).where(F.col("v").isNotNull())


def json_values(files: DataFrame) -> DataFrame:
    """(file, pos, v): a file's one JSON value, the elements of its array, or the values of its lines."""
    rows = F.filter(F.split("content", "\r?\n"), lambda x: F.trim(x) != "")
    # a parser may stop after the first of many values, so a file of lines is told by its first line
    by_line = (F.size(rows) > 1) & F.try_parse_json(F.get(rows, F.lit(0))).isNotNull()
    whole = F.col("whole")
    parts = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>")).when(whole.isNotNull(), F.array(whole))
    lines = F.filter(F.transform(rows, lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    files = files.withColumn("whole", F.when(~by_line, F.try_parse_json("content")))  # parsed once
    return files.select("file", F.posexplode(F.when(by_line, lines).otherwise(F.coalesce(parts, lines))).alias("pos", "v"))


def detect(content: Column) -> Column:
    """The trace format of a file's content by its first JSON value."""
    whole = F.try_parse_json(content)
    head = F.coalesce(F.when(F.schema_of_variant(whole).startswith("ARRAY"), get(whole, "$[0]", "variant")).otherwise(whole), F.try_parse_json(F.substring_index(F.ltrim(content), "\n", 1)))
    kind = get(head, "$.type")
    has = lambda p: get(head, p, "variant").isNotNull()
    return (
        F.when(F.coalesce(get(head, "$.schema_version").startswith("ATIF"), F.lit(False)), "atif")
        .when(has("$.resourceSpans") | has("$.scopeSpans") | has("$.spans") | (has("$.traceId") & has("$.spanId")) | has("$.context.trace_id"), "otlp")
        .when((get(head, "$.object") == "trace.span") | has("$.span_data.type"), "openai_agents")
        .when(kind == "transcript.started", "event_log")
        .when(has("$.task_id") & has("$.trial_id"), "native")
        .when(kind == "session", "pi")
        .when(kind.isin("thread.started", "turn.started") | kind.startswith("item."), "codex")
        .when(kind.isin("message_end", "message_start", "agent_start"), "pi_stream")
        .when(kind.isin("system", "assistant", "user", "result"), "claude")
        .otherwise("unknown")
    )
