"""The synthetic tables seen as traces, trials, cases, grades and runs.

Each view is a DataFrame and the DuckDB query that defines it, so that the checks share one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_calls(spark, sf_dir) -> DataFrame:
    """events: a user's day is a trial, an event is a tool call."""
    e = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    nth = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return e.withColumn("day", day).select(
        F.col("user_id").alias("case_id"), "day", F.concat_ws("@", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("trial_id"), nth.alias("pos"),
        F.col("event_type").alias("tool_name"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("value").alias("duration_ms"), F.col("props").alias("input"), F.col("ts"),
    )


CALLS = """calls AS (
  SELECT user_id AS case_id, CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS trial_id,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
         event_type AS tool_name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
         value AS duration_ms, props AS input, ts
  FROM events)"""


def trials(spark, sf_dir) -> DataFrame:
    """Trials of tool_calls; a day of one call is a harness error."""
    d = tool_calls(spark, sf_dir).groupBy("case_id", "day", "trial_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("duration_ms").alias("duration_ms"))
    return d.select(
        "case_id", "trial_id", F.row_number().over(Window.partitionBy("case_id").orderBy("day")).alias("trial_number"), (F.col("errors") == 0).alias("passed"),
        (1 - F.col("errors") / F.col("calls")).alias("score"), F.when(F.col("calls") == 1, "harness").alias("error"), "duration_ms", "calls", "errors",
    )


TRIALS = (
    CALLS
    + """, trials AS (
  SELECT case_id, trial_id, row_number() OVER (PARTITION BY case_id ORDER BY day) AS trial_number, errors = 0 AS passed,
         1 - errors / calls AS score, CASE WHEN calls = 1 THEN 'harness' END AS error, duration_ms, calls, errors
  FROM (SELECT case_id, day, trial_id, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, sum(duration_ms) AS duration_ms
        FROM calls GROUP BY ALL))"""
)


def transcripts(spark, sf_dir) -> DataFrame:
    """One row per trial with its calls in order as an array of structs."""
    c = tool_calls(spark, sf_dir)
    call = F.struct(
        "pos", "tool_name", "status", "duration_ms", "input", F.when(F.col("tool_name") == "view", F.concat(F.lit('{"v": '), F.floor("duration_ms").cast("string"), F.lit("}"))).alias("output"),
        (F.col("duration_ms") / 1000).alias("cost_usd"), F.floor("duration_ms").cast("long").alias("tokens"), F.lit(1).cast("long").alias("cached_tokens"),
        F.when(F.col("tool_name") == "signup", "llm").alias("tool_type"),
        F.when(F.col("tool_name") == "purchase", F.array(F.struct(F.lit("file").alias("kind"), F.when(F.col("duration_ms") > 100, "create").otherwise("update").alias("op"), F.concat(F.lit("out/"), F.col("case_id").cast("string"), F.lit(".txt")).alias("target")))).alias("state_delta"),
    )
    return c.groupBy("case_id", "trial_id").agg(F.array_sort(F.collect_list(call)).alias("tool_calls"))


def grades(spark, sf_dir) -> DataFrame:
    """lineitem: an order is a case with one trial, a line is a grader's result."""
    li = read(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    score = F.when(F.col("l_tax") != 0.08, F.least(F.lit(1.0), F.col("l_discount") * 10))
    return li.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_orderkey").alias("trial_id"), nth.alias("pos"), F.concat(F.lit("g"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("").alias("label"),
        score.alias("score"), (score >= 0.5).alias("passed"), (F.col("l_quantity") - 10).alias("weight"), (F.col("l_linestatus") == "F").alias("required"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("gate"),
        (F.col("l_tax") == 0).alias("skipped"), F.element_at(F.create_map(*[F.lit(x) for x in ("A", "transcript", "N", "outcome", "R", "both")]), F.col("l_returnflag")).alias("grader_scope"),
        F.array(F.concat(F.lit("flag_"), F.col("l_returnflag")), F.concat(F.lit("month_"), F.month("l_shipdate").cast("string"))).alias("failure_tags"), F.array(F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"))).alias("tags"),
    )


GRADES = """grades AS (
  SELECT l_orderkey AS case_id, l_orderkey AS trial_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos,
         'g' || CAST(l_linenumber AS VARCHAR) AS name,
         CASE WHEN l_tax <> 0.08 THEN least(1.0::DOUBLE, l_discount * 10) END AS score,
         CASE WHEN l_tax <> 0.08 THEN least(1.0::DOUBLE, l_discount * 10) END >= 0.5 AS passed,
         l_quantity - 10 AS weight, l_linestatus = 'F' AS required, l_returnflag = 'R' AND l_linenumber = 7 AS gate, l_tax = 0 AS skipped,
         CASE l_returnflag WHEN 'A' THEN 'transcript' WHEN 'N' THEN 'outcome' ELSE 'both' END AS grader_scope,
         ['flag_' || l_returnflag, 'month_' || CAST(month(l_shipdate) AS VARCHAR)] AS failure_tags, ['line_' || CAST(l_linenumber AS VARCHAR)] AS tags
  FROM lineitem)"""


def cases(spark, sf_dir) -> DataFrame:
    """documents with labels: a document is a case, its language a category, its source a tag; unlabelled: error."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    d = d.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "error").when((F.col("quality") == 1) & (F.col("toxic") == 0), "passed").otherwise("failed")
    score = F.coalesce(0.7 * F.col("quality") + 0.3 * (1 - F.col("toxic")), F.lit(0.0))
    return d.select(
        F.col("doc_id").alias("case_id"), status.alias("status"), (status == "passed").alias("passed"), score.alias("overall_score"), F.greatest(score, F.lit(0.25)).alias("best_score"),
        F.col("n_chars").cast("double").alias("duration_ms"), F.col("lang").alias("category"), F.array("source", F.concat(F.lit("len"), F.length(F.col("n_chars").cast("string")).cast("string"))).alias("tags"),
    )


CASES = """cases AS (
  SELECT doc_id AS case_id, status, status = 'passed' AS passed, score AS overall_score, greatest(score, 0.25) AS best_score,
         CAST(n_chars AS DOUBLE) AS duration_ms, lang AS category, [source, 'len' || length(CAST(n_chars AS VARCHAR))] AS tags
  FROM (SELECT d.*, CASE WHEN quality IS NULL THEN 'error' WHEN quality = 1 AND toxic = 0 THEN 'passed' ELSE 'failed' END AS status,
               coalesce(0.7::DOUBLE * quality + 0.3::DOUBLE * (1 - toxic), 0.0::DOUBLE) AS score
        FROM documents d LEFT JOIN labels l USING (doc_id)))"""


def grade_cases(spark, sf_dir) -> DataFrame:
    """Cases of ``grades``: an order passes where none of its live lines fails."""
    live = grades(spark, sf_dir).where("NOT skipped")
    d = live.groupBy("case_id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall_score"))
    return d.withColumn("status", F.when(F.col("passed"), "passed").otherwise("failed"))


GRADE_CASES = (
    GRADES
    + """, cases AS (
  SELECT case_id, passed, overall_score, CASE WHEN passed THEN 'passed' ELSE 'failed' END AS status
  FROM (SELECT case_id, bool_and(coalesce(passed, FALSE)) AS passed, coalesce(avg(score), 0.0) AS overall_score
        FROM grades WHERE NOT skipped GROUP BY case_id))"""
)


def run_records(spark, sf_dir, status: str) -> DataFrame:
    """orders of one status as a run: a customer is a case."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
    d = o.groupBy(F.col("o_custkey").alias("case_id")).agg((F.avg("o_totalprice") / 500000).alias("score"), F.count(F.lit(1)).alias("n"))
    return d.withColumn("passed", F.col("score") >= 0.5)


RUNS = """rec AS (SELECT o_orderstatus AS run, o_custkey AS case_id, avg(o_totalprice) / 500000 AS score, count(*) AS n, avg(o_totalprice) / 500000 >= 0.5 AS passed
  FROM orders GROUP BY ALL), a AS (SELECT * FROM rec WHERE run = 'F'), b AS (SELECT * FROM rec WHERE run = 'O')"""
