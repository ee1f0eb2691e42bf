"""Queries that grade how agents worked, over the transcripts of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import process_graders as g
from . import views as v
from .registry import query
from .rollup_queries import rounded

_N = f"""WITH {v.CALLS}, t AS (SELECT trial_id, count(*) AS n, count(*) FILTER (status = 'error') AS errors, sum(duration_ms) AS dur, max(duration_ms) AS slowest,
  count(DISTINCT tool_name) AS tools, count(*) FILTER (tool_name = 'view') AS views, count(*) FILTER (tool_name = 'signup') AS signups, count(*) FILTER (tool_name = 'purchase') AS buys, sum(floor(duration_ms) - 1) AS tokens FROM calls GROUP BY 1)"""


def _graded(spark, sf_dir, grade, *more):
    d = v.transcripts(spark, sf_dir).select("trial_id", grade(F.col("tool_calls")).alias("g")).select("trial_id", "g.score", "g.passed", *[f"g.{m}" for m in more])
    return rounded(d, "score")


@query("q24_tool_usage", f"""{_N}, e AS (SELECT trial_id, max(k) AS worst FROM (SELECT trial_id, count(*) AS k FROM calls WHERE status = 'error' GROUP BY trial_id, input) GROUP BY 1),
  c AS (SELECT t.trial_id, n, tools, (views > 0)::INT + (signups = 0)::INT + (n <= 5)::INT + (coalesce(worst, 0) <= 3)::INT AS ok FROM t LEFT JOIN e USING (trial_id))
  SELECT trial_id, round(ok / 4, 6) AS score, ok = 4 AS passed, CAST(n AS INTEGER) AS tool_calls, CAST(tools AS INTEGER) AS distinct_tools FROM c""")
def q24(spark, sf_dir):
    return _graded(spark, sf_dir, lambda c: g.tool_usage(c, ["view"], ["signup"], 5), "tool_calls", "distinct_tools")


@query("q25_cost_budget", f"""{_N} SELECT trial_id, round(CASE WHEN dur / 1000 <= 0.25 AND tokens <= 200 THEN 1 - 0.5 * least(1, dur / 1000 / 0.25) ELSE 0 END, 6) AS score,
  dur / 1000 <= 0.25 AND tokens <= 200 AS passed, CAST(tokens AS BIGINT) AS budgeted_tokens FROM t""")
def q25(spark, sf_dir):
    return _graded(spark, sf_dir, lambda c: g.cost_budget(c, 0.25, 200), "budgeted_tokens")


@query("q26_latency_budget", f"""{_N}, s AS (SELECT trial_id, count(*) FILTER (duration_ms > 150) AS slow FROM calls GROUP BY 1)
  SELECT trial_id, round(CASE WHEN dur <= 300 AND slow = 0 THEN 1 - 0.5 * least(1, dur / 300) ELSE 0 END, 6) AS score, dur <= 300 AND slow = 0 AS passed, CAST(slow AS INTEGER) AS slow_calls FROM t JOIN s USING (trial_id)""")
def q26(spark, sf_dir):
    return _graded(spark, sf_dir, lambda c: g.latency_budget(c, None, 300, 150), "slow_calls")


@query("q27_efficiency", f"""{_N}, s AS (SELECT trial_id, ((buys > 0)::INT + (1 - errors / n) + CASE WHEN n / 2 <= 1.5 THEN 1 WHEN n / 2 <= 3 THEN 0.5 ELSE 0 END) / 3 AS score FROM t)
  SELECT trial_id, round(score, 6) AS score, score >= 0.5 AS passed FROM s""")
def q27(spark, sf_dir):
    return _graded(spark, sf_dir, lambda c: g.efficiency(c, F.exists(c, lambda x: x["tool_name"] == "purchase"), 2))


def _turns(name, scoring, expr):
    sql = f"{_N}, s AS (SELECT trial_id, {expr} AS score, n FROM t) SELECT trial_id, round(CAST(score AS DOUBLE), 6) AS score, score >= 0.7 AS passed, CAST(n AS INTEGER) AS turns FROM s"
    query(name, sql)(lambda spark, sf_dir: _graded(spark, sf_dir, lambda c: g.turn_count(c, 5, 2, scoring), "turns"))


_turns("q28a_turn_count_budget", "budget", "CASE WHEN n <= 5 THEN 1 ELSE 5 / n END")
_turns("q28b_turn_count_linear", "linear", "CASE WHEN n <= 2 THEN 1 WHEN n >= 5 THEN 0 ELSE 1 - (n - 2) / 3 END")
_turns("q28c_turn_count_log", "logarithmic", "CASE WHEN n <= 2 THEN 1 WHEN n >= 5 THEN 0 ELSE 1 - ln(n / 2) / ln(2.5) END")


def _loops(spark, sf_dir):
    d = v.transcripts(spark, sf_dir)
    grade = g.loop_detection(F.col("tool_calls"), 2, 1, 2, include_llm=True)
    return d.select("trial_id", grade.alias("g")).select("trial_id", "g.*")


@query("q29_loop_single", f"WITH {v.CALLS} SELECT trial_id, CAST(max(k) AS INTEGER) AS single_repeats FROM (SELECT trial_id, count(*) AS k FROM calls GROUP BY trial_id, tool_name) GROUP BY 1")
def q29(spark, sf_dir):
    return _loops(spark, sf_dir).select("trial_id", "single_repeats")


@query("q30_loop_exact", f"WITH {v.CALLS} SELECT trial_id, CAST(max(k) AS INTEGER) AS exact_repeats FROM (SELECT trial_id, count(*) AS k FROM calls GROUP BY trial_id, tool_name, input) GROUP BY 1")
def q30(spark, sf_dir):
    return _loops(spark, sf_dir).select("trial_id", "exact_repeats")


_SEQ = " UNION ALL ".join(
    f"""SELECT trial_id, max(r) AS most FROM (SELECT trial_id, pattern, arg_min(r, start) AS r FROM (
      SELECT trial_id, start, array_to_string(names[start + 1 : start + {k}], '→') AS pattern,
        1 + (SELECT count(*) FROM range(1, len(names) // {k}) x(j) WHERE start + (j + 1) * {k} <= len(names) AND
             (SELECT bool_and(names[start + 1 : start + {k}] = names[start + i * {k} + 1 : start + (i + 1) * {k}]) FROM range(1, j + 1) y(i))) AS r
      FROM (SELECT trial_id, names, unnest(range(0, greatest(0, len(names) - 2 * {k} + 1))) AS start FROM arr)) WHERE r >= 2 GROUP BY 1, 2) GROUP BY 1"""
    for k in range(2, 6)
)


@query("q31_loop_sequence", f"""WITH {v.CALLS}, arr AS (SELECT trial_id, list(tool_name ORDER BY pos) AS names FROM calls GROUP BY 1), m AS ({_SEQ})
  SELECT trial_id, CAST(coalesce(max(most), 0) AS INTEGER) AS sequence_repeats FROM arr LEFT JOIN m USING (trial_id) GROUP BY 1""")
def q31(spark, sf_dir):
    return _loops(spark, sf_dir).select("trial_id", "sequence_repeats")


@query("q32_output_repeat", f"""WITH {v.CALLS}, o AS (SELECT trial_id, max(k) AS k FROM (SELECT trial_id, count(*) AS k FROM calls WHERE tool_name = 'view' GROUP BY trial_id, floor(duration_ms)) GROUP BY 1)
  SELECT trial_id, CAST(coalesce(max(k), 0) AS INTEGER) AS output_repeats FROM calls LEFT JOIN o USING (trial_id) GROUP BY 1""")
def q32(spark, sf_dir):
    return _loops(spark, sf_dir).select("trial_id", "output_repeats")


@query("q33_self_correction", f"""WITH {v.CALLS}, w AS (SELECT *, lag(status) OVER o AS before, lag(tool_name) OVER o AS tool_before, lead(status) OVER o AS after FROM calls WINDOW o AS (PARTITION BY trial_id ORDER BY pos)),
  a AS (SELECT trial_id, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status <> 'error' AND before = 'error') AS recoveries, count(*) FILTER (tool_name = tool_before) AS retries,
    max(CASE WHEN after IS NULL AND status <> 'error' THEN 1 ELSE 0 END) AS final FROM w GROUP BY 1),
  s AS (SELECT *, (CASE WHEN errors > 0 THEN recoveries / errors ELSE 1 END + final + CASE WHEN retries <= 1 THEN 1 ELSE greatest(0, 1 - (retries - 1) / 1) END) / 3 AS score FROM a)
  SELECT trial_id, round(score, 6) AS score, score >= 0.6 AS passed, CAST(errors AS INTEGER) AS errors, CAST(recoveries AS INTEGER) AS recoveries, CAST(retries AS INTEGER) AS retries FROM s""")
def q33(spark, sf_dir):
    return _graded(spark, sf_dir, lambda c: g.self_correction(c, 1), "errors", "recoveries", "retries")


@query("q46_state_delta", f"""WITH {v.CALLS}, s AS (SELECT trial_id, count(*) FILTER (tool_name = 'purchase') AS n, count(*) FILTER (tool_name = 'purchase' AND duration_ms > 100) AS creates,
    bool_or(tool_name = 'purchase' AND case_id % 10 = 1) AS ones FROM calls GROUP BY 1), c AS (SELECT *, (creates = 0)::INT + coalesce(ones, FALSE)::INT + (n <= 1)::INT AS ok FROM s)
  SELECT trial_id, round(ok / 3, 6) AS score, ok = 3 AS passed, CAST(n AS INTEGER) AS changes FROM c""")
def q46(spark, sf_dir):
    return _graded(spark, sf_dir, lambda c: g.state_delta(c, forbid=[{"kind": "file", "op": "create"}], require=[{"target": "out/*1.txt"}], max_changes=1), "changes")
