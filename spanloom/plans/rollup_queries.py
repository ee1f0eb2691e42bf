"""Queries over trials, grades, cases and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyze, compare as cmp, metrics, rollup
from . import views as v
from .registry import query


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- trial metrics -------------------------------------------------------------------------------------------------

_FINE = f"""WITH {v.TRIALS}, fine AS (SELECT * FROM trials WHERE error IS NULL), m AS (
  SELECT case_id, count(*) AS n, count(*) FILTER (passed) AS c, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std,
         min(score) AS lo, max(score) AS hi FROM fine GROUP BY case_id), allc AS (
  SELECT case_id, count(*) AS total, count(*) FILTER (error IS NOT NULL) AS errs FROM trials GROUP BY case_id)"""


def _metrics(spark, sf_dir):
    return metrics.trial_metrics(v.trials(spark, sf_dir))


@query("q01_trial_metrics", f"""{_FINE} SELECT a.case_id, CAST(total AS BIGINT) AS total_trials, CAST(errs AS BIGINT) AS error_trials,
  CAST(coalesce(n, 0) AS BIGINT) AS n_trials, CAST(coalesce(c, 0) AS BIGINT) AS n_passed, round(coalesce(c / n, 0), 6) AS pass_rate,
  round(mean, 6) AS score_mean, round(coalesce(std, 0), 6) AS score_std, round(lo, 6) AS score_min, round(hi, 6) AS score_max FROM allc a LEFT JOIN m USING (case_id)""")
def q01(spark, sf_dir):
    d = _metrics(spark, sf_dir).select("case_id", "total_trials", "error_trials", "n_trials", "n_passed", "pass_rate", "score_mean", "score_std", "score_min", "score_max")
    return rounded(d, "pass_rate", "score_mean", "score_std", "score_min", "score_max")


def _at_least_one(k):
    hit = " * ".join(f"((n - c - {i}) / (n - {i}))" for i in range(k))
    return f"CASE WHEN n < {k} THEN 1 - pow(1 - c / n, {k}) WHEN n - c < {k} THEN 1 ELSE 1 - {hit} END"


def _all_of(k):
    hit = " * ".join(f"((c - {i}) / (n - {i}))" for i in range(k))
    return f"CASE WHEN n < {k} THEN pow(c / n, {k}) WHEN c < {k} THEN 0 ELSE {hit} END"


@query("q02_pass_at_k", f"{_FINE} SELECT case_id, " + ", ".join(f"round(CAST({_at_least_one(k)} AS DOUBLE), 6) AS pass_at_{k}" for k in (1, 3, 5)) + " FROM m")
def q02(spark, sf_dir):
    d = _metrics(spark, sf_dir).where("n_trials > 0").select("case_id", "pass_at_1", "pass_at_3", "pass_at_5")
    return rounded(d, "pass_at_1", "pass_at_3", "pass_at_5")


@query("q03_pass_all_k", f"{_FINE} SELECT case_id, " + ", ".join(f"round(CAST({_all_of(k)} AS DOUBLE), 6) AS pass_all_{k}" for k in (1, 3, 5)) + " FROM m")
def q03(spark, sf_dir):
    d = _metrics(spark, sf_dir).where("n_trials > 0").select("case_id", "pass_all_1", "pass_all_3", "pass_all_5")
    return rounded(d, "pass_all_1", "pass_all_3", "pass_all_5")


@query("q04_consistency", f"""{_FINE} SELECT case_id, round(CASE WHEN n < 2 OR std = 0 THEN 1 WHEN mean = 0 THEN 0 ELSE exp(-std / mean) END, 6) AS consistency FROM m""")
def q04(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir).where("n_trials > 0").select("case_id", "consistency"), "consistency")


@query("q05_best_of_k", f"""{_FINE}, o AS (SELECT case_id, score, row_number() OVER (PARTITION BY case_id ORDER BY trial_number) AS i FROM fine)
  SELECT case_id, round(max(score), 6) AS best_of_3 FROM o WHERE i <= 3 GROUP BY case_id""")
def q05(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir).where("n_trials > 0").select("case_id", "best_of_3"), "best_of_3")


# --- grades, cases, runs -------------------------------------------------------------------------------------------

_ROLL = f"""WITH {v.GRADES}, act AS (SELECT * FROM grades WHERE NOT skipped), r AS (
  SELECT trial_id, count(*) AS active, count(*) FILTER (NOT gate AND score IS NOT NULL) AS scored, count(*) FILTER (gate) AS gates,
    coalesce(bool_and(coalesce(passed, FALSE)) FILTER (gate), TRUE) AS gates_pass,
    coalesce(bool_and(coalesce(passed, FALSE)) FILTER (NOT gate AND required), TRUE) AS required_pass, bool_and(score IS NOT NULL) AS all_scored,
    sum(score * weight) FILTER (NOT gate AND score IS NOT NULL) AS weighted, sum(weight) FILTER (NOT gate AND score IS NOT NULL AND weight > 0) AS weights,
    avg(score) FILTER (NOT gate AND score IS NOT NULL) AS plain,
    coalesce(arg_min(coalesce(passed, FALSE), pos) FILTER (NOT gate AND name = 'g3'), TRUE) AS named_pass
  FROM act GROUP BY trial_id), s AS (
  SELECT *, CASE WHEN weights > 0 THEN weighted / weights WHEN scored > 0 THEN plain WHEN gates > 0 AND gates = active AND gates_pass THEN 1.0 ELSE 0.0 END AS score FROM r)"""


@query("q06_grade_rollup_weighted", f"""{_ROLL} SELECT trial_id, CAST(active AS BIGINT) AS active_graders, CAST(scored AS BIGINT) AS scored_graders,
  CAST(gates AS BIGINT) AS gates, round(score, 6) AS score FROM s""")
def q06(spark, sf_dir):
    return rounded(rollup.grade_rollup(v.grades(spark, sf_dir)).drop("passed"), "score")


@query("q07_required_and_gate", f"""{_ROLL} SELECT trial_id, gates_pass AND required_pass AND named_pass AND all_scored AND (scored = 0 OR score >= 0.4) AS passed FROM s""")
def q07(spark, sf_dir):
    return rollup.grade_rollup(v.grades(spark, sf_dir), 0.4, ["g3"]).select("trial_id", "passed")


@query("q08_negative_inversion", f"""WITH {v.TRIALS} SELECT trial_id, CASE WHEN case_id % 5 = 0 THEN 'fail' ELSE 'pass' END AS expect,
  CASE WHEN case_id % 5 = 0 THEN calls > 4 OR NOT passed ELSE passed END AS passed FROM trials""")
def q08(spark, sf_dir):
    t = v.trials(spark, sf_dir).withColumns({"expect": F.when(F.col("case_id") % 5 == 0, "fail").otherwise("pass"), "blocked": F.col("calls") > 4})
    return rollup.invert_negative(t).select("trial_id", "expect", "passed")


_CASE = f"""WITH {v.TRIALS}, c AS (SELECT case_id, count(*) AS total, count(*) FILTER (error IS NOT NULL) AS errs, count(*) FILTER (error IS NULL AND passed) AS ok,
  coalesce(avg(score) FILTER (error IS NULL), 0) AS overall, coalesce(max(score) FILTER (error IS NULL), 0) AS best, sum(duration_ms) AS dur FROM trials GROUP BY case_id),
  cs AS (SELECT *, CASE WHEN total = errs THEN 'error' WHEN 2 * ok >= total - errs THEN 'passed' ELSE 'failed' END AS status FROM c)"""


@query("q09_run_rollup", f"""{_CASE} SELECT CAST(case_id % 4 AS BIGINT) AS run, count(*) AS total_cases, count(*) FILTER (status = 'passed') AS passed_cases,
  count(*) FILTER (status = 'failed') AS failed_cases, count(*) FILTER (status = 'error') AS error_cases, count(*) FILTER (status <> 'error') AS evaluated_cases,
  round(coalesce(avg(overall) FILTER (status <> 'error'), 0), 6) AS average_score, round(coalesce(avg(best) FILTER (status <> 'error'), 0), 6) AS best_of_k_score,
  round(sum(dur), 3) AS duration_ms, round(coalesce(count(*) FILTER (status = 'passed') / count(*) FILTER (status <> 'error'), 0), 6) AS pass_rate FROM cs GROUP BY 1""")
def q09(spark, sf_dir):
    c = rollup.case_rollup(v.trials(spark, sf_dir)).withColumn("run", F.col("case_id") % 4)
    return rounded(rounded(rollup.run_rollup(c, "run"), "average_score", "best_of_k_score", "pass_rate"), "duration_ms", digits=3)


@query("q09b_case_rollup", f"""{_CASE} SELECT case_id, total AS total_trials, errs AS error_trials, ok AS passed_trials, round(overall, 6) AS overall_score, round(best, 6) AS best_score,
  status, status = 'passed' AS passed FROM cs""")
def q09b(spark, sf_dir):
    d = rollup.case_rollup(v.trials(spark, sf_dir)).select("case_id", "total_trials", "error_trials", "passed_trials", "overall_score", "best_score", "status", "passed")
    return rounded(d, "overall_score", "best_score")


def _breakdown(key, name):
    return f"""SELECT {key} AS {name}, count(*) AS cases, count(*) FILTER (status = 'passed') AS passed_cases,
  round(avg(CASE WHEN status = 'passed' THEN 1.0 ELSE 0 END), 6) AS pass_rate, round(avg(overall_score), 6) AS average_score"""


@query("q10_category_rows", f"WITH {v.CASES} {_breakdown('category', 'category')} FROM cases WHERE status <> 'error' AND category <> '' GROUP BY 1")
def q10(spark, sf_dir):
    return rounded(analyze.breakdown(v.cases(spark, sf_dir), F.col("category"), "category"), "pass_rate", "average_score")


@query("q11_tag_rows", f"WITH {v.CASES} {_breakdown('tag', 'tag')} FROM (SELECT *, unnest(tags) AS tag FROM cases) WHERE status <> 'error' GROUP BY 1")
def q11(spark, sf_dir):
    return rounded(analyze.breakdown(v.cases(spark, sf_dir), F.explode("tags"), "tag"), "pass_rate", "average_score")


@query("q12_grouping_sets_ext", f"""WITH {v.CASES} SELECT category, tag, count(*) AS cases, round(avg(overall_score), 6) AS average_score
  FROM (SELECT *, unnest(tags) AS tag FROM cases) GROUP BY GROUPING SETS ((category), (tag), ())""")
def q12(spark, sf_dir):
    d = v.cases(spark, sf_dir).withColumn("tag", F.explode("tags"))
    sets = d.groupingSets([[F.col("category")], [F.col("tag")], []], "category", "tag").agg(F.count(F.lit(1)).alias("cases"), F.avg("overall_score").alias("average_score"))
    return rounded(sets, "average_score")


# --- comparisons ---------------------------------------------------------------------------------------------------

_STATS = """s AS (SELECT count(diff) AS n, coalesce(avg(diff), 0) AS mean_diff, coalesce(var_samp(diff), 0) AS variance, coalesce(sqrt(var_samp(diff) / count(diff)), 0) AS se FROM p)
  SELECT n, round(mean_diff, 6) AS mean_diff, round(variance, 6) AS variance, round(se, 6) AS std_error, round(mean_diff - 1.96 * se, 6) AS ci_low, round(mean_diff + 1.96 * se, 6) AS ci_high,
    round(2.8 * se, 6) AS mde, mean_diff - 1.96 * se > 0 OR mean_diff + 1.96 * se < 0 AS significant, se > 0 AS variance_observed FROM s"""
_STAT_COLUMNS = ("mean_diff", "variance", "std_error", "ci_low", "ci_high", "mde")


@query("q13_compare_paired", f"WITH {v.RUNS}, p AS (SELECT b.score - a.score AS diff FROM a JOIN b USING (case_id)), {_STATS}")
def q13(spark, sf_dir):
    return rounded(cmp.compare(v.run_records(spark, sf_dir, "F"), v.run_records(spark, sf_dir, "O")), *_STAT_COLUMNS)


@query("q14_compare_flips", f"""WITH {v.RUNS} SELECT count(*) FILTER (NOT a.passed AND b.passed) AS improved, count(*) FILTER (a.passed AND NOT b.passed) AS regressed,
  count(*) FILTER (a.passed AND b.passed) AS both_pass, count(*) FILTER (NOT a.passed AND NOT b.passed) AS both_fail FROM a JOIN b USING (case_id)""")
def q14(spark, sf_dir):
    return cmp.flip_counts(v.run_records(spark, sf_dir, "F"), v.run_records(spark, sf_dir, "O"))


@query("q15_compare_only_in", f"""WITH {v.RUNS} SELECT 'a' AS side, case_id FROM a WHERE case_id NOT IN (SELECT case_id FROM b)
  UNION ALL SELECT 'b', case_id FROM b WHERE case_id NOT IN (SELECT case_id FROM a)""")
def q15(spark, sf_dir):
    return cmp.only_in(v.run_records(spark, sf_dir, "F"), v.run_records(spark, sf_dir, "O"))


@query("q16_compare_metric", f"""WITH {v.RUNS}, x AS (SELECT case_id, CASE WHEN n > 2 THEN CAST(n AS DOUBLE) ELSE 0 END AS value, run FROM rec),
  p AS (SELECT b.value - a.value AS diff FROM (SELECT * FROM x WHERE run = 'F') a JOIN (SELECT * FROM x WHERE run = 'O') b USING (case_id)), {_STATS}""")
def q16(spark, sf_dir):
    a, b = (v.run_records(spark, sf_dir, s).select("case_id", F.when(F.col("n") > 2, F.col("n").cast("double")).alias("value"), F.lit(True).alias("measured")) for s in "FO")
    return rounded(cmp.compare_metric(a, b, missing_as_zero=True), *_STAT_COLUMNS)


@query("q16b_compare_metric_measured", f"""WITH {v.RUNS}, x AS (SELECT case_id, CAST(n AS DOUBLE) AS value, run FROM rec WHERE n > 2),
  p AS (SELECT b.value - a.value AS diff FROM (SELECT * FROM x WHERE run = 'F') a JOIN (SELECT * FROM x WHERE run = 'O') b USING (case_id)), {_STATS}""")
def q16b(spark, sf_dir):
    a, b = (v.run_records(spark, sf_dir, s).select("case_id", F.when(F.col("n") > 2, F.col("n").cast("double")).alias("value"), F.lit(True).alias("measured")) for s in "FO")
    return rounded(cmp.compare_metric(a, b), *_STAT_COLUMNS)


def _suppliers(spark, sf_dir):
    s = v.read(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("label"), (F.round(F.col("s_acctbal") / 2000, 0) / 5).alias("overall_score"), F.when(F.col("s_acctbal") > 5000, "passed").otherwise("failed").alias("status"))


@query("q17_leaderboard_rank", """WITH e AS (SELECT 'n' || s_nationkey AS label, round(s_acctbal / 2000, 0) / 5 AS score, s_acctbal > 5000 AS ok FROM supplier),
  g AS (SELECT label, count(*) AS cases, avg(score) AS mean, coalesce(stddev_samp(score) / sqrt(count(*)), 0) AS std_error, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS pass_rate FROM e GROUP BY 1),
  o AS (SELECT *, printf('%.3f ±%.3f', mean, std_error) AS shown, row_number() OVER (ORDER BY mean DESC, label) AS pos FROM g),
  l AS (SELECT *, CASE WHEN lag(shown) OVER (ORDER BY pos) = shown THEN NULL ELSE pos END AS start FROM o)
  SELECT label, cases, round(mean, 6) AS mean, round(std_error, 6) AS std_error, round(pass_rate, 6) AS pass_rate, shown,
    CAST(last_value(start IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS rank FROM l""")
def q17(spark, sf_dir):
    return rounded(cmp.leaderboard(cmp.board_entries(_suppliers(spark, sf_dir))), "mean", "std_error", "pass_rate")


_SEGMENT = "WITH rec AS (SELECT c_mktsegment AS run, CAST(c_nationkey AS BIGINT) AS case_id, avg(c_acctbal) / 10000 AS score FROM customer GROUP BY ALL)"


@query("q18_top_gap", f"""{_SEGMENT}, top AS (SELECT run, row_number() OVER (ORDER BY avg(score) DESC, run) AS i FROM rec GROUP BY run),
  a AS (SELECT case_id, score FROM rec JOIN top USING (run) WHERE i = 1), b AS (SELECT case_id, score FROM rec JOIN top USING (run) WHERE i = 2),
  p AS (SELECT b.score - a.score AS diff FROM a JOIN b USING (case_id)), {_STATS}""")
def q18(spark, sf_dir):
    c = v.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("run"), F.col("c_nationkey").cast("long").alias("case_id")).agg((F.avg("c_acctbal") / 10000).alias("score"))
    c = c.withColumn("passed", F.col("score") >= 0.5)
    top = c.groupBy("run").agg(F.avg("score").alias("mean")).orderBy(F.desc("mean"), "run").limit(2)
    place = top.withColumn("i", F.row_number().over(_by_mean()))
    both = c.join(F.broadcast(place.select("run", "i")), "run")
    return rounded(cmp.compare(both.where("i = 1"), both.where("i = 2")), *_STAT_COLUMNS)


def _by_mean():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("mean"), "run")


# --- analysis ------------------------------------------------------------------------------------------------------

_BAD = f"""WITH {v.GRADE_CASES}, bad AS (SELECT case_id FROM cases WHERE status = 'failed'),
  f AS (SELECT g.* FROM grades g JOIN bad USING (case_id) WHERE NOT skipped AND NOT coalesce(g.passed, FALSE))"""


@query("q19_failure_patterns", f"""{_BAD}, s AS (SELECT DISTINCT case_id, CASE grader_scope WHEN 'transcript' THEN 'T:' WHEN 'outcome' THEN 'O:' ELSE 'B:' END || name AS k FROM f),
  c AS (SELECT case_id, string_agg(k, ',' ORDER BY k) AS pattern FROM s GROUP BY 1)
  SELECT pattern, count(*) AS cases, round(100.0 * count(*) / (SELECT count(*) FROM cases), 6) AS percentage FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def q19(spark, sf_dir):
    return rounded(analyze.failure_patterns(v.grades(spark, sf_dir), v.grade_cases(spark, sf_dir)), "percentage")


@query("q20_failure_tags", f"""{_BAD}, t AS (SELECT case_id, name, unnest(failure_tags) AS tag FROM f)
  SELECT tag, count(*) AS occurrences, count(DISTINCT case_id) AS cases, string_agg(DISTINCT name, ',' ORDER BY name) AS graders, round(count(DISTINCT case_id) / (SELECT count(*) FROM bad), 6) AS share FROM t GROUP BY 1""")
def q20(spark, sf_dir):
    return rounded(analyze.failure_tags(v.grades(spark, sf_dir), v.grade_cases(spark, sf_dir)), "share")


@query("q21_observed_tags", f"""WITH {v.GRADE_CASES}, t AS (SELECT DISTINCT case_id, unnest(tags) AS tag FROM grades WHERE NOT skipped)
  SELECT tag, count(*) AS cases, round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END), 6) AS pass_rate, round(count(*) / (SELECT count(*) FROM cases), 6) AS share FROM t JOIN cases USING (case_id) GROUP BY 1""")
def q21(spark, sf_dir):
    return rounded(analyze.observed_tags(v.grades(spark, sf_dir), v.grade_cases(spark, sf_dir)), "pass_rate", "share")


@query("q22_metric_dist", """WITH m AS (SELECT event_type AS metric, value AS x, FALSE AS is_flag FROM events UNION ALL SELECT 'is_' || event_type, CASE WHEN value > 100 THEN 1.0 ELSE 0 END, TRUE FROM events)
  SELECT metric, count(*) AS n, bool_and(is_flag) AS is_rate, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x) / sqrt(count(*)), 0), 6) AS std_error, min(x) AS min, max(x) AS max FROM m GROUP BY 1""")
def q22(spark, sf_dir):
    e = v.read(spark, sf_dir, "events")
    nums = e.select(F.col("event_type").alias("metric"), F.col("value").alias("num"), F.lit(None).cast("boolean").alias("flag"))
    flags = e.select(F.concat(F.lit("is_"), F.col("event_type")).alias("metric"), F.lit(None).cast("double").alias("num"), (F.col("value") > 100).alias("flag"))
    return rounded(analyze.metric_distribution(nums.unionByName(flags)), "mean", "std_error")


@query("q23_scope_gap", """WITH d AS (SELECT CAST(quality AS DOUBLE) AS o, 1.0 - toxic AS t FROM labels)
  SELECT round(avg(o), 6) AS outcome_mean, round(avg(t), 6) AS transcript_mean, count(*) FILTER (o >= .7 AND t >= .7) AS both_high, count(*) FILTER (o >= .7 AND t < .7) AS outcome_only,
  count(*) FILTER (o < .7 AND t >= .7) AS transcript_only, count(*) FILTER (o < .7 AND t < .7) AS both_low, round(avg(o) - avg(t), 6) AS gap,
  CASE WHEN abs(avg(o) - avg(t)) < 0.1 THEN 'balanced' WHEN avg(o) - avg(t) > 0.2 THEN 'outcome_much_better' WHEN avg(o) - avg(t) > 0 THEN 'outcome_better'
       WHEN avg(o) - avg(t) < -0.2 THEN 'transcript_much_better' ELSE 'transcript_better' END AS diagnosis FROM d""")
def q23(spark, sf_dir):
    d = v.read(spark, sf_dir, "labels").select(F.col("quality").cast("double").alias("outcome_score"), (1.0 - F.col("toxic")).alias("transcript_score"))
    return rounded(analyze.scope_gap(d), "outcome_mean", "transcript_mean", "gap")


@query("q23b_grader_stats", f"""WITH {v.GRADES} SELECT name, count(*) AS runs, round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END), 6) AS pass_rate, round(avg(score), 6) AS average_score,
  round(coalesce(stddev_samp(score), 0), 6) AS score_std, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) < 0.7 AS bottleneck FROM grades WHERE grader_scope IN ('outcome', 'both') AND NOT skipped AND score IS NOT NULL GROUP BY 1""")
def q23b(spark, sf_dir):
    return rounded(analyze.grader_stats(v.grades(spark, sf_dir), "outcome"), "pass_rate", "average_score", "score_std")


@query("q23c_scope_scores", f"""WITH {v.GRADES}, m AS (SELECT case_id, avg(score) FILTER (NOT skipped AND grader_scope IN ('transcript', 'both')) AS t, avg(score) FILTER (NOT skipped AND grader_scope IN ('outcome', 'both')) AS o FROM grades GROUP BY 1)
  SELECT case_id, round(coalesce(t, 0), 6) AS transcript_score, round(coalesce(o, 0), 6) AS outcome_score, t IS NOT NULL AS has_transcript, o IS NOT NULL AS has_outcome FROM m""")
def q23c(spark, sf_dir):
    return rounded(rollup.scope_scores(v.grades(spark, sf_dir)), "transcript_score", "outcome_score")


@query("q23d_grader_summary", f"""WITH {v.GRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY case_id, trial_id, name ORDER BY pos) AS i FROM grades)
  SELECT case_id, CASE WHEN i > 1 THEN name || '#' || i ELSE name END AS grader_key, round(avg(score) FILTER (NOT skipped), 6) AS score_mean,
  round(coalesce(avg(CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0 END) FILTER (NOT skipped), 0), 6) AS pass_fraction, count(score) FILTER (NOT skipped) AS trials FROM k GROUP BY ALL""")
def q23d(spark, sf_dir):
    return rounded(rollup.grader_summary(v.grades(spark, sf_dir)), "score_mean", "pass_fraction")


@query("q23e_short_circuit", f"""WITH {v.GRADES}, h AS (SELECT *, coalesce(max(CASE WHEN required AND NOT coalesce(passed, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS halted FROM grades)
  SELECT trial_id, count(*) AS graders, count(*) FILTER (skipped OR halted) AS skipped, count(score) FILTER (NOT halted) AS scored FROM h GROUP BY 1""")
def q23e(spark, sf_dir):
    d = rollup.short_circuit(v.grades(spark, sf_dir))
    return d.groupBy("trial_id").agg(F.count(F.lit(1)).alias("graders"), F.count_if("skipped").alias("skipped"), F.count("score").alias("scored"))


@query("q23f_summary", f"""WITH {v.CASES} SELECT count(*) AS total_cases, round(avg(CASE WHEN status = 'passed' THEN 1.0 ELSE 0 END), 6) AS pass_rate, round(avg(overall_score), 6) AS average_score,
  round(coalesce(stddev_samp(overall_score), 0), 6) AS score_std, round(avg(duration_ms), 6) AS average_duration_ms, round(max(overall_score), 6) AS best_score FROM cases""")
def q23f(spark, sf_dir):
    return rounded(analyze.summary(v.cases(spark, sf_dir)), "pass_rate", "average_score", "score_std", "average_duration_ms", "best_score")


@query("q55_contract_id", """WITH f AS (SELECT DISTINCT c_mktsegment AS run, substr(sha256(CAST(c_nationkey AS VARCHAR)), 1, 12) AS fp FROM customer)
  SELECT run, substr(sha256(string_agg(fp, chr(10) ORDER BY fp)), 1, 12) AS contract_id FROM f GROUP BY 1""")
def q55(spark, sf_dir):
    d = v.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("run"), F.substring(F.sha2(F.col("c_nationkey").cast("string"), 256), 1, 12).alias("grader_fingerprint"))
    return rollup.contract_id(d, "grader_fingerprint", "run")


@query("q56_fingerprint", """SELECT event_id, substr(sha256(replace(props, ' ', '')), 1, 12) AS fingerprint FROM events""")
def q56(spark, sf_dir):
    return v.read(spark, sf_dir, "events").select("event_id", rollup.fingerprint(F.col("props")).alias("fingerprint"))
