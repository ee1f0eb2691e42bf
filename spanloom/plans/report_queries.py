"""Queries over reports and stores: comparison documents, verdicts, trails, records, reliability, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as cmp, image_graders as given, metrics, reports
from ..sources import store
from . import views as v
from .registry import query
from .rollup_queries import rounded

_LONG = """l AS (SELECT o_orderstatus AS run, o_custkey AS case_id, k.key AS key, CASE k.key WHEN 'cost' THEN avg(o_totalprice) / 1000 WHEN 'turns' THEN CAST(count(*) AS DOUBLE) ELSE min(o_totalprice) / 500000 END AS value
  FROM orders, (VALUES ('cost'), ('turns'), ('score')) k(key) GROUP BY o_orderstatus, o_custkey, k.key)"""


def _long(spark, sf_dir, status):
    o = v.read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("case_id"))
    d = o.agg((F.avg("o_totalprice") / 1000).alias("cost"), F.count(F.lit(1)).cast("double").alias("turns"), (F.min("o_totalprice") / 500000).alias("score"))
    return d.unpivot("case_id", ["cost", "turns", "score"], "key", "value")


@query("q71_comparison_document", f"""WITH {_LONG}, p AS (SELECT a.key, a.value AS va, b.value AS vb, b.value - a.value AS diff FROM (SELECT * FROM l WHERE run = 'F') a JOIN (SELECT * FROM l WHERE run = 'O') b USING (case_id, key)),
  s AS (SELECT key, count(*) AS n, avg(va) AS mean_a, avg(vb) AS mean_b, avg(diff) AS d, coalesce(sqrt(var_samp(diff) / count(*)), 0) AS se FROM p GROUP BY 1)
  SELECT key, n, round(mean_a, 5) AS mean_a, round(mean_b, 5) AS mean_b, round(d, 5) AS mean_diff, round(se, 5) AS std_error, d - 1.96 * se > 0 OR d + 1.96 * se < 0 AS significant, round(2.8 * se, 5) AS mde, se > 0 AS variance_observed FROM s""")
def q71(spark, sf_dir):
    d = reports.comparison_document(_long(spark, sf_dir, "F"), _long(spark, sf_dir, "O")).drop("verdict")
    return rounded(d, "mean_a", "mean_b", "mean_diff", "std_error", "mde", digits=5)


@query("q72_board_verdict", """WITH e AS (SELECT c_mktsegment AS label, round(avg(c_acctbal) / 10000, 2) AS m FROM customer GROUP BY 1), o AS (SELECT label, rank() OVER (ORDER BY m DESC) AS r, row_number() OVER (ORDER BY m DESC, label) AS i FROM e)
  SELECT count(*) AS entries, max(CASE WHEN i = 1 THEN label END) AS leader, CASE WHEN count(*) FILTER (r = 1) > 1 THEN 'tied at the top' ELSE max(CASE WHEN i = 1 THEN label END) || ' leads within noise' END AS verdict FROM o""")
def q72(spark, sf_dir):
    e = v.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.round(F.avg("c_acctbal") / 10000, 2).alias("mean"))
    ranked = cmp.leaderboard(e.withColumn("std_error", F.lit(0.001)))
    pair = metrics.paired_stats(v.read(spark, sf_dir, "nation").select((F.when(F.col("n_nationkey") % 2 == 0, 1.0).otherwise(-1.0) * (F.col("n_nationkey") + 1)).alias("diff")))
    return reports.board_verdict(ranked, pair)


@query("q73_history_trail", """SELECT slug, generated, CAST(age AS INTEGER) AS age FROM (SELECT 'u' || user_id AS slug, event_id AS generated, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 3""")
def q73(spark, sf_dir):
    e = v.read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug"), F.col("event_id").alias("generated"))
    return reports.history(e, 3)


@query("q74_grading_counters", """WITH t AS (SELECT c_custkey AS id, c_nationkey AS fp FROM customer), r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS old FROM customer WHERE c_custkey % 3 <> 0)
  SELECT count(*) FILTER (old IS NULL) AS graded, count(*) FILTER (old = fp) AS skipped, count(*) FILTER (old <> fp) AS stale FROM t LEFT JOIN r USING (id)""")
def q74(spark, sf_dir):
    c = v.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trace_id"), F.col("c_nationkey").alias("fingerprint"))
    old = c.where("trace_id % 3 <> 0").withColumn("fingerprint", F.when(F.col("trace_id") % 4 == 0, F.col("fingerprint") + 100).otherwise(F.col("fingerprint")))
    return store.grading_counts(store.match_records(c, old))


@query("q75_latest_file_wins", """SELECT case_id, score FROM (SELECT o_custkey AS case_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1""")
def q75(spark, sf_dir):
    o = v.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("pos"))
    return cmp.latest_records(o).select("case_id", "score")


@query("q76_reliability", f"""WITH {v.TRIALS}, m AS (SELECT case_id, count(*) AS n, count(*) FILTER (passed) AS c FROM trials WHERE error IS NULL GROUP BY 1), x AS (SELECT CAST(case_id % 3 AS VARCHAR) AS label, n, c FROM m)
  SELECT label, CAST(3 AS INTEGER) AS k, round(avg(CASE WHEN c < 3 THEN 0 ELSE (c / n) * ((c - 1) / (n - 1)) * ((c - 2) / (n - 2)) END), 6) AS reliability FROM x GROUP BY 1""")
def q76(spark, sf_dir):
    m = metrics.trial_metrics(v.trials(spark, sf_dir), ks=(1, 3)).where("n_trials > 0")
    cases = m.select((F.col("case_id") % 3).cast("string").alias("label"), F.lit("passed").alias("status"), "total_trials", F.create_map(F.lit(1), F.col("pass_all_1"), F.lit(3), F.col("pass_all_3")).alias("pass_all"))
    return rounded(cmp.reliability(cases), "reliability")


@query("q77_reviews_and_preferences", """WITH d AS (SELECT s_suppkey AS k, 1 + s_nationkey % 5 AS a, 1 + s_suppkey % 5 AS b FROM supplier)
  SELECT k AS s_suppkey, CASE WHEN k % 10 = 0 THEN 0 ELSE round(((a + b) / 2 - 1) / 4, 6) END AS review, k % 10 <> 0 AND ((a + b) / 2 - 1) / 4 >= 0.7 AS reviewed_well,
  round(CASE k % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.2 ELSE 0.5 END, 6)::DOUBLE AS preferred, round((a - 1) / 4, 6) AS safety_gap FROM d""")
def q77(spark, sf_dir):
    k, a, b = F.col("s_suppkey"), 1 + F.col("s_nationkey") % 5, 1 + F.col("s_suppkey") % 5
    review = given.human_review(F.when(k % 10 != 0, F.create_map(F.lit("x"), a.cast("double"), F.lit("y"), b.cast("double"))), ["x", "y"])
    choice = given.pairwise_comparison(F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("tie"), F.lit(0.8), "a")
    d = v.read(spark, sf_dir, "supplier").select("s_suppkey", review["score"].alias("review"), review["passed"].alias("reviewed_well"), choice["score"].alias("preferred"), given.aesthetic_score(a.cast("double"), 5.0)["score"].alias("safety_gap"))
    return rounded(d, "review", "preferred", "safety_gap")


@query("q78_index_upsert", """SELECT 'n' || n_nationkey AS slug, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END AS version FROM nation UNION ALL SELECT 'new', 2""")
def q78(spark, sf_dir):
    old = v.read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"), F.lit(1).alias("version"))
    new = old.where("cast(substring(slug, 2) as int) % 4 = 0").select("slug", F.lit(2).alias("version")).unionByName(spark.createDataFrame([("new", 2)], "slug string, version int"))
    return reports.upsert_index(old, new)
