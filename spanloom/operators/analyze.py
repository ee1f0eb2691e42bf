"""Analysis of a run: by grader, scope, failure, tag, metric and category.

Case rows: case_id, status, passed, overall_score, category, tags.  Grade rows: case_id, name, grader_scope
(transcript, outcome, both), score, passed, skipped, failure_tags, tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BOTTLENECK, HIGH = 0.7, 0.7


def grader_stats(grades: DataFrame, scope: str) -> DataFrame:
    """Each grader of a scope: runs, pass rate, mean and spread of measured scores, and whether it is a bottleneck."""
    rows = grades.where(F.col("grader_scope").isin(scope, "both") & ~F.col("skipped") & F.col("score").isNotNull())
    d = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("score").alias("average_score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std")
    )
    return d.withColumn("bottleneck", F.col("pass_rate") < BOTTLENECK)


def scope_gap(cases: DataFrame) -> DataFrame:
    """One row on ``(outcome_score, transcript_score)`` per case: the gap, its diagnosis, and the four quadrants."""
    o, t = F.col("outcome_score") >= HIGH, F.col("transcript_score") >= HIGH
    d = cases.agg(
        F.avg("outcome_score").alias("outcome_mean"),
        F.avg("transcript_score").alias("transcript_mean"),
        F.count_if(o & t).alias("both_high"),
        F.count_if(o & ~t).alias("outcome_only"),
        F.count_if(~o & t).alias("transcript_only"),
        F.count_if(~o & ~t).alias("both_low"),
    )
    gap = F.col("outcome_mean") - F.col("transcript_mean")
    says = F.when(F.abs(gap) < 0.1, "balanced").when(gap > 0.2, "outcome_much_better").when(gap > 0, "outcome_better").when(gap < -0.2, "transcript_much_better").otherwise("transcript_better")
    return d.withColumn("gap", gap).withColumn("diagnosis", says)


def failure_patterns(grades: DataFrame, cases: DataFrame, top: int = 10) -> DataFrame:
    """The commonest sets of failed graders among failed cases, with their share of all cases (a top-``top`` report)."""
    letter = F.when(F.col("grader_scope") == "transcript", "T:").when(F.col("grader_scope") == "outcome", "O:").otherwise("B:")
    failed = grades.where(~F.col("skipped") & ~F.coalesce("passed", F.lit(False))).join(cases.where("status = 'failed'").select("case_id"), "case_id", "left_semi")
    sets = failed.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(letter, F.col("name")))), ",").alias("pattern"))
    total = cases.agg(F.count(F.lit(1)).alias("total"))
    counted = sets.groupBy("pattern").agg(F.count(F.lit(1)).alias("cases"))
    out = counted.join(F.broadcast(total)).withColumn("percentage", 100.0 * F.col("cases") / F.col("total"))
    return out.select("pattern", "cases", "percentage").orderBy(F.desc("cases"), "pattern").limit(top)


def failure_tags(grades: DataFrame, cases: DataFrame) -> DataFrame:
    """Each failure tag among failed graders of failed cases: occurrences, share of failed cases, graders."""
    bad = cases.where("status = 'failed'").select("case_id")
    rows = grades.where(~F.col("skipped") & ~F.coalesce("passed", F.lit(False))).join(bad, "case_id", "left_semi").select("case_id", "name", F.explode("failure_tags").alias("tag"))
    total = bad.agg(F.count(F.lit(1)).alias("failed"))
    d = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("case_id").alias("cases"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("graders"))
    return d.join(F.broadcast(total)).withColumn("share", F.col("cases") / F.col("failed")).drop("failed")


def observed_tags(grades: DataFrame, cases: DataFrame) -> DataFrame:
    """Each observed tag: distinct cases, their share of all and their pass rate."""
    total = cases.agg(F.count(F.lit(1)).alias("total"))
    pairs = grades.where(~F.col("skipped")).select("case_id", F.explode("tags").alias("tag")).distinct()
    d = pairs.join(cases.select("case_id", "passed"), "case_id").groupBy("tag").agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return d.join(F.broadcast(total)).withColumn("share", F.col("cases") / F.col("total")).drop("total").orderBy(F.desc("cases"), "tag")


def metric_distribution(metrics: DataFrame) -> DataFrame:
    """Each metric of ``(metric, num, flag)``: a rate where all values are booleans, else mean, error and range."""
    v = F.coalesce("num", F.col("flag").cast("double"))
    d = metrics.groupBy("metric").agg(
        F.count(v).alias("n"), F.bool_and(F.col("flag").isNotNull()).alias("is_rate"), F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0)).alias("std_error"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return d


def breakdown(cases: DataFrame, key: Column, name: str) -> DataFrame:
    """Cases, pass rate and mean score by a key; cases in error and empty keys are left out."""
    rows = cases.where("status <> 'error'").select(key.alias(name), "status", "overall_score").where(F.coalesce(F.col(name), F.lit("")) != "")
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "passed").alias("passed_cases"), F.avg((F.col("status") == "passed").cast("double")).alias("pass_rate"), F.avg("overall_score").alias("average_score"))


def summary(cases: DataFrame) -> DataFrame:
    """One row over all cases, those in error included."""
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.avg((F.col("status") == "passed").cast("double")).alias("pass_rate"), F.avg("overall_score").alias("average_score"),
        F.coalesce(F.stddev_samp("overall_score"), F.lit(0.0)).alias("score_std"), F.avg("duration_ms").alias("average_duration_ms"), F.max("overall_score").alias("best_score"),
    )
