"""Result files: runs, cases and grades out of any of the usual wrappers, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import get, items
from .files import json_values, whole_files


def _unwrap(v: Column) -> Column:
    """The values that a wrapper holds: its case_results, its results, or itself."""
    return F.when(get(v, "$.case_results", "variant").isNotNull(), items(v, "$.case_results")).when(get(v, "$.results", "variant").isNotNull(), items(v, "$.results")).otherwise(F.array(v))


def case_values(values: DataFrame) -> DataFrame:
    """(file, pos, v) with one case in each row, two levels of wrappers taken off."""
    d = values.select("file", F.col("pos").alias("p0"), F.posexplode(_unwrap(F.col("v"))).alias("p1", "v"))
    d = d.select("file", "p0", "p1", F.posexplode(_unwrap(F.col("v"))).alias("p2", "v")).where(get(F.col("v"), "$.case_id").isNotNull())
    return d.select("file", (F.col("p0") * 1_000_000_000 + F.col("p1") * 1_000_000 + F.col("p2")).cast("long").alias("pos"), "v")


def cases(case_rows: DataFrame) -> DataFrame:
    """Case columns; best_score falls back from best_of_k to score_max to the overall score."""
    v = F.col("v")
    evaluated = F.coalesce(get(v, "$.total_trials", "int"), F.lit(1)) - F.coalesce(get(v, "$.error_trials", "int"), F.lit(0))
    passed = F.coalesce(get(v, "$.passed", "boolean"), get(v, "$.status") == "passed", F.lit(False))
    total = F.coalesce(get(v, "$.total_trials", "int"), F.lit(1))
    return case_rows.select(
        "file", "pos", get(v, "$.case_id").alias("case_id"), F.coalesce(get(v, "$.status"), F.when(passed, "passed").otherwise("failed")).alias("status"), passed.alias("passed"), get(v, "$.overall_score", "double").alias("overall_score"),
        F.coalesce(get(v, "$.trial_metrics.best_of_k", "double"), get(v, "$.trial_metrics.score_max", "double"), get(v, "$.best_score", "double"), get(v, "$.overall_score", "double")).alias("best_score"),
        F.when((total > 1) & (evaluated > 0), get(v, "$.passed_trials", "double") / evaluated).otherwise(passed.cast("double")).alias("pass_fraction"),
        get(v, "$.duration_ms", "double").alias("duration_ms"), F.coalesce(get(v, "$.category"), F.lit("")).alias("category"), F.coalesce(F.try_variant_get(v, "$.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        total.alias("total_trials"), F.coalesce(get(v, "$.error_trials", "int"), F.lit(0)).alias("error_trials"), get(v, "$.grader_fingerprint").alias("grader_fingerprint"), get(v, "$.error").alias("error"),
    )


def grades(case_rows: DataFrame) -> DataFrame:
    """Grade rows of cases, under either of their two names; a boolean metric keeps being one."""
    v, g = F.col("v"), F.col("g")
    listed = F.when(get(v, "$.evaluator_results", "variant").isNotNull(), items(v, "$.evaluator_results")).otherwise(items(v, "$.grade_results"))
    d = case_rows.select("file", get(v, "$.case_id").alias("case_id"), F.posexplode(listed).alias("pos", "g"))
    flag = lambda p, default=False: F.coalesce(get(g, p, "boolean"), F.lit(default))
    return d.select(
        "file", "case_id", "pos", get(g, "$.name").alias("name"), F.coalesce(get(g, "$.label"), F.lit("")).alias("label"), get(g, "$.score", "double").alias("score"), flag("$.passed").alias("passed"), F.coalesce(get(g, "$.weight", "double"), F.lit(1.0)).alias("weight"),
        flag("$.required").alias("required"), flag("$.gate").alias("gate"), flag("$.skipped").alias("skipped"), F.coalesce(get(g, "$.grader_scope"), F.lit("outcome")).alias("grader_scope"), F.coalesce(F.try_variant_get(g, "$.failure_tags", "array<string>"), F.array().cast("array<string>")).alias("failure_tags"),
        F.coalesce(F.try_variant_get(g, "$.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), F.try_variant_get(g, "$.metrics", "map<string,string>").alias("metrics"),
    )


def metric_rows(grade_rows: DataFrame) -> DataFrame:
    """(case_id, name, metric, num, flag) with numbers and booleans apart."""
    d = grade_rows.where("NOT skipped").select("file", "case_id", "name", F.explode("metrics").alias("metric", "value"))
    flag = F.when(F.lower("value").isin("true", "false"), F.lower("value") == "true")
    return d.select("file", "case_id", "name", "metric", F.when(flag.isNull(), F.col("value").try_cast("double")).alias("num"), flag.alias("flag")).where("num IS NOT NULL OR flag IS NOT NULL")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, grades) of result files; files that aren't JSON give nothing."""
    rows = case_values(json_values(whole_files(spark, path)))
    return cases(rows), grades(rows)


def select_score(case_rows: DataFrame, grade_rows: DataFrame, on: str | None = None) -> DataFrame:
    """(case_id, score, passed) of whole cases, or of one grader by label or name; evaluated cases only.

    Where a case has several graders of that key with different scores, that is an error.
    """
    live = case_rows.where("status <> 'error'")
    if on is None:
        return live.select("file", "pos", "case_id", F.col("overall_score").alias("score"), (F.col("pass_fraction") >= 0.5).alias("passed"), "pass_fraction")
    key = F.coalesce(F.nullif("label", F.lit("")), F.col("name"))
    g = grade_rows.where((key == on) & ~F.col("skipped") & F.col("score").isNotNull()).groupBy("file", "case_id").agg(F.countDistinct("score").alias("n"), F.first("score").alias("score"), F.bool_and("passed").alias("passed"))
    clash = g.where("n > 1").limit(3).collect()
    if clash:
        raise ValueError(f"{on!r} is ambiguous in case(s) {', '.join(sorted(r['case_id'] for r in clash))}")
    return live.select("file", "pos", "case_id").join(g.drop("n"), ["file", "case_id"]).select("file", "pos", "case_id", "score", "passed", F.col("passed").cast("double").alias("pass_fraction"))


def write_results(case_rows: DataFrame, grade_rows: DataFrame, path: str, *by: str) -> None:
    """Cases with their grades under both names, as JSON, in folders by run where ``by`` says so."""
    keys = [c for c in ("file", "case_id") if c in grade_rows.columns and c in case_rows.columns]
    g = grade_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in grade_rows.columns if c not in ("pos", *keys)])), lambda a, b: a["pos"] - b["pos"]).alias("evaluator_results"))
    d = case_rows.drop("pos").join(g, keys, "left").withColumn("grade_results", F.col("evaluator_results"))
    (d.write.partitionBy(*by) if by else d.write).json(path)
