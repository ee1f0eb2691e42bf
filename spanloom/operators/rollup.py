"""Grades to trials, trials to cases, cases to runs.

A grade row: case_id, trial_id, pos, name, label, score (null: not measured), passed, weight, required, gate,
skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def grade_rollup(grades: DataFrame, pass_threshold: float = 0.7, required_graders: Sequence[str] = (), by: Sequence[str] = ("trial_id",)) -> DataFrame:
    """Score and verdict of each trial.

    Skipped rows are left out.  Gates decide but don't score.  The score divides the weighted sum of all scored
    rows by the sum of the positive weights, or is their plain mean where that sum isn't positive; with gates
    alone it is 1 or 0, with nothing 0.  A trial passes if all gates pass, the score (if any row scores) reaches
    the threshold, flagged and named required graders pass, and no active row is unscored.
    """
    active = grades.where(~F.col("skipped"))
    plain, scored = ~F.col("gate"), ~F.col("gate") & F.col("score").isNotNull()
    named = [
        F.min_by(F.when(plain & (F.col("name") == n), F.coalesce("passed", F.lit(False))), F.when(plain & (F.col("name") == n), F.col("pos"))).alias(f"_named_{i}")
        for i, n in enumerate(required_graders)
    ]
    d = active.groupBy(*by).agg(
        F.count(F.lit(1)).alias("active_graders"),
        F.count_if(scored).alias("scored_graders"),
        F.count_if("gate").alias("gates"),
        F.coalesce(F.bool_and(F.when(F.col("gate"), F.coalesce("passed", F.lit(False)))), F.lit(True)).alias("_gates_pass"),
        F.coalesce(F.bool_and(F.when(plain & F.col("required"), F.coalesce("passed", F.lit(False)))), F.lit(True)).alias("_required_pass"),
        F.bool_and(F.col("score").isNotNull()).alias("_all_scored"),
        F.sum(F.when(scored, F.col("score") * F.col("weight"))).alias("_weighted"),
        F.sum(F.when(scored & (F.col("weight") > 0), F.col("weight"))).alias("_weights"),
        F.avg(F.when(scored, F.col("score"))).alias("_plain"),
        *named,
    )
    score = (
        F.when(F.col("_weights") > 0, F.col("_weighted") / F.col("_weights"))
        .when(F.col("scored_graders") > 0, F.col("_plain"))
        .when((F.col("gates") > 0) & F.col("_gates_pass") & (F.col("gates") == F.col("active_graders")), 1.0)
        .otherwise(0.0)
    )
    ok = F.col("_gates_pass") & F.col("_required_pass") & F.col("_all_scored")
    for i in range(len(required_graders)):
        ok = ok & F.coalesce(F.col(f"_named_{i}"), F.lit(True))
    d = d.withColumn("score", score).withColumn("passed", ok & ((F.col("scored_graders") == 0) | (F.col("score") >= pass_threshold)))
    return d.select(*by, "active_graders", "scored_graders", "gates", "score", "passed")


def invert_negative(trials: DataFrame, expect: str = "expect", blocked: str = "blocked") -> DataFrame:
    """A negative test (expect = 'fail') passes where the agent was blocked or its graders failed."""
    return trials.withColumn("passed", F.when(F.col(expect) == "fail", F.coalesce(F.col(blocked), F.lit(False)) | ~F.col("passed")).otherwise(F.col("passed")))


def case_rollup(trials: DataFrame) -> DataFrame:
    """Cases from ``trials(case_id, trial_number, passed, score, error, duration_ms)``.

    A case passes with at least half of its evaluated trials; without an evaluated trial its status is error.
    """
    fine = F.col("error").isNull()
    d = trials.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(~fine).alias("error_trials"),
        F.count_if(fine & F.col("passed")).alias("passed_trials"),
        F.coalesce(F.avg(F.when(fine, F.coalesce("score", F.lit(0.0)))), F.lit(0.0)).alias("overall_score"),
        F.coalesce(F.max(F.when(fine, F.coalesce("score", F.lit(0.0)))), F.lit(0.0)).alias("best_score"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max(F.when(fine, F.col("trial_number"))).alias("last_trial"),
    )
    evaluated = F.col("total_trials") - F.col("error_trials")
    passed = (evaluated > 0) & (2 * F.col("passed_trials") >= evaluated)
    return d.withColumn("passed", passed).withColumn("status", F.when(evaluated == 0, "error").when(passed, "passed").otherwise("failed"))


def run_rollup(cases: DataFrame, *by: str) -> DataFrame:
    """Totals, pass rate and mean scores of each run; cases in error count in the totals alone."""
    good = F.col("status") != "error"
    d = cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("status") == "passed").alias("passed_cases"),
        F.count_if(F.col("status") == "failed").alias("failed_cases"),
        F.count_if(~good).alias("error_cases"),
        F.count_if(good).alias("evaluated_cases"),
        F.coalesce(F.avg(F.when(good, F.col("overall_score"))), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.avg(F.when(good, F.col("best_score"))), F.lit(0.0)).alias("best_of_k_score"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    return d.withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed_cases").cast("double"), F.col("evaluated_cases")), F.lit(0.0)))


def grader_keys(grades: DataFrame, by: Sequence[str] = ("case_id", "trial_id")) -> DataFrame:
    """``grader_key``: label or name, with #n from its second occurrence in a trial on."""
    base = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("name"))
    nth = F.row_number().over(Window.partitionBy(*by, base).orderBy("pos"))
    return grades.withColumn("grader_key", F.when(nth > 1, F.concat(base, F.lit("#"), nth.cast("string"))).otherwise(base))


def grader_summary(grades: DataFrame) -> DataFrame:
    """Each grader of a case across its trials: mean of scores, share passed of those not skipped, trials scored."""
    live = ~F.col("skipped")
    return grader_keys(grades).groupBy("case_id", "grader_key").agg(
        F.avg(F.when(live, F.col("score"))).alias("score_mean"),
        F.coalesce(F.avg(F.when(live, F.col("passed").cast("double"))), F.lit(0.0)).alias("pass_fraction"),
        F.count(F.when(live, F.col("score"))).alias("trials"),
    )


def short_circuit(grades: DataFrame, by: Sequence[str] = ("trial_id",)) -> DataFrame:
    """Mark as skipped, with score null, every row after the first failed required one of its trial."""
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max(F.when(F.col("required") & ~F.coalesce("passed", F.lit(False)), 1).otherwise(0)).over(before)
    halted = F.coalesce(failed, F.lit(0)) == 1
    return grades.withColumns({"skipped": F.col("skipped") | halted, "score": F.when(~halted, F.col("score")), "skip_reason": F.when(halted, F.lit("required grader failed"))})


def scope_scores(grades: DataFrame, by: str = "case_id") -> DataFrame:
    """Mean measured score per scope of a case; rows of scope 'both' count on either side; 0 where none."""
    measured = ~F.col("skipped") & F.col("score").isNotNull()

    def mean(scope: str) -> Column:
        return F.avg(F.when(measured & F.col("grader_scope").isin(scope, "both"), F.col("score")))

    d = grades.groupBy(by).agg(mean("transcript").alias("_t"), mean("outcome").alias("_o"))
    return d.select(by, *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((F.col("_t"), "transcript_score"), (F.col("_o"), "outcome_score"))], F.col("_t").isNotNull().alias("has_transcript"), F.col("_o").isNotNull().alias("has_outcome"))


def contract_id(fingerprints: DataFrame, column: str = "grader_fingerprint", *by: str) -> DataFrame:
    """First 12 hex digits of the SHA-256 of the sorted distinct fingerprints, one per line."""
    listed = F.array_join(F.array_sort(F.collect_set(column)), "\n")
    return fingerprints.groupBy(*by).agg(F.substring(F.sha2(listed, 256), 1, 12).alias("contract_id"))


def fingerprint(spec: Column) -> Column:
    """First 12 hex digits of the SHA-256 of a JSON text with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.parse_json(spec)), 256), 1, 12)
