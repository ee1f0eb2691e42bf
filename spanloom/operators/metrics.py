"""Trial metrics: how often, how well and how reliably a case is solved over repeated trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _product(k: int, term) -> Column:
    """The product of ``term(i)`` for i in 0..k-1."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * term(i)
    return out


def pass_at_k(n, c, k: int) -> Column:
    """P(at least one of k trials passes), unbiased for k <= n, else from the pass rate."""
    n, c = F.col(n), F.col(c)
    if k <= 0:
        return F.lit(0.0)
    miss = _product(k, lambda i: F.try_divide((n - c - i).cast("double"), (n - i).cast("double")))
    return (
        F.when(n <= 0, 0.0)
        .when(F.lit(k) > n, 1.0 - F.pow(1.0 - F.try_divide(c.cast("double"), n), F.lit(k)))
        .when(n - c < k, 1.0)
        .otherwise(1.0 - miss)
    )


def pass_all_k(n, c, k: int) -> Column:
    """P(all of k trials pass), unbiased for k <= n, else from the pass rate."""
    n, c = F.col(n), F.col(c)
    if k <= 0:
        return F.lit(0.0)
    hit = _product(k, lambda i: F.try_divide((c - i).cast("double"), (n - i).cast("double")))
    return F.when(n <= 0, 0.0).when(F.lit(k) > n, F.pow(F.try_divide(c.cast("double"), n), F.lit(k))).when(c < k, 0.0).otherwise(hit)


def consistency(n, mean, std) -> Column:
    """exp(-std / mean): 1 for no spread, 0 for a mean of 0 with spread."""
    n, mean, std = F.col(n), F.col(mean), F.col(std)
    return F.when((n < 2) | (std == 0), 1.0).when(mean == 0, 0.0).otherwise(F.exp(-F.try_divide(std, mean)))


def trial_metrics(trials: DataFrame, ks: Sequence[int] = (1, 3, 5), best_of: int = 3, by: str = "case_id") -> DataFrame:
    """One row per case of ``trials(case_id, trial_number, passed, score, error)``.

    Trials with an error are left out of every figure but total_trials and error_trials; a null score of a trial
    without an error counts as 0.
    """
    fine = F.col("error").isNull()
    score = F.when(fine, F.coalesce("score", F.lit(0.0)))
    out = trials.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(~fine).alias("error_trials"),
        F.count_if(fine).alias("n_trials"),
        F.count_if(fine & F.col("passed")).alias("n_passed"),
        F.avg(score).alias("score_mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("score_std"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.array_sort(F.collect_list(F.when(fine, F.struct("trial_number", score.alias("score"))))).alias("_ordered"),
    )
    first = F.transform(F.slice("_ordered", 1, best_of), lambda t: t["score"])
    rate = F.try_divide(F.col("n_passed").cast("double"), F.col("n_trials"))
    out = out.withColumns({"pass_rate": F.coalesce(rate, F.lit(0.0)), f"best_of_{best_of}": F.array_max(first), "consistency": consistency("n_trials", "score_mean", "score_std")})
    return out.withColumns({f"pass_at_{k}": pass_at_k("n_trials", "n_passed", k) for k in ks} | {f"pass_all_{k}": pass_all_k("n_trials", "n_passed", k) for k in ks}).drop("_ordered")


def paired_stats(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """One row of paired statistics; an interval that excludes 0 is significant.  No pair: mde is infinite."""
    d = diffs.agg(F.count(column).alias("n"), F.coalesce(F.avg(column), F.lit(0.0)).alias("mean_diff"), F.coalesce(F.var_samp(column), F.lit(0.0)).alias("variance"))
    se = F.coalesce(F.sqrt(F.try_divide(F.col("variance"), F.col("n"))), F.lit(0.0))
    d = d.withColumn("std_error", se).withColumn("ci_low", F.col("mean_diff") - 1.96 * F.col("std_error")).withColumn("ci_high", F.col("mean_diff") + 1.96 * F.col("std_error"))
    return d.withColumns({
        "mde": F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise((1.96 + 0.84) * F.col("std_error")),
        "significant": (F.col("n") > 0) & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)),
        "variance_observed": F.col("std_error") > 0,
    })
