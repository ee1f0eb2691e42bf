"""Comparisons: two runs case by case, many runs on a leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .metrics import paired_stats


def latest_records(records: DataFrame) -> DataFrame:
    """The last record of each case of ``records(case_id, file, pos, ...)``: later files win, then later places."""
    last = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("file"), F.desc("pos")))
    return records.withColumn("_n", last).where(F.col("_n") == 1).drop("_n")


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases of both runs of ``(case_id, score, passed)`` with score_a, score_b, diff (b - a) and flip."""
    left = a.select("case_id", F.col("score").alias("score_a"), F.col("passed").alias("passed_a"))
    d = left.join(b.select("case_id", F.col("score").alias("score_b"), F.col("passed").alias("passed_b")), "case_id")
    flip = F.when(F.col("passed_a") & F.col("passed_b"), "both_pass").when(F.col("passed_a"), "regressed").when(F.col("passed_b"), "improved").otherwise("both_fail")
    return d.withColumns({"diff": F.col("score_b") - F.col("score_a"), "flip": flip})


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paired statistics of two runs in one row."""
    return paired_stats(pair(a, b))


def flip_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return pair(a, b).agg(*[F.count_if(F.col("flip") == f).alias(f) for f in ("improved", "regressed", "both_pass", "both_fail")])


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, case_id) of cases that one run has and the other has not."""
    one, two = a.select("case_id"), b.select("case_id")
    left = one.join(two, "case_id", "left_anti").select(F.lit("a").alias("side"), "case_id")
    return left.unionByName(two.join(one, "case_id", "left_anti").select(F.lit("b").alias("side"), "case_id"))


def compare_metric(a: DataFrame, b: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Paired statistics of ``(case_id, value, measured)``; a case that measured anything else may count as 0."""

    def values(d: DataFrame, name: str) -> DataFrame:
        v = F.coalesce("value", F.when(F.col("measured"), F.lit(0.0))) if missing_as_zero else F.col("value")
        return d.select("case_id", v.alias(name)).where(F.col(name).isNotNull())

    both = values(a, "va").join(values(b, "vb"), "case_id")
    return paired_stats(both.select((F.col("vb") - F.col("va")).alias("diff")))


def leaderboard(entries: DataFrame) -> DataFrame:
    """Ranks of ``(label, mean, std_error)``: entries that show alike at three digits share a rank.

    The next rank is the position, as in competitions.
    """
    shown = F.format_string("%.3f ±%.3f", F.col("mean"), F.col("std_error"))
    order = Window.orderBy(F.desc("mean"), "label")
    d = entries.withColumn("shown", shown).withColumn("position", F.row_number().over(order))
    new = F.coalesce(F.lag("shown").over(order) != F.col("shown"), F.lit(True))
    start = F.last(F.when(new, F.col("position")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("rank", start).drop("position")


def board_entries(cases: DataFrame, label: str = "label") -> DataFrame:
    """(label, cases, mean, std_error, pass_rate) over the evaluated cases of each run."""
    good = cases.where("status <> 'error'")
    return good.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg("overall_score").alias("mean"),
        F.coalesce(F.stddev_samp("overall_score") / F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("std_error"),
        F.avg((F.col("status") == "passed").cast("double")).alias("pass_rate"),
    )


def reliability(cases: DataFrame) -> DataFrame:
    """(label, k, reliability): the mean pass^k at the largest k that every evaluated case of a run has.

    ``cases(label, status, total_trials, pass_all MAP<INT, DOUBLE>)``; null where a case has a single trial.
    """
    good = cases.where("status <> 'error'")
    shared = good.groupBy("label").agg(
        F.aggregate(F.collect_set(F.array_sort(F.map_keys("pass_all"))), F.lit(None).cast("array<int>"), lambda a, k: F.when(a.isNull(), k).otherwise(F.array_intersect(a, k))).alias("ks"),
        F.min("total_trials").alias("_least"),
    )
    shared = shared.select("label", F.when(F.col("_least") > 1, F.array_max("ks")).alias("k"))
    return good.join(shared, "label").groupBy("label", "k").agg(F.when(F.col("k").isNotNull(), F.avg(F.element_at("pass_all", F.col("k")))).alias("reliability"))
