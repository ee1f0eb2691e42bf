"""Reports as tables: verdicts, run and comparison documents, indexes with history, recommendations, steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .metrics import paired_stats


def metric_verdict() -> Column:
    """One line on a row of paired statistics (n, mean_diff, std_error, significant, mde)."""
    size = F.format_string("%+.3f ±%.3f", F.col("mean_diff"), 1.96 * F.col("std_error"))
    return (
        F.when(F.col("n") == 0, "no paired cases")
        .when(~F.col("variance_observed") & (F.col("mean_diff") == 0), "identical on every pair")
        .when(F.col("n") == 1, F.concat(F.lit("one pair only: "), size))
        .when(~F.col("variance_observed"), F.concat(F.lit("the same difference on every pair: "), size))
        .when(F.col("significant"), F.concat(F.when(F.col("mean_diff") > 0, "higher: ").otherwise("lower: "), size))
        .otherwise(F.concat(F.lit("within noise: "), size, F.format_string(", detectable from %.3f", F.col("mde"))))
    )


def board_verdict(entries: DataFrame, top_pair: DataFrame) -> DataFrame:
    """One line on a leaderboard from its ranked entries and the paired statistics of its first two."""
    first = F.min_by("label", F.struct("rank", "label"))
    d = entries.agg(F.count(F.lit(1)).alias("entries"), first.alias("leader"), F.count_if(F.col("rank") == 1).alias("tied")).join(F.broadcast(top_pair))
    says = (
        F.when(F.col("entries") < 2, "a single entry")
        .when(F.col("tied") > 1, "tied at the top")
        .when(F.col("n") == 0, "the first two share no case")
        .when(~F.col("variance_observed") & (F.col("mean_diff") == 0), "the first two are identical")
        .when(F.col("significant"), F.concat(F.col("leader"), F.lit(" leads")))
        .otherwise(F.concat(F.col("leader"), F.lit(" leads within noise")))
    )
    return d.select("entries", "leader", says.alias("verdict"))


def comparison_document(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paired statistics for every key of ``(case_id, key, value)`` that both runs have, in one pass."""
    both = a.select("case_id", "key", F.col("value").alias("va")).join(b.select("case_id", "key", F.col("value").alias("vb")), ["case_id", "key"]).withColumn("diff", F.col("vb") - F.col("va"))
    d = both.groupBy("key").agg(
        F.count("diff").alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.coalesce(F.avg("diff"), F.lit(0.0)).alias("mean_diff"), F.coalesce(F.sqrt(F.var_samp("diff") / F.count("diff")), F.lit(0.0)).alias("std_error")
    )
    low, high = F.col("mean_diff") - 1.96 * F.col("std_error"), F.col("mean_diff") + 1.96 * F.col("std_error")
    d = d.withColumns({"significant": (F.col("n") > 0) & ((low > 0) | (high < 0)), "mde": (1.96 + 0.84) * F.col("std_error"), "variance_observed": F.col("std_error") > 0})
    return d.withColumn("verdict", metric_verdict())


def run_document(cases: DataFrame, grades: DataFrame) -> DataFrame:
    """One row per case with its graders as an array; metadata and skill sources stay out."""
    g = grades.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "grader_scope", "score", "passed", "skipped"))).alias("graders"))
    return cases.join(g, "case_id", "left").withColumn("graders", F.coalesce("graders", F.array()))


def upsert_index(index: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """The index with rows of ``new`` in place of those of the same key."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def history(snapshots: DataFrame, keep: int, key: str = "slug", at: str = "generated") -> DataFrame:
    """The last ``keep`` snapshots of each key (a bounded trail is the feature), newest first."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return snapshots.withColumn("age", nth).where(F.col("age") <= keep)


def recommendations(summary: DataFrame, gap: DataFrame, tags: DataFrame) -> DataFrame:
    """Advice from a run's summary row, its scope gap, and its three commonest failure tags (of two or more)."""
    rows = F.array(
        F.when(F.col("pass_rate") < 0.5, "Less than half of the cases pass: look at the failure patterns first."),
        F.when(F.col("score_std") > 0.3, "Scores vary widely between cases."),
        F.when(F.col("diagnosis").startswith("outcome"), "Answers are better than the way to them: look at process graders."),
        F.when(F.col("diagnosis").startswith("transcript"), "The way is better than the answers: look at outcome graders."),
    )
    own = summary.join(F.broadcast(gap)).select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("advice"))
    top = tags.where("occurrences >= 2").orderBy(F.desc("occurrences"), "tag").limit(3)
    return own.unionByName(top.select(F.format_string("Failure tag %s: %d times.", F.col("tag"), F.col("occurrences")).alias("advice")))


def steps(traces: DataFrame, trial_id: str) -> DataFrame:
    """A trace's calls in order, as a viewer shows them."""
    from ..functions.scalars import compact

    d = traces.where(F.col("trial_id") == trial_id).select(F.explode("tool_calls").alias("c"))
    return d.select("c.pos", "c.tool_name", "c.status", "c.duration_ms", compact(F.col("c.input")).alias("input"), compact(F.col("c.output")).alias("output")).orderBy("pos")


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "good").when(score >= 0.4, "medium").otherwise("poor")


__all__ = ["band", "board_verdict", "comparison_document", "history", "metric_verdict", "paired_stats", "recommendations", "run_document", "steps", "upsert_index"]
