"""Files beside traces: results of a harness, instances of a benchmark, skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import skill_name
from ..schemas import get
from .files import json_values

#: How many folders above a trajectory its harness's results may stand.
PARENTS = 4


def folder(path: Column, up: int = 1) -> Column:
    """The folder so many levels above a path."""
    return F.regexp_replace(path, "(/[^/]*){%d}$" % up, "")


def harness_results(traces: DataFrame, results: DataFrame, most: int = PARENTS) -> DataFrame:
    """(trace_id, task_id, trial_id, rewards): the nearest results file with a trial's name above each trajectory.

    ``traces(trace_id)`` are files; ``results(file, content)`` are results.json files.  Rewards are JSON for the trace's
    metadata, never its score; a trace without such a file keeps its own ids.
    """
    v = F.col("v")
    told = json_values(results).select(folder(F.col("file")).alias("folder"), get(v, "$.task_name").alias("s_task"), get(v, "$.trial_name").alias("s_trial"), F.to_json(F.coalesce(get(v, "$.verifier_result.rewards", "variant"), get(v, "$.rewards", "variant"))).alias("rewards")).where("s_trial IS NOT NULL")
    above = traces.select("trace_id", F.posexplode(F.array(*[folder(F.regexp_replace("trace_id", "#[0-9]+$", ""), i + 1) for i in range(most)])).alias("n", "folder"))
    return above.join(told, "folder").groupBy("trace_id").agg(*[F.min_by(c, "n").alias(c) for c in ("s_task", "s_trial", "rewards")])


def with_harness(traces: DataFrame, results: DataFrame) -> DataFrame:
    """Traces whose ids come from their harness's results where there are any, with the rewards in their metadata."""
    d = traces.join(harness_results(traces, results), "trace_id", "left")
    told = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    more = F.when(F.col("rewards").isNotNull(), F.to_json(F.map_concat(told, F.create_map(F.lit("harness_rewards"), F.col("rewards"))))).otherwise(F.col("metadata"))
    return d.select(*[
        F.coalesce("s_task", "task_id").alias(c) if c == "task_id" else F.coalesce("s_trial", "trial_id").alias(c) if c == "trial_id" else more.alias(c) if c == "metadata" else F.col(c) for c in traces.columns
    ])


def instances(files: DataFrame, ids: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Benchmark instances out of JSON arrays or lines ``(file, content)``; lists of tests may be JSON texts."""
    v = F.col("v")
    tests = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.from_json(get(v, f"$.{k}"), "array<string>"), F.array().cast("array<string>"))
    d = json_values(files).select(*[get(v, f"$.{k}").alias(k) for k in ("instance_id", "repo", "base_commit", "problem_statement", "patch", "test_patch")], tests("FAIL_TO_PASS").alias("fail_to_pass"), tests("PASS_TO_PASS").alias("pass_to_pass"))
    d = d.where("instance_id IS NOT NULL")
    d = d.where(F.col("instance_id").isin(*ids)) if ids else d
    return d.orderBy("instance_id").limit(limit) if limit is not None else d


def expected_tests(instance_rows: DataFrame) -> DataFrame:
    """(instance_id, test, kind) of each test that must turn or stay green."""
    kinds = F.concat(*[F.transform(c, lambda t, k=c: F.struct(t.alias("test"), F.lit(k).alias("kind"))) for c in ("fail_to_pass", "pass_to_pass")])
    return instance_rows.select("instance_id", F.explode(kinds).alias("x")).select("instance_id", "x.*")


def skills(files: DataFrame) -> DataFrame:
    """(skill, folder) of each SKILL.md among ``files(file, content)``."""
    d = files.where(F.lower("file").endswith("/skill.md"))
    return d.select(skill_name(F.col("content"), folder(F.col("file"))).alias("skill"), folder(F.col("file")).alias("folder"))
