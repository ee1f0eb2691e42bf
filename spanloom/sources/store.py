"""Grade records, checkpoints and price lists."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import get
from .files import whole_files


def write_grades(grades: DataFrame, path: str, grade_set: str) -> None:
    """Append grade records under their grade set."""
    grades.withColumn("grade_set", F.lit(grade_set)).write.mode("append").partitionBy("grade_set").parquet(path)


def read_grades(spark: SparkSession, path: str, grade_set: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("grade_set") == grade_set)


def match_records(traces: DataFrame, records: DataFrame, regrade: bool = False) -> DataFrame:
    """(trace_id, fingerprint, state) of ``traces(trace_id, fingerprint)`` against earlier records of the same set.

    skipped: the record is of this fingerprint.  stale: of another one; it is still used unless ``regrade``.
    graded: there is none, or it is graded again.
    """
    old = records.select("trace_id", F.col("fingerprint").alias("old")).distinct().groupBy("trace_id").agg(F.max("old").alias("old"))
    d = traces.select("trace_id", "fingerprint").join(old, "trace_id", "left")
    state = F.when(F.col("old").isNull(), "graded").when(F.col("old") == F.col("fingerprint"), "skipped").otherwise("graded" if regrade else "stale")
    return d.select("trace_id", "fingerprint", state.alias("state"))


def grading_counts(matched: DataFrame) -> DataFrame:
    return matched.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("graded", "skipped", "stale")])


def save_checkpoint(results: DataFrame, path: str, run_id: str) -> None:
    """Append finished cases or trials of a run."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def unfinished(cases: DataFrame, path: str, run_id: str) -> DataFrame:
    """Cases of a run that no checkpoint has; a missing or empty store leaves all."""
    spark = cases.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return cases
    done = spark.read.option("mergeSchema", "true").parquet(path).where(F.col("run_id") == run_id)
    return cases.join(done.select("case_id"), "case_id", "left_anti")


def prices(spark: SparkSession, table: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(model, input, output, cached) in dollars per million tokens, from a mapping with any of the usual keys."""

    def of(d: Mapping, *names: str) -> float | None:
        return next((float(d[n]) for n in names if d.get(n) is not None), None)

    rows = [(m, of(p, "input", "input_per_million", "prompt"), of(p, "output", "output_per_million", "completion"), of(p, "cached", "cached_input", "cache_read")) for m, p in table.items()]
    return spark.createDataFrame(rows, "model string, input double, output double, cached double")


def _yaml_as_json():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import yaml

        def one(t: str | None) -> str | None:
            try:
                return json.dumps(yaml.safe_load(t or ""), default=str)
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return run


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price file, JSON or YAML: model to prices."""
    v = F.coalesce(F.try_parse_json("content"), F.try_parse_json(_yaml_as_json()("content")))
    d = whole_files(spark, path).select(F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("model", "p"))
    p = F.col("p")
    pick = lambda *n: F.coalesce(*[get(p, f"$.{x}", "double") for x in n])
    return d.select("model", pick("input", "input_per_million", "prompt").alias("input"), pick("output", "output_per_million", "completion").alias("output"), pick("cached", "cached_input", "cache_read").alias("cached"))


def write_run(path: str, spark: SparkSession, document: Mapping) -> None:
    """A small document as one JSON file, through Spark's committer."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
