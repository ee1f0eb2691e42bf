"""How rows lie in partitions and are joined, and where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder that spark.checkpoint.dir names; its plan is a scan again.

    Only where that setting is empty and Spark runs in one process is a folder of our own used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not root and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="spanloom-"))
    return df.checkpoint()


def merged(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sorting and merging, never by broadcast.

    Spark counts a variant at 2 KB a row but leaves an explosion's size as it was, so what is left once the variant is
    dropped looks forty times smaller than it is, and millions of rows would be gathered and broadcast by the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it is a bare scan in far fewer pieces (small files in few row groups)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString() or 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores)
