"""Helpers shared by the training-data operators: table access, shared scratch tables, prefix sums.

Scratch tables are Parquet directories below ``spark.checkpoint.dir`` (the folder that driver and
executors share).  A written table cuts lineage: a lost executor costs a re-read, never a recompute of
the whole chain.  Only when that setting is empty and Spark runs in one process (unit tests) is a folder of our own
used; on a cluster an empty setting is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.partitions import spread

__all__ = ["buckets_for", "forget", "forget_since", "free_shuffles", "keep", "lookup", "salted_rank", "scratch_mark", "scratch_root", "spread", "table"]

_SCRATCH: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table, pruned to ``cols`` (extra columns never travel)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables, one sub-folder for each application."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir() + "/spanloom-scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return the re-read table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = []
        atexit.register(_sweep, spark, app)
    _SCRATCH[app].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a scratch table that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
        _SCRATCH.get(df.sparkSession.sparkContext.applicationId, []).remove(path)


def scratch_mark(spark: SparkSession) -> int:
    """Where the list of scratch tables stands now."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, []))


def forget_since(spark: SparkSession, mark: int, but: DataFrame) -> None:
    """Delete the scratch tables made since a mark, but for one."""
    for path in _SCRATCH.get(spark.sparkContext.applicationId, [])[mark:]:
        if path != but._scratch_path:
            _delete(spark, path)
            _SCRATCH[spark.sparkContext.applicationId].remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now, and not when the driver next collects its garbage.

    Long chains of steps call it where a large shuffle has just been written out to a scratch table.
    """
    spark.sparkContext._jvm.System.gc()


def _sweep(spark: SparkSession, app: str) -> None:
    for path in _SCRATCH.pop(app, []):
        try:
            _delete(spark, path)
        except Exception:  # the session or this table is gone already; the others are tried all the same
            continue


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """How many buckets of about ``per_bucket`` rows hold ``rows`` rows."""
    return max(least, -(-int(rows) // per_bucket))


#: A key is dealt over so many tasks if it has more rows than this and more than a thousandth of all.
SALTS, HOT_ROWS = 32, 10_000


def lookup(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``names(key, copies, ...)``, one row for each key, except copies.

    ``copies`` counts the key's rows.  Keys with very many rows are dealt over SALTS tasks; there are at most a
    thousand of those, so only their hashes go to the driver and into the plan.
    """
    sizes = names.agg(F.sum("copies").alias("total"), F.max("copies").alias("most")).first()
    limit = max(HOT_ROWS, (sizes["total"] or 0) // 1000)
    if (sizes["most"] or 0) <= limit:
        return rows.join(names.drop("copies"), key)
    hashed = F.xxhash64(key)
    hot = [r[0] for r in names.where(F.col("copies") > limit).select(hashed).distinct().collect()]
    names = names.drop("copies")
    is_hot = hashed.isin(hot)
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(names.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def salted_rank(df: DataFrame, key: str, order: str, n_buckets: int, rank: str = "rank_in_key") -> DataFrame:
    """0-based rank of each row within ``key`` without ever sorting a whole key in one task.

    Rows of a key are dealt over ``n_buckets`` hash buckets of ``order`` (unique in a key); each bucket is
    ranked on its own and shifted by the sizes of the key's earlier buckets.  The order is therefore a fixed
    pseudo-random one.  The table of sizes has at most keys x n_buckets rows and is joined, not collected.
    """
    from pyspark.sql import Window

    d = df.withColumn("_b", F.pmod(F.xxhash64(F.col(order)), F.lit(n_buckets)).cast("int"))
    sizes = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(key, "_b").orderBy(order)
    d = d.withColumn("_r", F.row_number().over(within) - 1)
    return d.join(sizes, [key, "_b"]).withColumn(rank, F.col("_r") + F.col("_shift")).drop("_b", "_r", "_shift")
