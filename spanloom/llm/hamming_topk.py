"""Exact top-k search over 64-bit binary codes by incremental multi-index hashing.

Codes are cut into five to two segments, fewer for more rows, each with a table of its own.  In round r every open query
probes the keys at distance r of its segments and verifies whole distances.  When segments have been searched to
radii r_i, every code at distance sum(r_i + 1) - 1 or less has been seen, so a query closes as soon as that
covers its k-th verified distance.  A query's last round grows only as many segments as its bound needs.

Neighbours are ordered by (distance, id); a row is no neighbour of itself (same id).  Rows of equal codes are one
class that carries its k + 1 smallest ids, which is all an answer can use.  Rows and queries with a null id or
code are left out; repeated rows count once; fewer than k other rows give fewer neighbours; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import keep, spread, table

K, SALTS, _BATCH = 10, 16, 1 << 18


def sign_code(embedding: str):
    """64 sign bits: bit i is 1 where the components at i, i + 64, ... sum to more than 0; null for unusable vectors."""
    e = F.col(embedding)
    usable = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x))
    folds = F.sequence(F.lit(0), F.floor((F.size(e) - 1) / 64).cast("int"))
    one = F.lit(1).cast("long")

    def bit(i):
        total = F.aggregate(folds, F.lit(0.0), lambda a, j: a + F.coalesce(F.get(e, i + j * 64).cast("double"), F.lit(0.0)))
        return F.when(total > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))

    return F.when(usable, F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i))))


def segments_for(rows: int) -> list[tuple[int, int]]:
    """(low bit, width) of each segment: fewer and wider ones for more rows, in coarse classes.

    As measured with 51,282 codes: 18 s with four segments, 10 s with five, 11 s with six, 62 s with seven.
    """
    m = 5 if rows < 1 << 17 else 4 if rows < 1 << 23 else 3 if rows < 1 << 30 else 2
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _smallest(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each ``by``; a key's rows are cut before they are shuffled."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def _part(code, low: int, width: int):
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest of ``rows(id, code)`` for each of ``queries(id, code)``."""
    rows = rows.select("id", "code").dropna().distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    salted = salted.withColumn("_n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("_n") <= k + 1)
    members = keep(_smallest(salted.select("code", "id"), "code", ["id"], k + 1), "codes")
    classes = keep(members.groupBy("code").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "code-classes")
    asked = keep(queries.select("id", "code").dropna().distinct(), "queries")
    segments = segments_for(classes.count())
    shelf = F.array(*[F.struct(F.lit(s).alias("seg"), _part(F.col("code"), *cut).alias("key")) for s, cut in enumerate(segments)])
    shelves = classes.select("code", "first_id", "copies", F.explode(shelf).alias("k")).select("code", "first_id", "copies", "k.seg", "k.key")
    pending = keep(asked.select(F.col("code").alias("q"), F.lit(64).alias("bound")).distinct(), "open")
    best, widest, closed = None, max(w for _, w in segments), []
    for r in range(widest + 1):
        found = _probe(pending, shelves, segments, r)
        if best is not None:
            found = found.unionByName(best.join(pending.select("q"), "q", "left_semi"))
        now = keep(_smallest(found, "q", ["distance", "first_id"], k + 1), "best")
        so_far = F.sum("copies").over(Window.partitionBy("q").orderBy("distance", "first_id").rowsBetween(Window.unboundedPreceding, 0))
        kth = now.withColumn("ids", so_far).where(F.col("ids") >= k + 1).groupBy("q").agg(F.min("distance").alias("kth"))
        bound = pending.select("q").join(kth, "q", "left").select("q", F.coalesce("kth", F.lit(64)).alias("bound"))
        # whoever had a bound of len(segments) * (r + 1) - 1 or less is covered by now
        open_ = keep(bound.where(F.col("bound") > len(segments) * (r + 1) - 1), "open")
        closed.append(now.join(open_.select("q"), "q", "left_anti"))
        best, pending = now, open_
        if r == widest:
            closed.append(now.join(open_.select("q"), "q", "left_semi"))
        elif not open_.take(1):
            break
    done = closed[0]
    for part in closed[1:]:
        done = done.unionByName(part)
    ids = _smallest(done.select("q", "code", "distance").join(members, "code").select("q", "id", "distance"), "q", ["distance", "id"], k + 1)
    near = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(ids, "q").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _probe(pending: DataFrame, shelves: DataFrame, segments: list[tuple[int, int]], r: int) -> DataFrame:
    """Verified candidates that the open queries first meet in round r and that their bounds don't rule out."""
    m = len(segments)
    flips = [np.array([sum(1 << b for b in bits) for bits in combinations(range(width), r)], dtype=np.int64) for _, width in segments]

    def balls(it):
        for b in it:
            codes, bounds = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s, (low, width) in enumerate(segments):
                # radii r - 1 cover m * r - 1; each segment grown to r covers one more
                own = codes[bounds > m * r - 1 + s] if s else codes
                own_bounds = bounds[bounds > m * r - 1 + s] if s else bounds
                part = (own.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
                step = max(1, _BATCH // len(flips[s]))
                for at in range(0, len(own), step):
                    keys = part[at : at + step, None] ^ flips[s][None, :]
                    columns = np.repeat(own[at : at + step], len(flips[s])), np.repeat(own_bounds[at : at + step], len(flips[s])), np.full(keys.size, s, dtype=np.int32), keys.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "bound", "seg", "key"])

    probe = spread(pending.select("q", "bound")).mapInArrow(balls, "q long, bound int, seg int, key long")
    differ = probe["q"].bitwiseXOR(shelves["code"])
    apart = [F.bit_count(_part(differ, *cut)) for cut in segments]
    # met in an earlier round, or in this one through an earlier segment: counted there
    fresh = F.lit(True)
    for s in range(m):
        earlier = F.lit(True)
        for t in range(m):
            earlier = earlier & (apart[t] > (r if t < s else r - 1))
        fresh = fresh & ((probe["seg"] != s) | earlier)
    on = (probe["seg"] == shelves["seg"]) & (probe["key"] == shelves["key"]) & fresh & (F.bit_count(differ) <= probe["bound"])
    # a probe table is far larger than its source's size suggests: it must never be broadcast
    return probe.hint("merge").join(shelves, on).select("q", "code", F.bit_count(differ).cast("int").alias("distance"), "first_id", "copies")


def op10_topk(spark, sf_dir):
    """The ten nearest codes of every vector whose id is divisible by 20, among all vectors."""
    codes = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    codes = keep(codes, "sign-codes")
    found = top_k(codes, codes.where("id % 20 = 0"))
    return found.select(F.col("query_id").alias("query_vec_id"), "rank", F.col("id").alias("vec_id"), "distance")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_vec_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.e[i] > 0) <> (r.e[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_vec_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_vec_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
