"""Near copies by the Jaccard similarity of five-word shingles, every pair at ``LEAST`` or more found.

Prefix filtering: with the shingles of all texts in one fixed order, two texts that similar share one among the
first n - ceil(0.8 n) + 1 of each.  The order puts shingles that are common in a sample last, so what many texts
quote brings few together; a poor sample costs time, never a pair.  Candidates are confirmed on their whole sets.
Pairs inside a component that is known already are never tested, so a large group of near copies costs a spanning
set and not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import forget, free_shuffles, keep, spread
from .components import connected_components

WIDTH = 5
#: The least similarity as a fraction, so that no rounding decides.
LEAST = (4, 5)
#: One in so many texts is sampled for the order, at every size alike; common shingles told to every task.
SAMPLED, COMMON = 4, 200_000
#: Neighbours in a bucket that the first round looks at, and candidates of a text that a round tests at first.
NEAR, TESTS = 4, 8
#: Bits of the filter that tells which texts are candidates.
FILTER_BITS = 1 << 24


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as signed hashes, sorted; a shorter text is one shingle, a wordless one none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(1, len(words) - width + 1)
    spans = zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in spans), dtype=np.uint64, count=last).view(np.int64))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, how many sampled texts hold each) of the commonest shingles of a sample."""
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("order"), "id"), F.lit(SAMPLED)) == 0)

    def batches(it):
        for b in it:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()))], names=["shingle"])

    counts = spread(drawn).mapInArrow(batches, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas().sort_values("shingle")
    free_shuffles(docs.sparkSession)
    return top["shingle"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)


def _prefixes(docs: DataFrame) -> DataFrame:
    """(shingle, id, n, pos): the first shingles of each text, with the size of its set and their place in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def batches(it):
        common, times = shared.value
        for b in it:
            for key, text in zip(b.column("id"), b.column("text")):
                own = shingles(text.as_py())
                if not len(own):
                    continue
                weight = np.zeros(len(own), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    weight = np.where(common[at] == own, times[at], 0)
                first = own[np.lexsort((own, weight))][: len(own) + LEAST[0] * len(own) // -LEAST[1] + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first), pa.array(np.full(k, key.as_py())), pa.array(np.full(k, len(own), dtype=np.int32)), pa.array(np.arange(k, dtype=np.int32))],
                    names=["shingle", "id", "n", "pos"],
                )

    return spread(docs).mapInArrow(batches, "shingle long, id long, n int, pos int")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): the whole sets of the texts whose ids hash like one of ``ids``; texts themselves are never shuffled.

    A bitmap of FILTER_BITS hashes, of one size whatever the input, leaves out nearly all others; the joins that follow
    leave out the rest.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1  # bitmap functions count from 1
    maps = ids.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in maps.collect():  # FILTER_BITS / 32,768 rows of 4 KB at most
        at = (r["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def batches(it):
        held = shared.value
        for b in it:
            h = b.column("h").to_numpy()
            b = b.filter(pa.array((held[h >> 3] >> (h & 7)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t.as_py()) for t in b.column("text")], type=pa.list_(pa.int64()))], names=["id", "own"])

    return docs.select("id", "text", (place - 1).alias("h")).mapInArrow(batches, "id long, own array<long>")


def _fits(x: str, y: str):
    """Whether two rows of a bucket can be similar: from the first shingle they share, all that can follow must be enough."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return sum(LEAST) * left >= LEAST[0] * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _prefix_length(n):
    return n - F.ceil(n * LEAST[0] / LEAST[1]) + 1


def _counted(pairs: DataFrame) -> DataFrame:
    """(src, dst, shared): pairs (x, y) of bucket rows that can be similar by all prefix shingles they share.

    Of two prefixes the one that ends first in the order is decided: what it shares with the other text, it shares with
    the other prefix.  So no more can be shared than that and all behind the prefix.
    """
    first = F.col("x.id") < F.col("y.id")
    pick = lambda c, turn: F.when(first != F.lit(turn), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    ends = pairs.select(pick("id", False).alias("src"), pick("id", True).alias("dst"), pick("n", False).alias("n"), pick("n", True).alias("m"), _fits("x", "y").alias("fits"))
    d = ends.groupBy("src", "dst", "n", "m").agg(F.count(F.lit(1)).alias("shared"), F.max("fits").alias("fits")).where("fits")
    n, m, a = F.col("n"), F.col("m"), F.col("shared")
    most = a + F.greatest(F.least(n - _prefix_length(n), m - a), F.least(m - _prefix_length(m), n - a))
    return d.where(sum(LEAST) * most >= LEAST[0] * (n + m)).select("src", "dst", "shared")


def _neighbours(buckets: DataFrame) -> DataFrame:
    """(src, dst, shared): each row of a bucket with the next NEAR in the order of sizes, without a join.

    Only pairs that are neighbours in most buckets come out; the others wait for ``_across``.
    """
    order, row = Window.partitionBy("shingle").orderBy("n", "id"), F.struct("id", "n", "pos")
    d = buckets.select("shingle", "id", "n", row.alias("x"), *[F.lead(row, i + 1).over(order).alias(f"y{i}") for i in range(NEAR)])
    d = d.select("x", F.explode(F.array(*[f"y{i}" for i in range(NEAR)])).alias("y")).where("y IS NOT NULL")
    return _counted(d)


def _across(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, shared): pairs of a bucket that can be similar enough and are in no component together.

    Buckets of one component are left out; in the others, only rows outside the largest component meet the rest, so a
    large group of near copies costs its bucket's size and not its square.
    """
    b = buckets.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = b.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("k"))
    major = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    b = b.join(major, "shingle").select("shingle", "root", "major", F.struct("id", "n", "pos").alias("row"))
    x, y = b.where("root <> major").alias("l"), b.alias("r")
    once = (F.col("r.root") == F.col("r.major")) | (F.col("l.row.id") < F.col("r.row.id"))
    on = (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.root") != F.col("r.root")) & once
    return _counted(x.hint("merge").join(y, on).select(F.col("l.row").alias("x"), F.col("r.row").alias("y")))


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    ids = pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id")))
    sets = keep(_sets(docs, ids), "similar-sets")
    both = pairs.join(sets.select(F.col("id").alias("src"), F.col("own").alias("a")), "src").join(sets.select(F.col("id").alias("dst"), F.col("own").alias("b")), "dst")
    holds = sum(LEAST) * F.size(F.array_intersect("a", "b")) >= LEAST[0] * (F.size("a") + F.size("b"))
    out = keep(both.where(holds).select("src", "dst"), "similar-links")
    forget(sets)
    return out


def similar_groups(docs: DataFrame) -> DataFrame:
    """(id, group) of each of ``docs(id, text)``, ids unique, that has a near copy; group is its component's least id."""
    docs = docs.select("id", "text")
    found = _prefixes(docs).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("shingle")))
    buckets = keep(found.where("size > 1").drop("size"), "similar-buckets")
    free_shuffles(docs.sparkSession)
    tested = roots = links = None
    tests = TESTS
    while True:
        pairs = _neighbours(buckets) if roots is None else _across(buckets, roots)
        if tested is not None:
            pairs = pairs.join(tested, ["src", "dst"], "left_anti")
        # those that share most come first; what is left waits until the components are known
        pairs = keep(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("shared"), "dst"))), "similar-pairs")
        waiting = roots is None or not pairs.where(F.col("rank") > tests).isEmpty()
        now = keep(pairs.where(F.col("rank") <= tests).select("src", "dst"), "similar-tested")
        forget(pairs)
        new = _confirmed(docs, now)
        free_shuffles(docs.sparkSession)
        links = new if links is None else links.unionByName(new)
        tested = now if tested is None else tested.unionByName(now)
        roots, old = connected_components(links), roots
        if old is not None:
            forget(old)
        if not waiting:
            break
        tests = tests if old is None else tests * 4
    forget(buckets)
    return roots.select(F.col("node").alias("id"), F.col("root").alias("group"))
