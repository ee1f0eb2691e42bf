"""SimHash near-dedup by multi-index hashing.

``fingerprints`` turns every whole text into a 64-bit SimHash of its 4-word shingles.  ``link_fingerprints``
links fingerprints at Hamming distance ``radius`` or less.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import forget, keep, lookup, spread, table
from .components import connected_components

_BLOCK = 1 << 16


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; 0 where the text has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1]
    stops = ends[width - 1 :]
    n, votes = len(starts), np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        pairs = zip(starts[at : at + _BLOCK].tolist(), stops[at : at + _BLOCK].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(((votes * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprint_batches(batches):
    """Arrow batches (doc_id, text) to (doc_id, fp): fp is the fingerprint's bits as a signed long."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        fps = np.fromiter((simhash(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs):
    """(doc_id, fp) for every row of ``docs(doc_id, text)``.  Null and wordless texts have fingerprint 0."""
    return spread(docs.select("doc_id", "text")).mapInArrow(fingerprint_batches, "doc_id long, fp long")


#: What sending a probe costs against testing one fingerprint that it meets.
PROBE_COST = 20


def plan_segments(rows: int, radius: int) -> list[tuple[int, int, int]]:
    """(low bit, width, ball radius) of each segment, by the general pigeonhole rule.

    The radii r_i satisfy sum(r_i + 1) > ``radius``: fingerprints at distance ``radius`` or less then agree within
    r_i on at least one segment i.  Of 2 to 8 segments that number is taken whose probes and meetings, for so many
    evenly spread fingerprints, cost least; buckets stay small at any size.
    """

    def cut(m: int) -> list[tuple[int, int, int]]:
        cuts, radii = [64 * i // m for i in range(m + 1)], [-1] * m
        for k in range(radius + 1):
            radii[k % m] += 1
        return [(a, b - a, r) for a, b, r in zip(cuts, cuts[1:], radii) if r >= 0]

    def cost(segments: list[tuple[int, int, int]]) -> float:
        return sum(sum(comb(w, i) for i in range(r + 1)) * (PROBE_COST + rows / 2**w) for _, w, r in segments)

    return min(map(cut, range(2, 9)), key=cost)


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def link_fingerprints(fps, radius: int = 4):
    """(src, dst) of distinct fingerprints ``fps(fp)`` that differ in ``radius`` bits or less.

    Multi-index hashing: every fingerprint stands in one table per segment; every fingerprint also probes each
    table with the small Hamming ball around its own segment.  Whole distances are verified inside the join, so
    only true links leave it.
    """
    segments = plan_segments(fps.count(), radius)

    def value(low, width):
        return F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << width) - 1))

    shelf = F.array(*[F.struct(F.lit(i).alias("seg"), value(a, w).alias("key")) for i, (a, w, _) in enumerate(segments)])

    def ball(i, low, width, r):
        flips = F.array(*[F.lit(x).cast("long") for x in _ball(width, r)])
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("seg"), value(low, width).bitwiseXOR(x).alias("key")))

    balls = [ball(i, *s) for i, s in enumerate(segments)]
    kept = fps.select(F.col("fp").alias("dst"), F.explode(shelf).alias("k")).select("dst", "k.seg", "k.key")
    probe = fps.select(F.col("fp").alias("src"), F.explode(reduce(F.concat, balls)).alias("k")).select("src", "k.seg", "k.key")
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)
    on = (probe.seg == kept.seg) & (probe.key == kept.key) & near
    # a probe table is far larger than its source's size suggests: it must never be broadcast
    return probe.hint("merge").join(kept, on).select("src", "dst")


def near_duplicates(docs, radius: int = 4):
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links.  Null and wordless texts share fingerprint 0 and
    are linked like any other; a null doc_id never becomes a component_id unless its component has no other;
    repeated rows are each returned; an empty table gives an empty result.
    """
    own = keep(fingerprints(docs), "simhash")
    classes = keep(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    roots = connected_components(link_fingerprints(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = keep(rooted.join(least, "root").select("fp", "copies", "component_id"), "simhash-named")
    forget(classes)
    return lookup(own, named, "fp")


def op1_simhash(spark, sf_dir):
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
