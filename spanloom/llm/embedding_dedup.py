"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own.  A tile's integer products (exact in float32 over
1,024 dimensions; longer vectors sum such slices in float64) bound each cosine from both sides: what is surely above
or below the threshold is settled, and only pairs in between are recomputed in double precision.

Blocks are as large as a task's memory allows, but enough of them that all cores have tiles: a vector travels once
for each block, and the number of tiles follows the cores and, beyond that, the square of the input over the memory.

Equal vectors are one class, so copies never meet in pairs.  A tile returns one row per class with a link, not
its links.  Vectors that are null, empty, zero, hold a null or non-finite component, or whose length differs from
the rest's (dimension is part of the class) link with nothing of another length; they keep their row.  A null
vec_id takes part but names no component unless its component has no other; repeated rows each count; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import buckets_for, keep, lookup, table
from .components import connected_components

#: Components in a block at most, products held at once, vectors in a block at least, and tiles for each core.
THRESHOLD, BLOCK_VALUES, STRIP_VALUES, LEAST_ROWS, TILES_PER_CORE = 0.95, 1 << 21, 1 << 22, 256, 3
_EXACT_DIM, MAX_TASKS = 1 << 10, 20_000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the rounding errors) of unit row vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, error + 1e-12


def linked(a: np.ndarray, b: np.ndarray, threshold: float, qa=None, qb=None) -> np.ndarray:
    """The matrix of cosine >= threshold between unit rows of ``a`` and ``b``."""
    (ca, sa, ea), (cb, sb, eb) = qa or quantise(a), qb or quantise(b)
    rough = ca[:, :_EXACT_DIM].astype(np.float32) @ cb[:, :_EXACT_DIM].astype(np.float32).T
    if a.shape[1] > _EXACT_DIM:
        rough = rough.astype(np.float64)
        for at in range(_EXACT_DIM, a.shape[1], _EXACT_DIM):
            s = slice(at, at + _EXACT_DIM)
            rough += ca[:, s].astype(np.float32) @ cb[:, s].astype(np.float32).T
    rough *= sa[:, None].astype(np.float32)
    rough *= sb[None, :].astype(np.float32)
    # |u.v - rough| <= |eu||v'| + |ev||u'| + |eu||ev| with |v'| <= 1 + |ev|, and float32 rounding of the scaling
    most = ea.max() + eb.max() + 3 * ea.max() * eb.max() + 1e-5
    near = rough >= np.float32(threshold - most - 1e-6)
    i, j = np.nonzero(near)
    for at in range(0, len(i), 1 << 16):
        r, c = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        slack = ea[r] + eb[c] + 3 * ea[r] * eb[c] + 1e-5
        value = rough[r, c].astype(np.float64)
        holds = value - slack >= threshold
        doubt = np.flatnonzero(~holds & (value + slack >= threshold))
        holds[doubt] = np.einsum("ij,ij->i", a[r[doubt]], b[c[doubt]]) >= threshold
        near[r, c] = holds
    return near


def _vectors(rows) -> tuple[np.ndarray, np.ndarray]:
    """(float64 vectors, lengths) from equal-length float arrays, scaled so that lengths can't overflow."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x, np.linalg.norm(x, axis=1)


def _tile(left: pd.DataFrame, right: pd.DataFrame, threshold: float, same: bool) -> pd.DataFrame:
    """(key, links, root) for the classes of a tile's two blocks that have a link in it."""
    blocks = [left] if same else [left, right]
    units, quants = [], []
    for b in blocks:
        x, length = _vectors(b["embedding"])
        units.append(x / length[:, None])
        quants.append(quantise(units[-1]))
    keys = [b["key"].to_numpy(dtype=np.int64) for b in blocks]
    copies = [b["copies"].to_numpy(dtype=np.int64) for b in blocks]
    last = len(blocks) - 1
    links = [np.zeros(len(k), dtype=np.int64) for k in keys]
    pairs = []
    strip = max(16, STRIP_VALUES // max(1, len(keys[last])))
    for at in range(0, len(keys[0]), strip):
        s = slice(at, at + strip)
        near = linked(units[0][s], units[last], threshold, tuple(q[s] for q in quants[0]), quants[last])
        if same:
            rows = np.arange(near.shape[0])
            near[rows, rows + at] = False
        links[0][s] += (near * copies[last][None, :]).sum(axis=1) if near.any() else 0
        if not same:
            links[1] += (near * copies[0][s][:, None]).sum(axis=0) if near.any() else 0
        i, j = np.nonzero(near)
        pairs.append(_spanning(keys[0][s][i], keys[last][j]))
    src = np.concatenate([p[0] for p in pairs])
    dst = np.concatenate([p[1] for p in pairs])
    root = dict(zip(*_spanning(src, dst)))
    out = pd.concat([pd.DataFrame({"key": k[n > 0], "links": n[n > 0]}) for k, n in zip(keys, links)])
    out["root"] = [root.get(k, k) for k in out["key"]]
    return out


def _spanning(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes of some links."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    i, j = at[: len(src)], at[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``.

    A block holds about ``block_values`` components, whatever their number per vector, so a tile's memory is fixed.
    """
    v = F.col("embedding")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.where("fine")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = keep(classes.withColumn("key", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark, linked_rows = vectors.sparkSession, None
    for dim, n in sizes.items():
        part = _tiles(classes.where(F.col("dim") == dim), blocks_for(n, dim, spark.sparkContext.defaultParallelism, block_values), threshold)
        linked_rows = part if linked_rows is None else linked_rows.unionByName(part)
    if linked_rows is None:
        linked_rows = spark.createDataFrame([], "key long, links long, root long")
    linked_rows = keep(linked_rows, "tiles")
    roots = connected_components(linked_rows.select(F.col("key").alias("src"), F.col("root").alias("dst")))
    links = linked_rows.groupBy("key").agg(F.sum("links").alias("links"))
    rooted = classes.join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    named = keep(named, "vectors-named")
    out = lookup(good, named, "embedding").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def blocks_for(rows: int, dim: int, cores: int, block_values: int = BLOCK_VALUES) -> int:
    """Blocks for so many vectors: as memory asks, and where rows allow, enough for a few tiles a core."""
    wanted = math.ceil(math.sqrt(2 * TILES_PER_CORE * cores))
    return max(buckets_for(rows, max(1, block_values // dim)), min(wanted, buckets_for(rows, LEAST_ROWS)))


def _tiles(classes: DataFrame, n_blocks: int, threshold: float) -> DataFrame:
    """The links of every pair of blocks; each block travels once to each of its tiles."""
    blocked = classes.select("key", "copies", "embedding", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    tiled = blocked.select("key", "copies", "embedding", "block", F.explode(others).alias("other"))
    tiled = tiled.select("key", "copies", "embedding", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        pdf = pdf.sort_values("key", kind="stable")
        left, right = pdf[pdf["block"] == a], pdf[pdf["block"] == b]
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "links": [], "root": []}).astype("int64")
        return _tile(left, right, threshold, a == b)

    # a task holds one tile at a time, two blocks at most, whatever the input; beyond MAX_TASKS it has several in turn
    return tiled.repartition(min(MAX_TASKS, n_blocks * (n_blocks + 1) // 2), "a", "b").groupBy("a", "b").applyInPandas(run, "key long, links long, root long")


def op3_embedding_dedup(spark, sf_dir):
    """vec_id, n_links, component_id and kept of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
