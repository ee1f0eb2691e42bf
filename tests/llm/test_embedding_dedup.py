"""Embedding near-dedup against all pairs in double precision."""

import math

import numpy as np

from spanloom.llm.embedding_dedup import linked, near_duplicates, op3_embedding_dedup


def brute(rows, threshold=0.95):
    good = {i: np.array(v, dtype=np.float64) / max(map(abs, v)) for i, v in enumerate(r[1] for r in rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / (np.linalg.norm(good[i]) * np.linalg.norm(good[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], first[find(i)], r[0] == first[find(i)]) for i, r in enumerate(rows))


def test_linked_is_exact_near_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 16))
    b = a + rng.normal(size=a.shape) * 0.32
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    assert (linked(a, b, 0.95) == (a @ b.T >= 0.95)).all() and linked(a, b, 0.95).any()


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = [(100 - i, [float(x) for x in centre[i % 6] + rng.normal(size=8) * 0.2]) for i in range(60)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] + [1.0] * 7), (205, [])]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, [2 * x for x in rows[0][1]]), (302, [1e200, 1e200]), (303, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS label", "2 AS key", "3 AS root", "4 AS copies")
    for block in (56, 1 << 19):
        got = sorted(tuple(r) for r in near_duplicates(df, block_values=block).collect())
        assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_small_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op3_embedding_dedup(spark, "/root/testdata/sf0.001").collect()) == brute(rows)
