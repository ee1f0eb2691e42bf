"""Exact top-k against every distance."""

import random

from spanloom.llm.hamming_topk import sign_code, top_k


def brute(rows, queries, k):
    rows, out = {r for r in rows if None not in r}, []
    for q, c in {q for q in queries if None not in q}:
        near = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in rows if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_clusters_ties_copies_and_nulls(spark):
    rnd = random.Random(4)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    centres = [rnd.getrandbits(64) for _ in range(4)]
    rows = [(i, signed(centres[i % 4] ^ sum(1 << rnd.randrange(64) for _ in range(i % 7)) % 2**64)) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[3], rows[3], (None, 5), (7777, None)]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(-1, signed(rnd.getrandbits(64))), (-2, None)]
    df = spark.createDataFrame(rows, "id long, code long").selectExpr("*", "1 AS q", "2 AS seg", "3 AS rank", "4 AS copies")
    qs = spark.createDataFrame(queries, "id long, code long")
    assert sorted(tuple(r) for r in top_k(df, qs, 5).collect()) == brute(rows, queries, 5)
    few = spark.createDataFrame(rows[:3], "id long, code long")
    assert sorted(tuple(r) for r in top_k(few, qs, 5).collect()) == brute(rows[:3], queries, 5)
    assert top_k(df.limit(0), qs, 5).count() == 0 and top_k(df, qs.limit(0), 5).count() == 0


def test_sign_code(spark):
    vs = [([1.0] * 64,), ([-1.0] * 63 + [2.0],), (None,), ([1.0, None],), ([],), ([1.0] + [0.0] * 63 + [-2.0, 1.0],)]
    df = spark.createDataFrame(vs, "e array<float>")
    assert [r[0] for r in df.select(sign_code("e")).collect()] == [-1, -(2**63), None, None, None, 2]
