"""Components against a plain search; edges inside what is one component already are not read again."""

import random

from spanloom.llm import components


def test_components_shrink_their_edges(spark, monkeypatch):
    dense = [(a, b) for a in range(30) for b in range(a)]
    path = [(100 + i, 101 + i) for i in range(40)]
    rng = random.Random(1)
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    pairs = dense + path + loose + [(300, 400), (400, 301), (301, 399), (399, 302), (5, 5), (None, 7)]
    kept, keep = [], components.keep
    monkeypatch.setattr(components, "keep", lambda df, tag: (lambda out: kept.append((tag, out.count())) or out)(keep(df, tag)))
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in root:
        for a, b in pairs:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    edges = [n for tag, n in kept if tag == "cc-edges"]
    assert len(edges) > 1 and edges[1] < 60 < edges[0] and edges[-1] == 0
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
