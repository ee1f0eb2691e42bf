"""SimHash: fingerprints by a plain loop, links and components by brute force."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from xxhash import xxh64_intdigest

from spanloom.llm.components import connected_components
from spanloom.llm.simhash import link_fingerprints, near_duplicates, op1_simhash, plan_segments, simhash


def plain(text, width=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x1cé ÀZ.", max_size=60))
def test_fingerprint(text):
    assert simhash(text) == plain(text)


def test_long_text_in_blocks():
    rnd = random.Random(1)
    text = " ".join(rnd.choice("abcdefghij") for _ in range(70_000))
    assert simhash(text) == plain(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 8])
@pytest.mark.parametrize("rows", [1, 10**3, 10**6, 10**9, 10**12])
def test_segments_cover_every_distance(rows, radius):
    segments = plan_segments(rows, radius)
    assert sum(r + 1 for _, _, r in segments) > radius
    assert all(a + w <= b for (a, w, _), (b, _, _) in zip(segments, segments[1:]))


def test_links_are_exactly_those_within_the_radius(spark):
    rnd = random.Random(2)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = sorted({signed(centres[i % 12] ^ sum(1 << b for b in rnd.sample(range(64), i % 9))) for i in range(250)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius in (0, 2, 4):
        want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
        assert {tuple(r) for r in link_fingerprints(df, radius).collect()} == want


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    ring = [(2000 + i, 2000 + (i + 1) % 31) for i in range(31)]
    odd = [(None, 5), (7000, 7000), (1000, 1001)]
    df = spark.createDataFrame(path + star + ring + odd, "src long, dst long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)} | {2000 + i: 2000 for i in range(31)}
    assert connected_components(df.limit(0)).count() == 0


def test_odd_documents(spark, odd_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, None: None}
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    roots = components([f for _, f in docs], 4)
    first = {}
    for (i, _), r in zip(docs, roots):
        first[r] = min(first.get(r, i), i)
    want = sorted((i, f"{f:016x}", first[r]) for (i, f), r in zip(docs, roots))
    assert sorted(tuple(r) for r in op1_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()) == want
