"""The pipeline's near-duplicate stage and its five-word links against all pairs."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as cp  # noqa: E402

from spanloom.llm.similar_texts import shingles, similar_groups  # noqa: E402


def sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 9 * both >= 4 * (len(a) + len(b))


def test_the_stage_leaves_no_similar_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = dict(cp.STAGES)["near_duplicates"]
    got = stage(spark, docs, "").collect()
    own = [sets(r["text"]) for r in got]
    assert not [(i, j) for i in range(len(own)) for j in range(i) if similar(own[i], own[j])]
    before = cp.near_duplicate(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} < {r["doc_id"] for r in before}  # links that 4 bits don't make
    kept = {r["doc_id"] for r in got}
    for r in before:  # what went has a similar text of a smaller id
        assert r["doc_id"] in kept or any(similar(sets(r["text"]), sets(x["text"])) and x["doc_id"] < r["doc_id"] for x in before)


def test_groups_are_components_of_all_pairs(spark):
    """A large group of near copies, a chain, a passage that many quote, short and wordless texts."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(60)]
    texts += [" ".join(f"c{k}" for k in range(s, s + 40)) for s in range(0, 60, 4)]
    texts += [" ".join(["this passage is quoted by very many texts"] + [f"q{s}_{k}" for k in range(30)]) for s in range(60)]
    texts += ["one two", "One  two", "one two three", "", None, " \n", "a b c d e", "a b c d e f"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    own, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(own)):
        for j in range(i):
            if similar(own[i], own[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert {r["id"]: r["group"] for r in similar_groups(d).collect()} == want
    assert similar_groups(d.where(F.lit(False))).count() == 0
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and not len(shingles(None))


def test_numbers_do_not_depend_on_file_splits(spark):
    numbered = cp._numbered(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3))
    before, size = {tuple(r) for r in numbered.select("row", "doc_id").collect()}, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        few = cp._numbered(docs)
        own = {tuple(r) for r in few.select("row", "doc_id").collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        assert {tuple(r) for r in few.select("row", "doc_id").collect()} == own
        assert {tuple(r) for r in numbered.select("row", "doc_id").collect()} == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
