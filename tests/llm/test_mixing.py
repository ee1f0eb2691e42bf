"""Mixing: budgets by hand, and selections against a plain re-computation of budgets, orders and prefixes."""

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanloom.llm import mixing
from spanloom.llm.mixing import ANY, NULL, TARGETS, mix, op6_mixing, word_count

from .plain_mixing import budgets, fill, weight

DDL = "a string, b string, tokens long"


def by_table(spark, have, total, epochs, weights=None):
    rows = [(*k, v) for k, v in have.items()]
    share = total / max(1, sum(have.values()))
    got = mixing.budgets(spark.createDataFrame(rows, DDL), ["a", "b"], share, epochs, weights or {}).collect()
    return {(r["a"], r["b"]): r["leaf_budget"] for r in got}


def test_shortages_go_to_siblings_first(spark):
    have = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    for f in (budgets, lambda *a: by_table(spark, *a)):
        assert f(have, 400, 1) == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
        short = have | {("a", "y"): 50}
        assert f(short, 400, 1) == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 340}
        assert f(short, 400, 1, {("b",): 3.0}) == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 340}
        assert f(have, 400, 1, {("b",): 3.0, (ANY, "x"): 0.0}) == {("a", "x"): 0, ("a", "y"): 100, ("b", "z"): 300}
        assert f(have, 10**9, 2) == {k: 2 * v for k, v in have.items()}
        assert f({}, 5, 1) == {}


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), st.integers(0, 500), min_size=1), st.floats(0, 2.5), st.integers(1, 3))
def test_budgets_are_those_of_plain_filling(spark, have, share, epochs):
    weights = {("a",): 2.5, (ANY, "x"): 3.0, ("b", "x"): 0.5, (ANY, "z"): 0.0}
    got = by_table(spark, have, share * sum(have.values()), epochs, weights)
    want = budgets(have, share * sum(have.values()), epochs, weights)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_fill_is_exact():
    assert fill(10, [1, 1, 2], [1, 100, 100]) == pytest.approx([1, 3, 6])
    assert fill(10, [1, 0], [3, 5]) == [3, 0]
    assert weight(TARGETS, ("domain9", "en")) == 5.0 and weight(TARGETS, ("domain9",)) == 1.0


def check(taken, have, want, epochs):
    """Each leaf's epochs hold all its documents, the last one a prefix of its order that spends the budget."""
    by_leaf = defaultdict(lambda: defaultdict(list))
    for r in taken:
        leaf = (r["domain"] or NULL, r["lang"] or NULL, r["source"] or NULL)
        assert r["leaf_budget"] == want[leaf] and 0 <= r["epoch"] < epochs
        by_leaf[leaf][r["epoch"]].append(r)
    for leaf, budget in want.items():
        docs, streams = have[leaf], by_leaf[leaf]
        tokens = sum(docs.values())
        assert sum(r["taken_tokens"] for e in streams.values() for r in e) == budget
        whole = min(epochs, budget // tokens) if tokens else 0
        assert set(streams) == set(range(whole + (budget > whole * tokens)))
        for e, rows in streams.items():
            got = Counter(r["doc_id"] for r in rows)
            if e < whole:
                assert got == Counter({d: 1 for d in docs}) and all(r["taken_tokens"] == r["n_tokens"] for r in rows)
                continue
            rows.sort(key=lambda r: r["draw"])
            assert max(got.values()) == 1 and all(r["taken_tokens"] == r["n_tokens"] for r in rows[:-1])
    return by_leaf


@pytest.mark.parametrize("share", [0.0, 0.35, 1.0, 2.0])
def test_selection(spark, monkeypatch, share):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    d = spark.range(600).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('d', id % 2) END AS domain",
        "CASE WHEN id % 50 = 0 THEN NULL ELSE 'en' END AS lang", "concat('s', id % 4) AS source", "id % 17 AS n_tokens", "1 AS copies", "2 AS _leaf", "3 AS _row", "4 AS draw", "5 AS epoch",
    )
    have = defaultdict(dict)
    for r in d.collect():
        have[(r["domain"], r["lang"] or NULL, r["source"])][r["doc_id"]] = r["n_tokens"]
    sums = {k: sum(v.values()) for k, v in have.items()}
    want = budgets(sums, share * sum(sums.values()), 2)
    taken = mix(d, share, 2).collect()
    streams = check(taken, have, want, 2)
    if share == 1.0:  # the epoch that ends early takes what comes first in an order that all its documents have
        whole = mix(d, 9.0, 2).collect()
        order = defaultdict(list)
        for r in whole:
            order[(r["domain"], r["lang"] or NULL, r["source"]), r["epoch"]].append((r["draw"], r["doc_id"], r["n_tokens"]))
        for leaf, epochs in streams.items():
            for e, rows in epochs.items():
                start, first = 0, []
                for _, doc, n in sorted(order[leaf, e]):
                    if start < want[leaf] - e * sums[leaf] or e < want[leaf] // max(1, sums[leaf]):
                        first.append(doc)
                    start += n
                assert sorted(r["doc_id"] for r in rows) == sorted(first)
        firsts, seconds = ([x[1] for x in sorted(v)] for v in (order[("hot", "en", "s1"), 0], order[("hot", "en", "s1"), 1]))
        assert firsts != seconds and sorted(firsts) == sorted(seconds)
    assert sorted(map(tuple, mix(d, share, 2).collect()), key=repr) == sorted(map(tuple, taken), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert sorted(map(tuple, mix(d, share, 2).collect()), key=repr) == sorted(map(tuple, taken), key=repr)
    assert mix(d.limit(0), share).count() == 0


def test_query_and_odd_rows(spark, odd_docs, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select(F.col("doc_id") + 10**9, "text", "lang", "source")
    docs = real.union(odd).withColumn("taken_tokens", F.lit(1))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    have = defaultdict(dict)
    for r in docs.select("*", mixing.domain_of(F.col("source")).alias("domain")).collect():
        have[(r["domain"], r["lang"] or NULL, r["source"] or NULL)][r["doc_id"]] = len((r["text"] or "").split())
    sums = {k: sum(v.values()) for k, v in have.items()}
    check(op6_mixing(spark, f"file://{tmp_path}").collect(), have, budgets(sums, sum(sums.values()), 2, TARGETS), 2)


def test_repeated_rows_are_taken_each(spark):
    d = spark.createDataFrame([(1, "x", 5)] * 4, "doc_id long, domain string, n_tokens long")
    got = mix(d, 0.6, 1, ("domain",)).collect()
    assert sorted(r["taken_tokens"] for r in got) == [2, 5, 5] and len({r["draw"] for r in got}) == 3


def test_words(spark, odd_docs):
    got = odd_docs.select("text", word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len((r["text"] or "").split()) for r in got)
