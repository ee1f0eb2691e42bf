"""Packing: exact round trips, full cover, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from spanloom.llm.cutting_stock import plan
from spanloom.llm.packing import op2_packing, pack
from spanloom.llm.token_matrix import CapacityTree, best_fit_decreasing, first_matrix, op8_token_matrix, read_pieces, sequence_of, token_matrices, write_matrices
from spanloom.llm.tokens import default_path, encode


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=12))
def test_plan_holds_the_demand(demand):
    held = defaultdict(int)
    for times, items in plan(demand, 32):
        assert sum(s * n for s, n in items.items()) <= 32
        for s, n in items.items():
            held[s] += n * times
    assert dict(held) == {s: n for s, n in demand.items() if n}


def test_plan_is_near_the_bound():
    demand = {s: 1000 for s in range(1, 64)}
    bins = sum(t for t, _ in plan(demand, 64))
    assert bins <= 1.01 * sum(s * n for s, n in demand.items()) / 64 + 5


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_tokenizers(text):
    slow = Tokenizer.from_file(default_path())
    assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids + [1]


def test_special_strings_follow_tokenizers():
    slow = Tokenizer.from_file(default_path())
    text = "a <|endoftext|> b"
    assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids + [1]


def check(rows, docs, capacity):
    """Gapless sequences and every id of every document row once."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for d in docs:
        ids = encode(d["text"])
        want[d["doc_id"]] += [(a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for a in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


def test_pack_odd_documents(spark, odd_docs):
    rows = pack(odd_docs, capacity=64, unit=8).collect()
    check(rows, odd_docs.collect(), 64)
    assert pack(odd_docs.limit(0)).count() == 0


def test_capacity_tree_is_best_fit():
    rng = np.random.default_rng(7)
    tree, plain = CapacityTree(50), []
    for i in range(2000):
        if rng.random() < 0.6:
            c = int(rng.integers(0, 51))
            tree.put(c, i)
            plain.append(c)
        else:
            n = int(rng.integers(0, 51))
            got, best = tree.take(n), min((c for c in plain if c >= n), default=None)
            assert (got and got[1]) == best
            if best is not None:
                plain.remove(best)


def test_best_fit_uses_each_item_once():
    bins = best_fit_decreasing([5, 9, 1, 10, 4, 6, 2], 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and len(bins) == 4


def test_ids_of_late_tasks_fit(spark):
    last = first_matrix(2**31 - 1, 0)
    assert sequence_of(last, 4095) < 2**63 and sequence_of(last, 0) > sequence_of(first_matrix(2**31 - 2, 10_000), 4095)
    with pytest.raises(ValueError):
        first_matrix(0, 1 << 20)
    with pytest.raises(ValueError):
        token_matrices(spark.range(0).selectExpr("id AS doc_id", "'' AS text"), matrix_rows=5000)


def test_queries_cover_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for query in (op2_packing, op8_token_matrix):
        rows = query(spark, "/root/testdata/sf0.001").collect()
        check(rows, docs, 2048)


def test_matrices_round_trip(spark, odd_docs, tmp_path):
    made = token_matrices(odd_docs, row_tokens=64, matrix_rows=3, window_tokens=2000)
    write_matrices(made, f"file://{tmp_path}/m")
    back = spark.read.parquet(f"file://{tmp_path}/m")
    rows = read_pieces(back).collect()
    check(rows, odd_docs.collect(), 64)
    assert all(r["resets"] == 1 for r in rows)
    for m in back.collect():
        lengths = defaultdict(int)
        for s in m["segments"]:
            lengths[s["row"]] += s["length"]
        assert [c[-1] for c in m["cu_seqlens"]] == [lengths[i] for i in range(m["n_rows"])]
    assert token_matrices(odd_docs.limit(0)).count() == 0
