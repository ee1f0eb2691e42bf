"""The trie against plain dictionaries, base scores against a plain re-computation, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ngram_lm as lm
from spanloom.llm.elias_fano import BigramTrie, EliasFano

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def tokens(text):
    return [*WORD.findall(lower(text or "")), None]


@pytest.mark.parametrize("values", [[], [0], [2**64 - 1], [3, 3, 3, 9], list(range(200)), sorted(x * x * 977 % 2**40 for x in range(900))])
def test_elias_fano(values):
    v = np.array(values, dtype=np.uint64)
    e, _ = EliasFano.from_buffer(EliasFano.build(v).to_bytes(), 0)
    assert e.access(np.arange(len(v))).tolist() == values
    q = np.array([0, 1, 5, 10, 2**33, 2**64 - 1, *values], dtype=np.uint64)
    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(v))
    assert e.successor(lo, hi, q).tolist() == np.searchsorted(v, q).tolist()


def test_trie():
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    kids = {int(w): sorted(set(rng.integers(0, 2**32, int(rng.integers(0, 9))).tolist())) for w in words}
    flat = [k for w in words for k in kids[int(w)]]
    codes = np.arange(len(flat)) % 255 + 1
    t = BigramTrie.open(BigramTrie.build(words, np.arange(len(words)), [len(kids[int(w)]) for w in words], flat, np.ones(len(words)), codes))
    assert (t.find(words) == np.arange(len(words))).all() and (t.find(words + np.uint64(1)) == -1).all()
    ranks = np.repeat(np.arange(len(words)), [len(kids[int(w)]) for w in words])
    assert (t.follow(ranks, np.array(flat)) == codes).all()
    assert (t.follow(ranks, np.array(flat) + 1) == [codes[i + 1] if i + 1 < len(flat) and ranks[i + 1] == ranks[i] and flat[i + 1] == x + 1 else 0 for i, x in enumerate(flat)]).all()


def test_word_hashes_tell_words_apart():
    a = lm.document_hashes("b a  ab\x0bAB ba é x a")
    assert len(a) == 8 and a[1] == a[6] and a[2] == a[3] and len(set(a.tolist())) == 6


def test_odd_rows_by_a_plain_model(spark, odd_docs):
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    train = [tokens(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    one, two, after, types = Counter(w for t in train for w in t), Counter(), Counter(), Counter()
    for t in train:
        two.update(zip(["<s>", *t], t))
    for (v, _), c in two.items():
        after[v] += c
        types[v] += 1
    n, v = sum(one.values()), len(one)

    def coarse(x):
        return lm.restore(lm.quantise(np.array([x])))[0]

    def expect(text):
        ts, base, score = tokens(text), 0.0, 0.0
        for p, w in zip(["<s>", *ts], ts):
            b = (one[w] + 1) / (n + v + 1)
            base += math.log10(b)
            a = coarse((two[p, w] - lm.DISCOUNT) / after[p]) if two[p, w] else 0
            score += math.log10(min(1, a + (coarse(lm.DISCOUNT * types[p] / after[p]) if after[p] else 1) * b))
        return len(ts), sum(one[w] > 0 for w in ts), n, base, score

    for size in (1000, 1 << 24):
        got = lm.score_documents(odd_docs, learn, chunk_bytes=size).collect()
        want = sorted((d if d is not None else -1, *expect(t)) for d, t in rows)
        have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *list(r)[1:]) for r in got)
        assert [h[:4] for h in have] == [w[:4] for w in want]
        assert np.allclose([h[4:] for h in have], [w[4:] for w in want])
    assert lm.score_documents(odd_docs.limit(0), learn).count() == 0
    nothing = lm.score_documents(odd_docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in nothing)


def test_held_out_gain(spark):
    rows = lm.op9_lm_score(spark, "/root/testdata/sf0.01").where("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.1 * n
