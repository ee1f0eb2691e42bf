"""LM scoring with an Elias-Fano bigram trie that is built, queried and dropped shard by shard.

Documents are dealt into chunks, words into shards by hash.  A chunk sends each shard its distinct words and
bigrams with their training counts; a shard adds them up, builds its trie in a memory-mapped file, and answers
each chunk in the order of its request; a chunk then scores its documents.  So each word and bigram travels once
per chunk, whatever its frequency, and no task holds the whole model.

The model is an interpolated absolute-discount bigram model over an add-one unigram model:
p(w|v) = max(c(vw) - D, 0) / c(v.) + D * t(v) / c(v.) * p1(w), with 8-bit quantised logarithms of the two factors.

Null and empty texts are one end token; null doc_ids are held in training never; repeated rows are scored (and
learned) each on their own; an empty table gives an empty result; extra columns are ignored.  With no training
token every word has the add-one probability of an empty corpus.
"""

from __future__ import annotations

import mmap
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buckets_for, table
from .elias_fano import BigramTrie

DISCOUNT, CHUNK_BYTES, PIECE_BYTES = 0.75, 8 << 20, 1 << 20
_STEP = 12.0 / 254  # decimal logarithms from 0 down to -12 in codes 1..255; code 0 is "none"
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_MULTIPLIER = 0x9E3779B97F4A7C15
_END, _BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_REQUEST = "chunk int, shard int, words binary, counts binary, children binary, followers binary, follower_counts binary"
_ANSWER = "chunk int, shard int, counts binary, backoff binary, codes binary, tokens long, types long"
_SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 for 0."""
    log = np.log10(np.where(p > 0, p, 1))
    return np.where(p > 0, 1 + np.clip(np.rint(-log / _STEP), 0, 254), 0).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) * _STEP), 0.0)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased bytes, in order: a polynomial over random byte values, mixed."""
    a = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    start, stop = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    up, down = _power_tables(len(a) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[a] * up[: len(a)], dtype=np.uint64)])
    return _mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes):
    """A long text in pieces that end at white space."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        m = _BREAK.search(data, at + PIECE_BYTES)
        if m is None:
            break
        yield data[at : m.end()]
        at = m.end()
    yield data[at:]


def document_hashes(text: str | None) -> np.ndarray:
    """A document's word hashes and the end token's."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return np.concatenate([*(word_hashes(p) for p in _pieces(data)), [_END]])


class _Chunk:
    """A chunk's documents as word numbers: ``words`` sorted, ``tokens`` and each token's predecessor by number."""

    def __init__(self, texts):
        docs = [document_hashes(t.as_py()) for t in texts]
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words, numbers = np.unique(np.concatenate([*docs, [_BEGIN]]), return_inverse=True)
        self.tokens = numbers[:-1].astype(np.int64)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = numbers[-1]
        self.begin = int(numbers[-1])

    def bigrams(self):
        """(bigrams as before * words + token, sorted; the bigram number of each token)."""
        return np.unique(self.before * len(self.words) + self.tokens, return_inverse=True)


def _shards(words: np.ndarray, n: int) -> np.ndarray:
    """The position of each shard's first word among sorted words, and the end."""
    shard = ((words >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(n + 1, dtype=np.uint64))


def _request(docs: pa.Table, n_shards: int) -> pa.Table:
    c = _Chunk(docs.column("text").combine_chunks())
    learn = np.repeat(docs.column("learn").to_numpy().astype(bool), c.lengths)
    pairs, number = c.bigrams()
    counts = np.bincount(c.tokens[learn], minlength=len(c.words)).astype("<u4")
    pair_counts = np.bincount(number[learn], minlength=len(pairs)).astype("<u4")
    children = np.bincount(pairs // len(c.words), minlength=len(c.words)).astype("<u4")
    followers = (c.words[pairs % len(c.words)] >> np.uint64(32)).astype("<u4")
    cuts = _shards(c.words, n_shards)
    pair_cuts = np.concatenate([[0], np.cumsum(children, dtype=np.int64)])[cuts]
    rows: list[list] = [[] for _ in range(7)]
    for s in range(n_shards):
        w, p = slice(cuts[s], cuts[s + 1]), slice(pair_cuts[s], pair_cuts[s + 1])
        values = docs.column("chunk")[0].as_py(), s, c.words[w].tobytes(), counts[w].tobytes(), children[w].tobytes(), followers[p].tobytes(), pair_counts[p].tobytes()
        for col, v in zip(rows, values):
            col.append(v)
    return _arrow(rows, _REQUEST)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _arrow(columns, ddl: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")))
    return pa.table([pa.array(c, type=_ARROW[k]) for c, k in zip(columns, kinds)], names=list(names))


def _joined(table_: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all rows' arrays in one, their lengths)."""
    arrays = [np.frombuffer(x.as_buffer(), dtype=kind) for x in table_.column(name)]
    return np.concatenate(arrays), np.array([len(a) for a in arrays], dtype=np.int64)


def _answer(requests: pa.Table) -> pa.Table:
    """Add up a shard's counts, build its trie, and answer every chunk."""
    words, sizes = _joined(requests, "words", "<u8")
    counts = _joined(requests, "counts", "<u4")[0]
    children = _joined(requests, "children", "<u4")[0].astype(np.int64)
    followers, pair_sizes = _joined(requests, "followers", "<u4")
    pair_counts = _joined(requests, "follower_counts", "<u4")[0]
    all_words, number = np.unique(words, return_inverse=True)
    totals = np.zeros(len(all_words), dtype=np.int64)
    np.add.at(totals, number, counts.astype(np.int64))
    pairs, pair_number = np.unique((np.repeat(number, children).astype(np.uint64) << np.uint64(32)) | followers, return_inverse=True)
    pair_totals = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(pair_totals, pair_number, pair_counts.astype(np.int64))
    seen = pair_totals > 0
    parent, follower, c = (pairs[seen] >> np.uint64(32)).astype(np.int64), (pairs[seen] & np.uint64(0xFFFFFFFF)), pair_totals[seen]
    after = np.bincount(parent, weights=c, minlength=len(all_words))
    types = np.bincount(parent, minlength=len(all_words))
    level1 = np.flatnonzero((totals > 0) | (types > 0))
    buffer = BigramTrie.build(
        all_words[level1], totals[level1], types[level1], follower,
        quantise(DISCOUNT * types[level1] / np.maximum(after[level1], 1)), quantise((c - DISCOUNT) / after[parent]),
    )
    with tempfile.TemporaryFile() as f:
        f.write(buffer)
        f.flush()
        del buffer
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as view:
            trie = BigramTrie.open(view)
            rank = trie.find(all_words)
            known = rank >= 0
            word_counts, backoff = np.zeros(len(rank), dtype="<u4"), np.zeros(len(rank), dtype=np.uint8)
            word_counts[known], backoff[known] = trie.counts[rank[known]], trie.backoff[rank[known]]
            codes = trie.follow(rank[(pairs >> np.uint64(32)).astype(np.int64)], (pairs & np.uint64(0xFFFFFFFF)))
            del trie
    in_base = all_words != _BEGIN
    tokens, kinds = int(totals[in_base].sum()), int((totals[in_base] > 0).sum())
    ends, pair_ends = np.cumsum(sizes), np.cumsum(pair_sizes)
    rows: list[list] = [[] for _ in range(7)]
    for i, chunk in enumerate(requests.column("chunk").to_pylist()):
        w, p = slice(ends[i] - sizes[i], ends[i]), slice(pair_ends[i] - pair_sizes[i], pair_ends[i])
        values = chunk, requests.column("shard")[0].as_py(), word_counts[number[w]].tobytes(), backoff[number[w]].tobytes(), codes[pair_number[p]].tobytes(), tokens, kinds
        for col, v in zip(rows, values):
            col.append(v)
    return _arrow(rows, _ANSWER)


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of a chunk's documents from the answers of all shards."""
    if not docs.num_rows:
        return _arrow([[]] * 6, _SCORES)
    answers = answers.sort_by("shard")
    c = _Chunk(docs.column("text").combine_chunks())
    number = c.bigrams()[1]
    counts = _joined(answers, "counts", "<u4")[0].astype(np.float64)
    backoff = restore(_joined(answers, "backoff", np.uint8)[0])
    codes = _joined(answers, "codes", np.uint8)[0]
    train, types = sum(answers.column("tokens").to_pylist()), sum(answers.column("types").to_pylist())
    base = (counts + 1) / (train + (types + 1))
    alone = base[c.tokens]
    backed = np.where(backoff > 0, backoff, 1.0)[c.before]
    p = restore(codes)[number] + backed * alone
    known = (counts > 0).astype(np.int64)[c.tokens]
    sums = [np.add.reduceat(x, c.starts) for x in (known, np.log10(alone), np.log10(np.minimum(p, 1.0)))]
    n = docs.num_rows
    return _arrow([docs.column("doc_id").to_numpy(zero_copy_only=False) if not docs.column("doc_id").null_count else docs.column("doc_id").to_pylist(), c.lengths, sums[0], np.full(n, train), sums[1], sums[2]], _SCORES)


def score_documents(docs: DataFrame, learn, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``, learning from the rows where ``learn`` holds.

    A chunk holds about ``chunk_bytes`` of text.  Chunks send rows to shards in number the square of the chunks',
    so chunks should grow on larger clusters as far as a worker's memory allows (it needs about 15 times as much).
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets_for(total, chunk_bytes)
    learn = F.coalesce(learn, F.lit(False)).alias("learn")
    row = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    dealt = docs.select("doc_id", "text", learn, row.alias("chunk"))
    requests = dealt.groupBy("chunk").applyInArrow(lambda t: _request(t, n), _REQUEST)
    answers = requests.groupBy("shard").applyInArrow(_answer, _ANSWER)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score, _SCORES)


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op9_lm_score(spark, sf_dir):
    """Token counts, base score and model score of every document."""
    scored = score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), _fold(7) != 2)
    return scored.select("doc_id", F.coalesce(_fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
