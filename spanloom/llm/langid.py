"""Language identification as a multilingual mixture.

Each word of a document has a likelihood under each language (its character uni-, bi- and trigrams).  The
document is a mixture of languages over its words; expectation-maximisation estimates the proportions, and the
set of languages is shrunk while the log-likelihood lost by a language is less than its penalty.

Null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing is labelled;
repeated rows are each answered; an empty table gives an empty result; extra columns are ignored.  Very long texts
are read whole, in slices that end where a word ends (a run of 2 x ``_SLICE`` characters without one is cut).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import spread, table

BITS = 17
#: About so many labelled documents of each language are learned from, whatever the size of the input.
DOCS_PER_LANG = 2000
SMOOTH = 0.01
UNKNOWN = "und"
_SLICE = 1 << 19
_ORDERS = ((0x9E3779B1, 0, 0), (0x85EBCA77, 0xC2B2AE3D, 0), (0x27D4EB2F, 0x165667B1, 0xD3A2646C))


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # 2^BITS x languages
    flat: float = 0.0  # the log-likelihood of an n-gram if all that were seen in any language were equally likely


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(text: str) -> tuple[list[np.ndarray], np.ndarray]:
    """(a table index per letter for each n-gram order, first letters of words by position among letters)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    c = np.full(len(points) + 2, 32, dtype=np.uint32)
    c[1:-1][letter] = points[letter]
    at = np.flatnonzero(letter) + 1
    left, mid, right = c[at - 1], c[at], c[at + 1]
    index = []
    for a, b, d in _ORDERS:
        h = mid * np.uint32(a) + left * np.uint32(b) + right * np.uint32(d)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        index.append(h >> np.uint32(32 - BITS))
    return index, np.flatnonzero(left == 32)


_GAP = re.compile(r"\s")


def _slices(text: str):
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _SLICE, at + 2 * _SLICE)
        end = gap.end() if gap else at + 2 * _SLICE
        yield text[at:end]
        at = end


def word_scores(text: str, model: Model) -> tuple[np.ndarray, int]:
    """(the log-likelihood of each word (rows) under each language (columns), letters)."""
    parts, letters = [], 0
    for piece in _slices(text):
        index, starts = _grams(piece)
        if len(index[0]):
            letters += len(index[0])
            total = model.log_p[index[0]] + model.log_p[index[1]] + model.log_p[index[2]]
            parts.append(np.add.reduceat(total, starts if len(starts) and starts[0] == 0 else np.r_[0, starts], axis=0))
    return np.concatenate(parts) if parts else np.zeros((0, len(model.langs)), dtype=np.float32), letters


def mixture(scores: np.ndarray, rounds: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of the languages over the words by expectation-maximisation."""
    top = scores.max(axis=1, keepdims=True)
    likely = np.exp(scores - top)
    theta = np.full(scores.shape[1], 1 / scores.shape[1], dtype=np.float64)
    for _ in range(rounds):
        joint = likely * theta
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        moved, theta = np.abs(new - theta).max(), new
        if moved < tolerance:
            break
    return theta, float(np.log((likely * theta).sum(axis=1)).sum() + top.sum())


def detect(text: str | None, model: Model) -> tuple[str, float, dict[str, float], float]:
    """(language, its proportion, proportions of the languages selected, gain).

    The gain is the mixture's log-likelihood a letter above that of letters that follow no language at all, with
    every n-gram ever seen equally likely: below 0, no language learned explains the text.
    """
    scores, letters = word_scores(text or "", model) if model.langs else (np.zeros((0, 0)), 0)
    scores = scores.astype(np.float64)
    if not len(scores):
        return UNKNOWN, 0.0, {}, 0.0
    chosen = np.arange(len(model.langs))
    theta, fit = mixture(scores)
    penalty = 2.0 + 0.5 * np.log(len(scores))
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), theta.argmin())
        less, fit_less = mixture(scores[:, chosen[rest]]) if len(rest) > 1 else (np.ones(1), float(scores[:, chosen[rest[0]]].sum()))
        if fit - fit_less > penalty:
            break
        chosen, theta, fit = chosen[rest], less, fit_less
    best = int(theta.argmax())
    shares = {model.langs[i]: float(t) for i, t in zip(chosen, theta)}
    return model.langs[chosen[best]], float(min(1.0, theta[best])), shares, fit / letters - len(_ORDERS) * model.flat


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``; rows with a null in any of them teach nothing.

    The sample is a fixed one by hash of doc_id: about ``docs_per_lang`` whole documents of each language.
    """
    labelled = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(docs_per_lang / sizes[lang]))])
    draw = (F.xxhash64(F.lit("language"), "doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    sample = labelled.where(draw < share[F.col("lang")])

    def count(it):
        totals: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}

        def add(lang: str) -> None:
            totals[lang] = totals.get(lang, 0) + np.bincount(np.concatenate(held.pop(lang)), minlength=1 << BITS)

        for b in it:
            for text, lang in zip(b.column(1), b.column(2).to_pylist()):
                for piece in _slices(text.as_py()):
                    held.setdefault(lang, []).extend(_grams(piece)[0])
                    if sum(map(len, held[lang])) > 1 << 21:
                        add(lang)
        for lang in list(held):
            add(lang)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "gram", "n"])

    grams = spread(sample).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << BITS, len(langs)))
    counts[grams["gram"].to_numpy(dtype=np.int64), grams["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = grams["n"].to_numpy(dtype=np.int64)
    flat = -float(np.log(max(1, int((counts.sum(axis=1) > 0).sum()))))
    return Model(langs, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (1 << BITS))).astype(np.float32), flat)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, langs) of every row of ``docs(doc_id, text)``; langs has all that were selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows by languages, whatever the input

    def batches(it):
        own = shared.value
        for b in it:
            found = [detect(t.as_py(), own) for t in b.column(1)]
            shares = [sorted(f[2].items(), key=lambda x: (-x[1], x[0])) for f in found]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64()),
                    pa.array([[{"lang": k, "share": v} for k, v in own] for own in shares], type=kind),
                ],
                names=["doc_id", "lang_pred", "score", "langs"],
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(batches, "doc_id long, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs(text, lang, ...)`` whose text a learned language explains; a null lang becomes the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        for b in it:
            found = [detect(t.as_py(), shared.value) for t in b.column("text")]
            given = b.column("lang").to_pylist()
            at = b.schema.get_field_index("lang")
            filled = pa.array([f[0] if g is None else g for f, g in zip(found, given)], type=b.schema.field(at).type)
            keep = pa.array([f[0] != UNKNOWN and f[3] >= 0 for f in found], type=pa.bool_())
            yield b.set_column(at, b.schema.field(at), filled).filter(keep)

    return spread(docs).mapInArrow(batches, docs.schema)


def op5_langid(spark, sf_dir):
    """doc_id, held_out, lang_pred, score and langs (the selected set with proportions) of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(_fold(4) != 2))
    return identify(docs, model).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs")
