"""Language ID: held-out accuracy, mixtures, and odd rows."""

import os
import zlib

import numpy as np
import pytest

from spanloom.llm import langid
from spanloom.llm.langid import detect, identify, mixture, op5_langid, train

SF = "/root/testdata/sf0.001"


def test_mixture_recovers_proportions():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    scores = np.where(truth[:, None], [0.0, -9.0, -30.0], [-9.0, 0.0, -30.0])
    theta, _ = mixture(scores)
    assert abs(theta[0] - truth.mean()) < 0.01 and theta[2] < 0.01


def test_odd_rows_and_mixed_text(spark, odd_docs):
    model = train(odd_docs)
    assert model.langs == ["en", "fr"]
    rows = identify(odd_docs, model).collect()
    assert len(rows) == 9
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert got[1] == "en" and got[6] == "fr" and got[3] == got[4] == got[5] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    lang, score, shares, _ = detect("the cat looked at the moon and sat " * 20 + "un chat est sur la table " * 5, model)
    assert lang == "en" and set(shares) == {"en", "fr"} and 0.6 < score < 0.95
    assert detect("12 34 !!", model)[0] == "und"


def test_langs_are_the_selected_set(spark, odd_docs):
    for r in identify(odd_docs, train(odd_docs)).collect():
        assert [x["lang"] for x in r["langs"][:1]] == ([r["lang_pred"]] if r["lang_pred"] != "und" else [])
        assert not r["langs"] or abs(sum(x["share"] for x in r["langs"]) - 1) < 1e-6


def test_slices_cut_no_word(spark, odd_docs, monkeypatch):
    text = " ".join(f"le{'chat' * (i % 7)}" for i in range(400))
    model = train(odd_docs)
    whole = langid.word_scores(text, model)
    monkeypatch.setattr(langid, "_SLICE", 50)
    assert "".join(langid._slices(text)) == text and all(p[-1] == " " for p in list(langid._slices(text))[:-1])
    cut = langid.word_scores(text, model)
    assert np.allclose(whole[0], cut[0]) and whole[1] == cut[1]
    assert "".join(langid._slices("x" * 333)) == "x" * 333


def test_gain_tells_noise_from_languages(spark):
    model = train(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert min(detect(t, model)[3] for t in docs) > 1
    for t in ("qzx xkcd wvvq zzzj qqkx jjxw", "我们认为这些真理是不言而喻的 人人生而平等", "SGVsbG8gd29ybGQhIFRoaXMgaXMgYmFzZTY0IGVuY29kZWQ"):
        assert detect(t, model)[3] < -5


def test_nothing_to_learn_from(spark, odd_docs):
    model = train(odd_docs.where("false"))
    assert {r["lang_pred"] for r in identify(odd_docs, model).collect()} == {"und"}
    assert identify(odd_docs.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in op5_langid(spark, SF).collect() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
