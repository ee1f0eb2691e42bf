"""Every pipeline stage against a plain re-computation."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as cp  # noqa: E402

from spanloom.llm.langid import detect, train  # noqa: E402
from spanloom.llm.mixing import NULL, TARGETS  # noqa: E402
from spanloom.llm.pii import redact  # noqa: E402
from spanloom.llm.simhash import simhash  # noqa: E402

from .plain_mixing import budgets  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, odd_docs, tmp_path_factory):
    """Documents and odd rows in one Parquet table."""
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    real = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    odd = odd_docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), F.lit(1).alias("extra"))
    real.unionByName(odd).write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return Counter(tuple(r) for r in df.select(*cp.COLUMNS).collect())


def test_language_keeps_what_a_language_explains(spark, docs):
    noise = [(901, "qzx xkcd wvvq zzzj qqkx jjxw vvkq", "en", "a", 1), (902, "我们认为这些真理是不言而喻的", None, "a", 1), (903, "12 34 !!", None, "a", 1)]
    docs = docs.unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(2)))
    model = train(docs)
    want = Counter()
    for (i, t, lang, source, n), times in rows(docs).items():
        pred, _, _, gain = detect(t, model)
        if pred != "und" and gain >= 0:
            want[i, t, lang or pred, source, n] += times
    got = rows(cp.language(spark, docs, SF))
    assert got == want and not {901, 902, 903} & {r[0] for r in got} and all(r[2] for r in got)
    real = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert real <= {r[0] for r in got}  # clean documents stay
    assert (2, "en") in {(r[0], r[2]) for r in got}  # a null label is filled


def test_near_duplicates_keep_one_of_each_component(spark, docs):
    have = [tuple(r) for r in docs.select(*cp.COLUMNS).collect()]
    fps = [simhash(r[1]) for r in have]
    root = list(range(len(have)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(have)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(have):
        groups.setdefault(find(i), []).append(r)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values())
    got = cp.near_duplicate(spark, docs, SF).select(*cp.COLUMNS).collect()
    assert Counter(r["doc_id"] for r in got) == want
    assert not Counter(tuple(r) for r in got) - Counter(have)


def test_personal_data(spark, docs):
    want = Counter()
    for (i, t, a, b, n), k in rows(docs).items():
        want[i, redact(t), a, b, None if t is None else len(redact(t))] += k
    assert rows(cp.personal_data(spark, docs, SF)) == want


def test_mixture_follows_budgets(spark, docs):
    leaf = F.struct(cp.domain_of(F.col("source")), F.coalesce("lang", F.lit(NULL)), F.coalesce("source", F.lit(NULL)))
    size = cp.word_count(F.col("text"))
    have, most = {}, {}
    for r in docs.select(leaf.alias("leaf"), size.alias("n")).collect():
        have[tuple(r["leaf"])] = have.get(tuple(r["leaf"]), 0) + r["n"]
        most[tuple(r["leaf"])] = max(most.get(tuple(r["leaf"]), 0), r["n"])
    got = cp.mixture(spark, docs, SF)
    assert not rows(got) - rows(docs)
    taken = Counter()
    for r in got.select(leaf.alias("leaf"), size.alias("n")).collect():
        taken[tuple(r["leaf"])] += r["n"]
    for k, budget in budgets(have, cp.BUDGET * sum(have.values()), 1, TARGETS).items():
        assert budget - 1 <= taken[k] <= budget + most[k]


def test_whole_run_and_empty_table(spark, docs):
    out = cp.run(spark, SF).collect()
    by_doc = Counter()
    for r in out:
        by_doc[r["doc_id"]] += r["length"]
    assert out and all(by_doc[r["doc_id"]] == r["doc_tokens"] for r in out)
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
