"""A training-data pipeline over ``documents`` in five stages, each an operator of the ``llm`` subpackage.

Every stage reads all that the one before kept, written as Parquet and read again:

1. language: documents whose text no learned language explains go (null texts, texts without a letter, and texts that
   the language mixture fits worse than letters in no order at all); a null lang becomes the language predicted;
2. near_duplicates: of each SimHash component the document with the smallest doc_id stays (of repeated rows, one), and
   then of each component of texts at a five-word similarity of 0.8 or more;
3. personal_data: every span is replaced by its kind, n_chars is the new length;
4. mixture: documents are taken to target weights of the domain-language-source tree, each at most once; the document
   in which a leaf's tokens end is kept whole;
5. packing: documents are packed into sequences, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanloom.llm.common import forget, forget_since, free_shuffles, keep, scratch_mark
from spanloom.llm.langid import recognised, train
from spanloom.llm.mixing import LEVELS, TARGETS, domain_of, mix, word_count
from spanloom.llm.packing import pack
from spanloom.llm.pii import redact_texts
from spanloom.llm.simhash import near_duplicates
from spanloom.llm.similar_texts import similar_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mixture's budget as a share of the tokens that reach it.
BUDGET = 0.9


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number of their own, so that repeated rows and null ids can be told apart.

    The number is written with its row: taken afresh in a later scan, it could differ with that scan's file splits.
    """
    return keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs)
    if not model.langs:  # nothing is labelled, so nothing can be told
        return docs.select(*COLUMNS).where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return recognised(docs.select(*COLUMNS), model)


def _one_of_each_component(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the documents that stay after op1's links, the scratch table that they are read from)."""
    numbered = _numbered(docs)
    found = near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ids = numbered.select("row", "doc_id").join(found, "row")
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return numbered.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select(*COLUMNS), numbered


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each_component(docs)[0]


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each SimHash component, then one of each component of five-word similarity 0.8 among those."""
    kept, behind = _one_of_each_component(docs)
    numbered = _numbered(kept)
    forget(behind)
    free_shuffles(spark)
    found = similar_groups(numbered.select(F.col("row").alias("id"), "text")).withColumnRenamed("id", "row")
    grouped = numbered.select("row", "doc_id").join(found, "row")
    first = F.row_number().over(Window.partitionBy("group").orderBy(F.col("doc_id").asc_nulls_last(), "row"))
    gone = grouped.withColumn("nth", first).where("nth > 1").select("row")
    return numbered.join(gone, "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_texts(docs.select(*COLUMNS)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = _numbered(docs)
    leaves = numbered.select(F.col("row").alias("doc_id"), domain_of(F.col("source")).alias("domain"), "lang", "source", word_count(F.col("text")).alias("n_tokens"))
    taken = mix(leaves, BUDGET, 1, LEVELS, TARGETS).select(F.col("doc_id").alias("row"))
    return numbered.join(taken, "row", "left_semi").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]
#: Trained models, hashes and a linear program are beyond SQL; tests hold each stage to a plain re-computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark, before = scratch_mark(spark), docs
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        forget_since(spark, mark, docs)  # what the stage needed on its way
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
