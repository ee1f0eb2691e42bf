"""Packing whole documents into fixed-length sequences by cutting-stock column generation.

A document's ids (its text's and an end id) are cut into full sequences and one remainder.  Remainders fall into
size classes of ``unit`` tokens; the histogram of classes (at most capacity / unit rows, whatever the input) goes
to the driver, where patterns are planned; ranked pieces then take their places from the small table of patterns.

Null and empty texts are one piece that holds the end id alone; repeated rows are packed each on their own; an
empty table gives no piece; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import buckets_for, keep, salted_rank, spread, table
from .cutting_stock import plan
from .tokens import encode

CAPACITY, UNIT = 2048, 8
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: the document's ids cut at multiples of ``capacity``."""

    def batches(it):
        for b in it:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py(), tokenizer)
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    for col, v in zip(rows, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return spread(docs.select("doc_id", "text")).mapInArrow(batches, _PIECE)


def _places(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """For each pattern and size: the ranks [lo, hi) of the size's pieces, ``each`` of them to a bin from bin ``base``."""
    rows, base, used = [], 0, dict.fromkeys(histogram, 0)
    for times, held in plan(histogram, capacity):
        slot = 0
        for size in sorted(held, reverse=True):
            n = held[size]
            rows.append((size, used[size], used[size] + n * times, n, base, slot))
            used[size] += n * times
            slot += n
        base += times
    return pd.DataFrame(rows, columns=["size", "lo", "hi", "each", "base", "slot0"]).astype("int64")


def pack(docs: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, tokenizer: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset; every sequence holds at most ``capacity`` ids, gapless from 0."""
    spark = docs.sparkSession
    cut = cut_pieces(docs, capacity, tokenizer).withColumn("row_key", F.monotonically_increasing_id())
    pieces = keep(cut.withColumn("size", F.ceil(F.col("length") / unit).cast("long")), "pieces")
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = spark.createDataFrame(_places(histogram, capacity // unit))
    ranked = salted_rank(pieces, "size", "row_key", buckets_for(sum(histogram.values()), 20_000, 64))
    at = (F.col("rank_in_key") - F.col("lo"))
    placed = ranked.join(F.broadcast(places), "size").where("rank_in_key >= lo AND rank_in_key < hi")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor(at / F.col("each"))).withColumn("slot", F.col("slot0") + at % F.col("each"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), offset.alias("offset"))


def op2_packing(spark, sf_dir):
    """Every piece of every document with its place."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
