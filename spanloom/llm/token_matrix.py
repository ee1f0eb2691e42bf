"""Token-id matrices: best-fit-decreasing packing with a segment tree over free capacity.

Each task packs its own documents in windows of a fixed number of tokens, so memory is bounded, nothing is
shuffled and a lost task is repeated alone.  Overlong documents are cut losslessly at multiples of the row
length.  A matrix row is padded with ``PAD_ID``; lengths say what is real.

Null and empty texts hold the end id alone; repeated rows are packed each on their own; an empty table gives no
matrix; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread, table
from .tokens import encode

ROW_TOKENS, MATRIX_ROWS, WINDOW_TOKENS, PAD_ID = 2048, 128, 1 << 21, 0
#: Matrices that a task can number, and rows that a matrix can have: with a task's 31 bits, ids stay within 63 bits.
_MATRIX_BITS, _ROW_BITS = 20, 12

_SEGMENT = pa.struct([("row", pa.int32()), ("offset", pa.int32()), ("length", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64())])
_MATRIX = pa.schema([
    ("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("row_tokens", pa.int32()), ("ids", pa.binary()),
    ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.list_(pa.int32()))), ("segments", pa.list_(_SEGMENT)),
])
MATRIX_DDL = (
    "matrix_id long, n_rows int, row_tokens int, ids binary, position_ids binary, cu_seqlens array<array<int>>, "
    "segments array<struct<row:int,offset:int,length:int,doc_id:long,start:long>>"
)
PIECE_DDL = "doc_id long, start long, length long, sequence_id long, offset long, ids_crc32 long, resets long"


class CapacityTree:
    """Open bins by free capacity; ``take(n)`` removes one with the least capacity that holds n."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.full = [0] * (2 * self.width)  # open bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.width
        while i:
            self.full[i] += n
            i >>= 1

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(bin, its capacity), or None where no open bin is large enough."""
        i = least + self.width
        while not self.full[i]:  # up to the first subtree to the right that has a bin
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if self.full[2 * i] else 2 * i + 1
        capacity = i - self.width
        self._add(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions; longest items first, ties by position."""
    tree, bins = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item])
        if found is None:
            bins.append([])
            found = len(bins) - 1, capacity
        at, room = found
        bins[at].append(item)
        tree.put(room - lengths[item], at)
    return bins


def _matrices(pieces: list, first_id: int, row_tokens: int, matrix_rows: int):
    """Arrow batches of one matrix each for a window's pieces (doc_id, start, ids)."""
    bins = best_fit_decreasing([len(p[2]) for p in pieces], row_tokens)
    for k in range(0, len(bins), matrix_rows):
        part = bins[k : k + matrix_rows]
        ids = np.full((len(part), row_tokens), PAD_ID, dtype="<u4")
        positions = np.zeros((len(part), row_tokens), dtype="<u4")
        sums, segments = [], []
        for row, items in enumerate(part):
            ends = [0]
            for i in items:
                doc, start, own = pieces[i]
                at = ends[-1]
                ids[row, at : at + len(own)] = own
                positions[row, at : at + len(own)] = np.arange(len(own))
                segments.append({"row": row, "offset": at, "length": len(own), "doc_id": doc, "start": start})
                ends.append(at + len(own))
            sums.append(ends)
        values = [first_id + k // matrix_rows], [len(part)], [row_tokens], [ids.tobytes()], [positions.tobytes()], [sums], [segments]
        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, _MATRIX)], schema=_MATRIX)


def first_matrix(part: int, made: int) -> int:
    """The next matrix id of a task that has made some."""
    if made >= (1 << _MATRIX_BITS) - WINDOW_TOKENS // MATRIX_ROWS:
        raise ValueError("a task has made too many matrices: read the input in smaller splits")
    return (part << _MATRIX_BITS) + made


def sequence_of(matrix_id: int, row: int) -> int:
    """One number for a row of a matrix."""
    return (matrix_id << _ROW_BITS) + row


def token_matrices(docs: DataFrame, row_tokens: int = ROW_TOKENS, matrix_rows: int = MATRIX_ROWS, window_tokens: int = WINDOW_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """One row per packed matrix of ``docs(doc_id, text)``.

    ids and position_ids are n_rows x row_tokens little-endian unsigned 32-bit integers; positions restart at 0
    with every segment.  cu_seqlens are each row's cumulative segment lengths from 0.  A task that would make more
    than a million matrices (hundreds of billions of tokens) raises an error, as its ids would run into another's.
    """
    if not 0 < matrix_rows <= 1 << _ROW_BITS:
        raise ValueError(f"a matrix has 1 to {1 << _ROW_BITS} rows")

    def batches(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        window, held, made = [], 0, 0
        for b in it:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py(), tokenizer)
                for at in range(0, len(ids), row_tokens):
                    window.append((doc, at, ids[at : at + row_tokens]))
                    held += len(window[-1][2])
                    if held >= window_tokens:
                        for m in _matrices(window, first_matrix(part, made), row_tokens, matrix_rows):
                            made += 1
                            yield m
                        window, held = [], 0
        yield from _matrices(window, first_matrix(part, made), row_tokens, matrix_rows)

    return spread(docs.select("doc_id", "text")).mapInArrow(batches, MATRIX_DDL)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Write matrices as Parquet with binary columns, to any store that Spark can write."""
    matrices.write.parquet(path)


def read_pieces(matrices: DataFrame) -> DataFrame:
    """The segments back out of the matrices: their place, the CRC-32 of their ids, and their position resets."""

    def batches(it):
        for b in it:
            rows = []
            for m in b.to_pylist():
                shape = (m["n_rows"], m["row_tokens"])
                ids = np.frombuffer(m["ids"], dtype="<u4").reshape(shape)
                positions = np.frombuffer(m["position_ids"], dtype="<u4").reshape(shape)
                for s in m["segments"]:
                    span = slice(s["offset"], s["offset"] + s["length"])
                    crc = zlib.crc32(ids[s["row"], span].tobytes())
                    resets = int((positions[s["row"], span] == 0).sum())
                    rows.append((s["doc_id"], s["start"], s["length"], sequence_of(m["matrix_id"], s["row"]), s["offset"], crc, resets))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=[c.split()[0] for c in PIECE_DDL.split(", ")])

    return matrices.mapInArrow(batches, PIECE_DDL)


def op8_token_matrix(spark, sf_dir):
    """Every packed segment, read back from the matrices."""
    return read_pieces(token_matrices(table(spark, sf_dir, "documents", "doc_id", "text")))
