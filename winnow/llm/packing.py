"""Packing token ids into windows by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document fills whole windows of its own while it is long enough; what
remains goes to the open window that it fits most tightly. When it fits none and no further window may be opened, the fullest
is emitted. What is still open at a partition's end is merged: the windows of 16 partitions at a time, largest first, again
by best fit. So memory is bounded by the number of open windows, whatever the size of the input.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import as_bytes, free_name, saved, slices
from winnow.llm.tokens import END_ID, encoder_of, send_tokenizer

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"
NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open"]
PARTITION_BITS = 32  # a window's id is its partition's number, then its own


class OpenWindows:
    """At most `most` windows by room left; put() gives the windows to emit, each a list of pieces."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next = size, most, first_id
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.pieces: dict[int, list] = {}

    def put(self, doc_id, ids: bytes):
        n = len(ids) // 4
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            yield False, [self._piece(doc_id, ids, at, self.size, n, self._new(), 0)]
        if n == whole:
            return
        need = n - whole
        k = bisect_left(self.rooms, (need, -1))
        if k < len(self.rooms):
            room, w = self.rooms.pop(k)
        else:
            if len(self.rooms) == self.most:
                yield False, self.pieces.pop(self.rooms.pop(0)[1])
            room, w = self.size, self._new()
            self.pieces[w] = []
        self.pieces[w].append(self._piece(doc_id, ids, whole, need, n, w, self.size - room))
        if room == need:
            yield False, self.pieces.pop(w)
        else:
            insort(self.rooms, (room - need, w))

    def rest(self):
        for w in sorted(self.pieces):
            yield True, self.pieces[w]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    @staticmethod
    def _piece(doc_id, ids, at, length, n, window, offset):
        return doc_id, at, length, n, window, offset, ids[at * 4 : (at + length) * 4]


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, open_windows: int = 64, end_id: int = END_ID, merge: int = 16) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids (little-endian unsigned 32-bit).

    A null text counts as empty: its document is the end id alone. Every row is packed, repeated rows and null ids too. A
    document up to the window's size is never cut. No rows: no pieces. Which window a piece is in depends on how the input
    is split into partitions; that every id lies in exactly one piece does not.
    """
    sent = send_tokenizer(docs.sparkSession, tokenizer)
    end = struct.pack("<I", end_id)

    def run(batches):
        windows, encoder, held = OpenWindows(size, open_windows, TaskContext.get().partitionId() << PARTITION_BITS), encoder_of(sent), []

        def take(emitted):
            held.extend((*piece, still_open) for still_open, pieces in emitted for piece in pieces)

        def full(least):
            if len(held) > least:
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), [pa.int64()] * 6 + [pa.binary(), pa.bool_()], strict=True)], names=NAMES)
                held.clear()
                yield out

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(as_bytes(batch.column("text"))), strict=True):
                take(windows.put(doc_id, ids + end))
            yield from full(1000)
        take(windows.rest())
        yield from full(0)

    pieces = saved(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces", partitionBy="open")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rooms, out = [], []
        for w, fill in sorted(zip(pdf["sequence_id"], pdf["fill"], strict=True), key=lambda x: (-x[1], x[0])):
            k = bisect_left(rooms, (fill, -1))
            room, into = rooms.pop(k) if k < len(rooms) else (size, w)
            out.append((w, into, size - room))
            insort(rooms, (room - fill, into))
        return pd.DataFrame(out, columns=["window", "into", "shift"])

    left = pieces.where("open")
    fills = left.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    moves = fills.groupBy(F.floor(F.shiftright("sequence_id", PARTITION_BITS) / merge)).applyInPandas(merged, "window long, into long, shift long")
    left = left.join(moves, left["sequence_id"] == moves["window"]).withColumns({"sequence_id": F.col("into"), "offset": F.col("offset") + F.col("shift")})
    names = [c for c in NAMES if c != "open"]
    return pieces.where("not open").select(names).unionAll(left.select(names))


def _digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document.

    A null or empty text is the end id alone; repeated rows and null ids are packed one by one; see pack().
    """
    return _digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs as they were written: by file name, which Spark numbers by partition, and row. A scan deals large files out first.

    Without files, or with columns that no longer show their files, docs as they are.
    """
    names = [free_name(docs, "file"), free_name(docs, "place")]
    try:
        placed = docs.withColumns({names[0]: F.col("_metadata.file_name"), names[1]: F.col("_metadata.row_index")})
    except AnalysisException:
        return docs
    return placed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, with their ids; nulls, empty texts and repeated rows as in pack().

    Documents are taken in the order in which the stage before wrote them, so windows follow it, by sequence_id, as far as a
    document waits in an open window at most.
    """
    return pack(in_file_order(docs))
