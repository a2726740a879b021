"""Token-id files: independent zstandard frames, a trailing seek table with a checksum for each frame, and a document index.

A file is [frame]... [index: skippable frame 0x184D2A50] [seek table: skippable frame 0x184D2A5E]. The seek table is that of
the public zstd seekable format: for each frame its compressed and decompressed size and the low half of XXH64 of its
content; the index counts as an entry without content. The index has for each document its id and its number of ids, so a
reader seeks straight to the frames of the documents that were asked for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.common import as_bytes, file_system, new_path, saved, slices
from winnow.llm.tokens import END_ID, encoder_of, send_tokenizer

INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("stored", "<u4"), ("size", "<u4"), ("sum", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n", "<u8")])
MANIFEST = "shard long, path string, n_docs long, n_ids long"
INDEX = "doc_id long, shard long, path string, place long, start long, n_tokens long"


class ShardWriter:
    """Gathers documents into frames of about frame_bytes; close() adds the index and the seek table and puts the file in its place."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard

        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.attempt{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.out = self.fs.open_output_stream(self.part)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes, self.held, self.size = frame_bytes, [], 0
        self.entries, self.docs = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.held)
        for at in range(0, len(data), 1 << 30):  # a frame's sizes are 32 bits wide
            piece = data[at : at + (1 << 30)]
            frame = self.zstd.compress(piece)
            self.out.write(frame)
            self.entries.append((len(frame), len(piece), xxhash.xxh64_intdigest(piece) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> tuple[int, int]:
        if self.size:
            self._flush()
        docs = np.array(self.docs, DOC)
        index = struct.pack("<II", INDEX_MAGIC, docs.nbytes) + docs.tobytes()
        self.out.write(index)
        table = np.array([*self.entries, (len(index), 0, 0)], ENTRY)
        self.out.write(struct.pack("<II", SEEK_MAGIC, table.nbytes + 9) + table.tobytes() + struct.pack("<IBI", len(table), 0x80, FOOT_MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)  # a repeated task writes the same bytes
        return len(docs), int(docs["n"].sum())


class ShardReader:
    """Reads a shard's tables, then only the frames that hold what is asked for, each held against its checksum."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file, self.uri = fs.open_input_file(path), uri
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != FOOT_MAGIC or flags != 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        self.table = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, end - 9 - n * ENTRY.itemsize), ENTRY)
        self.at = np.concatenate(([0], np.cumsum(self.table["stored"], dtype=np.int64)))
        index = self.file.read_at(int(self.table["stored"][-1]), int(self.at[-2]))
        self.docs = np.frombuffer(index, DOC, offset=8)
        self.begin = np.concatenate(([0], np.cumsum(self.docs["n"], dtype=np.int64)))
        self.frame_begin = np.concatenate(([0], np.cumsum(self.table["size"][:-1], dtype=np.int64)))
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        import zstandard

        if self.last[0] != k:
            e = self.table[k]
            data = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(e["stored"]), int(self.at[k])), max_output_size=int(e["size"]))
            if len(data) != e["size"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != e["sum"]:
                raise ValueError(f"frame {k} of {self.uri} doesn't match its checksum")
            self.last = (k, data)
        return self.last[1]

    def ids(self, place: int) -> bytes:
        """The ids of the document in this place of the index."""
        a, b = int(self.begin[place]) * 4, int(self.begin[place + 1]) * 4
        k, out = int(np.searchsorted(self.frame_begin, a, "right")) - 1, []
        while a < b:
            base = int(self.frame_begin[k])
            piece = self.frame(k)[a - base : b - base]
            out.append(piece)
            a, k = a + len(piece), k + 1
        return b"".join(out)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, frame_bytes: int = 1 << 20, level: int = 1) -> DataFrame:
    """Write docs (doc_id, text) under path in ascending doc_id order, one file for each range of ids; returns the files' manifest.

    A null text counts as empty, so it has the end id alone. Null ids come first. Rows that share an id stand together,
    ordered by their text's hash; repeated rows are all written. No rows: no files.
    """
    sent = send_tokenizer(docs.sparkSession, tokenizer)
    end = struct.pack("<I", end_id)

    def run(batches):
        shard, encoder, writer = TaskContext.get().partitionId(), encoder_of(sent), None
        for batch in slices(batches):
            writer = writer or ShardWriter(f"{path}/ids-{shard:06d}.zst", frame_bytes, level)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(as_bytes(batch.column("text"))), strict=True):
                writer.add(doc_id, ids + end)
        if writer:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{path}/ids-{shard:06d}.zst"], "n_docs": [n_docs], "n_ids": [n_ids]})

    order = ["doc_id", F.xxhash64("text")]
    return saved(docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "token-manifest")


def _bases(manifest: DataFrame) -> DataFrame:
    """Ids before each shard. The window runs over one row for each file."""
    return manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))


def _tasks(manifest: DataFrame) -> DataFrame:
    """A task for each file; of very many files, several in turn."""
    most = 64 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartitionByRange(max(1, min(most, manifest.count())), "shard")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of all documents."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                r = ShardReader(uri)
                for at in range(0, len(r.docs), 256):
                    some = r.docs[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some["doc_id"], pa.int64(), mask=some["is_null"].astype(bool)),
                            pa.array(r.begin[at : at + len(some)] + base, pa.int64()),
                            pa.array(some["n"].astype(np.int64)),
                            pa.array([r.ids(k) for k in range(at, at + len(some))], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return _tasks(_bases(manifest)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_index(manifest: DataFrame) -> DataFrame:
    """Where each document is, from the files' indexes alone."""

    def run(batches):
        for batch in batches:
            for shard, uri, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "base")), strict=True):
                r = ShardReader(uri)
                n = len(r.docs)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(r.docs["doc_id"], pa.int64(), mask=r.docs["is_null"].astype(bool)), "shard": [shard] * n, "path": [uri] * n, "place": np.arange(n), "start": r.begin[:-1] + base, "n_tokens": r.docs["n"].astype(np.int64)}
                )

    return _tasks(_bases(manifest)).mapInArrow(run, INDEX)


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents named in wanted (doc_id); only their frames are read and decompressed."""

    def run(batches):
        reader = None
        for batch in batches:
            out = []
            for uri, place in zip(batch.column("path").to_pylist(), batch.column("place").to_pylist(), strict=True):
                if reader is None or reader.uri != uri:
                    reader = ShardReader(uri)
                out.append(reader.ids(place))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    places = read_index(manifest).join(wanted.select("doc_id").distinct(), "doc_id")
    return places.repartition("shard").sortWithinPartitions("shard", "place").mapInArrow(run, "doc_id long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that were written.

    A null or empty text is the end id alone; null ids come first; repeated rows are written one by one.
    """
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token-files"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
