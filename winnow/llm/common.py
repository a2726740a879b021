"""What the operators of this package share: saved tables, words of Arrow columns, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.session import free_name, new_path, saved, shared_dir  # noqa: F401  for the modules beside this one
from winnow.sources.folders import arrow_uri, file_system  # noqa: F401


#: Python splits bytes without an argument at exactly \\x20 and \\x09-\\x0D, so bytes.split() gives these words.
WORD = r"[^\x20\x09-\x0D]+"


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 256):
    """Arrow batches of at most so many rows, so that few long texts are in Python's memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; emptied when it is full, which changes no result."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles. Fewer words than k: the whole sequence is one shingle; none: empty."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = mixed(h + word_hashes[j : n - k + 1 + j] * np.uint64(2 * j + 1) + np.uint64(k))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds = 0; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))
