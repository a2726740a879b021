"""Token ids of whole texts by a public tokenizer, encoded word by word.

The vocabulary's own rules never let a token reach over white space, so a text's ids are its words' ids in order, and each
Python worker remembers the ids of words it has met. New words are handed to the tokenizer many at a time, parted by a
control character whose id then marks where a word's ids end.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import as_bytes, slices

END_ID = 2
PART = b" \x01 "
#: a-z and U+00DF-U+00FF without the division sign: lower-case letters that NFC leaves alone
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def send_tokenizer(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The tokenizer's definition (a file of under 2 MB), for encoder_of in tasks."""
    return spark.sparkContext.broadcast(Path(path or tokenizer_file()).read_text(encoding="utf-8"))


class Encoder:
    """Whole texts (UTF-8 bytes) to ids (little-endian unsigned 32-bit, as bytes), as Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, definition: str, most_words: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        rules = json.loads(definition)
        kinds = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or rules.get("post_processor"):
            raise ValueError("only a tokenizer that lower-cases and drops white space can be run word by word")
        self.tokenizer = Tokenizer.from_str(definition)
        (self.part,) = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.ends = {x: self._alone(x) for x in (b".", b",")}
        # plain words (lower-case Latin letters) pass the rules unchanged but for the names of their bytes, so they need the model alone
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        name = {}
        for c in map(chr, [*range(1, 0x80), *range(0xC0, 0x100)]):
            name.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
        name[0x20] = " "
        self.names = "".join(name.get(b, "\ufffe") for b in range(256))
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        self.most = most_words  # about 250 bytes each

    def _alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """A point or comma after an ASCII letter is always a piece of its own, so the word before it is looked up alone."""
        known, plain, rest, ended = self.known, set(), set(), []
        for w in words:
            if not w.isalpha():
                if w[-1:] in self.ends and w[-2:-1].isalpha():
                    ended.append(w)
                    w = w[:-1]
                    if w in known:
                        continue
                if b"\x01" in w:
                    known[w] = self._alone(w)
                    continue
                if not PLAIN(w):
                    rest.add(w)
                    continue
            elif not w.islower():
                rest.add(w)
                continue
            plain.add(w)
        self._encode_apart([*plain], self.model, lambda x: charmap_decode(x, "strict", self.names)[0])
        self._encode_apart([*rest], self.tokenizer, lambda x: x.decode("utf-8", "replace"))
        for w in ended:
            known[w] = known[w[:-1]] + self.ends[w[-1:]]

    def _encode_apart(self, words: list[bytes], tokenizer, decoded) -> None:
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(tokenizer.encode_batch_fast([decoded(PART.join(some))], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.part) * 4
            raw = ids.tobytes()
            for w, a, b in zip(some, [0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True):
                self.known[w] = raw[a:b]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        docs, found, new = [], [], set()
        for x in texts:
            words = (x if b"<|" in x else x.lower()).split()  # lower-casing ASCII is part of the rules; special tokens are found before it
            ids = list(map(self.known.get, words))
            if None in ids:
                gaps = [i for i, y in enumerate(ids) if y is None]
                new.update(map(words.__getitem__, gaps))
                docs.append((ids, words, gaps))
            found.append(ids)
        if new:
            self._learn(new)
        for ids, words, gaps in docs:
            for i in gaps:
                ids[i] = self.known[words[i]]
        return list(map(b"".join, found))


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(sent: Broadcast) -> Encoder:
    """This Python worker's encoder; later tasks of the worker use it again."""
    key = hash(sent.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(sent.value)
    return _ENCODERS[key]


def token_counts(docs: DataFrame, columns: list[str], tokenizer: str | None = None) -> DataFrame:
    """The named columns of docs, which don't include text, and n_tokens: the text's ids and an end id. Null counts as empty."""
    sent = send_tokenizer(docs.sparkSession, tokenizer)
    schema = docs.select(*columns).limit(0).withColumn("n_tokens", F.lit(0).cast("long")).schema
    names = schema.names

    def run(batches):
        encoder = encoder_of(sent)
        for batch in slices(batches):
            n = [len(x) // 4 + 1 for x in encoder.encode(as_bytes(batch.column(batch.num_columns - 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=names)

    return docs.select(*columns, "text").mapInArrow(run, schema)
