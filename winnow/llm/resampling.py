"""Importance resampling towards a target corpus, drawn by a distributed quickselect.

Features are a text's runs of one and two words, hashed into buckets. A bucket's gain says how much likelier it is in the target
than in the corpus; tasks hold the gains as an array and a document's weight is the mean over its features. Adding Gumbel noise
keyed by the id makes the k highest scores a draw without replacement in proportion to exp(weight / 1000).

The k-th score is found without a sort of all rows: each round takes a few candidate keys at random as pivots, counts exactly how
many keys lie before, at and behind each, and keeps the stretch between two pivots that holds the k-th. Keys are unique, so it
ends at one key. Only what comes up to it is sorted and numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import as_bytes, saved, slices
from winnow.operators.prefix import numbered

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
PIVOTS = 24
#: Bytes of a UTF-8 text: A-Z become a-z; 0-9, a-z and all that isn't ASCII stay; the rest parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
KEY = ["low", "doc_id", "text_key", "row"]


class BucketsOf:
    """Buckets of a text's features: the crc32 of one or two words. What a word gives is kept; dropped when there are too many."""

    def __init__(self, most: int = 300_000):
        self.known, self.most = {}, most

    def __call__(self, text: bytes) -> tuple[int, np.ndarray]:
        """Number of words, and a bucket for each feature."""
        words = text.translate(LETTERS).split()
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = (zlib.crc32(w), b" " + w)
        one = [known[w] for w in words]
        # the crc32 of two words goes on from that of the first
        both = [zlib.crc32(follow, crc) for (crc, _), (_, follow) in zip(one, one[1:], strict=False)]
        return len(words), np.array([crc for crc, _ in one] + both, np.int64) % BUCKETS


def bucket_counts(df: DataFrame, text: str = "text") -> list[int]:
    """How often features of each bucket are in all texts. The driver gets one number for each bucket, whatever the table's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_of, held = BucketsOf(), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for t in as_bytes(batch.column(0)):
                held += np.bincount(buckets_of(t)[1], minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    out = [0] * BUCKETS
    for r in df.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Of each bucket: thousandths of the log of its smoothed share in the target over that in the corpus, rounded down."""
    total, wanted = float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (total + BUCKETS) / ((s + 1.0) * (wanted + BUCKETS)))) for s, t in zip(corpus, target, strict=True)]


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight) of each of docs: the floored mean of its features' gains, 0 without any."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_of, of = BucketsOf(), np.array(gain, np.int64)
        for batch in slices(batches):
            rows = []
            for t in as_bytes(batch.column(2)):
                n, buckets = buckets_of(t)
                rows.append((n, len(buckets), int(of[buckets].sum()) // len(buckets) if len(buckets) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))]], names=["doc_id", "text_key", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(score, "doc_id long, text_key long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int) -> Column:
    """Keyed Gumbel noise in thousandths, rounded down; a null id counts as no digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(KEY, key, strict=True)])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> tuple | None:
    """The k-th smallest of unique keys, rows of the columns KEY; None for k below 1 or beyond the last.

    A round reads the table twice: for pivots, candidates with the smallest hashes, and for the exact counts around them. Of n
    candidates some n / pivots go on to the next round on average, so rounds grow with log(n) / log(pivots).
    """
    if not 1 <= k <= keys.count():
        return None
    key, low, high, turn = F.struct(*KEY), None, None, 0
    while True:
        inside = keys
        if low is not None:
            inside = inside.where((F.col("low") >= low[0]) & (key > _literal(low)))
        if high is not None:
            inside = inside.where((F.col("low") <= high[0]) & (key < _literal(high)))
        draw = F.xxhash64(F.lit(seed), F.lit(turn), *KEY)
        found = sorted((tuple(r) for r in inside.orderBy(draw, *KEY).limit(pivots).select(*KEY).collect()), key=lambda r: tuple((x is not None, x or 0) for x in r))
        # twice the pivots before a key, and one more if it is a pivot itself: exact counts of three ways for each
        place = sum([2 * (key > _literal(p)).cast("int") + (key == _literal(p)).cast("int") for p in found], F.lit(0))
        counts = dict(inside.groupBy(place.alias("place")).agg(F.count("*")).collect())
        for at in range(2 * len(found) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        if at % 2:
            return found[at // 2]
        low = found[at // 2 - 1] if at else low
        high = found[at // 2] if at // 2 < len(found) else high
        turn += 1


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each of docs. rank is 1, 2, 3... by score where drawn, else null.

    docs (doc_id, text) are drawn towards the texts of target (text): percent of those with min_words words, rounded down, with
    the highest scores; ties go to the smaller doc_id, null first, then by the text's hash; rows that repeat both are drawn in
    any order, which shows in nothing. A text without words, null or empty has no features, weight 0, and isn't drawn. An empty
    target gives gains by smoothing alone. Other columns don't matter. No rows: no rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = saved(scored.withColumns({"low": -F.col("score"), "row": F.monotonically_increasing_id()}), "resample-scores")
    eligible = scored.where(F.col("n_words") >= min_words)
    last = kth_key(eligible.select(*KEY), percent * eligible.count() // 100, seed=seed)
    drawn = (F.col("n_words") >= min_words) & (F.struct(*KEY) <= _literal(last)) if last else F.lit(False)
    ranked = numbered(scored.where(drawn), [], [F.col("low").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_key").asc_nulls_first(), F.col("row").asc()])
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*columns, (F.col("pos") + 1).alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark's texts; see resampled()."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resampled(read("documents"), read("benchmark")).drop("n_words")
