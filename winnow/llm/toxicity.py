"""Toxicity by non-negative positive-unlabelled learning.

Known toxic texts are the positives; the unlabelled ones are drawn from all documents of the training folds, labelled or not,
whatever their label says. With class prior p the risk of a scorer g is  p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]):
the second part estimates the negatives' risk and is kept from going below zero, where training would only be fitting the
known positives.

A text's features are hashes of its distinct lower-cased words and of their character n-grams with the word's edges.
A linear scorer is a sum over distinct words, so each worker remembers the sum of a word's weights. Features are counted and
texts reduced to the chosen features in tasks; the driver gets no text, only small arrays of the bounded sample.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import as_bytes, free_name, held_out, saved, slices

GRAMS = (4, 5)
BITS = 20


def word_features(word: bytes) -> set[int]:
    """Distinct hashed features of one word, however long."""
    crc, shift = zlib.crc32, 32 - BITS
    edged = b"\x01" + word.strip(b".,;:!?\"'()[]*#$%&|<>") + b"\x02"
    found = {crc(word) >> shift}
    for n in GRAMS:
        found.update([crc(edged[i : i + n]) >> shift for i in range(len(edged) - n + 1)])
    return found


class WordFeatures(dict):
    """word -> its features; emptied when it is full, which changes no result."""

    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) >= 100_000:
            self.clear()
        self[word] = value = np.array(sorted(word_features(word)), np.int32)
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Features of the text's distinct words; what several words have comes several times."""
        return np.concatenate([np.zeros(0, np.int32), *map(self.__getitem__, sorted(words_of(text)))])


def words_of(text: bytes) -> set[bytes]:
    return set(text.decode("utf-8", "replace").lower().encode().split())


@dataclass(frozen=True)
class ToxicityModel:
    """Linear scorers over the same hashed features, averaged."""

    features: np.ndarray  # sorted ids of the features that carry weight
    weights: np.ndarray  # their mean weight
    bias: float
    prior: float


class WordWeights(dict):
    """word -> the sum of its features' weights; emptied when full, which changes no score."""

    def __init__(self, model: ToxicityModel, most: int = 500_000):
        super().__init__()
        self.most, self.of_feature = most, dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        hits = word_features(word) & self.of_feature.keys()
        self[word] = value = sum(self.of_feature[f] for f in sorted(hits)) if hits else 0.0
        return value


def nn_pu_fit(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear scorer. pos, unl: the column indices of each text (an index counts as often as it occurs).

    Full-batch Adam on the logistic loss. Where the estimated negative risk is below zero the step goes up its gradient
    instead (Kiryo et al., 2017).
    """

    def flat(rows):
        sizes = np.array([len(r) for r in rows])
        return np.repeat(np.arange(len(rows)), sizes), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    (pr, pc), (ur, uc) = flat(pos), flat(unl)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        gp = np.bincount(pr, w[pc], len(pos)) + b
        gu = np.bincount(ur, w[uc], len(unl)) + b
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        dp_neg, du_neg = -prior * sigmoid(gp) / len(pos), sigmoid(gu) / len(unl)
        dp, du = -prior * sigmoid(-gp) / len(pos), np.zeros(len(unl))
        if negative >= 0:
            dp, du = dp + dp_neg, du_neg
        else:
            dp, du = -dp_neg, -du_neg
        grad = np.empty(width + 1)
        grad[:width] = np.bincount(pc, dp[pr], width) + np.bincount(uc, du[ur], width) + decay * w
        grad[width] = dp.sum() + du.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:width]
        b -= step[width]
    return w, b


def fit(pos: list[np.ndarray], unl: list[np.ndarray], features: np.ndarray, prior: float, n_models: int = 3, seed: int = 7) -> ToxicityModel:
    """The average of n_models scorers, each fitted on its own resample of the unlabelled texts.

    pos, unl: for each text the columns of the features it has, counted as often as words have them. Without either side no
    feature has weight, and every text has the score of the bias.
    """
    if not pos or not unl:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), -3.0, prior)
    rng, fitted = np.random.default_rng(seed), []
    for _ in range(n_models):
        pick = rng.integers(0, len(unl), len(unl)) if n_models > 1 else np.arange(len(unl))
        fitted.append(nn_pu_fit(pos, [unl[i] for i in pick], len(features), prior))
    return ToxicityModel(features, np.mean([w for w, _ in fitted], axis=0), float(np.mean([b for _, b in fitted])), prior)


def _document_counts(sample: DataFrame) -> DataFrame:
    """(feature, in_pos, in_unl): in how many texts of each side a feature is. sample: (side, text); side 3 is on both."""

    def run(batches):
        words, totals = WordFeatures(), np.zeros((2, 1 << BITS), np.int32)
        for batch in slices(batches):
            for side, text in zip(batch.column("side").to_pylist(), as_bytes(batch.column("text")), strict=True):
                at = np.unique(words.of(text))
                for k in (0, 1):
                    if side & 1 << k:
                        totals[k, at] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[0, at]), pa.array(totals[1, at])], names=["feature", "in_pos", "in_unl"])

    counted = sample.select("side", "text").mapInArrow(run, "feature int, in_pos int, in_unl int")
    return counted.groupBy("feature").agg(F.sum("in_pos").alias("in_pos"), F.sum("in_unl").alias("in_unl"))


def _columns(sample: DataFrame, features: np.ndarray) -> DataFrame:
    """(side, columns) of each text: the places of its features among the chosen ones, as 32-bit integers."""
    sent = sample.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        words, column = WordFeatures(), np.full(1 << BITS, -1, np.int32)
        column[sent.value] = np.arange(len(sent.value))
        for batch in slices(batches):
            found = [column[words.of(text)] for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("side"), pa.array([c[c >= 0].tobytes() for c in found], pa.binary())], names=["side", "columns"])

    return sample.select("side", "text").mapInArrow(run, "side int, columns binary")


def fit_on(docs: DataFrame, labels: DataFrame, max_positives: int = 4000, max_unlabelled: int = 8000, min_docs: int = 3) -> ToxicityModel:
    """Fit on rows outside the held-out fold.

    The sample is bounded, and the bounds are these two parameters: the ids with the smallest hash. Unlabelled texts come from
    all documents; the class prior is the share of toxic rows among all training labels. A feature is kept if at least
    min_docs positives have it and among texts that have it the estimated share of toxic ones, p * P(f|pos) / P(f|unl), is
    over a half. An id labelled more than once is toxic if any of its labels says so; of an id's several texts the greatest
    counts; a null label, id or text is not used. Without toxic labels nothing is learned.
    """
    by_id = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = by_id.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return fit([], [], np.zeros(0, np.int32), 0.0)
    key = F.xxhash64("doc_id")
    positive = by_id.where("toxic = 1").orderBy(key, "doc_id").limit(max_positives).select("doc_id", F.lit(1).alias("side"))
    unlabelled = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).orderBy(key, "doc_id").limit(max_unlabelled).distinct().select("doc_id", F.lit(2).alias("side"))
    chosen = positive.unionAll(unlabelled).groupBy("doc_id").agg(F.sum("side").cast("int").alias("side"))  # 3: on both sides
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most as many rows as the two bounds
    sample = saved(texts.groupBy("doc_id", "side").agg(F.max("text").alias("text")), "toxicity-sample")
    n_pos, n_unl = sample.agg(F.count_if(F.col("side") != 2), F.count_if(F.col("side") != 1)).first()
    share = (prior * F.col("in_pos") / max(1, n_pos) * n_unl + prior) / (F.col("in_unl") + 1)
    kept = _document_counts(sample).where((F.col("in_pos") >= min(min_docs, n_pos)) & (share > 0.5)).select("feature").toPandas()  # at most 2^20 numbers
    features = np.sort(kept["feature"].to_numpy(np.int32))
    found = sorted(_columns(sample, features).collect(), key=lambda r: (r.side, r.columns))  # whatever the order of tasks
    rows = [(r.side, np.frombuffer(r.columns, np.int32).astype(np.int64)) for r in found]
    return fit([c for s, c in rows if s & 1], [c for s, c in rows if s & 2], features, float(prior))


def scores(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 for every whole text; a null or empty text has the score of no words. Other columns stay.

    A column of docs that has the score's name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    schema = docs.limit(0).withColumn(column, F.lit(0.0)).schema

    def run(batches):
        weights = WordWeights(sent.value)
        for batch in slices(batches):
            z = np.array([sent.value.bias + math.fsum(map(weights.__getitem__, words_of(x))) for x in as_bytes(batch.column("text"))])
            out = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. A null or empty text gets the score of a text without words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = scores(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Pipeline stage: the documents that score under the threshold, with their own columns, whatever their names.

    Null and empty texts score as texts without words and stay; repeated rows are scored one by one; no rows give no rows.
    """
    model = fit_on(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxicity")
    return scores(docs, model, score).where(F.col(score) < threshold).drop(score)
