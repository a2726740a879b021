"""Quality rules: counts of each whole text, and a calibrated logistic regression over hashed word and character n-grams.

The classifier's features are frequencies, per word of the text, of hashed words, word pairs and character 3- and 4-grams
within a word's edges. A text's margin is then the mean of its words' and pairs' weights, and a worker remembers each word's
weight. Platt scaling on labelled rows that fitting did not see turns margins into probabilities, held against a fixed
threshold.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import as_bytes, held_out, mixed, slices
from winnow.operators.folds import minimised

GRAMS = (3, 4)
BITS = 16
SPACES = [b"\x20", b"\x09", b"\x0a", b"\x0b", b"\x0c", b"\x0d"]
SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
LEAST_DEVIATION = 3e-3  # about once in 300 words; without it rare n-grams would count for more than they tell
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 50, 50, 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_features(word: bytes) -> list[int]:
    """Hashed features of one word, with repeats, however long it is."""
    crc, shift = zlib.crc32, 32 - BITS
    edged = b"\x01" + word + b"\x02"
    return [crc(b"\x03" + word) >> shift] + [crc(edged[i : i + n]) >> shift for n in GRAMS for i in range(len(edged) - n + 1)]


class Words(dict):
    """word -> small number, with each number's hash and (given feature weights) summed weight; emptied when full."""

    def __init__(self, weights: list[float] | None = None, most: int = 400_000):
        super().__init__()
        self.feature_weights, self.most = weights, most
        self.hashes, self.sums = np.zeros(1024, np.uint64), np.zeros(1024)

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        if k >= len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
        self.hashes[k] = zlib.crc32(word) | zlib.adler32(word) << 32
        if self.feature_weights is not None:
            self.sums[k] = sum(map(self.feature_weights.__getitem__, word_features(word)))
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, comparable within one text."""
        if len(self) >= self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def pair_features(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) >> np.uint64(64 - BITS)).astype(np.int64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a 3-word window whose words occur twice or more in the text."""
    n = len(numbers)
    if n < 4:
        return 0
    # pairs are numbered first, so that windows of whatever many words fit 64 bits
    span = int(numbers.max()) + 1
    pairs = np.unique(numbers[:-1] * span + numbers[1:], return_inverse=True)[1]
    windows = pairs[:-1] * span + numbers[2:]
    order = windows.argsort(kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j : n - 2 + j] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # by hashed feature, on frequencies
    bias: float
    slope: float  # of the margin, in the calibrated probability
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


#: Without both labels nothing can be learned, and every text counts as good.
NO_MODEL = QualityModel(np.zeros(1 << BITS), 0.0, 0.0, 60.0)


@dataclass
class Rows:
    """Texts as sparse rows: of text i the columns and their frequencies stand from ends[i] to ends[i + 1]."""

    columns: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        pick = lambda k, t: np.concatenate([np.zeros(0, t), *(p[k] for p in parts)])
        return Rows(pick(0, np.int32), pick(1, np.float32), np.cumsum([0, *(len(p[0]) for p in parts)]))

    def margins(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.values * w[self.columns], dtype=float)))
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def gradient(self, e: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * np.repeat(e, np.diff(self.ends)), width)


def frequencies(text: bytes, words: Words, known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(columns, frequency of each per word) of a text; known keeps words' features from text to text."""
    found = text.split()
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    if len(known) > 100_000:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = word_features(w)
    numbers = words.of(found)
    single = np.fromiter((f for w in found for f in known[w]), np.int64)
    columns, n = np.unique(np.concatenate((single, pair_features(words.hashes[numbers]))), return_counts=True)
    return columns.astype(np.int32), (n / len(found)).astype(np.float32)


def _descend(margins, gradient, width: int, y: np.ndarray, weight: np.ndarray, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Weighted L2 logistic regression by quasi-Newton steps, some tens of them; the last entry is the bias."""

    def value_and_gradient(all_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (w,) = all_of
        z = margins(w[:-1]) + w[-1]
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + decay / 2 * (w[:-1] ** 2).sum()
        e = weight * (0.5 * (1 + np.tanh(z / 2)) - y)
        return np.array([loss]), np.append(gradient(e) + decay * w[:-1], e.sum())[None]

    (w,) = minimised(value_and_gradient, np.zeros((1, width + 1)), steps, 1e-4)
    return w[:-1], float(w[-1])


def fit(texts: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, calibrate: np.ndarray) -> QualityModel:
    """texts: frequencies() of each; good: 0 or 1; calibrate: which texts serve the calibration alone.

    Columns are scaled by their deviation. Without both labels among the rows to train on: see NO_MODEL.
    """
    width, at = 1 << BITS, np.flatnonzero(~calibrate)
    y = good.astype(float)
    if len(set(good[at].tolist())) < 2:
        return NO_MODEL
    train = Rows.of([texts[i] for i in at])
    mean = train.gradient(np.ones(len(at)), width) / len(at)
    square = np.bincount(train.columns, train.values.astype(float) ** 2, width) / len(at)
    std = np.sqrt(np.maximum(0, square - mean**2)) + LEAST_DEVIATION
    train.values = (train.values / std[train.columns]).astype(np.float32)
    share = y[at].mean()
    weight = np.where(y[at] == 1, 0.5 / share, 0.5 / (1 - share)) / len(at)
    centre = mean / std
    w, b = _descend(lambda w: train.margins(w) - centre @ w, lambda e: train.gradient(e, width) - centre * e.sum(), width, y[at], weight, 1e-3, 60)
    raw, b = w / std, b - float(centre @ w)
    on = np.flatnonzero(calibrate) if len(set(good[calibrate].tolist())) == 2 else at
    margins = Rows.of([texts[i] for i in on]).margins(raw) + b
    n1, n0 = y[on].sum(), (1 - y[on]).sum()
    smooth = np.where(y[on] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
    slope, shift = _descend(lambda s: margins * s[0], lambda e: np.array([(margins * e).sum()]), 1, smooth, np.full(len(on), 1 / len(on)), 0.0, 200)
    return QualityModel(raw, b, max(0.0, float(slope[0])), shift)


def _vectors(sample: DataFrame) -> DataFrame:
    """(quality, calibrate, columns, values) of each text of the sample: 32-bit integers and floats, at most 2^BITS of each."""

    def run(batches):
        words, known = Words(), {}
        for batch in slices(batches):
            found = [frequencies(x, words, known) for x in as_bytes(batch.column("text"))]
            data = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("calibrate"), *data], names=["quality", "calibrate", "columns", "values"])

    return sample.mapInArrow(run, "quality int, calibrate boolean, columns binary, values binary")


def fit_on(docs: DataFrame, labels: DataFrame, max_low: int = 1200, max_good: int = 1800) -> QualityModel:
    """Fit on at most so many labelled rows of each label: those whose id has the smallest hash.

    A fifth of them (crc32 of the id) serves the calibration. Each label has its own bound, so the calibrated odds are
    corrected by the labels' true shares. Ids labelled twice count as low if any label says so; of an id's several texts the
    greatest counts; null labels, ids and texts are not used. The driver gets no text, only the sample's frequencies.
    """
    by_id = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    key = F.xxhash64("doc_id")
    pick = lambda value, most: by_id.where(F.col("quality") == value).orderBy(key, "doc_id").limit(most)
    chosen = F.broadcast(pick(0, max_low).unionAll(pick(1, max_good)))  # at most as many rows as the two bounds
    texts = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = _vectors(texts.select("quality", held_out("doc_id").alias("calibrate"), "text")).collect()
    rows.sort(key=lambda r: (r.quality, r.calibrate, r.columns, r["values"]))  # whatever the order of tasks
    good, calibrate = np.array([r.quality for r in rows], int), np.array([r.calibrate for r in rows], bool)
    model = fit([(np.frombuffer(r.columns, np.int32), np.frombuffer(r["values"], np.float32)) for r in rows], good, calibrate) if rows else NO_MODEL
    counts = dict(by_id.groupBy("quality").count().collect())
    if model is NO_MODEL or not counts.get(0) or not counts.get(1):
        return NO_MODEL
    drawn = (good == 1).sum() / max(1, (good == 0).sum())
    return QualityModel(model.weights, model.bias, model.slope, model.shift + math.log(counts[1] / counts[0] / drawn))


def rules(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the counts, probability (of being good), base_failed and kept for every whole text; null counts as empty.

    A text without words has margin bias alone; it fails the base rule of 50 words anyhow.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *COUNTS, "probability"]

    def run(batches):
        m = sent.value
        words = Words(m.weights.tolist())
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            counts, margins = [], []
            for text, n_chars in zip(texts, chars, strict=True):
                found = text.split()
                numbers = words.of(found)
                counts.append((len(found), n_chars - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeated_words(numbers)))
                total = words.sums[numbers].sum() + m.weights[pair_features(words.hashes[numbers])].sum() if found else 0.0
                margins.append(m.bias + total / max(1, len(found)))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(m.probability(np.array(margins)))], names=names)

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "probability double"])
    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= MIN_PROBABILITY))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and probability of every document.

    A null text counts as empty, has counts of 0 and fails; repeated rows and null ids are rows of their own; see rules().
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rules(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
