"""Models of all folds against Newton's method on each fold alone; rows of folds and of all methods against plain Python."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import folds, scorers
from winnow.operators.embedders import HashedNgrams


def newton(x, y, c=1.0):
    """Weights and intercept of balanced L2 logistic regression."""
    x, s = np.column_stack([x, np.ones(len(x))]), np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    w, penalty = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(penalty + c * (x * (s * p * (1 - p))[:, None]).T @ x, penalty @ w + c * x.T @ (s * (p - y)))
    return w


def area(y, score):
    p, n = score[y == 1], score[y == 0]
    return (p[:, None] > n).mean() + (p[:, None] == n).mean() / 2


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    return [(i, (rng.normal(size=5) + (i % 3 == 0) * np.array([1, 0.5, 0, 0, 0])).tolist(), int(i % 3 == 0), "abc"[i % 9 // 3]) for i in range(240)]


def test_models_of_all_folds(spark, data):
    frame = spark.createDataFrame(data + [(900, None, 1, "a")], "id long, embedding array<double>, y int, g string")
    of = [(g, r[0], "train") for g in "abc" for r in data if not (r[2] == 1 and r[3] == g)] + [("none", 1, "train"), (None, 3, "train")]
    models = folds.fit_folds(frame, spark.createDataFrame(of, "fold string, id long, role string").where("fold is not null"))
    assert models.names == ["a", "b", "c"]
    for g, w in zip(models.names, models.weights, strict=True):
        own = [r for r in data if not (r[2] == 1 and r[3] == g)]
        assert np.allclose(w, newton(np.array([r[1] for r in own]), np.array([r[2] for r in own])), atol=2e-3)
    scored = models.scores(frame, spark.createDataFrame([("a", 0), ("b", 5), ("b", 900), ("none", 1)], "fold string, id long")).collect()
    assert {(r.fold, r.id, r.y) for r in scored} == {("a", 0, 1), ("b", 5, 0)}
    w = models.weights[0]
    assert abs(next(r.score for r in scored if r.fold == "a") - 1 / (1 + np.exp(-(np.array(data[0][1]) @ w[:-1] + w[-1])))) < 1e-9
    assert folds.fit_folds(frame, spark.createDataFrame([], "fold string, id long")).names == []


def test_rows_of_left_out_groups(spark, data):
    frame = spark.createDataFrame(data, "id long, embedding array<double>, y int, g string")
    got = {r.fold: r for r in folds.leave_one_out_rows(frame, "g", iterations=40, negatives=50).collect()}
    role = defaultdict(list)
    for r in folds.leave_one_group_out(frame, "id", "y", "g", negatives=50).collect():
        role[r.fold, r.role].append(r.id)
    assert got.keys() == {"a", "b", "c"}
    for g, row in got.items():
        train, test = ([data[i] for i in sorted(role[g, k])] for k in ("train", "test"))
        w = newton(np.array([r[1] for r in train]), np.array([r[2] for r in train]))
        y, score = np.array([r[2] for r in test]), 1 / (1 + np.exp(-(np.array([r[1] for r in test]) @ w[:-1] + w[-1])))
        assert (row.n_pos, row.n_neg) == (y.sum(), 50) and {r[3] for r in test if r[2] == 1} == {g}
        assert abs(row.auroc - area(y, score)) < 2e-3 and row.auroc_lo <= row.auroc <= row.auroc_hi and abs(row.detection_rate - (score[y == 1] >= 0.5).mean()) < 0.05


def test_all_methods_over_all_splits(spark):
    rng = np.random.default_rng(2)
    text = lambda i: "".join(rng.choice([*("abcdef" if i % 2 else "uvwxyz")], 30)) * 60
    texts = {i: text(i) for i in range(36)}
    rows = [(i, t, i % 2, "train" if i < 20 else "test_a") for i, t in texts.items()] + [(i, texts[i], i % 2, "test_b") for i in (30, 31)] + [(35, texts[35], 1, "val")]
    got = defaultdict(dict)
    for r in scorers.evaluation_scores(spark.createDataFrame(rows, "id long, text string, y int, split string")).collect():
        got[r.split, r.method][r.id] = r.score
    assert {k: len(v) for k, v in got.items()} == {(s, m): n for s, n in (("test_a", 16), ("test_b", 2)) for m in ("kmer", "cosine", "linear", "knn")}
    mers = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in texts.items()}
    unit = dict(zip(texts, HashedNgrams().embed(list(texts.values())).astype(np.float32).astype(float), strict=True))
    train = np.array([unit[i] for i in range(20)])
    w = newton(train, np.arange(20) % 2)
    for i in range(20, 36):
        assert abs(got["test_a", "kmer"][i] - max(len(mers[i] & mers[j]) / len(mers[i] | mers[j]) for j in range(1, 20, 2))) < 1e-9
        sims = train @ unit[i]
        assert abs(got["test_a", "cosine"][i] - np.sort(sims[1::2])[-5:].mean()) < 1e-6
        near = np.argsort(-sims)[:5]
        assert abs(got["test_a", "knn"][i] - np.average(near % 2, weights=1 / (1 - sims[near]))) < 1e-4
        assert abs(got["test_a", "linear"][i] - 1 / (1 + np.exp(-(unit[i] @ w[:-1] + w[-1])))) < 2e-3
    assert all(got["test_b", m][i] == got["test_a", m][i] for m in ("kmer", "linear") for i in (30, 31))


def test_vectors_are_made_once(spark):
    made, rng = spark.sparkContext.accumulator(0), np.random.default_rng(2)

    @F.udf("array<float>")
    def vector(x):
        made.add(1)
        return [float(x), 1.0 - float(x)]

    rows = spark.createDataFrame([(i, float(rng.random()), i % 2, "ab"[i % 4 // 2]) for i in range(60)], "id long, x double, y int, g string")
    found = folds.leave_one_out_rows(rows.select("id", vector("x").alias("embedding"), "y", "g"), "g", iterations=3, negatives=5)
    assert found.count() == 2 and made.value == 60
