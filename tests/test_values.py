"""Queries without SQL against plain NumPy over the same tables."""

import duckdb
import numpy as np
import pytest

from tests.test_folds import area, newton
from tests.test_queries import DATA
from winnow.operators.embedders import MOST
from winnow.plans.queries import QUERIES


@pytest.fixture(scope="module")
def vectors():
    rows = duckdb.sql(f"select vec_id, embedding, label from read_parquet('{DATA}/embeddings.parquet') order by vec_id").fetchall()
    ids, x, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    return ids, x, label


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def split(vectors):
    ids, x, label = vectors
    y, test = (label == 0).astype(int), ids % 5 == 0
    return ids[test], x[~test], y[~test], x[test], y[test]


def linear(vectors):
    _, train, y, test, _ = split(vectors)
    w = newton(train, y)
    return 1 / (1 + np.exp(-(test @ w[:-1] + w[-1])))


def votes(sims, y, k=5):
    near = np.argsort(-np.round(sims, 12), axis=1, kind="stable")[:, :k]
    d = np.maximum(0, np.round(1 - np.take_along_axis(sims, near, 1), 12))
    return np.array([(y[n] * (w := (e == 0) if (e == 0).any() else 1 / e)).sum() / w.sum() for n, e in zip(near, d, strict=True)])


def test_linear_scores(spark, vectors):
    got = {r.id: (r.y, r.score) for r in QUERIES["linear_scores"](spark, str(DATA)).collect()}
    ids, _, _, _, y = split(vectors)
    assert got.keys() == set(ids.tolist()) and all(abs(got[i][1] - s) < 2e-3 and got[i][0] == c for i, s, c in zip(ids.tolist(), linear(vectors), y, strict=True))


def test_screen_metrics(spark, vectors):
    _, train, y, test, truth = split(vectors)
    sims = unit(test) @ unit(train).T
    scores = {"linear": linear(vectors), "knn": votes(sims, y), "cosine": np.sort(sims[:, y == 1], axis=1)[:, -5:].mean(1)}
    got = {r.method: r for r in QUERIES["screen_metrics"](spark, str(DATA)).collect()}
    assert got.keys() == scores.keys()
    for m, s in scores.items():
        assert abs(got[m].auroc - area(truth, s)) < 2e-3 and (got[m].n_pos, got[m].n_samples) == (truth.sum(), len(truth))
        grid = [2 * ((s >= t) & (truth == 1)).sum() / ((s >= t).sum() + truth.sum()) for t in np.arange(200) / 199]
        assert abs(got[m].f1_optimal - max(grid)) < 0.02


def test_train_auroc(spark, vectors):
    _, train, y, _, _ = split(vectors)
    row = QUERIES["train_auroc"](spark, str(DATA)).first()
    assert abs(row.auroc - area(y, votes(unit(train) @ unit(train).T, y))) < 1e-9 and (row.n_pos, row.n_neg) == (y.sum(), (1 - y).sum())


def test_pca_map(spark, vectors):
    ids, x, label = vectors
    got = {r.id: (r.label, r.x, r.y) for r in QUERIES["pca_map"](spark, str(DATA)).collect()}
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    mine = np.array([got[i][1:] for i in ids.tolist()])
    assert [got[i][0] for i in ids.tolist()] == label.tolist()
    for k in (0, 1):
        plain = x @ axes[k]
        assert np.allclose(mine[:, k], plain, atol=1e-6) or np.allclose(mine[:, k], -plain, atol=1e-6)


def test_ngram_embeddings(spark):
    def vector(text):
        out, b = np.zeros(64), text[:MOST].encode()
        for i in range(len(b) - 2):
            h = 0
            for c in b[i : i + 3]:
                h = (h ^ c) * 0x100000001B3 % 2**64
            h ^= h >> 29
            out[h % 64] += 1 if h >> 40 & 1 else -1
        return out / (np.linalg.norm(out) or 1)

    got = {r.doc_id: r.embedding for r in QUERIES["ngram_embeddings"](spark, str(DATA)).collect()}
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet')").fetchall()
    assert got.keys() == {i for i, _ in docs} and all(np.allclose(got[i], vector(t or ""), atol=1e-6) for i, t in docs)


def test_certification_grid(spark):
    got = {(r.kind, r.n_changes): r for r in QUERIES["certification_grid"](spark, str(DATA)).collect()}
    texts = [t for (t,) in duckdb.sql(f"select text from read_parquet('{DATA}/benchmark.parquet')").fetchall()]
    flagged = np.mean([t.lower().count("e") / max(1, sum(c.isalpha() for c in t)) > 0.05 for t in texts])
    assert {k for k, _ in got} == {"grouped", "random"} and {n for _, n in got} == {1, 2, 3, 5, 8, 10}
    for r in got.values():
        assert abs(r.accuracy - flagged) < 0.1 and 0 <= r.certified_accuracy <= r.accuracy and abs(r.gap - (r.accuracy - r.certified_accuracy)) < 1e-9
