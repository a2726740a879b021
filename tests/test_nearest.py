"""The k nearest, held by tasks and by lists, against brute force: clusters, ties, zero vectors, NaN, equal ids."""

import numpy as np
import pytest

from winnow.operators import simjoin

SCHEMA = "id long, embedding array<float>"


def clusters(seed, n, first=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(12, 8))
    return [(first + i, (centres[i % 12] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]


ODD = [(7001, [0.0] * 8), (7002, None), (7003, [float("nan")] * 8), (7004, [1.0] * 8), (7005, [1.0] * 8), (7006, [-1.0] * 8), (None, [1.0] * 8), (7007, [0.0] * 8)]


def plain(queries, references, k, exclude_self):
    ok = lambda r: r[0] is not None and r[1] is not None and not np.isnan(r[1]).any()
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    refs, out = [(j, unit(v)) for j, v in references if ok((j, v))], []
    for i, v in filter(ok, queries):
        sims = sorted((-round(float(unit(v) @ w), 12) + 0.0, j) for j, w in refs if not (exclude_self and i == j))[:k]
        out += [(i, j, n + 1, round(-c, 9) + 0.0) for n, (c, j) in enumerate(sims)]
    return sorted(out)


def found(df):
    return sorted((r.id, r.ref, r["rank"], round(r.cosine, 9) + 0.0) for r in df.collect())


@pytest.mark.parametrize("most", [8_000_000, 100])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_brute_force(spark, monkeypatch, most, k):
    monkeypatch.setattr(simjoin, "COMPONENTS", most)
    refs, asked = clusters(1, 150) + ODD + [(3, [1.0] + [0.0] * 7)], clusters(2, 40, 100) + ODD + [(120, [0.0, 1.0] + [0.0] * 6)]
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (asked, refs))
    assert found(simjoin.nearest(a, b, k, rows=16)) == plain(asked, refs, k, False)
    own = clusters(3, 60) + [(7001, [0.0] * 8), (7004, [1.0] * 8), (7006, [-1.0] * 8)]
    c = spark.createDataFrame(own, SCHEMA)
    assert found(simjoin.nearest(c, c, k, exclude_self=True, rows=16)) == plain(own, own, k, True)


@pytest.mark.parametrize("most", [8_000_000, 10])
def test_few_references(spark, monkeypatch, most):
    monkeypatch.setattr(simjoin, "COMPONENTS", most)
    asked = clusters(5, 6)
    a = spark.createDataFrame(asked, SCHEMA)
    for refs in (clusters(6, 3), [(1, [0.0] * 8), (2, [0.0] * 8)], clusters(6, 2) + [(50, [0.0] * 8)]):
        assert found(simjoin.nearest(a, spark.createDataFrame(refs, SCHEMA), 5)) == plain(asked, refs, 5, False)


def test_lists_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "COMPONENTS", 400)
    refs = clusters(1, 600)
    seen, whole = [], simjoin._closest
    met = spark.sparkContext.accumulator(0)

    def counted(rows, ids, left, refs, right, k, exclude_self):
        met.add(len(left) * len(right))
        return whole(rows, ids, left, refs, right, k, exclude_self)

    monkeypatch.setattr(simjoin, "_closest", counted)
    df = spark.createDataFrame(refs, SCHEMA)
    seen = simjoin.nearest(df, df, 3, exclude_self=True).collect()
    assert len(seen) == 1800 and met.value < 0.6 * 600 * 600


def test_memory_does_not_grow_with_references():
    """A few rows against many references, most of them equal to another: the k best as by a full sort, in pieces' memory."""
    import tracemalloc

    rng = np.random.default_rng(8)
    right = simjoin._unit(np.repeat(rng.normal(size=(10_000, 8)).round(1), 4, axis=0))
    left = simjoin._unit(rng.normal(size=(600, 8)).round(1))
    refs, ids = np.arange(len(right)), np.arange(600)
    tracemalloc.start()
    got = simjoin._closest(np.arange(600), ids, left, refs, right, 5, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6  # all at once: 600 x 40,000 numbers, 192 MB
    for i in range(0, 600, 37):
        sims = np.round(left[i] @ right.T, 12)
        sims[i] = -np.inf
        assert got["ref"][got["row"] == i].tolist() == np.argsort(-sims, kind="stable")[:5].tolist()
