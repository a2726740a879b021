"""The neighbour graph against brute force, its weights against plain Python, and what is near on the map."""

import math

import duckdb
import numpy as np
import pytest

from tests.test_queries import DATA
from winnow.operators.embedders import HashedNgrams
from winnow.operators.neighbour_map import _dealt, edge_weights, neighbour_graph, neighbour_map
from winnow.plans.queries import QUERIES

SCHEMA = "id long, label int, embedding array<float>"


def clusters(n, many=12, width=24):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(many, width))
    return [(i, i % many, (centres[i % many] + 0.6 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def nearest(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -9)
    return sims, np.argsort(-sims, axis=1)[:, :k]


def test_graph_of_the_vectors_is_nearly_brute_force(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{DATA}/embeddings.parquet') order by vec_id").fetchall()
    at = {r[0]: i for i, r in enumerate(rows)}
    sims, near = nearest(np.array([r[1] for r in rows], float), 15)
    got = {}
    for r in QUERIES["neighbour_graph"](spark, str(DATA)).collect():
        got.setdefault(at[r.id], {})[r["rank"]] = at[r.ref]
        assert r.id != r.ref and abs(r.cosine - sims[at[r.id], at[r.ref]]) < 1e-5
    assert got.keys() == set(at.values()) and all(sorted(g) == list(range(1, 16)) for g in got.values())
    assert np.mean([len({*g.values()} & {*near[i]}) / 15 for i, g in got.items()]) >= 0.95


def written(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_vectors_without_structure_exactly_and_without_moving_them_for_each_neighbour(spark):
    x = np.random.default_rng(5).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    before = written(spark)
    got = {}
    for r in neighbour_graph(df).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.ref
    assert (written(spark) - before) / len(x) < 40_000  # 107,000 on check_s where each list of neighbours had its vectors in up to 8 rounds
    _, near = nearest(x.astype(float), 15)
    assert all([got[i][n] for n in range(1, 16)] == near[i].tolist() for i in range(len(x)))


def test_more_blocks_than_a_row_meets(spark):
    rows = clusters(1500, 40)
    x = np.array([r[2] for r in rows])
    got = {}
    for r in neighbour_graph(spark.createDataFrame(rows, SCHEMA), probes=6, cell=60).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.ref
    _, near = nearest(x.astype(float), 15)
    assert all(sorted(g) == list(range(1, 16)) for g in got.values()) and len(got) == len(x)
    assert np.mean([len({*got[i].values()} & {*near[i]}) / 15 for i in got]) > 0.95


def test_a_cell_of_copies_is_cut_into_blocks(spark):
    rows = [(i, 0, [1.0, 2.0, 0.5]) for i in range(700)] + [(i, 0, [float(i % 7) - 3, float(i % 5) + 0.1, float(i % 3)]) for i in range(700, 900)]
    df = spark.createDataFrame(rows, SCHEMA)
    units = df.selectExpr("id", "transform(embedding, v -> cast(v / sqrt(aggregate(embedding, 0d, (s, e) -> s + e * e)) as float)) as unit")
    blocks, centres = _dealt(units, 900, 6, 60, 1)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sum(sizes) == 900 and len(sizes) == len(centres) and max(sizes) <= 120
    edges = [(r.id, r.ref, r.cosine) for r in neighbour_graph(df, 5, probes=6, cell=60).collect()]
    assert len(edges) == 900 * 5 and all(abs(c - 1) < 1e-6 for i, _, c in edges if i < 700)
    exact = {}
    for r in neighbour_graph(df, 5).collect():
        exact.setdefault(r.id, []).append(r.ref)
    assert all(sorted(exact[i]) == [j for j in range(6) if j != i][:5] for i in range(700))


def test_weights(spark):
    graph = [(1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.1), (2, 1, 0.9), (2, 3, 0.8), (2, 4, 0.7), (5, 1, 0.3)]
    w = {}
    for i in (1, 2, 5):
        d = {j: 1 - c for a, j, c in graph if a == i}
        least, lo, hi = min(d.values()), 0.0, 4.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(math.exp(-(x - least) / mid) for x in d.values()) > math.log2(max(2, len(d))) else (mid, hi)
        w |= {(i, j): math.exp(-(x - least) / mid) for j, x in d.items()}
    both = {(i, j): w.get((i, j), 0) + w.get((j, i), 0) - w.get((i, j), 0) * w.get((j, i), 0) for a, b in w for i, j in ((a, b), (b, a))}
    got = {(r.id, r.ref): r.weight for r in edge_weights(spark.createDataFrame(graph, "id long, ref long, cosine double")).collect()}
    assert got.keys() == both.keys() and all(abs(got[e] - x) < 1e-6 for e, x in both.items())


def test_neighbours_are_near_on_the_map(spark):
    rows = clusters(480)
    got = {r.id: (r.label, r.x, r.y) for r in neighbour_map(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == {r[0] for r in rows} and all(got[i][0] == label for i, label, _ in rows)
    y, label = np.array([got[i][1:] for i in range(len(rows))]), np.array([r[1] for r in rows])
    far = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf)
    assert np.isfinite(y).all() and (label[np.argsort(far, axis=1)[:, :10]] == label[:, None]).mean() > 0.9


def test_a_map_moves_few_bytes_for_each_row(spark):
    x = np.random.default_rng(6).normal(size=(2000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    before = written(spark)
    assert neighbour_map(df, steps=2).count() == len(x)
    assert (written(spark) - before) / len(x) < 40_000


@pytest.mark.parametrize("rows", [[], clusters(1), clusters(2), [(i, 0, [1.0, 2.0]) for i in range(7)] + [(7, 0, [0.0, 0.0]), (8, 0, None), (None, 0, [1.0, 1.0]), (9, 0, [float("nan"), 1.0])]])
def test_few_equal_and_broken_vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    ok = {i for i, _, v in rows if i is not None and v is not None and not np.isnan(v).any()}
    edges = {(r.id, r.ref) for r in neighbour_graph(df, 3).collect()}
    assert {i for i, _ in edges} == (ok if len(ok) > 1 else set()) and all(i != j and j in ok for i, j in edges)
    assert len(edges) == len(ok) * min(3, max(0, len(ok) - 1))
    assert all(math.isfinite(r.x + r.y) for r in neighbour_map(df, 3, steps=2).collect())


def test_saved_embeddings_are_the_models(spark):
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{DATA}/documents.parquet')").fetchall()
    want = dict(zip([i for i, _ in docs], HashedNgrams().embed([t or "" for _, t in docs]).astype(np.float32), strict=True))
    got = {r.doc_id: r.embedding for r in QUERIES["saved_embeddings"](spark, str(DATA)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], v, atol=1e-6) for i, v in want.items())
