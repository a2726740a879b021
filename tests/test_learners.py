"""The contrastive learner, attention pooling and embedders against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import neural
from winnow.operators.embedders import MOST, HashedNgrams, OnnxModel, embed_and_save, embedded, hidden_states


def test_gradients():
    """Of the whole loss by each weight, against differences; without dropout, whose draws would differ."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 6)), (np.arange(12) % 3 == 0).astype(float)
    for multi in (False, True):
        model = neural.ScreenerModel(6, 4, multi, dropout=0.0, seed=1)

        def loss(m=model):
            z, logit = m.forward(x, True, rng)
            con, bce, *_ = neural._loss(z, logit, y, 0.5)
            return 0.5 * (con + bce)

        z, logit = model.forward(x, True, rng)
        _, _, gz, gl = neural._loss(z, logit, y, 0.5)
        model.backward(gz, gl)
        for layer in [layer for layer in model.projection + model.head if layer.own]:
            for k, p in layer.own.items():
                grad = layer.grads[k].copy()
                for at in list(np.ndindex(p.shape))[:: max(1, p.size // 5)]:
                    kept = p[at]
                    p[at] = kept + 1e-6
                    up = loss()
                    p[at] = kept - 1e-6
                    down = loss()
                    p[at] = kept
                    assert abs((up - down) / 2e-6 - grad[at]) < 1e-5, (multi, type(layer).__name__, k)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(size=8) + (1.5 if i % 4 == 0 else 0)).tolist(), int(i % 4 == 0)) for i in range(240)]
    return spark.createDataFrame(data, "id long, embedding array<float>, y int")


def test_training_validation_and_saving(spark, rows, tmp_path):
    train, val = rows.where("id < 160"), rows.where("id >= 160")
    model = neural.train_screener(train, val, projection_dim=8, epochs=12, use_mixup=True, multi_scale=True)
    h = model.history
    assert len(h) == 12 and all(e["train_loss"] == pytest.approx(0.5 * (e["train_con"] + e["train_bce"])) for e in h) and h[-1]["train_bce"] < h[0]["train_bce"]
    scored = model.transform(val).toPandas()
    best = max(e["val_auroc"] for e in h)
    assert neural.auroc(scored["y"].to_numpy(), scored["score"].to_numpy()) == pytest.approx(best) and best > 0.8  # the best epoch's weights
    best = neural.best_epoch(model.history_frame(spark), "val_auroc").first()
    assert best.epoch == int(np.argmax([e["val_auroc"] for e in h]))
    model.save(spark, str(tmp_path / "net"))
    again = neural.ScreenerModel.load(spark, str(tmp_path / "net")).transform(val).toPandas()
    assert np.allclose(again["score"], scored["score"]) and again["id"].tolist() == scored["id"].tolist()
    unit = model.projected(val.limit(3)).collect()
    assert all(abs(np.linalg.norm(r.projection) - 1) < 1e-6 and len(r.projection) == 8 for r in unit)
    nothing = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    assert model.transform(nothing).first().score is None
    with pytest.raises(ValueError, match="both classes"):
        neural.train_screener(rows.where("y = 0"), hard_negatives=False)


def test_hard_negatives_are_the_nearest(spark, rows):
    x, y = neural._mined(rows, 3, 40, 42)
    assert len(x) == 40 and y.tolist() == [1, 0, 0, 0] * 10
    all_rows = {r.id: np.array(r.embedding) for r in rows.where("y = 0").collect()}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    best = sorted((-cosine(x[0], v) for v in all_rows.values()))[:3]
    assert np.allclose(best, [-cosine(x[0], v) for v in x[1:4]])


def test_contrastive_loss_in_blocks(spark, rows):
    batch = rows.withColumn("label", F.col("id") % 7).unionByName(spark.createDataFrame([(999, [1.0] * 8, 0, 99)], "id long, embedding array<float>, y int, label long"))
    x = batch.toPandas()
    z = np.array([*x["embedding"]])
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    expected = neural.supcon(z, x["label"].to_numpy(), 0.1)[0]
    for size in (4096, 50):
        got = neural.supcon_loss(batch, rows=size).first()
        assert got.n == 241 and abs(got.loss - expected) < 1e-9


def test_attention_pool(spark):
    rng = np.random.default_rng(5)
    pool = neural.AttentionPool.drawn(4, hidden=3, heads=2)
    states = [rng.normal(size=(n, 4)) for n in (5, 1)]
    data = [(1, states[0].tolist(), [1, 1, 0, 1, 0]), (2, states[1].tolist(), [1]), (3, [], []), (4, None, None), (5, states[0].tolist(), [0] * 5)]
    df = spark.createDataFrame(data, "id long, states array<array<double>>, mask array<int>")
    got = {r.id: r for r in pool.transform(df, mask="mask").collect()}
    x, on = states[0], np.array([1, 1, 0, 1, 0]) == 1
    heads = []
    for h in range(2):
        e = np.array([pool.query[h] @ (p @ pool.key)[3 * h : 3 * h + 3] / np.sqrt(3) for p in x])
        a = np.where(on, np.exp(e - e[on].max()), 0)
        heads.append(a / a.sum())
    a = np.mean(heads, axis=0)
    assert np.allclose(got[1].attention, a) and np.allclose(got[1].pooled, sum(w * (p @ pool.value) for w, p in zip(a, x, strict=True)))
    assert got[2].attention == [1.0] and got[3].pooled == got[4].pooled == [0.0] * 4 and got[3].attention == [] and got[5].attention == [0.0] * 5


def plain_ngrams(text, width=64, n=3):
    out, b = np.zeros(width), text.encode()
    for i in range(len(b) - n + 1):
        h = 0
        for c in b[i : i + n]:
            h = (h ^ c) * 0x100000001B3 % 2**64
        h ^= h >> 29
        out[h % width] += 1 if h >> 40 & 1 else -1
    size = np.linalg.norm(out)
    return out / size if size else out


def test_embedders(spark, tmp_path):
    texts = [(1, "some words, some more"), (2, None), (3, ""), (4, "é"), (5, "x" * 5000)]
    df = spark.createDataFrame(texts, "id long, text string")
    model = HashedNgrams()
    got = {r.id: r.embedding for r in embedded(df, model).collect()}
    assert all(np.allclose(got[i], plain_ngrams((t or "")[:MOST]), atol=1e-6) for i, t in texts)
    states = {r.id: r.states for r in hidden_states(df, model).collect()}
    mean = np.mean(states[1], axis=0)
    assert np.allclose(mean / np.linalg.norm(mean), got[1], atol=1e-6) and states[2] == [] and len(states[5]) == MOST - 2
    saved = embed_and_save(df, model, str(tmp_path / "v"))
    assert {r.id: r.embedding for r in saved.collect()} == got
    ragged = embed_and_save(df, model, str(tmp_path / "s"), with_states=True)
    assert {r.id: len(r.states) for r in ragged.collect()} == {i: len(x) for i, x in states.items()}
    assert embedded(df.limit(0), model).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        OnnxModel("/nowhere.onnx", 4, lambda t: ({}, np.ones((len(t), 1)))).embed(["a"])


def test_mixup_partners(spark):
    rows = [(i, [float(i), 0.0], i % 2) for i in range(7)] + [(100, [1.0, 2.0], 9)]
    got = {r.id: r for r in neural.mixup(spark.createDataFrame(rows, "id long, embedding array<float>, label int"), 0.25).collect()}
    of = dict((i, (np.array(v), label)) for i, v, label in rows)
    assert got.keys() == of.keys() and got[100].partner == 100
    for i, r in got.items():
        assert of[r.partner][1] == of[i][1] and np.allclose(r.mixed, 0.25 * of[i][0] + 0.75 * of[r.partner][0])
    assert len({r.partner for r in got.values()}) == len(rows)


def test_models_are_scored_together(spark, rows):
    models = {n: neural.ScreenerModel(8, 4, n == "b", seed=2) for n in "ab"}
    both = neural.scored_by(models, rows.unionByName(spark.createDataFrame([(9, None, 0)], rows.schema))).toPandas()
    for n, m in models.items():
        mine = both[both["method"] == n].sort_values("id")
        assert np.allclose(mine["score"], m.transform(rows).orderBy("id").toPandas()["score"])


def test_ablation_rows(spark, rows):
    got = neural.ablation(rows.where("id < 160"), rows.where("id >= 160"), {"negatives": [1, 3], "multi_scale": [True]}, epochs=3).collect()
    assert [(r.ablation_type, r.ablation_value) for r in got] == [("multi_scale", "True"), ("negatives", "1"), ("negatives", "3")] and all(r.n_samples == 80 for r in got)


def test_supcon_loss_by_few_anchors_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), int(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    monkeypatch.setattr(neural, "ANCHORS", 7)
    got = neural.supcon_loss(df, rows=20).first()
    z = np.array([r[1] for r in rows])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want, _ = neural.supcon(z, np.array([r[2] for r in rows]), 0.1)
    assert got.n == 50 and abs(got.loss - want) < 1e-9


@pytest.mark.parametrize("most", [20_000, 50])
def test_screeners_are_fitted_on_all_rows(spark, rows, monkeypatch, most):
    """Beyond a shard too, where before the first rows by hash were fitted on alone; shards' models are averaged after each epoch."""
    seen, whole = spark.sparkContext.accumulator(0), neural._by_shard
    largest = spark.sparkContext.accumulator(0)

    def counted(batches):
        for shard, x, y in whole(batches):
            seen.add(len(x))
            largest.add(int(len(x) > 2 * most))
            yield shard, x, y

    monkeypatch.setattr(neural, "SHARD", most)
    monkeypatch.setattr(neural, "_by_shard", counted)
    train, test = rows.where("id < 160"), rows.where("id >= 160")
    got = {r.ablation_value: r for r in neural.ablation(train, test, {"negatives": [1, 3]}, epochs=8).collect()}
    assert seen.value == (40 * 2 + 40 * 4) * (1 if most > 160 else 8) and largest.value == 0
    assert all(r.n_samples == 80 and r.auroc > 0.8 for r in got.values())


def test_shards_are_averaged_by_their_rows(spark, rows, monkeypatch):
    """One epoch over four shards is the mean of what each shard makes of the first model."""
    monkeypatch.setattr(neural, "SHARD", 40)
    all_rows = rows.select(F.col("id").alias("anchor"), F.lit(0).alias("slot"), "embedding", "y")
    how = neural.Fitting(projection_dim=4, epochs=1)
    (model,) = neural.fitted(all_rows, {"": how})[""]
    dealt, count = neural._dealt(all_rows, ["anchor", "slot"], "again")
    parts, weights = [], []
    for shard, pdf in dealt.toPandas().groupby("shard"):
        x, y = np.array([*pdf["embedding"]], float), pdf["y"].to_numpy(float)
        moving = neural._Moving(how, 8)
        list(moving.epochs(x, y, range(1), np.random.default_rng([how.seed, shard, 0])))
        parts.append(np.concatenate([a.ravel() for a in moving.model.arrays().values()]))
        weights.append(len(x))
    assert count == 6 == len(parts) and sum(weights) == 240
    assert np.allclose(np.concatenate([a.ravel() for a in model.arrays().values()]), np.average(parts, axis=0, weights=weights))
