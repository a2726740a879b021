"""Screeners as ML stages: saved and loaded models score alike, in pipelines, and in a tuned grid over splits."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from winnow.operators.pipeline import RankingEvaluator, Screener, ScreenerModel
from winnow.operators.scorers import CosineScreener, KmerScreener, LinearScreener, NeighbourScreener


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(60):
        y = int(i % 3 == 0)
        out.append((i, y, "".join(rng.choice([*("abc" if y else "cde")], 12)), (rng.normal(size=4) + y).tolist(), "kept"))
    return spark.createDataFrame(out, "id long, y int, text string, embedding array<double>, extra string")


@pytest.mark.parametrize("kind", ["kmer", "cosine", "linear", "knn"])
def test_saved_models_score_alike(spark, rows, tmp_path, kind):
    column = "text" if kind == "kmer" else "embedding"
    stage = Screener(kind=kind, k=3, inputCol=column, scoreCol="s")
    model = stage.fit(rows)
    got = {r.id: r.s for r in model.transform(rows).collect()}
    plain = {"kmer": KmerScreener(3), "cosine": CosineScreener(3), "linear": LinearScreener(), "knn": NeighbourScreener(3)}[kind].fit(rows).transform(rows.drop("extra"))
    assert got == pytest.approx({r.id: r.score for r in plain.collect()})
    model.write().overwrite().save(f"{tmp_path}/model")
    stage.save(f"{tmp_path}/stage")
    again, same = ScreenerModel.load(f"{tmp_path}/model"), Screener.load(f"{tmp_path}/stage")
    assert {r.id: r.s for r in again.transform(rows).collect()} == pytest.approx(got) and (same.uid, same._values()) == (stage.uid, stage._values())
    odd = spark.createDataFrame([(1, None, None), (1, "abcabc", [1.0, 0.0, 0.0, 0.0]), (None, "abc", [0.0] * 4)], "id long, text string, embedding array<double>").where("id is null or text is not null")
    assert {(r.id, r.s is None) for r in again.transform(odd).collect()} == {(1, False), (None, True)}


def test_in_a_pipeline(rows, tmp_path):
    fitted = Pipeline(stages=[Screener(kind="knn", scoreCol="near"), Screener(kind="linear", scoreCol="line")]).fit(rows)
    out = fitted.transform(rows)
    assert out.columns == [*rows.columns, "near", "line"] and out.count() == 60 and out.where("near is null or line is null").count() == 0
    fitted.save(f"{tmp_path}/p")
    a, b = ({r.id: (r.near, r.line) for r in m.transform(rows).collect()} for m in (fitted, PipelineModel.load(f"{tmp_path}/p")))
    assert all(a[i] == pytest.approx(b[i]) for i in a)


def test_a_tuned_grid(rows):
    stage, judge = Screener(kind="knn"), RankingEvaluator()
    grid = ParamGridBuilder().addGrid(stage.k, [1, 7]).build()
    tuned = CrossValidator(estimator=stage, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1).fit(rows)
    assert len(tuned.avgMetrics) == 2 and tuned.bestModel.getOrDefault("k") == [1, 7][int(np.argmax(tuned.avgMetrics))]
    assert judge.evaluate(tuned.bestModel.transform(rows)) > 0.8 and 0 <= RankingEvaluator(metric="auprc").evaluate(tuned.bestModel.transform(rows)) <= 1
    with pytest.raises(ValueError, match="kind"):
        Screener(kind="other").fit(rows)
