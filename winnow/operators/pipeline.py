"""The screeners as Spark ML stages: estimators with parameters, models that are saved and loaded, in pipelines and grids.

An estimator's fit gives a model whose transform adds a score column; the columns of transform's input stay. Models of references
keep them as Parquet beside the parameters, so a loaded one asks the same rows.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.operators.metrics import curve, ranking
from winnow.operators.scorers import CosineScreener, KmerScreener, LinearScreener, NeighbourScreener

KINDS = ("kmer", "cosine", "linear", "knn")


class _Shared(Params):
    """Parameters of estimators and models: the kind of screener, its columns, and what it is set by."""

    kind = Param(Params._dummy(), "kind", "kmer, cosine, linear or knn", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique ids", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "1 for positives, 0 for others", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "texts for kmer, arrays of numbers for the others", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "the column that transform adds", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "code points of a k-mer, or neighbours", TypeConverters.toInt)
    c = Param(Params._dummy(), "c", "inverse of linear's penalty", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(kind="linear", idCol="id", labelCol="y", inputCol="embedding", scoreCol="score", k=CONFIG.neighbours, c=1.0)

    def _screener(self):
        kind, k = self.getOrDefault("kind"), self.getOrDefault("k")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind}")
        return {"kmer": lambda: KmerScreener(k), "cosine": lambda: CosineScreener(k), "linear": lambda: LinearScreener(self.getOrDefault("c")), "knn": lambda: NeighbourScreener(k)}[kind]()

    def _slim(self, df: DataFrame, labelled: bool) -> DataFrame:
        name = "text" if self.getOrDefault("kind") == "kmer" else "embedding"
        columns = [F.col(self.getOrDefault("idCol")).alias("id"), F.col(self.getOrDefault("inputCol")).alias(name)]
        return df.select(*columns, *([F.col(self.getOrDefault("labelCol")).cast("int").alias("y")] if labelled else []))

    def _values(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark, stage = SparkSession.active(), self.stage
        described = {"class": type(stage).__module__ + "." + type(stage).__name__, "uid": stage.uid, "paramMap": stage._values(), "timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {}}
        spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        stage._write_more(path)


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = SparkSession.active()
        described = json.loads(spark.read.text(f"{path}/metadata").first().value)
        stage = self.kind()
        stage._resetUid(described["uid"])
        stage._set(**described["paramMap"])
        stage._read_more(path)
        return stage


class _Kept(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _write_more(self, path: str) -> None:
        pass

    def _read_more(self, path: str) -> None:
        pass


class Screener(_Shared, Estimator, _Kept):
    """Screener(kind="knn", k=5).fit(rows) gives a ScreenerModel; rows have ids, labels and inputs, nulls of which are left out."""

    def __init__(self, **values):
        super().__init__()
        self._defaults()
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> ScreenerModel:
        model = ScreenerModel()
        model._resetUid(self.uid)
        model._set(**self._values())
        rows = self._slim(dataset, True).dropna()
        return model._fitted(rows)


class ScreenerModel(_Shared, Model, _Kept):
    """Adds scoreCol to rows with ids and inputs; each id is scored once, so repeated ids share a score, and a null id has none."""

    def __init__(self):
        super().__init__()
        self._defaults()
        self.rows, self.fitted = None, None

    def _fitted(self, rows: DataFrame) -> ScreenerModel:
        self.rows, self.fitted = rows, self._screener().fit(rows)
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, out = self.getOrDefault("idCol"), self.getOrDefault("scoreCol")
        asked = self._slim(dataset, False).where("id is not null").dropDuplicates(["id"])
        scored = self.fitted.transform(asked).select(F.col("id").alias("_scored_id"), F.col("score").cast("double").alias(out))
        return dataset.join(scored, dataset[key] == F.col("_scored_id"), "left").drop("_scored_id")

    def _write_more(self, path: str) -> None:
        if self.getOrDefault("kind") == "linear":
            self.fitted.save(f"{path}/model")
        else:
            self.rows.write.parquet(f"{path}/references")

    def _read_more(self, path: str) -> None:
        if self.getOrDefault("kind") == "linear":
            self.fitted = LinearScreener.load(f"{path}/model")
        else:
            self._fitted(SparkSession.active().read.parquet(f"{path}/references"))


class RankingEvaluator(_Shared, Evaluator, _Kept):
    """AUROC, or with metric="auprc" average precision, of scoreCol against labelCol, exact with ties; for grids over splits."""

    metric = Param(Params._dummy(), "metric", "auroc or auprc", TypeConverters.toString)

    def __init__(self, **values):
        super().__init__()
        self._defaults()
        self._setDefault(metric="auroc")
        self._set(**values)

    def _evaluate(self, dataset: DataFrame) -> float:
        scores = dataset.select(F.lit("").alias("split"), F.lit("").alias("method"), F.col(self.getOrDefault("labelCol")).cast("int").alias("y"), F.col(self.getOrDefault("scoreCol")).cast("double").alias("score"))
        row = ranking(curve(scores, many_groups=True)).select(self.getOrDefault("metric")).first()
        return float(row[0]) if row else 0.0

    def isLargerBetter(self) -> bool:
        return True
