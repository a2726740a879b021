"""A small contrastive screener in NumPy: projection head with batch statistics and dropout, classifier head, supervised
contrastive and logistic loss, validation after each epoch. Spark finds hard negatives and deals all rows into shards; tasks fit
models to their shards and Spark averages these after each epoch. Scoring is a pandas UDF with broadcast weights."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.functions import vector as V
from winnow.operators import simjoin
from winnow.operators.metrics import curve, metric_rows, ranking
from winnow.operators.sampling import hash_rank, numbered, subsample
from winnow.session import saved

#: Anchors that a task compares with a block at a time, and rows that it scores by several models at a time.
ANCHORS, SCORED = 256, 1000
#: Rows that a task fits a model to, and numbers of their vectors at most; more rows are more tasks.
SHARD, NUMBERS = 20_000, 8_000_000


def mixup(rows: DataFrame, weight: float, seed: int = CONFIG.seed) -> DataFrame:
    """(id, partner, mixed): each row with the next one of its label in hash order, interpolated (M11). weight belongs to the row.

    The last row's partner is the first one; a label's only row is its own. Rows meet by their number within the label.
    """
    o = numbered(rows.select("id", "label", "embedding"), "id", seed, ["label"])
    nxt = o.select(F.col("label").alias("of"), "hash_order", F.col("id").alias("partner"), F.col("embedding").alias("other"))
    follows = o.withColumn("hash_order", F.col("hash_order") % F.col("stratum_size") + 1)
    met = follows.join(nxt, (follows["label"].eqNullSafe(nxt["of"])) & (follows["hash_order"] == nxt["hash_order"]))
    return met.select("id", "partner", V.interpolate("embedding", "other", weight).alias("mixed"))


def supcon_loss(batch: DataFrame, temperature: float = 0.1, rows: int = CONFIG.block_rows) -> DataFrame:
    """(n, loss) of a batch (id, embedding, label) (M9): each anchor against all others, self excluded, mean over all anchors.

    Rows are dealt into blocks of about `rows`; each pair of blocks is one group that gives its anchors' partial sums, so a
    task holds two blocks whatever the size of the batch. An anchor without another of its label counts as 0. Rows without
    a vector are left out; ids are unique.
    """
    x = batch.where("embedding is not null").select("id", "embedding", "label")
    blocks = max(1, -(-x.count() // rows))
    deal = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = x.select("*", deal.alias("a")).select("*", F.lit(True).alias("asks"), every.alias("b"))
    given = x.select("*", deal.alias("b")).select("*", F.lit(False).alias("asks"), every.alias("a")).select(asked.columns)

    def partial(both: pd.DataFrame) -> pd.DataFrame:
        u, v = both[both["asks"]], both[~both["asks"]]
        if u.empty or v.empty:
            return pd.DataFrame({"id": [], "e": [], "z": [], "same": []})
        out, y, labels, ids = [], simjoin._unit(v["embedding"]), v["label"].to_numpy(), v["id"].to_numpy()
        for at in range(0, len(u), ANCHORS):
            some = u.iloc[at : at + ANCHORS]
            s = simjoin._unit(some["embedding"]) @ y.T / temperature
            other = some["id"].to_numpy()[:, None] != ids[None, :]
            same = (some["label"].to_numpy()[:, None] == labels[None, :]) & other
            # cosines are at most 1, so no exponent is above 0
            out.append(pd.DataFrame({"id": some["id"].to_numpy(), "e": (np.exp(s - 1 / temperature) * other).sum(axis=1), "z": np.where(same, s, 0).sum(axis=1), "same": same.sum(axis=1)}))
        return pd.concat(out, ignore_index=True)

    kind = batch.schema["id"].dataType.simpleString()
    sums = asked.unionAll(given).groupBy("a", "b").applyInPandas(lambda both: partial(both), f"id {kind}, e double, z double, same long")
    per = sums.groupBy("id").agg(F.sum("e").alias("e"), F.sum("z").alias("z"), F.sum("same").alias("same"))
    loss = F.when(F.col("same") > 0, F.log("e") + 1 / temperature - F.col("z") / F.col("same")).otherwise(0.0)
    return per.agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))


def supcon(z: np.ndarray, y: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Loss and its gradient by the unit rows z."""
    n = len(z)
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    top = s.max(axis=1, keepdims=True)
    e = np.exp(s - top)
    soft = e / e.sum(axis=1, keepdims=True)
    logp = s - top - np.log(e.sum(axis=1, keepdims=True))
    same = (y[:, None] == y[None, :]) & ~np.eye(n, dtype=bool)
    count = np.maximum(1, same.sum(axis=1))
    value = -(np.where(same, logp, 0).sum(axis=1) / count).mean()
    g = (soft * (same.sum(axis=1) / count)[:, None] - same / count[:, None]) / n / temperature
    return float(value), (g + g.T) @ z


class Linear:
    def __init__(self, n_in: int, n_out: int, rng):
        edge = 1 / np.sqrt(n_in)
        self.own = {"w": rng.uniform(-edge, edge, (n_in, n_out)), "b": rng.uniform(-edge, edge, n_out)}

    def forward(self, x, train, rng):
        self.x = x
        return x @ self.own["w"] + self.own["b"]

    def backward(self, g):
        self.grads = {"w": self.x.T @ g, "b": g.sum(axis=0)}
        return g @ self.own["w"].T


class BatchNorm:
    """By the batch's statistics in training and by their running means in scoring."""

    def __init__(self, n: int):
        self.own = {"scale": np.ones(n), "shift": np.zeros(n)}
        self.kept = {"mean": np.zeros(n), "var": np.ones(n)}

    def forward(self, x, train, rng):
        mean, var = (x.mean(axis=0), x.var(axis=0)) if train else (self.kept["mean"], self.kept["var"])
        if train:
            self.kept["mean"] += 0.1 * (mean - self.kept["mean"])
            self.kept["var"] += 0.1 * (var * len(x) / max(1, len(x) - 1) - self.kept["var"])
        self.by = np.sqrt(var + 1e-5)
        self.x = (x - mean) / self.by
        return self.x * self.own["scale"] + self.own["shift"]

    def backward(self, g):
        self.grads = {"scale": (g * self.x).sum(axis=0), "shift": g.sum(axis=0)}
        g = g * self.own["scale"]
        return (g - g.mean(axis=0) - self.x * (g * self.x).mean(axis=0)) / self.by


class Relu:
    own: dict = {}

    def forward(self, x, train, rng):
        self.on = x > 0
        return x * self.on

    def backward(self, g):
        return g * self.on


class Dropout:
    own: dict = {}

    def __init__(self, rate: float):
        self.rate = rate

    def forward(self, x, train, rng):
        self.by = (rng.random(x.shape) >= self.rate) / (1 - self.rate) if train and self.rate else 1.0
        return x * self.by

    def backward(self, g):
        return g * self.by


def _run(layers: list, x: np.ndarray, train: bool = False, rng=None) -> np.ndarray:
    for layer in layers:
        x = layer.forward(x, train, rng)
    return x


def _back(layers: list, g: np.ndarray) -> np.ndarray:
    for layer in reversed(layers):
        g = layer.backward(g)
    return g


@dataclass
class ScreenerModel:
    """Projection (in, in/2, in/4, d with batch norm, M6) to unit vectors, and a classifier (M7) of these, or of input and projection."""

    width: int
    projection_dim: int = 16
    multi_scale: bool = False
    dropout: float = 0.1
    seed: int = CONFIG.seed
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        rng, drop = np.random.default_rng(self.seed), lambda: Dropout(self.dropout)
        a, b = max(2, self.width // 2), max(2, self.width // 4)
        self.projection = [Linear(self.width, a, rng), BatchNorm(a), Relu(), drop(), Linear(a, b, rng), BatchNorm(b), Relu(), drop(), Linear(b, self.projection_dim, rng)]
        sizes = [self.projection_dim + self.width, 128, 64] if self.multi_scale else [self.projection_dim, 64]
        hidden = [x for m, n in zip(sizes, sizes[1:], strict=False) for x in (Linear(m, n, rng), Relu(), drop())]
        self.head = [*hidden, Linear(sizes[-1], 1, rng)]

    def forward(self, x: np.ndarray, train: bool = False, rng=None) -> tuple[np.ndarray, np.ndarray]:
        """Unit projections and logits."""
        raw = _run(self.projection, x, train, rng)
        self.norm = np.maximum(1e-12, np.linalg.norm(raw, axis=1, keepdims=True))
        self.z = raw / self.norm
        h = np.concatenate((x, self.z), axis=1) if self.multi_scale else self.z
        return self.z, _run(self.head, h, train, rng)[:, 0]

    def backward(self, gz: np.ndarray, g_logit: np.ndarray) -> None:
        gz = gz + _back(self.head, g_logit[:, None])[:, -self.projection_dim :]
        _back(self.projection, (gz - self.z * (gz * self.z).sum(axis=1, keepdims=True)) / self.norm)

    def arrays(self) -> dict[str, np.ndarray]:
        """All weights and running statistics by name."""
        return {f"{part}.{i}.{name}": x for part in ("projection", "head") for i, layer in enumerate(getattr(self, part)) for name, x in {**layer.own, **getattr(layer, "kept", {})}.items()}

    def load_arrays(self, arrays: dict[str, np.ndarray]) -> None:
        for name, x in self.arrays().items():
            x[...] = np.asarray(arrays[name], dtype=float).reshape(x.shape)

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights as Parquet rows (name, shape, values), and the settings."""
        rows = [(n, list(x.shape), x.ravel().tolist()) for n, x in self.arrays().items()]
        rows.append(("settings", [], [float(self.width), float(self.projection_dim), float(self.multi_scale), self.dropout, float(self.seed)]))
        spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ScreenerModel:
        found = {r["name"]: r["values"] for r in spark.read.parquet(path).collect()}  # one model's weights
        width, dim, multi, dropout, seed = found.pop("settings")
        model = ScreenerModel(int(width), int(dim), bool(multi), dropout, int(seed))
        model.load_arrays(found)
        return model

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """epoch, train_loss, train_con, train_bce, val_loss, val_auroc."""
        return spark.createDataFrame(self.history, "epoch int, train_loss double, train_con double, train_bce double, val_loss double, val_auroc double")

    def _column(self, rows: DataFrame, embedding: str, kind: str):
        sent = rows.sparkSession.sparkContext.broadcast(replace_history(self))

        @F.pandas_udf(kind)
        def column(e: pd.Series) -> pd.Series:
            known = e.notna().to_numpy()
            values = iter(())
            if known.any():
                z, logit = sent.value.forward(np.array([*e[known]], dtype=float))
                values = iter(1 / (1 + np.exp(-logit)) if kind == "double" else list(z))
            return pd.Series([next(values) if k else None for k in known], dtype=float if kind == "double" else object)

        return column(embedding)

    def transform(self, rows: DataFrame, embedding: str = "embedding") -> DataFrame:
        """rows with score (M20); null without a vector."""
        return rows.withColumn("score", self._column(rows, embedding, "double"))

    def projected(self, rows: DataFrame, embedding: str = "embedding") -> DataFrame:
        """rows with the unit vector `projection`."""
        return rows.withColumn("projection", self._column(rows, embedding, "array<double>"))


def replace_history(model: ScreenerModel) -> ScreenerModel:
    """The model without its history, for sending."""
    out = replace(model, history=[])
    out.load_arrays(model.arrays())
    return out


def auroc(y: np.ndarray, score: np.ndarray) -> float:
    """By mean ranks; NaN where a class is missing."""
    pos = y == 1
    if pos.all() or not pos.any():
        return float("nan")
    ranks = pd.Series(score).rank().to_numpy()
    return float((ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()))


def _loss(z: np.ndarray, logit: np.ndarray, y: np.ndarray, temperature: float):
    """Contrastive and logistic loss with their gradients by z and the logits, half each."""
    con, gz = supcon(z, y, temperature)
    bce = float((np.logaddexp(0, logit) - y * logit).mean())
    return con, bce, 0.5 * gz, 0.5 * (1 / (1 + np.exp(-logit)) - y) / len(y)


def _mixed_up(x: np.ndarray, y: np.ndarray, rng, alpha: float = 0.2, share: float = 0.5) -> np.ndarray:
    """With a probability, each row is mixed with another of its class, by one weight for the batch."""
    if rng.random() > share:
        return x
    weight, x = rng.beta(alpha, alpha), x.copy()
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        if len(at) > 1:
            x[at] = weight * x[at] + (1 - weight) * x[rng.permutation(at)]
    return x


@dataclass(frozen=True)
class Fitting:
    """How a screener is fitted (M12): AdamW, cosine schedule by epoch, gradients clipped to length 1, incomplete batches dropped."""

    projection_dim: int = 256
    temperature: float = 0.07
    epochs: int = 50
    batch: int = 64
    rate: float = 1e-3
    decay: float = 1e-4
    use_mixup: bool = False
    multi_scale: bool = False
    negatives: int = 3
    seed: int = CONFIG.seed


class _Moving:
    """A model and its optimiser's moments, as one flat vector too."""

    def __init__(self, how: Fitting, width: int, flat: np.ndarray | None = None):
        self.how, self.model = how, ScreenerModel(width, how.projection_dim, how.multi_scale, seed=how.seed)
        self.layers = [layer for layer in self.model.projection + self.model.head if layer.own]
        self.moments = [{k: (np.zeros_like(p), np.zeros_like(p)) for k, p in layer.own.items()} for layer in self.layers]
        at = 0
        for x in self._all() if flat is not None else ():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def _all(self) -> list[np.ndarray]:
        return [*self.model.arrays().values(), *(x for held in self.moments for two in held.values() for x in two)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._all()])

    def epochs(self, x: np.ndarray, y: np.ndarray, some: range, rng):
        """Goes over the rows once for each of some epochs; gives the mean losses of each."""
        how, model = self.how, self.model
        batch = min(how.batch, len(x))
        for epoch in some:
            lr, losses, step = how.rate * 0.5 * (1 + np.cos(np.pi * epoch / how.epochs)), [], epoch * (len(x) // batch)
            order = rng.permutation(len(x))
            for at in range(0, len(x) - batch + 1, batch):
                of = order[at : at + batch]
                by = y[of]
                bx = _mixed_up(x[of], by, rng) if how.use_mixup else x[of]
                z, logit = model.forward(bx, True, rng)
                con, bce, gz, gl = _loss(z, logit, by, how.temperature)
                losses.append((0.5 * (con + bce), con, bce))
                model.backward(gz, gl)
                length = np.sqrt(sum((g**2).sum() for layer in self.layers for g in layer.grads.values()))
                step += 1
                for layer, held in zip(self.layers, self.moments, strict=True):
                    for k, p in layer.own.items():
                        g, (m, v) = layer.grads[k] / max(1.0, length), held[k]
                        m += 0.1 * (g - m)
                        v += 0.001 * (g**2 - v)
                        p -= lr * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + how.decay * p)
            yield np.mean(losses, axis=0)


def _mined_rows(train: DataFrame, negatives: int, positives: DataFrame | None = None) -> DataFrame:
    """(anchor, slot, embedding, y): each positive, or each of some, at slot 0 and its closest negatives at 1 and on."""
    ok = train.where("embedding is not null").select("id", "embedding", "y")
    pos = ok.where("y = 1") if positives is None else positives
    rows = simjoin.expanded(pos, simjoin.hard_negatives(pos, ok.where("y = 0"), negatives), negatives)
    return rows.join(ok.select("id", "embedding"), "id").select("anchor", "slot", "embedding", "y")


def _mined(train: DataFrame, negatives: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the mined rows, those of the first positives by hash, for a look at them; screeners are fitted on all."""
    pos = subsample(train.where("embedding is not null and y = 1").select("id", "embedding", "y"), "id", max(1, most // (1 + negatives)), seed)
    pdf = _mined_rows(train, negatives, pos).orderBy("anchor", "slot").toPandas()
    return np.array([*pdf["embedding"]], dtype=float), pdf["y"].to_numpy(float)


def _dealt(rows: DataFrame, order: list, label: str) -> tuple[DataFrame, int]:
    """(shard, slot, embedding, y) of all rows (anchor, slot, embedding, y), and how many shards there are, of about SHARD rows or NUMBERS numbers each.

    Rows are dealt by a hash of anchor and slot. A shard is one file, in order, and smaller than a row group, so a task reads it whole.
    """
    rows = saved(rows.select("anchor", "slot", "embedding", F.col("y").cast("int").alias("y")), f"{label}-rows")
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shards = max(1, -(-n // max(1, min(SHARD, NUMBERS // max(1, width or 1)))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("anchor", "slot"), F.lit(shards)).cast("int"))
    return saved(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", *order).select("shard", "slot", "embedding", "y"), label), shards


def _by_shard(batches):
    """(shard, vectors, labels) of rows that come shard by shard."""
    of, held = None, []
    whole = lambda: (of, np.array([v for pdf in held for v in pdf["embedding"]], dtype=float), np.concatenate([pdf["y"] for pdf in held]).astype(float))
    for pdf in batches:
        for shard, part in pdf.groupby("shard", sort=False):
            if held and shard != of:
                yield whole()
                held = []
            of, held = shard, [*held, part]
    if held:
        yield whole()


def fitted(rows: DataFrame, hows: dict[str, Fitting], every: bool = False) -> dict[str, list[ScreenerModel]]:
    """For each way the model fitted on all rows (anchor, slot, embedding, y) whose slot is up to its `negatives`; with every, the model after each epoch.

    Up to SHARD rows are one shard, which a task for each way takes through all epochs. More are dealt into shards: in each epoch every
    shard moves the same model by steps of its own, and Spark averages the models and their moments by the shards' rows. Neither
    driver nor a task holds more than a shard and a model for each way, whatever the number of rows. All ways have the same number of epochs.
    """
    shards, count = _dealt(rows, ["anchor", "slot"], "fit")
    labels, width = shards.agg(F.count_distinct("y"), F.max(F.size("embedding"))).first()
    if labels < 2:
        raise ValueError("both classes are needed to train on")
    (epochs,) = {how.epochs for how in hows.values()}
    states, found, history = {name: _Moving(how, width).flat() for name, how in hows.items()}, {name: [] for name in hows}, {name: [] for name in hows}
    for some in [range(epochs)] if count == 1 else [range(e, e + 1) for e in range(epochs)]:
        sent = shards.sparkSession.sparkContext.broadcast(states)

        def moved(name: str, how: Fitting, some=some, sent=sent) -> DataFrame:
            def run(batches):
                for shard, x, y in _by_shard(batches):
                    moving = _Moving(how, width, sent.value[name])
                    rng = np.random.default_rng(how.seed if count == 1 else [how.seed, shard, some[0]])
                    for epoch, losses in zip(some, moving.epochs(x, y, some, rng), strict=True):
                        told = np.concatenate((losses, moving.flat())) if every or epoch == some[-1] else losses
                        yield pd.DataFrame({"method": [name], "epoch": [epoch], "n": [float(len(x))], "told": [told]})

            return shards.where(F.col("slot") <= how.negatives).mapInPandas(run, "method string, epoch int, n double, told array<double>")

        parts = [moved(name, how) for name, how in hows.items()]
        mean = Summarizer.mean(array_to_vector("told"), F.col("n")).alias("told")
        means = reduce(DataFrame.unionAll, parts).groupBy("method", "epoch").agg(mean).collect()  # a model for each way
        for r in sorted(means, key=lambda r: r.epoch):
            losses, flat = r.told.toArray()[:3].tolist(), r.told.toArray()[3:]
            history[r.method].append({"epoch": r.epoch, **dict(zip(("train_loss", "train_con", "train_bce"), losses, strict=True)), "val_loss": None, "val_auroc": None})
            if len(flat):
                states[r.method] = flat
                if every or r.epoch == epochs - 1:
                    model = _Moving(hows[r.method], width, flat).model
                    model.history = list(history[r.method])
                    found[r.method].append(model)
        sent.destroy()
    return found


def train_screener(train: DataFrame, validation: DataFrame | None = None, projection_dim: int = 256, temperature: float = 0.07, epochs: int = 50, batch: int = 64, rate: float = 1e-3, decay: float = 1e-4, use_mixup: bool = False, multi_scale: bool = False, negatives: int = 3, hard_negatives: bool = True, seed: int = CONFIG.seed) -> ScreenerModel:
    """A screener fitted on all positives of (id, embedding, y), each with its hard negatives, or on all rows; see fitted().

    With a validation table the model of the epoch with the greatest AUROC over all of it is kept, else the last.
    """
    how = Fitting(projection_dim, temperature, epochs, batch, rate, decay, use_mixup, multi_scale, negatives, seed)
    known = train.where("embedding is not null and y is not null")
    rows = _mined_rows(known, negatives) if hard_negatives else known.select(F.col("id").alias("anchor"), F.lit(0).alias("slot"), "embedding", "y")
    models = fitted(rows, {"": how}, validation is not None)[""]
    if validation is None:
        return models[-1]
    told = _validated(models, validation, how)
    ok = [e for e, x in told.items() if x["val_auroc"] == x["val_auroc"]]
    out = models[max(ok, key=lambda e: (round(told[e]["val_auroc"], 12), -e)) if ok else -1]  # the first on ties, whatever the order of sums
    out.history = [h | told.get(h["epoch"], {}) for h in models[-1].history]
    return out


def _validated(models: list[ScreenerModel], validation: DataFrame, how: Fitting) -> dict[int, dict]:
    """val_loss, by batches in hash order, and val_auroc, NaN where a class is missing, of the model after each epoch over all rows; {} without rows."""
    known = validation.where("embedding is not null and y is not null")
    shards, _ = _dealt(known.select(F.col("id").alias("anchor"), F.lit(0).alias("slot"), "embedding", "y"), [hash_rank(how.seed, "anchor"), "anchor"], "validation")
    sent = validation.sparkSession.sparkContext.broadcast([replace_history(m) for m in models])

    def run(batches):
        for _, x, y in _by_shard(batches):
            for epoch, model in enumerate(sent.value):
                total, n = 0.0, 0
                for at in range(0, len(x), how.batch):
                    of = slice(at, at + how.batch)
                    con, bce, *_ = _loss(*model.forward(x[of]), y[of], how.temperature)
                    total, n = total + 0.5 * (con + bce), n + 1
                yield pd.DataFrame({"epoch": [epoch], "total": [total], "n": [n]})

    losses = {r.epoch: r.loss for r in shards.mapInPandas(run, "epoch int, total double, n long").groupBy("epoch").agg((F.sum("total") / F.sum("n")).alias("loss")).collect()}
    scored = scored_by({str(e): m for e, m in enumerate(models)}, known).withColumn("split", F.lit("validation"))
    areas = {int(r.method): r.auroc for r in ranking(curve(scored)).where("n_pos > 0 and n_neg > 0").collect()}  # one row for each epoch
    return {e: {"val_loss": x, "val_auroc": areas.get(e, float("nan"))} for e, x in losses.items()}


@dataclass(frozen=True)
class AttentionPool:
    """Scaled attention of learned queries over a row's position vectors, averaged over heads (M8).

    query: (heads, hidden); key: (width, heads * hidden); value: (width, width).
    """

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray

    @staticmethod
    def drawn(width: int, hidden: int = 64, heads: int = 4, seed: int = CONFIG.seed) -> AttentionPool:
        rng = np.random.default_rng(seed)
        return AttentionPool(rng.normal(size=(heads, hidden)), rng.uniform(-1, 1, (width, heads * hidden)) / np.sqrt(width), rng.uniform(-1, 1, (width, width)) / np.sqrt(width))

    def weights(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(heads, positions): softmax over the positions whose mask is 1; 0 elsewhere, and everywhere if there are none."""
        heads, hidden = self.query.shape
        e = np.einsum("hk,phk->hp", self.query, (x @ self.key).reshape(len(x), heads, hidden)) / np.sqrt(hidden)
        e = np.where(mask, e, -np.inf)
        if not mask.any():
            return np.zeros_like(e)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        return a / a.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame, states: str = "states", mask: str | None = None, out: str = "pooled", attention: str = "attention") -> DataFrame:
        """df with the pooled vector and the weights by position, both heads' means. No positions: zeros and no weights."""
        sent = df.sparkSession.sparkContext.broadcast(self)
        schema = df.drop(out, attention).limit(0).withColumn(out, F.array(F.lit(0.0))).withColumn(attention, F.array(F.lit(0.0))).schema

        def run(batches):
            width = sent.value.value.shape[1]
            for pdf in batches:
                pooled, att = [], []
                for k in range(len(pdf)):
                    s = pdf[states].iloc[k]
                    if s is None or not len(s):
                        pooled.append(np.zeros(width).tolist())
                        att.append([])
                        continue
                    x = np.array([*s], dtype=float)
                    on = np.ones(len(x), bool) if mask is None else np.asarray(pdf[mask].iloc[k]) == 1
                    a = sent.value.weights(x, on).mean(axis=0)
                    pooled.append((a @ (x @ sent.value.value)).tolist())
                    att.append(a.tolist())
                yield pdf.assign(**{out: pooled, attention: att})

        return df.drop(out, attention).mapInPandas(run, schema)


def scored_by(models: dict[str, ScreenerModel], rows: DataFrame) -> DataFrame:
    """(method, id, y, score) of every model over rows (id, embedding, y), in one pass; rows without a vector have no score."""
    sent = rows.sparkSession.sparkContext.broadcast({n: replace_history(m) for n, m in models.items()})

    def run(batches):
        # layers keep what they last saw, so a few rows go through all models at a time
        for pdf in (x.iloc[i : i + SCORED] for x in batches for i in range(0, len(x), SCORED)):
            pdf = pdf[pdf["embedding"].notna()]
            x = np.array([*pdf["embedding"]], dtype=float)
            for name, model in sent.value.items() if len(pdf) else ():
                yield pd.DataFrame({"method": name, "id": pdf["id"], "y": pdf["y"], "score": 1 / (1 + np.exp(-model.forward(x)[1]))})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "embedding", "y").mapInPandas(run, f"method string, id {kinds['id']}, y {kinds['y']}, score double")


def ablation(train: DataFrame, test: DataFrame, grid: dict[str, list], epochs: int = 50) -> DataFrame:
    """Metric rows with one factor changed at a time (M19): ablation_type, ablation_value and the metrics on test.

    Models are fitted together, each on all positives with their hard negatives, which are mined once.
    """
    hows = {f"{kind}={value}": Fitting(**{"epochs": epochs, kind: value}) for kind, values in grid.items() for value in values}
    # the closest negatives of fewer are the first of those of more
    rows = _mined_rows(train.where("y is not null"), max(how.negatives for how in hows.values()))
    models = {name: found[-1] for name, found in fitted(rows, hows).items()}
    rows = metric_rows(scored_by(models, test).withColumn("split", F.lit("test")))
    part = lambda k: F.element_at(F.split("method", "=", 2), k)
    return rows.withColumn("ablation_type", part(1)).withColumn("ablation_value", part(2)).drop("method").orderBy("ablation_type", "ablation_value")


def best_epoch(history: DataFrame, metric: str) -> DataFrame:
    """The epoch with the greatest metric, the first on ties; NaN and null left out."""
    ok = history.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    best = ok.agg(F.max(F.struct(metric, (-F.col("epoch")).alias("less"))).alias("b"))
    return best.select((-F.col("b.less")).alias("epoch"), F.col(f"b.{metric}").alias(metric))
