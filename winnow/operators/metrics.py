"""Ranking metrics over a long frame of scores (split, method, id, y, score), exact with ties.

Everything is built on counts by distinct score. Running counts over them come from ranges of scores, so no window holds all
scores of a method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.operators.prefix import joined, running

KEYS = ["split", "method"]


def by_score(scores: DataFrame, keys: list[str] = KEYS, weight: Column | None = None) -> DataFrame:
    """Positives and negatives of each distinct score; NaN and null scores are left out."""
    w = weight if weight is not None else F.lit(1)
    ok = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isin(0, 1))
    return ok.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("neg"))


def curve(scores: DataFrame, keys: list[str] = KEYS, weight: Column | None = None, many_groups: bool = False) -> DataFrame:
    """For each distinct score, taken as a threshold: tp, fp, and the totals n_pos, n_neg.

    Running counts are over ranges of (keys, score), so equal scores are one row and any number of distinct ones, however close,
    are spread over tasks. many_groups: where groups are many and alike, as the iterations of a bootstrap are, each group's
    distinct scores are sorted by one task instead, which writes nothing. Groups and scores as in by_score().
    """
    h = by_score(scores, keys, weight)
    if many_groups:
        down, whole = Window.partitionBy(*keys).orderBy(F.desc("score")), Window.partitionBy(*keys)
        sums = {f: F.sum(c).over(w) for f, c, w in (("tp", "pos", down), ("fp", "neg", down), ("n_pos", "pos", whole), ("n_neg", "neg", whole))}
        return h.withColumns(sums).select(*keys, "score", "pos", "neg", *sums)
    h = running(h, keys, [F.col("score").desc()], {"pos": "tp", "neg": "fp"})
    totals = h.groupBy(*keys).agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"))
    return joined(h, totals, keys).select(*keys, "score", "pos", "neg", "tp", "fp", "n_pos", "n_neg")


def roc_points(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return curve(scores, keys).where("n_pos > 0 and n_neg > 0").select(*keys, "score", (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / F.col("n_pos")).alias("tpr"))


def pr_points(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Precision and recall at each threshold, and the end point (1, 0) with a null score."""
    c = curve(scores, keys).where("n_pos > 0")
    points = c.select(*keys, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("n_pos")).alias("recall"))
    return points.unionAll(c.select(*keys).distinct().select(*keys, F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)))


def _two_classes(value: Column, otherwise: float) -> Column:
    return F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), value).otherwise(F.lit(otherwise))


def ranking(c: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """AUROC (A5), average precision (A6), recall at precision (A9), FPR at recall (A10), counts; one class: the fixed row."""
    p, n, tp, fp = (F.col(x).cast("double") for x in ("n_pos", "n_neg", "tp", "fp"))
    precision, recall, fpr = F.try_divide(tp, tp + fp), F.try_divide(tp, p), F.try_divide(fp, n)  # null where a class is missing
    below = n - fp + F.col("neg") / 2
    at = lambda cond, x: F.when(cond, x)
    return c.groupBy(*keys).agg(
        _two_classes(F.sum(F.try_divide(F.try_divide(F.col("pos") * below, p), n)), 0.0).alias("auroc"),
        _two_classes(F.sum(F.try_divide(F.col("pos").cast("double"), p) * precision), 0.0).alias("auprc"),
        *[_two_classes(F.coalesce(F.max(at(precision >= t, recall)), F.lit(0.0)), 0.0).alias(f"recall_at_{t * 100:.0f}_precision") for t in (0.95, 0.99)],
        *[_two_classes(F.coalesce(F.min(at(recall >= t, fpr)), F.lit(1.0)), 1.0).alias(f"fpr_at_{t * 100:.0f}_recall") for t in (0.95, 0.99)],
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )


def best_f1(scores: DataFrame, keys: list[str] = KEYS, steps: int = 200) -> DataFrame:
    """Best F1 over thresholds i / (steps - 1), the smallest on ties, and accuracy there.

    Scores are first counted by the last threshold they reach, so windows see at most `steps` rows of a method.
    """
    top = steps - 1
    h = by_score(scores, keys)
    guess = F.floor(F.col("score") * top)
    # the last i with score >= i / top, exactly as the comparison decides it
    reached = F.least(F.lit(top), guess + F.when(F.col("score") >= (guess + 1) / top, 1).when(F.col("score") < guess / top, -1).otherwise(0))
    counted = h.groupBy(*keys, F.greatest(F.lit(-1), reached).cast("int").alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = counted.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(-1), F.lit(top))).alias("i")).join(counted, [*keys, "i"], "left")
    up = Window.partitionBy(*keys).orderBy(F.desc("i"))
    whole = Window.partitionBy(*keys)
    t = every.select(*keys, "i", F.sum(F.coalesce("pos", F.lit(0))).over(up).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(up).alias("fp"), F.sum(F.coalesce("pos", F.lit(0))).over(whole).alias("p"), F.sum(F.coalesce("neg", F.lit(0))).over(whole).alias("n")).where("i >= 0")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).otherwise(F.lit(0.0))
    t = t.select(*keys, "i", f1.alias("f1"), ((F.col("tp") + F.col("n") - F.col("fp")) / (F.col("p") + F.col("n"))).alias("accuracy"))
    best = t.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("i")).alias("least"), "accuracy")).alias("b"))
    return best.select(*keys, F.col("b.f1").alias("f1_optimal"), (-F.col("b.least") / top).alias("threshold"), F.col("b.accuracy").alias("accuracy_optimal"))


def metric_rows(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The whole metric row of each group (A14); one class only: zeros, and ones for false-positive rates."""
    r = ranking(curve(scores, keys), keys).join(best_f1(scores, keys), keys)
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    fix = lambda c: F.when(ok, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    names = ["auroc", "auprc", "recall_at_95_precision", "recall_at_99_precision", "fpr_at_95_recall", "fpr_at_99_recall"]
    return r.select(*keys, *names, fix("f1_optimal"), fix("accuracy_optimal"), (F.col("n_pos") + F.col("n_neg")).alias("n_samples"), "n_pos", "n_neg")


def similarity_bin(value: Column, bounds: tuple[float, ...]) -> tuple[Column, Column]:
    """(bin_lo, bin_hi) of descending half-open bins; the first goes up to 1.01, the last down to 0 and below."""
    edges = [(b, hi) for b, hi in zip(bounds, (1.01, *bounds), strict=False)] + [(0.0, bounds[-1])]
    lo = hi = None
    for b, top in edges[:-1]:
        lo = F.when(value >= b, F.lit(b)) if lo is None else lo.when(value >= b, F.lit(b))
        hi = F.when(value >= b, F.lit(top)) if hi is None else hi.when(value >= b, F.lit(top))
    return lo.otherwise(F.lit(0.0)), hi.otherwise(F.lit(edges[-1][1]))


def detection_by_bin(scores: DataFrame, sims: DataFrame, bounds: tuple[float, ...] = CONFIG.divergence_bounds, threshold: float = CONFIG.threshold, keys: list[str] = KEYS) -> DataFrame:
    """Detection rate of positives by similarity bin (A15, A17); sims: (id, similarity). Empty bins have no row."""
    lo, hi = similarity_bin(F.col("similarity"), bounds)
    j = scores.where("y = 1").join(sims, "id").withColumn("bin_lo", lo).withColumn("bin_hi", hi)
    return j.groupBy(*keys, "bin_lo", "bin_hi").agg(F.avg((F.col("score") >= threshold).cast("double")).alias("detection_rate"), F.count("*").alias("n_samples"), F.avg("score").alias("mean_score"))


def false_positives(scores: DataFrame, keys: list[str] = KEYS, threshold: float = CONFIG.threshold) -> DataFrame:
    """Share of negatives at or over the threshold, their mean and greatest score."""
    return scores.where("y = 0").groupBy(*keys).agg(F.avg((F.col("score") >= threshold).cast("double")).alias("fpr"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count("*").alias("n_samples"))


def score_histogram(scores: DataFrame, bins: int = 30, keys: list[str] = KEYS) -> DataFrame:
    """Counts in equal-width bins from the group's least to its greatest score (A31); the top edge belongs to the last bin."""
    ends = scores.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return scores.join(ends, keys).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
