"""Monte-Carlo robustness certification: votes of a scorer over randomly substituted strings, and a lower bound on their share.

The perturbed strings live inside the vote count alone. What comes out is counts and bounds, never a perturbed string.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.functions.text import character_groups


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + t * d) or 1e-30)
        c = (1 + t / c) or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def lower_bound(successes: int, n: int, alpha: float = 0.001) -> float:
    """One-sided Clopper-Pearson lower bound (C5): the p with P(at least so many successes) = alpha; 0 without successes."""
    if successes <= 0:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, successes, n - successes + 1) < alpha else (lo, mid)
    return lo


def word_share_scorer(letter: str) -> Callable[[list[str]], np.ndarray]:
    """A plain scorer for tests and examples: 1 where the letter is over a twentieth of the text."""
    return lambda texts: np.array([float(t.count(letter) > len(t) / 20) for t in texts])


class _Substitutes:
    """Random substitutions of a text, drawn many at a time within a task; they serve the vote count alone."""

    def __init__(self, text: str, kind: str, group_of: dict[str, str]):
        self.text = np.array([*text], "<U1")
        letters, place = np.unique(self.text, return_inverse=True)
        same = lambda c: [x for x in letters if group_of.get(x) == group_of[c]] if kind == "grouped" and c in group_of else [c]
        choices = [list(letters) if kind == "random" else same(c) for c in letters.tolist()]
        self.sizes = np.array([len(c) for c in choices], int)[place] if len(text) else np.zeros(0, int)
        table = np.full((len(choices), max(map(len, choices), default=1)), "", "<U1")
        for row, c in zip(table, choices, strict=True):
            row[: len(c)] = c
        self.table, self.place = table, place
        self.at_once = max(1, 2_000_000 // max(1, len(text)))

    def drawn(self, n: int, n_changes: int, rng) -> list[str]:
        length, k = len(self.text), min(n_changes, len(self.text))
        if not k:
            return ["".join(self.text)] * n
        at = np.argpartition(rng.random((n, length)), k - 1, axis=1)[:, :k]
        new = np.repeat(self.text[None, :], n, axis=0)
        pick = (rng.random((n, k)) * self.sizes[at]).astype(int)
        np.put_along_axis(new, at, self.table[self.place[at], pick], axis=1)
        return new.view(f"<U{length}")[:, 0].tolist()


def votes(items: DataFrame, scorer: Callable[[list[str]], np.ndarray], groups: Mapping[str, str], kinds: list[str], counts: list[int], samples: int, seed: int = CONFIG.seed) -> DataFrame:
    """(id, y, kind, n_changes, first_n, first_votes, n, votes): votes for class 1 in two independent phases.

    kind: grouped substitutes within the caller's character groups, random by any character of the text, none leaves it.
    """
    group_of = character_groups(groups)
    grid = items.select("id", "y", "text", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("n_changes")) for k in kinds for c in counts])).alias("g"))
    grid = grid.select("id", "y", "text", "g.kind", "g.n_changes")
    first = min(100, samples // 4)

    def count(batches):
        for pdf in batches:
            rows = []
            for item, y, text, kind, n_changes in pdf[["id", "y", "text", "kind", "n_changes"]].itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(f"{item}|{kind}|{n_changes}".encode())])
                noise, tally = _Substitutes(text or "", kind, group_of), []
                for n in (first, samples - first):
                    found = 0
                    for at in range(0, n, noise.at_once):
                        found += int((scorer(noise.drawn(min(noise.at_once, n - at), n_changes, rng)) >= CONFIG.threshold).sum())
                    tally += [n, found]
                rows.append((item, y, kind, n_changes, *tally))
            yield pd.DataFrame(rows, columns=["id", "y", "kind", "n_changes", "first_n", "first_votes", "n", "votes"])

    kind = items.schema["id"].dataType.simpleString()
    return grid.mapInPandas(count, f"id {kind}, y int, kind string, n_changes int, first_n int, first_votes int, n int, votes int")


def certificates(counted: DataFrame, alpha: float = 0.001) -> DataFrame:
    """One row for each item and setting (C4): predicted class by the first phase (a tie is class 1), bound by the second."""

    @F.pandas_udf("double")
    def bound(s: pd.Series, n: pd.Series) -> pd.Series:
        known = {k: lower_bound(*k, alpha) for k in set(zip(s.tolist(), n.tolist(), strict=True))}
        return pd.Series([known[k] for k in zip(s.tolist(), n.tolist(), strict=True)], dtype=float)

    c = counted.withColumn("predicted_class", (2 * F.col("first_votes") >= F.col("first_n")).cast("int"))
    c = c.withColumn("agree", F.when(F.col("predicted_class") == 1, F.col("votes")).otherwise(F.col("n") - F.col("votes")))
    c = c.withColumn("p_lower", bound("agree", "n")).withColumn("confidence", F.when(F.col("n") > 0, F.col("agree") / F.col("n")).otherwise(0.0))
    return c.select("id", "kind", "n_changes", "predicted_class", (F.col("p_lower") > 0.5).alias("certified"), "p_lower", "confidence", F.col("n").alias("n_samples_certify"), F.col("y").alias("true_label"), (F.col("predicted_class") == F.col("y")).cast("int").alias("correct"))


def certification_grid(items: DataFrame, scorer: Callable, groups: Mapping[str, str], kinds: list[str], counts: list[int], samples: int = 1000, alpha: float = 0.001) -> DataFrame:
    """Accuracy, certified accuracy, rate, mean bound and their gap for each setting, ordered by kind and number of changes."""
    c = certificates(votes(items, scorer, groups, kinds, counts, samples), alpha)
    sure = F.col("certified").cast("int")
    out = c.groupBy("kind", "n_changes").agg(F.avg("correct").alias("accuracy"), F.avg(F.col("correct") * sure).alias("certified_accuracy"), F.avg(sure).alias("certification_rate"), F.avg("p_lower").alias("mean_p_lower"), F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n"))
    return out.withColumn("gap", F.col("accuracy") - F.col("certified_accuracy")).orderBy("kind", "n_changes")
