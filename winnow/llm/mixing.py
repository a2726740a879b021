"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent from 0 (all alike) to 1 (as they come), normalised. The
exponent is found by bisection: the one that meets a target entropy, or the smallest that repeats no source's tokens more
than a limit beyond the least repeated one's. Weights become a stream of blocks with a token budget: each source gives its
documents in keyed permutations, one for each epoch, and as many tokens to each block as its weight says.

Sources of equal size have equal weights, so bisection needs only how many sources there are of each size; weights are then
worked out where the sources are. Positions in a permutation are running sums of tokens. They are taken in two steps, over
parts of a source and within a part, so a source that holds most of the corpus is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.common import free_name, saved
from winnow.llm.tokens import token_counts

STEPS = 60
STREAM = ["epoch", "block", "place"]


def tempered(shares: list[float], counts: list[int], exponent: float) -> list[float]:
    """Weight of one source of each size; there are counts of each."""
    raw = [s**exponent for s in shares]
    total = sum(x * n for x, n in zip(raw, counts, strict=True))
    return [x / total for x in raw]


def entropy(weights: list[float], counts: list[int]) -> float:
    return -sum(n * w * math.log(w) for w, n in zip(weights, counts, strict=True) if w > 0)


def find_exponent(shares: list[float], counts: list[int], target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """By bisection. Entropy falls and the spread of repetition falls as the exponent grows; a target out of reach gives 0 or 1."""

    def enough(exponent: float) -> bool:
        weights = tempered(shares, counts, exponent)
        if target_entropy is not None:
            return entropy(weights, counts) <= target_entropy
        repeats = [w / s for w, s in zip(weights, shares, strict=True)]
        return max(repeats) <= max_repeats * min(repeats)

    if enough(0.0) or not enough(1.0):
        return 0.0 if enough(0.0) else 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def weighted(sources: DataFrame, budget: int | None, target_entropy: float | None, max_repeats: float | None) -> DataFrame:
    """sources (source, source_tokens, n) with weight, repeats, parts. Without a budget every document comes once at least.

    The driver sees one row for each distinct size, of which n tokens have at most about sqrt(2 n).
    """
    sizes = sorted((t, n) for t, n in sources.groupBy("source_tokens").agg(F.count("*").alias("k")).collect())
    total = sum(t * n for t, n in sizes)
    shares, counts = [t / total for t, _ in sizes], [n for _, n in sizes]
    exponent = find_exponent(shares, counts, target_entropy, max_repeats) if sizes else 1.0
    weights = tempered(shares, counts, exponent)
    whole = sum(s**exponent * n for s, n in zip(shares, counts, strict=True))
    tokens = budget if budget is not None else max((t / w for (t, _), w in zip(sizes, weights, strict=True)), default=0)
    out = sources.withColumn("weight", F.pow(F.col("source_tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(float(whole)))
    repeats = F.col("weight") * F.lit(float(tokens)) / F.col("source_tokens")
    # one part holds about as many rows as there are parts
    return out.withColumn("repeats", F.greatest(F.lit(1.0), repeats) if budget is None else repeats).withColumn("parts", F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("int"))


def assign(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = 2.0, block_tokens: int = 1 << 20, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, text_key, n_tokens, weight, epoch, block, place, copies: one row for each time that a document is in the stream.

    n_tokens is the text's token ids and an end id, so at least 1. place orders a block. A partial epoch takes documents in
    permuted order while its budget lasts. A null source is a source of its own; null ids and texts are mixed like others;
    copies is the number of rows that repeat id, source and text, which share a place. No rows: no stream.
    """
    counted = token_counts(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), "text"), ["doc_id", "source", "text_key"], tokenizer)
    slim = saved(counted.groupBy("doc_id", "source", "text_key", "n_tokens").agg(F.count("*").alias("copies")), "mix-rows")
    held = F.col("n_tokens") * F.col("copies")
    sources = saved(slim.groupBy("source").agg(F.sum(held).alias("source_tokens"), F.count("*").alias("n")), "mix-sources")
    weights = weighted(sources, budget, target_entropy, max_repeats).withColumnRenamed("source", "of").drop("n")
    rows = slim.join(weights, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("repeats") - 1, F.lit(0)).cast("int"))))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_key")).withColumn("part", F.pmod(F.shiftright("place", 20), F.col("parts")))
    key = ["source", "epoch", "part"]
    sums = rows.groupBy(*key).agg(F.sum(held).alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("source", "epoch").orderBy("part")) - F.col("in_part")
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in key], before.alias("before"))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("part") == F.col("_part"))
    inside = F.sum(held).over(Window.partitionBy(*key).orderBy("place", "doc_id", "text_key", "n_tokens")) - held
    placed = rows.withColumn("inside", inside).join(sums, on).withColumn("start", F.col("before") + F.col("inside"))
    kept = placed.where(F.col("start") < (F.col("repeats") - F.col("epoch")) * F.col("source_tokens"))
    along = F.col("epoch") * F.col("source_tokens") + F.col("start")
    block = F.floor(along / (F.col("weight") * block_tokens)).cast("long")
    return kept.select("doc_id", "source", "text_key", "n_tokens", "weight", "epoch", block.alias("block"), "place", "copies")


def _streamed(docs: DataFrame, **options) -> tuple[DataFrame, list[str]]:
    """docs as the stream has them, with epoch, block, place under names that docs doesn't use, and these names."""
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    names = {c: free_name(keyed, f"mix_{c}") for c in ("doc_id", "source", "text_key", *STREAM)}
    assigned = assign(docs, **options).select(*[F.col(c).alias(n) for c, n in names.items()])
    on = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"])) & (F.col(key) == F.col(names["text_key"]))
    return keyed.join(assigned, on), [names[c] for c in STREAM]


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs in the stream: their own columns, repeated as the weights ask, and epoch, block, place (own columns of these names go).

    Nulls, empty texts and repeated rows as in assign(): each row is in the stream by itself.
    """
    out, names = _streamed(docs, **options)
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in STREAM]
    return out.select(*own, *[F.col(n).alias(c) for n, c in zip(names, STREAM, strict=True)])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block, place of each time that a document is in the stream.

    Nulls in any column, empty and long texts and repeated rows are in it like others, each row by itself; see assign().
    """
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "place")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document at least once, small sources' up to twice, with the documents' own columns.

    The rows come in the stream's order, by block and by place in it: each partition, and so each file that is written, has the
    next stretch. Nulls in any column, empty texts and repeated rows stay, each row as often as its source asks; no rows give
    no rows.
    """
    out, (_, block, place) = _streamed(docs)
    return out.repartitionByRange(block, place).sortWithinPartitions(block, place).select(*[F.col(f"`{c}`") for c in docs.columns])
