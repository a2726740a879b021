"""Document fingerprints from closed syncmers of words, in SQL expressions alone.

A k-mer of eight words is kept if the least hash of its inner two-word substrings is its first or its last. Whether it is kept
depends on its own words only, so a passage has the same anchors in every text around it, and they can be matched by position.
Of any six consecutive k-mers at least one is kept. A fingerprint is all anchors in order, seven characters each: the step
from the anchor before (the first one's place) and six hex digits of its hash. An anchor and the next one match where both
stand at the same distance in another text; likeness is the Dice share of these, of all anchors of both texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.common import WORD

K = 8
GRAMS = K - 1  # two-word substrings of a k-mer


def _anchors(words: str, grams: str) -> Column:
    """Structs (pos, hash) of a text's anchors: pos is the k-mer's first word, hash six hex digits.

    A text of fewer words than K has its single words as anchors; one whose few k-mers are none of them closed, all k-mers.
    """
    inner = ", ".join(f"{grams}[i + {j}]" for j in range(1, GRAMS - 1))
    covering = ", ".join(f"{grams}[i + {j}]" for j in range(0, GRAMS, 2))
    mer = f"named_struct('pos', i, 'hash', left(md5(cast(concat({covering}) as binary)), 6))"
    places = f"sequence(0, size({grams}) - {GRAMS})"
    closed = f"least({grams}[i], {grams}[i + {GRAMS - 1}]) <= least({inner})"
    single = f"transform({words}, (w, i) -> named_struct('pos', i, 'hash', left(md5(cast(w as binary)), 6)))"
    found = f"transform(filter({places}, i -> {closed}), i -> {mer})"
    few = f"size({grams}) < {2 * GRAMS - 2} and not exists({places}, i -> {closed})"
    return F.expr(f"case when size({words}) < {K} then {single} when {few} then transform({places}, i -> {mer}) else {found} end")


def with_anchors(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the column `out` of its text's anchors."""
    words, grams = f"_{out}_words", f"_{out}_grams"
    docs = docs.withColumn(words, F.expr(f"regexp_extract_all(coalesce({text}, ''), r'{WORD}', 0)"))
    pairs = f"transform(sequence(0, size({words}) - 2), i -> left(md5(cast(concat({words}[i], ' ', {words}[i + 1]) as binary)), 8))"
    docs = docs.withColumn(grams, F.expr(f"if(size({words}) < {K}, cast(array() as array<string>), {pairs})"))
    return docs.withColumn(out, _anchors(words, grams)).drop(words, grams)


def _steps(anchors: str) -> str:
    return f"transform({anchors}, (x, i) -> concat(x.pos - coalesce(get({anchors}, i - 1).pos, 0), x.hash))"


def as_string(anchors: str) -> Column:
    return F.expr(f"array_join({_steps(anchors)}, '')")


def matchable(anchors: str) -> Column:
    """What positional matching compares: each anchor's hash, the step to the next and its hash; a lone anchor's hash."""
    pairs = f"transform(sequence(0, size({anchors}) - 2), i -> concat({anchors}[i].hash, {anchors}[i + 1].pos - {anchors}[i].pos, {anchors}[i + 1].hash))"
    return F.array_distinct(F.expr(f"if(size({anchors}) < 2, {anchors}.hash, {pairs})"))


def likeness(a: str, b: str) -> Column:
    """Dice share of what both have, from 0 to 1. Two texts without anchors are alike."""
    both = f"2 * size(array_intersect({a}, {b})) / (size({a}) + size({b}))"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, {both})").cast("double")


def anchor_positions(docs: DataFrame) -> DataFrame:
    """doc_id, pos (the place of the anchor's first word), hash: one row for each anchor, for positional matching by join."""
    return with_anchors(docs.select("doc_id", "text"), "text", "anchors").select("doc_id", F.inline("anchors"))


def _with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, anchors) with next_text and next_anchors of the document with the next smaller id; after the last comes the first.

    Ids are dealt into ranges by approximate quantiles; each range is one window, and gets a copy of the row that follows it.
    Rows of one id are ordered by their texts' hashes; null ids come last.
    """
    spark = docs.sparkSession
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or [0]
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    # the number of cuts below the id, found in two short looks
    fine, coarse = (F.array(*[F.lit(int(c)).cast("bigint") for c in x]) for x in (cuts, cuts[step - 1 :: step] or cuts[-1:]))
    looked = F.size(F.filter(coarse, lambda c: c < F.col("doc_id")))
    place = looked * step + F.size(F.filter(F.slice(fine, looked * step + 1, F.lit(step)), lambda c: c < F.col("doc_id")))
    # null ids come last, dealt by the upper bits of their texts' hashes
    unknown = F.shiftright(F.xxhash64("text"), 56).cast("int") - 129
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), unknown).otherwise(place).cast("int").alias("range"), F.xxhash64("text").alias("text_key"))
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_key")
    heads = rows.groupBy("range").agg(F.max(first).alias("head"))  # at most a row for each range
    order = Window.orderBy(F.desc("range"))
    heads = heads.select(F.lag("range").over(order).alias("before"), F.min("range").over(Window.partitionBy(F.lit(1))).alias("last"), "head.doc_id", "head.text_key")
    heads = heads.select(F.coalesce("before", "last").alias("into"), F.col("doc_id").alias("head_id"), F.col("text_key").alias("head_key"))
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_key") == F.col("head_key"))
    copies = rows.join(F.broadcast(heads), same).groupBy("into").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("text_key").alias("text_key"))
    every = rows.select("range", "doc_id", "text", "text_key", F.lit(0).alias("copy")).unionAll(copies.select("into", "doc_id", "text", "text_key", F.lit(1)))
    every = with_anchors(every.repartition("range"), "text", "anchors")
    w = Window.partitionBy("range").orderBy("copy", F.desc("doc_id"), F.desc("text_key"))
    return every.select("doc_id", "text", "anchors", "copy", F.lead("text").over(w).alias("next_text"), F.lead("anchors").over(w).alias("next_anchors")).where("copy = 0").drop("copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document's, by
    descending id. A null text counts as empty and has an empty fingerprint. Rows of one id follow each other by their texts'
    hashes, null ids come last. One row alone follows itself; no rows give none; other columns aren't looked at.
    """
    pairs = _with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.substring("next_text", F.lit(1), half)))
    pairs = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "anchors", "next_anchors", "edited")
    pairs = with_anchors(pairs, "edited", "edited_anchors").drop("edited")
    pairs = pairs.withColumns({f"of_{c}": matchable(c) for c in ("anchors", "next_anchors", "edited_anchors")})
    near = [likeness("of_anchors", "of_edited_anchors").alias("near_edited"), likeness("of_anchors", "of_next_anchors").alias("near_next")]
    return pairs.select("doc_id", "n_chars", "edited_sha256", as_string("anchors").alias("fingerprint"), as_string("edited_anchors").alias("edited_fingerprint"), *near)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    A null text counts as empty; null ids come last, repeated rows follow each other; see fingerprints().
    """
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
