"""Repeated passages by windows of words, sampled by minimisers.

Of a text's k-mers (by words) only minimisers are looked at first: k-mers with the least hash in some window of w. A passage of
k + w - 1 words or more that two texts share has a common minimiser, whatever stands around it, so only windows whose minimiser
occurs again can repeat. Of these the hash of the whole window, min_words long, is the key: every text that has a window meets
one other text with the same window, and each pair is extended over the texts themselves, right and left, as far as words agree.

Texts that are equal as wholes are one text from the start. Minimisers are dealt by range, so one that a third of all texts
share is spread over as many tasks as it fills; where the ranges are cut decides no match, since windows meet by equality alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.llm.common import WORD, WordHashes, as_bytes, mixed, saved, slices

MIN_WORDS = 50
K = 26  # so windows have MIN_WORDS - K + 1 k-mers
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SEEDS = "seed long, text_id long, pos int"
WINDOWS = "window long, text_id long, least long, pos int, first int"


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes (empty if there are fewer)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n, INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * inverse, dtype=np.uint64)))
    return mixed((sums[k:] - sums[:-k]) * powers[: n - k + 1])


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """Least or greatest of each run of w."""
    width = 1
    while 2 * width <= w:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def minimisers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of k-mers that are the least of some window of w; of the last ones' windows too. Fewer k-mers than w: one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    w = min(w, n)
    least = _sliding(hashes, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    reach = _sliding(np.concatenate((pad, least, pad)), w, np.maximum)
    return np.flatnonzero(reach == hashes)


def seeds(texts: DataFrame, k: int, w: int) -> DataFrame:
    """Minimisers of texts (text_id, text): k-mer hash and place."""

    def run(batches):
        hashes, seen = WordHashes(), set()  # a task takes each of its texts once, so few copies are sorted
        for batch in slices(batches):
            out = []
            for text_id, text in zip(batch.column("text_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if text_id in seen:
                    continue
                seen.add(text_id)
                h = hashes.of(text.split())
                if len(h) < k + w - 1:
                    continue
                runs = window_hashes(h, k)
                at = minimisers(runs, w)
                out.append((runs[at], np.full(len(at), text_id), at))
            if out:
                seed, ids, pos = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(ids), pa.array(pos.astype(np.int32))], names=["seed", "text_id", "pos"])

    return texts.select("text_id", "text").mapInArrow(run, SEEDS)


def repeated_seeds(sorted_seeds: DataFrame) -> DataFrame:
    """(text_id, pos) of all minimisers that occur again, and of a task's first and last, which may go on in another task."""

    def run(batches):
        held, kept = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "text_id", "pos")]
            cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.concatenate(([kept], same)) | np.concatenate((same, [False]))
            held, kept = [c[-1:] for c in cols], bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in cols[1:]], names=["text_id", "pos"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[1:]], names=["text_id", "pos"])

    return sorted_seeds.mapInArrow(run, "text_id long, pos int")


def windows(texts: DataFrame, k: int, w: int) -> DataFrame:
    """Windows of k + w - 1 words of texts (text_id, text, least, at) whose minimiser is at one of the places `at`.

    first is the window's first place in its text.
    """

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            out = []
            for row, (text, at) in enumerate(zip(as_bytes(batch.column("text")), batch.column("at").to_pylist(), strict=True)):
                h = hashes.of(text.split())
                runs = window_hashes(h, k)
                pos = np.flatnonzero(np.isin(_sliding(runs, w, np.minimum), runs[at]))
                window = window_hashes(h, k + w - 1)[pos]
                _, first, again = np.unique(window, return_index=True, return_inverse=True)
                out.append((window, np.full(len(pos), row), pos, pos[first[again]]))
            if out:
                window, row, pos, first = (np.concatenate(c) for c in zip(*out, strict=True))
                of = [batch.column(c).take(pa.array(row)) for c in ("text_id", "least")]
                yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), *of, pa.array(pos.astype(np.int32)), pa.array(first.astype(np.int32))], names=["window", "text_id", "least", "pos", "first"])

    return texts.mapInArrow(run, WINDOWS)


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs of texts with a common window (a, b, at) from windows; at: sorted, the shift from a to b in the upper half of a long, a place in a in the lower.

    A text's rank is the smallest id of a document that has it. Each window of a text meets the same window of the first text
    that has it; those of the first text meet the second's.
    """
    rank = F.struct(F.col("least").isNull().alias("unknown"), "least", "text_id", "first")
    # saved, so that the join deals windows itself and a very frequent one can be split over tasks
    ends = saved(met.groupBy("window").agg(F.min(rank).alias("lo"), F.min("text_id").alias("one"), F.max("text_id").alias("other")).where("one <> other").select("window", "lo"), "ends")
    linked = met.join(ends, "window")
    least = F.col("text_id") == F.col("lo.text_id")
    second = saved(linked.where(~least).groupBy("window").agg(F.min(rank).alias("next")), "seconds")
    long = lambda c: F.col(c).cast("long")
    sides = [F.col("lo.text_id").alias("a"), F.col("text_id").alias("b"), long("lo.first").alias("place"), long("pos").alias("there")]
    others = linked.where(~least).select(*sides)
    # the second text's first place is met already
    firsts = linked.where(least & (F.col("pos") != F.col("lo.first"))).join(second, "window").select("text_id", F.col("next.text_id").alias("b"), long("pos"), long("next.first"))
    tidy = others.unionAll(firsts).select("a", "b", (F.shiftleft(F.col("there") - F.col("place"), 32) + F.col("place")).alias("at"))
    return tidy.groupBy("a", "b").agg(F.sort_array(F.collect_list("at")).alias("at"))


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping ranges as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _extended(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(text_id, start, end, other): the words [start, end) of maximal matches of `least` words or more, for both texts.

    The first text of a common passage is the `a` of many pairs. Pairs reach a task with b's text and sorted by a, whose text
    is hashed once for all that follow each other; a hot a is split over tasks by AQE, as each of its pairs stands alone.
    """

    def matches(u: np.ndarray, v: np.ndarray, at: np.ndarray):
        """Ranges of u and of v; at comes sorted by shift, then place."""
        k = 0
        while k < len(at):
            shift, place = int(at[k]) >> 32, int(at[k]) & 0xFFFFFFFF
            lo, hi = max(0, -shift), min(len(u), len(v) - shift)
            right = u[place:hi] != v[place + shift : hi + shift]
            left = u[lo:place][::-1] != v[lo + shift : place + shift][::-1]
            e = place + (int(right.argmax()) if right.any() else len(right))
            s = place - (int(left.argmax()) if left.any() else len(left))
            k = max(k + 1, int(np.searchsorted(at, (shift << 32) + e)))  # places within this match are done
            if e - s >= least:
                yield (s, e), (s + shift, e + shift)

    def run(batches):
        hashes, last, u = WordHashes(), None, None
        for batch in slices(batches, 128):
            rows = []
            ends = batch.column("at").offsets.to_numpy()
            places = batch.column("at").values.to_numpy()
            for a, b, i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), ends, ends[1:], as_bytes(batch.column("ta")), as_bytes(batch.column("tb")), strict=False):
                if a != last:
                    last, u = a, hashes.of(x.split())
                found = [*matches(u, hashes.of(y.split()), places[i:j])]
                rows += [(a, s, e, b) for s, e in _merged([f[0] for f in found])] + [(b, s, e, a) for s, e in _merged([f[1] for f in found])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["text_id", "start", "end", "other"])

    side = lambda c, t: texts.select(F.col("text_id").alias(c), F.col("text").alias(t))
    return pairs.join(side("b", "tb"), "b").join(side("a", "ta").hint("merge"), "a").select("a", "b", "at", "ta", "tb").mapInArrow(run, "text_id long, start long, end long, other long")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_id: the parts of each document that another document has too.

    Words are parted at ASCII white space and compared as they are. Overlapping matches of a document are one part; other_id
    is the smallest id of another document that has a match of it. Documents whose texts are equal as wholes and have
    min_words or more are parts from end to end. Null, empty and shorter texts have no parts; no rows: no parts. Every row of
    docs is taken as a document, also where ids repeat or are null; other_id is null if no document that has the match has an
    id. Texts are told apart by 64 bits of hashes; columns beyond doc_id and text aren't looked at.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text_id = F.xxhash64(F.xxhash64("text"), F.hash("text"), F.length("text"))
    whole = docs.where("text is not null").select("doc_id", "text", text_id.alias("text_id"))
    rows = saved(whole.select("doc_id", "text_id", words.alias("words")), "rows")
    kinds = saved(rows.groupBy("text_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("words").alias("words")), "kinds")

    w = min_words - k + 1
    order = ["seed", "text_id"]
    seed = saved(seeds(whole, k, w), "seeds")
    again = repeated_seeds(seed.repartitionByRange(*order).sortWithinPartitions(*order)).groupBy("text_id").agg(F.collect_list("pos").alias("at"))
    texts = saved(whole.select("text_id", "text").join(again, "text_id").dropDuplicates(["text_id"]).join(kinds.select("text_id", "least"), "text_id"), "texts")
    pairs = saved(_pairs(saved(windows(texts, k, w), "windows")), "pairs")
    found = saved(_extended(pairs, texts, min_words), "matches")

    named = found.join(kinds.select(F.col("text_id").alias("other"), "least"), "other")
    # the first text of a very common passage has a row for each text that has it too
    named = named.groupBy("text_id", "start", "end").agg(F.min("least").alias("least"))
    w = Window.partitionBy("text_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = named.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    parts = parts.groupBy("text_id", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("least").alias("other_id"))

    alone = rows.join(parts.join(kinds.where("n = 1").select("text_id"), "text_id").select("text_id", "start_word", "end_word", "other_id"), "text_id")
    many = rows.join(kinds.where((F.col("n") > 1) & (F.col("words") >= min_words)).select("text_id", "least"), "text_id")
    second = many.where("doc_id > least").groupBy("text_id").agg(F.min("doc_id").alias("second"))
    beyond = parts.groupBy("text_id").agg(F.min("other_id").alias("beyond"))  # what other texts have of it
    copies = many.join(second, "text_id", "left").join(beyond, "text_id", "left")
    own = F.when(F.col("doc_id") == F.col("least"), F.coalesce("second", "least")).otherwise(F.col("least"))
    copies = copies.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("words").alias("end_word"), F.least(own, "beyond").alias("other_id"))
    out = alone.select("doc_id", "start_word", "end_word", "other_id").unionAll(copies)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_id of every passage of 50 words or more that another document has too.

    Null, empty and short texts have none; repeated rows are documents of their own; see repeated_passages().
    """
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
