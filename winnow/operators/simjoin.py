"""Similarity joins: set Jaccard by an inverted index, vectors by blocks.

The best reference of each set is found with the references' inverted index, which every task holds if it is within a bound; beyond it
block by block, in rounds of falling similarity. Where all pairs are the result, sets meet block by block too, by the items that they share.
Vectors: a reference side within a checked size is sent to all tasks; beyond it references are parted into lists around
centres, and a query meets only the lists that the triangle inequality doesn't exclude, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.operators.prefix import joined
from winnow.session import saved


#: Items of the reference side that all tasks hold, and components of vectors, a few tens of MB each.
POSTINGS, COMPONENTS = 2_000_000, 8_000_000
#: Similarities that more and more of the queries are asked for, the high ones first.
ROUNDS = (0.9, 0.6, 0.3, 0.1)
#: Beyond POSTINGS: items and sets of a block of references, the items of a block that go by a matrix and its numbers, and pairs counted, items
#: asked for and places of items in the block's sets that are taken at a time.
BLOCK_ITEMS, BLOCK_SETS, HOT_ITEMS, HOT_CELLS, MET_PAIRS = 8_000_000, 32_768, 2048, 8_000_000, 1_000_000


def _sets(column: pa.Array, k: int | None):
    """The set of each row: of its items, or (given k) of its text's substrings of k code points."""
    for x in column.to_pylist():
        yield set(x or ()) if k is None else {x[i : i + k] for i in range(len(x or "") - k + 1)}


def _substrings(text: str, k: int) -> np.ndarray:
    """Numbers for a text's distinct substrings of k code points, sorted: the code points side by side where they fit in 63 bits, else a hash below 0."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, bits = max(0, len(c) - k + 1), np.uint64(63 // k)
    packed, hashed, wide = np.zeros(n, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64), np.zeros(n, bool)
    for j in range(k):
        x = c[j : j + n]
        packed = (packed << bits) | x
        hashed = (hashed ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(29)
        wide |= (x >> bits) > 0
    return np.unique(np.where(wide, hashed | np.uint64(1 << 63), packed).view(np.int64))


def _hashed(items: Column, seed: int) -> Column:
    return F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.xxhash64(F.lit(seed), x))


def _ambiguous(items: DataFrame, seed: int) -> bool:
    """Whether two different ones of all items have the same hash; another hash of 64 bits tells them apart."""
    each = items.select(F.explode("items").alias("item")).where("item is not null").groupBy(F.xxhash64(F.lit(seed), "item").alias("code"))
    other = F.xxhash64(F.lit("other"), F.lit(seed), F.col("item"))
    return not each.agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").isEmpty()


def _coded(df: DataFrame, k: int | None, seed: int) -> DataFrame:
    """(row, own, n, s) of (row, own, items): a number for each distinct item, sorted, and how many there are."""
    if k is None:
        sets = df.select("row", "own", F.array_sort(F.array_distinct(_hashed(F.coalesce("items", F.array().cast(df.schema["items"].dataType)), seed))).alias("s"))
        return sets.select("row", "own", F.size("s").alias("n"), "s")

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(at, 500)
                each = [_substrings(x, k) for x in batch.column("items").to_pylist()]
                sizes = np.array([len(x) for x in each], np.int32)
                s = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("own"), pa.array(sizes), s], names=["row", "own", "n", "s"])

    return df.select("row", "own", "items").mapInArrow(run, f"row long, own {df.schema['own'].dataType.simpleString()}, n int, s array<bigint>")


def _bands(sets: DataFrame) -> DataFrame:
    """(lo, hi, first, pieces): ranges of sizes n of the sets, dealt into blocks `first` and on, of about BLOCK_ITEMS items and BLOCK_SETS sets.

    The driver sees one row for each size; sizes that differ are fewer than the square root of twice all items.
    """
    out, first = [], 0
    for r in sets.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect():
        if out and out[-1][2] + r.n * r.c <= BLOCK_ITEMS and out[-1][3] + r.c <= BLOCK_SETS:
            out[-1] = (out[-1][0], r.n, out[-1][2] + r.n * r.c, out[-1][3] + r.c)
        else:
            out.append((r.n, r.n, r.n * r.c, r.c))
    rows = []
    for lo, hi, items, count in out:
        pieces = max(-(-items // BLOCK_ITEMS), -(-count // BLOCK_SETS))
        rows.append((lo, hi, first, pieces))
        first += pieces
    return sets.sparkSession.createDataFrame(rows, "lo int, hi int, first int, pieces int")


class _Block:
    """An inverted index of some sets. Items that many of them have are columns of a matrix, the others lists."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.n_sets, self.sizes = len(sizes), sizes.astype(float)
        order = np.argsort(flat, kind="stable")
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.items, starts = np.unique(flat[order], return_index=True)
        counts = np.diff(np.append(starts, len(flat)))
        most = max(0, min(HOT_ITEMS, HOT_CELLS // max(1, self.n_sets), len(counts)))
        hot = np.argpartition(-counts, most - 1)[:most] if most else np.zeros(0, np.int64)
        hot = hot[counts[hot] > max(1, self.n_sets // 256)]
        self.column = np.full(len(counts), -1, np.int32)
        self.column[hot] = np.arange(len(hot), dtype=np.int32)
        self.matrix = np.zeros((len(hot), self.n_sets), np.float32)
        for i, x in enumerate(hot):
            self.matrix[i, of[starts[x] : starts[x] + counts[x]]] = 1
        self.of, self.starts, self.counts = of, starts, counts
        self.at_once = max(1, min(256, MET_PAIRS // max(1, self.n_sets)))

    def turns(self, sizes: np.ndarray):
        """(start, end) of sets that are asked for together: at most at_once, with about MET_PAIRS items or one set."""
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + MET_PAIRS, "right")))
            yield at, min(at + self.at_once, end)
            at = min(at + self.at_once, end)

    def common(self, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """How many items each of some sets has in common with each of the block's.

        Sets of many items find them in many more places than there are pairs of sets, so MET_PAIRS places are taken at a time.
        """
        row, n = np.repeat(np.arange(len(sizes)), sizes), self.n_sets
        at = np.minimum(np.searchsorted(self.items, flat), len(self.items) - 1)
        known = self.items[at] == flat
        row, at = row[known], at[known]
        column = self.column[at]
        wide = np.zeros((len(sizes), len(self.matrix)), np.float32)
        wide[row[column >= 0], column[column >= 0]] = 1
        out = (wide @ self.matrix).astype(float)
        row, at = row[column < 0], at[column < 0]
        ends = np.cumsum(self.counts[at])
        edges = np.searchsorted(ends, np.arange(MET_PAIRS, ends[-1], MET_PAIRS)) if len(ends) else []
        for a, b in zip([0, *edges], [*edges, len(at)], strict=True):
            if b > a:
                c, top = self.counts[at[a:b]], row[a]
                places = np.repeat(self.starts[at[a:b]] - np.cumsum(c) + c, c) + np.arange(c.sum())
                met = np.repeat((row[a:b] - top) * n, c) + self.of[places]
                out[top : row[b - 1] + 1] += np.bincount(met, minlength=(row[b - 1] + 1 - top) * n).reshape(-1, n)
        return out


def _met(queries: DataFrame, references: DataFrame, bands: DataFrame, visits: Column, what: str, schema: str) -> DataFrame:
    """What queries (ref, n, s, own, best) and references (ref, n, s, own, single) give where they meet, block by block.

    best: (row, sim), the greatest similarity of each query in a block, without the reference that is single and has its own id; pairs:
    (a, b, sim) of own ids for all with a common item, each pair one way. visits: of n, best and a band's lo and hi. A block is sent to a
    few tasks that share its queries; it comes first, sorted, and its queries stream by, so a task holds one block.
    """
    spark = references.sparkSession
    visited = queries.join(F.broadcast(bands), visits)
    firsts = [r["first"] for r in visited.select("first").distinct().collect()]
    if not firsts:
        return spark.createDataFrame([], schema)
    bands = bands.where(F.col("first").isin(firsts))
    blocks = bands.agg(F.max(F.col("first") + F.col("pieces"))).first()[0]
    parts = max(1, -(-2 * spark.sparkContext.defaultParallelism // len(firsts)))
    near = visited.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pieces") - 1)).alias("block"))
    asks = near.select((F.col("block") * parts + F.pmod(F.xxhash64("ref"), F.lit(parts))).cast("int").alias("group"), F.lit(True).alias("asks"), "ref", "n", "s", "own", F.lit(False).alias("single"), "best")
    held = references.join(F.broadcast(bands), (F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi"))).withColumn("block", F.col("first") + F.pmod(F.xxhash64("ref"), F.col("pieces")).cast("int"))
    held = held.select(F.explode(F.sequence(F.col("block") * parts, F.col("block") * parts + parts - 1)).alias("group"), F.lit(False).alias("asks"), "ref", "n", "s", "own", "single", F.lit(0.0).alias("best"))
    both = held.unionByName(asks).repartition(max(1, blocks * parts), "group").sortWithinPartitions("group", "asks")

    def runs(batches):
        """Parts of batches with one group and one side."""
        for batch in batches:
            group, asks = batch.column("group").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(group) != 0) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    yield group[a], asks[a], batch.slice(a, b - a)

    def run(batches):
        group, held, block, own, place, refs = None, [], None, None, {}, None
        for g, asking, part in runs(batches):
            if g != group:
                group, held, block = g, [], None
            if not asking:
                held.append(part)
                continue
            if not held and block is None:
                continue
            if block is None:
                flat = np.concatenate([x.column("s").flatten().to_numpy() for x in held])
                block = _Block(np.concatenate([x.column("n").to_numpy() for x in held]), flat)
                refs = np.concatenate([x.column("ref").to_numpy() for x in held])
                own = pa.concat_arrays([x.column("own") for x in held])
                single = np.concatenate([x.column("single").to_numpy(zero_copy_only=False) for x in held])
                place = {}
                if single.any():
                    for i in np.flatnonzero(single):
                        place.setdefault(own[int(i)].as_py(), []).append(i)
                held = []
            for at, end in block.turns(part.column("n").to_numpy()):
                some = part.slice(at, end - at)
                sizes = some.column("n").to_numpy()
                common = block.common(sizes, some.column("s").flatten().to_numpy())
                if what == "pairs":
                    i, j = np.nonzero((common > 0) & (some.column("ref").to_numpy()[:, None] < refs[None, :]))
                    c = common[i, j]
                    yield pa.RecordBatch.from_arrays([some.column("own").take(pa.array(i)), own.take(pa.array(j)), pa.array(c / (sizes[i] + block.sizes[j] - c))], names=["a", "b", "sim"])
                    continue
                for i, x in enumerate(some.column("own").to_pylist() if place else ()):
                    if x in place:
                        common[i, place[x]] = 0
                best = (common / (sizes[:, None] + block.sizes[None, :] - common)).max(axis=1)
                yield pa.RecordBatch.from_arrays([some.column("ref"), pa.array(best)], names=["row", "sim"])

    return both.mapInArrow(run, schema)


class SetIndex:
    """References whose best match is asked for; made once, asked as often as wanted, by streams too.

    references (id, items): items is an array, or with k a text that stands for its substrings of k code points. Up to POSTINGS
    items, which is counted, are sent to all tasks as an inverted index: no query is shuffled. More stay in tables, and
    queries meet them block by block; the driver holds the blocks' sizes. Both ways give the same, but for one thing: beyond the
    bound substrings with a code point of 2 ** (63 // k) or more (4,096 for k of 5) are told apart by 63 bits of a hash.
    """

    def __init__(self, references: DataFrame, k: int | None = None):
        self.k, self.spark = k, references.sparkSession
        size = F.size("items") if k is None else F.length("items")
        # written first: a filter by size would go below the joins that references come from, and cut sets of rows that these drop
        self.rows = saved(references.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("own"), "items"), "set-rows")
        self.references = self.rows.where(size > 0)
        self.held = (self.references.agg(F.sum(size)).first()[0] or 0) <= POSTINGS
        if self.held:
            self._broadcast()
        else:
            self.seed = 0
            self._tables()

    def _broadcast(self) -> None:
        index: dict[str, list[int]] = {}
        sizes, ids = [], []
        for row in self.references.toLocalIterator():  # within the counted bound
            (own,) = _sets(pa.array([row["items"]]), self.k)
            for item in own:
                index.setdefault(item, []).append(len(ids))
            sizes.append(len(own))
            ids.append(row["own"])
        # the references of item i stand from ends[i] to ends[i + 1]
        ends = np.cumsum([0, *map(len, index.values())])
        flat = np.fromiter((x for v in index.values() for x in v), np.int32, int(ends[-1]))
        place: dict = {}
        for i, x in enumerate(ids):
            place.setdefault(x, []).append(i)
        self.sent = self.spark.sparkContext.broadcast(({x: i for i, x in enumerate(index)}, ends, flat, np.array(sizes, float), place))

    def _tables(self) -> None:
        # equal sets are one, with the least and the greatest of their ids
        sets = _coded(self.references, self.k, self.seed).where("n > 0").groupBy("n", "s").agg(F.min("own").alias("low"), F.max("own").alias("high"))
        self.sets = saved(sets.withColumn("ref", F.monotonically_increasing_id()), "set-references")
        self.bands = _bands(self.sets)

    def best(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        """(id, max_sim) for every row of queries (id, items); 0 where nothing is shared. exclude_self: not with references of its id."""
        return self._best_held(queries, exclude_self) if self.held else self._best_blocked(queries, exclude_self)

    def _best_held(self, queries: DataFrame, exclude_self: bool) -> DataFrame:
        sent, k = self.sent, self.k

        def run(batches):
            number, ends, flat, n_refs, place = sent.value
            for batch in batches:
                out = []
                for own, items in zip(batch.column("id").to_pylist(), _sets(batch.column("items"), k), strict=True):
                    met = np.fromiter((number[x] for x in items if x in number), np.int64)
                    if not len(met):
                        out.append(0.0)
                        continue
                    n = ends[met + 1] - ends[met]
                    at = np.repeat(ends[met] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    common = np.bincount(flat[at], minlength=len(n_refs))
                    if exclude_self and own in place:
                        common[place[own]] = 0
                    out.append(float((common / (len(items) + n_refs - common)).max()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], names=["id", "max_sim"])

        kind = queries.schema["id"].dataType.simpleString()
        return queries.select("id", "items").mapInArrow(run, f"id {kind}, max_sim double")

    def _best_blocked(self, queries: DataFrame, exclude_self: bool) -> DataFrame:
        """Block by block of references of like sizes, in rounds of falling similarity t, with the best so far of each query.

        Sets of n and m items are at most min(n, m) / max(n, m) similar, so in the round of t a query visits the blocks whose sizes
        allow t or more and that it hasn't visited. One whose best is t or more is done.
        """
        other = ~(F.col("low").eqNullSafe(F.col("own")) & F.col("high").eqNullSafe(F.col("own"))) if exclude_self else F.lit(True)
        asked = saved(queries.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("own"), "items"), "set-queries")
        if self.k is None:
            items = self.references.select("items").unionAll(asked.select("items"))
            while _ambiguous(items, self.seed):  # items of equal hashes: another hash for all
                self.seed += 1
                self._tables()
        rows = saved(_coded(asked, self.k, self.seed).where("n > 0"), "set-asked")
        # queries with equal sets ask once, and what equals a reference is done
        by = ["n", "s", "own"] if exclude_self else ["n", "s"]
        groups = saved(rows.groupBy(*by).agg(F.count("*").alias("copies")).withColumn("g", F.monotonically_increasing_id()), "set-groups")
        same = self.sets.select(F.col("n").alias("rn"), F.col("s").alias("rs"), "low", "high")
        equal = groups.join(same, (F.col("n") == F.col("rn")) & (F.col("s") == F.col("rs"))).where(other).select("g", F.lit(1.0).alias("best"))
        own = F.col("own") if exclude_self else F.lit(None)
        left = groups.select("g", "n", "s", own.alias("own")).join(equal, "g", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
        left = saved(left, "set-left")
        done, left, before = left.where("best = 1").select("g", "best"), left.where("best < 1"), None
        refs = self.sets.select("ref", "n", "s", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).alias("own"), (F.lit(exclude_self) & F.col("low").eqNullSafe(F.col("high"))).alias("single"))
        within = lambda t: (F.col("hi") >= t * F.col("n") - 1e-9) & (t * F.col("lo") <= F.col("n") + 1e-9)
        for t in (*ROUNDS, 0.0):
            visits = within(F.greatest(F.lit(t), F.col("best"))) & (~within(F.lit(before)) if before is not None else F.lit(True))
            found = _met(left.select(F.col("g").alias("ref"), "n", "s", "own", "best"), refs, self.bands, visits, "best", "row long, sim double")
            found = found.groupBy(F.col("row").alias("g")).agg(F.max("sim").alias("sim"))
            after = left.join(found, "g", "left").withColumn("best", F.greatest("best", F.coalesce("sim", F.lit(0.0)))).drop("sim")
            after, before = saved(after, "set-left"), t
            done, left = done.unionAll(after.where(F.col("best") >= t).select("g", "best")), after.where(F.col("best") < t)
            if left.isEmpty():
                break
        told = joined(rows.select("row", *by), groups.select("g", *by), by).join(done, "g").select("row", "best")
        return asked.select("row", F.col("own").alias("id")).join(told, "row", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("max_sim"))


def max_jaccard(queries: DataFrame, references: DataFrame, query_key: str, reference_key: str, query_items: Column | str, reference_items: Column | str, exclude_self: bool = False) -> DataFrame:
    """(id, max_sim) for every query; 0 where nothing is shared (J2). A null or empty set shares nothing, nor does a null item."""

    def sets(df: DataFrame, key: str, items: Column | str) -> DataFrame:
        c = F.col(items) if isinstance(items, str) else items
        return df.select(F.col(key).alias("id"), F.filter(c, lambda x: x.isNotNull()).alias("items"))

    return SetIndex(sets(references, reference_key, reference_items)).best(sets(queries, query_key, query_items), exclude_self)


def max_kmer_jaccard(queries: DataFrame, references: DataFrame, query_key: str, reference_key: str, text: str = "text", k: int = CONFIG.k, exclude_self: bool = False) -> DataFrame:
    """The same over the texts' distinct substrings of k code points, which tasks cut themselves, so texts and not sets are sent to them."""
    slim = lambda df, key: df.select(F.col(key).alias("id"), F.col(text).alias("items"))
    return SetIndex(slim(references, reference_key), k).best(slim(queries, query_key), exclude_self)


def pairwise_jaccard(df: DataFrame, key: str, items: Column | str) -> DataFrame:
    """(id_a, id_b, sim) with id_a < id_b, of pairs that share an item (J3). Keys are unique.

    Rows meet block by block, so a task holds one block, whatever the items; the result holds each such pair, so hot items make it large.
    """
    c = F.col(items) if isinstance(items, str) else items
    rows = saved(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("own"), c.alias("items")), "pair-rows")
    seed = 0
    while _ambiguous(rows.select("items"), seed):
        seed += 1
    sets = saved(_coded(rows, None, seed).where("n > 0").withColumnRenamed("row", "ref"), "pair-sets")
    kind = df.schema[key].dataType.simpleString()
    met = _met(sets.withColumn("best", F.lit(0.0)), sets.withColumn("single", F.lit(False)), _bands(sets), F.lit(True), "pairs", f"a {kind}, b {kind}, sim double")
    return met.where("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "sim")


def peer_max(df: DataFrame, key: str, items: Column | str) -> DataFrame:
    """(id, max_sim) to any other row, 0 if none shares an item (J4). Keys are unique."""
    c = F.col(items) if isinstance(items, str) else items
    index = SetIndex(df.select(F.col(key).alias("id"), F.filter(c, lambda x: x.isNotNull()).alias("items")))
    return index.best(index.rows.select(F.col("own").alias("id"), "items"), exclude_self=True)


#: Lists that references are parted into at most, those that a query visits first, what angles may be off by, and rows and references that a task compares at a time.
LISTS, FIRST_LISTS, SLACK, PIECE, WIDE = 2048, 4, 1e-6, 512, 2048
#: Numbers of vectors that a task gives out in one frame.
GIVEN = 4_000_000


def _unit(x) -> np.ndarray:
    m = np.array([*x], dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _closest(rows: np.ndarray, ids: np.ndarray, left: np.ndarray, refs: np.ndarray, right: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """(row, id, ref, cosine): the k best of unit rows `right`, ordered by ref, for each unit row of `left`.

    PIECE rows meet WIDE references at a time and keep their k best so far, so the memory depends on neither number.
    """
    out = []
    for a in range(0, len(left), PIECE):
        some, own = left[a : a + PIECE], ids[a : a + PIECE]
        i, j, c, edge = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(some), -np.inf)
        full = np.zeros(len(some), bool)
        for b in range(0, len(right), WIDE):
            sims = some @ right[b : b + WIDE].T
            if exclude_self:
                sims[own[:, None] == refs[None, b : b + WIDE]] = -np.inf
            if sims.shape[1] > k and np.isneginf(edge).any():
                edge = np.maximum(edge, np.partition(sims, -k, axis=1)[:, -k])
            # all that may be among the k best, and some more within what rounding takes away
            row, at = np.nonzero((sims >= edge[:, None] - 1e-11) & (sims > -np.inf))
            # a later reference that ties with a k-th best is no better
            more = ~full[row] | (np.round(sims[row, at], 12) > np.round(edge[row], 12))
            row, at = row[more], at[more]
            i, j, c = np.concatenate((i, row)), np.concatenate((j, at + b)), np.concatenate((c, sims[row, at]))
            order = np.lexsort((j, -np.round(c, 12), i))
            i, j, c = i[order], j[order], c[order]
            starts = np.searchsorted(i, np.arange(len(some)))
            kept = np.arange(len(i)) - starts[i] < k
            i, j, c = i[kept], j[kept], c[kept]
            full = np.bincount(i, minlength=len(some)) == k
            edge[full] = c[np.cumsum(np.bincount(i, minlength=len(some)))[full] - 1]
        out.append(pd.DataFrame({"row": rows[a : a + PIECE][i], "id": own[i], "ref": refs[j], "cosine": c}))
    return pd.concat(out, ignore_index=True)


def whole(df: DataFrame) -> DataFrame:
    """(id, embedding) of the rows that can be compared."""
    return df.where("id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x))").select("id", "embedding")


def nearest(queries: DataFrame, references: DataFrame, k: int, exclude_self: bool = False, rows: int = CONFIG.block_rows) -> DataFrame:
    """(id, ref, cosine, rank): the k references (id, embedding) with the greatest cosine; ties by the smaller ref.

    Each row of the queries has ranks of its own, rows that repeat an id too; exclude_self leaves out references of its id. Zero
    vectors have cosine 0 with everything; rows without an id, without an embedding or with a null or NaN in it meet nothing.
    References of up to COMPONENTS numbers, which is counted first, go to all tasks, and nothing is shuffled. More are parted
    into lists, of which a query visits only those that can hold one of its k best; see _by_lists(). Both ways give the same.
    """
    q, r = whole(queries), whole(references)
    numbers = r.agg(F.sum(F.size("embedding"))).first()[0] or 0
    kind = queries.schema["id"].dataType.simpleString()
    if numbers > COMPONENTS:
        return _by_lists(q, r, k, exclude_self, rows)
    held = r.orderBy("id").toPandas()  # within the checked size
    sent = queries.sparkSession.sparkContext.broadcast((held["id"].to_numpy(), _unit(held["embedding"]) if len(held) else None))

    def compare(batches):
        refs, right = sent.value
        for pdf in batches:
            for at in range(0, len(pdf) if len(refs) else 0, PIECE):
                some = pdf.iloc[at : at + PIECE]
                found = _closest(np.arange(len(some)), some["id"].to_numpy(), _unit(some["embedding"]), refs, right, k, exclude_self)
                yield found.assign(rank=(found.groupby("row", sort=False).cumcount() + 1).astype("int32")).drop(columns="row")

    return q.mapInPandas(compare, f"id {kind}, ref {kind}, cosine double, rank int")


def _by_lists(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, rows: int) -> DataFrame:
    """nearest() for references of any size, exactly, by lists around drawn references and the triangle inequality of angles.

    Each reference is in the list of the centre at the least angle; a list knows its widest angle. A query at an angle a to a
    centre has at least a minus that width to all of its list. It visits its nearest lists first, then, with its k-th best so
    far, the lists that may still hold a better one. A list is compared in blocks of about 4 * `rows` references with as many
    visitors, so no task holds more, and _closest() takes them piece by piece; centres and widths, bounded in number, are all that the driver sees.
    """
    spark, kind, rows = q.sparkSession, q.schema["id"].dataType.simpleString(), 4 * rows
    refs = saved(r.withColumn("zero", ~F.exists("embedding", lambda x: x != 0)), "near-references")
    asked = saved(q.select(F.monotonically_increasing_id().alias("row"), "id", "embedding", (~F.exists("embedding", lambda x: x != 0)).alias("zero")), "near-queries")
    n_refs, width = refs.agg(F.count("*"), F.max(F.size("embedding"))).first()
    # a visit carries the query's vector, so there are no more lists than blocks, but for the 64 that any references have
    most = max(1, min(LISTS, math.isqrt(n_refs), COMPONENTS // width, max(64, n_refs // rows)))
    drawn = refs.where("not zero").orderBy(F.xxhash64("id", "embedding")).limit(most).select("embedding").collect()
    centres = _unit([x.embedding for x in drawn]) if drawn else np.zeros((1, width))
    held = spark.sparkContext.broadcast(centres)

    def angles(x) -> np.ndarray:
        return np.arccos(np.clip(_unit(x) @ held.value.T, -1, 1))

    def part(batches):
        for pdf in (x.iloc[i : i + PIECE] for x in batches for i in range(0, len(x), PIECE)):
            a = angles(pdf["embedding"])
            yield pdf.assign(list=np.where(pdf["zero"], -1, a.argmin(1)).astype(np.int32), angle=np.where(pdf["zero"], 0.0, a.min(1)))

    lists = saved(refs.mapInPandas(part, f"id {kind}, embedding {refs.schema['embedding'].dataType.simpleString()}, zero boolean, list int, angle double"), "near-lists")
    about = {x.list: (x.wide, x.n) for x in lists.groupBy("list").agg(F.max("angle").alias("wide"), F.count("*").alias("n")).collect()}
    place = np.array(sorted(x for x in about if x >= 0), int)
    wide, size = (np.array([about[x][i] for x in place]) for i in (0, 1))

    def visits(batches, later: bool):
        """(row, id, embedding, list): the lists to visit first, or the others that the k-th best doesn't exclude."""
        for pdf in (x.iloc[i : i + PIECE] for x in batches for i in range(0, len(x), PIECE)):
            a = angles(pdf["embedding"])[:, place] if len(place) else np.zeros((len(pdf), 0))
            order = np.argsort(a, axis=1)
            # as many lists as are sure to hold k references besides the query itself, and a few at least
            enough = np.cumsum(size[order], axis=1) >= k + exclude_self if len(place) else np.zeros((len(pdf), 0), bool)
            first = np.maximum(FIRST_LISTS, np.where(enough.any(1), enough.argmax(1) + 1, len(place))) if len(place) else np.zeros(len(pdf), int)
            out = []
            for i in range(len(pdf)):
                near = order[i, : first[i]]
                if later:
                    far = order[i, first[i] :]
                    near = far[a[i, far] - wide[far] <= pdf["bound"].iat[i] + SLACK]
                out.append(place[near].tolist() + ([-1] if later and -1 in about and np.pi / 2 <= pdf["bound"].iat[i] + SLACK else []))
            # a row for each visit carries the vector, so a few rows' visits are given out at a time
            given = pdf[["row", "id", "embedding"]].assign(list=out)
            few = max(1, GIVEN // max(1, max(map(len, out), default=1) * width))
            for i in range(0, len(given), few):
                yield given.iloc[i : i + few].explode("list").dropna(subset="list").astype({"list": "int32"})

    shape = f"row long, id {kind}, embedding {q.schema['embedding'].dataType.simpleString()}, list int"
    chunks = F.create_map(*[x for c, (_, n) in about.items() for x in (F.lit(c), F.lit(max(1, -(-n // rows))))])

    def compared(visiting: DataFrame) -> DataFrame:
        visiting = saved(visiting, "near-visits")
        counts = visiting.groupBy("list").agg(F.count("*").alias("n")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / rows)).cast("int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = visiting.join(F.broadcast(counts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("chunk", every(chunks[F.col("list")]))
        right = lists.join(F.broadcast(counts.select("list", "parts")), "list").withColumn("chunk", F.pmod(F.xxhash64("id", "embedding"), chunks[F.col("list")]).cast("int")).withColumn("part", every(F.col("parts")))
        names = ["list", "chunk", "part", "row", "id", "embedding"]
        both = left.select(*names).unionByName(right.withColumn("row", F.lit(None).cast("long")).select(*names))

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            mine = pdf["row"].notna()
            own, given = pdf[mine], pdf[~mine].sort_values("id", kind="stable")
            if own.empty or given.empty:
                return pd.DataFrame({"row": [], "id": [], "ref": [], "cosine": []})
            return _closest(own["row"].to_numpy(np.int64), own["id"].to_numpy(), _unit(own["embedding"]), given["id"].to_numpy(), _unit(given["embedding"]), k, exclude_self)

        return both.groupBy("list", "chunk", "part").applyInPandas(meet, f"row long, id {kind}, ref {kind}, cosine double")

    best = Window.partitionBy("row").orderBy(F.desc(F.round("cosine", 12)), "ref")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    usual = asked.where("not zero")
    early = saved(ranked(compared(usual.select("row", "id", "embedding").mapInPandas(lambda x: visits(x, False), shape))), "near-early")
    bound = early.groupBy("row").agg(F.when(F.count("*") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("cosine"))))).alias("bound"))
    more = usual.join(bound, "row", "left").select("row", "id", "embedding", F.coalesce("bound", F.lit(10.0)).alias("bound"))
    late = compared(more.mapInPandas(lambda x: visits(x, True), shape))
    found = ranked(early.drop("rank").unionByName(late))
    # a zero vector is as far from all: its k best are the first of all
    some = refs.select(F.col("id").alias("ref")).orderBy("ref").limit(k + 1 if exclude_self else k)
    zero = asked.where("zero").select("row", "id").join(F.broadcast(some), ~F.col("id").eqNullSafe(F.col("ref")) if exclude_self else F.lit(True)).withColumn("cosine", F.lit(0.0))
    return found.unionByName(ranked(zero)).select("id", "ref", "cosine", "rank")


def cosine_topk_mean(queries: DataFrame, positives: DataFrame, k: int = CONFIG.neighbours) -> DataFrame:
    """(id, score): mean cosine of the k nearest positives, of all of them if there are fewer (J5); 0 if there are none or the query has no vector."""
    near = nearest(queries, positives, k).groupBy("id").agg(F.avg("cosine").alias("score"))
    return queries.select("id").join(near, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def knn_vote(queries: DataFrame, labelled: DataFrame, k: int = CONFIG.neighbours) -> DataFrame:
    """(id, score): share of positives among the k nearest, weighted by 1 / cosine distance (J6). labelled: (id, embedding, y).

    Where a neighbour is at distance 0 only such neighbours vote, equally. Ids are unique on both sides; a query without a vector,
    or with a NaN in it, has no vote: its score is null.
    """
    near = nearest(queries.select("id", "embedding"), labelled, k).join(labelled.select(F.col("id").alias("ref"), "y"), "ref")
    near = near.withColumn("d", F.greatest(F.lit(0.0), F.round(1 - F.col("cosine"), 12)))
    exact = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("id")) == 1
    vote = F.when(exact, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    votes = near.withColumn("w", vote).groupBy("id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("score"))
    return queries.select("id").join(votes, "id", "left")


def hard_negatives(positives: DataFrame, negatives: DataFrame, k: int = 3) -> DataFrame:
    """(id, ref, cosine, rank): each positive's closest negatives."""
    return nearest(positives, negatives, k)


def expanded(positives: DataFrame, mined: DataFrame, k: int = 3) -> DataFrame:
    """(anchor, slot, id, y): each positive at slot 0, then k of its negatives in turn, repeated where it has fewer."""
    lists = mined.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "ref"))).alias("near"))  # at most k each
    turns = lists.select(F.col("id").alias("anchor"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"), "near")
    negative = turns.select("anchor", "slot", F.col("near")[F.pmod(F.col("slot") - 1, F.size("near"))]["ref"].alias("id"), F.lit(0).alias("y"))
    return positives.select(F.col("id").alias("anchor"), F.lit(0).alias("slot"), "id", F.lit(1).alias("y")).unionAll(negative)


def aligned(embeddings: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """embeddings with their labels; a label without an embedding raises."""
    missing = labels.join(embeddings, key, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"no embedding for {missing[0][key]}")
    return embeddings.join(labels, key)
