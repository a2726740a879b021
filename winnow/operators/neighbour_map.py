"""The graph of nearest neighbours by blocks and descent, for vectors too many to compare all, and a map in two dimensions laid out from it.

Both are tables throughout: the graph's rows are (id, ref, cosine), the map's (id, x, y). A step joins them and is written
before the next one; the driver sees counts and a bounded number of vectors as centres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.functions import vector as V
from winnow.operators.prefix import numbered
from winnow.operators.scorers import pca_map
from winnow.operators.simjoin import whole
from winnow.session import saved

LISTS = 256  # lists of neighbours, or rows that ask a block, that a task compares at a time
FIRST = 6  # nearest blocks that a row meets before the others, which then give only what is better
CELLS = 4096  # centres at most; the driver draws them and each task has them
NEGATIVES, PUSH = 5, 2.0  # others that a row is pushed from in each step, and how hard, against its neighbours' pull
CURVE_A, CURVE_B = 1.577, 0.895  # fixed values: fall of nearness with distance on the map, 1 / (1 + a d^2b), for a least distance of 0.1


def _compared(lists: DataFrame, kind: str) -> DataFrame:
    """(id, ref, cosine) of pairs within lists (ids, fresh, bounds, vectors), of which one is fresh, that beat the bound of id.

    Lists hold twice the kept neighbours at most, so what a list gives is bounded.
    """

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, LISTS):
                batch = whole_batch.slice(at, LISTS)
                ids, fresh, bounds = (batch.column(c).flatten() for c in ("ids", "fresh", "bounds"))
                vectors = batch.column("vectors").flatten().flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False))))
                if not len(ids):
                    continue
                x, new, bound = vectors.reshape(len(ids), -1).astype(np.float64), fresh.to_numpy(zero_copy_only=False), bounds.to_numpy(zero_copy_only=False)
                out = []
                for s, e in zip(ends, ends[1:], strict=False):
                    sims = x[s:e] @ x[s:e].T
                    wanted = (sims > bound[s:e, None]) & (new[s:e, None] | new[None, s:e])
                    np.fill_diagonal(wanted, False)
                    i, j = np.nonzero(wanted)
                    out.append((i + s, j + s, sims[i, j]))
                i, j, sims = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sims)], names=["id", "ref", "cosine"])

    return lists.mapInArrow(run, f"id {kind}, ref {kind}, cosine double").groupBy("id", "ref").agg(F.max("cosine").alias("cosine"))


def _lists(members: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Lists for _compared from members (by, id, fresh) and nodes (id, unit, bound)."""
    known = members.join(nodes, "id").groupBy(*by).agg(F.collect_list(F.struct("id", "fresh", "bound", "unit")).alias("m")).where(F.size("m") > 1)
    return known.select(F.col("m.id").alias("ids"), F.col("m.fresh").alias("fresh"), F.col("m.bound").alias("bounds"), F.col("m.unit").alias("vectors"))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each id with their rank. Spark cuts each task's rows to k for each id before it shuffles them."""
    w = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "ref")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _bounded(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """nodes with bound: the least cosine of a row that has k neighbours, else -2."""
    bounds = edges.groupBy("id").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("bound"))
    return nodes.join(bounds, "id", "left").fillna(-2.0, ["bound"])


def _dealt(nodes: DataFrame, n: int, probes: int, rows: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """nodes (id, unit) with draw and the block that each lies in, and the centres of the blocks.

    A row lies in the cell of the nearest of some rows that are drawn as centres, and a cell of more than twice the average is cut
    into blocks, whatever its vectors. Up to 2 / 3 probes * rows rows there are at most as many blocks as probes.
    """
    most = max(1, 2 * probes // 3)
    cells = min(CELLS, max(min(most, -(-n // 64)), -(-n // rows)))
    drawn = nodes.withColumn("draw", F.xxhash64("id", F.lit(seed)))
    centres = np.array([r.unit for r in drawn.orderBy("draw", "id").limit(cells).collect()], np.float64)

    @F.pandas_udf("int")
    def nearest(units: pd.Series) -> pd.Series:
        return pd.Series((_matrix(units, centres.shape[1]) @ centres.T).argmax(1).astype(np.int32))

    placed = numbered(drawn.withColumn("cell", nearest("unit")), ["cell"], [F.col("draw"), F.col("id")], "pos")
    size = -(-2 * n // cells)
    parts = [(r.cell, -(-r.n // size)) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()]
    before = np.cumsum([0] + [p for _, p in parts]).tolist()
    firsts = nodes.sparkSession.createDataFrame([(c, b) for (c, _), b in zip(parts, before, strict=False)], "cell int, first int")
    block = (F.col("first") + F.floor(F.col("pos") / size)).cast("int").alias("block")
    return placed.join(F.broadcast(firsts), "cell").select("id", "unit", "draw", block), centres[[c for c, p in parts for _ in range(p)]]


def _matrix(units: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([np.empty(0), *units]).reshape(len(units), width)


def _met(nodes: DataFrame, asked: DataFrame, blocks: int, k: int, kind: str) -> DataFrame:
    """(id, ref, cosine): of asked (id, unit, bound, block), the k best others among nodes (id, unit, block) of that block that reach the bound.

    A task has a block's rows in memory, and those that ask stream by.
    """

    def best(ids, x, bounds, refs, y):
        sims = x @ y.T
        own = pa.compute.index_in(ids, value_set=refs).to_numpy(zero_copy_only=False)
        here = ~np.isnan(own.astype(np.float64))
        sims[np.nonzero(here)[0], own[here].astype(np.int64)] = -9
        least = np.array(bounds)
        open_ = np.nonzero(least == -2)[0]
        if len(refs) > k and len(open_):
            least[open_] = np.partition(sims[open_], len(refs) - k, axis=1)[:, len(refs) - k]
        flat = np.flatnonzero(sims >= least[:, None] - 1e-12)  # much faster than of two dimensions
        i, j, s = flat // len(refs), flat % len(refs), sims.ravel()[flat]
        if len(i) and np.bincount(i).max() > k:  # ties go to the smaller ref, and refs are in order
            order = np.lexsort((j, -s.round(12), i))
            i, j, s = i[order], j[order], s[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, s = i[first], j[first], s[first]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), refs.take(pa.array(j)), pa.array(s)], names=["id", "ref", "cosine"])

    def run(batches):
        at, refs, rows, y = None, [], [], None
        for batch in batches:
            key = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(np.diff(key))[0] + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if key[s] // 2 != at:
                    at, refs, rows, y = key[s] // 2, [], [], None
                for b in range(s, e, LISTS):
                    part = batch.slice(b, min(LISTS, e - b))
                    ids, x = part.column("id"), part.column("unit").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    if not key[s] % 2:
                        refs.append(ids)
                        rows.append(x)
                        continue
                    if y is None:
                        known, y = pa.concat_arrays(refs), np.concatenate(rows)
                        refs, rows = [], []
                    yield best(ids, x, part.column("bound").to_numpy(), known, y)

    there = nodes.select("block", F.lit(False).alias("asks"), "id", "unit", F.lit(-2.0).alias("bound"))
    every = there.unionByName(asked.select("block", F.lit(True).alias("asks"), "id", "unit", "bound"))
    return every.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "id").mapInArrow(run, f"id {kind}, ref {kind}, cosine double")


def neighbour_graph(rows: DataFrame, k: int = 15, breadth: int = 2, probes: int = 48, rounds: int = 3, least: float = 0.002, seed: int = CONFIG.seed, cell: int = 4096) -> DataFrame:
    """(id, ref, cosine, rank): about the k nearest others of each row (id, embedding), by blocks of near rows and descent.

    Rows are dealt to blocks of about `cell` rows around centres, and a row meets the rows of the `probes` blocks that are
    nearest to it, so its vector moves about `probes` times whatever the number of rows. Up to 2 / 3 * probes * cell rows there are
    no more blocks than that: all pairs are compared and the result is exact. Beyond, the search keeps breadth * k for each row,
    which finds more where vectors have little structure, and rounds of descent follow. A round compares, within each row's
    neighbours and as many of those that it is a neighbour of, the pairs that no round compared before, for a neighbour's
    neighbour is often one too; it ends when fewer than a share `least` of all neighbours changed. What is found is a true
    cosine; a neighbour may be missed (see the tests for the share found). For exact ones: simjoin.nearest. Ids are unique;
    rows without an id or a whole vector are left out; ties go to the smaller ref; fewer than k others: all that were met. No
    rows or one row: no neighbours.
    """
    kind, asked = rows.schema["id"].dataType.simpleString(), k
    nodes = saved(whole(rows).withColumn("unit", V.unit(F.col("embedding").cast("array<double>"))).select("id", F.col("unit").cast("array<float>").alias("unit")), "graph-nodes")
    n = nodes.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([], f"id {kind}, ref {kind}, cosine double, rank int")
    nodes, centres = _dealt(nodes, n, probes, cell, seed)
    nodes = saved(nodes, "graph-blocks")
    if len(centres) > probes:
        k *= breadth

    @F.pandas_udf("array<int>")
    def visits(units: pd.Series, blocks: pd.Series, draws: pd.Series) -> pd.Series:
        near = _matrix(units, centres.shape[1]) @ centres.T
        # blocks of one cell are as near, and a row's draw tells which come first
        near += ((draws.to_numpy()[:, None] >> 20) + 40503 * np.arange(len(centres))[None, :]) % 65536 * 1e-12
        near[np.arange(len(near)), blocks.to_numpy()] = 9
        some = np.argpartition(-near, probes, axis=1)[:, :probes] if len(centres) > probes else np.tile(np.arange(len(centres)), (len(near), 1))
        return pd.Series([*np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1), 1).astype(np.int32)])

    order = visits("unit", "block", "draw")
    near = nodes.select("id", "unit", F.lit(-2.0).alias("bound"), F.explode(F.slice(order, 1, FIRST)).alias("block"))
    edges = saved(_best(_met(nodes, near, len(centres), k, kind), k), "graph")
    if len(centres) > FIRST:  # the rest of the blocks give only what beats the nearest ones
        rest = _bounded(nodes, edges, k).select("id", "unit", "bound", F.explode(F.slice(order, FIRST + 1, probes)).alias("block"))
        edges = saved(_best(edges.select("id", "ref", "cosine").unionByName(_met(nodes, rest, len(centres), k, kind)), k), "graph")
    edges, units = edges.withColumn("fresh", F.lit(True)), nodes.select("id", "unit")
    for _ in range(rounds if len(centres) > probes else 0):
        some = Window.partitionBy("of").orderBy(F.desc("fresh"), F.xxhash64("of", "id"))
        back = edges.select(F.col("ref").alias("of"), "id", "fresh").withColumn("rn", F.row_number().over(some)).where(F.col("rn") <= k)
        both = edges.select(F.col("id").alias("of"), F.col("ref").alias("id"), "fresh").unionByName(back.drop("rn"))
        members = both.repartition("of").groupBy("of", "id").agg(F.max("fresh").alias("fresh"))
        # vectors go to lists that have something fresh only
        members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("of"))).where("any").drop("any")
        met = _compared(_lists(members, _bounded(units, edges, k), ["of"]), kind)
        every = edges.select("id", "ref", "cosine", F.lit(False).alias("fresh")).unionByName(met.withColumn("fresh", F.lit(True)))
        # a pair that was there already isn't fresh
        edges = saved(_best(every.groupBy("id", "ref").agg(F.max("cosine").alias("cosine"), F.min("fresh").alias("fresh")), k), "graph")
        if edges.where("fresh").count() <= least * n * k:
            break
    return edges.where(F.col("rank") <= asked).select("id", "ref", "cosine", "rank")


def edge_weights(graph: DataFrame) -> DataFrame:
    """(id, ref, weight), both ways, from (id, ref, cosine): 1 for a row's nearest, falling so that all its weights sum to log2 of their number.

    Two rows that name each other have a + b - ab. Distances are 1 - cosine.
    """

    @F.pandas_udf("array<double>")
    def fall(distances: pd.Series) -> pd.Series:
        sizes = distances.str.len().to_numpy()
        d = np.full((len(sizes), sizes.max() if len(sizes) else 0), np.inf)
        d[np.arange(d.shape[1])[None, :] < sizes[:, None]] = np.concatenate([*distances]) if len(sizes) else []
        over = d - d.min(1, keepdims=True)
        low, high, goal = np.zeros(len(d)), np.full(len(d), 4.0), np.log2(np.maximum(sizes, 2))
        for _ in range(50):  # halving; distances are 2 at most
            mid = np.maximum((low + high) / 2, 1e-9)
            more = np.exp(-over / mid[:, None]).sum(1) > goal
            low, high = np.where(more, low, mid), np.where(more, mid, high)
        return pd.Series([w[:s] for w, s in zip(np.exp(-over / mid[:, None]), sizes, strict=True)])

    near = F.struct(F.greatest(F.lit(0.0), 1 - F.col("cosine")).alias("d"), "ref")
    lists = graph.groupBy("id").agg(F.sort_array(F.collect_list(near)).alias("near"))  # k at most
    one = lists.select("id", F.inline(F.arrays_zip(F.col("near.ref").alias("ref"), fall("near.d").alias("w"))))
    sides = one.unionByName(one.select(F.col("ref").alias("id"), F.col("id").alias("ref"), "w"))
    return sides.groupBy("id", "ref").agg((F.sum("w") - F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0)).alias("weight"))


def neighbour_map(rows: DataFrame, k: int = 15, steps: int = 16, seed: int = CONFIG.seed) -> DataFrame:
    """(id, label, x, y) of rows (id, label, embedding), so that near neighbours are near on the map (V7).

    It starts from the principal components. In each step rows are drawn to their neighbours by the edges' weights and pushed
    from a few others, which shifts of a random numbering give; steps shrink to nothing.
    Ids are unique; rows without an id or a whole vector aren't on the map, repeated vectors are near each other.
    """
    held = saved(rows.select("id", "label").join(whole(rows), "id"), "map-rows")
    n = held.count()
    if n < 3:
        return held.select("id", "label", F.col("id").isNull().cast("double").alias("x"), F.lit(0.0).alias("y"))
    edges = saved(edge_weights(neighbour_graph(held, k, seed=seed)), "map-edges")
    flat = pca_map(held)
    reach = flat.agg(F.greatest(F.max(F.abs("x") + F.abs("y")), F.lit(1e-9)).alias("reach"))
    # rows with equal vectors part by a hash
    jitter = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1e5
    first = flat.crossJoin(F.broadcast(reach)).select("id", (10 * F.col("x") / F.col("reach") + jitter(1)).alias("x"), (10 * F.col("y") / F.col("reach") + jitter(2)).alias("y"))
    places = saved(numbered(first, [], [F.xxhash64("id", F.lit(seed)), F.col("id")], "place"), "map")
    rng = np.random.default_rng(seed)
    names = ["id", "x", "y"]
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    far = dx * dx + dy * dy
    bounded = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    pull = F.when(far > 0, -2 * CURVE_A * CURVE_B * F.pow(far, CURVE_B - 1) / (1 + CURVE_A * F.pow(far, CURVE_B))).otherwise(0.0)
    push = 2 * CURVE_B / ((0.001 + far) * (1 + CURVE_A * F.pow(far, CURVE_B)))
    for step in range(steps):
        size = 1 - step / steps
        other = places.select(F.col("id").alias("ref"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        drawn = edges.join(other, "ref").join(places.select(*names), "id")  # in this order the sums need no shuffle of their own
        drawn = drawn.groupBy("id").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * bounded(pull * dx)).alias("px"), F.sum(F.col("weight") * bounded(pull * dy)).alias("py"))
        shifts = F.array(*[F.lit(int(s)) for s in rng.integers(1, n, NEGATIVES)])
        asked = places.select(*names, F.explode(F.transform(shifts, lambda s: F.pmod(F.col("place") + s, F.lit(n)))).alias("place"))
        pushed = asked.join(places.select("place", F.col("x").alias("ox"), F.col("y").alias("oy")), "place")
        pushed = pushed.groupBy("id").agg(F.avg(bounded(push * dx)).alias("rx"), F.avg(bounded(push * dy)).alias("ry"))
        forces = places.join(drawn, "id", "left").join(pushed, "id", "left").fillna(0.0, ["w", "px", "py", "rx", "ry"])
        # a row's weights bound how fast it may move, whatever its number of neighbours
        move = lambda p, r: size * (F.col(p) + PUSH * F.col("w") * F.col(r)) / (1 + F.col("w"))  # noqa: E731, B023
        places = saved(forces.select("id", (F.col("x") + move("px", "rx")).alias("x"), (F.col("y") + move("py", "ry")).alias("y"), "place"), "map")
    return held.select("id", "label").join(places.select(*names), "id").select("id", "label", "x", "y")
