"""Near-duplicate documents by the chosen-path set similarity join (Christiani, Pagh and Sivertsen).

A document is the set of its word shingles, and a row of minwise tokens stands for the set: two sets agree in each token with
the probability of their Jaccard similarity. A tree starts with all documents at its root. A node picks about 1/threshold of
the token places at random, and a document goes on to one child for each picked place, the one of the token it has there.
Nodes of few documents are compared exhaustively, larger ones branch again. Independent trees repeat this; a pair that is as
similar as the threshold is missed only where all trees part it, and there are as many trees as a stated recall needs.

What Spark does with it:
* documents with equal sets are one class from the start, so copies never meet in pairs;
* node sizes are counted with map-side sums and only nodes of two or more classes go on, so most rows end there;
* in a node, candidates are pairs whose tokens agree often enough; only as many are emitted as connect it (a maximum spanning
  forest), and what they connect over all trees is a crowd;
* a crowd's full sets meet once, in one task, where pairs are confirmed until all that is linked is connected. A crowd that is
  too large for that is confirmed node by node instead, so no task holds more than a node or a crowd within the bounds below.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import WordHashes, as_bytes, free_name, mixed, saved, shingle_hashes, slices
from winnow.llm.components import connected

TOKENS = 64
RECALL = 0.9985  # of pairs just at the threshold, whatever else there is; it gives the number of trees
LARGEST_NODE = 4096  # beyond this a node branches on
LARGEST_CROWD = 20_000_000  # shingles of the classes that one task compares
DEPTH = 5
SEED = 0x5EED
SIGNATURES = "doc_id long, text_key long, n_shingles long, cls binary, tokens binary"


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minwise_tokens(shingles: np.ndarray, n: int = TOKENS) -> bytes:
    """n 32-bit tokens of a non-empty set: for each of n hash functions the top half of the least value."""
    a, b = _multipliers(n)
    out = np.empty(n, "<u4")
    for i in range(n):
        out[i] = (shingles * a[i] ^ b[i]).min() >> np.uint64(32)
    return out.tobytes()


def shingles_of(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    return shingle_hashes(hashes.of(text.lower().split()), k)  # bytes.lower() touches A-Z alone


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """For each row its set's size, class (a 128-bit hash of the whole set) and tokens; both null without words."""

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            n, cls, tokens = [], [], []
            for text in as_bytes(batch.column("text")):
                s = shingles_of(text, k, hashes)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tokens.append(minwise_tokens(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(tokens, pa.binary())], names=["doc_id", "text_key", "n_shingles", "cls", "tokens"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SIGNATURES)


def _picked(node: int, rate: float, n: int) -> np.ndarray:
    """The token places that a node branches on: each with probability rate, and at least one. It depends on the node alone."""
    h = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(node & 0xFFFFFFFFFFFFFFFF))
    at = np.flatnonzero(h < np.uint64(min(1.0, rate) * 2**64 * (1 - 1e-12)))
    return at if len(at) else np.array([h.argmin()])


def met(trees: int, threshold: float) -> float:
    """The probability that two sets at the threshold are in a node together at the last depth of one of the trees."""
    rate, out = 1 / (threshold * TOKENS), 0.0
    none = (1 - rate) ** TOKENS  # then one place is picked all the same
    for m in range(TOKENS + 1):
        like, parted = m / TOKENS, 0.0
        for _ in range(DEPTH):
            stay = 1 - parted
            parted = (1 - rate * stay) ** m - none + none * (1 - like * stay)
        out += comb(TOKENS, m) * threshold**m * (1 - threshold) ** (TOKENS - m) * (1 - parted**trees)
    return out


def trees_for(recall: float, threshold: float) -> int:
    return next(t for t in range(1, 1000) if met(t, threshold) >= recall)


def _branch(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, cls, tokens) -> (node, cls) of the children."""
    rate = 1 / (threshold * TOKENS)

    def run(batches):
        places: dict[int, np.ndarray] = {}
        for batch in slices(batches, 2048):
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u4").reshape(-1, TOKENS)
            for node in np.unique(nodes).tolist():
                if node not in places:
                    if len(places) > 100_000:
                        places.clear()
                    places[node] = _picked(node, rate, TOKENS)
                own = np.flatnonzero(nodes == node) if len(nodes) > 1 else np.array([0])
                cls = batch.column("cls").take(pa.array(own))
                for i in places[node].tolist():
                    child = mixed(np.uint64((node * 0xC2B2AE3D27D4EB4F + i) & 0xFFFFFFFFFFFFFFFF) ^ mixed(tokens[own, i].astype(np.uint64) + np.uint64(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), cls], names=["node", "cls"])

    return rows.select("node", "cls", "tokens").mapInArrow(run, "node long, cls binary")


def _block_pairs(rows: DataFrame, parts: Column, columns: list[str]) -> DataFrame:
    """(node, columns) of nodes too large for a task: their rows are dealt into parts, and each two parts meet as a node of their own."""
    dealt = rows.select("node", *columns, parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("cls", "node"), "parts"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> other")
    return each.select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), *columns)


def _nodes(classes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """(node, cls) of the nodes to compare, for all trees."""
    roots = classes.select(F.explode(F.array(*[F.lit(t).cast("long") for t in range(1, trees + 1)])).alias("node"), "cls", "tokens")
    leaves, rows = None, roots
    for depth in range(1, DEPTH + 1):
        children = saved(_branch(rows, threshold), "paths")
        sizes = children.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        met = saved(children.join(sizes, "node"), "nodes")
        small = met.where(F.col("n") <= LARGEST_NODE).select("node", "cls")
        large = met.where(F.col("n") > LARGEST_NODE)
        if depth == DEPTH:  # a crowd that stays together
            small = small.unionAll(_block_pairs(large, F.ceil(2 * F.col("n") / LARGEST_NODE), ["cls"]))
        leaves = small if leaves is None else leaves.unionAll(small)
        if depth == DEPTH or large.isEmpty():
            return leaves
        rows = large.join(classes.select("cls", "tokens"), "cls")
    return leaves


def _grouped(batches, key: str):
    """Tables of the rows of one key each; rows come sorted by it."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        keys = t[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        begin = [0, *cuts.tolist()]
        for a, b in zip(begin, begin[1:], strict=False):
            yield t.slice(a, b - a)
        held = t.slice(begin[-1])
    if held is not None and held.num_rows:
        yield held


def _forest(tokens: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs that agree in at least `least` tokens (Prim)."""
    n = len(tokens)
    best, parent, out = np.zeros(n, np.int16), np.full(n, -1), np.ones(n, bool)
    edges, at = [], 0
    for _ in range(n):
        out[at] = False
        agree = (tokens == tokens[at]).sum(axis=1, dtype=np.int16)
        better = out & (agree > best)
        best[better], parent[better] = agree[better], at
        if not out.any():
            break
        at = int(np.where(out, best, -1).argmax())
        if best[at] >= least:
            edges.append((int(parent[at]), at))
    return edges


def _candidates(rows: DataFrame, least: int) -> DataFrame:
    """(a, b) that connect, in each node, all classes whose tokens agree often enough. rows: (node, cls, tokens)."""

    def run(batches):
        held = ([], [])

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in held], names=["a", "b"])
            for c in held:
                c.clear()
            return out

        for t in _grouped(batches, "node"):
            ids = t["cls"].to_pylist()
            for i, j in _forest(np.frombuffer(b"".join(t["tokens"].to_pylist()), "<u4").reshape(-1, TOKENS), least):
                lo, hi = sorted((ids[i], ids[j]))
                held[0].append(lo)
                held[1].append(hi)
            if len(held[0]) > 5000:
                yield full()
        yield full()

    return rows.repartition(_parts(rows), "node").sortWithinPartitions("node", "cls").mapInArrow(run, "a binary, b binary")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class _Crowd:
    """Classes to compare with each other on their full sets."""

    def __init__(self, tokens: list[bytes], shingles: list[bytes], least: int, percent: int):
        self.tokens = np.frombuffer(b"".join(tokens), "<u4").reshape(-1, TOKENS)
        self.sets = [np.frombuffer(x, np.uint64) for x in shingles]
        self.sizes, self.least, self.percent, self.bits = np.array([len(x) for x in self.sets]), least, percent, None
        n, words = len(self.sets), 1 + len(np.unique(np.concatenate(self.sets))) // 64 if len(self.sets) > 16 else 0
        if n > 16 and n * words <= 1 << 24:  # up to 128 MB of bits: a row then meets many others at once
            vocabulary = np.unique(np.concatenate(self.sets))
            packed = np.zeros((n, words * 64), np.uint8) if n * words <= 1 << 18 else None
            self.bits = np.zeros((n, words), np.uint64)
            for i, x in enumerate(self.sets):
                row = np.zeros(words * 64, np.uint8) if packed is None else packed[i]
                row[np.searchsorted(vocabulary, x)] = 1
                self.bits[i] = np.packbits(row).view(np.uint64)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        out = np.zeros(len(others), np.int64)
        for k, j in enumerate(others.tolist()):
            both = np.concatenate((self.sets[i], self.sets[j]))
            both.sort()
            out[k] = (both[1:] == both[:-1]).sum()
        return out

    def links(self):
        """Confirmed links that connect all that is linked: pairs that are connected already aren't tested again."""
        n = len(self.sets)
        label = np.arange(n)
        for i in range(n):
            agree = (self.tokens == self.tokens[i]).sum(axis=1)
            near = 100 * np.minimum(self.sizes, self.sizes[i]) >= self.percent * np.maximum(self.sizes, self.sizes[i])
            others = np.flatnonzero((agree >= self.least) & near & (label != label[i]))
            for at in range(0, len(others), 256):
                some = others[at : at + 256]
                some = some[label[some] != label[i]]
                common = self.common(i, some)
                for j in some[100 * common >= self.percent * (self.sizes[some] + self.sizes[i] - common)].tolist():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        yield i, j


def _confirmed(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b) of the confirmed links within each crowd. rows: (crowd, cls, tokens, shingles)."""

    def run(batches):
        for t in _grouped(batches, "crowd"):
            if t.num_rows > 1:
                ids = t["cls"].to_pylist()
                found = [*_Crowd(t["tokens"].to_pylist(), t["shingles"].to_pylist(), least, percent).links()]
                yield pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition(_parts(rows), "crowd").sortWithinPartitions("crowd", "cls").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the wanted classes, from one document of each. wanted: (cls, doc_id, text_key)."""

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            s = [shingles_of(x, k, hashes).tobytes() for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(s, pa.binary())], names=["cls", "shingles"])

    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    texts = keyed.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).select("cls", "text")
    return texts.mapInArrow(run, "cls binary, shingles binary")


def near_links(docs: DataFrame, signed: DataFrame, k: int, percent: int, trees: int | None = None) -> DataFrame:
    """Confirmed links (a, b) between classes that connect all linked classes. signed: the saved signatures of docs."""
    of = F.struct("doc_id", "text_key")
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min_by(of, of).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    classes = saved(classes.select("cls", "of.doc_id", "of.text_key", "n_shingles", "tokens"), "classes")
    # a pair at the threshold agrees in fewer tokens than this about three times in 100,000
    least = int(np.floor(TOKENS * (percent / 100) - 4 * np.sqrt(TOKENS * (percent / 100) * (1 - percent / 100))))
    trees = trees or trees_for(RECALL, percent / 100)
    leaves = saved(_nodes(classes, percent / 100, trees).join(classes.select("cls", "tokens"), "cls"), "leaves")
    crowds = connected(saved(_candidates(leaves, least).distinct(), "candidates"))
    members = classes.join(crowds, classes["cls"] == crowds["node"]).select("cls", "doc_id", "text_key", "n_shingles", "tokens", F.xxhash64("root").alias("crowd"))
    members = saved(members, "members")
    sizes = members.groupBy("crowd").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    fits = (F.col("n") <= LARGEST_NODE) & (F.col("total") <= LARGEST_CROWD)
    sets = saved(_sets(docs, members.select("cls", "doc_id", "text_key"), k).dropDuplicates(["cls"]), "sets")
    whole = members.join(sizes.where(fits), "crowd").select("crowd", "cls", "tokens")
    # a crowd too large for a task is compared node by node instead, and nodes of too many shingles block against block
    own = leaves.join(members.join(sizes.where(~fits), "crowd").select("cls", "n_shingles"), "cls")
    totals = own.join(own.groupBy("node").agg(F.sum("n_shingles").alias("total")), "node")
    cut = _block_pairs(totals.where(F.col("total") > LARGEST_CROWD), F.ceil(2 * F.col("total") / LARGEST_CROWD), ["cls", "tokens"])
    parts = totals.where(F.col("total") <= LARGEST_CROWD).select("node", "cls", "tokens").unionAll(cut).withColumnRenamed("node", "crowd")
    return saved(_confirmed(whole.unionAll(parts).join(sets, "cls"), least, percent), "near-links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int | None = None) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Words are lower-cased in A-Z and parted at ASCII white space; fewer than k words are one shingle. Rows link if
    100 * intersection >= percent * union; component_id is the smallest doc_id a row can reach. Rows without words (null,
    empty) have no shingles and link with nothing. A null id never names a component unless all rows of it are null; repeated
    rows and ids are single rows here and end in one component if their texts link.
    """
    signed = saved(signatures(docs.select("doc_id", "text"), k), "signatures")
    links = near_links(docs, signed, k, percent, trees)
    roots = connected(links)
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.select("cls", "root").join(least, "root").select("cls", "component")
    out = signed.join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, on 4-word shingles.

    Null and empty texts have no shingles and link with nothing; repeated rows and null ids as in near_duplicates().
    """
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80).drop("text_key")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the smallest id, with its own columns.

    Five-word shingles, similarity 0.8. Documents without words all stay; of rows that repeat both id and text one stays.
    """
    found = near_duplicates(docs, k=5, percent=80)
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    of_id, of_key = free_name(keyed, "of_id"), free_name(keyed, "of_key")
    keep = found.where("kept").select(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_key)).distinct()
    kept = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)
