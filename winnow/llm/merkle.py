"""A Merkle manifest of a table, with a proof for every row.

Rows of a group, in order, are the leaves of a tree whose nodes are hashes of up to eight consecutive nodes; the groups' roots, in
order, are the leaves of another. Proofs are found by pointer jumping: every inner node holds the siblings on the way from it to
an ancestor, first its parent; joining the table with itself on that ancestor joins both ways into one of twice the length, until
all ways end at the root. Leaves take the way of their parent in a last join, where their own siblings are at hand. A tree has an
eighth as many inner nodes as leaves, so the ways that are shuffled are few, and no task holds more of a level than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import saved
from winnow.operators.prefix import numbered

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A way is one step for each level, from below: the hashes left and right of the node in its run, as hex text.
NO_WAY = "cast(array() as array<struct<l:string,r:string>>)"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """- for null, else UTF-8 byte count, colon, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def _parents(level: DataFrame) -> DataFrame:
    """The level above: (g, pos, size, kids); kids (pos, hash) in order. Groups whose root is reached have no more."""
    up = level.where("size > 1").groupBy("g", F.expr(f"pos div {FANOUT}").alias("pos"), F.ceil(F.col("size") / FANOUT).cast("long").alias("size"))
    return up.agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("kids"))


def _step(kids: str, pos: str) -> str:
    """SQL for the siblings of the kid at pos, left and right."""
    side = lambda sign: f"array_join(transform(filter({kids}, k -> k.pos {sign} {pos}), k -> k.hash), '')"
    return f"named_struct('l', {side('<')}, 'r', {side('>')})"


def tree(leaves: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """leaves (g, pos, size, hash): pos from 0 on in the group g of size rows. Gives inner nodes and the groups' roots.

    Inner nodes (g, level, pos, way): the siblings from the node to the group's root. Roots (g, hash); a lone leaf is its root.
    """
    level, inner, roots, at = leaves.select("g", "pos", "size", "hash"), [], [leaves.where("size = 1").select("g", "hash")], 0
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        at, most = at + 1, -(-most // FANOUT)
        level = saved(_parents(level).withColumn("hash", digest(F.array_join("kids.hash", ""))), f"{label}-level")
        inner.append(level.withColumn("level", F.lit(at)))
        roots.append(level.where("size = 1").select("g", "hash"))
    if not inner:
        none = leaves.select("g", F.lit(1).alias("level"), "pos", F.expr(NO_WAY).alias("way")).where("false")
        return none, roots[0]
    every = inner[0]
    for x in inner[1:]:
        every = every.unionByName(x)
    # a kid's first pointer is to its parent; a root points to itself, over no way
    first = every.where("level > 1").select("g", (F.col("level") - 1).alias("level"), F.explode("kids").alias("kid"), F.col("pos").alias("to"), "kids")
    first = first.select("g", "level", F.col("kid.pos").alias("pos"), (F.col("level") + 1).alias("to_level"), "to", F.array(F.expr(_step("kids", "kid.pos"))).alias("way"))
    ends = every.where("size = 1").select("g", "level", "pos", F.col("level").alias("to_level"), F.col("pos").alias("to"), F.expr(NO_WAY).alias("way"))
    ways, reach = saved(first.unionByName(ends), f"{label}-ways"), 1
    while reach < at - 1:
        a, b = ways.alias("a"), ways.alias("b")
        on = F.expr("a.g <=> b.g and a.to_level = b.level and a.to = b.pos")
        ways = saved(a.join(b, on).select("a.g", "a.level", "a.pos", "b.to_level", "b.to", F.concat("a.way", "b.way").alias("way")), f"{label}-ways")
        reach *= 2
    reached = roots[0]
    for x in roots[1:]:
        reached = reached.unionByName(x)
    return ways.select("g", "level", "pos", "way"), reached


def proven(leaves: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """leaves (g, pos, size, hash, row) with way, the siblings from each leaf to its group's root; and the groups' roots."""
    inner, roots = tree(leaves, label)
    run = leaves.where("size > 1").groupBy("g", F.expr(f"pos div {FANOUT}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "row"))).alias("kids"))
    met = run.alias("a").join(inner.where("level = 1").alias("b"), F.expr("a.g <=> b.g and a.up = b.pos")).select("a.g", "kids", F.explode("kids").alias("kid"), "way")
    up = met.select("g", F.col("kid.row").alias("row"), F.col("kid.hash").alias("hash"), F.concat(F.array(F.expr(_step("kids", "kid.pos"))), "way").alias("way"))
    return leaves.where("size = 1").select("g", "row", "hash", F.expr(NO_WAY).alias("way")).unionByName(up), roots


def folded(leaf: str, way: str) -> Column:
    """The root that the leaf gives with the siblings of the way."""
    return F.expr(f"aggregate({way}, {leaf}, (h, s) -> sha2(concat(s.l, h, s.r), 256))")


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], changed: dict[str, Column] | None = None, label: str = "merkle") -> DataFrame:
    """A row for each of docs: order's column, leaf, subroot, root, proof_sha256, folded_root, verified.

    Groups are ordered by value, null first; rows by `order`, null first, then by leaf. changed gives fields as a reader finds
    them later: folded_root is worked out from these, with the siblings of the manifest, and verified says whether it is the
    root. Rows that are equal in all fields are leaves of their own with places side by side. Columns beyond these don't matter.
    No rows: no rows, and no root.
    """
    own = [F.col(f"`{c}`") for c in fields]
    later = [(changed or {}).get(c, F.col(f"`{c}`")) for c in fields]
    same = F.lit(True)
    for a, b in zip(own, later, strict=True):
        same = same & a.eqNullSafe(b)
    hashed = docs.select(F.col(f"`{group}`").alias("g"), F.col(f"`{order}`").alias("id"), leaf_hash(own).alias("hash"), F.when(~same, leaf_hash(later)).alias("later"))
    # each text is read and hashed once; only hashes are dealt and sorted
    slim = saved(hashed, f"{label}-hashes").withColumn("later", F.coalesce("later", "hash"))
    placed = saved(numbered(slim, ["g"], [F.col("id").asc_nulls_first(), F.col("hash").asc()], "pos", "size"), f"{label}-leaves")
    rows, subroots = proven(placed.select("g", "pos", "size", "hash", F.struct("id", "later").alias("row")), label)
    subroots = saved(subroots, f"{label}-subroots")
    tops = saved(numbered(subroots.select(F.lit(0).alias("g"), F.col("g").alias("of"), "hash"), ["g"], [F.col("of").asc_nulls_first()], "pos", "size"), f"{label}-tops")
    top, root = proven(tops.select("g", "pos", "size", "hash", F.struct("of").alias("row")), f"{label}-top")
    top = top.crossJoin(F.broadcast(root.select(F.col("hash").alias("root")))).select(F.col("row.of").alias("of"), F.col("hash").alias("subroot"), F.col("way").alias("over"), "root")
    met = rows.join(F.broadcast(top) if _few(tops) else top, F.col("g").eqNullSafe(F.col("of"))).withColumn("way", F.concat("way", "over"))
    joined = F.expr("array_join(transform(way, s -> concat(s.l, s.r)), '')")
    out = met.select(F.col("row.id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), folded("row.later", "way").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _few(tops: DataFrame, most: int = 10_000) -> bool:
    """Whether so few groups are there that their ways, a few hundred bytes each for every level, can go to all tasks."""
    return tops.count() <= most


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; languages are the groups.

    A third of the ids, those whose crc32 three divides, are read back with the letters A-Z of their text in lower case. Nulls count
    as -, an empty text as 0:, whole texts of any length; a null id is first in its language and never changed; repeated rows
    are leaves of their own.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return manifest(docs, "lang", "doc_id", FIELDS, {"text": lower})
