"""Tables in the roles that the engine's queries need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import table

#: Two synthetic scorers over the labelled documents, the same in both engines: hashed noise, helped along by the label, in
#: steps of a hundredth so that there are ties.
SCORES_SQL = """
with u as (
  select l.doc_id as id, d.lang as split, l.toxic as y, l.quality as quality, m.method as method,
         ('0x' || substr(md5(m.method || '|' || l.doc_id::varchar), 1, 8))::bigint as h, m.lift as lift
  from labels l join documents d on l.doc_id = d.doc_id
  cross join (select 'plain' as method, 10 as lift union all select 'sharp', 35) m
), scores as (
  select split, method, id, y, quality, ((h % 101) * (100 - lift) // 100 + lift * y) / 100.0::double as score from u
)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, method, id, y, quality, score): languages are splits."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    base = labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("split"), F.col("toxic").alias("y"), "quality")
    base = base.withColumn("m", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.lit(x).alias("lift")) for n, x in (("plain", 10), ("sharp", 35))])))
    base = base.select("split", F.col("m.method").alias("method"), "id", "y", "quality", F.col("m.lift").alias("lift"))
    noise = hash_rank("method", "id") % 101
    return base.select("split", "method", "id", "y", "quality", ((F.floor(noise * (100 - F.col("lift")) / 100) + F.col("lift") * F.col("y")) / 100.0).alias("score"))


def hash_rank(a: str, b: str) -> Column:
    """First 32 bits of md5('a|b')."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", a, F.col(b).cast("string"))), 1, 8), 16, 10).cast("bigint")


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as JSON records of the ingest's schema, one in fifty of them broken off."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("n"), "doc_id"))
    organism = F.when(F.col("doc_id") % 4 != 0, F.struct(F.col("lang").alias("name")))
    props = F.array(F.struct(F.lit("term").alias("key"), F.col("source").alias("value")))
    ref = lambda db, i, p: F.struct(F.lit(db).alias("database"), i.alias("id"), p.alias("props"))
    refs = F.array(ref("Families", F.concat(F.lit("f"), F.col("doc_id") % 5), props), ref("Terms", F.concat(F.lit("t"), F.col("doc_id") % 7), props), ref("Terms", F.lit("u"), F.slice(props, 1, 0)))
    told = lambda kind, x: F.struct(F.lit(kind).alias("type"), F.array(F.struct(x.alias("value"))).alias("texts"))
    comments = F.array(told("OTHER", F.lit("x")), told("FUNCTION", F.col("lang")), told("FUNCTION", F.col("source")))
    record = F.struct(F.concat(F.lit("e"), "doc_id").alias("id"), name.alias("name"), organism.alias("organism"), F.struct(F.col("text").alias("value"), F.col("n_chars").alias("length")).alias("body"), refs.alias("xrefs"), comments.alias("comments"))
    return d.select(F.when(F.col("doc_id") % 50 == 7, F.substring(F.to_json(record), 1, 20)).otherwise(F.to_json(record)).alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, label, y): label 0 is the positive class."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("label") == 0).cast("int").alias("y"))


def vector_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test vectors: every fifth id is a test."""
    v = vectors(spark, sf_dir)
    return v.where("id % 5 <> 0"), v.where("id % 5 = 0")


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
