"""Curated ingest: nested JSON entries to flat rows, length limits, first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = (
    "id string, name string, organism struct<name:string>, body struct<value:string,length:int>, "
    "xrefs array<struct<database:string,id:string,props:array<struct<key:string,value:string>>>>, "
    "comments array<struct<type:string,texts:array<struct<value:string>>>>, _corrupt_record string"
)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines; malformed ones have _corrupt_record set and are skipped by parse_entries."""
    return spark.read.schema(ENTRY).option("mode", "PERMISSIVE").json(path)


def entries_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON records."""
    return lines.select(F.from_json(column, ENTRY).alias("e")).select("e.*")


def parse_entries(raw: DataFrame, family_database: str = "Families", term_database: str = "Terms", term_property: str = "term", keep: list[str] | None = None) -> DataFrame:
    """Flat rows with defaults (P1-P6): name falls back to id, organism to Unknown, length to the text's; last description wins.

    keep: columns beside the entry's own that stay.
    """
    text = F.col("body.value")
    refs = F.coalesce("xrefs", F.array().cast("array<struct<database:string,id:string,props:array<struct<key:string,value:string>>>>"))
    of = lambda db: F.filter(refs, lambda x: x["database"] == db)

    def term(x: Column) -> Column:
        props = F.filter(F.coalesce(x["props"], F.array().cast("array<struct<key:string,value:string>>")), lambda p: p["key"] == term_property)
        return F.concat_ws(":", x["id"], F.coalesce(F.get(props, F.lit(0))["value"], F.lit("")))

    told = F.filter(F.coalesce("comments", F.array().cast("array<struct<type:string,texts:array<struct<value:string>>>>")), lambda c: (c["type"] == "FUNCTION") & (F.size(c["texts"]) > 0))
    good = raw.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()) if "_corrupt_record" in raw.columns else raw.where("id is not null")
    return good.where(F.length(text) >= 1).select(
        *(keep or []),
        "id",
        F.coalesce("name", "id").alias("name"),
        text.alias("text"),
        F.coalesce("body.length", F.length(text)).alias("length"),
        F.coalesce("organism.name", F.lit("Unknown")).alias("organism"),
        F.transform(of(family_database), lambda x: x["id"]).alias("family_ids"),
        F.transform(of(term_database), term).alias("terms"),
        F.coalesce(F.when(F.size(told) > 0, F.element_at(told, -1)["texts"][0]["value"]), F.lit("")).alias("description"),
    )


def within_length(df: DataFrame, least: int = 50, most: int = 2000) -> DataFrame:
    """Inclusive length limits."""
    return df.where(F.col("length").between(least, most))


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by order (W1), nulls before others. Filter before, so a rejected row isn't taken for seen.

    Rows of a key are combined before they are shuffled, so a key that most rows have is no more than one row of each task.
    """
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_first"))
    return first.select(key, "_first.*").select(*[F.col(f"`{c}`") for c in df.columns])


def capped(df: DataFrame, query: str, order: list[str], most: int) -> DataFrame:
    """At most so many rows for each query (T1); the cap is the feature."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def with_hard_flag(df: DataFrame, column: str, values: list) -> DataFrame:
    """is_hard_negative: membership in a list (P9); null isn't a member."""
    return df.withColumn("is_hard_negative", F.coalesce(F.col(column).isin(values), F.lit(False)))


def running_totals(df: DataFrame, group: str) -> DataFrame:
    """Rows by query and in total so far (A27); one row for each query."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.select(group, "n", F.sum("n").over(Window.orderBy(group)).alias("running"))
