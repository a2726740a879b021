"""Curation in one run: entries to curated rows, splits, and their sinks and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from winnow.functions.text import kmers
from winnow.operators import simjoin
from winnow.operators.ingest import ENTRY, first_wins, parse_entries, with_hard_flag, within_length
from winnow.operators.sampling import create_splits
from winnow.sources.files import write_csv, write_fasta, write_json

SPLITS = ["train", "val", "test_standard", "test_hard_negative", "test_seq_divergent"]


@dataclass
class Curated:
    """Where a run's tables are, and the counts that came with writing them."""

    path: str
    stats: dict = field(default_factory=dict)
    splits: dict = field(default_factory=dict)

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/curated")

    def split_rows(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/splits")


def curated_rows(raw: DataFrame, hard: list[str], least: int = 50, most: int = 2000) -> DataFrame:
    """Flat rows of raw (query_ord, row_ord, y, subcategory, value): value is an entry as JSON.

    Broken entries, those without an id or text and those beyond the length limits go; of those that are left the first by
    (query_ord, row_ord) of each id stays, with is_hard_negative where its subcategory is one of `hard`.
    """
    entries = raw.select("query_ord", "row_ord", "y", "subcategory", F.from_json("value", ENTRY).alias("e")).select("query_ord", "row_ord", "y", "subcategory", "e.*")
    rows = first_wins(within_length(parse_entries(entries, keep=["query_ord", "row_ord", "y", "subcategory"]), least, most), "id", ["query_ord", "row_ord"])
    return with_hard_flag(rows, "subcategory", hard).drop("query_ord", "row_ord")


def curate(raw: DataFrame, path: str, hard: list[str], items=None, strata: str | None = "subcategory", small: str = "error", **limits) -> Curated:
    """Write everything that a curation makes under path, and count it as it is written.

    curated (Parquet), metadata (CSV without texts), sequences (FASTA), splits (Parquet, a folder for each split, of which a run
    overwrites those it has), subcategories, stats and split_stats (JSON). A run with the same entries leaves the same rows.
    items: a column of each text's set for the similarity of positives, k-mers by default. See curated_rows() and create_splits().
    """
    spark = raw.sparkSession
    seen = Observation("curated")
    y, hard_one = F.col("y"), F.col("is_hard_negative")
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"), F.count_if(hard_one).alias("hard_negative")]
    lengths = [F.avg("length").alias("mean_length"), F.percentile("length", F.lit(0.5)).alias("median_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length")]
    curated_rows(raw, hard, **limits).observe(seen, *counts, *lengths).write.mode("overwrite").parquet(f"{path}/curated")
    out = Curated(path, dict(seen.get))
    rows = out.rows(spark)
    write_csv(rows.withColumns({c: F.array_join(c, "|") for c in ("family_ids", "terms")}), f"{path}/metadata", drop=["text"], mode="overwrite")
    write_fasta(rows, f"{path}/sequences", "id", "text", ["y", "subcategory"], mode="overwrite")
    write_json(rows.groupBy("subcategory").agg(F.count("*").alias("n")), f"{path}/subcategories", mode="overwrite")

    positives = rows.where(y == 1)
    sims = simjoin.peer_max(positives, "id", kmers("text", 5) if items is None else items)
    told = Observation("splits")
    each = [F.count_if((F.col("split") == s) & (y == v)).alias(f"{s}|{v}") for s in SPLITS for v in (0, 1)]
    split = create_splits(rows, sims, "id", "y", "is_hard_negative", strata, small=small).observe(told, *each)
    split.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(f"{path}/splits")
    for key, n in told.get.items():
        name, v = key.split("|")
        out.splits.setdefault(name, {})["positive" if v == "1" else "negative"] = n
    write_json(spark.createDataFrame([tuple(out.stats.values())], ", ".join(f"{k} {'double' if 'mean' in k or 'median' in k else 'long'}" for k in out.stats)), f"{path}/stats", mode="overwrite")
    write_json(spark.createDataFrame([(s, n["positive"], n["negative"]) for s, n in out.splits.items()], "split string, positive long, negative long"), f"{path}/split_stats", mode="overwrite")
    return out
