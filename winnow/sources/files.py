"""Readers and writers: FASTA, CSV, JSON statistics and history, vectors, LaTeX rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, text of each record; a record's text may span lines, and a header may hold '>' (S6)."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\r", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return rows.select(F.trim(head).alias("header"), F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 2)"), r"\s", "").alias("text"))


def fasta_records(df: DataFrame, key: str, text: str, tags: list[str]) -> DataFrame:
    """Column record: '>id|tag|tag' and the text on the next line."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *tags)]
    return df.select(F.concat(F.lit(">"), F.concat_ws("|", *parts), F.lit("\n"), F.coalesce(text, F.lit(""))).alias("record"))


def write_fasta(df: DataFrame, path: str, key: str, text: str, tags: list[str], mode: str = "errorifexists") -> None:
    fasta_records(df, key, text, tags).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, drop: list[str] | None = None, mode: str = "errorifexists") -> None:
    """With a header, without the columns in drop."""
    df.drop(*(drop or [])).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode(mode).json(path)


def read_history(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """epoch and one column for each series, from one JSON object of parallel lists."""
    doc = spark.read.option("multiLine", True).schema(", ".join(f"{s} array<double>" for s in series)).json(path)
    zipped = doc.select(F.posexplode(F.arrays_zip(*series)).alias("epoch", "row"))
    return zipped.select("epoch", *[F.col(f"row.{s}").alias(s) for s in series])


def write_vectors(df: DataFrame, path: str) -> None:
    """(id, embedding array<float>) or (id, states array<array<float>>) as Parquet."""
    df.write.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table, or no rows where nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One LaTeX table row for each row, doubles with four digits."""
    cells = [F.format_string("%.4f", c) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.select(*columns).dtypes]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))


def interval_text(lo: str, hi: str, known: str):
    """Column '[lo, hi]' with four digits, '[N/A]' where the column `known` is false or a bound is missing."""
    return F.when(F.col(known) & F.col(lo).isNotNull() & F.col(hi).isNotNull(), F.format_string("[%.4f, %.4f]", lo, hi)).otherwise(F.lit("[N/A]"))


def append_positives(train: DataFrame, extra: DataFrame, key: str = "id", label: str = "y", held_out: DataFrame | None = None) -> DataFrame:
    """train and the extra rows, labelled positive (U2). An extra id that train already has, or held_out, the rows that anything is
    measured on, is an error: it would be trained on and tested. Null ids meet nothing."""
    for name, other in (("training", train), ("held-out", held_out)):
        both = extra.join(other, key, "left_semi").limit(1).collect() if other is not None else []
        if both:
            raise ValueError(f"{both[0][key]} is in both tables, the extra and the {name} rows")
    return train.unionByName(extra.withColumn(label, F.lit(1).cast(train.schema[label].dataType)), allowMissingColumns=True)
