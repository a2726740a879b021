"""From raw documents to packed training windows, stage by stage; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.llm.common import saved
from winnow.llm.mixing import mixing_stage
from winnow.llm.packing import packing_stage
from winnow.llm.pii import pii_stage
from winnow.llm.setjoin import near_dedup_stage
from winnow.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained scores, keyed permutations and online packing are beyond SQL; tests/llm/test_plain.py holds stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows, pieces of documents with their ids.

    Rows with nulls, empty or very long texts and repeated rows go through like others: near-duplicate detection keeps one of
    those that repeat id and text, no other stage drops them. Empty documents give no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
