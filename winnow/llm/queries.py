"""Queries and SQL of this package's operators, added by the driver contract if the package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winnow.llm.html_text import op12_html_text
from winnow.llm.merkle import op13_merkle
from winnow.llm.mixing import op5_mixing
from winnow.llm.packing import op4_packing
from winnow.llm.pii import op8_pii
from winnow.llm.quality import op10_quality
from winnow.llm.resampling import op11_resampling
from winnow.llm.setjoin import op6_near_dedup
from winnow.llm.sql import oracle_sql as _sql
from winnow.llm.suffixes import op7_suffix_dedup
from winnow.llm.syncmers import op3_fingerprints
from winnow.llm.token_files import op2_token_files
from winnow.llm.toxicity import op1_toxicity
from winnow.llm.warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_fingerprints, op4_packing, op5_mixing, op6_near_dedup, op7_suffix_dedup, op8_pii, op9_warc, op10_quality, op11_resampling, op12_html_text, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return _sql()
