"""op9: passages of 100 bytes that stand earlier in the corpus removed from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .queries import query
from .suffixes import without_repeats


@query("op9_repeats")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
