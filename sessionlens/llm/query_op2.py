"""op2: components of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard import near_duplicates
from .queries import query


@query("op2_near_duplicates")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
