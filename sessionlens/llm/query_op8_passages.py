"""op8: licence statements anywhere in the words of every document, across lines and beside other words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licences import passages
from .queries import query
from .query_op8 import LEAST, TEMPLATES


@query("op8_passages")
def licence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"), TEMPLATES, LEAST)
