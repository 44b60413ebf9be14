"""op10: all documents mixed by source weights 1, 2, 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import stored, table
from .mixing import mix, word_count
from .queries import query


@query("op10_mix")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"))
    return mix(stored(spark, sized, "sizes"))
