"""op5: the 20 nearest vectors of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .neighbours import nearest
from .queries import query


@query("op5_neighbours")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
