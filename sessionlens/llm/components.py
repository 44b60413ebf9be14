"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(v, m): for every vertex of `edges` (u, v long) but the least of each component that least vertex.

    Each round hangs the neighbours of a vertex on its least neighbour, first the larger ones, then
    the smaller ones; the number of rounds grows with the logarithm of the component size. A vertex
    with very many neighbours only meets a minimum combined before the shuffle and a join that
    adaptive execution may split. Every round is written to the shared folder, so lineage stays
    short. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    now = stored(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = _least(large)
        small = large.join(m, "u")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        now = stored(spark, hung, "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("u").alias("v"), F.col("v").alias("m"))
        mark = seen
