"""What the operators of this folder share: reading tables, scratch tables, Arrow helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .packed import FILTER_BITS

#: A word, in Java, DuckDB and Python spelling alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame once into the shared folder and read it back; later uses never recompute it."""
    path = new_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(spark: SparkSession, frame: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """Like `stored`, with the rows dealt into buckets by a column, so that joins on it leave them where they are.
    Each task writes a file for every bucket of which it has rows: a frame dealt by the key makes a file a bucket."""
    path = new_folder(spark, purpose)
    name = path.rpartition("/")[2].replace("-", "_")
    frame.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def hex_number(text: Column, start: int) -> Column:
    """15 hex digits of the md5 of `text`, as a non-negative long."""
    return F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("long")


def fresh(frame: DataFrame, *wanted: str) -> list[str]:
    """Column names derived from `wanted` that the frame does not have (names compare without case)."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def common_bits(told: DataFrame) -> np.ndarray:
    """The filter that rows (common) with its places make: FILTER_BITS / 8 bytes, whatever the data."""
    words = told.where("common IS NOT NULL").groupBy((F.col("common") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(common % 32 AS int))")).alias("bits"))
    got = words.toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def may_be_among(frame: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows of `frame` whose `key` may stand in the column `key` of `known`: all that do, and some others, so that a
    join with `known` needs to move few rows. The filter has FILTER_BITS bits, whatever the data; null is never among them."""
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))
    words = known.where(F.col(key).isNotNull()).select(place.alias("place")).groupBy((F.col("place") / 64).cast("int").alias("word"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    [own] = fresh(frame, "words")
    one = frame.sparkSession.createDataFrame([(bits.tolist(),)], f"{own} array<long>")
    word = F.get(F.col(own), (place / 64).cast("int"))
    inside = F.col(key).isNotNull() & (F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return frame.join(F.broadcast(one), inside).drop(own)


def lowered(text: str) -> Column:
    """A text with A-Z as a-z and all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(text), upper, upper.lower())


def positions(frame: DataFrame, order: list[Column]) -> DataFrame:
    """`frame` (with a column `tree` that is never null) and its rows' `pos` in their tree, from 0, and the tree's `n` rows."""
    spark = frame.sparkSession
    sort = [F.col("tree").asc(), *order]
    ordered = frame.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered = stored(spark, ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    counts = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("shift", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).withColumn("n", F.sum("rows").over(Window.partitionBy("tree")))
    return ordered.join(counts.select("tree", "part", "shift", "n"), ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def apart(frame: DataFrame) -> DataFrame:
    """The frame with columns of its own, so that it can meet a frame that it comes from."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns])
