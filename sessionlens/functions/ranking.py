"""Exact ranks and percentiles that never gather a hot group into one task.

All helpers use the same two-level scheme. A `bucket` column, monotone in the ordering, cuts each
group into pieces; pieces are ranked on their own, and piece sizes (a pre-aggregated table with one
row per group and bucket) give the offset of each piece. A group holding a third of all rows is
thus spread over as many tasks as it has buckets, and the result is the same as one big window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_on_nullable(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that treats NULL keys as equal and keeps only the left copy of the keys."""
    renamed = right
    condition = None
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
        term = left[key].eqNullSafe(F.col(f"__r_{key}"))
        condition = term if condition is None else condition & term
    if condition is None:
        return left.crossJoin(renamed)  # `right` is a one-row aggregate here
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def _flag_descending(order: Column, descending: bool) -> Column:
    return order.desc() if descending else order.asc()


def by_size(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of up to `most` rows, and rows of larger ones. The keys of the large groups are broadcast: there
    are fewer than one for every `most` rows."""
    renamed = [f"__l_{key}" for key in keys]
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    large = F.broadcast(large.select(*[F.col(key).alias(new) for key, new in zip(keys, renamed)]))
    same = reduce(and_, [df[key].eqNullSafe(F.col(new)) for key, new in zip(keys, renamed)])
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def _in_buckets(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, bucket: Column, descending: bool) -> DataFrame:
    """Running total of `value` inside each group, computed bucket by bucket: the rows are used twice, once for the
    bucket sizes and once for the windows, which stay where the join with the offsets has put them."""
    staged = rows.withColumn("__bucket", bucket).withColumn("__value", value)
    by_bucket = _flag_descending(F.col("__bucket"), descending)
    ahead = Window.partitionBy(*keys).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*keys, "__bucket")
        .agg(F.sum("__value").alias("__size"))
        .select(*keys, "__bucket", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead"))
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_on_nullable(staged, offsets, [*keys, "__bucket"])
    return joined.withColumn(name, F.sum("__value").over(inside) + F.col("__ahead")).drop("__bucket", "__ahead", "__value")


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "row_number",
    bucket: Column | None = None,
    descending: bool = False,
    most: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add the 1-based row number of each row inside its group.

    `bucket` must not decrease along `order` (not increase with `descending=True`). Without a
    bucket a plain window is used: only for groups whose size the data model bounds. `order` must be
    a total order, which row numbers need anyway to be reproducible.

    Buckets cost two more shuffles and one more sort of all rows. With `most`, groups of up to so many rows take the
    plain window and only larger ones their buckets; the rows are read three times, so this is for tables, not for
    frames that are dear to derive. `tasks` deals the small groups to so many tasks where that is more than the session's
    shuffle partitions, so that a task's rows fit its memory however large the table is.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if most is not None:
        small, large = by_size(df, keys, most)
        if tasks and tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            small = small.repartition(tasks, *keys)
        cut = _in_buckets(large, keys, order, F.lit(1).cast("bigint"), name, bucket, descending)
        # buckets come first here too: rows without one stand where `_in_buckets` puts them
        whole = Window.partitionBy(*keys).orderBy(_flag_descending(bucket, descending), *order)
        return small.withColumn(name, F.row_number().over(whole).cast("bigint")).unionByName(cut)
    return _in_buckets(df, keys, order, F.lit(1).cast("bigint"), name, bucket, descending)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: Column,
    name: str,
    bucket: Column,
) -> DataFrame:
    """Add the running total of `value` up to and including each row."""
    return _in_buckets(df, keys, order, value, name, bucket, False)


@dataclass(frozen=True)
class Rank:
    """One percentile to compute. The rules differ on purpose and must not be mixed:

    linear      interpolate between the neighbours of (n-1)*p
    floor       value at index floor((n-1)*p), p a fraction
    floor_int   value at index (n-1)*p div 100, p a whole percentage
    ceil        value at 1-based rank ceil(n*p)
    middle      value at index (n-1) div 2
    truncated   value at index min(n-1, floor(n*p))
    """

    name: str
    p: float
    rule: str = "linear"

    def bounds(self, n: Column) -> tuple[Column, Column, Column]:
        """Lower index, upper index and the weight of the upper one."""
        last = n - 1
        if self.rule == "linear":
            position = last.cast("double") * F.lit(float(self.p))
            low = F.floor(position)
            return low, F.ceil(position), position - low
        if self.rule == "floor":
            index = F.floor(last.cast("double") * F.lit(float(self.p)))
        elif self.rule == "floor_int":
            index = F.floor(last * F.lit(int(self.p)) / 100)
        elif self.rule == "ceil":
            # 0.999999 instead of 1 keeps an exact product from being pushed up a rank.
            rank = F.floor(n.cast("double") * F.lit(float(self.p)) + F.lit(0.999999))
            index = F.least(last, F.greatest(rank - 1, F.lit(0)))
        elif self.rule == "middle":
            index = F.floor(last / 2)
        elif self.rule == "truncated":
            index = F.least(last, F.floor(n.cast("double") * F.lit(float(self.p))))
        else:
            raise ValueError(f"unknown rank rule {self.rule!r}")
        return index, index, F.lit(0.0)


DISTRIBUTION = [
    Rank("p50", 0.50),
    Rank("p75", 0.75),
    Rank("p90", 0.90),
    Rank("p95", 0.95),
    Rank("p99", 0.99),
]


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: list[Rank],
    width: float = 4096,
    with_max: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Exact percentiles per group: `keys`, `count`, one column per rank, optionally `max`. With `weight`, a row stands for
    so many.

    Rows collapse first to one row per (group, value) with map-side combining. Values are then cut
    into ranges of `width`, so a whole-numbered group never puts more than `width` rows into one
    window partition, however many rows it holds.
    """
    histogram = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
        .withColumn("__bucket", F.floor(F.col("__v") / F.lit(width)))
    )
    ahead = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        histogram.groupBy(*keys, "__bucket")
        .agg(F.sum("__n").alias("__size"))
        .select(
            *keys,
            "__bucket",
            F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead"),
            F.sum("__size").over(whole).alias("__total"),
        )
    )
    inside = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = join_on_nullable(histogram, offsets, [*keys, "__bucket"]).withColumn(
        "__end", F.sum("__n").over(inside) + F.col("__ahead")
    )
    start, end = F.col("__end") - F.col("__n"), F.col("__end")
    picks = [F.coalesce(F.max("__total"), F.lit(0)).alias("count")]
    for rank in ranks:
        low, high, _ = rank.bounds(F.col("__total"))
        picks.append(F.max(F.when((start <= low) & (low < end), F.col("__v"))).alias(f"__lo_{rank.name}"))
        if rank.rule == "linear":
            picks.append(
                F.max(F.when((start <= high) & (high < end), F.col("__v"))).alias(f"__hi_{rank.name}")
            )
    if with_max:
        picks.append(F.max("__v").cast("double").alias("max"))
    picked = ranked.groupBy(*keys).agg(*picks)
    out = [*keys, "count"]
    for rank in ranks:
        low_value = F.col(f"__lo_{rank.name}")
        if rank.rule == "linear":
            _, _, weight = rank.bounds(F.col("count"))
            low_value = low_value.cast("double")
            high_value = F.col(f"__hi_{rank.name}").cast("double")
            out.append((low_value + (high_value - low_value) * weight).alias(rank.name))
        else:
            out.append(low_value.alias(rank.name))
    if with_max:
        out.append("max")
    return picked.select(*out)


def distribution(df: DataFrame, keys: list[str], value: str, width: float = 4096, weight: str | None = None) -> DataFrame:
    """count, p50, p75, p90, p95, p99 (interpolated) and max of `value` per group."""
    return exact_percentiles(df, keys, value, DISTRIBUTION, width, with_max=True, weight=weight)


def group_counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows per key value as (`name`_key, `name`); combined map-side, so hot keys are harmless."""
    return df.groupBy(key.alias(f"{name}_key")).agg(F.count(F.lit(1)).alias(name))
