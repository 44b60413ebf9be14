"""Composition of context: groups, matrices, coverage, unknown content, workload mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_where, nonnegative, or_label, or_unknown, ratio
from ..functions.ranking import Rank, distribution, exact_percentiles, group_counts
from ..sources.trace import Trace
from .views import counted_blocks, group_column


def _with_total(df: DataFrame, **totals: str) -> DataFrame:
    """Attach grand totals (a one-row aggregate of an already grouped frame)."""
    row = df.agg(*[F.sum(value).alias(name) for name, value in totals.items()])
    return df.crossJoin(F.broadcast(row))


def composition(blocks: DataFrame, group: str = "detected_kind", pool_missing: bool = True) -> DataFrame:
    """Blocks, bytes, tokens, share, repeated tokens and mean persistence per group."""
    column = group_column(group)
    repeated = lambda fp, count: F.sum(
        F.when(F.col(fp).isNotNull() & (F.col(count) > 1), F.col("estimated_tokens"))
    )
    grouped = counted_blocks(blocks, pool_missing).groupBy(column.alias("name")).agg(
        F.count(F.lit(1)).alias("block_count"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
        repeated("exact_fp", "exact_count").alias("exact_repeated_tokens"),
        repeated("semantic_fp", "semantic_count").alias("semantic_repeated_tokens"),
        F.avg(F.col("persistence").cast("double")).alias("persistence"),
        F.count("estimated_tokens").alias("__estimated"),
    )
    total = _with_total(grouped, __tokens="estimated_tokens", __blocks="block_count", __known="__estimated")
    return total.select(
        "name",
        "block_count",
        nonnegative("raw_bytes").alias("raw_bytes"),
        "estimated_tokens",
        F.when(F.col("__tokens") > 0, ratio("estimated_tokens", "__tokens")).alias("estimated_token_share"),
        "exact_repeated_tokens",
        "semantic_repeated_tokens",
        "persistence",
        ratio("__known", "__blocks").alias("estimator_coverage"),
    )


def snapshot_composition(blocks: DataFrame) -> DataFrame:
    """Composition by detected kind inside every snapshot."""
    grouped = blocks.groupBy("snapshot_id", or_label("detected_kind").alias("name")).agg(
        F.count(F.lit(1)).alias("block_count"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
        F.count("estimated_tokens").alias("__estimated"),
    )
    # At most one row per detected kind and snapshot is left, so this window is small.
    from pyspark.sql.window import Window

    whole = Window.partitionBy("snapshot_id")
    tokens = F.sum("estimated_tokens").over(whole)
    return grouped.select(
        "snapshot_id",
        "name",
        "block_count",
        nonnegative("raw_bytes").alias("raw_bytes"),
        "estimated_tokens",
        F.when(tokens > 0, ratio("estimated_tokens", tokens)).alias("estimated_token_share"),
        ratio(F.sum("__estimated").over(whole), F.sum("block_count").over(whole)).alias("estimator_coverage"),
    )


def origin_matrix(blocks: DataFrame) -> DataFrame:
    """Origin by detected kind with the share of all estimated tokens."""
    cells = blocks.groupBy("origin", or_label("detected_kind").alias("detected_kind")).agg(
        F.count(F.lit(1)).alias("block_count"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
    )
    return _with_total(cells, __tokens="estimated_tokens").select(
        "origin", "detected_kind", "block_count", nonnegative("raw_bytes").alias("raw_bytes"), "estimated_tokens",
        ratio("estimated_tokens", "__tokens").alias("estimated_token_share"),
    )


def origin_pivot(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """The same matrix with one token column per detected kind."""
    return (
        blocks.withColumn("detected_kind", or_label("detected_kind"))
        .groupBy("origin")
        .pivot("detected_kind", kinds)
        .agg(F.sum("estimated_tokens"))
    )


def unknown_summary(blocks: DataFrame) -> DataFrame:
    """Counts, coverage, distinct fingerprints, floor-rank sizes and mean persistence of unknown content."""
    unknown = blocks.where(F.coalesce("detected_kind", F.lit("unknown")) == "unknown")
    preferred = F.coalesce("semantic_fp", "exact_fp")
    # mean of count-per-row = sum of squared group sizes over rows; NULL keys are one group.
    sizes = unknown.groupBy(preferred.alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    persistence = sizes.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("persistence"))
    distinct = lambda column, name: (
        unknown.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("one"))
        .agg(F.count(F.lit(1)).alias(name))
    )
    totals = unknown.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
        ratio(F.count("estimated_tokens"), F.count(F.lit(1))).alias("estimator_coverage"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"),
    )
    ranks = [Rank("p50", 0.5, "floor"), Rank("p90", 0.9, "floor"), Rank("p99", 0.99, "floor")]
    sizes_at = exact_percentiles(unknown, [], "raw_bytes", ranks).drop("count")
    return (
        totals.crossJoin(distinct("exact_fp", "unique_exact_fingerprints"))
        .crossJoin(distinct("semantic_fp", "unique_semantic_fingerprints"))
        .crossJoin(sizes_at)
        .crossJoin(persistence)
    )


def subtotal_by(blocks: DataFrame, key: str) -> DataFrame:
    """Plain subtotals per key (a missing value adds nothing), with token and byte shares."""
    grouped = blocks.groupBy(or_unknown(key).alias("name")).agg(
        F.count(F.lit(1)).alias("block_count"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_tokens"),
    )
    return _with_total(grouped, __t="estimated_tokens", __b="bytes").select(
        "name", "block_count", "bytes", "estimated_tokens",
        ratio("estimated_tokens", "__t").alias("token_share"), ratio("bytes", "__b").alias("bytes_share"),
    )


def estimation_coverage(blocks: DataFrame, key: str) -> DataFrame:
    """Which groups contribute estimable blocks and bytes."""
    known = F.col("estimated_tokens").isNotNull()
    grouped = blocks.groupBy(or_unknown(key).alias("name")).agg(
        F.count(F.lit(1)).alias("block_count"),
        count_where(known).alias("estimated_block_count"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum(F.when(known, F.col("raw_bytes"))), F.lit(0)).alias("estimated_raw_bytes"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_tokens"),
    )
    return _with_total(grouped, __t="estimated_tokens").select(
        "name", "block_count", "estimated_block_count", "raw_bytes", "estimated_raw_bytes", "estimated_tokens",
        ratio("estimated_block_count", "block_count").alias("block_coverage"),
        ratio("estimated_raw_bytes", "raw_bytes").alias("bytes_coverage"),
        ratio("estimated_tokens", "__t").alias("estimated_token_share"),
    )


def cross_tab(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Composition over several keys with a readable composed name."""
    grouped = blocks.groupBy(*[or_unknown(k).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("block_count"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_tokens"),
    )
    name = F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in keys])
    return _with_total(grouped, __t="estimated_tokens", __b="raw_bytes").select(
        *keys, name.alias("name"), "block_count", "raw_bytes", "estimated_tokens",
        ratio("estimated_tokens", "__t").alias("token_share"), ratio("raw_bytes", "__b").alias("bytes_share"),
    )


def _labelled(trace: Trace) -> DataFrame:
    """Blocks with session and workload label; a session without a label is `unknown`."""
    place = trace.snapshots.select("snapshot_id", "session_id")
    labels = trace.workloads.select("session_id", "workload")
    return (
        trace.blocks.join(place, "snapshot_id")
        .join(labels, "session_id", "left")
        .withColumn("workload", or_unknown("workload"))
        .withColumn("detected", or_unknown("detected_kind"))
    )


def workload_composition(trace: Trace) -> DataFrame:
    """Token and byte composition per workload and content kind, with workload totals and shares."""
    cells = _labelled(trace).groupBy("workload", "session_id", "detected").agg(
        F.count(F.lit(1)).alias("block_count"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_tokens"),
    )
    content = cells.groupBy("workload", "detected").agg(
        F.sum("block_count").alias("block_count"), F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
    )
    per_session = cells.groupBy("workload", "session_id").agg(
        F.sum("raw_bytes").alias("b"), F.sum("estimated_tokens").alias("t")
    )
    by_workload = per_session.groupBy("workload").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("t").alias("workload_tokens"), F.sum("b").alias("workload_bytes")
    )
    totals = by_workload.agg(F.sum("workload_tokens").alias("__t"), F.sum("workload_bytes").alias("__b"))
    sessions = trace.snapshots.select("session_id").distinct().agg(F.count(F.lit(1)).alias("__sessions"))
    return (
        content.join(by_workload, "workload")
        .crossJoin(F.broadcast(totals))
        .crossJoin(F.broadcast(sessions))
        .select(
            "workload", F.col("detected").alias("name"), "block_count", "raw_bytes", "estimated_tokens",
            ratio("estimated_tokens", "workload_tokens").alias("token_share"),
            ratio("raw_bytes", "workload_bytes").alias("bytes_share"),
            "session_count", ratio("session_count", "__sessions").alias("session_share"),
            ratio("workload_tokens", "__t").alias("workload_token_share"),
            ratio("workload_bytes", "__b").alias("workload_bytes_share"),
        )
    )


def session_weighted_composition(trace: Trace) -> DataFrame:
    """Mean over sessions of each kind's share of the session; a kind a session lacks counts as 0.

    The mean is the sum of the shares that exist over the number of sessions with estimates, so no
    session-by-kind grid is built.
    """
    cells = (
        _labelled(trace)
        .where(F.col("estimated_tokens").isNotNull())
        .groupBy("session_id", "detected")
        .agg(F.sum("estimated_tokens").alias("tokens"))
    )
    totals = cells.groupBy("session_id").agg(F.sum("tokens").alias("total"))
    estimated = totals.where("total > 0").agg(F.count(F.lit(1)).alias("sessions_with_estimates"))
    shares = cells.join(totals, "session_id")
    return (
        shares.groupBy(F.col("detected").alias("name"))
        .agg(F.sum(F.when(F.col("total") > 0, F.col("tokens") / F.col("total"))).alias("__share"))
        .crossJoin(F.broadcast(estimated))
        .select(
            "name",
            "sessions_with_estimates",
            F.when(
                F.col("sessions_with_estimates") > 0,
                F.coalesce("__share", F.lit(0.0)) / F.col("sessions_with_estimates"),
            ).alias("mean_session_token_share"),
        )
    )


def kind_distribution(blocks: DataFrame, value: str) -> DataFrame:
    """Size distribution per block kind."""
    return distribution(blocks.select(or_unknown("kind").alias("name"), value), ["name"], value)


def unknown_report(trace: Trace) -> DataFrame:
    """Size distributions and per-session fingerprint frequencies of unknown content, as one row."""
    place = trace.snapshots.select("snapshot_id", "session_id")
    blocks = trace.blocks.join(place, "snapshot_id", "left")
    unknown = blocks.where(or_unknown("detected_kind") == "unknown").withColumn(
        "size", F.coalesce("raw_bytes", F.lit(0))
    )
    def frequency(column: str, prefix: str) -> DataFrame:
        per_key = unknown.where(F.col(column).isNotNull()).groupBy("session_id", column).agg(
            F.count(F.lit(1)).alias("n")
        )
        return per_key.agg(
            F.count(F.lit(1)).alias(f"{prefix}_unique"),
            F.coalesce(F.max("n"), F.lit(0)).alias(f"{prefix}_max_frequency"),
            F.avg("n").alias(f"{prefix}_average_frequency"),
        )

    def named(value: str, prefix: str) -> DataFrame:
        spread = distribution(unknown, [], value)
        return spread.select(*[F.col(c).alias(f"{prefix}_{c}") for c in spread.columns])

    totals = unknown.agg(
        F.count(F.lit(1)).alias("block_count"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_tokens"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("raw_bytes"),
    )
    overall = trace.blocks.agg(F.sum("estimated_tokens").alias("__all"))
    return (
        totals.crossJoin(overall)
        .withColumn("token_share", ratio("estimated_tokens", "__all"))
        .drop("__all")
        .crossJoin(named("size", "bytes"))
        .crossJoin(named("estimated_tokens", "tokens"))
        .crossJoin(frequency("exact_fp", "exact"))
        .crossJoin(frequency("semantic_fp", "semantic"))
    )


def repetition_summary(blocks: DataFrame) -> DataFrame:
    """Share of tokens in fingerprints seen more than once anywhere, exact and semantic.

    Works on per-fingerprint aggregates only: a fingerprint with more than one estimated row
    contributes all its tokens. No row-level join or window is needed.
    """
    known = blocks.where(F.col("estimated_tokens").isNotNull())

    def repeated(column: str, name: str) -> DataFrame:
        per_key = known.where(F.col(column).isNotNull()).groupBy(column).agg(
            F.count(F.lit(1)).alias("n"), F.sum("estimated_tokens").alias("t")
        )
        return per_key.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("t"))), F.lit(0)).alias(name))

    return (
        known.agg(F.sum("estimated_tokens").alias("total_tokens"))
        .crossJoin(repeated("exact_fp", "exact_repeated_tokens"))
        .crossJoin(repeated("semantic_fp", "semantic_repeated_tokens"))
        .select(
            "total_tokens", "exact_repeated_tokens", "semantic_repeated_tokens",
            ratio("exact_repeated_tokens", "total_tokens").alias("exact_token_share"),
            ratio("semantic_repeated_tokens", "total_tokens").alias("semantic_token_share"),
        )
    )


def fingerprint_counts(blocks: DataFrame, column: str) -> DataFrame:
    """Occurrences per fingerprint (all sessions)."""
    return group_counts(blocks.where(F.col(column).isNotNull()), F.col(column), "occurrences").withColumnRenamed(
        "occurrences_key", "fingerprint"
    )
