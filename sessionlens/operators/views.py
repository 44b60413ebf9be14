"""Reusable views: latest analysis, final attempt, request facts, fingerprint counts, block order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import or_label
from ..functions.ranking import group_counts, join_on_nullable, numbered
from ..sources.trace import Trace

HOUR_US = 3_600_000_000


def _best(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the greatest `order` per key.

    Written as an aggregate so that rows combine before the shuffle; a hot key costs no more than
    any other. Rows without a key belong to no group and are dropped.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    packed = F.struct(*order, *rest).alias("__row")
    best = df.where(F.col(key).isNotNull()).select(key, packed).groupBy(key).agg(
        F.max_by("__row", F.struct(*[F.col(f"__row.{c}") for c in order])).alias("__row")
    )
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in (*order, *rest)])


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Highest analysis version per request."""
    return _best(snapshots, "provider_request_id", "analysis_version", "snapshot_id")


def final_attempts(attempts: DataFrame) -> DataFrame:
    """Highest ordinal per request."""
    return _best(attempts, "request_id", "ordinal")


def request_sessions(trace: Trace) -> DataFrame:
    """Requests with the session of their operation."""
    return trace.requests.join(trace.operations.select("operation_id", "session_id"), "operation_id")


def request_usage(trace: Trace, requests: DataFrame | None = None) -> DataFrame:
    """Every request with its final attempt and that attempt's usage; missing parts stay NULL."""
    base = request_sessions(trace) if requests is None else requests
    final = final_attempts(trace.attempts).select(
        "request_id", "attempt_id", F.col("status").alias("attempt_status"), "duration_us"
    )
    counters = trace.usage.select(
        "attempt_id", "input_total", "input_cached", "input_uncached", "output_total", "output_reasoning"
    )
    return base.join(final, "request_id", "left").join(counters, "attempt_id", "left")


def request_context(trace: Trace) -> DataFrame:
    """Per request: token total of its latest snapshot, coverage and repeated tokens."""
    latest = latest_snapshots(trace.snapshots).select("snapshot_id", "provider_request_id")
    totals = trace.blocks.groupBy("snapshot_id").agg(F.sum("estimated_tokens").alias("estimated_context"))
    return (
        latest.join(totals, "snapshot_id", "left")
        .join(trace.metrics.select("snapshot_id", "semantic_coverage_bp"), "snapshot_id", "left")
        .join(
            trace.deltas.select(
                F.col("current_snapshot_id").alias("snapshot_id"), F.col("repeated_tokens")
            ),
            "snapshot_id",
            "left",
        )
        .select(
            F.col("provider_request_id").alias("request_id"),
            "estimated_context",
            "semantic_coverage_bp",
            "repeated_tokens",
        )
    )


def group_column(group: str) -> Column:
    """Composition may be grouped by four columns only."""
    allowed = {"detected_kind", "kind", "origin", "role"}
    if group not in allowed:
        raise ValueError(f"group must be one of {sorted(allowed)}, not {group!r}")
    return or_label(group)


def counted_blocks(blocks: DataFrame, pool_missing: bool = True) -> DataFrame:
    """Blocks with the number of rows sharing their exact, semantic and preferred fingerprint.

    Counts come from a pre-aggregated table joined back, not from a window: a popular fingerprint
    then spreads over all tasks (the count side has one row per fingerprint). Rows without any
    fingerprint count as one pool in `persistence` unless `pool_missing` is off.
    """
    preferred = F.coalesce("semantic_fp", "exact_fp")
    exact = group_counts(blocks.where(F.col("exact_fp").isNotNull()), F.col("exact_fp"), "exact_count")
    semantic = group_counts(
        blocks.where(F.col("semantic_fp").isNotNull()), F.col("semantic_fp"), "semantic_count"
    )
    keyed = blocks.where(preferred.isNotNull())
    shared = group_counts(keyed, preferred, "persistence")
    out = (
        blocks.withColumn("__preferred", preferred)
        .join(exact, F.col("exact_fp") == F.col("exact_count_key"), "left")
        .join(semantic, F.col("semantic_fp") == F.col("semantic_count_key"), "left")
        .join(shared, F.col("__preferred") == F.col("persistence_key"), "left")
        .drop("exact_count_key", "semantic_count_key", "persistence_key")
    )
    if pool_missing:
        pool = blocks.where(preferred.isNull()).agg(F.count(F.lit(1)).alias("__pool"))
        out = (
            out.crossJoin(F.broadcast(pool))
            .withColumn(
                "persistence",
                F.when(F.col("__preferred").isNull(), F.col("__pool")).otherwise(F.col("persistence")),
            )
            .drop("__pool")
        )
    return out.drop("__preferred")


def tool_identity() -> Column:
    """Tool name, or its hash where the name was cut, or NULL."""
    return F.when(
        ~F.col("tool_name_truncated") & F.col("tool_name").isNotNull(), F.concat(F.lit("name:"), "tool_name")
    ).when(
        F.col("tool_name_truncated") & F.col("tool_name_hash").isNotNull(),
        F.concat(F.lit("hash:"), "tool_name_hash"),
    )


def time_bucket(column: str, width: int = HOUR_US) -> Column:
    """Bucket of a nullable time column for orderings with NULLs last."""
    return F.coalesce(F.floor(F.col(column) / width), F.lit(9223372036854775807))


def ordered_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots with `snapshot_order`; a table that was numbered at ingest is taken as it is."""
    return snapshots if "snapshot_order" in snapshots.columns else number_snapshots(snapshots)


#: Snapshots of a session that one task may number.
LARGE_SESSION = 1 << 18


def number_snapshots(snapshots: DataFrame, tasks: int | None = None) -> DataFrame:
    """0-based place of each snapshot in its session: start time, unknown last, then id. An ingest step: its result is
    stored with the snapshots, and every analysis of neighbours, windows and lineages reads it."""
    out = numbered(
        snapshots,
        ["session_id"],
        [F.col("started_at_us").asc_nulls_last(), F.col("snapshot_id").asc()],
        "snapshot_order",
        time_bucket("started_at_us"),
        most=LARGE_SESSION,
        tasks=tasks,
    )
    return out.withColumn("snapshot_order", F.col("snapshot_order") - 1)


def placed_blocks(trace: Trace) -> DataFrame:
    """Blocks with session, request and snapshot order."""
    place = ordered_snapshots(trace.snapshots).select(
        "snapshot_id", "session_id", "provider_request_id", "snapshot_order"
    )
    return trace.blocks.join(place, "snapshot_id")


def request_ordinals(trace: Trace) -> DataFrame:
    """1-based request ordinal within the session, in id order (ids are time ordered)."""
    return numbered(
        request_sessions(trace),
        ["session_id"],
        [F.col("request_id").asc()],
        "ordinal",
        F.floor(F.col("request_id").cast("bigint") / 4096),
    )


def short_fingerprint(column: str) -> Column:
    """First five bytes in hex and an ellipsis, for display."""
    return F.concat(F.lower(F.substring(column, 1, 10)), F.lit("…"))


def with_group_total(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Join a per-group total of an already aggregated frame."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias(name))
    return join_on_nullable(df, totals, keys)
