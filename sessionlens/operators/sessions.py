"""Session rollup, pages, detail and growth."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import (
    complete_sum, difference_if_positive, guarded, nonnegative, ratio,
)
from ..sources.trace import Trace
from .views import (
    counted_blocks, latest_snapshots, request_context, request_ordinals, request_usage, short_fingerprint,
)


def session_rollup(trace: Trace) -> DataFrame:
    """One row per session, including sessions without requests."""
    facts = request_usage(trace).join(request_context(trace), "request_id", "left")
    rolled = facts.groupBy("session_id").agg(
        F.count("request_id").alias("request_count"),
        F.max("model").alias("model"),
        F.max("transport").alias("transport"),
        F.max(F.col("request_kind").startswith("compaction")).alias("__compaction"),
        complete_sum("input_total").alias("input_tokens"),
        complete_sum("input_cached").alias("cached_tokens"),
        complete_sum("input_uncached").alias("__uncached"),
        complete_sum("output_total").alias("output_tokens"),
        complete_sum("output_reasoning").alias("reasoning_tokens"),
        F.max_by("estimated_context", "request_id").alias("estimated_context_tokens"),
        F.sum("estimated_context").alias("__context"),
        F.sum("repeated_tokens").alias("__repeated"),
        F.sum("semantic_coverage_bp").alias("__coverage"),
        F.count("semantic_coverage_bp").alias("__covered"),
    )
    return trace.sessions.join(rolled, "session_id", "left").select(
        "session_id",
        "started_at",
        "ended_at",
        "state",
        F.coalesce("request_count", F.lit(0)).alias("request_count"),
        "model",
        "transport",
        F.coalesce("__compaction", F.lit(False)).alias("has_compaction"),
        "input_tokens",
        "cached_tokens",
        F.coalesce("__uncached", difference_if_positive("input_tokens", "cached_tokens")).alias("uncached_tokens"),
        "output_tokens",
        "reasoning_tokens",
        F.when(F.col("input_tokens") > 0, ratio("cached_tokens", "input_tokens")).alias("cache_ratio"),
        "estimated_context_tokens",
        F.when(F.col("__context") > 0, ratio("__repeated", "__context")).alias("repetition"),
        F.when(F.col("__covered") > 0, F.col("__coverage") / F.col("__covered") / 10000.0).alias(
            "semantic_coverage"
        ),
        guarded(F.unix_micros("ended_at") - F.unix_micros("started_at")).alias("duration_us"),
    )


@dataclass(frozen=True)
class SessionFilter:
    """Optional filters; a field left out does not filter."""

    model: str | None = None
    transport: str | None = None
    state: str | None = None
    has_compaction: bool | None = None
    started_from: datetime | str | None = None
    started_to: datetime | str | None = None
    session_id: object | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        for field in fields(self):
            wanted = getattr(self, field.name)
            if wanted is None:
                continue
            if field.name == "started_from":
                df = df.where(F.col("started_at") >= F.lit(wanted).cast("timestamp"))
            elif field.name == "started_to":
                df = df.where(F.col("started_at") <= F.lit(wanted).cast("timestamp"))
            else:
                df = df.where(F.col(field.name) == F.lit(wanted))
        return df


# Public sort names and the columns behind them.
SESSION_SORTS = {
    "created_at": "started_at",
    "request_count": "request_count",
    "input_tokens": "input_tokens",
    "cache_ratio": "cache_ratio",
    "estimated_context_tokens": "estimated_context_tokens",
    "repetition": "repetition",
}


def sort_column(sort: str, direction: str):
    """Allow-listed sort: NULL sorts as the smallest value."""
    if sort not in SESSION_SORTS:
        raise ValueError(f"sort must be one of {sorted(SESSION_SORTS)}, not {sort!r}")
    if direction not in ("asc", "desc"):
        raise ValueError(f"direction must be asc or desc, not {direction!r}")
    column = F.col(SESSION_SORTS[sort])
    return column.asc_nulls_first() if direction == "asc" else column.desc_nulls_last()


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page plus `next_offset`, which is NULL on the last page.

    One extra row is fetched to learn whether a next page exists.
    """
    fetched = df.orderBy(*order).offset(offset).limit(limit + 1)
    more = fetched.agg(F.count(F.lit(1)).alias("__fetched"))
    return (
        fetched.orderBy(*order)
        .limit(limit)
        .crossJoin(F.broadcast(more))
        .withColumn("next_offset", F.when(F.col("__fetched") > limit, F.lit(offset + limit).cast("bigint")))
        .drop("__fetched")
    )


def sessions_page(
    trace: Trace,
    filters: SessionFilter = SessionFilter(),
    sort: str = "created_at",
    direction: str = "desc",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    rows = filters.apply(session_rollup(trace))
    return page(rows, [sort_column(sort, direction), F.col("session_id").desc()], limit, offset)


def session_requests(trace: Trace) -> DataFrame:
    """Requests of every session with ordinal, status, usage and context size."""
    facts = request_usage(trace, request_ordinals(trace)).join(request_context(trace), "request_id", "left")
    uncached = F.coalesce("input_uncached", difference_if_positive("input_total", "input_cached"))
    return facts.select(
        "session_id",
        "request_id",
        "ordinal",
        F.col("request_kind").alias("kind"),
        "model",
        F.coalesce("attempt_status", "observation_status", F.lit("unknown")).alias("status"),
        guarded("input_total").alias("input_tokens"),
        guarded("input_cached").alias("cached_input_tokens"),
        guarded(uncached).alias("uncached_input_tokens"),
        ratio("input_cached", "input_total").alias("cache_ratio"),
        guarded("output_total").alias("output_tokens"),
        guarded("output_reasoning").alias("reasoning_tokens"),
        F.col("estimated_context").alias("estimated_context_tokens"),
        (F.col("semantic_coverage_bp") / 10000.0).alias("semantic_coverage"),
        guarded("duration_us").alias("duration_us"),
    )


def session_requests_page(trace: Trace, session_id, limit: int = 50, offset: int = 0) -> DataFrame:
    """One session's requests; the session filter reaches the scans because it is a plain predicate."""
    own = trace.replace(operations=trace.operations.where(F.col("session_id") == F.lit(session_id)))
    return page(session_requests(own), [F.col("request_id").asc()], limit, offset)


def context_growth(trace: Trace) -> DataFrame:
    """Growth series of every session: input, cached, uncached and estimated tokens by ordinal."""
    return session_requests(trace).select(
        "session_id", "ordinal", "input_tokens", "cached_input_tokens", "uncached_input_tokens",
        "estimated_context_tokens",
    )


def latest_effort(trace: Trace) -> DataFrame:
    """Latest known reasoning effort per session."""
    from .views import request_sessions

    known = request_sessions(trace).where(F.col("reasoning_effort").isNotNull())
    return known.groupBy("session_id").agg(F.max_by("reasoning_effort", "request_id").alias("reasoning_effort"))


def session_detail(trace: Trace, max_requests: int = 100) -> DataFrame:
    """Rollup, latest effort and the growth series over the first requests, as one row per session.

    The series is part of a top-k report: its length is bounded by `max_requests`.
    """
    series = (
        context_growth(trace)
        .where(F.col("ordinal") <= max_requests)
        .groupBy("session_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "ordinal", "input_tokens", "cached_input_tokens", "uncached_input_tokens",
                        "estimated_context_tokens",
                    )
                )
            ).alias("context_growth")
        )
    )
    return (
        session_rollup(trace)
        .join(latest_effort(trace), "session_id", "left")
        .join(series, "session_id", "left")
    )


def session_context_blocks(trace: Trace) -> DataFrame:
    """Blocks of each session's newest snapshot with repetition flags, ordinals ascending."""
    newest = trace.snapshots.groupBy("session_id").agg(
        F.max_by(
            F.struct("snapshot_id", "logical_context_status"), F.struct("provider_request_id", "analysis_version")
        ).alias("s")
    ).select("session_id", F.col("s.snapshot_id").alias("snapshot_id"),
             F.col("s.logical_context_status").alias("visibility"))
    return (
        counted_blocks(trace.blocks)
        .join(newest, "snapshot_id")
        .select(
            "session_id", "snapshot_id", "visibility", "block_id", "ordinal", "kind", "role", "origin",
            "detected_kind", nonnegative("raw_bytes").alias("raw_bytes"), "estimated_tokens",
            F.when(F.col("exact_fp").isNotNull(), F.col("exact_count") > 1).alias("exact_repeated"),
            F.when(F.col("semantic_fp").isNotNull(), F.col("semantic_count") > 1).alias("semantic_repeated"),
            "persistence",
            short_fingerprint("exact_fp").alias("fingerprint_short"),
        )
    )


def largest_blocks(trace: Trace, k: int = 10) -> DataFrame:
    """Top k blocks per latest snapshot by size, then ordinal and id.

    Each snapshot keeps a bounded list while it aggregates (k per partial group), so a snapshot with
    very many blocks is never ranked in one task.
    """
    latest = latest_snapshots(trace.snapshots).select("snapshot_id")
    candidates = trace.blocks.join(latest, "snapshot_id", "left_semi").withColumn(
        "__slice", F.pmod(F.xxhash64("block_id"), F.lit(64))
    )
    from pyspark.sql.window import Window

    order = [F.col("raw_bytes").desc(), F.col("ordinal").asc(), F.col("block_id").asc()]
    first = candidates.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("snapshot_id", "__slice").orderBy(*order))
    ).where(F.col("__rank") <= k)
    final = first.withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_id").orderBy(*order)))
    return final.where(F.col("rank") <= k).select(
        "snapshot_id", "rank", "block_id", "ordinal", "kind", "raw_bytes", "estimated_tokens"
    )


def first_sessions(trace: Trace, n: int) -> DataFrame:
    """The first n sessions by start time."""
    return trace.sessions.orderBy("started_at", "session_id").limit(n)


def inspection(trace: Trace) -> DataFrame:
    """One wide record per analysed request: the latest snapshot with its metrics and delta.

    Provider tokens are the reconciled value, else the usage of the final attempt.
    """
    latest = latest_snapshots(trace.snapshots)
    facts = request_usage(trace).select(
        F.col("request_id").alias("provider_request_id"), "model", "transport", "request_kind",
        "attempt_status", "input_total",
    )
    return (
        latest.join(facts, "provider_request_id")
        .join(trace.metrics, "snapshot_id", "left")
        .join(
            trace.deltas.withColumnRenamed("current_snapshot_id", "snapshot_id"), "snapshot_id", "left"
        )
        .select(
            "snapshot_id", "session_id", "provider_request_id", "analysis_version", "status",
            "logical_context_status", "model", "transport", "request_kind", "attempt_status",
            F.coalesce("provider_input_tokens", "input_total").alias("provider_tokens"),
            "visible_estimated_tokens", "semantic_coverage_bp", "repeated_blocks", "new_blocks",
            "changed_blocks", "removed_blocks", "repeated_tokens", "tool_count", "stable_prefix_estimate",
        )
    )
