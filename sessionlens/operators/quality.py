"""Measurement quality, overview, tool surface and measurement coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import basis_points, complete_sum, count_where, ratio
from ..sources.trace import Trace
from .composition import repetition_summary
from .usage import total_usage
from .views import latest_snapshots, request_sessions, tool_identity


def measurement_quality(trace: Trace) -> DataFrame:
    """Counts by status over latest snapshots, coverage ratios and the reasons for degradation."""
    latest = latest_snapshots(trace.snapshots).join(
        trace.metrics.select("snapshot_id", "semantic_coverage_bp"), "snapshot_id", "left"
    )
    counts = latest.agg(
        count_where(F.col("status") == "complete").alias("complete"),
        count_where(F.col("status") == "partial").alias("partial"),
        count_where(F.col("status") == "dropped").alias("dropped"),
        count_where(F.col("logical_context_status") == "malformed").alias("malformed"),
        count_where(F.col("correlation_status") == "correlated").alias("correlated"),
        F.sum("semantic_coverage_bp").alias("__bp"),
        F.count("semantic_coverage_bp").alias("__rows"),
    )
    requests = trace.requests.agg(F.count(F.lit(1)).alias("requests"))
    missing = F.col("requests") - F.col("complete")
    reasons = F.filter(
        F.array(
            F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" requests missing complete context analysis"))),
            F.when(
                F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(" context analyses dropped"))
            ),
            F.when(
                F.col("malformed") > 0,
                F.concat(F.col("malformed").cast("string"), F.lit(" malformed context observations")),
            ),
        ),
        lambda reason: reason.isNotNull(),
    )
    return counts.crossJoin(requests).select(
        "requests", "complete", "partial", "dropped", "malformed",
        F.when(F.size(reasons) == 0, "healthy").otherwise("degraded").alias("quality_status"),
        ratio("complete", "requests").alias("analysis_coverage"),
        ratio("correlated", F.col("complete") + F.col("partial")).alias("correlation_coverage"),
        F.when(F.col("__rows") > 0, F.col("__bp") / (F.col("__rows") * 10000.0)).alias("semantic_coverage"),
        reasons.alias("reasons"),
    )


def overview(trace: Trace) -> DataFrame:
    """Session and request counts with usage, repetition and quality, as one row."""
    sessions = trace.sessions.agg(F.count(F.lit(1)).alias("session_count"))
    return (
        sessions.crossJoin(total_usage(trace))
        .crossJoin(repetition_summary(trace.blocks))
        .crossJoin(measurement_quality(trace).drop("requests"))
    )


def tool_surface(trace: Trace, complete_values: tuple[str, ...] = ("complete", "explicit_only")) -> DataFrame:
    """Exposed tool schemas and, where identity coverage is complete, defined, used and unused tools."""
    latest = latest_snapshots(trace.snapshots)
    schema_parts = ["tool_count", "schema_bytes", "estimated_schema_tokens", "repeated_schema_tokens"]
    observed = F.lit(True)
    for part in schema_parts:
        observed = observed & F.col(part).isNotNull()
    schemas = latest.join(trace.metrics.select("snapshot_id", *schema_parts), "snapshot_id", "left").agg(
        F.count(F.lit(1)).alias("snapshots"),
        count_where(observed).alias("schema_observations"),
        *[F.sum(F.when(observed, F.col(part))).alias(part) for part in schema_parts],
        count_where(
            (F.col("status") == "complete")
            & F.col("explicit_request_complete")
            & F.col("logical_context_status").isin(*complete_values)
            & (F.col("correlation_status") == "correlated")
        ).alias("__complete"),
    )
    blocks = (
        trace.blocks.where(F.col("kind").isin("tool_definition", "tool_call"))
        .join(latest.select("snapshot_id", "session_id"), "snapshot_id")
        .select("session_id", "kind", tool_identity().alias("tool"))
    )
    is_definition, is_call = F.col("kind") == "tool_definition", F.col("kind") == "tool_call"
    # One row per (session, tool) says whether the tool was defined and used: distinct counts and the
    # anti join between the two sets all come from this one aggregate.
    tools = blocks.groupBy("session_id", "tool").agg(
        count_where(is_definition).alias("defined"), count_where(is_call).alias("called")
    )
    named = F.col("tool").isNotNull()
    counts = tools.agg(
        F.coalesce(F.sum("defined"), F.lit(0)).alias("__definitions"),
        F.coalesce(F.sum(F.when(named, F.col("defined"))), F.lit(0)).alias("__named_definitions"),
        F.coalesce(F.sum("called"), F.lit(0)).alias("tool_calls"),
        F.coalesce(F.sum(F.when(named, F.col("called"))), F.lit(0)).alias("__named_calls"),
        count_where(named & (F.col("defined") > 0)).alias("__defined"),
        count_where(named & (F.col("called") > 0)).alias("__used"),
        count_where(named & (F.col("defined") > 0) & (F.col("called") == 0)).alias("__unused"),
    )
    session_requests = request_sessions(trace).join(
        latest.select("session_id"), "session_id", "left_semi"
    ).agg(F.count(F.lit(1)).alias("__session_requests"))
    complete = (
        (F.col("__definitions") > 0)
        & (F.col("snapshots") > 0)
        & (F.col("snapshots") == F.col("__complete"))
        & (F.col("snapshots") == F.col("__session_requests"))
        & (F.col("__definitions") == F.col("__named_definitions"))
        & (F.col("tool_calls") == F.col("__named_calls"))
    )
    return (
        schemas.crossJoin(counts)
        .crossJoin(session_requests)
        .select(
            F.col("snapshots").alias("requests_observed"),
            "schema_observations",
            basis_points("schema_observations", "snapshots").alias("schema_coverage_bp"),
            F.col("tool_count").alias("tool_definitions_exposed"),
            "schema_bytes",
            "estimated_schema_tokens",
            "repeated_schema_tokens",
            basis_points("repeated_schema_tokens", "estimated_schema_tokens").alias("repeated_schema_share_bp"),
            "tool_calls",
            complete.alias("identity_coverage_complete"),
            F.when(complete, F.col("__defined")).alias("distinct_defined_tools"),
            F.when(complete, F.col("__used")).alias("distinct_used_tools"),
            F.when(complete, F.col("__unused")).alias("unused_tools_lower_bound"),
        )
    )


def unused_tools(trace: Trace) -> DataFrame:
    """Tools a session defines but never calls."""
    latest = latest_snapshots(trace.snapshots).select("snapshot_id", "session_id")
    tools = trace.blocks.join(latest, "snapshot_id").select("session_id", "kind", tool_identity().alias("tool"))
    named = tools.where(F.col("tool").isNotNull())
    defined = named.where("kind = 'tool_definition'").select("session_id", "tool").distinct()
    used = named.where("kind = 'tool_call'").select("session_id", "tool").distinct()
    return defined.join(used, ["session_id", "tool"], "left_anti")


def schema_totals(trace: Trace) -> DataFrame:
    """Completeness-gated schema totals per session."""
    latest = latest_snapshots(trace.snapshots).select("snapshot_id", "session_id")
    joined = latest.join(trace.metrics, "snapshot_id", "left")
    return joined.groupBy("session_id").agg(
        complete_sum("schema_bytes").alias("schema_bytes"),
        complete_sum("repeated_schema_tokens").alias("repeated_schema_tokens"),
    )


def measurement_coverage(trace: Trace) -> DataFrame:
    """Observed over eligible, per measurement, for every snapshot."""
    per_snapshot = trace.blocks.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("eligible_blocks"),
        F.count("estimated_tokens").alias("estimated_blocks"),
        count_where(F.coalesce("detected_kind", F.lit("unknown")) != "unknown").alias("detected_blocks"),
    )
    return (
        trace.snapshots.join(per_snapshot, "snapshot_id", "left")
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("snapshots"),
            F.coalesce(F.sum("eligible_blocks"), F.lit(0)).alias("eligible_blocks"),
            ratio(F.sum("estimated_blocks"), F.sum("eligible_blocks")).alias("token_coverage"),
            ratio(F.sum("detected_blocks"), F.sum("eligible_blocks")).alias("detection_coverage"),
            ratio(count_where(F.col("correlation_status") == "correlated"), F.count(F.lit(1))).alias(
                "correlation_coverage"
            ),
        )
    )
