"""Data-quality audits of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK_KINDS, DETECTED_KINDS, ORIGINS, RELATIONSHIPS, ROLES
from ..sources.trace import Trace

# Constraints of the trace schema.
FOREIGN_KEYS = (
    ("operations", "session_id", "sessions", "session_id"),
    ("requests", "operation_id", "operations", "operation_id"),
    ("attempts", "request_id", "requests", "request_id"),
    ("usage", "attempt_id", "attempts", "attempt_id"),
    ("snapshots", "session_id", "sessions", "session_id"),
    ("snapshots", "provider_request_id", "requests", "request_id"),
    ("blocks", "snapshot_id", "snapshots", "snapshot_id"),
    ("metrics", "snapshot_id", "snapshots", "snapshot_id"),
)
UNIQUE_KEYS = (
    ("sessions", ("session_id",)), ("operations", ("operation_id",)), ("requests", ("request_id",)), ("attempts", ("attempt_id",)),
    ("attempts", ("request_id", "ordinal")), ("usage", ("attempt_id",)), ("snapshots", ("provider_request_id", "analysis_version")),
    ("blocks", ("block_id",)), ("blocks", ("snapshot_id", "ordinal")),
)
ENUMS = (
    ("blocks", "kind", BLOCK_KINDS), ("blocks", "role", ROLES), ("blocks", "origin", ORIGINS), ("blocks", "detected_kind", DETECTED_KINDS),
    ("snapshots", "status", ("complete", "partial", "resource_limit", "malformed", "observer_backpressure", "correlation_degraded", "unsupported", "cancelled")),
)
RANGES = (("usage", "input_total", 0, None), ("usage", "input_cached", 0, None), ("blocks", "raw_bytes", 0, None),
          ("blocks", "estimated_tokens", 0, None), ("metrics", "semantic_coverage_bp", 0, 10000))


def constraint_audit(trace: Trace) -> DataFrame:
    """Violations per constraint; a constraint that holds reports 0."""
    parts = []

    def report(kind: str, name: str, violations: DataFrame) -> None:
        parts.append(
            violations.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(kind).alias("constraint"), F.lit(name).alias("subject"), "violations")
        )

    for table, column, parent, key in FOREIGN_KEYS:
        child = getattr(trace, table).where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
        known = getattr(trace, parent).select(F.col(key).alias("k"))
        report("foreign_key", f"{table}.{column}", child.join(known, "k", "left_anti"))
    for table, columns in UNIQUE_KEYS:
        twice = getattr(trace, table).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        report("unique", f"{table}({', '.join(columns)})", twice)
    for table, column, values in ENUMS:
        odd = getattr(trace, table).where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
        report("enum", f"{table}.{column}", odd.select(column))
    for table, column, low, high in RANGES:
        outside: Column = F.col(column) < low
        if high is not None:
            outside = outside | (F.col(column) > high)
        report("range", f"{table}.{column}", getattr(trace, table).where(outside).select(column))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def binding_conflicts(bindings: DataFrame) -> DataFrame:
    """Keys bound to more than one representation, with the frozen fields that differ."""
    fields = ("raw_content_id", "rendered_content_id", "compressor_version", "policy_version")
    spread = bindings.groupBy("session_id", "logical_content_id").agg(
        F.count(F.lit(1)).alias("bindings"), *[(F.min(f) != F.max(f)).alias(f"__{f}") for f in fields]
    )
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"__{f}"), F.lit(f)) for f in fields]))
    return spread.select("session_id", "logical_content_id", "bindings", conflicts.alias("conflicts")).where(F.size("conflicts") > 0)


def protection_classes(found: DataFrame, objects: DataFrame, recoveries: DataFrame, cutoff: Column) -> DataFrame:
    """Why stored content is kept: pinned, recoverable, referenced, or an orphan (young or old).

    `found` lists stored content (content_id, modified_at); a report only, nothing is deleted.
    """
    needed = recoveries.select(F.explode(F.array("raw_content_id", "provenance_content_id")).alias("content_id")).where(
        "content_id is not null"
    ).distinct().withColumn("__needed", F.lit(True))
    joined = found.join(objects.select("content_id", "pin_count"), "content_id", "left").join(needed, "content_id", "left")
    kind = (
        F.when(F.col("pin_count") > 0, "pinned")
        .when(F.col("pin_count").isNotNull() & F.col("__needed"), "recoverable")
        .when(F.col("pin_count").isNotNull(), "referenced")
        .when(F.col("modified_at") >= cutoff, "young_orphan")
        .otherwise("old_orphan")
    )
    return joined.select("content_id", kind.alias("protection"))


def edge_violations(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """Invalid causal edges with the first reason that applies."""
    ids = operations.select(F.col("operation_id").alias("__id"), F.lit(True).alias("__ok"))
    known = lambda column, flag: ids.select(F.col("__id").alias(column), F.col("__ok").alias(flag))
    joined = edges.join(known("parent_id", "__p"), "parent_id", "left").join(known("child_id", "__c"), "child_id", "left")
    reason = (
        F.when(F.col("parent_id") == F.col("child_id"), "self_edge")
        .when(~F.coalesce(F.col("relationship").isin(*RELATIONSHIPS), F.lit(False)), "unknown_relationship")
        .when(F.col("__p").isNull(), "missing_parent")
        .when(F.col("__c").isNull(), "missing_child")
    )
    return joined.select("parent_id", "child_id", "relationship", reason.alias("reason")).where("reason is not null")
