"""Trace data model: tables, column types and closed vocabularies."""

from __future__ import annotations

# Column types as Spark DDL. Readers fill a column that a file lacks with a typed NULL.
TABLES: dict[str, dict[str, str]] = {
    "sessions": {
        "session_id": "string", "started_at": "timestamp", "ended_at": "timestamp", "state": "string",
    },
    "operations": {
        "operation_id": "string", "session_id": "string", "kind": "string", "status": "string",
    },
    "causal_edges": {"parent_id": "string", "child_id": "string", "relationship": "string"},
    "requests": {
        "request_id": "string", "operation_id": "string", "route": "string", "method": "string",
        "request_bytes": "bigint", "request_kind": "string", "transport": "string", "model": "string",
        "reasoning_effort": "string", "observation_status": "string", "compaction_trigger": "string",
    },
    "attempts": {
        "attempt_id": "string", "request_id": "string", "ordinal": "bigint", "status_code": "int",
        "status": "string", "transport_error": "string", "error_code": "string", "ttfb_us": "bigint",
        "ttft_us": "bigint", "duration_us": "bigint", "compaction_output_seen": "boolean",
    },
    "usage": {
        "attempt_id": "string", "input_total": "bigint", "input_cached": "bigint",
        "input_uncached": "bigint", "output_total": "bigint", "output_reasoning": "bigint",
    },
    "snapshots": {
        "snapshot_id": "string", "session_id": "string", "provider_request_id": "string",
        "analysis_version": "int", "status": "string", "started_at_us": "bigint",
        "completed_at_us": "bigint", "recovered_at_us": "bigint", "correlation_status": "string",
        "logical_context_status": "string", "explicit_request_complete": "boolean",
    },
    "blocks": {
        "block_id": "string", "snapshot_id": "string", "ordinal": "bigint", "kind": "string",
        "role": "string", "origin": "string", "detected_kind": "string", "raw_bytes": "bigint",
        "raw_value_start": "bigint", "exact_fp": "string", "semantic_fp": "string",
        "estimated_tokens": "bigint", "tool_call_id": "string", "tool_name": "string",
        "tool_name_truncated": "boolean", "tool_name_hash": "string",
    },
    "metrics": {
        "snapshot_id": "string", "semantic_coverage_bp": "bigint", "tool_count": "bigint",
        "schema_bytes": "bigint", "estimated_schema_tokens": "bigint",
        "repeated_schema_tokens": "bigint", "stable_prefix_estimate": "bigint",
        "visible_estimated_tokens": "bigint", "provider_input_tokens": "bigint",
    },
    "deltas": {
        "current_snapshot_id": "string", "repeated_blocks": "bigint", "new_blocks": "bigint",
        "changed_blocks": "bigint", "removed_blocks": "bigint", "repeated_tokens": "bigint",
        "new_tokens": "bigint", "common_prefix_blocks": "bigint", "common_prefix_tokens": "bigint",
    },
    "events": {
        "seq": "bigint", "session_id": "string", "operation_id": "string", "event_type": "string",
        "timestamp": "timestamp", "payload": "string",
    },
    "experiments": {
        "experiment_id": "string", "status": "string", "started_at": "timestamp",
        "forwarding_mutations": "bigint", "shadow_drops": "bigint", "recovery_failures": "bigint",
        "determinism_failures": "bigint",
    },
    "candidates": {
        "candidate_id": "string", "experiment_id": "string", "snapshot_id": "string",
        "block_id": "string", "compressor_id": "string", "compressor_version": "int",
        "status": "string", "original_fp": "string", "cache_risk": "string",
        "provider_readability": "string", "text_shape": "string", "json_root_kind": "string",
        "input_bytes": "bigint", "output_bytes": "bigint", "bytes_delta": "bigint",
        "input_tokens": "bigint", "output_tokens": "bigint", "token_delta": "bigint",
        "processing_us": "bigint", "reversible": "boolean", "recovery_verified": "boolean",
        "deterministic": "boolean",
    },
    "sidecars": {
        "session_id": "string", "measurement_run_id": "string", "agent_pid": "bigint",
        "analysis_admitted_total": "bigint", "analysis_requests_seen": "bigint",
        "processed_deferred_total": "bigint", "backlog_capacity_drops": "bigint",
        "deferred_total": "bigint", "high_water_items": "bigint", "high_water_bytes": "bigint",
        "analysis_wait_us": "bigint", "drain_duration_us": "bigint", "capture_complete": "boolean",
        "scheduler_capture_note": "string", "workload": "string", "concurrency_mode": "string",
    },
    "workloads": {"session_id": "string", "workload": "string", "concurrency_mode": "string"},
}

# The closed vocabularies of the data model.
BLOCK_KINDS = (
    "instructions", "message", "text", "image_reference", "file_reference", "tool_definition",
    "tool_call", "tool_result", "item_reference", "prompt_reference", "provider_state_reference",
    "assistant_history", "opaque_reasoning", "opaque", "unknown",
)
ROLES = ("system", "developer", "user", "assistant", "tool", "unknown")
ORIGINS = (
    "human_authored", "agent_generated", "tool_generated", "tool_schema", "provider_managed",
    "external_reference", "proxy_generated", "unknown",
)
DETECTED_KINDS = (
    "json", "ndjson", "log", "search_results", "test_results", "source_code", "diff", "plain_text",
    "binary_like", "unknown",
)
CANDIDATE_STATUSES = (
    "applicable", "not_applicable", "no_improvement", "resource_limit", "invalid_input",
    "recovery_failed", "internal_error",
)
RELATIONSHIPS = ("spawned", "follows_from", "recovery_of", "evaluation_of")
TURN_ROUTES = ("responses", "v1/responses", "backend-api/codex/responses")
COMPACTION_KINDS = ("compaction_v2", "compaction_legacy")
