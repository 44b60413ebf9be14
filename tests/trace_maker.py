"""A deterministic small trace for tests."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sessionlens.sources.trace import Trace


def generate_trace(spark: SparkSession, sessions: int = 4, requests: int = 4, blocks: int = 5):
    """Deterministic trace of sessions x requests x blocks for smoke and scale tests."""
    name = lambda prefix, *columns: F.concat_ws("-", F.lit(prefix), *[F.col(c).cast("string") for c in columns])
    s = spark.range(sessions).select(F.col("id").alias("s"))
    r = spark.range(sessions * requests).select(F.floor(F.col("id") / requests).alias("s"), (F.col("id") % requests).alias("r"))
    b = spark.range(sessions * requests * blocks).select(
        F.floor(F.col("id") / (requests * blocks)).alias("s"), F.floor((F.col("id") % (requests * blocks)) / blocks).alias("r"), (F.col("id") % blocks).alias("b")
    )
    degraded = F.col("s") % 4 == 2
    last = F.col("b") == blocks - 1
    total = F.lit(1000) + 350 * F.col("r")
    return Trace({
        "sessions": s.select(
            name("session", "s").alias("session_id"), F.timestamp_micros(F.lit(1700000000000000) + F.col("s") * 60000000).alias("started_at"),
            F.when(F.col("s") % 4 != 3, F.timestamp_micros(F.lit(1700000030000000) + F.col("s") * 60000000)).alias("ended_at"),
            F.when(F.col("s") % 4 == 3, "active").otherwise("closed").alias("state"),
        ),
        "operations": r.select(
            name("operation", "s", "r").alias("operation_id"), name("session", "s").alias("session_id"), F.lit("inference").alias("kind"), F.lit("completed").alias("status")
        ),
        "requests": r.select(
            name("request", "s", "r").alias("request_id"), name("operation", "s", "r").alias("operation_id"), F.lit("/v1/responses").alias("route"),
            F.lit("POST").alias("method"), (F.lit(500) + F.col("r")).alias("request_bytes"), F.lit("turn").alias("request_kind"), F.lit("http").alias("transport"),
            F.lit("model-a").alias("model"), F.lit("medium").alias("reasoning_effort"), F.lit("complete").alias("observation_status"), F.lit(None).cast("string").alias("compaction_trigger"),
        ),
        "attempts": r.select(
            name("attempt", "s", "r").alias("attempt_id"), name("request", "s", "r").alias("request_id"), F.lit(1).alias("ordinal"), F.lit(200).alias("status_code"),
            F.lit("completed").alias("status"), F.lit(None).cast("string").alias("transport_error"), F.lit(None).cast("string").alias("error_code"),
            F.lit(10).alias("ttfb_us"), F.lit(20).alias("ttft_us"), F.lit(30).alias("duration_us"), F.lit(False).alias("compaction_output_seen"),
        ),
        "usage": r.select(
            name("attempt", "s", "r").alias("attempt_id"), total.alias("input_total"), F.expr("(1000 + 350 * r) * 3 div 5").alias("input_cached"),
            F.lit(None).cast("bigint").alias("input_uncached"), F.lit(100).cast("bigint").alias("output_total"), F.lit(20).cast("bigint").alias("output_reasoning"),
        ),
        "snapshots": r.select(
            name("snapshot", "s", "r").alias("snapshot_id"), name("session", "s").alias("session_id"), name("request", "s", "r").alias("provider_request_id"),
            F.lit(1).alias("analysis_version"), F.when(degraded & (F.col("r") == 0), "partial").otherwise("complete").alias("status"),
            (F.col("r") * 1000).alias("started_at_us"), (F.col("r") * 1000 + 500).alias("completed_at_us"), F.lit(None).cast("bigint").alias("recovered_at_us"),
            F.lit("correlated").alias("correlation_status"), F.lit("complete").alias("logical_context_status"), F.lit(True).alias("explicit_request_complete"),
        ),
        "blocks": b.select(
            name("block", "s", "r", "b").alias("block_id"), name("snapshot", "s", "r").alias("snapshot_id"), F.col("b").alias("ordinal"), F.lit("text").alias("kind"),
            F.lit("user").alias("role"), F.lit("human_authored").alias("origin"),
            F.expr("case b % 4 when 0 then 'json' when 3 then 'unknown' else 'plain_text' end").alias("detected_kind"), (F.lit(400) + F.col("b")).alias("raw_bytes"),
            (F.col("b") * 400).alias("raw_value_start"), F.sha2((F.col("b") % 8).cast("string"), 256).alias("exact_fp"),
            F.sha2(F.concat(F.lit("s"), (F.col("b") % 5).cast("string")), 256).alias("semantic_fp"),
            F.when(~(degraded & last), F.lit(100) + F.col("b")).alias("estimated_tokens"),
            F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("boolean").alias("tool_name_truncated"),
            F.lit(None).cast("string").alias("tool_name_hash"),
        ),
        "metrics": r.select(
            name("snapshot", "s", "r").alias("snapshot_id"), F.lit(9000).cast("bigint").alias("semantic_coverage_bp"), F.lit(3).cast("bigint").alias("tool_count"),
            F.lit(1200).cast("bigint").alias("schema_bytes"), F.lit(300).cast("bigint").alias("estimated_schema_tokens"), F.lit(200).cast("bigint").alias("repeated_schema_tokens"),
        ),
        "deltas": r.select(name("snapshot", "s", "r").alias("current_snapshot_id"), F.lit(50).cast("bigint").alias("repeated_tokens")),
    })
