"""Bind the star-schema and text tables to trace tables.

The given tables carry no agent traffic, so each trace table is derived from them row by row:
customers become sessions, orders become requests and snapshots, line items become attempts and
context blocks, events stay an event log, documents and conversations provide block text. All
derivations are arithmetic on the source columns, hence the same at any scale and in any engine.
Gaps are part of the data: some requests have no snapshot, some attempts no usage, some sessions no
label, because missing facts are what most operators are about.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..operators.views import number_snapshots
from ..session import new_folder
from .trace import Trace

LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


#: Bytes of a table whose rows cost much work that are worth a task, and that a scan puts into one task anyway.
HEAVY_TASK, SCAN_TASK = 1 << 20, 128 << 20
#: Bytes of a table that one task numbers: some half a million rows, which a sort holds in 100 MB.
NUMBERED_TASK = 8 << 20


def table_bytes(spark: SparkSession, root: str, table: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def read_text(spark: SparkSession, root: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows cost much work: texts, and keys that streams and bodies are made of.

    A file of one row group is one task, however much work its rows are. A table that scans would
    leave to fewer tasks than the cluster has cores is therefore stored once per application in so many files as
    its bytes are worth; one with more than `SCAN_TASK` bytes a core never is. Only the named columns are dealt and stored.
    """
    size = table_bytes(spark, root, table)
    wanted = min(spark.sparkContext.defaultParallelism, -(-size // HEAVY_TASK))
    if wanted <= -(-size // SCAN_TASK):
        return read(spark, root, table).select(*columns)
    kept = sorted(columns)
    return _ingested(spark, root, "-".join([table, *kept, "dealt"]), lambda: read(spark, root, table).select(*kept).repartition(wanted)).select(*columns)


def whole(expr: str) -> Column:
    """Truncate a non-negative double the same way in every engine."""
    return F.expr(f"cast(floor({expr}) as bigint)")


def sessions(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "customer").select(
        F.col("c_custkey").alias("session_id"),
        F.expr("timestamp_micros(1704067200000000 + c_custkey * 60000000)").alias("started_at"),
        F.expr(
            "case when c_custkey % 7 <> 0 then timestamp_micros(1704067200000000 + c_custkey * 60000000"
            " + cast(floor(abs(c_acctbal)) as bigint) * 1000000) end"
        ).alias("ended_at"),
        F.expr(
            "case c_custkey % 5 when 0 then 'active' when 1 then 'closing' when 2 then 'stale'"
            " else 'closed' end"
        ).alias("state"),
    )


def workloads(spark: SparkSession, root: str) -> DataFrame:
    """Manifest: a label for most sessions."""
    return (
        read(spark, root, "customer")
        .where("c_custkey % 9 <> 0")
        .select(
            F.col("c_custkey").alias("session_id"),
            F.lower("c_mktsegment").alias("workload"),
            F.expr("case when c_custkey % 2 = 0 then 'parallel' else 'serial' end").alias("concurrency_mode"),
        )
    )


def operations(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "orders").select(
        F.col("o_orderkey").alias("operation_id"),
        F.col("o_custkey").alias("session_id"),
        F.lit("inference").alias("kind"),
        F.expr("case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'incomplete' end").alias(
            "status"
        ),
    )


def requests(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderkey").alias("operation_id"),
        F.expr(
            "case when o_orderkey % 3 = 0 then '/v1/responses/' when o_orderkey % 3 = 1 then 'V1/Responses'"
            " else 'v1/models' end"
        ).alias("route"),
        F.expr("case when o_orderkey % 14 = 0 then 'GET' else 'POST' end").alias("method"),
        whole("o_totalprice").alias("request_bytes"),
        F.expr(
            "case when o_orderstatus = 'P' then 'compaction_v2' when o_orderkey % 50 = 0 then 'compaction'"
            " when o_orderkey % 17 = 0 then null else 'turn' end"
        ).alias("request_kind"),
        F.expr("case when o_orderkey % 2 = 0 then 'http_sse' else 'websocket' end").alias("transport"),
        F.col("o_orderpriority").alias("model"),
        F.expr(
            "case o_orderkey % 4 when 1 then 'low' when 2 then 'medium' when 3 then 'high' end"
        ).alias("reasoning_effort"),
        F.expr(
            "case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'partial' else 'complete' end"
        ).alias("observation_status"),
        F.expr(
            "case when o_orderstatus = 'P' and o_orderkey % 4 = 1 then 'manual'"
            " when o_orderstatus = 'P' and o_orderkey % 4 < 3 then 'auto' end"
        ).alias("compaction_trigger"),
        F.expr("unix_micros(cast(o_orderdate as timestamp))").alias("created_us"),
    )


_STORED: dict[tuple[str, str, str], str] = {}


def ordered_lines(spark: SparkSession, root: str) -> DataFrame:
    """Numbered line items, derived once per application and stored in the shared folder.

    Attempts, usage, blocks and candidates all start here, so the numbering is an ingest step: its
    result is a table, as the facts of a real trace are, on every kind of master.
    """
    return _ingested(spark, root, "lines", lambda: numbered_lines(spark, root))


def ordered_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots with their place in the session, numbered once per application like the lines."""
    return _ingested(spark, root, "snapshots", lambda: number_snapshots(snapshots(spark, root), -(-table_bytes(spark, root, "orders") // NUMBERED_TASK)))


def _ingested(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, root, name)
    if key not in _STORED:
        path = new_folder(spark, name)
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


#: Lines of an order that one task may number.
LARGE_ORDER = 1 << 18


def numbered_lines(spark: SparkSession, root: str) -> DataFrame:
    """Line items numbered inside their order over a total order of the columns.

    The bucket cuts an order of more than `LARGE_ORDER` lines by line number and part range, so one order holding a
    large share of all lines is still numbered by many tasks.
    """
    lines = read(spark, root, "lineitem").select("l_orderkey", *LINE_ORDER)
    bucket = F.col("l_linenumber").cast("bigint") * 1000000000 + F.floor(F.col("l_partkey") / 1024)
    tasks = -(-table_bytes(spark, root, "lineitem") // NUMBERED_TASK)
    return numbered(lines, ["l_orderkey"], [F.col(c) for c in LINE_ORDER], "ordinal", bucket, most=LARGE_ORDER, tasks=tasks)


def _attempt_id() -> Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("ordinal").cast("string"))


def attempts(spark: SparkSession, root: str) -> DataFrame:
    return ordered_lines(spark, root).select(
        _attempt_id().alias("attempt_id"),
        F.col("l_orderkey").alias("request_id"),
        F.col("ordinal"),
        F.expr(
            "case when l_suppkey % 20 = 3 then 500 when l_suppkey % 20 = 4 then 429"
            " when l_suppkey % 20 = 5 then null else 200 end"
        ).cast("int").alias("status_code"),
        F.expr(
            "case when l_suppkey % 20 in (3, 4) then 'errored' when l_suppkey % 20 = 5 then null"
            " when l_suppkey % 20 = 6 then 'cancelled' else 'completed' end"
        ).alias("status"),
        F.expr("case when l_suppkey % 25 = 9 then 'connection_reset' end").alias("transport_error"),
        F.expr("case when l_suppkey % 20 = 4 then 'rate_limit' end").alias("error_code"),
        F.expr("case when l_suppkey % 20 <> 5 then cast(floor(l_extendedprice) as bigint) end").alias("ttfb_us"),
        F.expr("case when l_suppkey % 20 > 5 then cast(floor(l_extendedprice * 2) as bigint) end").alias("ttft_us"),
        F.expr(
            "case when l_suppkey % 20 <> 5 then cast(floor(l_extendedprice * 10) as bigint) end"
        ).alias("duration_us"),
        F.expr("l_linenumber % 2 = 0").alias("compaction_output_seen"),
    )


def usage(spark: SparkSession, root: str) -> DataFrame:
    return (
        ordered_lines(spark, root)
        .where("l_quantity > 1")
        .select(
            _attempt_id().alias("attempt_id"),
            F.expr("case when l_suppkey % 50 <> 7 then cast(floor(l_extendedprice) as bigint) end").alias(
                "input_total"
            ),
            F.expr(
                "case when l_suppkey % 10 <> 0 then cast(floor(l_extendedprice * l_discount) as bigint) end"
            ).alias("input_cached"),
            F.expr(
                "case when l_suppkey % 10 > 2 then cast(floor(l_extendedprice) as bigint)"
                " - cast(floor(l_extendedprice * l_discount) as bigint) end"
            ).alias("input_uncached"),
            whole("l_quantity").alias("output_total"),
            F.expr("case when l_tax > 0 then cast(floor(l_quantity / 2) as bigint) end").alias("output_reasoning"),
        )
    )


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One snapshot per analysed request; every tenth request was analysed twice."""
    return (
        read(spark, root, "orders")
        .where("o_orderkey % 23 <> 0")
        .select(
            "*",
            F.explode(
                F.expr("case when o_orderkey % 10 = 0 then array(1, 2) else array(1) end")
            ).alias("analysis_version"),
        )
        .select(
            F.expr("o_orderkey * 10 + analysis_version").alias("snapshot_id"),
            F.col("o_custkey").alias("session_id"),
            F.expr("case when o_orderkey % 101 = 0 then o_orderkey + 1000000000000 else o_orderkey end").alias(
                "provider_request_id"
            ),
            F.col("analysis_version"),
            F.expr(
                "case o_orderkey % 11 when 0 then 'partial' when 1 then 'dropped' else 'complete' end"
            ).alias("status"),
            F.expr(
                "case when o_orderkey % 31 <> 0 then unix_micros(cast(o_orderdate as timestamp)) end"
            ).alias("started_at_us"),
            F.expr(
                "case when o_orderkey % 11 <> 1 and o_orderkey % 29 <> 0 then"
                " unix_micros(cast(o_orderdate as timestamp)) + analysis_version * 1000 end"
            ).alias("completed_at_us"),
            F.expr(
                "case when o_orderkey % 58 = 0 then unix_micros(cast(o_orderdate as timestamp)) + 5000 end"
            ).alias("recovered_at_us"),
            F.expr("case when o_orderkey % 13 = 0 then 'unmatched' else 'correlated' end").alias(
                "correlation_status"
            ),
            F.expr(
                "case when o_orderkey % 19 = 0 then 'malformed' when o_orderkey % 7 = 0 then 'explicit_only'"
                " else 'complete' end"
            ).alias("logical_context_status"),
            F.expr("o_orderkey % 37 <> 0").alias("explicit_request_complete"),
        )
    )


def blocks(spark: SparkSession, root: str) -> DataFrame:
    """Line items as context blocks of every snapshot of their order."""
    return (
        ordered_lines(spark, root)
        .where("l_orderkey % 23 <> 0")
        .select(
            "*",
            F.explode(
                F.expr("case when l_orderkey % 10 = 0 then array(1, 2) else array(1) end")
            ).alias("version"),
        )
        .select(
            F.expr("concat_ws('-', cast(l_orderkey * 10 + version as string), cast(ordinal - 1 as string))").alias(
                "block_id"
            ),
            F.expr("l_orderkey * 10 + version").alias("snapshot_id"),
            F.expr("ordinal - 1").alias("ordinal"),
            F.expr(
                "case l_suppkey % 6 when 0 then 'text' when 1 then 'message' when 2 then 'tool_result'"
                " when 3 then 'tool_call' when 4 then 'tool_definition' else 'instructions' end"
            ).alias("kind"),
            F.expr(
                "case when l_suppkey % 6 in (2, 3, 4) then 'tool' when l_linestatus = 'F' then 'user'"
                " when l_suppkey % 4 = 0 then null else 'assistant' end"
            ).alias("role"),
            F.expr(
                "case l_returnflag when 'A' then 'human_authored' when 'R' then 'tool_generated'"
                " else 'agent_generated' end"
            ).alias("origin"),
            F.expr(
                "case l_partkey % 7 when 0 then 'json' when 1 then 'plain_text' when 2 then 'source_code'"
                " when 3 then 'log' when 4 then 'unknown' when 5 then 'plain_text' end"
            ).alias("detected_kind"),
            whole("l_extendedprice").alias("raw_bytes"),
            F.expr("(ordinal - 1) * 1500").alias("raw_value_start"),
            F.expr("case when l_partkey % 100 < 97 then sha2(cast(l_partkey % 100 as string), 256) end").alias(
                "exact_fp"
            ),
            F.expr(
                "case when l_partkey % 100 < 90 and l_suppkey % 6 < 3"
                " then sha2(concat('s', cast(l_partkey % 25 as string)), 256) end"
            ).alias("semantic_fp"),
            F.expr("case when l_tax > 0 then cast(floor(l_quantity) as bigint) end").alias("estimated_tokens"),
            F.expr(
                "case when l_suppkey % 6 in (2, 3) and l_partkey % 40 < 39"
                " then concat('call-', cast(l_partkey % 40 as string)) end"
            ).alias("tool_call_id"),
            F.expr(
                "case when l_suppkey % 6 in (3, 4) then case l_partkey % 7 when 0 then 'git_status'"
                " when 1 then 'rg-search' when 2 then 'cargo_test' when 3 then 'read_file' when 4 then 'shell'"
                " when 5 then 'npm_install' else 'weather' end end"
            ).alias("tool_name"),
            F.expr("case when l_suppkey % 6 in (3, 4) then l_partkey % 7 = 6 end").alias("tool_name_truncated"),
            F.expr("case when l_suppkey % 6 in (3, 4) and l_partkey % 7 = 6 then sha2('weather', 256) end").alias(
                "tool_name_hash"
            ),
            whole("l_quantity").alias("line_count"),
        )
    )


def metrics(spark: SparkSession, root: str) -> DataFrame:
    return (
        read(spark, root, "orders")
        .where("o_orderkey % 23 <> 0 and o_orderkey % 47 <> 0")
        .select(
            F.expr("o_orderkey * 10 + case when o_orderkey % 10 = 0 then 2 else 1 end").alias("snapshot_id"),
            F.expr("case when o_orderkey % 41 <> 0 then 10000 - (o_orderkey * 37) % 3000 end").alias(
                "semantic_coverage_bp"
            ),
            F.expr("o_orderkey % 8").alias("tool_count"),
            F.expr("400 * (o_orderkey % 8)").alias("schema_bytes"),
            F.expr("100 * (o_orderkey % 8)").alias("estimated_schema_tokens"),
            F.expr("case when o_orderkey % 43 <> 0 then 60 * (o_orderkey % 8) end").alias("repeated_schema_tokens"),
            F.expr("case when o_orderkey % 3 <> 0 then o_orderkey % 500 end").alias("stable_prefix_estimate"),
            F.expr("case when o_orderkey % 6 <> 0 then cast(floor(o_totalprice / 10) as bigint) end").alias(
                "visible_estimated_tokens"
            ),
            F.expr("case when o_orderkey % 9 <> 0 then cast(floor(o_totalprice / 9) as bigint) end").alias(
                "provider_input_tokens"
            ),
        )
    )


def deltas(spark: SparkSession, root: str) -> DataFrame:
    return (
        read(spark, root, "orders")
        .where("o_orderkey % 23 <> 0 and o_orderkey % 53 <> 0")
        .select(
            F.expr("o_orderkey * 10 + case when o_orderkey % 10 = 0 then 2 else 1 end").alias("current_snapshot_id"),
            F.expr("o_orderkey % 5").alias("repeated_blocks"),
            F.expr("o_orderkey % 4").alias("new_blocks"),
            F.expr("o_orderkey % 3").alias("changed_blocks"),
            F.expr("o_orderkey % 2").alias("removed_blocks"),
            F.expr("case when o_orderkey % 12 <> 0 then o_orderkey % 60 end").alias("repeated_tokens"),
            F.expr("o_orderkey % 80").alias("new_tokens"),
            F.expr("o_orderkey % 4").alias("common_prefix_blocks"),
            F.expr("case when o_orderkey % 15 <> 0 then o_orderkey % 70 end").alias("common_prefix_tokens"),
        )
    )


def events(spark: SparkSession, root: str) -> DataFrame:
    """The event log with a JSON payload naming the requests it is about."""
    return read(spark, root, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("operation_id"),
        F.expr(
            "case event_type when 'error' then 'context.analysis.dropped' when 'purchase' then"
            " 'context.analysis.partial' when 'click' then 'context.analysis.completed' when 'signup' then"
            " 'session.started' else 'provider.request.observed' end"
        ).alias("event_type"),
        F.col("ts").alias("timestamp"),
        F.expr(
            """case event_id % 6
            when 0 then concat('{"reason":"observer_backpressure","dropped_count":', cast(user_id % 4 as string),
                 ',"provider_request_id":', cast(event_id as string), '}')
            when 1 then concat('{"reason":"resource_limit","request_ids":[', cast(event_id as string), ',',
                 cast(event_id * 2 as string), ',', cast(event_id as string), '],"terminal":true}')
            when 2 then concat('{"dropped_count":"two","request":{"request_id":', cast(event_id + 3 as string), '}}')
            when 3 then '[1,2]'
            when 4 then concat('{"reason":"cancelled","dropped_count":-3,"outcome":"drop","request_id":',
                 cast(event_id + 900000000 as string), '}')
            else props end"""
        ).alias("payload"),
    )


def experiments(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "supplier").groupBy(F.expr("concat('exp-', cast(s_suppkey % 4 as string))").alias(
        "experiment_id"
    )).agg(
        F.expr("case when min(s_suppkey) % 2 = 0 then 'completed' else 'running' end").alias("status"),
        F.expr("timestamp_micros(1704067200000000 + min(s_suppkey) * 1000000)").alias("started_at"),
        F.expr("cast(0 as bigint)").alias("forwarding_mutations"),
        F.expr("cast(count(*) as bigint)").alias("shadow_drops"),
        F.expr("cast(max(s_suppkey) % 3 as bigint)").alias("recovery_failures"),
        F.expr("cast(0 as bigint)").alias("determinism_failures"),
    )


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """One candidate evaluation per line item, joined one to one with its metrics."""
    saved = "cast(floor(l_extendedprice * (l_discount + l_tax) * 4) as bigint)"
    applied = "l_partkey % 4 <> 3"
    return ordered_lines(spark, root).where("l_orderkey % 23 <> 0").select(
        _attempt_id().alias("candidate_id"),
        F.expr("concat('exp-', cast(l_suppkey % 3 as string))").alias("experiment_id"),
        F.expr("l_orderkey * 10 + 1").alias("snapshot_id"),
        F.expr("concat_ws('-', cast(l_orderkey * 10 + 1 as string), cast(ordinal - 1 as string))").alias("block_id"),
        F.expr(
            "case l_partkey % 6 when 0 then 'json.minify' when 1 then 'text.readable_line_fold'"
            " when 2 then 'search.result_projection' when 3 then 'shell.diagnostic_projection'"
            " when 4 then 'tests.failure_projection' else 'json.tabular' end"
        ).alias("compressor_id"),
        F.expr("cast(1 as int)").alias("compressor_version"),
        F.expr(
            "case l_partkey % 4 when 0 then 'applicable' when 1 then 'applicable' when 2 then 'no_improvement'"
            " else 'not_applicable' end"
        ).alias("status"),
        F.expr("sha2(cast(l_partkey % 100 as string), 256)").alias("original_fp"),
        F.expr(
            "case when l_linenumber > 5 then 'unknown' when l_linenumber > 3 then 'high'"
            " when l_linenumber > 1 then 'medium' else 'low' end"
        ).alias("cache_risk"),
        F.expr("case when l_partkey % 6 in (1, 2) then 'readable' when l_partkey % 6 = 5 then 'opaque' end").alias(
            "provider_readability"
        ),
        F.expr("case when l_partkey % 3 = 0 then 'duplicate' when l_partkey % 3 = 1 then 'logs' end").alias(
            "text_shape"
        ),
        F.expr("case when l_partkey % 2 = 0 then 'array' else 'object' end").alias("json_root_kind"),
        whole("l_extendedprice").alias("input_bytes"),
        F.expr(f"case when {applied} then cast(floor(l_extendedprice) as bigint) - {saved} end").alias("output_bytes"),
        F.expr(f"case when {applied} then {saved} end").alias("bytes_delta"),
        F.expr("case when l_tax > 0 then cast(floor(l_quantity) as bigint) end").alias("input_tokens"),
        F.expr(f"case when {applied} and l_tax > 0 then cast(floor(l_quantity * 0.75) as bigint) end").alias(
            "output_tokens"
        ),
        F.expr(
            f"case when {applied} and l_tax > 0 then cast(floor(l_quantity) as bigint)"
            " - cast(floor(l_quantity * 0.75) as bigint) end"
        ).alias("token_delta"),
        F.expr("cast(floor(l_extendedprice / 8) as bigint)").alias("processing_us"),
        F.expr("l_suppkey % 12 <> 0").alias("reversible"),
        F.expr("l_suppkey % 30 <> 1").alias("recovery_verified"),
        F.expr("l_suppkey % 40 <> 2").alias("deterministic"),
    )


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Scheduler counters per session; some sessions lack a sidecar, some have two."""
    seen = (
        requests(spark, root)
        .join(operations(spark, root).select("operation_id", "session_id"), "operation_id")
        .where(
            "request_kind = 'turn' or (lower(method) = 'post' and"
            " lower(trim(both '/' from route)) in ('responses', 'v1/responses', 'backend-api/codex/responses'))"
        )
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("seen"))
    )
    customers = read(spark, root, "customer").where("c_custkey % 13 <> 0")
    return (
        customers.join(seen, customers.c_custkey == seen.session_id, "left")
        .select("c_custkey", "c_mktsegment", F.expr("coalesce(seen, 0)").alias("seen"))
        .select("*", F.explode(F.expr("case when c_custkey % 21 = 0 then array(0, 1) else array(0) end")).alias("copy"))
        .select(
            F.expr("case when c_custkey % 33 = 0 then c_custkey + 10000000000 else c_custkey end").alias("session_id"),
            F.expr("case when c_custkey % 16 <> 0 then concat('run-', cast(c_custkey as string)) end").alias(
                "measurement_run_id"
            ),
            F.expr("c_custkey % 1000").alias("agent_pid"),
            F.expr("case when c_custkey % 10 = 0 then seen + 1 else seen end").alias("analysis_admitted_total"),
            F.expr("case when c_custkey % 11 <> 0 then seen end").alias("analysis_requests_seen"),
            F.expr("case when seen > 1 then seen - 1 else seen end").alias("processed_deferred_total"),
            F.expr("cast(case when seen > 1 then 1 else 0 end as bigint)").alias("backlog_capacity_drops"),
            F.expr("case when c_custkey % 4 <> 0 then seen * 2 end").alias("deferred_total"),
            F.expr("case when c_custkey % 14 <> 0 then c_custkey % 9 end").alias("high_water_items"),
            F.expr("c_custkey * 100").alias("high_water_bytes"),
            F.expr("c_custkey % 77").alias("analysis_wait_us"),
            F.expr("case when c_custkey % 2 = 0 then c_custkey % 50 end").alias("drain_duration_us"),
            F.expr("c_custkey % 18 <> 0").alias("capture_complete"),
            F.expr("case when c_custkey % 22 = 0 then 'Shutdown before capture' end").alias("scheduler_capture_note"),
            F.expr("lower(c_mktsegment)").alias("workload"),
            F.expr("case when c_custkey % 2 = 0 then 'parallel' else 'serial' end").alias("concurrency_mode"),
            F.col("copy").cast("bigint").alias("copy"),
        )
    )


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents as text blocks: session = source, order = document id."""
    return read_text(spark, root, "documents", "doc_id", "source", "text", "lang").select(
        F.col("doc_id").alias("block_id"), F.col("source").alias("session_id"), "text", "lang"
    )


MAKERS = {
    "sessions": sessions, "workloads": workloads, "operations": operations, "requests": requests,
    "attempts": attempts, "usage": usage, "snapshots": ordered_snapshots, "blocks": blocks,
    "metrics": metrics, "deltas": deltas, "events": events, "experiments": experiments,
    "candidates": candidates, "sidecars": sidecars,
}


def star_trace(spark: SparkSession, root: str) -> Trace:
    """All trace tables over the given folder, built lazily."""
    return Trace({name: (lambda maker=maker: maker(spark, root)) for name, maker in MAKERS.items()})


# Tool output texts of an order: each line is computed from the order key and the line's place, so a
# text is built on its own row without grouping.
OUTPUT_LINES = {
    "test_stdout": """case (i * 7 + o_orderkey) % 5 when 0 then concat('test mod_a::case_', i, ' ... FAILED')
        when 1 then 'running 12 tests' else concat('test mod_b::case_', i, ' ... ok') end""",
    "check_stderr": """case (i + o_orderkey) % 6 when 0 then 'warning: unused variable'
        when 1 then '    Finished dev profile' else concat('   Compiling crate_', i, ' v0.1.0') end""",
    "rg_stdout": """concat('src/file_', {quarter}, '.rs:', i * 3 + 1, ':let value = ', i,
        case when o_orderkey % 11 = 0 and i = 1 then ' at :9: end' else '' end)""",
    "status_lines": "concat('\tmodified:   src/file_', i, '.rs')",
    "log_text": """concat('2024-01-01T00:00:0', i % 10, case when ({fifth}) % 2 = 0 then ' INFO ' else ' WARN ' end,
        'worker ', i, ' done')""",
    "json_rows": """concat('{"id": ', i, ', "status": "ok", "note": "", "price": ', i * 10, '}')""",
}


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """Tool outputs derived from orders: test, build, search, status, log and JSON texts."""
    def joined(name: str, separator: str) -> str:
        line = OUTPUT_LINES[name].replace("{quarter}", "i div 4").replace("{fifth}", "i div 5")
        return f"array_join(transform(sequence(0, cast(1 + o_orderkey % 30 as int)), i -> {line}), '{separator}')"

    newline = "\\n"
    return read_text(spark, root, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("block_id"),
        F.expr(f"concat({joined('test_stdout', newline)}, '{newline}')").alias("test_stdout"),
        F.expr(f"concat({joined('check_stderr', newline)}, '{newline}')").alias("check_stderr"),
        F.expr(joined("rg_stdout", newline)).alias("rg_stdout"),
        F.expr(
            "concat(case when o_orderkey % 5 = 0 then 'Unknown head' else 'On branch main' end,"
            f" '{newline}Changes not staged for commit:{newline}  (use \"git add <file>...\" to update){newline}',"
            f" {joined('status_lines', newline)}, '{newline}')"
        ).alias("status_stdout"),
        F.expr(f"concat({joined('log_text', newline)}, '{newline}')").alias("log_text"),
        F.expr(f"concat('[', {joined('json_rows', ', ')}, case when o_orderkey % 7 = 0 then '' else ']' end)").alias(
            "json_text"
        ),
    )


def raw_requests(spark: SparkSession, root: str) -> DataFrame:
    """One request body per conversation turn; every fifth is cut off and so malformed."""
    body = F.concat(
        F.expr("concat('{\"model\":\"m', cast(turn % 3 as string), '\",\"stream\":true,\"instructions\":\"be brief\",\"input\":["
               "{\"type\":\"message\",\"role\":\"', role, '\",\"content\":[{\"type\":\"input_text\",\"text\":')"),
        F.expr("substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"),
        F.lit('},{"type":"input_image","image_url":"u"}]},{"type":"function_call","call_id":"c1","name":"search","arguments":"{}"},'
              '{"type":"function_call_output","call_id":"c1","output":"done"},{"type":"reasoning"},{"role":"user","content":"plain"},'
              '"loose",{"type":"mystery"}],"tools":[{"type":"function","name":"search"},{"type":"mcp","server_label":"files"}]'),
        F.expr("case when turn % 2 = 0 then concat(',\"previous_response_id\":\"resp_', cast(conv_id as string), '\"') else '' end"),
        F.expr("case when turn % 5 = 4 then '' else '}' end"),
    )
    return read_text(spark, root, "conversations", "conv_id", "turn", "role", "text").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        "conv_id", "turn", "role", "text", body.alias("body"),
    )


def usage_documents(spark: SparkSession, root: str) -> DataFrame:
    """Provider usage documents derived from orders, some of them inconsistent."""
    return read(spark, root, "orders").select(
        F.col("o_orderkey").alias("attempt_id"),
        F.expr(
            """case o_orderkey % 9 when 0 then '{}' when 1 then 'null' when 2 then '{"input_tokens":-3,"output_tokens":4}'
            when 3 then '{"input_tokens":10,"input_tokens_details":{"cached_tokens":12}}'
            when 4 then '{"input_tokens":1.5,"output_tokens":2}' when 5 then '{"input_tokens":18446744073709551615}'
            when 6 then '{"input_tokens":10,"output_tokens":4,"total_tokens":15,"output_tokens_details":{"reasoning_tokens":9}}'
            else concat('{"input_tokens":', cast(o_orderkey as string), ',"input_tokens_details":{"cached_tokens":',
                 cast(o_orderkey div 3 as string), ',"cache_write":2},"output_tokens":8,"output_tokens_details":{"reasoning_tokens":5},"total_tokens":',
                 cast(o_orderkey + 8 as string), '}') end"""
        ).alias("usage"),
    )


def stream_chunks(spark: SparkSession, root: str, source: DataFrame | None = None, *more: Column) -> DataFrame:
    """Response streams derived from orders, cut into chunks at arbitrary places. `more` may use `last`, the place of a
    stream's last chunk."""
    orders = read_text(spark, root, "orders", "o_orderkey") if source is None else source
    text = F.expr(
        r"""concat('event: response.created\ndata: {"response":{"id":"resp-', o_orderkey, '","model":"m', o_orderkey % 3, '"}}\n\n: ping\n\n',
        repeat('event: response.output_text.delta\ndata: {"delta":"x"}\n\n', cast(o_orderkey % 4 as int)),
        case o_orderkey % 5 when 0 then concat('event: response.completed\ndata: {"response":\ndata: {"usage":{"input_tokens":', o_orderkey, '}}}\n\n')
        when 1 then 'event: response.incomplete\ndata: {"response":{}}\n\n'
        when 2 then 'event: response.failed\ndata: {"response":{"error":{"code":"overloaded"}}}\n\n'
        when 4 then 'event: response.completed\ndata: {"response":{"usage":{"input_tokens":1}}}\n\nevent: response.output_text.delta\ndata: {"usage":{"input_tokens":9}}\n\n'
        else 'event: response.in_progress\ndata: {oops\n\n' end)"""
    )
    ended = F.expr(r"case o_orderkey % 3 when 0 then replace(body, '\n', '\r\n') when 1 then body else replace(body, '\n', '\r') end")
    return (
        orders.select("o_orderkey", text.alias("body"))
        .select("o_orderkey", ended.alias("body"), (F.col("o_orderkey") % 23 + 17).cast("int").alias("w"))
        .select("o_orderkey", "body", "w", F.expr("cast((length(body) - 1) div w as int)").alias("last"))
        .select("*", F.explode(F.expr("sequence(0, last)")).alias("seq"))
        .select(
            F.col("o_orderkey").alias("attempt_id"), F.col("seq").cast("bigint").alias("seq"),
            F.expr("substring(body, seq * w + 1, w)").alias("chunk"),
            F.expr("case when seq = last then case when o_orderkey % 2 = 0 then 'cancel' else 'disconnect' end end").alias("closing"),
            *more,
        )
    )


def dialogue_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Response streams of dialogues: a delta a turn with its text, then usage, reasons and a compaction item by kind of dialogue."""
    turns = read(spark, root, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size")
    )
    delta = F.transform("turns", lambda t: F.concat(F.lit("event: response.output_text.delta\ndata: "), F.to_json(F.struct(t["text"].alias("delta"))), F.lit("\n\n")))
    rest = F.expr(
        r"""concat(case conv_id % 4 when 0 then 'event: response.output_item.done\ndata: {"item":{"type":"compaction"}}\n\n'
              when 1 then 'event: response.output_item.done\ndata: {"item":{"text":"\\\"type\\\":\\\"compaction\\\""}}\n\n'
              when 3 then 'event: note\ndata: {"items":[{"parts":[{"b":1,"type":"compaction"}]}]}\n\n' else '' end,
            case conv_id % 5 when 1 then 'event: response.incomplete\ndata: {"response":{"incomplete_details":{"reason":"max_output_tokens"},"usage":'
              when 2 then 'event: response.in_progress\ndata: {"response":{"usage":' else 'event: response.completed\ndata: {"response":{"usage":' end,
            case conv_id % 5 when 3 then '"none"' when 4 then '{}' else concat('{"input_tokens":', size,
              case when conv_id % 4 = 1 then concat(',"input_tokens_details":{"cached_tokens":', size div 2, '}') else '' end, ',"output_tokens":', n,
              ',"total_tokens":', case when conv_id % 4 = 2 then 1 else size + n end, '}') end, '}}\n\n')"""
    )
    body = turns.select("conv_id", F.concat(F.array_join(delta, ""), rest).alias("body"), (F.col("conv_id") % 61 + 40).cast("int").alias("w"))
    cut = body.select("conv_id", "body", "w", F.explode(F.expr("sequence(0, cast((length(body) - 1) div w as int))")).alias("seq"))
    return cut.select(
        F.col("conv_id").cast("bigint").alias("attempt_id"), F.col("seq").cast("bigint").alias("seq"), F.expr("substring(body, seq * w + 1, w)").alias("chunk"),
        F.expr("case when seq = (length(body) - 1) div w then case when conv_id % 5 = 2 then 'cancel' else 'end' end end").alias("closing"),
    )


def session_of_event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The event table as a stream."""
    schema = read(spark, root, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Experiment runs derived from orders: two arms by key parity, experiment by priority."""
    return read(spark, root, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.substring("o_orderpriority", 1, 1).alias("experiment"),
        F.expr("case when o_orderkey % 2 = 0 then 'control' else 'treatment' end").alias("arm"),
        F.expr("cast(1 as bigint)").alias("agent_success"),
        F.expr("cast(1 as bigint)").alias("task_success"),
        F.expr("cast(case when o_orderkey % 4999 = 0 then 1 else 0 end as bigint)").alias("provider_errors"),
        *[F.expr("cast(1 as bigint)").alias(c) for c in ("source_executions", "source_ids_present", "source_sessions_linked", "active_evaluations", "forwarding_mutations", "never_worse_accepted", "shadow_evaluations")],
        *[F.expr("cast(0 as bigint)").alias(c) for c in ("hook_rewrites", "fail_open_executions", "recovery_requests", "recovery_failures")],
        F.expr("cast(case when o_orderkey % 2 = 0 then 5000 else 1000 + o_orderkey % 50 end as bigint)").alias("source_emitted_bytes"),
        F.expr("cast(4000 as bigint)").alias("source_stdout_bytes"),
        F.expr("cast(1000 as bigint)").alias("source_stderr_bytes"),
        F.expr("cast(1200 as bigint)").alias("candidate_bytes"),
        F.expr("o_orderkey % 900").alias("reducer_duration_us"),
        F.expr("cast(floor(o_totalprice / case when o_orderkey % 2 = 0 then 1 else 2 end) as bigint)").alias("input_uncached"),
        F.expr("cast(floor(o_totalprice) as bigint)").alias("duration_us"),
        F.expr("cast(floor(o_totalprice / 7) as bigint)").alias("dispatch_us"),
        F.expr("o_orderkey % 3").alias("command_retries"),
        F.expr("cast(2 as bigint)").alias("provider_requests"),
        F.expr("o_orderkey % 2").alias("tool_calls"),
        F.expr("o_orderkey % 5 + 1").alias("snapshots"),
        F.expr("o_orderkey % 5 + 1").alias("complete_snapshots"),
        F.expr("cast(floor(o_totalprice) as bigint) - (o_orderkey % 2) * 700").alias("forwarded_bytes"),
        F.expr("cast(case when o_orderkey % 997 = 0 then 1 else 0 end as bigint)").alias("determinism_failures"),
    )


ARMS = ("config_a", "config_b", "no_plugins", "no_memories", "no_hooks", "no_extensions", "ignored")


def arm_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Instruction blocks of seven experiment arms: customers are requests, each arm lacks some blocks."""
    names = ", ".join(f"'{a}'" for a in ARMS)
    return (
        read(spark, root, "customer")
        .select(
            F.expr(f"element_at(array({names}), cast(c_custkey % 7 + 1 as int))").alias("arm"),
            F.expr("(c_custkey div 7) % 6").alias("run"), F.col("c_custkey").alias("request_id"), F.expr("c_custkey % 7").alias("a"),
            F.explode(F.expr("sequence(0, 9)")).alias("j"),
        )
        .where(
            "(j < 7 and not (a = 2 and j in (1, 2)) and not (a = 3 and j = 3) and not (a = 5 and j in (1, 2, 3, 4)) and not (a = 6 and j > 1))"
            " or (j = 7 and request_id % 2 = 0) or (j = 8 and a = 5) or (j = 9 and a = 6)"
        )
        .select("arm", "run", "request_id", F.concat(F.lit("b"), F.col("j").cast("string")).alias("fp"), (F.col("j") + 10).cast("bigint").alias("tokens"))
    )


def arm_requests(spark: SparkSession, root: str) -> DataFrame:
    """Usage of three crossover arms over six rounds; orders are the runs' requests."""
    return read(spark, root, "orders").select(
        F.expr("element_at(array('control', 'null', 'treatment'), cast(o_orderkey % 3 + 1 as int))").alias("arm"),
        F.expr("cast((o_orderkey div 3) % 6 as int)").alias("round"),
        F.col("o_orderkey").alias("request_id"),
        F.expr("unix_micros(cast(o_orderdate as timestamp))").alias("created_us"),
        F.expr("1000 + (o_orderkey div 3) % 100 - case when o_orderkey % 3 = 2 then 300 else 0 end").alias("input_tokens"),
        F.expr("500 + (o_orderkey div 3) % 10").alias("cached_input_tokens"),
        F.expr("500 + (o_orderkey div 3) % 100 - case when o_orderkey % 3 = 2 then 300 else 0 end").alias("uncached_input_tokens"),
        F.expr("20 + o_orderkey % 4").alias("output_tokens"),
        F.col("o_orderpriority").alias("model"),
        F.expr("cast(1 as bigint)").alias("tool_count"),
        F.expr("o_orderkey % 3").alias("effort"),
    )
