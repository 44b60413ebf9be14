"""Sources, reports, audits and the remaining scalar rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.measures import metric, or_unknown, ratio
from ..functions.ranking import Rank, exact_percentiles
from ..operators import composition as comp
from ..operators import reduce as red
from ..operators import shapes
from ..plans import audits, baseline
from ..sources import files
from ..sources.bindings import read, runs, star_trace
from ..sources.trace import cohort, conform, missing_sessions
from .queries_core import _DIST, PERCENTILES, rounded
from .queries_ingest import _scratch
from .registry import query

# --- sources ------------------------------------------------------------------------------------------------


@query("S01_schema_tolerance", "select count(*) as rows_read, 0 as known_cache_writes, count(o_orderkey) as ids from orders")
def schema_tolerance(spark, root):
    raw = read(spark, root, "orders").select(F.col("o_orderkey").alias("snapshot_id"))
    table = conform(raw, "metrics")
    return table.agg(F.count(F.lit(1)).alias("rows_read"), F.count("schema_bytes").alias("known_cache_writes"), F.count("snapshot_id").alias("ids"))


_COHORT = "select session_id from t_workloads where workload = 'building'"


@query(
    "S02_cohort_filter",
    """select (select count(*) from t_sessions where session_id in (select * from c)) as sessions,
         (select count(*) from t_requests join t_operations using (operation_id) where session_id in (select * from c)) as requests,
         (select count(*) from t_attempts where request_id in (select operation_id from t_operations where session_id in (select * from c))) as attempts,
         (select count(*) from t_blocks where snapshot_id in (select snapshot_id from t_snapshots where session_id in (select * from c))) as blocks,
         0 as missing""",
    c=_COHORT,
)
def cohort_filter(spark, root):
    trace = star_trace(spark, root)
    chosen = trace.workloads.where("workload = 'building'").select("session_id")
    kept = cohort(trace, chosen)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        n(kept.sessions, "sessions").crossJoin(n(kept.requests, "requests")).crossJoin(n(kept.attempts, "attempts"))
        .crossJoin(n(kept.blocks, "blocks")).crossJoin(n(missing_sessions(trace, chosen), "missing"))
    )


def receipts(spark, root):
    """Receipts as JSON lines, one per line item."""
    row = F.struct(
        F.when(F.col("l_suppkey") % 40 != 0, F.concat(F.lit("x-"), F.col("l_orderkey").cast("string"))).alias("source_execution_id"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey")).otherwise(F.col("l_orderkey") + 1000000000).cast("string").alias("session_id"),
        F.expr("case l_suppkey % 4 when 0 then 'cargo_test' when 1 then 'ripgrep' when 2 then 'git_status' else 'cargo_check' end").alias("command_family"),
        F.expr("case l_suppkey % 5 when 0 then 'success' when 1 then 'nonzero' when 2 then 'signal' when 3 then 'odd' end").alias("exit_status_class"),
        F.expr("cast(floor(l_extendedprice) as bigint)").alias("raw_stdout_bytes"), F.lit(10).cast("bigint").alias("raw_stderr_bytes"),
        F.expr("cast(floor(l_quantity) as bigint)").alias("emitted_bytes"), (F.col("l_suppkey") % 2 == 0).alias("active"), (F.col("l_suppkey") % 2 == 1).alias("shadow"),
        (F.col("l_suppkey") % 3 == 1).alias("never_worse_accepted"), F.when(F.col("l_suppkey") % 7 == 0, "timeout").alias("fail_open_reason"),
    )
    return read(spark, root, "lineitem").select(F.to_json(row).alias("value"))


@query(
    "S03_receipts",
    """select case l_suppkey % 4 when 0 then 'cargo_test' when 1 then 'ripgrep' when 2 then 'git_status' else 'cargo_check' end as command_family,
         count(*) as executions, count(*) filter (l_suppkey % 5 = 0) as exit_success, count(*) filter (l_suppkey % 5 >= 3) as exit_unknown,
         count(*) filter (l_suppkey % 40 <> 0) as ids_present, count(*) filter (l_suppkey % 3 = 0 and l_partkey in (select c_custkey from customer)) as sessions_linked,
         cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as raw_stdout_bytes, count(*) filter (l_suppkey % 2 = 0) as active_evaluations,
         count(*) filter (l_suppkey % 7 = 0) as fail_open_executions, count(*) filter (l_suppkey % 3 = 1) as never_worse_accepted from lineitem group by 1""",
)
def receipt_totals(spark, root):
    folder = _scratch(spark)
    receipts(spark, root).write.text(f"{folder}/receipts")
    rows = files.read_receipts(spark, f"{folder}/receipts")
    out = files.receipt_totals(rows, star_trace(spark, root).sessions, ["command_family"])
    return out.select(
        "command_family", "executions", "exit_success", "exit_unknown", "ids_present", "sessions_linked", "raw_stdout_bytes", "active_evaluations",
        "fail_open_executions", "never_worse_accepted",
    )


_SIDE = """select c_custkey, c_custkey % 11 = 0 as old, c_custkey % 13 = 0 as bad, c_custkey % 17 = 0 as open, c_custkey % 19 = 0 as twice from customer"""


@query(
    "S04_merge_sidecars",
    """select reason, count(*) as documents from (select case when old then 'unsupported_version' when bad then 'identity_mismatch'
         when open then 'incomplete_capture' when twice then 'duplicate_run_id' else 'accepted' end as reason
         from side, (values (0), (1)) d(copy) where copy = 0 or twice) group by 1""",
    side=_SIDE,
)
def merge_sidecars(spark, root):
    row = F.struct(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("measurement_run_id"), F.col("c_custkey").cast("string").alias("session_id"),
        F.lit(7).alias("agent_pid"), (F.col("c_custkey") % 17 != 0).alias("capture_complete"), F.lit(3).alias("analysis_requests_seen"),
    )
    document = F.struct(
        F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(2).alias("measurement_instrument_version"),
        F.concat(F.when(F.col("c_custkey") % 13 == 0, "other-").otherwise("run-"), F.col("c_custkey").cast("string")).alias("measurement_run_id"),
        F.col("c_custkey").cast("string").alias("session_id"), F.lit(7).alias("agent_pid"), (F.col("c_custkey") % 17 != 0).alias("capture_complete"),
        F.array(row).alias("sessions"),
    )
    customers = read(spark, root, "customer").select("*", F.explode(F.expr("case when c_custkey % 19 = 0 then array(0, 1) else array(0) end")).alias("copy"))
    documents = customers.select(
        F.concat_ws("/", F.lit("sidecar"), F.col("c_custkey").cast("string"), F.col("copy").cast("string")).alias("path"), F.parse_json(F.to_json(document)).alias("doc")
    )
    accepted, rejected = files.merge_sidecars(documents)
    both = accepted.select(F.lit("accepted").alias("reason")).unionByName(rejected.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


def report_documents(spark, root):
    """A catalogue of report documents: five per folder, cohorts of 10 to 40 sessions and a convergence file."""
    share = lambda name, e: F.struct(F.lit(name).alias("name"), e.alias("token_share"))
    k = F.col("c_custkey")
    report = F.struct(
        F.struct(F.struct((k % 40).alias("count")).alias("requests_per_session"), (k * 3).alias("requests_total")).alias("dataset"),
        F.concat(F.lit("n"), (k % 4).cast("string")).alias("cohort_label"),
        F.struct(F.when(k % 3 == 0, "failed").otherwise("passed").alias("measurement_integrity")).alias("quality"),
        F.struct(
            F.array(share("json", (k % 10) / 10.0), share("plain_text", (k % 7) / 10.0)).alias("detected_content"),
            F.array(F.struct(F.lit("debugging").alias("name"), (k % 5).alias("session_count"), ((k % 8) / 8.0).alias("workload_token_share"),
                             F.array(share("json", (k % 4) / 4.0)).alias("by_detected_content"))).alias("by_workload"),
        ).alias("composition"),
        F.struct(((k % 9) / 9.0).alias("cache_ratio")).alias("provider_usage"), F.struct(((k % 6) / 6.0).alias("exact_repeated_token_share")).alias("repetition"),
    )
    converged = F.struct(
        F.when(k % 2 == 0, "CONVERGED").otherwise("NEED_MORE_SESSIONS").alias("status"),
        F.array(F.struct(F.lit(20).alias("current_sessions"), (k % 3 == 0).alias("stable"))).alias("transitions"),
    )
    folder = F.format_string("baseline-%03d", (k / 5).cast("int"))
    name = F.when(k % 5 == 4, F.format_string("convergence_%05d.json", k.cast("int"))).otherwise(
        F.concat(F.lit("baseline_n"), ((k % 5 + 1) * 10).cast("string"), F.lit(".json"))
    )
    return read(spark, root, "customer").select(
        F.concat_ws("/", folder, name).alias("path"), F.parse_json(F.when(k % 5 == 4, F.to_json(converged)).otherwise(F.to_json(report))).alias("doc")
    )


_CAT = """select *, 'baseline-' || case when c_custkey // 5 < 1000 then lpad((c_custkey // 5)::varchar, 3, '0') else (c_custkey // 5)::varchar end as id, (c_custkey % 5 + 1) * 10 as n, c_custkey % 5 = 4 as conv
  from customer"""


@query(
    "S05_report_catalogue",
    """select id, case id when 'baseline-001' then 'exploratory' when 'baseline-002' then 'legacy_uncertified' when 'baseline-003' then 'valid'
         else case when max(case when conv and c_custkey % 2 = 0 then 1 else 0 end) = 1 then 'converged' else 'valid' end end as status,
         arg_max(c_custkey % 40, n) filter (not conv) as sessions, arg_max(c_custkey * 3, n) filter (not conv) as requests,
         'n' || arg_max(c_custkey % 4, n) filter (not conv) as cohort,
         arg_max(case when c_custkey % 3 = 0 then 'failed' else 'passed' end, n) filter (not conv) as measurement_integrity from cat group by 1""",
    cat=_CAT,
)
def report_catalogue(spark, root):
    return files.report_catalogue(report_documents(spark, root))


@query(
    "S06_convergence_points",
    """select p.id, p.n as size, 'N' || p.n as cohort, round((p.c_custkey % 10) / 10.0, 9) as json_share, round((p.c_custkey % 7) / 10.0, 9) as plain_share,
         cast(null as double) as unknown_share, round((p.c_custkey % 9) / 9.0, 9) as cache_ratio, round((p.c_custkey % 6) / 6.0, 9) as repetition,
         case when p.n = 20 then c.c_custkey % 3 = 0 end as stable
       from cat p left join (select * from cat where conv) c on c.id = p.id where not p.conv and p.n <= 40""",
    cat=_CAT,
)
def convergence_points(spark, root):
    return rounded(files.convergence_points(report_documents(spark, root)), "json_share", "plain_share", "cache_ratio", "repetition")


@query(
    "S07_report_workloads",
    """select id || '/baseline_n' || n || '.json' as path, 'debugging' as workload, c_custkey % 5 as sessions, (c_custkey % 8) / 8.0 as token_share,
         (c_custkey % 4) / 4.0 as json_share, cast(null as double) as plain_share, cast(null as double) as unknown_share from cat where not conv""",
    cat=_CAT,
)
def report_workloads(spark, root):
    return files.report_workloads(report_documents(spark, root))


def source_documents(spark, root):
    """A source report per priority, its rows split over one document per 50 runs."""
    r = F.struct(
        F.when(F.col("arm") == "control", "ExplicitRgActiveControl").otherwise("ExplicitRgActive").alias("arm"), F.lit(True).alias("task_success"),
        "source_stdout_bytes", "source_stderr_bytes", "source_emitted_bytes", "candidate_bytes", "active_evaluations", "forwarding_mutations", "recovery_requests",
        "never_worse_accepted", F.struct(F.col("duration_us").alias("input_total"), F.col("input_uncached")).alias("provider_usage"),
    )
    document = F.struct(
        F.concat(F.lit("exp-"), F.col("run_id").cast("string")).alias("experiment_id"), F.lit("explicit-rg-active").alias("reducer"), F.lit(1).alias("pairs"),
        F.struct(F.when(F.col("run_id") % 3 == 0, "pass").when(F.col("run_id") % 3 == 1, "reject").alias("decision")).alias("analysis"), F.array(r).alias("rows"),
    )
    return runs(spark, root).select(F.concat(F.lit("r/"), F.col("run_id").cast("string")).alias("path"), F.parse_json(F.to_json(document)).alias("doc"))


@query(
    "S08_source_reports",
    """select 'exp-' || run_id as experiment_id, case run_id % 3 when 0 then 'pass' when 1 then 'reject' else 'pending' end as decision, 'rg' as command_family,
         case when arm = 'treatment' then 1 else 0 end as executions, case when arm = 'treatment' then 5000 else 0 end as raw_bytes,
         case when arm = 'treatment' then source_emitted_bytes else 0 end as candidate_bytes,
         case when arm = 'treatment' then (5000 - source_emitted_bytes) * 10000 // 5000 end as reduction_bp, case when arm = 'treatment' then 1 else 0 end as evaluations from t_runs""",
)
def source_reports(spark, root):
    return files.source_reports(source_documents(spark, root)).select(
        "experiment_id", "decision", "command_family", "executions", "raw_bytes", "candidate_bytes", "reduction_bp", "evaluations"
    )


@query(
    "S08_source_arms",
    """select 'exp-' || run_id as experiment_id, case arm when 'control' then 'ExplicitRgActiveControl' else 'ExplicitRgActive' end as arm, 1 as sessions,
         1 as successful_sessions, duration_us as input_tokens, input_uncached as uncached_input_tokens from t_runs""",
)
def source_arms(spark, root):
    return files.source_arms(source_documents(spark, root))


@query(
    "S11_report_sink",
    """select coalesce(kind, 'unknown') as name, count(*) as block_count, cast(sum(raw_bytes) as bigint) as bytes from t_blocks group by 1""",
)
def report_sink(spark, root):
    folder = _scratch(spark)
    files.write_report({"by_kind": comp.subtotal_by(star_trace(spark, root).blocks, "kind")}, folder)
    return spark.read.parquet(f"{folder}/parquet/by_kind").select("name", "block_count", "bytes")


@query(
    "P14_privacy_projection",
    "select block_id, kind, role, origin, raw_bytes, estimated_tokens from t_blocks",
)
def privacy_projection(spark, root):
    return star_trace(spark, root).blocks.select("block_id", "kind", "role", "origin", "raw_bytes", "estimated_tokens")


@query("P06_empty_label_unknown", "select coalesce(nullif(case when l_suppkey % 3 = 0 then '' when l_suppkey % 3 = 1 then l_returnflag end, ''), 'unknown') as name, count(*) as n from lineitem group by 1")
def empty_label(spark, root):
    value = F.expr("case when l_suppkey % 3 = 0 then '' when l_suppkey % 3 = 1 then l_returnflag end")
    return read(spark, root, "lineitem").groupBy(or_unknown(value).alias("name")).agg(F.count(F.lit(1)).alias("n"))


# --- shapes and wide metrics ----------------------------------------------------------------------------------


def _gate(condition, full="s.status = 'complete'"):
    return (
        f"case when count(*) filter ({condition}) = 0 and not any_value({full}) then null when count(*) filter (({condition}) and estimated_tokens is null) = 0"
        f" then cast(coalesce(sum(estimated_tokens) filter ({condition}), 0) as bigint) end"
    )


@query(
    "D45_snapshot_metrics",
    f"""select m.*, round(case when m.visible_estimated_tokens > 0 then m.tokens_kind_tool_result::double / m.visible_estimated_tokens end, 9) as tool_result_share,
         round(case when f.gu > 0 then case when m.visible_estimated_tokens > 0 then f.su::double / m.visible_estimated_tokens end when s.status = 'complete' then 0.0 end, 9) as unique_content_share
       from (select s.snapshot_id, {_gate('b.block_id is not null')} as visible_estimated_tokens, {_gate("b.kind = 'text'")} as tokens_kind_text,
               {_gate("b.kind = 'tool_result'")} as tokens_kind_tool_result, {_gate("b.role = 'user'")} as tokens_role_user,
               {_gate("b.origin = 'tool_generated'")} as tokens_origin_tool_generated,
               case when count(*) filter (b.kind = 'tool_definition') = 0 and not any_value(s.status = 'complete') then null else count(*) filter (b.kind = 'tool_definition') end as tool_count
             from t_snapshots s left join t_blocks b on b.snapshot_id = s.snapshot_id group by s.snapshot_id) m
       join t_snapshots s on s.snapshot_id = m.snapshot_id
       left join (select snapshot_id, count(*) filter (n = 1) as gu, case when coalesce(sum(missing) filter (n = 1), 0) = 0 then coalesce(sum(t) filter (n = 1), 0) end as su
         from (select snapshot_id, exact_fp, count(*) as n, sum(estimated_tokens) as t, count(*) filter (estimated_tokens is null) as missing from t_blocks group by 1, 2) group by 1) f
         on f.snapshot_id = m.snapshot_id""",
)
def snapshot_metrics(spark, root):
    trace = star_trace(spark, root)
    out = shapes.snapshot_metrics(trace.snapshots, trace.blocks).select(
        "snapshot_id", "visible_estimated_tokens", "tokens_kind_text", "tokens_kind_tool_result", "tokens_role_user", "tokens_origin_tool_generated",
        "tool_count", "tool_result_share", "unique_content_share",
    )
    return rounded(out, "tool_result_share", "unique_content_share")


@query(
    "D38_candidate_coverage",
    """select compressor_id, case when input_bytes < 1024 then '<1KiB' when input_bytes < 1048576 then '1KiB-1MiB' else '>=1MiB' end as size_bucket,
         coalesce(b.detected_kind, 'unavailable') as detected_kind, count(*) as evaluations from t_candidates join t_blocks b using (block_id) group by 1, 2, 3""",
)
def candidate_coverage(spark, root):
    trace = star_trace(spark, root)
    return shapes.candidate_coverage(trace.candidates, trace.blocks)


_FAM = """case tool_name when 'git_status' then 'version_control' when 'rg-search' then 'search' when 'cargo_test' then 'search' when 'read_file' then 'filesystem'
  when 'shell' then 'shell_generic' when 'npm_install' then 'dependency' else 'unknown' end"""


@query(
    "D39_family_characterisation",
    f"""select t.family, t.detected_kind, t.blocks, t.estimated_tokens, t.raw_bytes, round(t.estimated_tokens::double / sum(t.estimated_tokens) over (), 9) as exposure_share,
         l[cast(floor((blocks - 1) * 0.5::double) as int) + 1] as raw_bytes_p50, l[cast(floor((blocks - 1) * 0.9::double) as int) + 1] as raw_bytes_p90,
         l[cast(floor((blocks - 1) * 0.95::double) as int) + 1] as raw_bytes_p95, l[cast(floor((blocks - 1) * 0.99::double) as int) + 1] as raw_bytes_p99,
         coalesce(f.u, 0) as unique_fingerprints, coalesce(f.r, 0) as repeated_blocks
       from (select family, detected_kind, count(*) as blocks, cast(sum(coalesce(estimated_tokens, 0)) as bigint) as estimated_tokens, cast(sum(raw_bytes) as bigint) as raw_bytes,
               list_sort(list(raw_bytes)) as l from x group by 1, 2) t
       left join (select family, detected_kind, count(*) as u, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as r from (select family, detected_kind, exact_fp, count(*) as n
         from x where exact_fp is not null group by 1, 2, 3) group by 1, 2) f using (family, detected_kind)""",
    x=f"select {_FAM} as family, coalesce(detected_kind, 'unavailable') as detected_kind, raw_bytes, estimated_tokens, exact_fp from t_blocks where origin = 'tool_generated' and kind = 'tool_result'",
)
def family_characterisation(spark, root):
    return rounded(shapes.family_characterisation(star_trace(spark, root).blocks), "exposure_share")


@query("F11_tool_family", f"select coalesce(tool_name, 'none') as tool, {_FAM} as family, count(*) as blocks from t_blocks group by 1, 2")
def tool_families(spark, root):
    rows = star_trace(spark, root).blocks
    return rows.groupBy(F.coalesce("tool_name", F.lit("none")).alias("tool"), labels.tool_family("tool_name").alias("family")).agg(F.count(F.lit(1)).alias("blocks"))


@query(
    "D39_shape_counts",
    """select detected_kind, case when detected_kind = 'json' then case when line_count % 3 = 0 then 'object_or_scalar' when raw_bytes % 4 > 1 then 'nested_array_or_object'
         else 'array_or_object' end else case when raw_bytes % 2 > 0 then 'duplicate_lines' when line_count > 1 then 'multi_line' else 'single_line_or_empty' end end as shape,
         count(*) as blocks, cast(coalesce(sum(estimated_tokens), 0) as bigint) as estimated_tokens, cast(sum(raw_bytes) as bigint) as raw_bytes
       from t_blocks where origin = 'tool_generated' and kind = 'tool_result' and detected_kind in ('json', 'plain_text') group by 1, 2""",
)
def shape_counts(spark, root):
    rows = star_trace(spark, root).blocks.withColumn("items", F.expr("case when line_count % 3 <> 0 then line_count end")).withColumn("depth", F.col("raw_bytes") % 4)
    return shapes.shape_counts(rows, "items", "depth", "line_count", F.col("raw_bytes") % 2)


_INV = """select coalesce(origin, 'unavailable') as origin, coalesce(kind, 'unavailable') as kind, coalesce(role, 'unavailable') as role,
    coalesce(detected_kind, 'unavailable') as detected_kind, count(*) as blocks, cast(sum(raw_bytes) as bigint) as raw_bytes,
    cast(sum(estimated_tokens) as bigint) as estimated_tokens, min(raw_bytes) as min_bytes, max(raw_bytes) as max_bytes, count(tool_name) as named_blocks
  from t_blocks group by 1, 2, 3, 4"""


@query("D41_group_inventory", _INV)
def group_inventory(spark, root):
    return shapes.group_inventory(star_trace(spark, root).blocks)


@query(
    "D41_first_target",
    """select * from inv where origin = 'tool_generated' and kind = 'tool_result' and detected_kind in ('plain_text', 'search_results', 'json')
       order by coalesce(estimated_tokens, 0) desc, blocks desc, origin, kind, role, detected_kind limit 1""",
    inv=_INV,
)
def first_target(spark, root):
    return shapes.first_target(shapes.group_inventory(star_trace(spark, root).blocks))


# --- baseline and convergence -----------------------------------------------------------------------------------


@query(
    "D36_baseline_report",
    """select 'by_kind' as section, kind as name, unnest(['block_count', 'bytes', 'estimated_tokens', 'token_share', 'bytes_share']) as metric,
         round(unnest([block_count::double, bytes::double, tokens::double, tokens / sum(tokens) over (), bytes / sum(bytes) over ()]), 6) as value
       from (select kind, count(*) as block_count, sum(raw_bytes) as bytes, coalesce(sum(estimated_tokens), 0) as tokens from t_blocks group by 1)
       union all select 'detected_content', kind, unnest(['block_count', 'bytes', 'estimated_tokens', 'token_share', 'bytes_share']),
         round(unnest([block_count::double, bytes::double, tokens::double, tokens / sum(tokens) over (), bytes / sum(bytes) over ()]), 6)
       from (select coalesce(detected_kind, 'unknown') as kind, count(*) as block_count, sum(raw_bytes) as bytes, coalesce(sum(estimated_tokens), 0) as tokens from t_blocks group by 1)""",
)
def baseline_report(spark, root):
    sections = baseline.report_sections(star_trace(spark, root))
    return rounded(baseline.report_rows({k: sections[k] for k in ("by_kind", "detected_content")}), "value", digits=6)


@query("D36_baseline_report_all_sections")
def baseline_report_all(spark, root):
    return rounded(baseline.report_rows(baseline.report_sections(star_trace(spark, root), stored=True)), "value", digits=6)


def cohort_reports(spark, root):
    """Cohort rows for the gate: regions are measurements, their nations growing cohorts of sessions."""
    customers = read(spark, root, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.expr("cast(floor(c_acctbal) as bigint)")).alias("balance")
    )
    nation = read(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("measurement_id"))
    k = F.col("c_nationkey")
    rows = nation.join(customers, "c_nationkey").withColumn("jitter", (F.col("balance") % 100) / 5000.0)
    return rows.select(
        "measurement_id", (k * 4 + 2).cast("bigint").alias("sessions"),
        *[(F.lit(0.3) + (F.col("jitter") if i < 2 else F.lit(0.0))).alias(name) for i, name in enumerate(baseline.SHARES)],
        F.lit(100.0).alias("block_size_p50"), (F.lit(900.0) + k).alias("block_size_p90"), F.lit("json,plain_text").alias("top3"),
        F.lit(0.99).alias("analysis_coverage"), F.lit(1.0).alias("correlation_coverage"),
        F.when(F.col("measurement_id") == 3, 1).otherwise(0).alias("forwarding_errors"), F.lit(0).alias("context_malformed"),
        F.lit("passed").alias("integrity"), F.lit("v2").alias("manifest"), "customers",
    )


_REPORTS = """select n_regionkey as measurement_id, n_nationkey * 4 + 2 as sessions, n_nationkey as k,
    0.3::double + (balance % 100) / 5000.0::double as share, 900.0::double + n_nationkey as p90, customers
  from nation join (select c_nationkey, count(*) as customers, sum(cast(floor(c_acctbal) as bigint)) as balance from customer group by 1) c on c.c_nationkey = n_nationkey"""
_MOVES = """select measurement_id, sessions, lag(sessions) over w as previous_sessions, abs(share - lag(share) over w) < 0.02 as share_stable,
    abs(p90 - lag(p90) over w) / greatest(p90, lag(p90) over w) < 0.1 as p90_stable from rep window w as (partition by measurement_id order by sessions)"""


@query(
    "Q10_transitions",
    """select measurement_id, sessions, previous_sessions, share_stable as plain_text_share_stable, p90_stable as block_size_p90_stable, share_stable and p90_stable as stable
       from mv where previous_sessions is not null""",
    rep=_REPORTS, mv=_MOVES,
)
def transitions(spark, root):
    return baseline.transitions(cohort_reports(spark, root)).select(
        "measurement_id", F.col("sessions"), "previous_sessions", "plain_text_share_stable", "block_size_p90_stable", "stable"
    )


@query(
    "Q10_convergence_gate",
    """select r.measurement_id, r.sessions, r.cohorts, r.measurement_id <> 3 as quality_pass, s.flagged as flagged_strata,
         case when r.sessions >= 40 and t.n >= 2 and r.measurement_id <> 3 and s.flagged = 0 and t.last2 then 'CONVERGED' else 'NEED_MORE_SESSIONS' end as status
       from (select measurement_id, max(sessions) as sessions, count(*) as cohorts from rep group by 1) r
       join (select measurement_id, count(*) as n, bool_and(ok) filter (rn <= 2) as last2 from (select measurement_id, share_stable and p90_stable as ok,
           row_number() over (partition by measurement_id order by sessions desc) as rn from mv where previous_sessions is not null) group by 1) t using (measurement_id)
       join (select measurement_id, count(*) filter (customers >= 5 and customers % 13 = 0) as flagged from rep group by 1) s using (measurement_id)""",
    rep=_REPORTS, mv=_MOVES,
)
def convergence_gate(spark, root):
    reports = cohort_reports(spark, root)
    strata = reports.select(
        "measurement_id", F.lit("workload").alias("dimension"), F.lit("x").alias("name"), F.col("customers").alias("eligible_requests"),
        F.when(F.col("customers") % 13 == 0, 0.2).otherwise(0.0).alias("drop_rate"),
    )
    return baseline.convergence(reports, strata).select("measurement_id", "sessions", "cohorts", "quality_pass", "flagged_strata", "status")


# --- audits --------------------------------------------------------------------------------------------------------


def _fk(t, c, p, k):
    return f"select 'foreign_key' as \"constraint\", '{t}.{c}' as subject, count(*) as violations from t_{t} where {c} is not null and {c} not in (select {k} from t_{p})"


@query(
    "Q12_constraint_audit",
    " union all ".join(
        [_fk(*f) for f in audits.FOREIGN_KEYS]
        + [f"select 'unique', '{t}({', '.join(c)})', count(*) from (select 1 from t_{t} group by {', '.join(c)} having count(*) > 1)" for t, c in audits.UNIQUE_KEYS]
        + [f"select 'enum', '{t}.{c}', count(*) from t_{t} where {c} is not null and {c} not in {v}" for t, c, v in audits.ENUMS]
        + [f"select 'range', '{t}.{c}', count(*) from t_{t} where {c} < {lo}" + (f" or {c} > {hi}" if hi is not None else "") for t, c, lo, hi in audits.RANGES]
    ),
)
def constraint_audit(spark, root):
    return audits.constraint_audit(star_trace(spark, root))


@query(
    "Q13_binding_conflicts",
    """select session_id, logical_content_id, count(*) as bindings, concat_ws(',', case when min(raw) <> max(raw) then 'raw_content_id' end,
         case when min(v) <> max(v) then 'compressor_version' end) as conflicts
       from (select l_suppkey as session_id, l_partkey as logical_content_id, case when l_linenumber = 7 then 'other' else 'same' end as raw, l_linenumber // 6 as v from lineitem)
       group by 1, 2 having min(raw) <> max(raw) or min(v) <> max(v)""",
)
def binding_conflicts(spark, root):
    rows = read(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), F.col("l_partkey").alias("logical_content_id"),
        F.expr("case when l_linenumber = 7 then 'other' else 'same' end").alias("raw_content_id"), F.lit("r").alias("rendered_content_id"),
        F.expr("l_linenumber div 6").alias("compressor_version"), F.lit("1").alias("policy_version"),
    )
    return audits.binding_conflicts(rows).withColumn("conflicts", F.array_join("conflicts", ","))


@query(
    "Q14_protection_class",
    """select case when p_partkey % 5 = 0 then case when p_size >= 25 then 'young_orphan' else 'old_orphan' end when p_partkey % 7 = 0 then 'pinned'
         when p_partkey in (select l_partkey from lineitem where l_returnflag = 'R') then 'recoverable' else 'referenced' end as protection, count(*) as objects from part group by 1""",
)
def protection_class(spark, root):
    part = read(spark, root, "part")
    found = part.select(F.col("p_partkey").alias("content_id"), F.col("p_size").alias("modified_at"))
    objects = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("content_id"), F.expr("case when p_partkey % 7 = 0 then 2 else 0 end").alias("pin_count"))
    needed = read(spark, root, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("raw_content_id"), F.lit(None).cast("bigint").alias("provenance_content_id"))
    out = audits.protection_classes(found, objects, needed, F.lit(25))
    return out.groupBy("protection").agg(F.count(F.lit(1)).alias("objects"))


@query(
    "Q15_causal_edges",
    """select reason, count(*) as edges from (select case when l_orderkey = l_partkey then 'self_edge' when l_linenumber = 7 then 'unknown_relationship'
         when l_orderkey not in (select o_orderkey from orders) then 'missing_parent' when l_partkey not in (select o_orderkey from orders) then 'missing_child' end as reason from lineitem)
       where reason is not null group by 1""",
)
def causal_edges(spark, root):
    edges = read(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").alias("child_id"), F.expr("case when l_linenumber = 7 then 'guessed' else 'spawned' end").alias("relationship")
    )
    bad = audits.edge_violations(edges, star_trace(spark, root).operations)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("edges"))


# --- scalar rules -------------------------------------------------------------------------------------------------


@query(
    "F01_linear_percentile",
    "select kind, quantile_cont(raw_bytes, 0.5) as p50, round(quantile_cont(raw_bytes, 0.9), 6) as p90 from t_blocks group by 1",
)
def linear_percentile(spark, root):
    out = exact_percentiles(star_trace(spark, root).blocks, ["kind"], "raw_bytes", [Rank("p50", 0.5), Rank("p90", 0.9)]).drop("count")
    return rounded(out, "p90", digits=6)


@query("F05_ratio", "select o_orderkey, round((o_orderkey % 7)::double / nullif(o_orderkey % 5, 0), 9) as value from orders")
def safe_ratio(spark, root):
    return read(spark, root, "orders").select("o_orderkey", F.round(ratio(F.col("o_orderkey") % 7, F.col("o_orderkey") % 5), 9).alias("value"))


@query(
    "F09_length_bucket",
    """select case when n is null then 'unavailable' when n <= 0 then '0' when n = 1 then '1' when n < 10 then '2-9' when n < 100 then '10-99' when n < 1000 then '100-999' else '1000+' end as bucket,
         count(*) as parts from (select case when p_partkey % 50 <> 0 then p_partkey % 1500 end as n from part) group by 1""",
)
def length_bucket(spark, root):
    value = F.expr("case when p_partkey % 50 <> 0 then p_partkey % 1500 end")
    return read(spark, root, "part").groupBy(labels.length_bucket(value).alias("bucket")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    "F10_size_buckets",
    """select case when t < 256 then '<256' when t < 1024 then '256-1K' when t < 4096 then '1K-4K' when t < 16384 then '4K-16K' else '>16K' end as tokens,
         case when t * 20 < 1024 then '<1KiB' when t * 20 < 1048576 then '1KiB-1MiB' else '>=1MiB' end as bytes, count(*) as requests
       from (select cast(floor(o_totalprice / 10) as bigint) as t from orders) group by 1, 2""",
)
def size_buckets(spark, root):
    t = F.expr("cast(floor(o_totalprice / 10) as bigint)")
    return read(spark, root, "orders").groupBy(labels.token_bucket(t).alias("tokens"), labels.byte_bucket(t * 20).alias("bytes")).agg(F.count(F.lit(1)).alias("requests"))


@query(
    "F15_cache_risk",
    """select case when bp is null then 'unknown' when bp >= 9000 and coalesce(n, 0) > 1 then 'low' when bp >= 5000 then 'medium' else 'high' end as risk, count(*) as rows_seen
       from (select case when l_suppkey % 9 <> 0 then l_partkey * 7 % 10001 end as bp, case when l_tax > 0 then l_linenumber end as n from lineitem) group by 1""",
)
def cache_risk(spark, root):
    rows = read(spark, root, "lineitem").select(F.expr("case when l_suppkey % 9 <> 0 then l_partkey * 7 % 10001 end").alias("bp"), F.expr("case when l_tax > 0 then l_linenumber end").alias("n"))
    return rows.groupBy(labels.cache_risk("bp", "n").alias("risk")).agg(F.count(F.lit(1)).alias("rows_seen"))


@query(
    "F27_string_helpers",
    """select lower(c_mktsegment) || ':' || substr(c_name, 1, 4) as label, count(*) filter (c_name like 'Customer%') as matched,
         cast(sum(case when c_acctbal < 0 then 1 else 0 end) as bigint) as negative, hex(lower(c_mktsegment)) as code from customer group by 1, 4""",
)
def string_helpers(spark, root):
    segment = F.lower("c_mktsegment")
    return read(spark, root, "customer").groupBy(
        F.concat(segment, F.lit(":"), F.substring("c_name", 1, 4)).alias("label"), F.hex(segment).alias("code")
    ).agg(F.count(F.when(F.col("c_name").like("Customer%"), 1)).alias("matched"), F.sum((F.col("c_acctbal") < 0).cast("bigint")).alias("negative"))


@query(
    "F29_metric_source",
    """select attempt_id, input_cached as value, case when input_cached is null then 'unavailable' else 'provider_reported' end as source from t_usage""",
)
def metric_source(spark, root):
    return star_trace(spark, root).usage.select("attempt_id", metric("input_cached", "provider_reported").alias("m")).select("attempt_id", "m.value", "m.source")


# --- extension points ------------------------------------------------------------------------------------------------


@query("U01_registered_estimator", "select doc_id, greatest(1, cast(ceil(strlen(text) / 4.0) as bigint)) as tokens, 'byte_quarter' as estimator, 1 as version from documents")
def registered_estimator(spark, root):
    """An estimator is a column function; its id and version stand beside its values."""
    return read(spark, root, "documents").select(
        "doc_id", labels.byte_quarter_tokens(F.octet_length("text")).alias("tokens"), F.lit("byte_quarter").alias("estimator"), F.lit(1).alias("version")
    )


@query(
    "U03_registered_compressor",
    """select doc_id, case when strlen(text) < 256 then 'below_minimum' when strlen(c) >= strlen(text) then 'no_improvement' else 'applicable' end as status,
         case when strlen(text) >= 256 then strlen(c) end as output_bytes
       from (select doc_id, text, regexp_replace(text, ' +', ' ', 'g') as c from documents)""",
)
def registered_compressor(spark, root):
    """A reducer of one's own: runs of blanks become one."""

    def squeeze(df, text="text"):
        return df.withColumn("candidate", F.regexp_replace(text, " +", " ")).withColumn("failure", F.lit(None).cast("string"))

    rows = read(spark, root, "documents").select("doc_id", "text").withColumn("detected_kind", F.lit("plain_text"))
    out = red.evaluate(red.gated(rows, "text.squeeze", job=squeeze, min_bytes=256))
    return out.select("doc_id", F.when(F.col("output_bytes") >= F.col("input_bytes"), "no_improvement").otherwise(F.col("status")).alias("status"), "output_bytes")


@query(
    "U04_registered_reducer",
    """select doc_id, decision, strlen(c) as candidate_bytes, strlen(text) >= 300 and strlen(c) < strlen(text) as accepted,
         strlen(text) >= 300 and strlen(c) < strlen(text) and decision = 'accepted_opt_in' as applied,
         sha256(case when strlen(text) >= 300 and strlen(c) < strlen(text) and decision = 'accepted_opt_in' then c else text end) as output_fp
       from (select doc_id, text, regexp_replace(text, '\n+', chr(10), 'g') as c, unnest(['accepted_opt_in', 'shadow_only']) as decision from documents)""",
)
def registered_reducer(spark, root):
    """A reducer of one's own as a table function: empty lines go, where the policy says so."""
    red.register_reducer(spark, "without_empty_lines", lambda text: re.sub("\n+", "\n", text), min_bytes=300)
    docs = read(spark, root, "documents").select("doc_id", "text")
    parts = []
    for decision in ("accepted_opt_in", "shadow_only"):
        part = spark.sql(f"SELECT * FROM without_empty_lines(TABLE({{docs}}), column => 'text', decision => '{decision}')", docs=docs)
        parts.append(part.withColumn("decision", F.lit(decision)))
    whole = parts[0].unionByName(parts[1])
    return whole.select("doc_id", "decision", "candidate_bytes", "accepted", "applied", F.sha2("output", 256).alias("output_fp"))
