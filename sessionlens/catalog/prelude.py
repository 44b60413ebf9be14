"""The bindings of `sources.bindings` as ANSI-style common table expressions for the SQL check."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "t_sessions": """
        select c_custkey as session_id,
               make_timestamp(1704067200000000 + c_custkey * 60000000) as started_at,
               case when c_custkey % 7 <> 0 then make_timestamp(1704067200000000 + c_custkey * 60000000
                    + cast(floor(abs(c_acctbal)) as bigint) * 1000000) end as ended_at,
               case c_custkey % 5 when 0 then 'active' when 1 then 'closing' when 2 then 'stale' else 'closed' end as state
        from customer""",
    "t_workloads": """
        select c_custkey as session_id, lower(c_mktsegment) as workload,
               case when c_custkey % 2 = 0 then 'parallel' else 'serial' end as concurrency_mode
        from customer where c_custkey % 9 <> 0""",
    "t_operations": """
        select o_orderkey as operation_id, o_custkey as session_id, 'inference' as kind,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'incomplete' end as status
        from orders""",
    "t_requests": """
        select o_orderkey as request_id, o_orderkey as operation_id,
               case when o_orderkey % 3 = 0 then '/v1/responses/' when o_orderkey % 3 = 1 then 'V1/Responses'
                    else 'v1/models' end as route,
               case when o_orderkey % 14 = 0 then 'GET' else 'POST' end as method,
               cast(floor(o_totalprice) as bigint) as request_bytes,
               case when o_orderstatus = 'P' then 'compaction_v2' when o_orderkey % 50 = 0 then 'compaction'
                    when o_orderkey % 17 = 0 then null else 'turn' end as request_kind,
               case when o_orderkey % 2 = 0 then 'http_sse' else 'websocket' end as transport,
               o_orderpriority as model,
               case o_orderkey % 4 when 1 then 'low' when 2 then 'medium' when 3 then 'high' end as reasoning_effort,
               case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'partial' else 'complete' end
                    as observation_status,
               case when o_orderstatus = 'P' and o_orderkey % 4 = 1 then 'manual'
                    when o_orderstatus = 'P' and o_orderkey % 4 < 3 then 'auto' end as compaction_trigger,
               epoch_us(o_orderdate) as created_us
        from orders""",
    "t_lines": """
        select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as ordinal
        from lineitem""",
    "t_attempts": """
        select concat_ws('-', cast(l_orderkey as varchar), cast(ordinal as varchar)) as attempt_id,
               l_orderkey as request_id, ordinal,
               case when l_suppkey % 20 = 3 then 500 when l_suppkey % 20 = 4 then 429 when l_suppkey % 20 = 5 then null
                    else 200 end as status_code,
               case when l_suppkey % 20 in (3, 4) then 'errored' when l_suppkey % 20 = 5 then null
                    when l_suppkey % 20 = 6 then 'cancelled' else 'completed' end as status,
               case when l_suppkey % 25 = 9 then 'connection_reset' end as transport_error,
               case when l_suppkey % 20 = 4 then 'rate_limit' end as error_code,
               case when l_suppkey % 20 <> 5 then cast(floor(l_extendedprice) as bigint) end as ttfb_us,
               case when l_suppkey % 20 > 5 then cast(floor(l_extendedprice * 2) as bigint) end as ttft_us,
               case when l_suppkey % 20 <> 5 then cast(floor(l_extendedprice * 10) as bigint) end as duration_us,
               l_linenumber % 2 = 0 as compaction_output_seen
        from t_lines""",
    "t_usage": """
        select concat_ws('-', cast(l_orderkey as varchar), cast(ordinal as varchar)) as attempt_id,
               case when l_suppkey % 50 <> 7 then cast(floor(l_extendedprice) as bigint) end as input_total,
               case when l_suppkey % 10 <> 0 then cast(floor(l_extendedprice * l_discount) as bigint) end as input_cached,
               case when l_suppkey % 10 > 2 then cast(floor(l_extendedprice) as bigint)
                    - cast(floor(l_extendedprice * l_discount) as bigint) end as input_uncached,
               cast(floor(l_quantity) as bigint) as output_total,
               case when l_tax > 0 then cast(floor(l_quantity / 2) as bigint) end as output_reasoning
        from t_lines where l_quantity > 1""",
    "t_snapshots": """
        select o_orderkey * 10 + v as snapshot_id, o_custkey as session_id,
               case when o_orderkey % 101 = 0 then o_orderkey + 1000000000000 else o_orderkey end as provider_request_id,
               v as analysis_version,
               case o_orderkey % 11 when 0 then 'partial' when 1 then 'dropped' else 'complete' end as status,
               case when o_orderkey % 31 <> 0 then epoch_us(o_orderdate) end as started_at_us,
               case when o_orderkey % 11 <> 1 and o_orderkey % 29 <> 0 then epoch_us(o_orderdate) + v * 1000 end
                    as completed_at_us,
               case when o_orderkey % 58 = 0 then epoch_us(o_orderdate) + 5000 end as recovered_at_us,
               case when o_orderkey % 13 = 0 then 'unmatched' else 'correlated' end as correlation_status,
               case when o_orderkey % 19 = 0 then 'malformed' when o_orderkey % 7 = 0 then 'explicit_only'
                    else 'complete' end as logical_context_status,
               o_orderkey % 37 <> 0 as explicit_request_complete
        from orders, (values (1), (2)) as versions(v)
        where o_orderkey % 23 <> 0 and (v = 1 or o_orderkey % 10 = 0)""",
    "t_blocks": """
        select concat_ws('-', cast(l_orderkey * 10 + v as varchar), cast(ordinal - 1 as varchar)) as block_id,
               l_orderkey * 10 + v as snapshot_id, ordinal - 1 as ordinal,
               case l_suppkey % 6 when 0 then 'text' when 1 then 'message' when 2 then 'tool_result'
                    when 3 then 'tool_call' when 4 then 'tool_definition' else 'instructions' end as kind,
               case when l_suppkey % 6 in (2, 3, 4) then 'tool' when l_linestatus = 'F' then 'user'
                    when l_suppkey % 4 = 0 then null else 'assistant' end as role,
               case l_returnflag when 'A' then 'human_authored' when 'R' then 'tool_generated'
                    else 'agent_generated' end as origin,
               case l_partkey % 7 when 0 then 'json' when 1 then 'plain_text' when 2 then 'source_code'
                    when 3 then 'log' when 4 then 'unknown' when 5 then 'plain_text' end as detected_kind,
               cast(floor(l_extendedprice) as bigint) as raw_bytes,
               (ordinal - 1) * 1500 as raw_value_start,
               case when l_partkey % 100 < 97 then sha256(cast(l_partkey % 100 as varchar)) end as exact_fp,
               case when l_partkey % 100 < 90 and l_suppkey % 6 < 3
                    then sha256(concat('s', cast(l_partkey % 25 as varchar))) end as semantic_fp,
               case when l_tax > 0 then cast(floor(l_quantity) as bigint) end as estimated_tokens,
               case when l_suppkey % 6 in (2, 3) and l_partkey % 40 < 39
                    then concat('call-', cast(l_partkey % 40 as varchar)) end as tool_call_id,
               case when l_suppkey % 6 in (3, 4) then case l_partkey % 7 when 0 then 'git_status'
                    when 1 then 'rg-search' when 2 then 'cargo_test' when 3 then 'read_file' when 4 then 'shell'
                    when 5 then 'npm_install' else 'weather' end end as tool_name,
               case when l_suppkey % 6 in (3, 4) then l_partkey % 7 = 6 end as tool_name_truncated,
               case when l_suppkey % 6 in (3, 4) and l_partkey % 7 = 6 then sha256('weather') end as tool_name_hash,
               cast(floor(l_quantity) as bigint) as line_count
        from t_lines, (values (1), (2)) as versions(v)
        where l_orderkey % 23 <> 0 and (v = 1 or l_orderkey % 10 = 0)""",
    "t_metrics": """
        select o_orderkey * 10 + case when o_orderkey % 10 = 0 then 2 else 1 end as snapshot_id,
               case when o_orderkey % 41 <> 0 then 10000 - (o_orderkey * 37) % 3000 end as semantic_coverage_bp,
               o_orderkey % 8 as tool_count, 400 * (o_orderkey % 8) as schema_bytes,
               100 * (o_orderkey % 8) as estimated_schema_tokens,
               case when o_orderkey % 43 <> 0 then 60 * (o_orderkey % 8) end as repeated_schema_tokens,
               case when o_orderkey % 3 <> 0 then o_orderkey % 500 end as stable_prefix_estimate,
               case when o_orderkey % 6 <> 0 then cast(floor(o_totalprice / 10) as bigint) end as visible_estimated_tokens,
               case when o_orderkey % 9 <> 0 then cast(floor(o_totalprice / 9) as bigint) end as provider_input_tokens
        from orders where o_orderkey % 23 <> 0 and o_orderkey % 47 <> 0""",
    "t_deltas": """
        select o_orderkey * 10 + case when o_orderkey % 10 = 0 then 2 else 1 end as current_snapshot_id,
               o_orderkey % 5 as repeated_blocks, o_orderkey % 4 as new_blocks, o_orderkey % 3 as changed_blocks,
               o_orderkey % 2 as removed_blocks,
               case when o_orderkey % 12 <> 0 then o_orderkey % 60 end as repeated_tokens,
               o_orderkey % 80 as new_tokens, o_orderkey % 4 as common_prefix_blocks,
               case when o_orderkey % 15 <> 0 then o_orderkey % 70 end as common_prefix_tokens
        from orders where o_orderkey % 23 <> 0 and o_orderkey % 53 <> 0""",
    "t_events": """
        select event_id as seq, user_id as session_id, event_id as operation_id,
               case event_type when 'error' then 'context.analysis.dropped' when 'purchase' then
                    'context.analysis.partial' when 'click' then 'context.analysis.completed' when 'signup' then
                    'session.started' else 'provider.request.observed' end as event_type,
               ts as "timestamp",
               case event_id % 6
                 when 0 then concat('{"reason":"observer_backpressure","dropped_count":', cast(user_id % 4 as varchar),
                      ',"provider_request_id":', cast(event_id as varchar), '}')
                 when 1 then concat('{"reason":"resource_limit","request_ids":[', cast(event_id as varchar), ',',
                      cast(event_id * 2 as varchar), ',', cast(event_id as varchar), '],"terminal":true}')
                 when 2 then concat('{"dropped_count":"two","request":{"request_id":', cast(event_id + 3 as varchar), '}}')
                 when 3 then '[1,2]'
                 when 4 then concat('{"reason":"cancelled","dropped_count":-3,"outcome":"drop","request_id":',
                      cast(event_id + 900000000 as varchar), '}')
                 else props end as payload
        from events""",
    "t_experiments": """
        select concat('exp-', cast(s_suppkey % 4 as varchar)) as experiment_id,
               case when min(s_suppkey) % 2 = 0 then 'completed' else 'running' end as status,
               make_timestamp(1704067200000000 + min(s_suppkey) * 1000000) as started_at,
               cast(0 as bigint) as forwarding_mutations, cast(count(*) as bigint) as shadow_drops,
               cast(max(s_suppkey) % 3 as bigint) as recovery_failures, cast(0 as bigint) as determinism_failures
        from supplier group by 1""",
    "t_candidates": """
        select concat_ws('-', cast(l_orderkey as varchar), cast(ordinal as varchar)) as candidate_id,
               concat('exp-', cast(l_suppkey % 3 as varchar)) as experiment_id, l_orderkey * 10 + 1 as snapshot_id,
               concat_ws('-', cast(l_orderkey * 10 + 1 as varchar), cast(ordinal - 1 as varchar)) as block_id,
               case l_partkey % 6 when 0 then 'json.minify' when 1 then 'text.readable_line_fold'
                    when 2 then 'search.result_projection' when 3 then 'shell.diagnostic_projection'
                    when 4 then 'tests.failure_projection' else 'json.tabular' end as compressor_id,
               1 as compressor_version,
               case l_partkey % 4 when 0 then 'applicable' when 1 then 'applicable' when 2 then 'no_improvement'
                    else 'not_applicable' end as status,
               sha256(cast(l_partkey % 100 as varchar)) as original_fp,
               case when l_linenumber > 5 then 'unknown' when l_linenumber > 3 then 'high'
                    when l_linenumber > 1 then 'medium' else 'low' end as cache_risk,
               case when l_partkey % 6 in (1, 2) then 'readable' when l_partkey % 6 = 5 then 'opaque' end
                    as provider_readability,
               case when l_partkey % 3 = 0 then 'duplicate' when l_partkey % 3 = 1 then 'logs' end as text_shape,
               case when l_partkey % 2 = 0 then 'array' else 'object' end as json_root_kind,
               cast(floor(l_extendedprice) as bigint) as input_bytes,
               case when l_partkey % 4 <> 3 then cast(floor(l_extendedprice) as bigint)
                    - cast(floor(l_extendedprice * (l_discount + l_tax) * 4) as bigint) end as output_bytes,
               case when l_partkey % 4 <> 3 then cast(floor(l_extendedprice * (l_discount + l_tax) * 4) as bigint) end
                    as bytes_delta,
               case when l_tax > 0 then cast(floor(l_quantity) as bigint) end as input_tokens,
               case when l_partkey % 4 <> 3 and l_tax > 0 then cast(floor(l_quantity * 0.75) as bigint) end as output_tokens,
               case when l_partkey % 4 <> 3 and l_tax > 0 then cast(floor(l_quantity) as bigint)
                    - cast(floor(l_quantity * 0.75) as bigint) end as token_delta,
               cast(floor(l_extendedprice / 8) as bigint) as processing_us,
               l_suppkey % 12 <> 0 as reversible, l_suppkey % 30 <> 1 as recovery_verified,
               l_suppkey % 40 <> 2 as deterministic
        from t_lines where l_orderkey % 23 <> 0""",
    "t_eligible": """
        select *, coalesce(request_kind = 'turn', false) or (lower(method) = 'post' and
               trim(lower(route), '/') in ('responses', 'v1/responses', 'backend-api/codex/responses')) as eligible
        from t_requests""",
    "t_sidecars": """
        select case when c_custkey % 33 = 0 then c_custkey + 10000000000 else c_custkey end as session_id,
               case when c_custkey % 16 <> 0 then concat('run-', cast(c_custkey as varchar)) end as measurement_run_id,
               c_custkey % 1000 as agent_pid,
               case when c_custkey % 10 = 0 then seen + 1 else seen end as analysis_admitted_total,
               case when c_custkey % 11 <> 0 then seen end as analysis_requests_seen,
               case when seen > 1 then seen - 1 else seen end as processed_deferred_total,
               cast(case when seen > 1 then 1 else 0 end as bigint) as backlog_capacity_drops,
               case when c_custkey % 4 <> 0 then seen * 2 end as deferred_total,
               case when c_custkey % 14 <> 0 then c_custkey % 9 end as high_water_items,
               c_custkey * 100 as high_water_bytes, c_custkey % 77 as analysis_wait_us,
               case when c_custkey % 2 = 0 then c_custkey % 50 end as drain_duration_us,
               c_custkey % 18 <> 0 as capture_complete,
               case when c_custkey % 22 = 0 then 'Shutdown before capture' end as scheduler_capture_note,
               lower(c_mktsegment) as workload,
               case when c_custkey % 2 = 0 then 'parallel' else 'serial' end as concurrency_mode,
               copy
        from (select c_custkey, c_mktsegment, coalesce(seen, 0) as seen from customer
              left join (select session_id, cast(count(*) as bigint) as seen from t_eligible
                         join t_operations using (operation_id) where eligible group by 1) s
                on s.session_id = c_custkey
              where c_custkey % 13 <> 0),
             (values (0), (1)) as copies(copy)
        where copy = 0 or c_custkey % 21 = 0""",
    "t_outputs": "OUTPUTS",
    "t_runs": """
        select o_orderkey as run_id, substr(o_orderpriority, 1, 1) as experiment,
               case when o_orderkey % 2 = 0 then 'control' else 'treatment' end as arm,
               case when o_orderkey % 4999 = 0 then 1 else 0 end as provider_errors,
               case when o_orderkey % 2 = 0 then 5000 else 1000 + o_orderkey % 50 end as source_emitted_bytes,
               o_orderkey % 900 as reducer_duration_us,
               cast(floor(o_totalprice / case when o_orderkey % 2 = 0 then 1 else 2 end) as bigint) as input_uncached,
               cast(floor(o_totalprice) as bigint) as duration_us, cast(floor(o_totalprice / 7) as bigint) as dispatch_us,
               o_orderkey % 3 as command_retries, o_orderkey % 2 as tool_calls,
               cast(floor(o_totalprice) as bigint) - (o_orderkey % 2) * 700 as forwarded_bytes,
               case when o_orderkey % 997 = 0 then 1 else 0 end as determinism_failures,
               row_number() over (partition by substr(o_orderpriority, 1, 1), o_orderkey % 2 order by o_orderkey) as pair_index
        from orders""",
    "t_arm_blocks": """
        select ['config_a', 'config_b', 'no_plugins', 'no_memories', 'no_hooks', 'no_extensions', 'ignored'][c_custkey % 7 + 1] as arm,
               (c_custkey // 7) % 6 as run, c_custkey as request_id, 'b' || j as fp, cast(j + 10 as bigint) as tokens
        from customer, range(0, 10) as r(j)
        where (j < 7 and not (c_custkey % 7 = 2 and j in (1, 2)) and not (c_custkey % 7 = 3 and j = 3)
               and not (c_custkey % 7 = 5 and j in (1, 2, 3, 4)) and not (c_custkey % 7 = 6 and j > 1))
            or (j = 7 and c_custkey % 2 = 0) or (j = 8 and c_custkey % 7 = 5) or (j = 9 and c_custkey % 7 = 6)""",
    "t_arm_requests": """
        select ['control', 'null', 'treatment'][o_orderkey % 3 + 1] as arm, cast((o_orderkey // 3) % 6 as int) as round,
               o_orderkey as request_id, epoch_us(o_orderdate) as created_us,
               1000 + (o_orderkey // 3) % 100 - case when o_orderkey % 3 = 2 then 300 else 0 end as input_tokens,
               500 + (o_orderkey // 3) % 10 as cached_input_tokens,
               500 + (o_orderkey // 3) % 100 - case when o_orderkey % 3 = 2 then 300 else 0 end as uncached_input_tokens,
               20 + o_orderkey % 4 as output_tokens, o_orderpriority as model, 1 as tool_count, o_orderkey % 3 as effort
        from orders""",
    "v_stable": """
        select arm, fp, min(n) * min(lo) as weight from (select arm, request_id, fp, count(*) as n, min(tokens) as lo, max(tokens) as hi
          from t_arm_blocks group by 1, 2, 3) p group by arm, fp
        having count(*) = (select count(distinct request_id) from t_arm_blocks b where b.arm = p.arm)
          and min(n) = max(n) and min(lo) = max(hi)""",
    # Views built on the bindings, as the operators define them.
    "v_latest": """
        select * from t_snapshots s where analysis_version =
          (select max(analysis_version) from t_snapshots x where x.provider_request_id = s.provider_request_id)""",
    "v_final": """
        select r.request_id, r.operation_id, o.session_id, a.attempt_id, a.status as attempt_status, a.duration_us
        from t_requests r join t_operations o on o.operation_id = r.operation_id
        left join (select * from t_attempts qualify row_number() over
                   (partition by request_id order by ordinal desc) = 1) a on a.request_id = r.request_id""",
    "v_counted": """
        select *, case when exact_fp is not null then count(*) over (partition by exact_fp) end as exact_count,
               case when semantic_fp is not null then count(*) over (partition by semantic_fp) end as semantic_count,
               count(*) over (partition by coalesce(semantic_fp, exact_fp)) as persistence
        from t_blocks""",
    "v_ordered": """
        select *, row_number() over (partition by session_id order by started_at_us asc nulls last, snapshot_id) - 1
               as snapshot_order
        from t_snapshots""",
    "v_placed": """
        select b.*, s.session_id, s.provider_request_id, s.snapshot_order
        from t_blocks b join v_ordered s on s.snapshot_id = b.snapshot_id""",
}


def _outputs() -> str:
    from ..sources.bindings import OUTPUT_LINES

    def joined(name: str, separator: str) -> str:
        line = OUTPUT_LINES[name].replace("{quarter}", "i // 4").replace("{fifth}", "i // 5")
        return f"array_to_string(list_transform(range(0, 2 + o_orderkey % 30), lambda i: {line}), {separator})"

    return f"""select o_orderkey as block_id, {joined('test_stdout', 'chr(10)')} || chr(10) as test_stdout,
      {joined('check_stderr', 'chr(10)')} || chr(10) as check_stderr, {joined('rg_stdout', 'chr(10)')} as rg_stdout,
      case when o_orderkey % 5 = 0 then 'Unknown head' else 'On branch main' end || chr(10) || 'Changes not staged for commit:'
        || chr(10) || '  (use "git add <file>..." to update)' || chr(10) || {joined('status_lines', 'chr(10)')} || chr(10) as status_stdout,
      {joined('log_text', 'chr(10)')} || chr(10) as log_text,
      '[' || {joined('json_rows', "', '")} || case when o_orderkey % 7 = 0 then '' else ']' end as json_text
      from orders"""


CTES["t_outputs"] = _outputs()


def _needed(text: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\b[tv]_[a-z_]+\b", text):
        if name in CTES and name not in found:
            _needed(CTES[name], found)
            found[name] = None


def with_bindings(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the bindings a query uses in front of it."""
    own = extra or {}
    found: dict[str, None] = {}
    _needed(" ".join([body, *own.values()]), found)
    parts = [f"{name} as ({CTES[name]})" for name in found]
    parts += [f"{name} as ({text})" for name, text in own.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
