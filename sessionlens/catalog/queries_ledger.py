"""Ledger, missingness, scheduler and compression reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import compression, ledger, missing
from ..sources.bindings import star_trace
from .queries_core import _DIST, PERCENTILES, rounded
from .registry import query

_IDS = {
    "drops": """select seq, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload else '{}' end as o,
          session_id from t_events where event_type like 'context.analysis.%.dropped' or event_type = 'context.analysis.dropped'""",
}
_DROPS = """select seq, coalesce(nullif(o ->> '$.reason', ''), 'unknown') as reason,
    case when regexp_matches(coalesce(o ->> '$.dropped_count', ''), '^\\s*[+-]?[0-9]+\\s*$')
      then greatest(cast(trim(o ->> '$.dropped_count') as bigint), 0) else 1 end as dropped_work,
    coalesce(lower(trim(o ->> '$.terminal')) in ('1', 'true', 'yes', 'terminal'), false)
      or coalesce(o ->> '$.outcome' in ('drop', 'dropped'), false) as terminal,
    list_distinct(list_filter(list_concat(
       case when json_type(o, '$.request_ids') = 'ARRAY' then json_extract_string(o, '$.request_ids[*]') else [] end,
       [o ->> '$.provider_request_id', o ->> '$.request_id', o ->> '$.request.request_id', o ->> '$.request.provider_request_id']),
       lambda x: x is not null and x <> '')) as ids
  from (select seq, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload else '{}' end as o
        from t_events where starts_with(event_type, 'context.analysis.') and ends_with(event_type, '.dropped'))"""
_EXPANDED = """select seq, reason, dropped_work, terminal, len(ids) as named, unnest(ids) as named_id from drops
  union all select seq, reason, dropped_work, terminal, 0, null from drops where len(ids) = 0"""
_MATCHES = """select x.seq, any_value(x.dropped_work) as dropped_work, any_value(x.named) as named, count(e.request_id) as matched
  from expanded x left join (select request_id from t_eligible where eligible) e
    on cast(e.request_id as varchar) = x.named_id group by x.seq"""
_CHOSEN = """select *, completed_at_us is not null or recovered_at_us is not null as term from t_snapshots
  qualify row_number() over (partition by provider_request_id order by
    (completed_at_us is not null or recovered_at_us is not null) desc, (completed_at_us is null) desc,
    coalesce(completed_at_us, 0) desc, snapshot_id desc) = 1"""
_LEDGER = """select e.request_id, o.session_id, e.request_kind, e.request_bytes, e.observation_status, e.eligible,
    case when e.eligible then c.snapshot_id end as snapshot_id, case when e.eligible then c.status end as snapshot_status,
    case when e.eligible then c.completed_at_us end as completed_at_us,
    case when e.eligible then coalesce(t.n, 0) else 0 end as terminal_snapshots,
    case when not e.eligible then 'Ineligible' when c.snapshot_id is null or not c.term then 'Dropped'
         when c.status = 'complete' then 'Complete' else 'Partial' end as outcome,
    case when e.eligible and c.snapshot_id is null then 'missing_snapshot'
         when e.eligible and not c.term then 'non_terminal_snapshot' end as outcome_note,
    coalesce(d.n, 0) as drop_events, cast(coalesce(d.w, 0) as bigint) as drop_work, coalesce(d.r, '') as drop_reasons,
    cast(coalesce(d.t, 0) as bigint) as terminal_drops
  from t_eligible e left join t_operations o using (operation_id)
  left join chosen c on c.provider_request_id = e.request_id
  left join (select provider_request_id, count(*) as n from t_snapshots
             where completed_at_us is not null or recovered_at_us is not null group by 1) t
    on t.provider_request_id = e.request_id
  left join (select e2.request_id, count(*) as n, sum(dropped_work) as w, string_agg(distinct reason, ',' order by reason) as r,
               count(*) filter (terminal) as t from expanded x join t_eligible e2
               on cast(e2.request_id as varchar) = x.named_id where e2.eligible group by 1) d on d.request_id = e.request_id"""
CHAIN = dict(drops=_DROPS, expanded=_EXPANDED, chosen=_CHOSEN, ledger=_LEDGER)


@query(
    "S10_payload_objects",
    """select event_type, count(*) as events, count(o ->> '$.reason') as with_reason,
         count(*) filter (o = '{}') as empty_objects from (select event_type,
         case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload else '{}' end as o from t_events)
       group by 1""",
)
def payload_objects(spark, root):
    decoded = ledger.payload_objects(star_trace(spark, root).events)
    return decoded.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count(F.try_variant_get("object", "$.reason", "string")).alias("with_reason"),
        F.count(F.when(F.to_json("object") == "{}", 1)).alias("empty_objects"),
    )


@query("D23_event_counts", "select event_type, count(*) as events from t_events group by 1")
def event_counts(spark, root):
    return ledger.event_type_counts(star_trace(spark, root).events)


@query(
    "D23_drop_reasons",
    """select coalesce(nullif(o ->> '$.reason', ''), 'unknown') as reason, count(nullif(o ->> '$.reason', '')) as events,
         cast(coalesce(sum(case when event_type = 'context.analysis.dropped' then
           case when regexp_matches(coalesce(o ->> '$.dropped_count', ''), '^\\s*[+-]?[0-9]+\\s*$')
             then greatest(cast(trim(o ->> '$.dropped_count') as bigint), 0) else 1 end end), 0) as bigint) as dropped_work
       from (select event_type, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload else '{}' end as o
             from t_events where event_type like '%drop%' or event_type like '%partial%') group by 1""",
)
def drop_reasons(spark, root):
    return ledger.drop_reason_counts(star_trace(spark, root).events)


@query(
    "P08_eligible_requests",
    "select coalesce(request_kind, 'none') as kind, method, eligible, count(*) as requests from t_eligible group by 1, 2, 3",
)
def eligible_requests(spark, root):
    rows = star_trace(spark, root).requests
    return rows.groupBy(
        F.coalesce("request_kind", F.lit("none")).alias("kind"), "method", labels.analysis_eligible().alias("eligible")
    ).agg(F.count(F.lit(1)).alias("requests"))


@query(
    "P09_provider_errors",
    """select coalesce(status, 'unknown') as status, count(*) as errors from t_attempts
       where coalesce(status, 'unknown') <> 'completed' or error_code is not null or transport_error is not null group by 1""",
)
def provider_errors(spark, root):
    rows = star_trace(spark, root).attempts.where(labels.provider_error())
    return rows.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("errors"))


@query(
    "P13_migrated_kind",
    """select coalesce(case when request_kind = 'compaction' then 'compaction_legacy' else request_kind end, 'none') as kind,
         count(*) as requests from t_requests group by 1""",
)
def migrated_kind(spark, root):
    kind = F.coalesce(labels.migrated_kind("request_kind"), F.lit("none")).alias("kind")
    return star_trace(spark, root).requests.groupBy(kind).agg(F.count(F.lit(1)).alias("requests"))


@query("D24_request_ledger", "select * from ledger", **CHAIN)
def request_ledger(spark, root):
    rows = ledger.request_ledger(star_trace(spark, root))
    return rows.drop("correlation_status").withColumn("drop_reasons", F.array_join("drop_reasons", ","))


_CONFLICTS = """
  select 'snapshot_without_provider_request' as kind, s.provider_request_id::varchar as request_id, 1 as times
    from t_snapshots s where provider_request_id not in (select request_id from t_requests)
  union all select 'snapshot_for_ineligible_request', s.provider_request_id::varchar, 1 from t_snapshots s
    join t_eligible e on e.request_id = s.provider_request_id where not e.eligible
  union all select 'multiple_terminal_snapshots', request_id::varchar, 1 from ledger where eligible and terminal_snapshots > 1
  union all select 'complete_snapshot_without_completion_timestamp', request_id::varchar, 1 from ledger
    where eligible and snapshot_status = 'complete' and completed_at_us is null
  union all select 'non_terminal_snapshot', request_id::varchar, 1 from ledger where outcome_note = 'non_terminal_snapshot'
  union all select 'terminal_drop_conflicts_with_snapshot', request_id::varchar, terminal_drops from ledger
    where eligible and terminal_drops > 0 and outcome <> 'Dropped'
  union all select 'drop_without_identifiable_eligible_request', null, 1 from matches where matched = 0
  union all select 'drop_references_unknown_or_ineligible_request', null, 1 from matches where matched > 0 and matched <> named"""


@query(
    "D24_ledger_conflicts",
    "select kind, cast(sum(times) as bigint) as conflicts, count(distinct request_id) as requests from conflicts group by 1",
    **CHAIN, matches=_MATCHES, conflicts=_CONFLICTS,
)
def ledger_conflicts(spark, root):
    return ledger.ledger_conflicts(star_trace(spark, root))


@query(
    "D25_ledger_summary",
    """select l.*, m.*, l.requests - l.eligible_requests as ineligible_requests,
         round(complete_requests::double / eligible_requests, 9) as request_coverage, c.conflicts,
         eligible_requests = complete_requests + partial_requests + dropped_requests as outcome_partition_valid,
         case when c.conflicts > 0 or unmatched_events > 0 then 'failed' else 'passed' end as measurement_integrity,
         concat_ws(',', case when c.conflicts > 0 then 'analysis_outcome_conflicts' end,
           case when unmatched_events > 0 then 'unmatched_drop_events' end) as integrity_reasons
       from (select count(*) as requests, count(*) filter (eligible) as eligible_requests,
               count(*) filter (outcome = 'Complete') as complete_requests, count(*) filter (outcome = 'Partial') as partial_requests,
               count(*) filter (outcome = 'Dropped') as dropped_requests from ledger) l,
            (select count(*) as auxiliary_drop_events, cast(sum(dropped_work) as bigint) as auxiliary_drop_work,
               count(*) filter (matched = 0 or matched <> named) as unmatched_events,
               cast(coalesce(sum(dropped_work) filter (matched = 0 or matched <> named), 0) as bigint) as unmatched_drop_work
             from matches) m,
            (select cast(coalesce(sum(times), 0) as bigint) as conflicts from conflicts) c""",
    **CHAIN, matches=_MATCHES, conflicts=_CONFLICTS,
)
def ledger_summary(spark, root):
    out = ledger.ledger_summary(star_trace(spark, root))
    return rounded(out.withColumn("integrity_reasons", F.array_join("integrity_reasons", ",")), "request_coverage")


@query(
    "J08_drop_event_matches",
    "select seq, cast(dropped_work as bigint) as dropped_work, cast(named as bigint) as named, matched from matches",
    drops=_DROPS, expanded=_EXPANDED, matches=_MATCHES,
)
def drop_event_matches(spark, root):
    return ledger.drop_match_counts(star_trace(spark, root)).withColumn("named", F.col("named").cast("bigint"))


@query(
    "J07_orphans",
    """select 'snapshot_without_request' as problem, snapshot_id as id from t_snapshots
         where provider_request_id not in (select request_id from t_requests)
       union all select 'request_without_attempt', request_id from t_requests
         where request_id not in (select request_id from t_attempts)""",
)
def orphans(spark, root):
    return ledger.orphans(star_trace(spark, root))


_LIFECYCLE = """select count(*) as snapshots,
    count(*) filter (completed_at_us is not null or recovered_at_us is not null) as terminal_snapshots,
    count(*) filter (status = 'complete') as complete_snapshots, count(*) filter (status = 'partial') as partial_snapshots,
    count(*) filter (status = 'dropped') as dropped_snapshots, count(distinct provider_request_id) as distinct_requests,
    count(*) filter (provider_request_id not in (select request_id from t_requests)) as orphan_snapshots,
    (select count(*) from t_requests) as requests, (select count(*) from drops) as drop_events,
    (select count(*) from drops where reason = 'observer_backpressure') as backpressure_events,
    (select cast(sum(dropped_work) as bigint) from drops) as dropped_work from t_snapshots"""


@query("D44_lifecycle_counts", _LIFECYCLE, drops=_DROPS)
def lifecycle_counts(spark, root):
    return ledger.lifecycle_counts(star_trace(spark, root))


@query(
    "D50_lifecycle_violations",
    """select unnest(list_filter([
         case when snapshots <> complete_snapshots + partial_snapshots + dropped_snapshots then 'snapshots_not_partitioned' end,
         case when distinct_requests > requests then 'more_snapshot_ids_than_requests' end,
         case when orphan_snapshots > 0 then 'orphan_snapshots' end,
         case when dropped_snapshots > 0 and drop_events = 0 then 'drops_without_events' end], lambda x: x is not null)) as violation
       from lc""",
    drops=_DROPS, lc=_LIFECYCLE,
)
def lifecycle_violations(spark, root):
    return ledger.lifecycle_violations(star_trace(spark, root))


_QUART = """case when {0} is null or {1}1 is null then 'unknown' when {0} <= {1}1 then 'q1' when {0} <= {1}2 then 'q2'
  when {0} <= {1}3 then 'q3' else 'q4' end"""
_STRATA = f"""select x.request_id, x.outcome, x.request_kind, {_QUART.format('x.request_bytes', 'b.r')} as request_size_quartile,
    {_QUART.format('x.visible', 'b.c')} as context_size_quartile,
    row_number() over (partition by x.session_id order by x.request_id) as turn_index,
    count(*) over (partition by x.session_id) as session_request_count, x.observation_status, w.workload, w.concurrency_mode
  from elig x left join t_workloads w on w.session_id = x.session_id,
    (select quantile_cont(request_bytes, 0.25) as r1, quantile_cont(request_bytes, 0.5) as r2, quantile_cont(request_bytes, 0.75) as r3,
      quantile_cont(visible, 0.25) as c1, quantile_cont(visible, 0.5) as c2, quantile_cont(visible, 0.75) as c3 from elig) b"""
_ELIG = """select l.*, v.visible from ledger l left join (select snapshot_id, sum(estimated_tokens) as visible from t_blocks
  group by 1) v on v.snapshot_id = l.snapshot_id where l.eligible"""


@query(
    "D26_missingness",
    " union all ".join(
        f"""select '{d}' as dimension, coalesce(nullif(cast({d} as varchar), ''), 'unknown') as name, count(*) as eligible_requests,
           count(*) filter (outcome = 'Complete') as complete_requests, count(*) filter (outcome = 'Partial') as partial_requests,
           count(*) filter (outcome = 'Dropped') as dropped_requests,
           round(count(*) filter (outcome = 'Complete')::double / count(*), 9) as request_coverage,
           round(count(*) filter (outcome = 'Dropped')::double / count(*), 9) as drop_rate from strata group by 2"""
        for d in missing.DIMENSIONS
    ),
    **CHAIN, elig=_ELIG, strata=_STRATA,
)
def missingness(spark, root):
    return rounded(missing.missingness(star_trace(spark, root), stored=True), "request_coverage", "drop_rate")


@query("W06_turn_index", "select request_id, turn_index, session_request_count from strata", **CHAIN, elig=_ELIG, strata=_STRATA)
def turn_index(spark, root):
    return missing.turn_index(star_trace(spark, root), stored=True)


@query(
    "F14_quartile_labels",
    "select request_size_quartile, context_size_quartile, count(*) as requests from strata group by 1, 2",
    **CHAIN, elig=_ELIG, strata=_STRATA,
)
def quartile_labels(spark, root):
    return missing.strata(star_trace(spark, root), stored=True).groupBy("request_size_quartile", "context_size_quartile").agg(
        F.count(F.lit(1)).alias("requests")
    )


_SELECTED = "select * from t_sidecars where session_id in (select session_id from t_sessions)"


@query(
    "D27_scheduler_totals",
    """select count(*) as sessions_with_metrics,
         cast(sum(analysis_admitted_total) as bigint) as analysis_admitted_total, cast(sum(deferred_total) as bigint) as deferred_total,
         cast(sum(processed_deferred_total) as bigint) as processed_deferred_total,
         cast(sum(backlog_capacity_drops) as bigint) as backlog_capacity_drops, count(high_water_items) as high_water_items_observed,
         count(analysis_wait_us) as analysis_wait_us_observed, count(deferred_total) as deferred_total_observed,
         count(drain_duration_us) as drain_duration_us_observed,
         cast(sum(analysis_requests_seen) as bigint) as analysis_requests_seen, any_value(o.e) as eligible_requests,
         round(sum(deferred_total)::double / any_value(o.e), 9) as deferral_rate, round(any_value(o.d)::double / any_value(o.e), 9) as loss_rate,
         cast(sum(analysis_requests_seen) as bigint) - any_value(o.e) as seen_delta,
         count(analysis_requests_seen) = count(*) and sum(analysis_requests_seen) = any_value(o.e) as counters_consistent
       from sel, (select count(*) filter (eligible) as e, count(*) filter (outcome = 'Dropped') as d from ledger) o""",
    **CHAIN, sel=_SELECTED,
)
def scheduler_totals(spark, root):
    return rounded(missing.scheduler_totals(star_trace(spark, root)), "deferral_rate", "loss_rate")


@query(
    "D27_scheduler_distributions",
    f"select metric, {_DIST.format('value')} from (unpivot (select high_water_items, high_water_bytes, analysis_wait_us,"
    " drain_duration_us from sel) on columns(*) into name metric value value) group by 1",
    sel=_SELECTED,
)
def scheduler_distributions(spark, root):
    return rounded(missing.scheduler_distributions(star_trace(spark, root)), *PERCENTILES, digits=6)


_AUDIT = """select s.session_id, coalesce(e.n, 0) as eligible_requests, coalesce(e.c, 0) as complete_snapshots,
    r.session_id is not null as sidecar_present,
    case when r.session_id is null then 'sidecar_missing' when r.ident <> '' then 'legacy_uncertified'
      when r.records > 1 then 'sidecar_duplicate' when r.issue then 'harness_collection_failure'
      when r.missing_counters <> '' or r.analysis_admitted_total <> coalesce(e.n, 0)
        or coalesce(r.analysis_requests_seen <> coalesce(e.n, 0), false)
        or r.processed_deferred_total + r.backlog_capacity_drops <> r.analysis_admitted_total then 'counter_mismatch'
      else 'passed' end as status,
    case when r.session_id is null then 'sidecar_missing' when r.ident <> '' then 'legacy_uncertified'
      when lower(r.note) like '%shutdown%' then 'shutdown_before_capture' when r.issue then 'harness_collection_failure'
      else 'complete' end as capture_classification,
    r.missing_counters as missing_counter_fields, r.missing_capture as missing_capture_fields, r.ident as missing_identity_fields,
    r.analysis_admitted_total - coalesce(e.n, 0) as admitted_delta, r.analysis_requests_seen - coalesce(e.n, 0) as seen_delta,
    r.processed_deferred_total + r.backlog_capacity_drops - r.analysis_admitted_total as processed_delta
  from t_sessions s left join (select session_id, count(*) as n, count(*) filter (snapshot_status = 'complete') as c
    from ledger where eligible group by 1) e on e.session_id = s.session_id
  left join (select *, note <> '' or missing_capture <> '' or not capture_complete or ident <> '' as issue from (
      select *, count(*) over (partition by session_id) as records, coalesce(scheduler_capture_note, '') as note,
        concat_ws(',', case when analysis_requests_seen is null then 'analysis_requests_seen' end) as missing_counters,
        concat_ws(',', case when high_water_items is null then 'high_water_items' end) as missing_capture,
        concat_ws(',', case when measurement_run_id is null then 'measurement_run_id' end,
          case when agent_pid <= 0 then 'agent_pid' end, case when not capture_complete then 'capture_complete' end) as ident
      from t_sidecars) where copy = 0) r on r.session_id = s.session_id"""


@query("D28_sidecar_audit", "select * from audit", **CHAIN, audit=_AUDIT)
def sidecar_audit(spark, root):
    out = missing.sidecar_audit(star_trace(spark, root))
    for c in ("missing_counter_fields", "missing_capture_fields", "missing_identity_fields"):
        out = out.withColumn(c, F.array_join(c, ","))
    return out


@query(
    "D28_sidecar_audit_summary",
    "select status, count(*) as sessions, cast(sum(eligible_requests) as bigint) as eligible_requests from audit group by 1",
    **CHAIN, audit=_AUDIT,
)
def sidecar_audit_summary(spark, root):
    return missing.sidecar_audit_summary(star_trace(spark, root))


# --- compression reports -------------------------------------------------------------------------------


@query(
    "D13_experiment_summary",
    """select e.experiment_id, e.status, e.shadow_drops, e.recovery_failures, count(c.candidate_id) as candidate_count,
         count(distinct c.block_id) as block_count, count(distinct s.session_id) as session_count
       from t_experiments e left join t_candidates c using (experiment_id)
       left join t_snapshots cs on cs.snapshot_id = c.snapshot_id left join t_sessions s on s.session_id = cs.session_id
       group by all""",
)
def experiment_summary(spark, root):
    return compression.experiment_summary(star_trace(spark, root)).select(
        "experiment_id", "status", "shadow_drops", "recovery_failures", "candidate_count", "block_count", "session_count"
    )


_TOTALS = """select experiment_id, compressor_id, compressor_version,
    case when compressor_id like 'search.%' then 'search' when compressor_id like 'tests.%' then 'tests'
      when compressor_id like 'shell.%' then 'shell_generic' else 'generic_control' end as tool_family,
    count(*) as eligible_blocks, count(*) filter (status = 'applicable') as applicable_blocks,
    least(10000, count(*) filter (status = 'applicable') * 10000 // count(*)) as applicability_bp,
    cast(least(10000, coalesce(sum(input_tokens) filter (status = 'applicable'), 0) * 10000 // nullif(coalesce(sum(input_tokens), 0), 0)) as bigint)
      as addressable_token_share_bp, coalesce(max(provider_readability), 'unknown') as provider_readability,
    cast(sum(input_bytes) filter (status = 'applicable') as bigint) as input_bytes,
    cast(sum(output_bytes) filter (status = 'applicable') as bigint) as output_bytes,
    cast(sum(bytes_delta) filter (status = 'applicable') as bigint) as byte_reduction,
    cast(least(10000, sum(bytes_delta) filter (status = 'applicable') * 10000 // sum(input_bytes) filter (status = 'applicable')) as bigint)
      as byte_reduction_bp,
    cast(sum(input_tokens) filter (status = 'applicable') as bigint) as input_tokens,
    cast(sum(output_tokens) filter (status = 'applicable') as bigint) as output_tokens,
    cast(sum(token_delta) filter (status = 'applicable') as bigint) as token_reduction,
    cast(least(10000, sum(token_delta) filter (status = 'applicable') * 10000 // sum(input_tokens) filter (status = 'applicable')) as bigint)
      as token_reduction_bp,
    least(10000, count(*) filter (reversible and output_bytes is not null and recovery_verified) * 10000
      // nullif(count(*) filter (reversible and output_bytes is not null), 0)) as recovery_bp,
    least(10000, count(*) filter (output_bytes is not null and deterministic) * 10000
      // nullif(count(*) filter (output_bytes is not null), 0)) as deterministic_bp,
    count(*) filter (cache_risk = 'low') as cache_risk_low, count(*) filter (cache_risk = 'medium') as cache_risk_medium,
    count(*) filter (cache_risk = 'high') as cache_risk_high, count(*) filter (cache_risk = 'unknown') as cache_risk_unknown
  from t_candidates group by 1, 2, 3"""
_LAT = """select experiment_id, compressor_id, list_sort(list(processing_us)) as l, count(*) as n from t_candidates group by 1, 2"""
_UNIQ = """select experiment_id, compressor_id, cast(sum(b) as bigint) as unique_byte_reduction, cast(sum(t) as bigint) as unique_token_reduction
  from (select experiment_id, compressor_id, original_fp, max(bytes_delta) as b, max(token_delta) as t from t_candidates
        where status = 'applicable' group by 1, 2, 3) group by 1, 2"""


def _median_sql(delta, base):
    return f"""select c.experiment_id, c.compressor_id, cast(min(least(10000, {delta} * 10000 // nullif({base}, 0))) as bigint) as m
      from t_candidates c join (select experiment_id, compressor_id, list_sort(list({delta}))[(count(*) - 1) * 50 // 100 + 1] as mid
        from t_candidates where status = 'applicable' and {delta} is not null group by 1, 2) q
      on q.experiment_id = c.experiment_id and q.compressor_id = c.compressor_id and c.{delta} = q.mid
      where status = 'applicable' group by 1, 2"""


@query(
    "D14_compressor_summary",
    """select t.*, l[(n - 1) * 50 // 100 + 1] as processing_p50_us, l[(n - 1) * 90 // 100 + 1] as processing_p90_us,
         l[(n - 1) * 95 // 100 + 1] as processing_p95_us, l[(n - 1) * 99 // 100 + 1] as processing_p99_us,
         mb.m as median_byte_reduction_bp, mt.m as median_token_reduction_bp, u.unique_byte_reduction, u.unique_token_reduction
       from tot t join lat using (experiment_id, compressor_id) left join mb using (experiment_id, compressor_id)
       left join mt using (experiment_id, compressor_id) left join uq u using (experiment_id, compressor_id)""",
    tot=_TOTALS, lat=_LAT, uq=_UNIQ, mb=_median_sql("bytes_delta", "input_bytes"), mt=_median_sql("token_delta", "input_tokens"),
)
def compressor_summary(spark, root):
    return compression.compressor_summary(star_trace(spark, root))


@query("D15_unique_reductions", "select * from uq", uq=_UNIQ)
def unique_reductions(spark, root):
    return compression.unique_reductions(star_trace(spark, root).candidates)


@query(
    "F02_latency_floor_rank",
    """select experiment_id, compressor_id, l[(n - 1) * 50 // 100 + 1] as processing_p50_us, l[(n - 1) * 90 // 100 + 1] as processing_p90_us,
         l[(n - 1) * 95 // 100 + 1] as processing_p95_us, l[(n - 1) * 99 // 100 + 1] as processing_p99_us from lat""",
    lat=_LAT,
)
def latency_percentiles(spark, root):
    return compression.latency_percentiles(star_trace(spark, root).candidates)


def _hist_sql(edges, value, where):
    rows = ", ".join(
        f"('{label}', {low}, {edges[i + 1][1] if i + 1 < len(edges) else 'null'})" for i, (label, low) in enumerate(edges)
    )
    return f"""select e.experiment_id, b.label, cast(b.lower as bigint) as lower, (select count(*) from t_candidates c
        where c.experiment_id = e.experiment_id and {where} and {value} >= b.lower and (b.upper is null or {value} < b.upper)) as count
      from (select distinct experiment_id from t_candidates) e, (values {rows}) b(label, lower, upper)"""


@query(
    "D16_reduction_histogram",
    _hist_sql(compression.REDUCTION_EDGES, "bytes_delta * 10000 // input_bytes", "c.status = 'applicable' and input_bytes > 0"),
)
def reduction_histogram(spark, root):
    return compression.reduction_histogram(star_trace(spark, root).candidates)


@query("D16_latency_histogram", _hist_sql(compression.LATENCY_EDGES, "processing_us", "true"))
def latency_histogram(spark, root):
    return compression.latency_histogram(star_trace(spark, root).candidates)


@query(
    "L04_candidate_page",
    """select c.candidate_id, c.experiment_id, c.snapshot_id, b.ordinal, b.kind, b.origin, b.detected_kind, c.compressor_id, c.status,
         c.input_bytes, c.output_bytes, c.bytes_delta, c.token_delta, c.cache_risk, f.n > 1 as exact_repetition, f.n as persistence,
         cast(70 as bigint) as next_offset
       from t_candidates c join t_blocks b using (block_id) left join (select exact_fp, count(*) as n from t_blocks
         where exact_fp is not null group by 1) f on f.exact_fp = b.exact_fp
       where c.experiment_id = 'exp-1' order by c.candidate_id limit 50 offset 20""",
)
def candidate_page(spark, root):
    from ..operators.sessions import page

    rows = compression.candidate_rows(star_trace(spark, root)).where("experiment_id = 'exp-1'")
    return page(rows, [F.col("candidate_id").asc()], 50, 20)


@query("D42_status_matrix", "select compressor_id, status, count(*) as candidates from t_candidates group by 1, 2")
def status_matrix(spark, root):
    return compression.status_matrix(star_trace(spark, root).candidates)


@query(
    "D40_forecast",
    """select compressor_id, count(*) as eligible, count(*) filter (status = 'applicable') as applicable,
         cast(coalesce(sum(input_tokens) filter (status = 'applicable'), 0) as bigint) as applicable_tokens from t_candidates group by 1""",
)
def forecast(spark, root):
    return compression.forecast(star_trace(spark, root).candidates)


def _script_sql(keys, source):
    k = ", ".join(keys)
    using = f"using ({k})"
    return f"""select {k}, t.evaluations, t.applicable, round(t.applicable::double / t.evaluations, 9) as applicability, t.input_bytes,
        t.byte_reduction, t.token_reduction, u.unique_byte_reduction, u.unique_token_reduction,
        round(t.mb, 9) as median_byte_ratio, round(t.mt, 9) as median_token_ratio
      from (select {k}, count(*) as evaluations, count(*) filter (status = 'applicable') as applicable,
              cast(coalesce(sum(input_bytes) filter (status = 'applicable'), 0) as bigint) as input_bytes,
              cast(coalesce(sum(bytes_delta) filter (status = 'applicable'), 0) as bigint) as byte_reduction,
              cast(coalesce(sum(token_delta) filter (status = 'applicable'), 0) as bigint) as token_reduction,
              quantile_cont(bytes_delta::double / nullif(input_bytes, 0), 0.5) filter (status = 'applicable') as mb,
              quantile_cont(token_delta::double / nullif(input_tokens, 0), 0.5) filter (status = 'applicable') as mt
            from {source} group by {k}) t
      left join (select {k}, cast(sum(b) as bigint) as unique_byte_reduction, cast(sum(t) as bigint) as unique_token_reduction
        from (select {k}, original_fp, max(bytes_delta) as b, max(token_delta) as t from {source} where status = 'applicable'
              group by {k}, original_fp) group by {k}) u {using}"""


@query("D37_compressor_report", _script_sql(["compressor_id"], "t_candidates"))
def compressor_report(spark, root):
    out = compression.script_compressor_report(star_trace(spark, root).candidates, ["compressor_id"])
    return rounded(out, "applicability", "median_byte_ratio", "median_token_ratio")


def labelled_candidates(trace):
    """Candidates with the workload of their session; sessions without a label are `unmapped`."""
    place = trace.snapshots.select("snapshot_id", "session_id")
    joined = trace.candidates.join(place, "snapshot_id").join(
        trace.workloads.select("session_id", "workload"), "session_id", "left"
    )
    return joined.withColumn("workload", F.coalesce("workload", F.lit("unmapped")))


_LABELLED_CANDIDATES = """select c.*, s.session_id, coalesce(w.workload, 'unmapped') as workload from t_candidates c
  join t_snapshots s using (snapshot_id) left join t_workloads w on w.session_id = s.session_id"""


@query("Q11_shadow_report_by_workload", _script_sql(["experiment_id", "workload", "compressor_id"], "lc"), lc=_LABELLED_CANDIDATES)
def shadow_report(spark, root):
    rows = labelled_candidates(star_trace(spark, root))
    out = compression.script_compressor_report(rows, ["experiment_id", "workload", "compressor_id"])
    return rounded(out, "applicability", "median_byte_ratio", "median_token_ratio")


@query(
    "J12_workload_distribution",
    "select workload, count(distinct session_id) as session_count, count(*) as candidate_count from lc group by 1",
    lc=_LABELLED_CANDIDATES,
)
def workload_distribution(spark, root):
    rows = labelled_candidates(star_trace(spark, root))
    per_session = rows.groupBy("workload", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return per_session.groupBy("workload").agg(F.count(F.lit(1)).alias("session_count"), F.sum("n").alias("candidate_count"))


@query(
    "D37_status_and_shape_counts",
    """select compressor_id, status as value, 'status' as label, count(*) as count from t_candidates group by 1, 2
       union all select compressor_id, coalesce(text_shape, 'unknown'), 'text_shape', count(*) from t_candidates group by 1, 2""",
)
def status_and_shapes(spark, root):
    rows = star_trace(spark, root).candidates
    one = lambda c: compression.value_counts(rows, ["compressor_id"], c).select(
        "compressor_id", F.col(c).alias("value"), F.lit(c).alias("label"), "count"
    )
    return one("status").unionByName(one("text_shape"))


@query(
    "R20_candidate_selection",
    """select e.experiment_id, case when f.x is null then 'blocked_requested_candidate_did_not_qualify'
         else 'selected_after_all_gates_passed' end as decision, case when f.x is not null then 'json.minify' end as selected_compressor
       from t_experiments e left join (select experiment_id, 1 as x from tot where compressor_id = 'json.minify'
         and provider_readability = 'unknown' and applicable_blocks > 0 and byte_reduction > 0 and recovery_bp = 10000
         and deterministic_bp = 10000) f using (experiment_id)""",
    tot=_TOTALS,
)
def candidate_selection(spark, root):
    trace = star_trace(spark, root)
    return compression.select_candidate(
        compression.compressor_totals(trace.candidates), trace.experiments, True, "json.minify"
    )


@query(
    "F13_compressor_family",
    """select compressor_id, case when compressor_id like 'search.%' then 'search' when compressor_id like 'tests.%' then 'tests'
      when compressor_id like 'shell.%' then 'shell_generic' else 'generic_control' end as family, count(*) as candidates
      from t_candidates group by 1, 2""",
)
def compressor_families(spark, root):
    return star_trace(spark, root).candidates.groupBy(
        "compressor_id", labels.compressor_family("compressor_id").alias("family")
    ).agg(F.count(F.lit(1)).alias("candidates"))
