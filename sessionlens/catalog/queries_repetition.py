"""Repetition, deltas, compaction and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compaction, delta, lineage, repetition, views
from ..sources.bindings import star_trace
from .queries_core import _DIST, PERCENTILES, rounded
from .registry import query

_KEYED = """select *, coalesce(estimated_tokens, 0) as tok, coalesce(nullif(detected_kind, ''), 'unknown') as detected
  from (select 'exact' as field, exact_fp as fp, * from v_placed where exact_fp is not null
        union all select 'semantic', semantic_fp, * from v_placed where semantic_fp is not null)"""
_RANKED = """select *, row_number() over (partition by session_id, field, fp order by snapshot_order, ordinal) as rn,
    min(snapshot_order) over (partition by session_id, field, fp) as first_order from keyed"""
CH = dict(keyed=_KEYED, ranked=_RANKED)


@query(
    "D29_session_repetition",
    """select r.field, count(*) filter (rn > 1) as repeated_blocks, cast(sum(tok) filter (rn > 1) as bigint) as repeated_tokens,
         any_value(w.b) as within_blocks, any_value(w.t) as within_tokens,
         count(*) filter (snapshot_order > first_order) as cross_blocks,
         cast(sum(tok) filter (snapshot_order > first_order) as bigint) as cross_tokens,
         (select cast(sum(estimated_tokens) as bigint) from v_placed) as estimated_token_total,
         round(sum(tok) filter (rn > 1)::double / (select sum(estimated_tokens) from v_placed), 9) as repeated_token_share
       from ranked r join (select field, cast(sum(n - 1) as bigint) as b,
           cast(round_even(sum(t * (n - 1)::double / n), 0) as bigint) as t from (select session_id, field, fp, snapshot_order, count(*) as n, sum(tok) as t
             from keyed group by all) group by 1) w on w.field = r.field group by 1""",
    **CH,
)
def session_repetition(spark, root):
    return rounded(repetition.session_repetition(star_trace(spark, root)), "repeated_token_share")


@query("W07_occurrence_index", "select block_id, rn as occurrence from ranked where field = 'exact'", **CH)
def occurrence_index(spark, root):
    return repetition.occurrence_index(star_trace(spark, root)).select("block_id", "occurrence")


_GROUPS = """select session_id, field, fp, count(distinct snapshot_order) as persistence,
    max(detected) filter (rn = 1) as detected, max(estimated_tokens) filter (rn = 1) as first_tokens from ranked group by 1, 2, 3"""


@query(
    "D30_persistence",
    f"""select name, {_DIST.format('persistence')}, round(avg(persistence), 9) as average from
        (select 'all' as name, persistence from g union all select detected, persistence from g) group by 1""",
    **CH, g=_GROUPS,
)
def persistence(spark, root):
    out = rounded(repetition.persistence_distribution(star_trace(spark, root)), "average")
    return rounded(out, *PERCENTILES, digits=6)


_EFFECTIVE = """select e.detected as name, e.t as effective_tokens, coalesce(f.u, 0) as unique_tokens,
    e.t::double / nullif(coalesce(f.u, 0), 0) as redundancy_factor, f.p as average_persistence,
    e.t - coalesce(f.ft, 0) as repeated_tokens, (e.t - coalesce(f.ft, 0)) * coalesce(f.p, 1) as redundant_exposure
  from (select detected, cast(sum(tok) as bigint) as t from keyed group by 1) e
  left join (select detected, cast(coalesce(sum(first_tokens) filter (field = 'semantic'), 0) as bigint) as u,
      cast(coalesce(sum(first_tokens), 0) as bigint) as ft, avg(persistence) as p from g group by 1) f on f.detected = e.detected"""


@query(
    "D31_effective_presence",
    """select name, effective_tokens, unique_tokens, round(redundancy_factor, 9) as redundancy_factor,
       round(average_persistence, 9) as average_persistence, repeated_tokens, round(redundant_exposure, 5) as redundant_exposure
       from eff""",
    **CH, g=_GROUPS, eff=_EFFECTIVE,
)
def effective_presence(spark, root):
    out = repetition.effective_presence(star_trace(spark, root))
    return rounded(rounded(out, "redundancy_factor", "average_persistence"), "redundant_exposure", digits=5)


@query(
    "D32_repetition_by_group",
    """select t.origin, t.kind, t.block_count, t.estimated_tokens,
         round(t.estimated_tokens::double / (select sum(estimated_tokens) from v_placed), 9) as token_share,
         coalesce(r.eb, 0) as exact_repeated_blocks, coalesce(r.et, 0) as exact_repeated_tokens,
         coalesce(r.sb, 0) as semantic_repeated_blocks, coalesce(r.st, 0) as semantic_repeated_tokens,
         coalesce(r.uniq, 0) as unique_tokens, round(t.estimated_tokens::double / nullif(coalesce(r.uniq, 0), 0), 9) as redundancy_factor,
         round(p.a, 9) as average_persistence, p.m as max_persistence
       from (select origin, kind, count(*) as block_count, cast(coalesce(sum(estimated_tokens), 0) as bigint) as estimated_tokens
             from v_placed group by 1, 2) t
       left join (select origin, kind, count(*) filter (field = 'exact' and rn > 1) as eb,
           cast(sum(tok) filter (field = 'exact' and rn > 1) as bigint) as et,
           count(*) filter (field = 'semantic' and rn > 1) as sb, cast(sum(tok) filter (field = 'semantic' and rn > 1) as bigint) as st,
           cast(sum(tok) filter (field = 'semantic' and rn = 1) as bigint) as uniq from ranked group by 1, 2) r using (origin, kind)
       left join (select origin, kind, avg(n) as a, max(n) as m from (select session_id, field, fp, origin, kind,
           count(distinct snapshot_order) as n from keyed group by all) group by 1, 2) p using (origin, kind)""",
    **CH,
)
def repetition_by_group(spark, root):
    out = repetition.repetition_by_group(star_trace(spark, root), ["origin", "kind"])
    return rounded(out, "token_share", "redundancy_factor", "average_persistence")


_WEIGHTS = "select * from (values " + ", ".join(
    f"('{k}', {c}::double, {s}::double)" for k, (c, s) in repetition.CONTROLS.items()
) + ") w(name, control, safety)"
_RANKING = """select d.name, d.t as estimated_tokens, d.share as token_share, e.redundancy_factor, e.average_persistence as persistence,
    conf.c as measurement_confidence, coalesce(w.control, 0.4) as controllability, coalesce(w.safety, 0.4) as semantic_safety,
    d.share * (coalesce(nullif(e.redundancy_factor, 0), 1) / m.r) * (coalesce(nullif(e.average_persistence, 0), 1) / m.p) * conf.c
      * coalesce(w.control, 0.4) * coalesce(w.safety, 0.4) as priority_score
  from (select coalesce(detected_kind, 'unknown') as name, cast(coalesce(sum(estimated_tokens), 0) as bigint) as t,
          sum(estimated_tokens)::double / (select sum(estimated_tokens) from t_blocks) as share from t_blocks group by 1) d
  left join eff e on e.name = d.name left join weights w on w.name = d.name,
  (select max(coalesce(nullif(redundancy_factor, 0), 1)) as r, max(coalesce(nullif(average_persistence, 0), 1)) as p from eff) m,
  (select (select count(estimated_tokens)::double / count(*) from t_blocks)
     * (select sum(semantic_coverage_bp)::double / (count(semantic_coverage_bp) * 10000.0) from t_metrics) as c) conf"""
RK = dict(**CH, g=_GROUPS, eff=_EFFECTIVE, weights=_WEIGHTS, ranking=_RANKING)


@query(
    "D34_opportunity_ranking",
    """select name, round(priority_score, 9) as priority_score, estimated_tokens, round(token_share, 9) as token_share,
       round(redundancy_factor, 9) as redundancy_factor, round(persistence, 9) as persistence,
       round(measurement_confidence, 9) as measurement_confidence, controllability::double as controllability,
       semantic_safety::double as semantic_safety from ranking""",
    **RK,
)
def opportunity_ranking(spark, root):
    out = repetition.opportunity_ranking(star_trace(spark, root))
    return rounded(out, "priority_score", "token_share", "redundancy_factor", "persistence", "measurement_confidence")


@query(
    "L06_top_three",
    "select string_agg(name, ',' order by priority_score desc, name) as top from (select * from ranking order by priority_score desc, name limit 3)",
    **RK,
)
def top_three(spark, root):
    top = repetition.top_ranked(repetition.opportunity_ranking(star_trace(spark, root)))
    return top.select(F.array_join("top", ",").alias("top"))


@query(
    "Q16_opportunities_view",
    """select r.name, round(r.priority_score, 9) as priority_score, e.effective_tokens, e.unique_tokens,
       round(e.redundant_exposure, 5) as redundant_exposure from ranking r left join eff e on e.name = r.name""",
    **RK,
)
def opportunities_view(spark, root):
    out = repetition.opportunities_view(star_trace(spark, root)).select(
        "name", "priority_score", "effective_tokens", "unique_tokens", "redundant_exposure"
    )
    return rounded(rounded(out, "priority_score"), "redundant_exposure", digits=5)


@query(
    "D35_stable_prefix",
    """select p.*, d.* from (select cast(coalesce(sum(stable_prefix_estimate), 0) as bigint) as prefix_tokens,
         round(avg(stable_prefix_estimate), 6) as mean_prefix_tokens, round(sum(stable_prefix_estimate)::double
           / (select sum(estimated_tokens) from t_blocks), 9) as prefix_share from t_metrics) p,
       (select cast(sum(repeated_blocks) as bigint) as repeated_blocks, cast(sum(new_blocks) as bigint) as new_blocks,
         cast(sum(changed_blocks) as bigint) as changed_blocks, cast(sum(removed_blocks) as bigint) as removed_blocks,
         cast(sum(repeated_tokens) as bigint) as repeated_tokens, cast(sum(new_tokens) as bigint) as new_tokens,
         cast(sum(common_prefix_tokens) as bigint) as common_prefix_tokens from t_deltas) d""",
)
def stable_prefix(spark, root):
    return rounded(rounded(repetition.stable_prefix(star_trace(spark, root)), "prefix_share"), "mean_prefix_tokens", digits=6)


# --- deltas ------------------------------------------------------------------------------------------

_PAIRS = """select session_id, snapshot_id as cur, lag(snapshot_id) over w as prev, status as cs, lag(status) over w as ps
  from v_ordered window w as (partition by session_id order by snapshot_order)"""
_DELTA = dict(
    pairs=f"select * from ({_PAIRS}) where prev is not null",
    cur0="""select p.cur as pair, b.ordinal, b.exact_fp as e, b.semantic_fp as s, b.estimated_tokens as t,
        row_number() over (partition by p.cur order by b.ordinal) as pos,
        row_number() over (partition by p.cur, b.exact_fp order by b.ordinal) as re
      from pairs p join t_blocks b on b.snapshot_id = p.cur""",
    prv0="""select p.cur as pair, b.ordinal, b.exact_fp as e, b.semantic_fp as s,
        row_number() over (partition by p.cur order by b.ordinal) as pos,
        row_number() over (partition by p.cur, b.exact_fp, b.semantic_fp order by b.ordinal) as res
      from pairs p join t_blocks b on b.snapshot_id = p.prev""",
    cur1="""select c.*, c.e is not null and c.re <= coalesce(n.n, 0) as repeated from cur0 c
      left join (select pair, e, count(*) as n from prv0 group by 1, 2) n on n.pair = c.pair and n.e = c.e""",
    prv1="""select p.*, p.e is not null and p.res <= coalesce(n.n, 0) as pa from prv0 p
      left join (select pair, e, s, count(*) as n from cur1 where repeated group by 1, 2, 3) n
        on n.pair = p.pair and n.e = p.e and n.s is not distinct from p.s""",
    prv2="""select p.*, pa or (e is not null and not pa and row_number() over (partition by pair, e, pa order by ordinal)
        <= coalesce(n, 0) - coalesce(na, 0)) as taken
      from (select p.*, u.n, a.na from prv1 p
        left join (select pair, e, count(*) as n from cur1 where repeated group by 1, 2) u on u.pair = p.pair and u.e = p.e
        left join (select pair, e, count(*) as na from prv1 where pa group by 1, 2) a on a.pair = p.pair and a.e = p.e) p""",
    cur2="""select c.*, coalesce(seeks and row_number() over (partition by c.pair, c.s, seeks order by ordinal) <= coalesce(n.n, 0), false) as changed
      from (select *, not repeated and s is not null as seeks from cur1) c
      left join (select pair, s, count(*) as n from prv2 where not taken and s is not null group by 1, 2) n
        on n.pair = c.pair and n.s = c.s""",
    pos="""select coalesce(c.pair, p.pair) as pair, coalesce(c.pos, p.pos) as pos, c.t, c.pos is not null and p.pos is not null as both_,
        coalesce(c.e = p.e, false) as same from cur0 c full join prv0 p on c.pair = p.pair and c.pos = p.pos""",
    pre="""select pair, min(pos) filter (not same) as stop, coalesce(bool_or(both_ and not same), false) as mismatch from pos group by 1""",
    prefix="""select r.pair, any_value(r.mismatch) as mismatch, count(*) filter (p.pos < coalesce(r.stop, 2147483647)) as n,
        case when count(*) filter (p.pos < coalesce(r.stop, 2147483647) and p.t is null) = 0
          then coalesce(sum(p.t) filter (p.pos < coalesce(r.stop, 2147483647)), 0) end as t
      from pre r join pos p on p.pair = r.pair group by 1""",
    sizes="select snapshot_id, count(*) as n from t_blocks group by 1",
    delta="""select p.cur as current_snapshot_id, p.prev as previous_snapshot_id,
        case when lim then 'resource_limit' else 'complete' end as status,
        coalesce(c.r, 0) as repeated_blocks, coalesce(c.n, 0) as new_blocks, coalesce(c.c, 0) as changed_blocks,
        coalesce(v.l, 0) - coalesce(c.c, 0) as removed_blocks,
        cast(case when c.pair is null then 0 else c.rt end as bigint) as repeated_tokens,
        cast(case when c.pair is null then 0 else c.nt end as bigint) as new_tokens,
        case when not (lim and not coalesce(x.mismatch, false) and same_size) then coalesce(x.n, 0) end as common_prefix_blocks,
        cast(case when not (lim and not coalesce(x.mismatch, false) and same_size)
          then case when x.pair is null then 0 else x.t end end as bigint) as common_prefix_tokens
      from (select p.*, coalesce(cs, '') <> 'complete' or coalesce(ps, '') <> 'complete' as lim,
              coalesce(a.n, 0) = coalesce(b.n, 0) as same_size
            from pairs p left join sizes a on a.snapshot_id = p.cur left join sizes b on b.snapshot_id = p.prev) p
      left join (select pair, count(*) filter (repeated) as r, count(*) filter (changed) as c,
          count(*) filter (not repeated and not changed) as n,
          case when count(*) filter (repeated and t is null) = 0 then coalesce(sum(t) filter (repeated), 0) end as rt,
          case when count(*) filter (not repeated and not changed and t is null) = 0
            then coalesce(sum(t) filter (not repeated and not changed), 0) end as nt from cur2 group by 1) c on c.pair = p.cur
      left join (select pair, count(*) filter (not taken) as l from prv2 group by 1) v on v.pair = p.cur
      left join prefix x on x.pair = p.cur""",
)


@query("C10_context_deltas", "select * from delta", **_DELTA)
def context_deltas(spark, root):
    return delta.trace_deltas(star_trace(spark, root))


@query(
    "J13_previous_snapshot",
    "select session_id, cur as current_snapshot_id, prev as previous_snapshot_id from pairs", pairs=_DELTA["pairs"],
)
def previous_snapshot(spark, root):
    return delta.snapshot_pairs(star_trace(spark, root).snapshots).select(
        "session_id", "current_snapshot_id", "previous_snapshot_id"
    )


@query(
    "W10_common_prefix",
    "select common_prefix_blocks, count(*) as pairs from delta group by 1", **_DELTA,
)
def common_prefix(spark, root):
    return delta.trace_deltas(star_trace(spark, root)).groupBy("common_prefix_blocks").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "C12_token_reconciliation",
    """select comparability, count(*) as snapshots, cast(sum(residual) as bigint) as residual_tokens from (
         select case when provider_input_tokens is null then 'missing_provider_usage'
             when visible_estimated_tokens is null then 'missing_local_estimate'
             when correlation_status <> 'correlated' then 'not_comparable'
             when logical_context_status = 'explicit_only' then 'comparable_approximate' else 'partial_visibility' end as comparability,
           case when provider_input_tokens is not null and visible_estimated_tokens is not null and correlation_status = 'correlated'
             then provider_input_tokens - visible_estimated_tokens end as residual
         from t_snapshots join t_metrics using (snapshot_id)) group by 1""",
)
def token_reconciliation(spark, root):
    trace = star_trace(spark, root)
    rows = trace.snapshots.join(trace.metrics, "snapshot_id")
    out = delta.reconcile(
        rows, "visible_estimated_tokens", "provider_input_tokens", "logical_context_status",
        F.col("correlation_status") == "correlated",
    )
    return out.groupBy("comparability").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("residual_tokens").alias("residual_tokens")
    )


# --- compaction ----------------------------------------------------------------------------------------

_COMP = dict(
    marked="""select s.*, coalesce(r.request_kind in ('compaction_v2', 'compaction_legacy', 'compaction'), false) as is_c
      from v_ordered s left join t_requests r on r.request_id = s.provider_request_id""",
    windowed="""select *, coalesce(sum(is_c::int) over (partition by session_id order by snapshot_order
        rows between unbounded preceding and 1 preceding), 0) as w,
        sum(is_c::int) over (partition by session_id) as total from marked""",
    vis="select snapshot_id, cast(sum(estimated_tokens) as bigint) as visible from t_blocks group by 1",
    prov="select f.request_id, u.input_total from v_final f left join t_usage u on u.attempt_id = f.attempt_id",
    grid="""select session_id, unnest(range(0, cast(any_value(total) as bigint) + 1)) as w from windowed where total > 0 group by session_id""",
    ordinary="""select x.*, v.visible, p.input_total from windowed x left join vis v on v.snapshot_id = x.snapshot_id
      left join prov p on p.request_id = x.provider_request_id where not is_c""",
    cpairs="""select c.session_id, cast(c.w + 1 as bigint) as compaction_index,
        (select o.snapshot_id from ordinary o where o.session_id = c.session_id and o.snapshot_order < c.snapshot_order
           order by o.snapshot_order desc limit 1) as before_id,
        (select o.snapshot_id from ordinary o where o.session_id = c.session_id and o.snapshot_order > c.snapshot_order
           order by o.snapshot_order limit 1) as after_id
      from windowed c where is_c""",
    cp="""select p.*, a.visible as before_tokens, b.visible as after_tokens,
        (a.visible - b.visible)::double / nullif(a.visible, 0) as context_reduction
      from cpairs p left join vis a on a.snapshot_id = before_id left join vis b on b.snapshot_id = after_id
      where before_id is not null and after_id is not null""",
)


@query(
    "W09_compaction_windows",
    """select g.session_id, g.w as window_index, count(o.snapshot_id) as requests,
         cast(sum(o.visible) as bigint) as visible_estimated_tokens, cast(sum(o.input_total) as bigint) as provider_input_tokens
       from grid g left join ordinary o on o.session_id = g.session_id and o.w = g.w group by 1, 2""",
    **_COMP,
)
def compaction_windows(spark, root):
    return compaction.compaction_windows(star_trace(spark, root))


@query(
    "J14_compaction_neighbours",
    """select session_id, compaction_index, before_id, after_id, before_tokens, after_tokens,
         round(context_reduction, 9) as context_reduction from cp""",
    **_COMP,
)
def compaction_neighbours(spark, root):
    return rounded(compaction.compaction_pairs(star_trace(spark, root)).drop("pair"), "context_reduction")


_SURV = """select b.name, cast(sum(b.estimated_tokens) as bigint) as before_tokens,
    cast(coalesce(sum(b.estimated_tokens) filter (b.fp is not null and b.rn <= coalesce(a.n, 0)), 0) as bigint) as survived_tokens
  from (select p.session_id, p.compaction_index, coalesce(detected_kind, 'unknown') as name, estimated_tokens,
          coalesce(semantic_fp, exact_fp) as fp, semantic_fp is not null as sem,
          row_number() over (partition by p.session_id, p.compaction_index, semantic_fp is not null, coalesce(semantic_fp, exact_fp)
            order by ordinal) as rn
        from cp p join t_blocks x on x.snapshot_id = p.before_id where estimated_tokens is not null) b
  left join (select p.session_id, p.compaction_index, coalesce(semantic_fp, exact_fp) as fp, semantic_fp is not null as sem, count(*) as n
        from cp p join t_blocks x on x.snapshot_id = p.after_id group by 1, 2, 3, 4) a
    on a.session_id = b.session_id and a.compaction_index = b.compaction_index and a.fp = b.fp and a.sem = b.sem group by 1"""


@query(
    "Q03_compaction_survival",
    "select *, round(survived_tokens::double / nullif(before_tokens, 0), 9) as survival_share from surv", **_COMP, surv=_SURV,
)
def compaction_survival(spark, root):
    return rounded(compaction.compaction_survival(star_trace(spark, root)), "survival_share")


@query(
    "X06_multiset_match",
    "select name, survived_tokens from surv", **_COMP, surv=_SURV,
)
def multiset_match(spark, root):
    return compaction.compaction_survival(star_trace(spark, root)).select("name", "survived_tokens")


@query(
    "Q02_compaction_summary",
    f"""select c.*, (select count(*) from cp) as pre_post_pairs, d.* from
        (select count(*) as requests, count(*) filter (request_kind = 'compaction_v2') as v2_requests,
           count(*) filter (request_kind = 'compaction') as legacy_requests, count(compaction_trigger) as trigger_seen,
           count(*) filter (request_id in (select request_id from t_attempts where compaction_output_seen)) as output_seen
         from t_requests where request_kind in ('compaction_v2', 'compaction')) c,
        (select count as reduction_count, p50 as reduction_p50, p75 as reduction_p75, p90 as reduction_p90, p95 as reduction_p95,
           p99 as reduction_p99, max as reduction_max from (select {_DIST.format('context_reduction')} from cp)) d""",
    **_COMP,
)
def compaction_summary(spark, root):
    out = compaction.compaction_summary(star_trace(spark, root))
    return rounded(out, *[f"reduction_{p}" for p in PERCENTILES], digits=6)


@query(
    "Q02_trigger_counts",
    """select compaction_trigger, count(*) as requests from t_requests where request_kind in ('compaction_v2', 'compaction')
       and compaction_trigger is not null group by 1""",
)
def trigger_counts(spark, root):
    return compaction.trigger_counts(star_trace(spark, root))


# --- lineage ---------------------------------------------------------------------------------------------

_LIN = dict(
    ord="""select snapshot_id, session_id, provider_request_id, row_number() over (partition by session_id order by completed_at_us is null,
        coalesce(nullif(completed_at_us, 0), nullif(started_at_us, 0), 0), snapshot_id) as req
      from t_snapshots where status = 'complete' and snapshot_id in (select snapshot_id from t_blocks)""",
    occ="""select b.*, o.session_id, o.req, coalesce(w.workload, 'unmapped') as workload, r.request_kind,
        coalesce(b.estimated_tokens, greatest(1, cast(ceil(b.raw_bytes / 4.0) as bigint))) as tokens
      from t_blocks b join ord o on o.snapshot_id = b.snapshot_id left join t_workloads w on w.session_id = o.session_id
      left join t_requests r on r.request_id = o.provider_request_id""",
    fol="select * from occ where kind = 'tool_result' and tool_call_id is not null and exact_fp is not null",
    frk="""select *, min(req) over k as first_seen, row_number() over (partition by session_id, tool_call_id, exact_fp
        order by req, ordinal, block_id) as rn from fol window k as (partition by session_id, tool_call_id, exact_fp)""",
    lin="""select session_id, tool_call_id, exact_fp, min(req) as first_seen, max(req) as last_seen,
        count(distinct req) as requests_present, count(*) as occurrences, cast(sum(tokens) as bigint) as cumulative_exposure,
        max(req) - min(req) as requests_after_creation, count(*) filter (req > first_seen) as exact_reappearances,
        max(tokens) filter (rn = 1) as lineage_tokens, max(raw_bytes) filter (rn = 1) as lineage_bytes,
        coalesce(max(detected_kind) filter (rn = 1), 'unknown') as content_kind,
        coalesce(max(tool_name) filter (rn = 1), 'unknown') as tool_family, max(workload) filter (rn = 1) as workload,
        max(semantic_fp) filter (rn = 1) as lineage_semantic_fp from frk group by 1, 2, 3""",
    hist="""select f.*, l.lineage_tokens, f.req - f.first_seen as age from frk f join lin l using (session_id, tool_call_id, exact_fp)
      where f.req > f.first_seen""",
    tot="select sum(tokens) as total from occ",
)


def _rows(spark, root):
    rows = lineage.occurrences(star_trace(spark, root))
    return rows, lineage.lineages(rows)


@query("Q04_lineages", "select * from lin", **_LIN)
def lineages(spark, root):
    return _rows(spark, root)[1]


@query(
    "Q04_lineage_exclusions",
    """select case when tool_call_id is null then 'missing_tool_call_id' else 'missing_exact_fingerprint' end as reason, count(*) as blocks
       from occ where kind = 'tool_result' and (tool_call_id is null or exact_fp is null) group by 1""",
    **_LIN,
)
def lineage_exclusions(spark, root):
    return lineage.exclusions(lineage.occurrences(star_trace(spark, root)))


@query("W05_request_ordinal", "select snapshot_id, req as request_ordinal from ord", **_LIN)
def request_ordinal(spark, root):
    return lineage.request_order(star_trace(spark, root)).select("snapshot_id", "request_ordinal")


@query(
    "Q05_semantic_reappearances",
    """select l.session_id, l.tool_call_id, l.exact_fp, (select count(*) from fol f where f.session_id = l.session_id
         and f.semantic_fp = l.lineage_semantic_fp and f.req > l.first_seen
         and (f.tool_call_id <> l.tool_call_id or f.exact_fp <> l.exact_fp)) as semantic_reappearances from lin l""",
    **_LIN,
)
def semantic_reappearances(spark, root):
    return lineage.semantic_reappearances(*_rows(spark, root)).select(*lineage.KEY, "semantic_reappearances")


@query(
    "Q06_age_exposure",
    """select a as age_at_least, cast(coalesce(sum(h.tokens), 0) as bigint) as exposure,
         round(coalesce(sum(h.tokens), 0)::double / (select total from tot), 9) as share_of_context
       from (values (1::bigint), (2), (3), (5), (10)) v(a) left join hist h on h.age >= a group by 1""",
    **_LIN,
)
def age_exposure(spark, root):
    return rounded(lineage.age_exposure(*_rows(spark, root)), "share_of_context")


_SIZE = """case when {0} < 256 then '<256' when {0} < 1024 then '256-1K' when {0} < 4096 then '1K-4K' when {0} < 16384 then '4K-16K' else '>16K' end"""


@query(
    "Q06_size_age_matrix",
    f"""select s as size, a as age_at_least, count(h.block_id) as results, cast(coalesce(sum(h.tokens), 0) as bigint) as exposure,
         round(coalesce(sum(h.tokens), 0)::double / (select total from tot), 9) as share_of_context
       from (values (1::bigint), (2), (3), (5), (10)) v(a), (values ('<256'), ('256-1K'), ('1K-4K'), ('4K-16K'), ('>16K')) z(s)
       left join hist h on h.age >= a and {_SIZE.format('h.lineage_tokens')} = s group by 1, 2""",
    **_LIN,
)
def size_age_matrix(spark, root):
    return rounded(lineage.size_age_matrix(*_rows(spark, root)), "share_of_context")


@query(
    "Q07_lifetime_distributions",
    f"""select coalesce(content_kind, 'all') as content_kind, coalesce(tool_family, 'all') as tool_family,
         coalesce(workload, 'all') as workload, {_DIST.format('requests_after_creation')} from lin
       group by grouping sets ((content_kind, tool_family), (content_kind), (tool_family), (workload))""",
    **_LIN,
)
def lifetime_distributions(spark, root):
    return rounded(lineage.lifetime_distributions(_rows(spark, root)[1]), *PERCENTILES, digits=6)


_EVICT = dict(
    pol="""select * from (values ('E0', 1000000000, 0), ('E1', 1, 0), ('E2', 2, 0), ('E3', 3, 0), ('E4', 2, 512), ('E5', 2, 2048)) p(policy, a, z)""",
    sel="""select p.policy, h.*, h.raw_value_start::double / nullif(b.bytes, 0) as prefix_ratio from pol p join hist h
        on h.age >= p.a and h.lineage_tokens >= p.z
      join (select snapshot_id, sum(raw_bytes) as bytes from occ group by 1) b on b.snapshot_id = h.snapshot_id""",
    risk="""select *, case when prefix_ratio is null then 'Unknown' when prefix_ratio >= 0.9 then 'Low' when prefix_ratio >= 0.5
        then 'Medium' else 'High' end as risk from sel""",
    snaps="select session_id, count(distinct snapshot_id) as n from occ group by 1",
    evict="""select p.policy, coalesce(s.n, 0) as selected, coalesce(s.g, 0) as gross, coalesce(s.n, 0) * 24 as stub_overhead,
        coalesce(c.n, 0) * 88 as schema_overhead, coalesce(s.g, 0) - coalesce(s.n, 0) * 24 - coalesce(c.n, 0) * 88 as net,
        (coalesce(s.g, 0) - coalesce(s.n, 0) * 24 - coalesce(c.n, 0) * 88)::double / (select total from tot) as net_share,
        coalesce(s.l, 0) as risk_low, coalesce(s.m, 0) as risk_medium, coalesce(s.h, 0) as risk_high, coalesce(s.u, 0) as risk_unknown
      from pol p left join (select policy, count(*) as n, cast(sum(tokens) as bigint) as g, count(*) filter (risk = 'Low') as l,
          count(*) filter (risk = 'Medium') as m, count(*) filter (risk = 'High') as h, count(*) filter (risk = 'Unknown') as u
        from risk group by 1) s on s.policy = p.policy
      left join (select policy, cast(sum(n) as bigint) as n from (select distinct policy, session_id from sel) join snaps using (session_id)
        group by 1) c on c.policy = p.policy""",
)


@query("Q08_eviction_policies", "select * replace (round(net_share, 9) as net_share) from evict", **_LIN, **_EVICT)
def eviction_policies(spark, root):
    return rounded(lineage.eviction_policies(*_rows(spark, root)), "net_share")


@query("F15_prefix_risk", "select risk, count(*) as occurrences from risk where policy = 'E1' group by 1", **_LIN, **_EVICT)
def prefix_risk(spark, root):
    rows, found = _rows(spark, root)
    return lineage._selected(rows, found, (("E1", 1, 0),)).groupBy("risk").agg(F.count(F.lit(1)).alias("occurrences"))


@query(
    "Q08_eviction_gate",
    """select b.policy as best_policy, round(b.net_share, 9) as best_net_share, h.e as historical_exposure,
         round(h.e::double / t.total, 9) as historical_share, l.n as lineages, l.f as lineages_with_follow_up, c.n as compaction_snapshots,
         case when l.f = 0 then 'insufficient_follow_up_observation' when h.e::double / t.total >= 0.1 or b.net_share >= 0.05
           then 'eviction_may_be_investigated' else 'close_without_runtime_eviction' end as decision
       from (select policy, net_share from evict order by net_share desc, policy limit 1) b,
         (select cast(coalesce(sum(tokens), 0) as bigint) as e from hist) h,
         (select count(*) as n, count(*) filter (m.last > lin.first_seen) as f from lin join (select session_id, max(req) as last
            from occ group by 1) m using (session_id)) l,
         (select count(distinct snapshot_id) as n from occ where request_kind like 'compaction%') c, tot t""",
    **_LIN, **_EVICT,
)
def eviction_gate(spark, root):
    return rounded(lineage.eviction_gate(*_rows(spark, root)), "best_net_share", "historical_share")


@query(
    "Q09_eviction_candidates",
    """select t.policy, t.session_id, t.tool_call_id, t.exact_fp, t.block_id, t.age, t.tokens, sh as schema_share, t.tokens - 24 - sh as net,
         t.risk, round(t.prefix_ratio, 9) as prefix_ratio
       from (select x.*, b.budget // c.n + case when place - 1 < b.budget % c.n then 1 else 0 end as sh from
         (select *, row_number() over (partition by policy order by session_id, tool_call_id, exact_fp, req, ordinal, block_id) as place from top) x
         join (select policy, cast(sum(n) * 88 as bigint) as budget from (select distinct policy, session_id from top)
           join snaps using (session_id) group by 1) b using (policy)
         join (select policy, count(*) as n from top group by 1) c using (policy)) t""",
    **_LIN, **_EVICT,
    top="""select * from risk where policy in ('E1', 'E2') order by policy, session_id, tool_call_id, exact_fp, req, ordinal, block_id limit 1000""",
)
def eviction_candidates(spark, root):
    return rounded(lineage.eviction_candidates(*_rows(spark, root), ("E1", "E2"), 1000), "prefix_ratio")
