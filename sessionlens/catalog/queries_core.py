"""Usage, sessions, composition, quality: totals and pages over the bound trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composition as comp
from ..operators import quality, sessions, usage, views
from ..sources.bindings import snapshots, star_trace
from .registry import query


def rounded(df, *columns: str, digits: int = 9):
    for column in columns:
        df = df.withColumn(column, F.round(column, digits))
    return df


# --- usage ------------------------------------------------------------------------------------

_USAGE = """select {key} cast(count(*) as bigint) as n,
  case when count(u.input_total) = count(*) then cast(sum(u.input_total) as bigint) end as i,
  case when count(u.input_cached) = count(*) then cast(sum(u.input_cached) as bigint) end as c,
  case when count(u.input_uncached) = count(*) then cast(sum(u.input_uncached) as bigint) end as un,
  case when count(u.output_total) = count(*) then cast(sum(u.output_total) as bigint) end as o,
  case when count(u.output_reasoning) = count(*) then cast(sum(u.output_reasoning) as bigint) end as r
  from {source} f left join t_usage u on u.attempt_id = f.attempt_id {group}"""
_TAG = "case when {0} is null then 'unavailable' else 'provider_reported' end as {1}_source"
_PUBLISHED = """{key} n as request_count, i as input_tokens, c as cached_input_tokens,
  coalesce(un, case when i >= c then i - c end) as uncached_input_tokens, o as output_tokens, r as reasoning_tokens,
  round(cast(c as double) / nullif(i, 0), 9) as cache_ratio, """ + ", ".join(
    [
        _TAG.format("i", "input_tokens"), _TAG.format("c", "cached_input_tokens"),
        _TAG.format("coalesce(un, case when i >= c then i - c end)", "uncached_input_tokens"),
        _TAG.format("o", "output_tokens"), _TAG.format("r", "reasoning_tokens"),
        _TAG.format("cast(c as double) / nullif(i, 0)", "cache_ratio"),
    ]
)


@query(
    "D02_usage_by_session",
    f"select {_PUBLISHED.format(key='session_id,')} from agg",
    agg=_USAGE.format(key="f.session_id,", source="v_final", group="group by f.session_id"),
)
def usage_by_session(spark, root):
    return rounded(usage.session_usage(star_trace(spark, root)), "cache_ratio")


@query(
    "D02_usage_total",
    f"select {_PUBLISHED.format(key='')} from agg",
    agg=_USAGE.format(key="", source="v_final", group=""),
)
def usage_total(spark, root):
    return rounded(usage.total_usage(star_trace(spark, root)), "cache_ratio")


@query(
    "D03_analyzed_usage",
    f"select {_PUBLISHED.format(key='')} from agg",
    analyzed="select * from v_final where request_id in (select provider_request_id from v_latest)",
    agg=_USAGE.format(key="", source="analyzed", group=""),
)
def analyzed_usage(spark, root):
    return rounded(usage.analyzed_usage(star_trace(spark, root)), "cache_ratio")


@query(
    "D01_complete_sum",
    """select session_id, cast(count(*) as bigint) as requests,
         case when count(input_cached) = count(*) then cast(sum(input_cached) as bigint) end as cached_complete,
         cast(sum(input_cached) as bigint) as cached_subtotal
       from v_final f left join t_usage u on u.attempt_id = f.attempt_id group by 1""",
)
def complete_sum_by_session(spark, root):
    from ..functions.measures import complete_sum

    return views.request_usage(star_trace(spark, root)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("requests"), complete_sum("input_cached").alias("cached_complete"),
        F.sum("input_cached").alias("cached_subtotal"),
    )


# --- views and joins -----------------------------------------------------------------------------


@query("P01_latest_snapshot", "select provider_request_id, snapshot_id, analysis_version, status from v_latest")
def latest_snapshot(spark, root):
    return views.latest_snapshots(star_trace(spark, root).snapshots).select(
        "provider_request_id", "snapshot_id", "analysis_version", "status"
    )


@query("P02_final_attempt", "select request_id, attempt_id, attempt_status from v_final")
def final_attempt(spark, root):
    return views.request_usage(star_trace(spark, root)).select("request_id", "attempt_id", "attempt_status")


@query(
    "J01_requests_per_session_state",
    """select state, cast(count(*) as bigint) as requests, cast(sum(request_bytes) as bigint) as bytes
       from t_requests join t_operations using (operation_id) join t_sessions using (session_id) group by state""",
)
def requests_per_state(spark, root):
    trace = star_trace(spark, root)
    joined = views.request_sessions(trace).join(trace.sessions.select("session_id", "state"), "session_id")
    return joined.groupBy("state").agg(F.count(F.lit(1)).alias("requests"), F.sum("request_bytes").alias("bytes"))


@query(
    "J02_left_final_attempt_status",
    """select coalesce(attempt_status, 'none') as status, cast(count(*) as bigint) as requests,
              cast(count(attempt_id) as bigint) as with_attempt from v_final group by 1""",
)
def left_final_attempt(spark, root):
    facts = views.request_usage(star_trace(spark, root))
    return facts.groupBy(F.coalesce("attempt_status", F.lit("none")).alias("status")).agg(
        F.count(F.lit(1)).alias("requests"), F.count("attempt_id").alias("with_attempt")
    )


_TOOLS = """select l.session_id, b.kind, case when not tool_name_truncated and tool_name is not null
  then 'name:' || tool_name when tool_name_truncated and tool_name_hash is not null
  then 'hash:' || tool_name_hash end as tool from v_latest l join t_blocks b on b.snapshot_id = l.snapshot_id
  where b.kind in ('tool_definition', 'tool_call')"""


@query(
    "J03_unused_tools",
    """select distinct d.session_id, d.tool from tools d
       left join (select distinct session_id, tool from tools where kind = 'tool_call') u
         on u.session_id = d.session_id and u.tool = d.tool
       where d.kind = 'tool_definition' and d.tool is not null and u.tool is null""",
    tools=_TOOLS,
)
def unused_tools(spark, root):
    return quality.unused_tools(star_trace(spark, root))


@query(
    "J04_requests_of_observed_sessions",
    """select model, cast(count(*) as bigint) as requests from t_requests join t_operations using (operation_id)
       where session_id in (select session_id from v_latest) group by model""",
)
def observed_requests(spark, root):
    trace = star_trace(spark, root)
    observed = views.latest_snapshots(trace.snapshots).select("session_id")
    rows = views.request_sessions(trace).join(observed, "session_id", "left_semi")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "J05_context_of_latest_snapshot",
    """select r.request_id, (select cast(sum(b.estimated_tokens) as bigint) from v_latest l join t_blocks b
         on b.snapshot_id = l.snapshot_id where l.provider_request_id = r.request_id) as estimated_context
       from t_requests r""",
)
def context_of_latest(spark, root):
    trace = star_trace(spark, root)
    context = views.request_context(trace).select("request_id", "estimated_context")
    return trace.requests.select("request_id").join(context, "request_id", "left")


@query(
    "J06_last_context_per_session",
    """select session_id, arg_max(coalesce(cast(estimated_context as varchar), 'none'), request_id) as last_context
       from (select o.session_id, r.request_id, c.estimated_context from t_requests r
             join t_operations o using (operation_id)
             left join ctx c on c.request_id = r.request_id) group by session_id""",
    ctx="""select l.provider_request_id as request_id, sum(b.estimated_tokens) as estimated_context
           from v_latest l join t_blocks b on b.snapshot_id = l.snapshot_id group by 1""",
)
def last_context(spark, root):
    trace = star_trace(spark, root)
    rows = views.request_sessions(trace).join(views.request_context(trace), "request_id", "left")
    value = F.coalesce(F.col("estimated_context").cast("string"), F.lit("none"))
    return rows.groupBy("session_id").agg(F.max_by(value, F.col("request_id")).alias("last_context"))


@query(
    "J15_one_row_counts",
    """select (select count(*) from t_sessions) as sessions, (select count(*) from t_requests) as requests,
              (select count(*) from v_latest) as analyzed, (select count(*) from t_blocks) as blocks""",
)
def one_row_counts(spark, root):
    trace = star_trace(spark, root)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        count(trace.sessions, "sessions").crossJoin(count(trace.requests, "requests"))
        .crossJoin(count(views.latest_snapshots(trace.snapshots), "analyzed"))
        .crossJoin(count(trace.blocks, "blocks"))
    )


# --- sessions ------------------------------------------------------------------------------------

_REQUEST_DATA = """select f.session_id, f.request_id, r.model, r.transport, r.request_kind, f.duration_us,
    u.input_total, u.input_cached, u.input_uncached, u.output_total, u.output_reasoning,
    c.estimated_context, m.semantic_coverage_bp, d.repeated_tokens, f.attempt_status, r.observation_status
  from v_final f join t_requests r using (request_id) left join t_usage u on u.attempt_id = f.attempt_id
  left join v_latest l on l.provider_request_id = f.request_id
  left join (select snapshot_id, sum(estimated_tokens) as estimated_context from t_blocks group by 1) c
    on c.snapshot_id = l.snapshot_id
  left join t_metrics m on m.snapshot_id = l.snapshot_id
  left join t_deltas d on d.current_snapshot_id = l.snapshot_id"""
_GATED = "case when count(rd.{0}) = count(rd.request_id) and count(rd.request_id) > 0 then cast(sum(rd.{0}) as bigint) end"
_ROLLUP = f"""select s.session_id, s.started_at, s.ended_at, s.state, cast(count(rd.request_id) as bigint) as request_count,
    max(rd.model) as model, max(rd.transport) as transport,
    coalesce(bool_or(rd.request_kind like 'compaction%'), false) as has_compaction,
    {_GATED.format('input_total')} as input_tokens, {_GATED.format('input_cached')} as cached_tokens,
    coalesce({_GATED.format('input_uncached')}, case when {_GATED.format('input_total')} >= {_GATED.format('input_cached')}
      then {_GATED.format('input_total')} - {_GATED.format('input_cached')} end) as uncached_tokens,
    {_GATED.format('output_total')} as output_tokens, {_GATED.format('output_reasoning')} as reasoning_tokens,
    case when {_GATED.format('input_total')} > 0
      then cast({_GATED.format('input_cached')} as double) / {_GATED.format('input_total')} end as cache_ratio,
    (select cast(x.estimated_context as bigint) from rd x where x.session_id = s.session_id
       order by x.request_id desc limit 1) as estimated_context_tokens,
    case when sum(rd.estimated_context) > 0
      then cast(sum(rd.repeated_tokens) as double) / sum(rd.estimated_context) end as repetition,
    case when count(rd.semantic_coverage_bp) > 0 then avg(rd.semantic_coverage_bp) / 10000.0 end as semantic_coverage,
    epoch_us(s.ended_at) - epoch_us(s.started_at) as duration_us
  from t_sessions s left join rd on rd.session_id = s.session_id
  group by s.session_id, s.started_at, s.ended_at, s.state"""
_SESSION_OUT = """session_id, epoch_us(started_at) as started_us, state, request_count, model, transport, has_compaction,
  input_tokens, cached_tokens, uncached_tokens, output_tokens, reasoning_tokens, round(cache_ratio, 9) as cache_ratio,
  estimated_context_tokens, round(repetition, 9) as repetition, round(semantic_coverage, 9) as semantic_coverage,
  duration_us"""


def session_columns(df):
    df = rounded(df, "cache_ratio", "repetition", "semantic_coverage")
    return df.withColumn("started_us", F.unix_micros("started_at")).drop("started_at", "ended_at")


@query("D05_session_rollup", f"select {_SESSION_OUT} from rolled", rd=_REQUEST_DATA, rolled=_ROLLUP)
def session_rollup(spark, root):
    return session_columns(sessions.session_rollup(star_trace(spark, root)))


_SORTED = {
    "created_at": ("started_at", "desc nulls last"), "request_count": ("request_count", "desc nulls last"),
    "input_tokens": ("input_tokens", "desc nulls last"), "cache_ratio": ("cache_ratio", "desc nulls last"),
    "estimated_context_tokens": ("estimated_context_tokens", "desc nulls last"),
    "repetition": ("repetition", "desc nulls last"),
}


def _page_sql(column, direction, limit, offset, where="true"):
    return f"""select {_SESSION_OUT}, case when (select count(*) from (select 1 from rolled where {where}
        limit {limit + 1} offset {offset})) > {limit} then cast({limit + offset} as bigint) end as next_offset
      from (select * from rolled where {where} order by {column} {direction}, session_id desc
            limit {limit} offset {offset})"""


def _register_page(name, sort, direction, limit, offset, filters, where):
    column = sessions.SESSION_SORTS[sort]
    order = "desc nulls last" if direction == "desc" else "asc nulls first"

    @query(name, _page_sql(column, order, limit, offset, where), rd=_REQUEST_DATA, rolled=_ROLLUP)
    def run(spark, root):
        return session_columns(
            sessions.sessions_page(star_trace(spark, root), filters, sort, direction, limit, offset)
        )


_register_page("L01_sessions_by_cache_ratio", "cache_ratio", "desc", 20, 5, sessions.SessionFilter(), "true")
_register_page(
    "P05_sessions_sorted_ascending", "estimated_context_tokens", "asc", 25, 10, sessions.SessionFilter(), "true"
)
_register_page(
    "P03_sessions_filtered", "request_count", "desc", 50, 0,
    sessions.SessionFilter(state="closed", has_compaction=True, started_from="2024-01-01 02:00:00"),
    "state = 'closed' and has_compaction and started_at >= timestamp '2024-01-01 02:00:00'",
)

_REQUEST_ROWS = """select session_id, request_id,
    row_number() over (partition by session_id order by request_id) as ordinal, request_kind as kind, model,
    coalesce(attempt_status, observation_status, 'unknown') as status, input_total as input_tokens,
    input_cached as cached_input_tokens,
    coalesce(input_uncached, case when input_total >= input_cached then input_total - input_cached end)
      as uncached_input_tokens, round(cast(input_cached as double) / nullif(input_total, 0), 9) as cache_ratio,
    output_total as output_tokens, output_reasoning as reasoning_tokens,
    cast(estimated_context as bigint) as estimated_context_tokens,
    round(semantic_coverage_bp / 10000.0, 9) as semantic_coverage, duration_us from rd"""


@query("L02_session_requests", "select * from listed", rd=_REQUEST_DATA, listed=_REQUEST_ROWS)
def session_requests(spark, root):
    return rounded(sessions.session_requests(star_trace(spark, root)), "cache_ratio", "semantic_coverage")


@query(
    "W08_context_growth",
    """select session_id, ordinal, input_tokens, cached_input_tokens, uncached_input_tokens, estimated_context_tokens
       from listed""",
    rd=_REQUEST_DATA, listed=_REQUEST_ROWS,
)
def context_growth(spark, root):
    return sessions.context_growth(star_trace(spark, root))


@query(
    "W03_request_ordinal",
    """select request_id, session_id, row_number() over (partition by session_id order by request_id) as ordinal
       from t_requests join t_operations using (operation_id)""",
)
def request_ordinal(spark, root):
    return views.request_ordinals(star_trace(spark, root)).select("request_id", "session_id", "ordinal")


@query(
    "Q01_session_detail",
    """select r.session_id, r.request_count, r.input_tokens, e.reasoning_effort,
         g.points, g.last_input, g.sum_estimated
       from rolled r
       left join (select session_id, arg_max(reasoning_effort, request_id) as reasoning_effort
                  from t_requests join t_operations using (operation_id)
                  where reasoning_effort is not null group by 1) e on e.session_id = r.session_id
       left join (select session_id, cast(count(*) as bigint) as points,
                         arg_max(coalesce(input_tokens, -1), ordinal) as last_input,
                         cast(sum(estimated_context_tokens) as bigint) as sum_estimated
                  from listed where ordinal <= 100 group by 1) g on g.session_id = r.session_id""",
    rd=_REQUEST_DATA, rolled=_ROLLUP, listed=_REQUEST_ROWS,
)
def session_detail(spark, root):
    detail = sessions.session_detail(star_trace(spark, root))
    return detail.select(
        "session_id", "request_count", "input_tokens", "reasoning_effort",
        F.when(F.col("context_growth").isNotNull(), F.size("context_growth").cast("bigint")).alias("points"),
        F.coalesce(F.element_at("context_growth", -1)["input_tokens"],
                   F.when(F.col("context_growth").isNotNull(), F.lit(-1))).alias("last_input"),
        F.expr(
            "aggregate(filter(transform(context_growth, x -> x.estimated_context_tokens), x -> x is not null),"
            " cast(null as bigint), (a, x) -> coalesce(a, 0) + x)"
        ).alias("sum_estimated"),
    )


@query(
    "L03_session_context_blocks",
    """select n.session_id, c.snapshot_id, n.logical_context_status as visibility, block_id, ordinal, kind, role, origin,
         detected_kind, raw_bytes, estimated_tokens,
         case when exact_fp is not null then exact_count > 1 end as exact_repeated,
         case when semantic_fp is not null then semantic_count > 1 end as semantic_repeated, persistence,
         substr(exact_fp, 1, 10) || '…' as fingerprint_short
       from v_counted c join (select * from t_snapshots qualify row_number() over (partition by session_id
         order by provider_request_id desc, analysis_version desc) = 1) n on n.snapshot_id = c.snapshot_id""",
)
def session_context_blocks(spark, root):
    return sessions.session_context_blocks(star_trace(spark, root))


@query(
    "P15_short_fingerprint",
    """select coalesce(substr(exact_fp, 1, 10) || '…', 'none') as shown, cast(count(*) as bigint) as blocks
       from t_blocks group by 1""",
)
def short_fingerprint(spark, root):
    shown = F.coalesce(views.short_fingerprint("exact_fp"), F.lit("none")).alias("shown")
    return star_trace(spark, root).blocks.groupBy(shown).agg(F.count(F.lit(1)).alias("blocks"))


@query(
    "L05_largest_blocks",
    """select snapshot_id, row_number() over w as rank, block_id, ordinal, kind, raw_bytes, estimated_tokens
       from t_blocks where snapshot_id in (select snapshot_id from v_latest)
       window w as (partition by snapshot_id order by raw_bytes desc, ordinal, block_id)
       qualify row_number() over w <= 3""",
)
def largest_blocks(spark, root):
    return sessions.largest_blocks(star_trace(spark, root), 3)


@query("L07_first_sessions", "select session_id, state from t_sessions order by started_at, session_id limit 12")
def first_sessions(spark, root):
    return sessions.first_sessions(star_trace(spark, root), 12).select("session_id", "state")


@query(
    "D49_inspection",
    """select l.snapshot_id, l.session_id, l.provider_request_id, l.analysis_version, l.status, l.logical_context_status,
         r.model, r.transport, r.request_kind, f.attempt_status,
         coalesce(m.provider_input_tokens, u.input_total) as provider_tokens, m.visible_estimated_tokens,
         m.semantic_coverage_bp, d.repeated_blocks, d.new_blocks, d.changed_blocks, d.removed_blocks, d.repeated_tokens,
         m.tool_count, m.stable_prefix_estimate
       from v_latest l join t_requests r on r.request_id = l.provider_request_id
       join v_final f on f.request_id = r.request_id left join t_usage u on u.attempt_id = f.attempt_id
       left join t_metrics m on m.snapshot_id = l.snapshot_id
       left join t_deltas d on d.current_snapshot_id = l.snapshot_id""",
)
def inspection(spark, root):
    return sessions.inspection(star_trace(spark, root))


@query(
    "F08_session_duration",
    "select session_id, epoch_us(ended_at) - epoch_us(started_at) as duration_us from t_sessions",
)
def session_duration(spark, root):
    return star_trace(spark, root).sessions.select(
        "session_id", (F.unix_micros("ended_at") - F.unix_micros("started_at")).alias("duration_us")
    )


# --- composition -----------------------------------------------------------------------------------


def _composition_sql(column):
    return f"""select coalesce({column}, 'unavailable') as name, cast(count(*) as bigint) as block_count,
        cast(sum(raw_bytes) as bigint) as raw_bytes, cast(sum(estimated_tokens) as bigint) as estimated_tokens,
        round(cast(sum(estimated_tokens) as double) / (select sum(estimated_tokens) from t_blocks), 9)
          as estimated_token_share,
        cast(sum(case when exact_fp is not null and exact_count > 1 then estimated_tokens end) as bigint)
          as exact_repeated_tokens,
        cast(sum(case when semantic_fp is not null and semantic_count > 1 then estimated_tokens end) as bigint)
          as semantic_repeated_tokens,
        round(avg(cast(persistence as double)), 6) as persistence,
        round((select cast(count(estimated_tokens) as double) / count(*) from t_blocks), 9) as estimator_coverage
      from v_counted group by 1"""


def _register_composition(name, group):
    @query(name, _composition_sql(group))
    def run(spark, root):
        out = rounded(
            comp.composition(star_trace(spark, root).blocks, group), "estimated_token_share", "estimator_coverage"
        )
        return rounded(out, "persistence", digits=6)


_register_composition("D08_composition_detected_kind", "detected_kind")
_register_composition("P04_composition_origin", "origin")
_register_composition("P04_composition_kind", "kind")
_register_composition("P06_composition_role_unavailable", "role")


@query(
    "D09_snapshot_composition",
    """select snapshot_id, coalesce(detected_kind, 'unavailable') as name, cast(count(*) as bigint) as block_count,
         cast(sum(raw_bytes) as bigint) as raw_bytes, cast(sum(estimated_tokens) as bigint) as estimated_tokens,
         round(cast(sum(estimated_tokens) as double) / nullif(sum(sum(estimated_tokens)) over (partition by snapshot_id), 0), 9)
           as estimated_token_share,
         round(cast(sum(count(estimated_tokens)) over (partition by snapshot_id) as double)
           / sum(count(*)) over (partition by snapshot_id), 9) as estimator_coverage
       from t_blocks group by 1, 2""",
)
def snapshot_composition(spark, root):
    return rounded(
        comp.snapshot_composition(star_trace(spark, root).blocks), "estimated_token_share", "estimator_coverage"
    )


@query(
    "D10_origin_matrix",
    """select origin, coalesce(detected_kind, 'unavailable') as detected_kind, cast(count(*) as bigint) as block_count,
         cast(sum(raw_bytes) as bigint) as raw_bytes, cast(sum(estimated_tokens) as bigint) as estimated_tokens,
         round(cast(sum(estimated_tokens) as double) / (select sum(estimated_tokens) from t_blocks), 9)
           as estimated_token_share
       from t_blocks group by 1, 2""",
)
def origin_matrix(spark, root):
    return rounded(comp.origin_matrix(star_trace(spark, root).blocks), "estimated_token_share")


@query(
    "D11_unknown_summary",
    """select cast(count(*) as bigint) as blocks, cast(sum(estimated_tokens) as bigint) as estimated_tokens,
         round(cast(count(estimated_tokens) as double) / nullif(count(*), 0), 9) as estimator_coverage,
         cast(sum(raw_bytes) as bigint) as raw_bytes,
         count(distinct exact_fp) as unique_exact_fingerprints, count(distinct semantic_fp) as unique_semantic_fingerprints,
         (select raw_bytes from u order by raw_bytes limit 1 offset (select cast(floor((count(*) - 1) * 0.5::double) as bigint) from u)) as p50,
         (select raw_bytes from u order by raw_bytes limit 1 offset (select cast(floor((count(*) - 1) * 0.9::double) as bigint) from u)) as p90,
         (select raw_bytes from u order by raw_bytes limit 1 offset (select cast(floor((count(*) - 1) * 0.99::double) as bigint) from u)) as p99,
         round((select avg(cast(f as double)) from (select count(*) over (partition by coalesce(semantic_fp, exact_fp)) as f
            from u)), 6) as persistence
       from u""",
    u="select * from t_blocks where coalesce(detected_kind, 'unknown') = 'unknown'",
)
def unknown_summary(spark, root):
    out = comp.unknown_summary(star_trace(spark, root).blocks)
    return rounded(rounded(out, "estimator_coverage"), "persistence", digits=6)


@query(
    "D06_repetition_summary",
    """select cast(sum(estimated_tokens) as bigint) as total_tokens,
         cast(sum(case when exact_fp is not null and ec > 1 then estimated_tokens else 0 end) as bigint) as exact_repeated_tokens,
         cast(sum(case when semantic_fp is not null and sc > 1 then estimated_tokens else 0 end) as bigint)
           as semantic_repeated_tokens,
         round(cast(sum(case when exact_fp is not null and ec > 1 then estimated_tokens else 0 end) as double)
           / sum(estimated_tokens), 9) as exact_token_share,
         round(cast(sum(case when semantic_fp is not null and sc > 1 then estimated_tokens else 0 end) as double)
           / sum(estimated_tokens), 9) as semantic_token_share
       from (select *, count(*) over (partition by exact_fp) as ec, count(*) over (partition by semantic_fp) as sc
             from t_blocks where estimated_tokens is not null)""",
)
def repetition_summary(spark, root):
    return rounded(
        comp.repetition_summary(star_trace(spark, root).blocks), "exact_token_share", "semantic_token_share"
    )


@query(
    "W01_fingerprint_counts",
    "select block_id, exact_count, semantic_count from v_counted",
)
def fingerprint_counts(spark, root):
    return views.counted_blocks(star_trace(spark, root).blocks).select("block_id", "exact_count", "semantic_count")


@query("W02_persistence_counts", "select block_id, persistence from v_counted")
def persistence_counts(spark, root):
    return views.counted_blocks(star_trace(spark, root).blocks).select("block_id", "persistence")


@query("W04_snapshot_order", "select snapshot_id, session_id, snapshot_order from v_ordered")
def snapshot_order(spark, root):
    return views.number_snapshots(snapshots(spark, root)).select(
        "snapshot_id", "session_id", "snapshot_order"
    )


_UNKNOWN = "coalesce(nullif({0}, ''), 'unknown')"


@query(
    "D17_subtotal_by_role",
    f"""select {_UNKNOWN.format('role')} as name, cast(count(*) as bigint) as block_count,
         cast(coalesce(sum(raw_bytes), 0) as bigint) as bytes,
         cast(coalesce(sum(estimated_tokens), 0) as bigint) as estimated_tokens,
         round(coalesce(sum(estimated_tokens), 0)::double / (select sum(estimated_tokens) from t_blocks), 9) as token_share,
         round(coalesce(sum(raw_bytes), 0)::double / (select sum(raw_bytes) from t_blocks), 9) as bytes_share
       from t_blocks group by 1""",
)
def subtotal_by_role(spark, root):
    return rounded(comp.subtotal_by(star_trace(spark, root).blocks, "role"), "token_share", "bytes_share")


@query(
    "D18_estimation_coverage",
    f"""select {_UNKNOWN.format('detected_kind')} as name, cast(count(*) as bigint) as block_count,
         cast(count(estimated_tokens) as bigint) as estimated_block_count, cast(sum(raw_bytes) as bigint) as raw_bytes,
         cast(coalesce(sum(raw_bytes) filter (estimated_tokens is not null), 0) as bigint) as estimated_raw_bytes,
         cast(coalesce(sum(estimated_tokens), 0) as bigint) as estimated_tokens,
         round(count(estimated_tokens)::double / count(*), 9) as block_coverage,
         round(coalesce(sum(raw_bytes) filter (estimated_tokens is not null), 0)::double / sum(raw_bytes), 9) as bytes_coverage,
         round(coalesce(sum(estimated_tokens), 0)::double / (select sum(estimated_tokens) from t_blocks), 9)
           as estimated_token_share
       from t_blocks group by 1""",
)
def estimation_coverage(spark, root):
    return rounded(
        comp.estimation_coverage(star_trace(spark, root).blocks, "detected_kind"),
        "block_coverage", "bytes_coverage", "estimated_token_share",
    )


@query(
    "D19_cross_tab",
    f"""select *, 'origin=' || origin || ' | kind=' || kind || ' | detected_kind=' || detected_kind as name from (
         select {_UNKNOWN.format('origin')} as origin, {_UNKNOWN.format('kind')} as kind,
           {_UNKNOWN.format('detected_kind')} as detected_kind, cast(count(*) as bigint) as block_count,
           cast(sum(raw_bytes) as bigint) as raw_bytes, cast(coalesce(sum(estimated_tokens), 0) as bigint) as estimated_tokens,
           round(coalesce(sum(estimated_tokens), 0)::double / (select sum(estimated_tokens) from t_blocks), 9) as token_share,
           round(sum(raw_bytes)::double / (select sum(raw_bytes) from t_blocks), 9) as bytes_share
         from t_blocks group by 1, 2, 3)""",
)
def cross_tab(spark, root):
    return rounded(
        comp.cross_tab(star_trace(spark, root).blocks, ["origin", "kind", "detected_kind"]), "token_share", "bytes_share"
    )


_LABELLED = """select b.*, s.session_id, coalesce(nullif(w.workload, ''), 'unknown') as workload,
    coalesce(nullif(b.detected_kind, ''), 'unknown') as detected
  from t_blocks b join t_snapshots s on s.snapshot_id = b.snapshot_id left join t_workloads w on w.session_id = s.session_id"""


@query(
    "D20_workload_composition",
    """select c.workload, c.detected as name, c.block_count, c.raw_bytes, c.estimated_tokens,
         round(c.estimated_tokens::double / w.t, 9) as token_share, round(c.raw_bytes::double / w.b, 9) as bytes_share,
         w.session_count, round(w.session_count::double / (select count(distinct session_id) from t_snapshots), 9) as session_share,
         round(w.t::double / (select sum(estimated_tokens) from lab), 9) as workload_token_share,
         round(w.b::double / (select sum(raw_bytes) from lab), 9) as workload_bytes_share
       from (select workload, detected, cast(count(*) as bigint) as block_count, cast(sum(raw_bytes) as bigint) as raw_bytes,
                    cast(coalesce(sum(estimated_tokens), 0) as bigint) as estimated_tokens from lab group by 1, 2) c
       join (select workload, cast(count(distinct session_id) as bigint) as session_count,
                    sum(estimated_tokens) as t, sum(raw_bytes) as b from lab group by 1) w on w.workload = c.workload""",
    lab=_LABELLED,
)
def workload_composition(spark, root):
    return rounded(
        comp.workload_composition(star_trace(spark, root)), "token_share", "bytes_share", "session_share",
        "workload_token_share", "workload_bytes_share",
    )


@query(
    "D20_session_weighted_composition",
    """select k.detected as name, cast((select count(*) from st where total > 0) as bigint) as sessions_with_estimates,
         round(avg(coalesce(c.tokens, 0)::double / s.total), 9) as mean_session_token_share
       from (select distinct detected from cells) k cross join (select * from st where total > 0) s
       left join cells c on c.session_id = s.session_id and c.detected = k.detected group by 1""",
    lab=_LABELLED,
    cells="""select session_id, detected, sum(estimated_tokens) as tokens from lab
             where estimated_tokens is not null group by 1, 2""",
    st="select session_id, sum(tokens) as total from cells group by 1",
)
def session_weighted(spark, root):
    return rounded(comp.session_weighted_composition(star_trace(spark, root)), "mean_session_token_share")


_DIST = """cast(count({0}) as bigint) as count, round(quantile_cont({0}, 0.5), 6) as p50, round(quantile_cont({0}, 0.75), 6) as p75,
  round(quantile_cont({0}, 0.9), 6) as p90, round(quantile_cont({0}, 0.95), 6) as p95, round(quantile_cont({0}, 0.99), 6) as p99,
  cast(max({0}) as double) as max"""
PERCENTILES = ("p50", "p75", "p90", "p95", "p99")


@query("D22_kind_distribution", f"select kind as name, {_DIST.format('raw_bytes')} from t_blocks group by 1")
def kind_distribution(spark, root):
    return rounded(comp.kind_distribution(star_trace(spark, root).blocks, "raw_bytes"), *PERCENTILES, digits=6)


@query("D21_token_distribution", f"select {_DIST.format('estimated_tokens')} from t_blocks")
def token_distribution(spark, root):
    from ..functions.ranking import distribution

    return rounded(distribution(star_trace(spark, root).blocks, [], "estimated_tokens"), *PERCENTILES, digits=6)


@query(
    "D33_unknown_report",
    """select cast(count(*) as bigint) as block_count, cast(coalesce(sum(estimated_tokens), 0) as bigint) as estimated_tokens,
         cast(sum(raw_bytes) as bigint) as raw_bytes,
         round(sum(estimated_tokens)::double / (select sum(estimated_tokens) from t_blocks), 9) as token_share,
         round(quantile_cont(raw_bytes, 0.5), 6) as bytes_p50, round(quantile_cont(raw_bytes, 0.99), 6) as bytes_p99,
         round(quantile_cont(estimated_tokens, 0.9), 6) as tokens_p90, cast(max(estimated_tokens) as double) as tokens_max,
         (select count(*) from ef) as exact_unique, (select max(n) from ef) as exact_max_frequency,
         (select count(*) from sfq) as semantic_unique, (select max(n) from sfq) as semantic_max_frequency,
         round((select avg(n) from sfq), 9) as semantic_average_frequency
       from u""",
    u="""select b.*, s.session_id from t_blocks b join t_snapshots s using (snapshot_id)
         where coalesce(detected_kind, 'unknown') = 'unknown'""",
    ef="select count(*) as n from u where exact_fp is not null group by session_id, exact_fp",
    sfq="select count(*) as n from u where semantic_fp is not null group by session_id, semantic_fp",
)
def unknown_report(spark, root):
    out = comp.unknown_report(star_trace(spark, root)).select(
        "block_count", "estimated_tokens", "raw_bytes", "token_share", "bytes_p50", "bytes_p99", "tokens_p90",
        "tokens_max", "exact_unique", "exact_max_frequency", "semantic_unique", "semantic_max_frequency",
        "semantic_average_frequency",
    )
    return rounded(rounded(out, "token_share", "semantic_average_frequency"), "bytes_p50", "bytes_p99", "tokens_p90", digits=6)


# --- quality and tools -------------------------------------------------------------------------------

_QUALITY = """select (select count(*) from t_requests) as requests, count(*) filter (status = 'complete') as complete,
    count(*) filter (status = 'partial') as partial, count(*) filter (status = 'dropped') as dropped,
    count(*) filter (logical_context_status = 'malformed') as malformed,
    count(*) filter (correlation_status = 'correlated') as correlated,
    sum(semantic_coverage_bp) as bp, count(semantic_coverage_bp) as nbp
  from v_latest left join t_metrics using (snapshot_id)"""
_QUALITY_OUT = """complete, partial, dropped, malformed,
    case when requests > complete or dropped > 0 or malformed > 0 then 'degraded' else 'healthy' end as quality_status,
    round(complete::double / nullif(requests, 0), 9) as analysis_coverage,
    round(correlated::double / nullif(complete + partial, 0), 9) as correlation_coverage,
    round(bp / (nbp * 10000.0), 9) as semantic_coverage,
    concat_ws('; ', case when requests > complete then (requests - complete)::varchar || ' requests missing complete context analysis' end,
      case when dropped > 0 then dropped::varchar || ' context analyses dropped' end,
      case when malformed > 0 then malformed::varchar || ' malformed context observations' end) as reasons"""


@query("D07_measurement_quality", f"select requests, {_QUALITY_OUT} from q", q=_QUALITY)
def measurement_quality(spark, root):
    out = quality.measurement_quality(star_trace(spark, root)).withColumn("reasons", F.array_join("reasons", "; "))
    return rounded(out, "analysis_coverage", "correlation_coverage", "semantic_coverage")


@query(
    "D04_overview",
    f"""select (select count(*) from t_sessions) as session_count, n as request_count, i as input_tokens,
         c as cached_input_tokens, o as output_tokens, rep.total_tokens, {_QUALITY_OUT}
       from q, agg, (select cast(sum(estimated_tokens) as bigint) as total_tokens from t_blocks) rep""",
    q=_QUALITY, agg=_USAGE.format(key="", source="v_final", group=""),
)
def overview(spark, root):
    out = quality.overview(star_trace(spark, root)).withColumn("reasons", F.array_join("reasons", "; "))
    out = rounded(out, "analysis_coverage", "correlation_coverage", "semantic_coverage")
    return out.select(
        "session_count", "request_count", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens",
        "complete", "partial", "dropped", "malformed", "quality_status", "analysis_coverage", "correlation_coverage",
        "semantic_coverage", "reasons",
    )


_OBSERVED = """m.tool_count is not null and m.schema_bytes is not null and m.estimated_schema_tokens is not null
  and m.repeated_schema_tokens is not null"""
_TOOL_SURFACE = f"""select n.n as requests_observed, n.obs as schema_observations,
         least(10000, n.obs * 10000 // n.n) as schema_coverage_bp, n.tc as tool_definitions_exposed, n.sb as schema_bytes,
         n.st as estimated_schema_tokens, n.rt as repeated_schema_tokens,
         least(10000, n.rt * 10000 // nullif(n.st, 0)) as repeated_schema_share_bp, t.calls as tool_calls,
         ok.ok as identity_coverage_complete, case when ok.ok then t.d end as distinct_defined_tools,
         case when ok.ok then t.u end as distinct_used_tools, case when ok.ok then t.x end as unused_tools_lower_bound
       from n, t, (select n.n > 0 and t.defs > 0 and n.n = n.full and n.n = (select count(*) from t_requests
            join t_operations using (operation_id) where session_id in (select session_id from v_latest))
            and t.defs = t.named_defs and t.calls = t.named_calls as ok from n, t) ok"""


@query(
    "D12_tool_surface",
    _TOOL_SURFACE,
    tools=_TOOLS,
    n=f"""select count(*) as n, count(*) filter ({_OBSERVED}) as obs,
          cast(sum(m.tool_count) filter ({_OBSERVED}) as bigint) as tc, cast(sum(m.schema_bytes) filter ({_OBSERVED}) as bigint) as sb,
          cast(sum(m.estimated_schema_tokens) filter ({_OBSERVED}) as bigint) as st,
          cast(sum(m.repeated_schema_tokens) filter ({_OBSERVED}) as bigint) as rt,
          count(*) filter (l.status = 'complete' and explicit_request_complete and correlation_status = 'correlated'
            and logical_context_status in ('complete', 'explicit_only')) as "full"
          from v_latest l left join t_metrics m on m.snapshot_id = l.snapshot_id""",
    t="""select count(*) filter (kind = 'tool_definition') as defs, count(tool) filter (kind = 'tool_definition') as named_defs,
          count(*) filter (kind = 'tool_call') as calls, count(tool) filter (kind = 'tool_call') as named_calls,
          (select count(*) from (select distinct session_id, tool from tools where kind = 'tool_definition' and tool is not null)) as d,
          (select count(*) from (select distinct session_id, tool from tools where kind = 'tool_call' and tool is not null)) as u,
          0 as x from tools""",
)
def tool_surface(spark, root):
    return quality.tool_surface(star_trace(spark, root))


@query(
    "P07_tool_identity",
    "select coalesce(tool, 'none') as tool, kind, cast(count(*) as bigint) as blocks from tools group by 1, 2",
    tools=_TOOLS,
)
def tool_identity(spark, root):
    trace = star_trace(spark, root)
    latest = views.latest_snapshots(trace.snapshots).select("snapshot_id")
    rows = trace.blocks.where(F.col("kind").isin("tool_definition", "tool_call")).join(latest, "snapshot_id", "left_semi")
    return rows.groupBy(F.coalesce(views.tool_identity(), F.lit("none")).alias("tool"), "kind").agg(
        F.count(F.lit(1)).alias("blocks")
    )


@query("X05_distinct_tools", "select distinct session_id, tool from tools where tool is not null", tools=_TOOLS)
def distinct_tools(spark, root):
    trace = star_trace(spark, root)
    latest = views.latest_snapshots(trace.snapshots).select("snapshot_id", "session_id")
    rows = trace.blocks.where(F.col("kind").isin("tool_definition", "tool_call")).join(latest, "snapshot_id")
    return rows.select("session_id", views.tool_identity().alias("tool")).where("tool is not null").distinct()


@query(
    "D51_measurement_coverage",
    """select s.status, cast(count(*) as bigint) as snapshots, cast(coalesce(sum(e), 0) as bigint) as eligible_blocks,
         round(sum(t)::double / sum(e), 9) as token_coverage, round(sum(d)::double / sum(e), 9) as detection_coverage,
         round(count(*) filter (correlation_status = 'correlated')::double / count(*), 9) as correlation_coverage
       from t_snapshots s left join (select snapshot_id, count(*) as e, count(estimated_tokens) as t,
         count(*) filter (coalesce(detected_kind, 'unknown') <> 'unknown') as d from t_blocks group by 1) b using (snapshot_id)
       group by 1""",
)
def measurement_coverage(spark, root):
    return rounded(
        quality.measurement_coverage(star_trace(spark, root)), "token_coverage", "detection_coverage", "correlation_coverage"
    )
