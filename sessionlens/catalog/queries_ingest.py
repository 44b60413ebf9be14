"""Ingest, status derivation, usage, event streams and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import ingest
from ..session import new_folder
from ..sources.bindings import dialogue_chunks, raw_requests, read, session_of_event_stream, star_trace, stream_chunks, table_bytes, usage_documents
from ..streaming import eventlog, sse
from .registry import query

_RAW = "select conv_id || '-' || turn as request_id, conv_id, turn, role, text, turn % 5 <> 4 as ok from conversations"


@query(
    "S09_request_metadata",
    """select request_id, case when ok then 'complete' else 'malformed' end as observation_status, case when ok then 'm' || turn % 3 end as model,
         case when ok then true end as stream, case when ok then turn % 2 = 0 end as has_previous_response, case when ok then 7 end as input_item_count,
         case when ok then 2 end as tool_count, case when ok then 1 end as text_input_blocks, case when ok then 1 end as image_input_blocks from raw""",
    raw=_RAW.replace("turn % 5 <> 4 as ok", "turn % 5 <> 4 as ok"),
)
def request_metadata(spark, root):
    out = ingest.request_metadata(raw_requests(spark, root))
    return out.select(
        "request_id",
        F.when(F.col("observation_status") == "malformed", "malformed").otherwise("complete").alias("observation_status"),
        "model", "stream", "has_previous_response", "input_item_count", "tool_count", "text_input_blocks", "image_input_blocks",
    )


_ROLE = "case when role in ('system', 'developer', 'user', 'assistant', 'tool') then role else 'unknown' end"
_ORIGIN = """case when role in ('system', 'developer', 'user') then 'human_authored' when role = 'assistant' then 'agent_generated'
  when role = 'tool' then 'tool_generated' else 'unknown' end"""
_BLOCKS = f"""select request_id, ordinal, kind, case role_ when 'R' then {_ROLE} when '' then null else role_ end as role,
    case origin_ when 'O' then {_ORIGIN} else origin_ end as origin, nullif(call_, '') as tool_call_id, nullif(tool_, '') as tool_name
  from raw, (values (0, 'instructions', 'system', 'human_authored', '', ''), (1, 'message', 'R', 'O', '', ''), (2, 'text', 'R', 'O', '', ''),
    (3, 'image_reference', 'R', 'external_reference', '', ''), (4, 'tool_call', 'tool', 'agent_generated', 'c1', 'search'),
    (5, 'tool_result', 'tool', 'tool_generated', 'c1', ''), (6, 'opaque_reasoning', 'assistant', 'provider_managed', '', ''),
    (7, 'message', 'user', 'human_authored', '', ''), (8, 'text', 'user', 'human_authored', '', ''), (9, 'unknown', '', 'unknown', '', ''),
    (10, 'unknown', '', 'unknown', '', ''), (11, 'tool_definition', '', 'tool_schema', '', 'search'),
    (12, 'tool_definition', '', 'tool_schema', '', 'files'), (13, 'provider_state_reference', '', 'provider_managed', '', ''))
    as b(ordinal, kind, role_, origin_, call_, tool_)
  where ok and (ordinal < 13 or turn % 2 = 0)"""


@query("C01_request_blocks", "select * from blk", raw=_RAW, blk=_BLOCKS)
def request_blocks(spark, root):
    out = ingest.request_blocks(raw_requests(spark, root), "request_id")
    return out.select("request_id", "ordinal", "kind", "role", "origin", "tool_call_id", "tool_name")


@query("C02_block_kinds", "select kind, count(*) as blocks from blk group by 1", raw=_RAW, blk=_BLOCKS)
def block_kinds(spark, root):
    return ingest.request_blocks(raw_requests(spark, root), "request_id").groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"))


@query(
    "C03_role_and_origin",
    f"select role, {_ROLE} as known_role, {_ORIGIN} as origin, count(*) as turns from conversations group by 1",
)
def role_and_origin(spark, root):
    rows = read(spark, root, "conversations")
    return rows.groupBy("role", labels.role_of("role").alias("known_role"), labels.origin_of_role("role").alias("origin")).agg(
        F.count(F.lit(1)).alias("turns")
    )


@query(
    "C04_visibility",
    """select request_id, ok and turn % 2 = 0 as uses_previous_response, false as uses_conversation_state, 0 as item_references,
         case when ok then 1 else 0 end as image_references, case when ok then 1 else 0 end as opaque_items,
         case when ok then 'mixed_partial' else 'unknown' end as logical_context_status from raw""",
    raw=_RAW,
)
def visibility(spark, root):
    raw = raw_requests(spark, root)
    out = ingest.visibility(raw, ingest.request_blocks(raw, "request_id"), "request_id")
    return out.select(
        "request_id", "uses_previous_response", "uses_conversation_state", "item_references", "image_references", "opaque_items",
        "logical_context_status",
    )


@query(
    "F20_logical_context_status",
    """select p or c or i or r or q as managed, f or g as external, k as complete,
         case when (p or c or i or r or q) and (f or g) then 'mixed_partial' when p or c or i or r or q then 'provider_managed_partial'
           when f or g then 'external_references_partial' when k then 'explicit_only' else 'unknown' end as status, count(*) as requests
       from (select o_orderkey % 2 = 0 as p, o_orderkey % 3 = 0 as c, o_orderkey % 5 = 0 as i, o_orderkey % 7 = 0 as r, o_orderkey % 11 = 0 as q,
               o_orderkey % 4 = 1 as f, o_orderkey % 6 = 1 as g, o_orderkey % 8 <> 3 as k from orders) group by 1, 2, 3, 4""",
)
def logical_context(spark, root):
    flag = lambda n, r=0: F.col("o_orderkey") % n == r
    status = labels.context_status(flag(2), flag(3), flag(5), flag(7), flag(11), flag(4, 1), flag(6, 1), F.col("o_orderkey") % 8 != 3)
    managed = flag(2) | flag(3) | flag(5) | flag(7) | flag(11)
    return read(spark, root, "orders").groupBy(
        managed.alias("managed"), (flag(4, 1) | flag(6, 1)).alias("external"), (F.col("o_orderkey") % 8 != 3).alias("complete"),
        status.alias("status"),
    ).agg(F.count(F.lit(1)).alias("requests"))


@query(
    "J09_tool_name_backfill",
    """select request_id, ordinal, kind, case when kind = 'tool_result' then 'search' else tool_name end as tool_name from blk
       where kind in ('tool_call', 'tool_result')""",
    raw=_RAW, blk=_BLOCKS,
)
def tool_name_backfill(spark, root):
    blocks = ingest.request_blocks(raw_requests(spark, root), "request_id")
    return ingest.fill_tool_names(blocks, "request_id").where("kind in ('tool_call', 'tool_result')").select(
        "request_id", "ordinal", "kind", "tool_name"
    )


@query(
    "J10_response_id_resolution",
    """select request_id, case when ok and turn % 2 = 0 then conv_id % 3 = 0 end as resolved_locally from raw""",
    raw=_RAW,
)
def response_id_resolution(spark, root):
    raw = ingest.parsed_requests(raw_requests(spark, root)).withColumn(
        "previous_response_id", F.try_variant_get("doc", "$.previous_response_id", "string")
    )
    seen = read(spark, root, "conversations").where("conv_id % 3 = 0").select(F.concat(F.lit("resp_"), F.col("conv_id").cast("string")).alias("response_id"))
    return ingest.resolve_references(raw, seen).select("request_id", "resolved_locally")


@query(
    "F21_usage_normalisation",
    """select o_orderkey as attempt_id, case o_orderkey % 9 when 3 then 10 when 6 then 10 when 7 then o_orderkey when 8 then o_orderkey end as input_total,
         case when o_orderkey % 9 = 3 then 12 when o_orderkey % 9 > 6 then o_orderkey // 3 end as input_cached,
         case when o_orderkey % 9 > 6 then o_orderkey - o_orderkey // 3 end as input_uncached, case when o_orderkey % 9 > 6 then 2 end as cache_write,
         case o_orderkey % 9 when 2 then 4 when 4 then 2 when 6 then 4 when 7 then 8 when 8 then 8 end as output_total,
         case o_orderkey % 9 when 6 then 9 when 7 then 5 when 8 then 5 end as output_reasoning,
         o_orderkey % 9 in (1, 2, 4) as invalid_number, o_orderkey % 9 = 5 as overflow, o_orderkey % 9 = 3 as cached_exceeds_input,
         o_orderkey % 9 = 6 as reasoning_exceeds_output, o_orderkey % 9 = 6 as inconsistent_total,
         case when o_orderkey % 9 in (0, 1, 5) then 'unavailable' when o_orderkey % 9 > 6 then 'final' else 'partial' end as usage_status from orders""",
)
def usage_normalisation(spark, root):
    out = ingest.normalize_usage(usage_documents(spark, root))
    return out.drop("usage", "total")


@query(
    "F22_response_state",
    """select case o_orderkey % 8 when 0 then 'completed' when 1 then 'cancelled' when 2 then 'cancelled' when 3 then 'failed' when 4 then 'queued'
         when 5 then 'in_progress' when 6 then 'incomplete' else 'unknown' end as state,
         case when o_orderkey % 8 in (4, 5, 7) then 'partial' else 'final' end as usage_status, count(*) as responses from orders group by 1, 2""",
)
def response_state(spark, root):
    status = F.expr(
        "case o_orderkey % 8 when 0 then 'completed' when 1 then 'cancelled' when 2 then 'canceled' when 3 then 'failed' when 4 then 'queued'"
        " when 5 then 'in_progress' when 6 then 'incomplete' else 'paused' end"
    )
    state = ingest.response_state(status)
    return read(spark, root, "orders").groupBy(state.alias("state"), ingest.settle_usage(F.lit("final"), state).alias("usage_status")).agg(
        F.count(F.lit(1)).alias("responses")
    )


_OBS = """select o_orderkey as attempt_id, case when o_orderkey % 6 = 0 then 'compaction_v2' else 'turn' end as request_kind,
    case when o_orderkey % 29 = 0 then 'reset' end as transport_error, case when o_orderkey % 13 = 0 then 500 when o_orderkey % 5 = 0 then null else 200 end as status_code,
    case o_orderkey % 7 when 0 then 'completed' when 1 then 'incomplete' when 2 then 'cancelled' when 3 then 'disconnected' when 4 then 'failed'
      else 'in_progress' end as outcome, o_orderkey % 2 = 0 as ended,
    case o_orderkey % 4 when 0 then 'completed' when 1 then 'in_progress' when 2 then 'disconnected' end as response_state,
    case when o_orderkey % 4 < 3 then case when o_orderkey % 17 = 0 then 'cancelled' when o_orderkey % 3 = 0 then 'partial' else 'complete' end end as response_status,
    case when o_orderkey % 31 = 0 then 'overloaded' end as error_code, case when o_orderkey % 10 = 0 then 'partial' else 'complete' end as request_status,
    case o_orderkey % 3 when 0 then 'final' when 1 then 'unavailable' end as usage_status, o_orderpriority as model from orders"""
_STATUS = """case when request_kind = 'compaction_v2' then case when transport_error is not null or coalesce(status_code, 200) <> 200 or outcome = 'failed' then 'errored'
      when outcome in ('completed', 'incomplete', 'cancelled', 'disconnected') then outcome when ended then 'incomplete' else 'started' end
    when transport_error is not null then 'errored'
    when response_state is null then case when coalesce(status_code, 200) <> 200 or outcome = 'failed' then 'errored'
      when outcome in ('completed', 'incomplete') then 'incomplete' when outcome in ('cancelled', 'disconnected') then outcome
      when ended then 'incomplete' else 'started' end
    when coalesce(response_status, '') = 'cancelled' or response_state = 'cancelled' or outcome = 'cancelled' then 'cancelled'
    when coalesce(status_code, 200) <> 200 or outcome = 'failed' or error_code is not null or response_state = 'failed' then 'errored'
    when response_state = 'completed' then 'completed' when response_state = 'disconnected' or outcome = 'disconnected' then 'disconnected'
    else 'incomplete' end"""


def observations(spark, root):
    sql = _OBS.replace("from orders", "from {orders}")
    return spark.sql(sql, orders=read(spark, root, "orders"))


def with_status(df):
    return df.withColumn(
        "status",
        labels.attempt_status("request_kind", "transport_error", "status_code", "outcome", "ended", "response_state", "response_status", "error_code"),
    )


@query("P10_attempt_status", f"select attempt_id, {_STATUS} as status from obs", obs=_OBS)
def attempt_status(spark, root):
    return with_status(observations(spark, root)).select("attempt_id", "status")


@query(
    "P11_terminal_status",
    f"""select status, case when status <> 'started' then status end as operation_status, case status when 'completed' then 'provider.response.completed'
         when 'errored' then 'provider.response.failed' when 'started' then null else 'provider.response.incomplete' end as terminal_event, count(*) as attempts
       from (select {_STATUS} as status from obs) group by 1""",
    obs=_OBS,
)
def terminal_status(spark, root):
    return with_status(observations(spark, root)).groupBy(
        "status", labels.operation_status("status").alias("operation_status"), labels.terminal_event("status").alias("terminal_event")
    ).agg(F.count(F.lit(1)).alias("attempts"))


@query(
    "P12_canonical_events",
    f"""select attempt_id, event_type, row_number() over (partition by attempt_id order by n) - 1 as position from (
         select attempt_id, unnest([1, 2, 3, 4, 5, 6]) as n, unnest(['provider.request.observed',
           case when status_code is not null or response_state is not null then 'provider.response.started' end,
           case status when 'completed' then 'provider.response.completed' when 'errored' then 'provider.response.failed' when 'started' then null
             else 'provider.response.incomplete' end,
           case when response_state is not null and usage_status is not null then 'provider.usage.observed' end,
           case when response_state is not null and usage_status = 'final' then 'provider.usage.normalized' end,
           case when request_status <> 'complete' or coalesce(response_status, 'complete') <> 'complete' then 'provider.observation.partial' end]) as event_type
         from (select *, {_STATUS} as status from obs)) where event_type is not null""",
    obs=_OBS,
)
def canonical_events(spark, root):
    rows = with_status(observations(spark, root)).withColumns({
        "request_bytes": F.lit(0), "ttfb_us": F.lit(0), "duration_us": F.lit(0), "input_total": F.lit(0), "output_total": F.lit(0)
    })
    out = ingest.canonical_events(rows)
    return out.select("attempt_id", "event_type", F.col("position").cast("bigint").alias("position"))


# --- streams --------------------------------------------------------------------------------------------------

_TERM = "o_orderkey % 5 in (0, 1, 2, 4)"


# Every event of every attempt, by name and data; comments and the ends of lines leave no trace.
@query(
    "T01_sse_events",
    """select o_orderkey as attempt_id, cast(row_number() over (partition by o_orderkey order by p, i) - 1 as integer) as event_no, event, data from (
         select o_orderkey, 0 as p, 0 as i, 'response.created' as event, '{"response":{"id":"resp-' || o_orderkey || '","model":"m' || o_orderkey % 3 || '"}}' as data from orders
         union all select o_orderkey, 1, unnest(range(o_orderkey % 4)), 'response.output_text.delta', '{"delta":"x"}' from orders
         union all select o_orderkey, 2, 0, case o_orderkey % 5 when 0 then 'response.completed' when 1 then 'response.incomplete' when 2 then 'response.failed'
             when 4 then 'response.completed' else 'response.in_progress' end,
           case o_orderkey % 5 when 0 then '{"response":' || chr(10) || '{"usage":{"input_tokens":' || o_orderkey || '}}}' when 1 then '{"response":{}}'
             when 2 then '{"response":{"error":{"code":"overloaded"}}}' when 4 then '{"response":{"usage":{"input_tokens":1}}}' else '{oops' end from orders
         union all select o_orderkey, 3, 0, 'response.output_text.delta', '{"usage":{"input_tokens":9}}' from orders where o_orderkey % 5 = 4)""",
)
def sse_events(spark, root):
    return sse.frame_events(stream_chunks(spark, root)).select("attempt_id", "event_no", "event", "data")


_FOLD = f"""select o_orderkey as attempt_id, 'resp-' || o_orderkey as response_id, 'm' || o_orderkey % 3 as model,
    case when o_orderkey % 5 = 2 then 'overloaded' end as error_code,
    case o_orderkey % 5 when 0 then '{{"input_tokens":' || o_orderkey || '}}' when 4 then '{{"input_tokens":1}}' end as usage,
    case o_orderkey % 5 when 0 then 'completed' when 4 then 'completed' when 1 then 'incomplete' when 2 then 'failed'
      else case when o_orderkey % 2 = 0 then 'cancelled' else 'disconnected' end end as state,
    case when o_orderkey % 5 = 3 then case when o_orderkey % 2 = 0 then 'cancelled' else 'partial' end else 'complete' end as status,
    {_TERM} as terminal, 2 + o_orderkey % 4 as events, case when o_orderkey % 5 = 4 then 1 else 0 end as late_events from orders"""


def folded(spark, root):
    chunks = stream_chunks(spark, root)
    closings = chunks.where("closing is not null").select("attempt_id", "closing")
    return sse.fold_events(sse.frame_events(chunks, dense=False), closings)


@query("T02_stream_fold", _FOLD)
def stream_fold(spark, root):
    return folded(spark, root).drop("incomplete_reason", "compaction_output_seen")


@query(
    "T02_observation_fields",
    """select conv_id as attempt_id, case when r = 1 then 'max_output_tokens' end as incomplete_reason, m in (0, 3) as compaction_output_seen,
         case when r = 3 then 'unavailable' when r = 4 then 'unavailable' when r = 2 or m = 2 then 'partial' else 'final' end as usage_status,
         case when r not in (3, 4) then size end as input_total, case when r not in (3, 4) and m = 1 then size // 2 end as input_cached,
         case when r not in (3, 4) then turns end as output_total, case when r not in (3, 4) then case when m = 2 then 1 else size + turns end end as total,
         case when r in (3, 4) then 'partial' when r = 2 then 'cancelled' else 'complete' end as status
       from (select conv_id, count(*) as turns, cast(sum(length(text)) as bigint) as size, conv_id % 5 as r, conv_id % 4 as m from conversations group by 1)""",
)
def observation_fields(spark, root):
    """Reason, compaction and normalised usage of streams whose deltas carry the turns of dialogues."""
    chunks = dialogue_chunks(spark, root)
    closings = chunks.where("closing is not null").select("attempt_id", "closing")
    out = sse.with_usage(sse.fold_events(sse.frame_events(chunks, dense=False), closings))
    return out.select("attempt_id", "incomplete_reason", "compaction_output_seen", "usage_status", "input_total", "input_cached", "output_total", "total", "status")


@query("T03_late_events", "select late_events, count(*) as attempts from f group by 1", f=_FOLD)
def late_events(spark, root):
    return folded(spark, root).groupBy("late_events").agg(F.count(F.lit(1)).alias("attempts"))


@query("T04_worst_status", "select model, max(case status when 'complete' then 0 when 'partial' then 1 else 3 end) as severity from f group by 1", f=_FOLD)
def worst_status(spark, root):
    worst = folded(spark, root).groupBy("model").agg(sse.worst(F.col("status")).alias("s"))
    return worst.select("model", F.expr("case s when 'complete' then 0 when 'partial' then 1 else 3 end").alias("severity"))


@query("T05_closed_without_terminal", "select state, status, count(*) as attempts from f where not terminal group by 1, 2", f=_FOLD)
def closed_without_terminal(spark, root):
    return folded(spark, root).where("not terminal").groupBy("state", "status").agg(F.count(F.lit(1)).alias("attempts"))


@query(
    "T11_stream_latencies",
    """select user_id, min(us) - min(us) as ttfb_us, min(us) filter (event_type = 'view') - min(us) as ttft_us,
         min(us) filter (event_type in ('purchase', 'error')) - min(us) as duration_us from (select *, epoch_us(ts) as us from events) group by 1""",
)
def stream_latencies(spark, root):
    rows = read(spark, root, "events").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.unix_micros(F.col("ts").cast("timestamp")).alias("started_us"),
        F.expr("case event_type when 'view' then 'response.output_text.delta' when 'purchase' then 'response.completed' else event_type end").alias("event"),
    )
    return sse.first_latencies(rows, "user_id")


def _scratch(spark) -> str:
    return new_folder(spark, "stream")


def _as_log(events):
    return events.select(
        F.col("event_id"), F.col("user_id").alias("session_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp")
    )


@query("T07_append_only_log", "select event_type, count(*) as events, count(distinct event_id) as ids from events group by 1")
def append_only_log(spark, root):
    folder = _scratch(spark)
    # Every event arrives twice; the sink keeps one of each.
    twice = _as_log(session_of_event_stream(spark, root)).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    eventlog.append_events(twice, f"{folder}/log", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/log").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids")
    )


@query("T09_running_counters", "select user_id as session_id, event_type, count(*) as events from events group by 1, 2")
def running_counters(spark, root):
    folder = _scratch(spark)
    stream = eventlog.event_counters(_as_log(session_of_event_stream(spark, root)))
    return eventlog.run_to_table(stream, spark, f"{folder}/counters", f"{folder}/state")


@query(
    "T09_windowed_counters",
    "select epoch_us(date_trunc('day', ts)) as window_us, event_type, count(*) as events from events group by 1, 2",
)
def windowed_counters(spark, root):
    out = eventlog.windowed_counters(_as_log(read(spark, root, "events")))
    return out.select(F.unix_micros("window_start").alias("window_us"), "event_type", "events")


@query(
    "T10_drop_accounting",
    """select user_id, cast(sum(a) as bigint) as admitted, cast(sum(p) as bigint) as processed, cast(sum(d) as bigint) as dropped,
         sum(a) = sum(p) + sum(d) as balanced, sum(b) + sum(c) = sum(d) as reasons_agree
       from (select user_id, 1 as a, case when event_type = 'error' then 0 else 1 end as p, case when event_type = 'error' or event_id % 211 = 0 then 1 else 0 end as d,
               case when event_type = 'error' and event_id % 2 = 0 then 1 else 0 end as b, case when event_type = 'error' and event_id % 2 = 1 then 1 else 0 end as c
             from events) group by 1""",
)
def drop_accounting(spark, root):
    rows = read(spark, root, "events").select(
        "user_id", F.lit(1).alias("admitted"),
        F.expr("case when event_type = 'error' then 0 else 1 end").alias("processed"),
        F.expr("case when event_type = 'error' or event_id % 211 = 0 then 1 else 0 end").alias("dropped"),
        F.expr("case when event_type = 'error' and event_id % 2 = 0 then 1 else 0 end").alias("dropped_queue_full"),
        F.expr("case when event_type = 'error' and event_id % 2 = 1 then 1 else 0 end").alias("dropped_work_budget"),
    )
    out = eventlog.drop_accounting(rows, "user_id")
    return out.select("user_id", "admitted", "processed", "dropped", "balanced", "reasons_agree")


@query(
    "T08_stale_recovery",
    """select (select count(*) from t_sessions where state in ('active', 'closing')) as recovered_sessions,
         (select count(*) from t_sessions where state in ('active', 'closing', 'stale')) as stale_sessions,
         count(*) filter (completed_at_us is null and recovered_at_us is null) as recovered_snapshots,
         count(*) filter ((completed_at_us is null and recovered_at_us is null) or status = 'partial') as partial_snapshots from t_snapshots""",
)
def stale_recovery(spark, root):
    return eventlog.recovery_counts(star_trace(spark, root), "2025-01-01 00:00:00")


#: Bytes of the event table that are worth a file in each stretch of time.
STRETCH_FILE = 8 << 20


def _in_time_order(spark, rows, folder: str, parts: int = 4, each: int = 2):
    """A stream of rows in several micro-batches, each of a stretch of time in `each` files: rows (…, timestamp)."""
    edges = rows.agg(F.percentile_approx("timestamp", [i / parts for i in range(1, parts)]).alias("e")).first()["e"]
    files = 0
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
        mine = rows.where((F.lit(low is None) | (F.col("timestamp") >= F.lit(low))) & (F.lit(high is None) | (F.col("timestamp") < F.lit(high))))
        mine.repartition(each).write.parquet(f"{folder}/in/{i}")
        files = max(files, len(spark.read.parquet(f"{folder}/in/{i}").inputFiles()))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")


@query(
    "T08_stale_sessions_stream",
    """select user_id as session_id, epoch_us(min(ts)) as started_us, epoch_us(max(ts)) + 7200000000 as stale_us, count(*) as events from (
         select *, sum(case when before is null or ts - before >= interval 2 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as run
         from (select *, lag(ts) over (partition by user_id order by ts) as before from events))
       group by user_id, run having epoch_us(max(ts)) + 7200000000 <= (select epoch_us(max(ts)) from events) - 7200000000""",
)
def stale_sessions_stream(spark, root):
    """Sessions without events for two hours, closed on a stream of several micro-batches by the watermark."""
    folder = _scratch(spark)
    stream = _in_time_order(spark, _as_log(read(spark, root, "events")), folder)
    closed = eventlog.stale_after(stream, "2 hours").select("session_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("stale_at").alias("stale_us"), "events")
    return eventlog.run_to_table(closed, spark, f"{folder}/out", f"{folder}/state", "append")


@query(
    "U05_seen_ids_stream",
    """select event_type, user_id, epoch_us(ts) as at_us, coalesce(ts - before <= interval 12 hours, false) as seen
       from (select *, lag(ts) over (partition by event_type, user_id order by ts) as before from events)""",
)
def seen_ids_stream(spark, root):
    """Whether a user's event type was seen in the twelve hours before, over several micro-batches."""
    folder = _scratch(spark)
    rows = _as_log(read(spark, root, "events")).select(F.concat_ws("|", "event_type", "session_id").alias("id"), "timestamp")
    each = max(2, min(spark.sparkContext.defaultParallelism, table_bytes(spark, root, "events") // STRETCH_FILE))
    seen = eventlog.seen_before(_in_time_order(spark, rows, folder, each=each), "12 hours")
    out = eventlog.run_to_table(seen, spark, f"{folder}/out", f"{folder}/state", "append")
    return out.select(F.split_part("id", F.lit("|"), F.lit(1)).alias("event_type"), F.split_part("id", F.lit("|"), F.lit(2)).cast("bigint").alias("user_id"), F.unix_micros("timestamp").alias("at_us"), "seen")


@query(
    "T12_live_deltas",
    """select conv_id as session_id, conv_id * 1000 + turn as current_snapshot_id, conv_id * 1000 + before as previous_snapshot_id, n as repeated_blocks,
         0 as changed_blocks, 1 as new_blocks, 0 as removed_blocks, cast(t as bigint) as repeated_tokens, length(text) as new_tokens, n as common_prefix_blocks
       from (select *, lag(turn) over w as before, count(*) over p as n, sum(length(text)) over p as t from conversations
             window w as (partition by conv_id order by turn), p as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))
       where before is not null""",
)
def live_deltas(spark, root):
    """Deltas of dialogue snapshots, each holding all turns so far, as they arrive on a stream."""
    folder = _scratch(spark)
    turns = read(spark, root, "conversations")
    earlier = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    block = F.struct("t", F.sha2("x", 256).alias("exact"), F.sha2("r", 256).alias("semantic"), F.length("x").cast("bigint").alias("tokens"))
    whole = turns.join(earlier, (F.col("conv_id") == F.col("c")) & (F.col("t") <= F.col("turn"))).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(block)).alias("b"))
    snapshots = whole.select(
        F.col("conv_id").cast("bigint").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("snapshot_id"),
        F.col("turn").cast("bigint").alias("position"),
        F.transform("b", lambda x: F.struct(x["exact"].alias("exact"), x["semantic"].alias("semantic"), x["tokens"].alias("tokens"))).alias("blocks"),
    )
    snapshots.write.parquet(f"{folder}/in")
    return eventlog.live_deltas(spark.readStream.schema(snapshots.schema).parquet(f"{folder}/in"), spark, folder)


@query("T02_stateful_fold", _FOLD)
def stateful_fold(spark, root):
    """The same observations from the stateful form, over several micro-batches."""
    folder = _scratch(spark)
    placed = stream_chunks(spark, root, None, (F.col("seq") > F.col("last") / 2).alias("late"))
    for late in (False, True):
        placed.where(F.col("late") == late).select("attempt_id", "seq", "chunk", "closing").write.mode("append").parquet(f"{folder}/in/{int(late)}")
    first = len(spark.read.parquet(f"{folder}/in/0").inputFiles())
    stream = spark.readStream.schema(placed.select("attempt_id", "seq", "chunk", "closing").schema).option("maxFilesPerTrigger", first).parquet(f"{folder}/in/*")
    return sse.observe_to_table(stream, folder).drop("incomplete_reason", "compaction_output_seen")


@query(
    "T06_bounded_stream",
    """select o_orderkey as attempt_id, case when 2 + o_orderkey % 4 + case when o_orderkey % 5 = 4 then 1 else 0 end > 4 then 'resource_limit' else 'complete' end as status,
         least(4, 2 + o_orderkey % 4 + case when o_orderkey % 5 = 4 then 1 else 0 end) as kept from orders""",
)
def bounded_stream(spark, root):
    bounded = sse.bound_events(sse.frame_events(stream_chunks(spark, root)), max_events=4, max_bytes=1 << 20)
    return bounded.groupBy("attempt_id").agg(
        F.when(F.max("over"), "resource_limit").otherwise("complete").alias("status"), F.count(F.when(~F.col("over"), 1)).alias("kept")
    )
