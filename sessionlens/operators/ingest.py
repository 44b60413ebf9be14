"""Raw requests and responses to relational facts: metadata, blocks, visibility, usage, status, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import context_status, origin_of_role, role_of, terminal_event
from ..functions.measures import count_where

# Item types and the block kind they become.
CALL_TYPES = (
    "function_call", "computer_call", "web_search_call", "web_search_preview_call", "code_interpreter_call",
    "custom_tool_call", "tool_search_call", "local_shell_call", "shell_call",
)
RESULT_TYPES = (
    "function_call_output", "computer_call_output", "web_search_call_output", "code_interpreter_call_output",
    "custom_tool_call_output", "tool_search_output", "local_shell_call_output", "shell_call_output",
)


def parsed_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """Add `doc` (VARIANT, NULL when the body is not a JSON object)."""
    parsed = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return raw.withColumn("doc", F.when(is_object, parsed))


def _get(path: str, kind: str, source: str = "doc") -> Column:
    return F.try_variant_get(source, path, kind)


def _kind_of(path: str, source: str = "doc") -> Column:
    """JSON type of a member: OBJECT<...>, ARRAY<...>, STRING, ...; NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(source, path, "variant"))


def request_metadata(raw: DataFrame, body: str = "body") -> DataFrame:
    """Metadata columns of each request body; a member of the wrong type makes the row partial."""
    rows = parsed_requests(raw, body)
    wrong = F.lit(False)
    for name, good in (("stream", "BOOLEAN"), ("background", "BOOLEAN"), ("store", "BOOLEAN"), ("model", "STRING"),
                       ("truncation", "STRING"), ("previous_response_id", "STRING"), ("input", "ARRAY"), ("tools", "ARRAY")):
        found = _kind_of(f"$.{name}")
        wrong = wrong | F.coalesce((found != "VOID") & ~found.startswith(good), F.lit(False))
    items = F.coalesce(_get("$.input", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    staged = rows.withColumn("__items", F.when(_kind_of("$.input").startswith("ARRAY"), items)).withColumn("__wrong", wrong)
    parts = F.flatten(
        F.transform(
            F.col("__items"),
            lambda item: F.coalesce(F.try_variant_get(item, "$.content", "array<variant>"), F.expr("cast(array() as array<variant>)")),
        )
    )
    types = F.transform(parts, lambda part: F.try_variant_get(part, "$.type", "string"))
    count = lambda *names: F.size(F.filter(F.col("__types"), lambda t: t.isin(*names))).cast("bigint")
    triggered = F.exists("__items", lambda item: F.coalesce(F.try_variant_get(item, "$.type", "string") == "compaction_trigger", F.lit(False)))
    is_list = _kind_of("$.input").startswith("ARRAY")
    known = F.array(*[F.lit(t) for t in ("input_text", "text", "input_image", "image_url", "image", "input_file", "file")])
    odd = F.exists("__types", lambda t: t.isNotNull() & ~F.array_contains(known, t))
    ok = F.col("doc").isNotNull()
    return (
        staged.withColumn("__types", F.when(is_list, types))
        .select(
            *raw.columns,
            F.when(~ok, "malformed").when(F.col("__wrong") | F.coalesce(odd, F.lit(False)), "partial").otherwise("complete").alias("observation_status"),
            F.octet_length(body).cast("bigint").alias("request_bytes"),
            _get("$.model", "string").alias("model"),
            F.when(_kind_of("$.stream") == "BOOLEAN", _get("$.stream", "boolean")).alias("stream"),
            F.when(_kind_of("$.store") == "BOOLEAN", _get("$.store", "boolean")).alias("store"),
            _get("$.reasoning.effort", "string").alias("reasoning_effort"),
            _get("$.text.verbosity", "string").alias("text_verbosity"),
            F.when(ok, F.coalesce(_kind_of("$.previous_response_id") == "STRING", F.lit(False))).alias("has_previous_response"),
            F.when(is_list, F.size("__items").cast("bigint")).alias("input_item_count"),
            F.when(_kind_of("$.tools").startswith("ARRAY"), F.size(_get("$.tools", "array<variant>")).cast("bigint")).alias("tool_count"),
            count("input_text", "text").alias("text_input_blocks"),
            count("input_image", "image_url", "image").alias("image_input_blocks"),
            count("input_file", "file").alias("file_input_blocks"),
            F.when(F.coalesce(triggered, F.lit(False)), "compaction_v2").otherwise("turn").alias("request_kind"),
        )
    )


def _block(kind: Column, role: Column, origin: Column, payload: Column, call: Column, tool: Column) -> Column:
    return F.struct(
        kind.alias("kind"), role.alias("role"), origin.alias("origin"), F.to_json(payload).alias("content"),
        call.alias("tool_call_id"), tool.alias("tool_name"),
    )


_NONE = lambda: F.lit(None).cast("string")


def _item_kind(item_type: Column, has_body: Column) -> Column:
    """Block kind of an input item; `has_body` says an untyped item carries a role or content."""
    return (
        F.when((item_type == "message") | (item_type.isNull() & has_body), "message")
        .when(item_type == "assistant_history", "assistant_history")
        .when(item_type.isin(*CALL_TYPES), "tool_call")
        .when(item_type.isin(*RESULT_TYPES), "tool_result")
        .when(item_type.isin("item_reference", "item_ref"), "item_reference")
        .when(item_type.isin("prompt", "prompt_reference"), "prompt_reference")
        .when(item_type.isin("reasoning", "opaque_reasoning"), "opaque_reasoning")
        .when(item_type == "compaction_trigger", "compaction_trigger")
        .when(item_type.isin("input_text", "output_text"), "text")
        .otherwise("unknown")
    )


def _part_kind(part_type: Column, has_text: Column) -> Column:
    """Block kind of a message content part."""
    return (
        F.when((part_type.isNull() | part_type.isin("input_text", "output_text", "text")) & has_text, "text")
        .when(part_type.isin("input_image", "output_image", "image"), "image_reference")
        .when(part_type.isin("input_file", "output_file", "file"), "file_reference")
        .when(part_type.isin("item_reference", "item_ref"), "item_reference")
        .when(part_type.isin("prompt", "prompt_reference"), "prompt_reference")
        .when(part_type.isin("reasoning", "opaque_reasoning"), "opaque_reasoning")
        .otherwise("unknown")
    )


def _origin(kind: Column, role: Column) -> Column:
    by_role = F.coalesce(origin_of_role(role), F.lit("unknown"))
    return (
        F.when(kind == "tool_call", "agent_generated").when(kind == "assistant_history", "agent_generated")
        .when(kind == "tool_result", "tool_generated").when(kind == "tool_definition", "tool_schema")
        .when(kind.isin("item_reference", "prompt_reference", "opaque_reasoning", "provider_state_reference"), "provider_managed")
        .when(kind.isin("image_reference", "file_reference"), "external_reference")
        .when(kind == "instructions", "human_authored")
        .when(kind == "unknown", "unknown")
        .otherwise(by_role)
    )


def request_blocks(raw: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Ordered block rows of each request: instructions, input, tools, then references.

    One parse and two explodes; ordinals number the blocks of a request, which the request contract
    bounds. Members of one section keep their order; sections come in the fixed order above.
    """
    rows = parsed_requests(raw.select(key, body), body).where("doc is not null")
    entry = lambda slot, value: F.struct(F.lit(slot).alias("slot"), value.alias("v"))
    empty = F.expr("cast(array() as array<struct<slot string, v variant>>)")
    member = lambda name: F.try_variant_get("doc", f"$.{name}", "variant")
    one = lambda name, slot: F.when(
        F.coalesce(_kind_of(f"$.{name}") != "VOID", F.lit(False)), F.array(entry(slot, member(name)))
    ).otherwise(empty)
    many = lambda name, slot: F.when(
        F.coalesce(_kind_of(f"$.{name}").startswith("ARRAY"), F.lit(False)),
        F.transform(_get(f"$.{name}", "array<variant>"), lambda v: entry(slot, v)),
    ).otherwise(empty)
    text_of = lambda name, slot: F.when(F.coalesce(_kind_of(f"$.{name}") == "STRING", F.lit(False)), F.array(entry(slot, member(name)))).otherwise(empty)
    listed = lambda name: F.when(
        F.coalesce(_kind_of(f"$.{name}").startswith("ARRAY"), F.lit(False)), many(name, "item_reference")
    ).otherwise(one(name, "item_reference"))
    entries = F.concat(
        text_of("instructions", "instructions"), text_of("input", "text"), many("input", "item"), many("tools", "tool"),
        text_of("previous_response_id", "provider_state_reference"), one("conversation", "provider_state_reference"),
        one("prompt", "prompt_reference"), listed("item_reference"), listed("item_ref"), listed("item_references"),
        one("file_id", "file_reference"), one("file_url", "file_reference"),
        one("image_url", "image_reference"), one("image_id", "image_reference"),
    )
    exploded = rows.select(key, F.posexplode(entries).alias("entry", "e")).select(key, "entry", "e.slot", "e.v")
    v = lambda path, kind="string": F.try_variant_get("v", path, kind)
    shape = F.schema_of_variant("v")
    is_object = shape.startswith("OBJECT")
    item = F.col("slot") == "item"
    item_type = F.when(is_object, v("$.type"))
    role_text = F.when(is_object, v("$.role"))
    has_body = is_object & (role_text.isNotNull() | v("$.content", "variant").isNotNull())
    kind = (
        F.when(item & is_object, _item_kind(item_type, has_body)).when(item, "unknown")
        .when((F.col("slot") == "tool") & is_object, "tool_definition").when(F.col("slot") == "tool", "unknown")
        .otherwise(F.col("slot"))
    )
    staged = exploded.withColumn("kind", kind).where("kind <> 'compaction_trigger'")
    item_role = F.when(role_text.isNotNull(), role_of(role_text))
    k = F.col("kind")
    role = (
        F.when(k == "instructions", "system")
        .when(F.col("slot") == "text", "user")
        .when(k.isin("tool_call", "tool_result"), "tool")
        .when(item & k.isin("assistant_history", "opaque_reasoning"), F.coalesce(item_role, F.lit("assistant")))
        .when(item & (k == "text"), F.coalesce(item_role, F.lit("user")))
        .when(item & is_object, item_role)
    )
    call = F.when(k.isin("tool_call", "tool_result"), F.coalesce(v("$.call_id"), v("$.id")))
    tool = F.when(k.isin("tool_call", "tool_result"), v("$.name")).when(
        k == "tool_definition", F.coalesce(v("$.name"), v("$.function.name"), v("$.server_label"))
    )
    payload = (
        F.when(k == "tool_call", F.coalesce(v("$.arguments", "variant"), v("$.input", "variant"), F.col("v")))
        .when(k == "tool_result", F.coalesce(v("$.output", "variant"), v("$.content", "variant"), F.col("v")))
        .when(item & (k == "text"), F.coalesce(v("$.text", "variant"), F.col("v")))
        .otherwise(F.col("v"))
    )
    origin_role = F.when(item & (k == "text"), item_role).otherwise(role)
    own = _block(k, role, F.when(F.col("slot") == "text", "human_authored").otherwise(_origin(k, origin_role)), payload, call, tool)
    # Content of messages: a string, an object or a list of parts.
    speaks = item & k.isin("message", "assistant_history")
    content_kind = F.schema_of_variant(v("$.content", "variant"))
    no_parts = F.expr("cast(array() as array<variant>)")
    parts = (
        F.when(speaks & content_kind.startswith("ARRAY"), v("$.content", "array<variant>"))
        .when(speaks & content_kind.startswith("OBJECT"), F.array(v("$.content", "variant")))
        .otherwise(no_parts)
    )
    origin_parts = F.when(k == "assistant_history", "agent_generated").otherwise(F.coalesce(origin_of_role(item_role), F.lit("unknown")))

    def part_block(part: Column) -> Column:
        object_part = F.schema_of_variant(part).startswith("OBJECT")
        part_kind = F.when(
            object_part,
            _part_kind(F.try_variant_get(part, "$.type", "string"), F.try_variant_get(part, "$.text", "variant").isNotNull()),
        ).otherwise("unknown")
        origin = F.when(part_kind == "text", origin_parts).otherwise(_origin(part_kind, F.lit("unknown")))
        body_of = F.when(part_kind == "text", F.try_variant_get(part, "$.text", "variant")).otherwise(part)
        return _block(part_kind, role, origin, body_of, _NONE(), _NONE())

    said = F.when(
        speaks & (content_kind == "STRING"),
        F.array(_block(F.lit("text"), role, origin_parts, v("$.content", "variant"), _NONE(), _NONE())),
    ).otherwise(F.transform(parts, part_block))
    blocks = staged.select(key, "entry", F.posexplode(F.concat(F.array(own), said)).alias("part", "b")).select(
        key, "entry", "part", "b.*"
    )
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("entry", "part")) - 1
    return (
        blocks.withColumn("ordinal", ordinal.cast("bigint"))
        .withColumn("raw_bytes", F.octet_length("content").cast("bigint"))
        .drop("entry", "part")
    )


def fill_tool_names(blocks: DataFrame, key: str) -> DataFrame:
    """Give results the tool name of the call with the same id in the same request; the last call wins."""
    calls = (
        blocks.where("kind = 'tool_call' and tool_call_id is not null and tool_name is not null")
        .groupBy(key, "tool_call_id")
        .agg(F.max_by("tool_name", "ordinal").alias("__called"))
    )
    joined = blocks.join(calls, [key, "tool_call_id"], "left")
    name = F.when((F.col("kind") == "tool_result") & F.col("tool_name").isNull(), F.col("__called")).otherwise(F.col("tool_name"))
    return joined.withColumn("tool_name", name).drop("__called")


def visibility(raw: DataFrame, blocks: DataFrame, key: str, complete: Column | None = None, body: str = "body") -> DataFrame:
    """Visibility flags, reference counts and the logical context status of each request."""
    has = lambda kind: count_where(F.col("kind") == kind)
    counts = blocks.groupBy(key).agg(
        has("item_reference").alias("item_references"), has("prompt_reference").alias("prompt_references"),
        has("file_reference").alias("file_references"), has("image_reference").alias("image_references"),
        count_where(F.col("kind").isin("opaque_reasoning", "opaque")).alias("opaque_items"),
    )
    base = parsed_requests(raw, body).select(
        key,
        F.coalesce(_kind_of("$.previous_response_id") != "VOID", F.lit(False)).alias("uses_previous_response"),
        F.coalesce(_kind_of("$.conversation") != "VOID", F.lit(False)).alias("uses_conversation_state"),
        (F.lit(True) if complete is None else complete).alias("explicit_complete"),
        F.col("doc").isNotNull().alias("parsed"),
    )
    out = base.join(counts, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    whole = F.col("explicit_complete") & F.col("parsed")
    status = context_status(
        F.col("uses_previous_response"), F.col("uses_conversation_state"), n("item_references") > 0,
        n("prompt_references") > 0, n("opaque_items") > 0, n("file_references") > 0, n("image_references") > 0, whole,
    )
    return out.select(
        key, "uses_previous_response", "uses_conversation_state",
        *[n(c).alias(c) for c in ("item_references", "prompt_references", "file_references", "image_references", "opaque_items")],
        status.alias("logical_context_status"),
    )


def resolve_references(requests: DataFrame, seen: DataFrame | None, column: str = "previous_response_id") -> DataFrame:
    """Whether a referenced response id was observed before; NULL when no ids are available."""
    if seen is None:
        return requests.withColumn("resolved_locally", F.lit(None).cast("boolean"))
    ids = seen.select(F.sha2(F.col("response_id"), 256).alias("__h")).distinct().withColumn("__hit", F.lit(True))
    joined = requests.withColumn("__k", F.sha2(F.col(column), 256)).join(ids, F.col("__k") == F.col("__h"), "left")
    found = F.when(F.col(column).isNotNull(), F.coalesce("__hit", F.lit(False)))
    return joined.withColumn("resolved_locally", found).drop("__k", "__h", "__hit")


# --- usage -----------------------------------------------------------------------------------------------


def _counter(path: str, parent: str | None = None) -> tuple[Column, Column, Column]:
    """Value, invalid flag and overflow flag of one usage counter."""
    kind = _kind_of(path)
    value = F.when(kind == "BIGINT", _get(path, "bigint"))
    number = _get(path, "double")
    is_number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    huge = is_number & (F.abs(number) > 9.223372036854775e18)
    invalid = (value < 0) | (is_number & ~huge) | (~is_number & ~kind.isin("BIGINT", "VOID"))
    if parent is not None:
        outer = _kind_of(parent)
        invalid = F.coalesce(invalid, F.lit(False)) | F.coalesce(~outer.startswith("OBJECT") & (outer != "VOID"), F.lit(False))
    return F.when(value >= 0, value), F.coalesce(invalid, F.lit(False)), F.coalesce(huge, F.lit(False))


def normalize_usage(rows: DataFrame, column: str = "usage") -> DataFrame:
    """Six counters, five anomaly flags and a status out of a usage document."""
    parsed = F.try_parse_json(column)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    staged = rows.withColumn("doc", F.when(is_object, parsed))
    fields = {
        "input_total": ("$.input_tokens", None),
        "input_cached": ("$.input_tokens_details.cached_tokens", "$.input_tokens_details"),
        "cache_write": ("$.input_tokens_details.cache_write_tokens", "$.input_tokens_details"),
        "output_total": ("$.output_tokens", None),
        "output_reasoning": ("$.output_tokens_details.reasoning_tokens", "$.output_tokens_details"),
        "total": ("$.total_tokens", None),
    }
    invalid, overflow = F.col("doc").isNull(), F.lit(False)
    for name, (path, parent) in fields.items():
        value, bad, huge = _counter(path, parent)
        if name == "cache_write":
            other, other_bad, other_huge = _counter("$.input_tokens_details.cache_write", "$.input_tokens_details")
            missing = value.isNull()
            value, bad, huge = F.coalesce(value, other), bad | (missing & other_bad), huge | (missing & other_huge)
        staged = staged.withColumn(name, value)
        invalid, overflow = invalid | bad, overflow | huge
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    cached_over = no(c("input_cached") > c("input_total"))
    reasoning_over = no(c("output_reasoning") > c("output_total"))
    inconsistent = no(c("input_total") + c("output_total") != c("total"))
    staged = (
        staged.withColumn("invalid_number", invalid).withColumn("overflow", overflow)
        .withColumn("cached_exceeds_input", cached_over).withColumn("reasoning_exceeds_output", reasoning_over)
        .withColumn("inconsistent_total", inconsistent)
        .withColumn("input_uncached", F.when(~cached_over, c("input_total") - c("input_cached")))
    )
    reported = F.coalesce(*fields).isNotNull()
    anomaly = c("invalid_number") | c("overflow") | c("cached_exceeds_input") | c("reasoning_exceeds_output") | c("inconsistent_total")
    status = F.when(~reported, "unavailable").when(anomaly, "partial").otherwise("final")
    return staged.withColumn("usage_status", status).drop("doc")


def response_state(status: Column | str) -> Column:
    """Lifecycle state of a provider status text."""
    status = F.col(status) if isinstance(status, str) else status
    return (
        F.when(status.isin("completed", "incomplete", "failed", "queued", "in_progress"), status)
        .when(status.isin("cancelled", "canceled"), "cancelled")
        .otherwise("unknown")
    )


def settle_usage(status: Column | str, state: Column | str) -> Column:
    """Usage is final only if the response reached a terminal state."""
    status = F.col(status) if isinstance(status, str) else status
    state = F.col(state) if isinstance(state, str) else state
    terminal = state.isin("completed", "incomplete", "failed", "cancelled")
    return F.when((status == "final") & ~terminal, "partial").otherwise(status)


# --- canonical events --------------------------------------------------------------------------------------


def canonical_events(attempts: DataFrame) -> DataFrame:
    """Each observed attempt as one to six typed events with allow-listed payloads.

    Expects attempt_id, request_kind, model, request_bytes, request_status, status_code, status,
    response_state, response_status, usage_status, ttfb_us, duration_us, error_code, transport_error,
    input_total and output_total; response_state NULL means no response was seen.
    """
    payload = lambda *names: F.to_json(F.struct(*names))
    event = lambda name, body: F.struct(name.alias("event_type"), body.alias("payload"))
    answered = F.col("response_state").isNotNull()
    ending = terminal_event("status")
    partial = (F.col("request_status") != "complete") | F.coalesce(F.col("response_status") != "complete", F.lit(False))
    events = F.array(
        event(F.lit("provider.request.observed"), payload("request_kind", "model", "request_bytes")),
        F.when(
            F.col("status_code").isNotNull() | answered,
            event(F.lit("provider.response.started"), payload("status_code", "response_state", "ttfb_us")),
        ),
        F.when(ending.isNotNull(), event(ending, payload("status", "error_code", "transport_error", "duration_us"))),
        F.when(answered & F.col("usage_status").isNotNull(), event(F.lit("provider.usage.observed"), payload("usage_status"))),
        F.when(
            answered & F.col("usage_status").isin("final", "partial"),
            event(F.lit("provider.usage.normalized"), payload("usage_status", "input_total", "output_total")),
        ),
        F.when(partial, event(F.lit("provider.observation.partial"), payload("request_status", "response_status"))),
    )
    return attempts.select("attempt_id", F.posexplode(F.filter(events, lambda e: e.isNotNull())).alias("position", "e")).select(
        "attempt_id", "position", "e.event_type", "e.payload"
    )
