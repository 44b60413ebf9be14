"""Server-sent event streams: framing and folding, as a batch job and as a stateful stream.

The batch form is the specification. It never puts a whole stream together: chunks are cut at blank
lines where they are, and only the pieces of an event that crosses chunks meet. The stateful form
carries the unfinished event and the folded observation between batches and gives the same result for
any cut of the stream.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import numbered
from ..operators.ingest import normalize_usage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Event names and the lifecycle state they report.
STATES = {
    "response.created": "queued", "response.queued": "queued", "response.in_progress": "in_progress",
    "response.completed": "completed", "response.incomplete": "incomplete", "response.failed": "failed",
    "error": "failed", "response.cancelled": "cancelled", "response.canceled": "cancelled",
}
TERMINAL = ("completed", "incomplete", "failed", "cancelled")
# Observation statuses from best to worst; a status only ever gets worse.
SEVERITY = ("complete", "partial", "unsupported", "cancelled", "observer_backpressure", "malformed", "resource_limit")
# How a stream without a terminal event is closed: (state, status).
CLOSINGS = {
    "cancel": ("cancelled", "cancelled"), "disconnect": ("disconnected", "partial"), "end": ("disconnected", "partial"),
}


def worst(status: Column) -> Column:
    """Worst of a group of statuses."""
    place = F.create_map(*[F.lit(v) for i, s in enumerate(SEVERITY) for v in (s, i)])
    names = F.array(*[F.lit(s) for s in SEVERITY])
    return F.get(names, F.max(place[status]))


#: Chunks, and events, in one piece of an attempt.
PIECE = 1024


def frame_events(chunks: DataFrame, key: str = "attempt_id", dense: bool = True) -> DataFrame:
    """Chunks (seq, chunk) to events (event_no, event, data, size): CR, LF and CRLF end lines, blank lines end events,
    data lines join, comments go. Attempts are never null; a null or empty chunk adds nothing. Event numbers rise with the
    stream; where they need not be 0, 1, 2, …, `dense=False` saves a shuffle.

    A segmented scan over pieces of `PIECE` chunks. A piece is cut at its blank lines: its first part may
    go on with an event of the piece before, its last part may go on in the next, and what lies between are whole
    events. What a piece needs of those before it, their last character and their number of blank lines,
    is a running sum over one small row a piece. Only parts at the edges of pieces are grouped by (attempt,
    number) and joined in order. So an attempt of any length is spread over as many tasks as it has pieces.
    """
    line_end, break_ = F.array(F.lit("\r"), F.lit("\n")), "\n{2,}"
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "")
    pieces = chunks.where("chunk <> ''").groupBy(key, F.floor(F.col("seq") / PIECE).alias("__piece")).agg(joined.alias("__raw"))
    pieces = pieces.withColumn("__text", F.regexp_replace("__raw", "\r\n|\r", "\n"))
    ahead = Window.partitionBy(key).orderBy("__piece")
    edges = pieces.select(
        key, "__piece", F.right("__raw", F.lit(1)).alias("__last"), F.col("__raw").startswith("\n").alias("__feed"),
        F.col("__text").rlike("^\n(?!\n)").alias("__one"), F.regexp_count("__text", F.lit(break_)).alias("__breaks"),
    )
    edges = edges.withColumn("__before", F.lag("__last").over(ahead)).withColumn("__open", F.lead("__last").over(ahead).isNotNull())
    edges = edges.withColumn("__start", F.coalesce(F.array_contains(line_end, F.col("__before")), F.lit(False)))
    edges = edges.withColumn("__split", F.col("__start") & (F.col("__before") == "\r") & F.col("__feed"))  # a line end cut in two
    cuts = F.col("__breaks") + (F.col("__start") & ~F.col("__split") & F.col("__one")).cast("int")
    shift = F.coalesce(F.sum(cuts).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(key, "__piece", "__start", "__split", "__open", F.col("__before").isNotNull().alias("__goes_on"), shift.alias("__shift"))

    def parts(some: DataFrame) -> DataFrame:
        """(attempt, piece, number, text, and whether the part may go on before or after its piece)"""
        # the line feed before a piece, so that a blank line across its edge is seen
        text = F.when(F.col("__start") & ~F.col("__split"), F.concat(F.lit("\n"), "__text")).otherwise(F.col("__text"))
        placed = pieces.join(some, [key, "__piece"]).select("*", F.split(text, break_).alias("__parts")).drop("__raw", "__text")
        placed = placed.select("*", F.posexplode("__parts").alias("__i", "__part"))
        own = F.when(F.col("__start") & (F.col("__i") == 0), F.regexp_replace("__part", "^\n", "")).otherwise(F.col("__part"))
        crosses = ((F.col("__i") == 0) & F.col("__goes_on")) | ((F.col("__i") == F.size("__parts") - 1) & F.col("__open"))
        return placed.select(key, "__piece", (F.col("__shift") + F.col("__i")).alias("block"), own.alias("text"), crosses.alias("__crosses"))

    several = F.col("__goes_on") | F.col("__open")
    crossing = parts(edges.where(several)).where("__crosses and text <> ''").groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("__piece", "text"))).alias("__texts"))
    crossing = crossing.select(key, "block", F.array_join(F.transform("__texts", lambda c: c["text"]), "").alias("text"))
    whole = parts(edges).where("not __crosses").select(key, "block", "text").unionByName(crossing)
    return _read_events(whole.withColumn("text", F.regexp_replace("text", "^\n+|\n+$", "")), key, dense)


def _read_events(blocks: DataFrame, key: str, dense: bool) -> DataFrame:
    """Blocks of lines to events; blocks without event name and data are no events."""

    def fields(name: str) -> Column:
        lines = F.filter(F.split("text", "\n"), lambda l: (l == name) | l.startswith(f"{name}:"))
        return F.transform(lines, lambda l: F.regexp_replace(l, f"^{name}:? ?", ""))

    # An empty data line adds nothing before the first byte of data.
    data = F.regexp_replace(F.array_join(fields("data"), "\n"), "^\n+", "")
    events = blocks.select(key, "block", F.try_element_at(fields("event"), F.lit(-1)).alias("event"), data.alias("data"), F.octet_length("text").alias("size"))
    events = events.where(F.col("event").isNotNull() | (F.col("data") != ""))
    if not dense:
        return events.withColumnRenamed("block", "event_no")
    placed = numbered(events, [key], [F.col("block")], "event_no", F.floor(F.col("block") / PIECE))
    return placed.select(key, (F.col("event_no") - 1).cast("int").alias("event_no"), "event", "data", "size")


def bound_events(events: DataFrame, max_events: int, max_bytes: int) -> DataFrame:
    """Mark events beyond bounds that the caller sets; every event stays."""
    return events.withColumn("over", (F.col("event_no") >= max_events) | (F.col("size") > max_bytes))


def fold_events(events: DataFrame, closings: DataFrame, key: str = "attempt_id") -> DataFrame:
    """Observation per attempt: first id and model, last usage, terminal state; late events only count.

    `closings` has one row per attempt with `closing` (cancel, disconnect or end). Aggregates only:
    an attempt with very many events folds on the map side.
    """
    lifecycle = F.create_map(*[F.lit(v) for k, s in STATES.items() for v in (k, s)])
    doc = F.try_parse_json("data")
    named = events.withColumn("state", lifecycle[F.col("event")]).withColumn("doc", doc)
    stop = named.where(F.col("state").isin(*TERMINAL) & F.col("doc").isNotNull()).groupBy(key).agg(
        F.min("event_no").alias("stop")
    )
    response = F.coalesce(F.try_variant_get("doc", "$.response", "variant"), F.col("doc"))
    rows = named.join(stop, key, "left").withColumn("__r", response)
    live = F.col("stop").isNull() | (F.col("event_no") <= F.col("stop"))
    text = lambda path: F.when(live, F.try_variant_get("__r", path, "string"))
    first = lambda value: F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col("event_no")))
    usage = F.when(live, F.to_json(F.try_variant_get("__r", "$.usage", "variant")))
    usage = F.when(usage.startswith("{"), usage)
    state = F.when(live & F.col("doc").isNotNull(), F.col("state"))
    odd_usage = live & F.col("doc").isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_variant_get("__r", "$.usage", "variant")).rlike("^(OBJECT|VOID)"), F.lit(True))
    status = (
        F.when((live & F.col("state").isNotNull() & F.col("doc").isNull()) | odd_usage, "partial")
        .otherwise("complete")
    )
    # `type` of any object in the document; a quote inside a text is escaped
    compaction = live & F.to_json("doc").rlike(r'(?<!\\)"type":"compaction"')
    folded = rows.groupBy(key).agg(
        first(text("$.id")).alias("response_id"),
        first(text("$.model")).alias("model"),
        first(text("$.error.code")).alias("error_code"),
        first(text("$.incomplete_details.reason")).alias("incomplete_reason"),
        F.coalesce(F.bool_or(compaction), F.lit(False)).alias("compaction_output_seen"),
        F.max_by(usage, F.when(usage.isNotNull(), F.col("event_no"))).alias("usage"),
        F.max_by(state, F.when(state.isNotNull(), F.col("event_no"))).alias("state"),
        F.count(F.when(live, 1)).alias("events"),
        F.count(F.when(~live, 1)).alias("late_events"),
        worst(status).alias("__status"),
        F.max(F.col("stop").isNotNull()).alias("__terminal"),
    )
    out = closings.join(folded, key, "left")
    closing_state = F.create_map(*[F.lit(v) for k, (s, _) in CLOSINGS.items() for v in (k, s)])[F.col("closing")]
    closing_status = F.create_map(*[F.lit(v) for k, (_, s) in CLOSINGS.items() for v in (k, s)])[F.col("closing")]
    terminal = F.coalesce("__terminal", F.lit(False))
    place = F.create_map(*[F.lit(v) for i, s in enumerate(SEVERITY) for v in (s, i)])
    names = F.array(*[F.lit(s) for s in SEVERITY])
    bare = terminal & (F.col("state") == "completed") & F.col("usage").isNull()
    own = F.coalesce("__status", F.lit("complete"))
    status = F.when(terminal, F.when(bare, F.get(names, F.greatest(place[own], F.lit(1)))).otherwise(own)).otherwise(
        F.get(names, F.greatest(place[own], place[closing_status]))
    )
    return out.select(
        key, "response_id", "model", "error_code", "usage",
        F.when(terminal, F.col("state")).otherwise(closing_state).alias("state"),
        status.alias("status"), terminal.alias("terminal"),
        F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("late_events", F.lit(0)).alias("late_events"),
        "incomplete_reason", F.coalesce("compaction_output_seen", F.lit(False)).alias("compaction_output_seen"),
    )


def with_usage(observations: DataFrame) -> DataFrame:
    """Observations of either form with the normalised usage: six counters, and a status that is final only after a
    terminal event. A completed response whose usage says nothing is partial."""
    out = normalize_usage(observations)
    kept = F.when(F.col("usage").isNotNull(), F.col("usage_status")).otherwise("unavailable")
    settled = F.when((kept == "final") & ~F.col("terminal"), "partial").otherwise(kept)
    out = out.withColumn("usage_status", settled)
    silent = F.col("terminal") & (F.col("state") == "completed") & (F.col("usage_status") == "unavailable") & (F.col("status") == "complete")
    counters = ("input_total", "input_cached", "cache_write", "output_total", "output_reasoning", "total")
    return out.withColumn("status", F.when(silent, "partial").otherwise(F.col("status"))).select(*observations.columns, "usage_status", *counters)


# --- stateful form ---------------------------------------------------------------------------------------


def cut_events(text: str, final: bool = False) -> tuple[list[tuple[str | None, str]], str]:
    """Complete (event, data) pairs of a stretch of a stream, and the text that waits for more.

    The same rules as `frame_events`, by pattern: line ends become line feeds, blank lines part events. A
    carriage return at the very end waits, since a line feed may follow.
    """
    held = "\r" if text.endswith("\r") and not final else ""
    body = re.sub("\r\n?", "\n", text[: len(text) - len(held)])
    whole, _, rest = (body, "", "") if final else body.rpartition("\n\n")
    found = []
    for block in filter(None, re.split("\n{2,}", whole)):
        fields = [(name, value.removeprefix(" ")) for name, _, value in (line.partition(":") for line in block.split("\n"))]
        names = [value for name, value in fields if name == "event"]
        data = "\n".join(value for name, value in fields if name == "data").lstrip("\n")
        if names or data:
            found.append((names[-1] if names else None, data))
    return found, rest + held


def _parsed(data: str):
    try:
        return json.loads(data)
    except ValueError:
        return None


def observe(seen: dict, events: list[tuple[str | None, str]]) -> dict:
    """An observation with more events: the first id, model and error code, the last usage and state up to the
    terminal event; what comes after it only counts."""
    rows = [(STATES.get(name), _parsed(data)) for name, data in events]
    ends = [i for i, (state, doc) in enumerate(rows) if state in TERMINAL and doc is not None]
    live = rows[: 0 if seen["terminal"] else ends[0] + 1 if ends else len(rows)]
    bodies = [doc.get("response", doc) for _, doc in live if isinstance(doc, dict)]
    bodies = [b for b in bodies if isinstance(b, dict)]
    errors = [b["error"] for b in bodies if isinstance(b.get("error"), dict)]
    usages = [b["usage"] for b in bodies if isinstance(b.get("usage"), dict)]
    states = [state for state, doc in live if state is not None and doc is not None]
    broken = any(state is not None and doc is None for state, doc in live) or any(b.get("usage") is not None and not isinstance(b["usage"], dict) for b in bodies)
    details = [b["incomplete_details"] for b in bodies if isinstance(b.get("incomplete_details"), dict)]

    def first(known, found: list, field: str):
        return known if known is not None else next((x[field] for x in found if isinstance(x.get(field), str)), None)

    return {
        "response_id": first(seen["response_id"], bodies, "id"),
        "model": first(seen["model"], bodies, "model"),
        "error_code": first(seen["error_code"], errors, "code"),
        "usage": json.dumps(usages[-1], separators=(",", ":"), sort_keys=True) if usages else seen["usage"],
        "state": states[-1] if states else seen["state"],
        "status": max(seen["status"], SEVERITY.index("partial") if broken else 0),
        "terminal": seen["terminal"] or bool(ends),
        "events": seen["events"] + len(live),
        "late_events": seen["late_events"] + len(rows) - len(live),
        "incomplete_reason": first(seen["incomplete_reason"], details, "reason"),
        "compaction_output_seen": seen["compaction_output_seen"] or any(_has_compaction(doc) for _, doc in live),
    }


def _has_compaction(value) -> bool:
    """Whether an object of type compaction stands anywhere in a document."""
    open_values = [value]
    while open_values:
        one = open_values.pop()
        if isinstance(one, dict):
            if one.get("type") == "compaction":
                return True
            open_values.extend(one.values())
        elif isinstance(one, list):
            open_values.extend(one)
    return False


NOTHING = dict(response_id=None, model=None, error_code=None, usage=None, state=None, status=0, terminal=False, events=0, late_events=0, incomplete_reason=None, compaction_output_seen=False)


def closed(seen: dict, closing: str) -> dict:
    """The observation of a stream that ended: without a terminal event it takes state and status of its closing."""
    status = seen["status"]
    if not seen["terminal"]:
        state, worse = CLOSINGS[closing]
        return {**seen, "state": state, "status": SEVERITY[max(status, SEVERITY.index(worse))]}
    bare = seen["state"] == "completed" and seen["usage"] is None
    return {**seen, "status": SEVERITY[max(status, SEVERITY.index("partial")) if bare else status]}


OBSERVATION = (
    "attempt_id bigint, response_id string, model string, error_code string, usage string, state string,"
    " status string, terminal boolean, events bigint, late_events bigint, incomplete_reason string, compaction_output_seen boolean"
)


_FOLDED = pa.schema([
    ("attempt_id", pa.int64()), *[(c, pa.string()) for c in ("response_id", "model", "error_code", "usage", "state", "status")], ("terminal", pa.bool_()),
    ("events", pa.int64()), ("late_events", pa.int64()), ("incomplete_reason", pa.string()), ("compaction_output_seen", pa.bool_()), ("fold", pa.string()), ("open", pa.int32()),
])


def observe_stream(chunks: DataFrame, timeout_minutes: int | None = None) -> DataFrame:
    """Stateful fold of a stream of (attempt_id, seq, chunk, closing).

    A row with `closing` set ends its attempt. With a timeout, one that never ends is closed as
    disconnected after that much processing time; a bounded run (availableNow) must go without, since
    waiting timers keep a query alive. Chunks of an attempt arrive in order across batches (a transport keyed
    by attempt gives that) and are ordered by `seq` within a batch.
    """
    def step(key, batches: Iterator[pd.DataFrame], state):
        rest, seen = json.loads(state.get[0]) if state.exists else ("", NOTHING)
        rows = pd.DataFrame() if state.hasTimedOut else pd.concat(list(batches)).sort_values("seq")
        ends = ["disconnect"] if state.hasTimedOut else [c for c in rows["closing"] if isinstance(c, str)]
        text = rest + ("" if state.hasTimedOut else "".join(c for c in rows["chunk"] if isinstance(c, str)))
        events, rest = cut_events(text, final=bool(ends))
        seen = observe(seen, events)
        if ends:
            state.remove()
            yield pd.DataFrame([{"attempt_id": key[0], **closed(seen, ends[-1])}])
            return
        state.update((json.dumps([rest, seen]),))
        if timeout_minutes is not None:
            state.setTimeoutDuration(timeout_minutes * 60_000)

    return chunks.groupBy("attempt_id").applyInPandasWithState(
        step, OBSERVATION, "fold string", "append", "NoTimeout" if timeout_minutes is None else "ProcessingTimeTimeout"
    )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(attempt_id, fold, text, closing) to observations of attempts that ended, and the folds of those that go on."""
    for batch in batches:
        rows = []
        for attempt, fold, text, closing in zip(*(batch.column(c).to_pylist() for c in ("attempt_id", "fold", "text", "closing"))):
            rest, seen = json.loads(fold) if fold is not None else ("", NOTHING)
            events, rest = cut_events(rest + text, final=closing is not None)
            seen = observe(seen, events)
            own = closed(seen, closing) if closing is not None else {"fold": json.dumps([rest, seen])}
            rows.append({"attempt_id": attempt, **own, "open": int(closing is None)})
        yield pa.RecordBatch.from_pylist(rows, schema=_FOLDED)


def observe_to_table(chunks: DataFrame, folder: str) -> DataFrame:
    """The stateful fold over what is available of a stream of (attempt_id, seq, chunk, closing), with the state in tables.

    The rules are those of `observe_stream`, without timeouts. A micro-batch puts the chunks of an attempt in
    order, adds them to the fold that its predecessor left, and writes observations and open folds to a folder of its
    number; so one that is run again writes the same again. An attempt costs a row of a batch, not a call of its own.
    """
    spark = chunks.sparkSession

    def step(arrived: DataFrame, number: int) -> None:
        own = arrived.sparkSession
        rows = arrived.select("attempt_id", "seq", "chunk", "closing", F.lit(None).cast("string").alias("fold"))
        if number:
            none = [F.lit(None).cast(t).alias(c) for c, t in (("seq", "bigint"), ("chunk", "string"), ("closing", "string"))]
            rows = rows.unionByName(own.read.schema(f"{OBSERVATION}, fold string, open int").parquet(f"{folder}/fold/batch={number - 1}").where("open = 1").select("attempt_id", *none, "fold"))
        piece = F.when(F.col("chunk").isNotNull(), F.struct("seq", "chunk"))
        together = rows.groupBy("attempt_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda c: c["chunk"]), "").alias("text"),
            F.max_by("closing", F.when(F.col("closing").isNotNull(), F.col("seq"))).alias("closing"), F.max("fold").alias("fold"),
        )
        found = together.mapInArrow(_folded, f"{OBSERVATION}, fold string, open int")
        found.write.mode("overwrite").partitionBy("open").parquet(f"{folder}/fold/batch={number}")

    query = chunks.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(f"{OBSERVATION}, fold string, open int, batch int").parquet(f"{folder}/fold")
    return written.where("open = 0").drop("fold", "open", "batch")


def first_latencies(events: DataFrame, key: str) -> DataFrame:
    """Time to first event, to first output and to the end; expects event, at_us and started_us."""
    output = F.col("event").contains("output") & (F.col("event").contains("delta") | F.col("event").contains("item"))
    ended = F.col("event").isin(*[k for k, s in STATES.items() if s in TERMINAL])
    return events.groupBy(key).agg(
        (F.min("at_us") - F.min("started_us")).alias("ttfb_us"),
        (F.min(F.when(output, F.col("at_us"))) - F.min("started_us")).alias("ttft_us"),
        (F.min(F.when(ended, F.col("at_us"))) - F.min("started_us")).alias("duration_us"),
    )
