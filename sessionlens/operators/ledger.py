"""Request ledger: one exclusive analysis outcome per request, its conflicts and its audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import analysis_eligible
from ..functions.measures import count_where, ratio
from ..sources.trace import Trace


def payload_objects(events: DataFrame) -> DataFrame:
    """Decode payloads to VARIANT; text that is not a JSON object reads as an empty object."""
    parsed = F.try_parse_json(F.col("payload").cast("string"))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return events.withColumn(
        "object", F.when(F.coalesce(is_object, F.lit(False)), parsed).otherwise(F.parse_json(F.lit("{}")))
    )


def _text(path: str) -> Column:
    """A payload field as text, NULL when absent or empty."""
    return F.nullif(F.try_variant_get("object", path, "string"), F.lit(""))


def _texts(path: str) -> Column:
    """A payload field that may be one value or a list, as an array of texts."""
    listed = F.try_variant_get("object", path, "array<string>")
    return F.coalesce(listed, F.array(_text(path)))


def drop_weight() -> Column:
    """Declared work of a drop event: default 1, a bad value counts as 1, never negative."""
    declared = F.try_variant_get("object", "$.dropped_count", "string")
    whole = F.when(declared.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.expr("try_cast(trim(try_variant_get(object, '$.dropped_count', 'string')) as bigint)"))
    return F.when(whole.isNull(), F.lit(1)).otherwise(F.greatest(whole, F.lit(0)))


def drop_events(events: DataFrame) -> DataFrame:
    """Context drop events with reason, weight, request ids and terminal flag (metadata only)."""
    chosen = events.where(
        F.col("event_type").startswith("context.analysis.") & F.col("event_type").endswith(".dropped")
    )
    ids = F.array_distinct(
        F.filter(
            F.concat(
                _texts("$.provider_request_id"), _texts("$.request_id"), _texts("$.provider_request_ids"),
                _texts("$.request_ids"), F.array(_text("$.request.request_id")),
                F.array(_text("$.request.provider_request_id")),
            ),
            lambda name: name.isNotNull() & (name != ""),
        )
    )
    flag = F.lower(F.trim(F.coalesce(_text("$.terminal"), F.lit(""))))
    return payload_objects(chosen).select(
        "seq",
        F.coalesce(_text("$.session_id"), F.col("session_id").cast("string")).alias("session_id"),
        F.coalesce(_text("$.reason"), F.lit("unknown")).alias("reason"),
        drop_weight().alias("dropped_work"),
        ids.alias("request_ids"),
        _text("$.forward_id").alias("forward_id"),
        (flag.isin("1", "true", "yes", "terminal")
         | F.coalesce(_text("$.outcome").isin("drop", "dropped"), F.lit(False))).alias("terminal"),
    )


def event_type_counts(events: DataFrame) -> DataFrame:
    """Events per type."""
    return events.groupBy(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown")).alias("event_type")).agg(
        F.count(F.lit(1)).alias("events")
    )


def drop_reason_counts(events: DataFrame) -> DataFrame:
    """Events and weighted dropped work per reason, over drop and partial events.

    A reason counts as an event only when the payload states it; work without a reason is `unknown`.
    """
    touched = payload_objects(
        events.where(F.col("event_type").contains("drop") | F.col("event_type").contains("partial"))
    )
    reason = _text("$.reason")
    return touched.groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(
        F.count(reason).alias("events"),
        F.coalesce(
            F.sum(F.when(F.col("event_type") == "context.analysis.dropped", drop_weight())), F.lit(0)
        ).alias("dropped_work"),
    )


def request_ledger(trace: Trace) -> DataFrame:
    """Exactly one outcome per request: Complete, Partial, Dropped or Ineligible.

    Every step is keyed by request id and pre-aggregated before it is joined, so a request with very
    many snapshots or drop events costs one partial aggregate per task, not one large group.
    """
    sessions = trace.operations.select("operation_id", "session_id")
    requests = trace.requests.join(sessions, "operation_id", "left").select(
        "request_id", "session_id", "request_kind", "request_bytes", "observation_status",
        analysis_eligible().alias("eligible"),
    )
    terminal = F.col("completed_at_us").isNotNull() | F.col("recovered_at_us").isNotNull()
    # Terminal snapshots win; among them (or else among all) a missing completion time sorts last.
    rank = F.struct(
        terminal.alias("terminal"),
        F.col("completed_at_us").isNull().alias("open"),
        F.coalesce("completed_at_us", F.lit(0)).alias("completed"),
        F.col("snapshot_id").alias("id"),
    )
    chosen = (
        trace.snapshots.where(F.col("provider_request_id").isNotNull())
        .groupBy(F.col("provider_request_id").alias("request_id"))
        .agg(
            count_where(terminal).alias("terminal_snapshots"),
            F.max_by(
                F.struct("snapshot_id", "status", "correlation_status", "completed_at_us"), rank
            ).alias("s"),
        )
    )
    drops = _matched_drops(trace, requests).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("drop_events"),
        F.sum("dropped_work").alias("drop_work"),
        F.array_sort(F.collect_set("reason")).alias("drop_reasons"),  # a closed set of reasons
        F.sum(F.col("terminal").cast("bigint")).alias("terminal_drops"),
    )
    eligible = F.col("eligible")
    status = F.when(eligible, F.col("s.status"))
    settled = F.col("terminal_snapshots") > 0
    outcome = (
        F.when(~eligible, "Ineligible")
        .when(F.col("s").isNull() | ~settled, "Dropped")
        .when(F.coalesce("s.status", F.lit("unknown")) == "complete", "Complete")
        .otherwise("Partial")
    )
    return (
        requests.join(chosen, "request_id", "left")
        .join(drops, "request_id", "left")
        .select(
            "request_id", "session_id", "request_kind", "request_bytes", "observation_status", "eligible",
            F.when(eligible, F.col("s.snapshot_id")).alias("snapshot_id"),
            status.alias("snapshot_status"),
            F.when(eligible, F.col("s.correlation_status")).alias("correlation_status"),
            F.when(eligible, F.col("s.completed_at_us")).alias("completed_at_us"),
            F.when(eligible, F.coalesce("terminal_snapshots", F.lit(0))).otherwise(F.lit(0)).alias("terminal_snapshots"),
            outcome.alias("outcome"),
            F.when(outcome == "Dropped", F.when(F.col("s").isNull(), "missing_snapshot").otherwise("non_terminal_snapshot")).alias(
                "outcome_note"
            ),
            F.coalesce("drop_events", F.lit(0)).alias("drop_events"),
            F.coalesce("drop_work", F.lit(0)).alias("drop_work"),
            F.coalesce("drop_reasons", F.expr("cast(array() as array<string>)")).alias("drop_reasons"),
            F.coalesce("terminal_drops", F.lit(0)).alias("terminal_drops"),
        )
    )


def _exploded_drops(trace: Trace) -> DataFrame:
    return drop_events(trace.events).select(
        "seq", "reason", "dropped_work", "terminal", F.size("request_ids").alias("named"),
        F.explode_outer("request_ids").alias("named_id"),
    )


def _matched_drops(trace: Trace, requests: DataFrame) -> DataFrame:
    """Drop events expanded to the eligible requests they name."""
    eligible = requests.where("eligible").select("request_id", F.col("request_id").cast("string").alias("named_id"))
    return _exploded_drops(trace).join(eligible, "named_id")


def drop_match_counts(trace: Trace) -> DataFrame:
    """Per drop event: how many of the named requests are eligible requests."""
    requests = trace.requests.select("request_id", analysis_eligible().alias("eligible"))
    eligible = requests.where("eligible").select(
        F.col("request_id").cast("string").alias("named_id"), F.lit(1).alias("hit")
    )
    return (
        _exploded_drops(trace)
        .join(eligible, "named_id", "left")
        .groupBy("seq")
        .agg(
            F.first("dropped_work").alias("dropped_work"),
            F.first("named").alias("named"),
            F.count("hit").alias("matched"),
        )
    )


def ledger_conflicts(trace: Trace, ledger: DataFrame | None = None) -> DataFrame:
    """Conflicts in long form: kind, occurrences and distinct requests involved."""
    ledger = request_ledger(trace) if ledger is None else ledger
    known = trace.requests.select("request_id", analysis_eligible().alias("eligible"))
    snapshots = trace.snapshots.select(F.col("provider_request_id").alias("request_id")).join(
        known, "request_id", "left"
    )
    orphan = snapshots.select(
        F.when(F.col("eligible").isNull(), "snapshot_without_provider_request")
        .when(~F.col("eligible"), "snapshot_for_ineligible_request")
        .alias("kind"),
        F.col("request_id").cast("string").alias("request_id"),
        F.lit(1).cast("bigint").alias("times"),
    )
    open_complete = (F.coalesce("snapshot_status", F.lit("unknown")) == "complete") & F.col("completed_at_us").isNull()
    conflicts = F.filter(
        F.array(
            F.when(F.col("terminal_snapshots") > 1, F.struct(F.lit("multiple_terminal_snapshots").alias("kind"), F.lit(1).cast("bigint").alias("times"))),
            F.when(open_complete & F.col("snapshot_id").isNotNull(), F.struct(F.lit("complete_snapshot_without_completion_timestamp").alias("kind"), F.lit(1).cast("bigint").alias("times"))),
            F.when(F.col("outcome_note") == "non_terminal_snapshot", F.struct(F.lit("non_terminal_snapshot").alias("kind"), F.lit(1).cast("bigint").alias("times"))),
            F.when((F.col("terminal_drops") > 0) & (F.col("outcome") != "Dropped"), F.struct(F.lit("terminal_drop_conflicts_with_snapshot").alias("kind"), F.col("terminal_drops").alias("times"))),
        ),
        lambda c: c.isNotNull(),
    )
    inside = ledger.where("eligible").select(F.col("request_id").cast("string").alias("request_id"), F.explode(conflicts).alias("c")).select(
        "c.kind", "request_id", "c.times"
    )
    events = drop_match_counts(trace).select(
        F.when(F.col("matched") == 0, "drop_without_identifiable_eligible_request")
        .when(F.col("matched") != F.col("named"), "drop_references_unknown_or_ineligible_request")
        .alias("kind"),
        F.lit(None).cast("string").alias("request_id"),
        F.lit(1).cast("bigint").alias("times"),
    )
    every = orphan.where("kind is not null").unionByName(inside).unionByName(events.where("kind is not null"))
    per_request = every.groupBy("kind", "request_id").agg(F.sum("times").alias("times"))
    return per_request.groupBy("kind").agg(
        F.sum("times").alias("conflicts"), F.count("request_id").alias("requests")
    )


def ledger_summary(trace: Trace) -> DataFrame:
    """Outcome counts, coverage, drop evidence and the integrity verdict, as one row."""
    ledger = request_ledger(trace)
    outcomes = ledger.agg(
        F.count(F.lit(1)).alias("requests"),
        count_where(F.col("eligible")).alias("eligible_requests"),
        count_where(F.col("outcome") == "Complete").alias("complete_requests"),
        count_where(F.col("outcome") == "Partial").alias("partial_requests"),
        count_where(F.col("outcome") == "Dropped").alias("dropped_requests"),
    )
    matches = drop_match_counts(trace)
    unmatched = (F.col("matched") == 0) | (F.col("matched") != F.col("named"))
    drops = matches.agg(
        F.count(F.lit(1)).alias("auxiliary_drop_events"),
        F.coalesce(F.sum("dropped_work"), F.lit(0)).alias("auxiliary_drop_work"),
        count_where(unmatched).alias("unmatched_events"),
        F.coalesce(F.sum(F.when(unmatched, F.col("dropped_work"))), F.lit(0)).alias("unmatched_drop_work"),
    )
    conflicts = ledger_conflicts(trace, ledger).agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"))
    partition = F.col("eligible_requests") == (
        F.col("complete_requests") + F.col("partial_requests") + F.col("dropped_requests")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("conflicts") > 0, "analysis_outcome_conflicts"),
            F.when(F.col("unmatched_events") > 0, "unmatched_drop_events"),
            F.when(~partition, "invalid_outcome_partition"),
        )
    )
    return outcomes.crossJoin(drops).crossJoin(conflicts).select(
        "requests", "eligible_requests", "complete_requests", "partial_requests", "dropped_requests",
        (F.col("requests") - F.col("eligible_requests")).alias("ineligible_requests"),
        "auxiliary_drop_events", "auxiliary_drop_work", "unmatched_events", "unmatched_drop_work",
        ratio("complete_requests", "eligible_requests").alias("request_coverage"),
        "conflicts", partition.alias("outcome_partition_valid"),
        F.when(F.size(reasons) == 0, "passed").otherwise("failed").alias("measurement_integrity"),
        reasons.alias("integrity_reasons"),
    )


def orphans(trace: Trace) -> DataFrame:
    """Snapshots without a request and requests without an attempt."""
    snapshots = trace.snapshots.select(F.col("provider_request_id").alias("id"), "snapshot_id")
    lost = snapshots.join(trace.requests.select(F.col("request_id").alias("id")), "id", "left_anti").select(
        F.lit("snapshot_without_request").alias("problem"), F.col("snapshot_id").alias("id")
    )
    bare = trace.requests.select(F.col("request_id").alias("id")).join(
        trace.attempts.select(F.col("request_id").alias("id")), "id", "left_anti"
    ).select(F.lit("request_without_attempt").alias("problem"), "id")
    return lost.unionByName(bare)


def lifecycle_counts(trace: Trace) -> DataFrame:
    """Lifecycle counters: snapshots, requests with a snapshot, orphans, terminal and drop counts."""
    terminal = F.col("completed_at_us").isNotNull() | F.col("recovered_at_us").isNotNull()
    snapshots = trace.snapshots.agg(
        F.count(F.lit(1)).alias("snapshots"),
        count_where(terminal).alias("terminal_snapshots"),
        count_where(F.col("status") == "complete").alias("complete_snapshots"),
        count_where(F.col("status") == "partial").alias("partial_snapshots"),
        count_where(F.col("status") == "dropped").alias("dropped_snapshots"),
    )
    ids = trace.snapshots.select("provider_request_id").where("provider_request_id is not null").distinct()
    covered = ids.agg(F.count(F.lit(1)).alias("distinct_requests"))
    lost = trace.snapshots.join(
        trace.requests.select(F.col("request_id").alias("provider_request_id")), "provider_request_id", "left_anti"
    ).agg(F.count(F.lit(1)).alias("orphan_snapshots"))
    requests = trace.requests.agg(F.count(F.lit(1)).alias("requests"))
    events = drop_events(trace.events).agg(
        F.count(F.lit(1)).alias("drop_events"),
        count_where(F.col("reason") == "observer_backpressure").alias("backpressure_events"),
        F.coalesce(F.sum("dropped_work"), F.lit(0)).alias("dropped_work"),
    )
    return snapshots.crossJoin(covered).crossJoin(lost).crossJoin(requests).crossJoin(events)


def lifecycle_violations(trace: Trace) -> DataFrame:
    """One row per violated lifecycle invariant."""
    c = F.col
    checks = [
        ("snapshots_not_partitioned", c("snapshots") != c("complete_snapshots") + c("partial_snapshots") + c("dropped_snapshots")),
        ("more_snapshot_ids_than_requests", c("distinct_requests") > c("requests")),
        ("orphan_snapshots", c("orphan_snapshots") > 0),
        ("drops_without_events", (c("dropped_snapshots") > 0) & (c("drop_events") == 0)),
    ]
    rows = F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])
    return lifecycle_counts(trace).select(F.explode(F.array_compact(rows)).alias("violation"))
