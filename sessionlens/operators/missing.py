"""Where analysis is missing: coverage by strata, scheduler evidence and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import analysis_eligible, quartile_label
from ..functions.measures import count_where, or_unknown, ratio
from ..functions.ranking import Rank, distribution, exact_percentiles, numbered
from ..session import stored as kept
from ..sources.trace import Trace
from .ledger import request_ledger

QUARTILES = [Rank("q1", 0.25), Rank("q2", 0.50), Rank("q3", 0.75)]


#: Requests of a session that one task may number.
LARGE_SESSION = 1 << 18


def turns(rows: DataFrame) -> DataFrame:
    """`rows` (session_id, request_id, ...) with `turn_index`, their place in the session, and `session_request_count`. They
    are read four times."""
    counts = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("session_request_count"))
    indexed = numbered(
        rows, ["session_id"], [F.col("request_id").asc()], "turn_index",
        F.floor(F.col("request_id").cast("bigint") / 4096), most=LARGE_SESSION,
    )
    return indexed.join(counts, "session_id", "left")


def turn_index(trace: Trace, stored: bool = False) -> DataFrame:
    """(request_id, turn_index, session_request_count) of the rows of `strata`, from requests and their sessions alone:
    what `strata` joins from snapshots, drop events and blocks neither adds nor drops a request. With `stored` the
    requests are derived now, once."""
    sessions = trace.operations.select("operation_id", "session_id")
    rows = trace.requests.join(sessions, "operation_id", "left").where(analysis_eligible()).select("request_id", "session_id")
    rows = kept(rows, "requests") if stored else rows
    labels = trace.workloads.select("session_id")
    return turns(rows).join(labels, "session_id", "left").select("request_id", "turn_index", "session_request_count")


def strata(trace: Trace, stored: bool = False) -> DataFrame:
    """Eligible requests with outcome and their labels in eight dimensions. With `stored` the requests, which are read
    six times, are derived now, once."""
    ledger = request_ledger(trace).where("eligible")
    visible = trace.blocks.groupBy("snapshot_id").agg(F.sum("estimated_tokens").alias("visible"))
    rows = ledger.join(visible, "snapshot_id", "left").select(
        "request_id", "session_id", "outcome", "request_kind", "request_bytes", "visible", "observation_status"
    )
    rows = kept(rows, "strata") if stored else rows
    cuts = lambda column, prefix: exact_percentiles(rows, [], column, QUARTILES).select(
        *[F.col(q).alias(f"{prefix}_{q}") for q in ("q1", "q2", "q3")]
    )
    labels = trace.workloads.select("session_id", "workload", "concurrency_mode")
    return (
        turns(rows)
        .join(labels, "session_id", "left")
        .crossJoin(F.broadcast(cuts("request_bytes", "r")))
        .crossJoin(F.broadcast(cuts("visible", "c")))
        .select(
            "request_id", "outcome", "request_kind",
            quartile_label("request_bytes", F.col("r_q1"), F.col("r_q2"), F.col("r_q3")).alias("request_size_quartile"),
            quartile_label("visible", F.col("c_q1"), F.col("c_q2"), F.col("c_q3")).alias("context_size_quartile"),
            "turn_index", "session_request_count", "observation_status", "workload", "concurrency_mode",
        )
    )


DIMENSIONS = (
    "request_kind", "request_size_quartile", "context_size_quartile", "turn_index", "session_request_count",
    "observation_status", "workload", "concurrency_mode",
)


def missingness(trace: Trace, stored: bool = False) -> DataFrame:
    """Coverage and drop rate in every stratum of every dimension.

    One pass: rows are unpivoted into (dimension, label) after a first fold to distinct label
    combinations, so the unpivot works on folded rows.
    """
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), or_unknown(d).alias("name")) for d in DIMENSIONS]
    )
    folded = strata(trace, stored).groupBy("outcome", *DIMENSIONS).agg(F.count(F.lit(1)).alias("n"))
    long = folded.select("outcome", "n", F.explode(pairs).alias("p")).select("outcome", "n", "p.*")
    total = lambda outcome: F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("n"))), F.lit(0))
    grouped = long.groupBy("dimension", "name").agg(
        F.sum("n").alias("eligible_requests"),
        total("Complete").alias("complete_requests"),
        total("Partial").alias("partial_requests"),
        total("Dropped").alias("dropped_requests"),
    )
    return grouped.select(
        "*",
        ratio("complete_requests", "eligible_requests").alias("request_coverage"),
        ratio("dropped_requests", "eligible_requests").alias("drop_rate"),
    )


def _alias(*names: str):
    return F.coalesce(*names) if len(names) > 1 else F.col(names[0])


SCHEDULER_FIELDS = ("high_water_items", "high_water_bytes", "analysis_wait_us", "drain_duration_us")


def scheduler_totals(trace: Trace) -> DataFrame:
    """Totals, rates, field coverage and counter consistency of the scheduler sidecars, as one row."""
    ledger = request_ledger(trace)
    outcomes = ledger.agg(
        count_where(F.col("eligible")).alias("eligible_requests"),
        count_where(F.col("outcome") == "Dropped").alias("dropped_requests"),
    )
    selected = trace.sidecars.join(trace.sessions.select("session_id"), "session_id", "left_semi")
    totals = selected.agg(
        F.count(F.lit(1)).alias("sessions_with_metrics"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("analysis_admitted_total", "deferred_total", "processed_deferred_total", "backlog_capacity_drops")
        ],
        *[
            F.count(c).alias(f"{c}_observed")
            for c in ("high_water_items", "analysis_wait_us", "deferred_total", "drain_duration_us")
        ],
        F.count("analysis_requests_seen").alias("__seen_rows"),
        F.coalesce(F.sum("analysis_requests_seen"), F.lit(0)).alias("analysis_requests_seen"),
    )
    consistent = (
        (F.col("sessions_with_metrics") > 0)
        & (F.col("__seen_rows") == F.col("sessions_with_metrics"))
        & (F.col("analysis_requests_seen") == F.col("eligible_requests"))
    )
    return totals.crossJoin(outcomes).select(
        *[c for c in totals.columns if not c.startswith("__")],
        "eligible_requests",
        ratio("deferred_total", "eligible_requests").alias("deferral_rate"),
        ratio("dropped_requests", "eligible_requests").alias("loss_rate"),
        (F.col("analysis_requests_seen") - F.col("eligible_requests")).alias("seen_delta"),
        consistent.alias("counters_consistent"),
    )


def scheduler_distributions(trace: Trace) -> DataFrame:
    """Distribution of each scheduler metric over sessions (long form)."""
    selected = trace.sidecars.join(trace.sessions.select("session_id"), "session_id", "left_semi")
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in SCHEDULER_FIELDS])
    long = selected.select(F.explode(pairs).alias("p")).select("p.*")
    return distribution(long, ["metric"], "value")


def sidecar_audit(trace: Trace, selected: DataFrame | None = None, instrument_version: int = 2) -> DataFrame:
    """Audit sidecar counters against the ledger, one row per selected session.

    Capture gaps stay gaps (they are not filled with zero) and every unexplained difference is a
    mismatch. The status is the first that applies.
    """
    selected = trace.sessions.select("session_id") if selected is None else selected
    ledger = request_ledger(trace).where("eligible")
    per_session = ledger.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("eligible_requests"),
        count_where((F.col("snapshot_status") == "complete") & F.col("snapshot_id").isNotNull()).alias("complete_snapshots"),
    )
    fields = [c for c in trace.sidecars.columns if c not in ("session_id", "workload", "concurrency_mode")]
    # A session reports once; the first record stands and further ones only mark a duplicate.
    first = trace.sidecars.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("records"), F.min(F.struct(*(["copy"] if "copy" in fields else []), *[f for f in fields if f != "copy"])).alias("r")
    ).select("session_id", "records", *[F.col(f"r.{f}").alias(f) for f in fields])
    joined = (
        selected.join(per_session, "session_id", "left")
        .join(first, "session_id", "left")
        .withColumn("eligible_requests", F.coalesce("eligible_requests", F.lit(0)))
        .withColumn("complete_snapshots", F.coalesce("complete_snapshots", F.lit(0)))
    )
    admitted, seen = F.col("analysis_admitted_total"), F.col("analysis_requests_seen")
    processed = F.col("processed_deferred_total") + F.col("backlog_capacity_drops")
    eligible = F.col("eligible_requests")
    missing_counters = F.array_compact(
        F.array(*[
            F.when(F.col(c).isNull(), F.lit(c))
            for c in ("analysis_admitted_total", "analysis_requests_seen", "processed_deferred_total", "backlog_capacity_drops")
        ])
    )
    missing_fields = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("high_water_items", "high_water_bytes", "analysis_wait_us")])
    )
    identity = F.array_compact(
        F.array(
            F.when(F.coalesce("measurement_run_id", F.lit("")) == "", F.lit("measurement_run_id")),
            F.when(F.coalesce("agent_pid", F.lit(0)) <= 0, F.lit("agent_pid")),
            F.when(~F.coalesce("capture_complete", F.lit(False)), F.lit("capture_complete")),
        )
    ) if instrument_version >= 2 else F.expr("cast(array() as array<string>)")
    note = F.coalesce("scheduler_capture_note", F.lit(""))
    capture_issue = (
        (note != "") | (F.size(missing_fields) > 0) | ~F.coalesce("capture_complete", F.lit(True)) | (F.size(identity) > 0)
    )
    counter_issue = (
        (F.size(missing_counters) > 0)
        | F.coalesce(admitted != eligible, F.lit(False))
        | F.coalesce(seen != eligible, F.lit(False))
        | F.coalesce(processed != admitted, F.lit(False))
    )
    present = F.col("records").isNotNull()
    status = (
        F.when(~present, "sidecar_missing")
        .when(F.size(identity) > 0, "legacy_uncertified")
        .when(F.col("records") > 1, "sidecar_duplicate")
        .when(capture_issue, "harness_collection_failure")
        .when(counter_issue, "counter_mismatch")
        .otherwise("passed")
    )
    capture = (
        F.when(~present, "sidecar_missing")
        .when(F.size(identity) > 0, "legacy_uncertified")
        .when(F.lower(note).contains("shutdown"), "shutdown_before_capture")
        .when(capture_issue, "harness_collection_failure")
        .otherwise("complete")
    )
    return joined.select(
        "session_id", "eligible_requests", "complete_snapshots", present.alias("sidecar_present"),
        status.alias("status"), capture.alias("capture_classification"),
        F.when(present, missing_counters).alias("missing_counter_fields"),
        F.when(present, missing_fields).alias("missing_capture_fields"),
        F.when(present, identity).alias("missing_identity_fields"),
        (admitted - eligible).alias("admitted_delta"),
        (seen - eligible).alias("seen_delta"),
        (processed - admitted).alias("processed_delta"),
    )


def sidecar_audit_summary(trace: Trace) -> DataFrame:
    """Sessions per audit status."""
    return sidecar_audit(trace).groupBy("status").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("eligible_requests").alias("eligible_requests")
    )
