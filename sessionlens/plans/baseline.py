"""The baseline report and the convergence gate over growing cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import count_where
from ..operators import composition, ledger, missing, quality, repetition, usage
from ..session import stored as _stored
from ..sources.trace import Trace


def report_sections(trace: Trace, stored: bool = False) -> dict[str, DataFrame]:
    """Every section of the baseline report as its own lazy frame. Four sections share two small tables of sums over
    fingerprints and content kinds; with `stored` they are derived now, once, and kept in the shared folder."""
    facts, present = repetition.repetition_facts(trace), repetition.presence_facts(trace)
    if stored:
        facts, present = _stored(facts, "repetition"), _stored(present, "presence")
    return {
        "ledger": ledger.ledger_summary(trace),
        "usage": usage.total_usage(trace),
        "quality": quality.measurement_quality(trace),
        "by_kind": composition.subtotal_by(trace.blocks, "kind"),
        "by_role": composition.subtotal_by(trace.blocks, "role"),
        "by_origin": composition.subtotal_by(trace.blocks, "origin"),
        "detected_content": composition.subtotal_by(trace.blocks, "detected_kind"),
        "cross": composition.cross_tab(trace.blocks, ["origin", "kind", "detected_kind"]),
        "estimation_coverage": composition.estimation_coverage(trace.blocks, "detected_kind"),
        "workloads": composition.workload_composition(trace),
        "repetition": repetition.session_repetition(trace, facts, present),
        "persistence": repetition.persistence_distribution(trace, facts),
        "effective_presence": repetition.effective_presence(trace, facts, present),
        "stable_prefix": repetition.stable_prefix(trace),
        "unknown": composition.unknown_report(trace),
        "missingness": missing.missingness(trace),
        "scheduler": missing.scheduler_totals(trace),
        "ranking": repetition.opportunity_ranking(trace, facts=facts, present=present),
    }


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """Numeric cells of the sections in long form: section, name, metric, value."""
    out = None
    for section, frame in sections.items():
        numbers = [n for n, t in frame.dtypes if t in ("bigint", "int", "double")]
        name = next((c for c in ("name", "field", "dimension") if c in frame.columns), None)
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers])
        part = frame.select(
            F.lit(section).alias("section"), (F.col(name) if name else F.lit("all")).alias("name"), F.explode(cells).alias("c")
        ).select("section", "name", "c.*")
        out = part if out is None else out.unionByName(part)
    return out


SHARES = (
    "plain_text_share", "json_share", "unknown_share", "tool_result_share", "tool_definition_share", "exact_repetition_share",
    "semantic_repetition_share", "cached_input_ratio", "stable_prefix_share",
)
SIZES = ("block_size_p50", "block_size_p90")
MIN_SESSIONS, MAX_SESSIONS = 40, 100
SHARE_TOLERANCE, SIZE_TOLERANCE = 0.02, 0.10


def transitions(reports: DataFrame, key: str = "measurement_id") -> DataFrame:
    """Each cohort against the next smaller one: which checks are stable.

    Expects one row per cohort with `sessions`, the share and size columns and `top3`. A check that
    cannot be made (a NULL on either side) does not count against stability.
    """
    order = Window.partitionBy(key).orderBy("sessions")  # a handful of cohorts per measurement
    was = lambda c: F.lag(c).over(order)
    checks: dict[str, Column] = {}
    for name in SHARES:
        checks[name] = F.abs(F.col(name) - was(name)) < SHARE_TOLERANCE
    for name in SIZES:
        now, before = F.col(name), was(name)
        checks[name] = (
            F.when(now == before, True).when((now == 0) | (before == 0), False)
            .otherwise(F.abs(now - before) / F.greatest(F.abs(before), F.abs(now)) < SIZE_TOLERANCE)
        )
    checks["top3"] = F.col("top3").eqNullSafe(was("top3"))
    stable = F.lit(True)
    for check in checks.values():
        stable = stable & F.coalesce(check, F.lit(True))
    return reports.select(
        key, "sessions", was("sessions").alias("previous_sessions"), *[c.alias(f"{n}_stable") for n, c in checks.items()], stable.alias("stable")
    ).where("previous_sessions is not null")


def convergence(reports: DataFrame, strata: DataFrame, key: str = "measurement_id") -> DataFrame:
    """Decision per measurement: converged, or the reasons for more sessions.

    Besides the transition columns, `reports` carries analysis_coverage, correlation_coverage,
    forwarding_errors, context_malformed, integrity and manifest; `strata` lists (key, dimension,
    name, eligible_requests, drop_rate).
    """
    good = (
        F.coalesce(F.col("analysis_coverage") >= 0.95, F.lit(False)) & F.coalesce(F.col("correlation_coverage") >= 0.99, F.lit(False))
        & F.coalesce(F.col("forwarding_errors") == 0, F.lit(False)) & F.coalesce(F.col("context_malformed") == 0, F.lit(False))
        & F.coalesce(F.col("integrity") == "passed", F.lit(False))
    )
    per = reports.groupBy(key).agg(
        F.max("sessions").alias("sessions"), F.count(F.lit(1)).alias("cohorts"), F.bool_and(good).alias("quality_pass"),
        F.coalesce(F.min("manifest") == F.max("manifest"), F.lit(True)).alias("manifest_pass"),
    )
    moves = transitions(reports, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sessions", "stable"))).alias("__m"))
    flagged = strata.where("eligible_requests >= 5 and drop_rate > 0.05").groupBy(key).agg(F.count(F.lit(1)).alias("flagged_strata"))
    joined = per.join(moves, key, "left").join(flagged, key, "left")
    count = F.coalesce(F.size("__m"), F.lit(0))
    last_two = F.when(count >= 2, F.forall(F.slice("__m", -2, 2), lambda m: m["stable"])).otherwise(F.lit(False))
    complete = F.coalesce("flagged_strata", F.lit(0)) == 0
    done = (F.col("sessions") >= MIN_SESSIONS) & (count >= 2) & F.col("quality_pass") & F.col("manifest_pass") & complete & last_two
    reasons = F.array_compact(
        F.array(
            F.when(F.col("sessions") < MIN_SESSIONS, "minimum_cohort_size"),
            F.when(count < 2, "two_transitions_required"),
            F.when(~F.col("quality_pass"), "quality_gate_failed"),
            F.when(~F.col("manifest_pass"), "manifests_differ"),
            F.when(~complete, "missingness_in_stratum"),
            F.when((count >= 1) & ~F.get("__m", count - 1)["stable"], "latest_transition_unstable"),
            F.when((count >= 2) & ~last_two, "last_two_transitions_unstable"),
            F.when((F.col("sessions") >= MAX_SESSIONS) & ~done, "maximum_cohort_reached"),
        )
    )
    return joined.select(
        key, "sessions", "cohorts", "quality_pass", "manifest_pass", F.coalesce("flagged_strata", F.lit(0)).alias("flagged_strata"),
        F.when(done, "CONVERGED").otherwise("NEED_MORE_SESSIONS").alias("status"), reasons.alias("reasons"),
    )


def stable_share(trans: DataFrame, key: str = "measurement_id") -> DataFrame:
    """Stable transitions per measurement."""
    return trans.groupBy(key).agg(F.count(F.lit(1)).alias("transitions"), count_where(F.col("stable")).alias("stable"))
