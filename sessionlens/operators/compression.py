"""Reports over reduction candidates: experiments, compressors, histograms, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import compressor_family
from ..functions.measures import basis_points, count_where, or_unknown, ratio
from ..functions.ranking import Rank, exact_percentiles, group_counts, join_on_nullable
from ..sources.trace import Trace



def _applicable() -> Column:
    return F.col("status") == "applicable"


def experiment_summary(trace: Trace) -> DataFrame:
    """One row per experiment: counters, candidates, distinct blocks and distinct sessions.

    Distinct counts are two-level aggregates: duplicates fold map-side before the final count.
    """
    candidates = trace.candidates.select("experiment_id", "block_id", "snapshot_id")
    placed = candidates.join(trace.snapshots.select("snapshot_id", "session_id"), "snapshot_id", "left").join(
        trace.sessions.select(F.col("session_id"), F.lit(True).alias("__known")), "session_id", "left"
    )
    volume = candidates.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    blocks = (
        candidates.where(F.col("block_id").isNotNull()).groupBy("experiment_id", "block_id").agg(F.lit(1).alias("x"))
        .groupBy("experiment_id").agg(F.count(F.lit(1)).alias("block_count"))
    )
    sessions = (
        placed.where("__known").groupBy("experiment_id", "session_id").agg(F.lit(1).alias("x"))
        .groupBy("experiment_id").agg(F.count(F.lit(1)).alias("session_count"))
    )
    out = trace.experiments
    for part, name in ((volume, "candidate_count"), (blocks, "block_count"), (sessions, "session_count")):
        out = out.join(part, "experiment_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def compressor_totals(candidates: DataFrame) -> DataFrame:
    """Per experiment and compressor: applicability, gated sums, recovery, risk and addressable share."""
    applied = _applicable()
    when_applied = lambda column: F.sum(F.when(applied, F.col(column)))
    attempted = F.col("output_bytes").isNotNull()
    recoverable = F.col("reversible") & attempted
    risk = lambda level: count_where(F.col("cache_risk") == level).alias(f"cache_risk_{level}")
    totals = candidates.groupBy("experiment_id", "compressor_id", "compressor_version").agg(
        F.count(F.lit(1)).alias("eligible_blocks"),
        count_where(applied).alias("applicable_blocks"),
        when_applied("input_bytes").alias("input_bytes"),
        when_applied("output_bytes").alias("output_bytes"),
        when_applied("bytes_delta").alias("byte_reduction"),
        when_applied("input_tokens").alias("input_tokens"),
        when_applied("output_tokens").alias("output_tokens"),
        when_applied("token_delta").alias("token_reduction"),
        count_where(recoverable & F.col("recovery_verified")).alias("__recovered"),
        count_where(recoverable).alias("__recoverable"),
        count_where(attempted & F.col("deterministic")).alias("__deterministic"),
        count_where(attempted).alias("__attempted"),
        risk("low"), risk("medium"), risk("high"), risk("unknown"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("__all_tokens"),
        F.max("provider_readability").alias("provider_readability"),
    )
    return totals.select(
        "experiment_id", "compressor_id", "compressor_version",
        compressor_family("compressor_id").alias("tool_family"),
        "eligible_blocks", "applicable_blocks",
        basis_points("applicable_blocks", "eligible_blocks").alias("applicability_bp"),
        basis_points(F.coalesce("input_tokens", F.lit(0)), "__all_tokens").alias("addressable_token_share_bp"),
        F.coalesce("provider_readability", F.lit("unknown")).alias("provider_readability"),
        "input_bytes", "output_bytes", "byte_reduction",
        basis_points("byte_reduction", "input_bytes").alias("byte_reduction_bp"),
        "input_tokens", "output_tokens", "token_reduction",
        basis_points("token_reduction", "input_tokens").alias("token_reduction_bp"),
        basis_points("__recovered", "__recoverable").alias("recovery_bp"),
        basis_points("__deterministic", "__attempted").alias("deterministic_bp"),
        "cache_risk_low", "cache_risk_medium", "cache_risk_high", "cache_risk_unknown",
    )


def latency_percentiles(candidates: DataFrame) -> DataFrame:
    """Floor-rank processing time per experiment and compressor."""
    ranks = [Rank(f"processing_p{p}_us", p, "floor_int") for p in (50, 90, 95, 99)]
    return exact_percentiles(candidates, ["experiment_id", "compressor_id"], "processing_us", ranks).drop("count")


def _median_reduction(candidates: DataFrame, delta: str, base: str, name: str) -> DataFrame:
    """Reduction share of the row in the middle of the rows ordered by absolute reduction."""
    keys = ["experiment_id", "compressor_id"]
    rows = candidates.where(_applicable() & F.col(delta).isNotNull())
    middle = exact_percentiles(rows, keys, delta, [Rank("__middle", 50, "floor_int")]).drop("count")
    share = F.least(
        F.lit(10000).cast("bigint"),
        F.expr(f"case when {base} <> 0 then ({delta} * 10000) div {base} end"),
    )
    # Several rows may share the middle reduction; the lowest share of them is taken, so that the
    # result does not depend on the order of equal rows.
    at_middle = rows.join(middle, keys).where(F.col(delta) == F.col("__middle"))
    return at_middle.groupBy(*keys).agg(F.min(share).alias(name))


def unique_reductions(candidates: DataFrame) -> DataFrame:
    """Reduction counted once per original content: greatest per fingerprint, then summed."""
    per_content = candidates.where(_applicable()).groupBy("experiment_id", "compressor_id", "original_fp").agg(
        F.max("bytes_delta").alias("b"), F.max("token_delta").alias("t")
    )
    return per_content.groupBy("experiment_id", "compressor_id").agg(
        F.sum("b").alias("unique_byte_reduction"), F.sum("t").alias("unique_token_reduction")
    )


def compressor_summary(trace: Trace) -> DataFrame:
    """Totals, medians, latency ranks and unique reductions per experiment and compressor."""
    candidates = trace.candidates
    keys = ["experiment_id", "compressor_id"]
    return (
        compressor_totals(candidates)
        .join(latency_percentiles(candidates), keys, "left")
        .join(_median_reduction(candidates, "bytes_delta", "input_bytes", "median_byte_reduction_bp"), keys, "left")
        .join(_median_reduction(candidates, "token_delta", "input_tokens", "median_token_reduction_bp"), keys, "left")
        .join(unique_reductions(candidates), keys, "left")
    )


# Histogram edges as (label, lower inclusive).
REDUCTION_EDGES = (("0-4%", 0), ("5-14%", 500), ("15-29%", 1500), ("30-49%", 3000), (">=50%", 5000))
LATENCY_EDGES = (("<100 us", 0), ("100-499 us", 100), ("500-999 us", 500), ("1-5 ms", 1000), (">=5 ms", 5000))


def _histogram(candidates: DataFrame, value: Column, edges) -> DataFrame:
    """Count per fixed bucket; empty buckets stay in with zero."""
    label = F.lit(None).cast("string")
    for name, lower in edges:
        label = F.when(value >= lower, F.lit(name)).otherwise(label)
    counts = candidates.select("experiment_id", label.alias("label")).where("label is not null").groupBy(
        "experiment_id", "label"
    ).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(lo).cast("bigint").alias("lower")) for n, lo in edges])
    grid = candidates.select("experiment_id").distinct().select("experiment_id", F.explode(rows).alias("e")).select(
        "experiment_id", "e.label", "e.lower"
    )
    return grid.join(counts, ["experiment_id", "label"], "left").select(
        "experiment_id", "label", "lower", F.coalesce("n", F.lit(0)).alias("count")
    )


def reduction_histogram(candidates: DataFrame) -> DataFrame:
    share = F.expr("case when status = 'applicable' and input_bytes > 0 then (bytes_delta * 10000) div input_bytes end")
    return _histogram(candidates, share, REDUCTION_EDGES)


def latency_histogram(candidates: DataFrame) -> DataFrame:
    return _histogram(candidates, F.col("processing_us"), LATENCY_EDGES)


def candidate_rows(trace: Trace) -> DataFrame:
    """Candidates with their block and the number of blocks sharing its exact fingerprint."""
    counts = group_counts(trace.blocks.where(F.col("exact_fp").isNotNull()), F.col("exact_fp"), "persistence")
    blocks = trace.blocks.select("block_id", "ordinal", "kind", "origin", "detected_kind", "exact_fp")
    return (
        trace.candidates.join(blocks, "block_id")
        .join(counts, F.col("exact_fp") == F.col("persistence_key"), "left")
        .select(
            "candidate_id", "experiment_id", "snapshot_id", "ordinal", "kind", "origin", "detected_kind",
            "compressor_id", "status", "input_bytes", "output_bytes", "bytes_delta", "token_delta", "cache_risk",
            (F.col("persistence") > 1).alias("exact_repetition"), "persistence",
        )
    )


def status_matrix(candidates: DataFrame) -> DataFrame:
    """Candidates per compressor and status."""
    return candidates.groupBy("compressor_id", "status").agg(F.count(F.lit(1)).alias("candidates"))


def forecast(candidates: DataFrame) -> DataFrame:
    """Eligible and applicable candidates and the tokens they address, per compressor."""
    applied = _applicable()
    return candidates.groupBy("compressor_id").agg(
        F.count(F.lit(1)).alias("eligible"),
        count_where(applied).alias("applicable"),
        F.coalesce(F.sum(F.when(applied, F.col("input_tokens"))), F.lit(0)).alias("applicable_tokens"),
    )


def script_compressor_report(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregate per key with medians of per-row ratios (interpolated) and unique sums."""
    applied = _applicable()
    rows = candidates.withColumn(
        "__byte_ratio", F.when(applied, ratio("bytes_delta", "input_bytes"))
    ).withColumn("__token_ratio", F.when(applied, ratio("token_delta", "input_tokens")))
    unique = (
        rows.where(applied).groupBy(*keys, "original_fp")
        .agg(F.max("bytes_delta").alias("b"), F.max("token_delta").alias("t"))
        .groupBy(*keys)
        .agg(F.sum("b").alias("unique_byte_reduction"), F.sum("t").alias("unique_token_reduction"))
    )
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluations"),
        count_where(applied).alias("applicable"),
        ratio(count_where(applied), F.count(F.lit(1))).alias("applicability"),
        F.coalesce(F.sum(F.when(applied, F.col("input_bytes"))), F.lit(0)).alias("input_bytes"),
        F.coalesce(F.sum(F.when(applied, F.col("bytes_delta"))), F.lit(0)).alias("byte_reduction"),
        F.coalesce(F.sum(F.when(applied, F.col("token_delta"))), F.lit(0)).alias("token_reduction"),
    )
    median = lambda column, name: exact_percentiles(rows, keys, column, [Rank(name, 0.5)], width=0.001).drop("count")
    out = totals
    for part in (unique, median("__byte_ratio", "median_byte_ratio"), median("__token_ratio", "median_token_ratio")):
        out = join_on_nullable(out, part, keys, "left") if keys else out.crossJoin(part)
    return out


def value_counts(candidates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows per value of a label column (status, shape, readability) within each key."""
    return candidates.groupBy(*keys, or_unknown(column).alias(column)).agg(F.count(F.lit(1)).alias("count"))


# Compressors that only serve as controls.
CONTROL_COMPRESSORS = ("json.noop", "text.noop")


def qualified(report: DataFrame) -> DataFrame:
    """Mark the compressors of a report that may be selected.

    Readable output, at least one applicable block, a positive byte reduction, and complete recovery
    and determinism. Reports without a readability column keep `json.minify` eligible.
    """
    readable = (F.col("provider_readability") == "human_readable_structured") | (
        (F.col("compressor_id") == "json.minify") & (F.col("provider_readability") == "unknown")
    )
    passes = (
        ~F.col("compressor_id").isin(*CONTROL_COMPRESSORS)
        & readable
        & (F.col("applicable_blocks") > 0)
        & (F.coalesce("byte_reduction", F.lit(0)) > 0)
        & (F.coalesce("recovery_bp", F.lit(0)) == 10000)
        & (F.coalesce("deterministic_bp", F.lit(0)) == 10000)
    )
    return report.withColumn("qualified", F.coalesce(passes, F.lit(False)))


def select_candidate(
    report: DataFrame, experiments: DataFrame, gates_passed: bool, requested: str | None
) -> DataFrame:
    """One decision per experiment: the selected compressor, or why nothing was selected."""
    wanted = qualified(report).where(F.col("qualified") & (F.col("compressor_id") == F.lit(requested or "")))
    found = wanted.select("experiment_id").distinct().withColumn("__found", F.lit(True))
    decision = (
        F.when(F.col("forwarding_mutations") != 0, "blocked_forwarding_mutations_detected")
        .when(F.lit(not gates_passed), "blocked_pending_empirical_gates")
        .when(F.lit(not requested), "blocked_candidate_decision_not_recorded")
        .when(F.col("__found").isNull(), "blocked_requested_candidate_did_not_qualify")
        .otherwise("selected_after_all_gates_passed")
    )
    return experiments.join(found, "experiment_id", "left").select(
        "experiment_id",
        decision.alias("decision"),
        F.when(decision == "selected_after_all_gates_passed", F.lit(requested)).alias("selected_compressor"),
    )
