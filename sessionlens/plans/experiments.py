"""Experiment statistics: arms, pairs, bootstrap, stable maps, crossover, cache-key studies."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import (
    basis_points_half_even, complete_sum, count_where, ratio, relative_change, relative_distance,
)
from ..functions.ranking import Rank, exact_percentiles, join_on_nullable, numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- paired runs -----------------------------------------------------------------------------------------


def unpivot_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form (keys, metric, value); a missing counter counts as zero."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("bigint"), F.lit(0)).alias("value")) for m in metrics
    ])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def arm_totals(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Sum and median of every metric per arm."""
    long = unpivot_metrics(rows, keys, metrics)
    sums = long.groupBy(*keys, "metric").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("runs"))
    medians = exact_percentiles(long, [*keys, "metric"], "value", [Rank("median", 0.5)]).drop("count")
    return join_on_nullable(sums, medians, [*keys, "metric"])


def pair_runs(rows: DataFrame, keys: list[str], control: str, treatment: str, metrics: list[str]) -> DataFrame:
    """Runs of both arms side by side, joined on the explicit pair index."""
    side = lambda arm, prefix: rows.where(F.col("arm") == arm).select(
        *keys, "pair_index", *[F.coalesce(F.col(m).cast("bigint"), F.lit(0)).alias(f"{prefix}_{m}") for m in metrics]
    )
    return side(control, "c").join(side(treatment, "t"), [*keys, "pair_index"])


def index_pairs(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Give runs without a pair index their position inside the arm."""
    return numbered(rows, [*keys, "arm"], [F.col(c) for c in order], "pair_index", F.floor(F.col(order[0]).cast("bigint") / 4096))


def paired_deltas(rows: DataFrame, keys: list[str], control: str, treatment: str, metrics: list[str]) -> DataFrame:
    """Treatment minus control per metric: median, extremes and sign counts."""
    paired = pair_runs(rows, keys, control, treatment, metrics)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"t_{m}") - F.col(f"c_{m}")).alias("delta")) for m in metrics])
    long = paired.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    shape = long.groupBy(*keys, "metric").agg(
        F.min("delta").alias("min"), F.max("delta").alias("max"),
        count_where(F.col("delta") > 0).alias("positive"), count_where(F.col("delta") < 0).alias("negative"),
        count_where(F.col("delta") == 0).alias("zero"),
    )
    medians = exact_percentiles(long, [*keys, "metric"], "delta", [Rank("median", 0.5)]).drop("count")
    return join_on_nullable(shape, medians, [*keys, "metric"])


def paired_verdict(rows: DataFrame, keys: list[str], control: str, treatment: str, mode: str, fail_open: bool = False) -> DataFrame:
    """Invariant, shadow, active and positive gates of a paired experiment and the decision.

    `mode` is passthrough, shadow or active. All gates are boolean aggregates over pairs or arms.
    """
    metrics = [
        "agent_success", "task_success", "provider_errors", "source_executions", "source_ids_present", "source_sessions_linked",
        "hook_rewrites", "source_emitted_bytes", "source_stdout_bytes", "source_stderr_bytes", "candidate_bytes",
        "shadow_evaluations", "active_evaluations", "never_worse_accepted", "forwarding_mutations", "fail_open_executions",
        "recovery_requests", "reducer_duration_us", "input_uncached", "command_retries", "provider_requests", "tool_calls",
    ]
    paired = pair_runs(rows, keys, control, treatment, metrics)
    c, t = (lambda m: F.col(f"c_{m}")), (lambda m: F.col(f"t_{m}"))
    active, shadow = mode == "active", mode == "shadow"
    both = lambda test: test(c) & test(t)
    invariant = (
        both(lambda s: (s("agent_success") == 1) & (s("provider_errors") == 0) & (s("source_executions") >= 1))
        & both(lambda s: (s("source_ids_present") == s("source_executions")) & (s("source_sessions_linked") == s("source_executions")))
        & both(lambda s: s("hook_rewrites") == 0)
    )
    if not active:
        invariant = invariant & (c("source_emitted_bytes") == t("source_emitted_bytes"))
    raw = t("source_stdout_bytes") + t("source_stderr_bytes")
    kept = t("source_emitted_bytes") if active else t("candidate_bytes")
    every = lambda test, name: F.bool_and(test).alias(name)
    grouped = paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        every(invariant, "invariant_gate"),
        every((t("shadow_evaluations") == 1) & (t("never_worse_accepted") == 1) & (t("reducer_duration_us") <= 50_000), "__shadow"),
        every(both(lambda s: s("task_success") == 1) & (t("active_evaluations") >= 1), "__active"),
        every(
            (t("forwarding_mutations") >= 1) & (t("fail_open_executions") == 0)
            & (t("never_worse_accepted") == t("active_evaluations")), "__mutates",
        ),
        every(
            (t("forwarding_mutations") == 0) & (t("fail_open_executions") == t("active_evaluations"))
            & (t("never_worse_accepted") == 0) & (t("candidate_bytes") == raw) & (t("source_emitted_bytes") == raw)
            & (t("recovery_requests") == 0), "__open",
        ),
        F.sum(raw).alias("__raw"), F.sum(kept).alias("__kept"),
        *[F.sum(s(m)).alias(f"__{p}_{m}") for p, s in (("c", c), ("t", t)) for m in ("input_uncached", "command_retries", "provider_requests", "tool_calls")],
        F.sum(t("recovery_requests")).alias("__recovered"), F.sum(t("forwarding_mutations")).alias("__mutations"),
    )
    median = exact_percentiles(
        paired.withColumn("__d", t("input_uncached") - c("input_uncached")), keys, "__d", [Rank("__median", 0.5)]
    ).drop("count")
    joined = join_on_nullable(grouped, median, keys)
    reduction = F.when(F.col("__raw") != 0, (F.col("__raw") - F.col("__kept")) / F.col("__raw")).otherwise(F.lit(0.0))
    steady = F.lit(True)
    for m in ("command_retries", "provider_requests", "tool_calls"):
        steady = steady & (F.col(f"__t_{m}") <= F.col(f"__c_{m}") + 1)
    shadow_gate = F.col("__shadow") & (reduction >= 0.20)
    active_gate = F.col("__active") & (F.col("__open") if fail_open else F.col("__mutates") & (reduction >= 0.20))
    gain = (
        (F.col("__t_input_uncached") < F.col("__c_input_uncached")) & (F.col("__median") < 0) & steady
        & (F.col("__recovered") <= F.greatest(F.lit(1), F.floor(F.col("__mutations") / 10)))
    )
    positive = F.when(F.col("pairs") >= 10, steady if fail_open else gain) if active else F.lit(None).cast("boolean")
    passed = F.col("invariant_gate")
    if shadow:
        passed = passed & shadow_gate
    if active:
        passed = passed & active_gate & F.coalesce(positive, F.lit(True))
    return joined.select(
        *keys, "pairs", "invariant_gate",
        (shadow_gate if shadow else F.lit(None).cast("boolean")).alias("shadow_gate"),
        (active_gate if active else F.lit(None).cast("boolean")).alias("active_gate"),
        positive.alias("positive_gate"),
        (reduction if shadow or active else F.lit(None).cast("double")).alias("source_reduction"),
        F.when(passed, "pass").otherwise("reject").alias("decision"),
    )


# --- bootstrap -------------------------------------------------------------------------------------------

RESAMPLES = 4000


@F.pandas_udf(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
def _median_ranks(seed: pd.Series, size: pd.Series) -> pd.DataFrame:
    """1-based ranks of the middle values of one bootstrap resample of `size` rows.

    The k-th smallest of n uniform draws is Beta(k, n-k+1); a resample is n draws of ranks, so its
    middle ranks follow from one or two Beta draws, whatever n is.
    """
    import numpy as np

    out = []
    for s, n in zip(seed, size):
        n = int(n)
        rng = np.random.Generator(np.random.Philox(int(s) & 0xFFFFFFFFFFFFFFFF))
        half = n // 2
        if n % 2:
            low = high = rng.beta(half + 1, half + 1)
        else:
            high = rng.beta(half + 1, half)
            low = high * rng.random() ** (1.0 / half)
        rank = lambda u: min(n, int(u * n) + 1)
        out.append((rank(low), rank(high)))
    return pd.DataFrame(out, columns=["lo", "hi"])


def bootstrap_median_delta(
    rows: DataFrame, keys: list[str], side: str, value: str, baseline: str, current: str,
    resamples: int = RESAMPLES, seed: int = 0,
) -> DataFrame:
    """95 % bootstrap interval of the difference of medians (current - baseline) per key.

    No row is ever resampled: each resample draws only the ranks of its middle values, which are then
    looked up. The work is `resamples` draws per group, independent of the number of rows.
    """
    group = [*keys, side]
    values = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    ranked = numbered(values, group, [F.col("__v").asc()], "__rank", F.floor(F.col("__v") / 4096))
    sizes = values.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    draws = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample")).withColumn(
        "__d", _median_ranks(F.xxhash64(*group, "resample", F.lit(seed)), "__n")
    )
    ends = draws.select(*group, "resample", F.explode(F.array("__d.lo", "__d.hi")).alias("__rank"))
    medians = join_on_nullable(ends, ranked, [*group, "__rank"]).groupBy(*group, "resample").agg(
        (F.sum("__v") / 2.0).alias("__m")
    )
    delta = medians.groupBy(*keys, "resample").agg(
        (F.sum(F.when(F.col(side) == current, F.col("__m"))) - F.sum(F.when(F.col(side) == baseline, F.col("__m")))).alias("d")
    )
    low, high = max(0, int(0.025 * resamples) - 1), min(resamples - 1, int(0.975 * resamples))
    ordered = F.array_sort(F.collect_list("d"))  # one entry per resample
    return delta.groupBy(*keys).agg(ordered.alias("__o")).select(
        *keys, F.round(F.get("__o", F.lit(low)), 3).alias("lower_95"), F.round(F.get("__o", F.lit(high)), 3).alias("upper_95"),
        F.coalesce(F.get("__o", F.lit(low)) > 0, F.lit(False)).alias("significant_positive"),
    )


def phase_medians(rows: DataFrame, keys: list[str], side: str, value: str, baseline: str, current: str) -> DataFrame:
    """Medians of both phases, their difference and relative difference."""
    medians = exact_percentiles(rows, [*keys, side], value, [Rank("m", 0.5)])
    pick = lambda phase: F.max(F.when(F.col(side) == phase, F.col("m")))
    out = medians.groupBy(*keys).agg(pick(baseline).alias("baseline_median"), pick(current).alias("current_median"))
    delta = F.col("current_median") - F.col("baseline_median")
    return out.withColumn("delta", delta).withColumn("relative_delta", ratio(delta, "baseline_median"))


def compare_phases(rows: DataFrame, keys: list[str], side: str, value: str, baseline: str, current: str, resamples: int = RESAMPLES) -> DataFrame:
    """Medians with bootstrap interval; expects `metric` among the keys for the regression flag."""
    out = join_on_nullable(
        phase_medians(rows, keys, side, value, baseline, current),
        bootstrap_median_delta(rows, keys, side, value, baseline, current, resamples), keys, "left",
    )
    return out.withColumn("forwarding_regression", F.col("significant_positive") & (F.col("metric") != "duration_us"))


def noise_envelope(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """Largest absolute interval bound an A/A comparison shows, absolute and relative."""
    bound = F.greatest(F.abs("lower_95"), F.abs("upper_95"))
    return comparison.groupBy(*keys).agg(
        F.max(bound).alias("envelope_absolute"),
        F.max(F.coalesce(ratio(bound, F.abs("baseline_median")), F.lit(0.0))).alias("envelope_relative"),
    )


def accept_within_envelope(target: DataFrame, envelope: DataFrame, keys: list[str]) -> DataFrame:
    """A change is acceptable if it is no slowdown, crosses zero or stays within measured noise."""
    joined = join_on_nullable(target, envelope, keys, "left")
    crosses = (F.col("lower_95") <= 0) & (F.col("upper_95") >= 0)
    within = F.abs("delta") <= F.col("envelope_absolute")
    return joined.withColumn("crosses_zero", crosses).withColumn("within_envelope", within).withColumn(
        "operationally_acceptable",
        F.coalesce(F.col("envelope_absolute").isNotNull() & ((F.col("upper_95") <= 0) | crosses | within), F.lit(False)),
    )


# --- stable block maps and set algebra --------------------------------------------------------------------


def stable_map(blocks: DataFrame, groups: list[str]) -> DataFrame:
    """Blocks present in every request of a group with constant multiplicity and weight.

    Expects request_id, fp and tokens. Two aggregates: per request, then per fingerprint.
    """
    requests = blocks.select(*groups, "request_id").distinct().groupBy(*groups).agg(F.count(F.lit(1)).alias("__all"))
    per_request = blocks.groupBy(*groups, "request_id", "fp").agg(
        F.count(F.lit(1)).alias("n"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")
    )
    per_block = per_request.groupBy(*groups, "fp").agg(
        F.count(F.lit(1)).alias("__seen"), F.min("n").alias("__n0"), F.max("n").alias("__n1"), F.min("lo").alias("__t0"), F.max("hi").alias("__t1")
    )
    constant = (F.col("__seen") == F.col("__all")) & (F.col("__n0") == F.col("__n1")) & (F.col("__t0") == F.col("__t1"))
    return join_on_nullable(per_block, requests, groups).where(constant).select(*groups, "fp", (F.col("__n0") * F.col("__t0")).alias("weight"))


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of the left map that the right map lacks, with their weight."""
    return left.join(right.select("fp"), "fp", "left_anti")


def weight_of(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias(name))


def common_blocks(maps: DataFrame, group: str, groups: int) -> DataFrame:
    """Blocks every group has, and whether they weigh the same everywhere."""
    return maps.groupBy("fp").agg(
        F.count_distinct(group).alias("__g"), F.min("weight").alias("weight"), (F.min("weight") == F.max("weight")).alias("consistent")
    ).where(F.col("__g") == groups).drop("__g")


def maps_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do both maps hold the same blocks with the same weights."""
    joined = left.select("fp", F.col("weight").alias("l")).join(right.select("fp", F.col("weight").alias("r")), "fp", "full")
    return joined.agg(
        count_where(F.col("l").isNull() | F.col("r").isNull()).alias("unmatched"),
        count_where(F.col("l") != F.col("r")).alias("different"),
    ).withColumn("equal", (F.col("unmatched") == 0) & (F.col("different") == 0))


def arm_of(maps: DataFrame, arm: str) -> DataFrame:
    return maps.where(F.col("arm") == arm).select("fp", "weight")


def combine_runs(maps: DataFrame) -> DataFrame:
    """Blocks common to all runs of an arm with one weight; expects arm, run, fp, weight."""
    runs = maps.select("arm", "run").distinct().groupBy("arm").agg(F.count(F.lit(1)).alias("__runs"))
    folded = maps.groupBy("arm", "fp").agg(
        F.count_distinct("run").alias("__in"), F.min("weight").alias("weight"), F.max("weight").alias("__max")
    )
    return folded.join(runs, "arm").where((F.col("__in") == F.col("__runs")) & (F.col("weight") == F.col("__max"))).select("arm", "fp", "weight")


def arm_usage(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Usage sums per arm; one request without a value leaves the sum unknown."""
    columns = ("input_tokens", "cached_input_tokens", "uncached_input_tokens", "output_tokens")
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), *[complete_sum(c).alias(c) for c in columns])


def arm_weights(maps: DataFrame, arms: list[str]) -> DataFrame:
    """One row a fingerprint with its weight in every arm, NULL where the arm lacks it: one shuffle for all set algebra."""
    weight = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("weight")))
    return maps.where(F.col("arm").isin(*arms)).groupBy("fp").agg(*[weight(arm).alias(arm) for arm in dict.fromkeys(arms)])


def _total(condition: Column, weight: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(weight) if isinstance(weight, str) else weight)), F.lit(0))


def _lost(left: str, right: str) -> Column:
    """Tokens of blocks that the left arm has and the right one lacks."""
    return _total(F.col(left).isNotNull() & F.col(right).isNull(), left)


def attribution(maps: DataFrame, control: str, ignored: str, markers: dict[str, str]) -> DataFrame:
    """Where instruction tokens come from: common, control only, ignored only and per marker arm."""
    arms = [control, ignored, *markers.values()]
    everywhere = F.lit(True)
    for arm in arms:
        everywhere = everywhere & F.col(arm).isNotNull()
    least, greatest = F.least(*arms), F.greatest(*arms)
    sums = [
        _total(everywhere, least).alias("common_tokens"), F.coalesce(F.bool_and(F.when(everywhere, least == greatest)), F.lit(True)).alias("weight_consistent"),
        _lost(control, ignored).alias(f"{control}_only_tokens"), _lost(ignored, control).alias(f"{ignored}_only_tokens"),
    ]
    for name, arm in markers.items():
        sums += [_lost(arm, ignored).alias(f"{name}_only_tokens"), _lost(ignored, arm).alias(f"{name}_removed_tokens")]
    return arm_weights(maps, arms).agg(*sums)


def layer_decomposition(maps: DataFrame, baseline: str, twin: str, layers: dict[str, str], combined: str, ignored: str) -> DataFrame:
    """Tokens each layer removes and adds, and how far single layers explain the combined removal."""
    base, every = F.col(baseline), {**layers, "combined": combined}
    sums = [F.coalesce(F.bool_and(F.when(base.isNotNull() | F.col(twin).isNotNull(), base.eqNullSafe(F.col(twin)))), F.lit(True)).alias("baseline_match")]
    for name, arm in every.items():
        sums += [_lost(baseline, arm).alias(f"{name}_removed_tokens"), _lost(arm, baseline).alias(f"{name}_added_tokens")]
    single = F.lit(False)
    for arm in layers.values():
        single = single | F.col(arm).isNull()
    removed = base.isNotNull() & F.col(combined).isNull()
    sums += [
        _total(removed & single, baseline).alias("explained_tokens"), _total(removed & ~single, baseline).alias("interaction_only_tokens"),
        _lost(combined, ignored).alias("combined_only_tokens"), _lost(ignored, combined).alias("ignored_only_tokens"),
    ]
    return arm_weights(maps, [baseline, twin, *every.values(), ignored]).agg(*sums)


def recurrence(blocks: DataFrame) -> DataFrame:
    """Tokens of fingerprints in several requests or sessions, and exposure beyond one copy.

    Expects fp, tokens, request_id and session_id. Distinct counts are two-level aggregates.
    """
    per = blocks.groupBy("fp", "session_id", "request_id").agg(F.sum("tokens").alias("t"), F.min("tokens").alias("one"))
    per_session = per.groupBy("fp", "session_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("t").alias("t"), F.min("one").alias("one"))
    grouped = per_session.groupBy("fp").agg(
        F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("sessions"), F.sum("t").alias("t"), F.min("one").alias("one")
    )
    many = F.col("requests") >= 2
    zero = lambda c: F.coalesce(c, F.lit(0))
    return grouped.agg(
        zero(F.sum(F.when(many, F.col("t")))).alias("cross_request_tokens"),
        zero(F.sum(F.when(F.col("sessions") >= 2, F.col("t")))).alias("cross_session_tokens"),
        zero(F.sum(F.when(many, F.col("t") - F.col("one")))).alias("repeat_exposure_tokens"),
        zero(F.sum("t")).alias("tokens"),
    ).withColumn("repeat_share_bp", basis_points_half_even("repeat_exposure_tokens", "tokens"))


# --- crossover and cache keys -------------------------------------------------------------------------------


def williams_schedule(spark: SparkSession, arms: tuple[str, str, str]) -> DataFrame:
    """Six rounds in which every arm takes every position twice and follows every other arm twice."""
    a, b, c = arms
    rounds = ((a, b, c), (b, c, a), (c, a, b), (a, c, b), (c, b, a), (b, a, c))
    rows = [(i, p, arm) for i, order in enumerate(rounds) for p, arm in enumerate(order)]
    return spark.createDataFrame(rows, "round int, position int, arm string")


def interleaved_schedule(spark: SparkSession, rounds: int, twins: tuple[str, str], rest: tuple[str, ...]) -> DataFrame:
    """Rotating order with the twin arms side by side, their order swapped every other round."""
    rows = []
    for i in range(rounds):
        turned = [*rest[i % len(rest):], *rest[: i % len(rest)]]
        pair = list(twins) if i % 2 == 0 else list(reversed(twins))
        at = i % (len(turned) + 1)
        rows += [(i, p, arm) for p, arm in enumerate([*turned[:at], *pair, *turned[at:]])]
    return spark.createDataFrame(rows, "round int, position int, arm string")


def crossover(usage: DataFrame, schedule: DataFrame, control: str, null: str, treatment: str, structural: bool = True) -> DataFrame:
    """Null-control distances and treatment changes of a position-balanced crossover, as one row.

    Expects arm, round and the usage columns per run.
    """
    placed = usage.join(schedule, ["arm", "round"])
    by_position = arm_usage(placed, ["arm", "position"])
    by_arm = arm_usage(placed, ["arm"])
    value = lambda arm, column: F.max(F.when(F.col("arm") == arm, F.col(column)))
    per_position = by_position.groupBy("position").agg(
        relative_distance(value(control, "uncached_input_tokens"), value(null, "uncached_input_tokens")).alias("d")
    )
    worst = per_position.agg(F.when(F.count("d") == F.count(F.lit(1)), F.max("d")).alias("null_position_distance"))
    columns = ("input_tokens", "cached_input_tokens", "uncached_input_tokens", "output_tokens")
    totals = by_arm.agg(
        relative_distance(value(control, "input_tokens"), value(null, "input_tokens")).alias("null_input_distance"),
        relative_distance(value(control, "uncached_input_tokens"), value(null, "uncached_input_tokens")).alias("null_uncached_distance"),
        *[relative_change(value(control, c), value(treatment, c)).alias(f"{c}_change") for c in columns],
    )
    at_most = lambda c, limit: F.coalesce(F.col(c) <= limit, F.lit(False)) & F.lit(structural)
    joined = totals.crossJoin(worst)
    joined = joined.withColumn("input_reliable", at_most("null_input_distance", 0.02)).withColumn(
        "split_reliable", at_most("null_uncached_distance", 0.10) & at_most("null_position_distance", 0.20)
    )
    reliable = F.col("input_reliable") & F.col("split_reliable")
    return joined.withColumn(
        "interpretation", F.when(reliable, "eligible_for_quality_gated_follow_up").otherwise("blocked_by_cache_controls")
    )


def first_requests(requests: DataFrame, run: list[str], order: str) -> DataFrame:
    """The first request of every run."""
    rest = [c for c in requests.columns if c not in run]
    return requests.groupBy(*run).agg(F.min_by(F.struct(*rest), F.struct(order, "request_id")).alias("r")).select(*run, "r.*")


def field_mismatches(manifest: DataFrame, cell: list[str], fields: list[str]) -> DataFrame:
    """Per field, in how many cells (a round, or a block place in a round) the arms disagree."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("\x00")).alias("value")) for f in fields])
    long = manifest.select(*cell, F.explode(pairs).alias("p")).select(*cell, "p.*")
    spread = long.groupBy(*cell, "field").agg((F.min("value") != F.max("value")).alias("differs"))
    return spread.groupBy("field").agg(count_where(F.col("differs")).alias("mismatches"))


def cache_attribution(by_arm: DataFrame, implicit: str, enabled: str, disabled: str, prefix_equal: Column) -> DataFrame:
    """Class of a cache divergence from three pairwise distances."""
    value = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("uncached_input_tokens")))
    d = by_arm.agg(
        relative_distance(value(implicit), value(enabled)).alias("enabled_pair"),
        relative_distance(value(implicit), value(disabled)).alias("implicit_disabled"),
        relative_distance(value(enabled), value(disabled)).alias("enabled_disabled"),
    )
    same = F.coalesce(F.col("enabled_pair") <= 0.10, F.lit(False))
    apart = F.coalesce((F.col("implicit_disabled") >= 0.20) & (F.col("enabled_disabled") >= 0.20), F.lit(False))
    return d.withColumn(
        "classification",
        F.when(~prefix_equal, "blocked_by_observable_prefix_difference")
        .when(same & apart, "effective_hooks_state_associated")
        .when(~same, "explicit_override_or_uncontrolled_variance")
        .otherwise("phase_divergence_not_reproduced"),
    )


def equality_study(records: DataFrame, runs_expected: int) -> DataFrame:
    """Stability of cache-key classes inside runs and across arms, and the resulting class.

    Expects arm, round, request_index, cache_key_status and equality_class.
    """
    present = F.col("cache_key_status") == "present"
    runs = records.groupBy("arm", "round").agg(
        F.min("equality_class").alias("lo"), F.max("equality_class").alias("hi"),
        F.bool_and(present & F.col("equality_class").isNotNull()).alias("present"),
        F.min_by("equality_class", "request_index").alias("first_class"),
        F.count(F.lit(1)).alias("requests"),
    )
    # Two arms agree in a round when their first classes match: groups of equal (round, class).
    shared = runs.where("first_class is not null").groupBy("round", "first_class").agg(F.count(F.lit(1)).alias("arms")).agg(
        F.coalesce(F.sum(F.expr("arms * (arms - 1) div 2")), F.lit(0)).alias("cross_arm_equalities")
    )
    totals = runs.agg(
        F.count(F.lit(1)).alias("runs"), F.bool_and(F.col("present") & (F.col("lo") == F.col("hi"))).alias("within_run_stable"),
        F.sum("requests").alias("requests"),
    )
    classes = records.where(present & F.col("equality_class").isNotNull()).select("equality_class").distinct().agg(F.count(F.lit(1)).alias("classes"))
    statuses = records.agg(count_where(present).alias("present"), count_where(F.col("cache_key_status") == "absent").alias("absent"))
    out = totals.crossJoin(classes).crossJoin(statuses).crossJoin(shared)
    all_present = F.col("present") == F.col("requests")
    unique = F.col("within_run_stable") & (F.col("classes") == runs_expected) & (F.col("cross_arm_equalities") == 0)
    return out.withColumn(
        "classification",
        F.when(F.col("runs") != runs_expected, "insufficient_equality_evidence")
        .when(F.col("absent") == F.col("requests"), "cache_key_absent")
        .when(all_present & (F.col("classes") == 1), "one_shared_cache_key_class")
        .when(all_present & unique, "session_scoped_cache_key_classes")
        .when(all_present, "mixed_cache_key_classes")
        .otherwise("incomplete_cache_key_presence"),
    )


# --- verdicts ------------------------------------------------------------------------------------------------


def counter_delta(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """After minus before per counter; unknown on either side stays unknown."""
    old = before.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = join_on_nullable(after, old, keys) if keys else after.crossJoin(old)
    return joined.select(*keys, *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in columns])


def tool_surface_verdict(surface: DataFrame, usage_known: Column, completed: bool = True) -> DataFrame:
    """Decision from a tool-surface summary: ready, rejected for lack of schemas, or insufficient."""
    measured = (F.col("schema_coverage_bp") == 10_000) & usage_known & F.lit(completed)
    exposed = (F.col("tool_definitions_exposed") > 0) & (F.col("schema_bytes") > 0) & (F.col("estimated_schema_tokens") > 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    decision = (
        F.when(yes(measured) & yes(exposed), "shadow_evidence_ready_for_policy_design")
        .when(yes(measured), "reject_active_tool_selection_no_observed_schema_surface")
        .otherwise("insufficient_shadow_evidence")
    )
    return surface.select("schema_coverage_bp", yes(exposed).alias("exposure_observed"), decision.alias("decision"))


def pilot_verdict(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Was the treatment exercised at all; failures; comparable or blocked."""
    return rows.groupBy(*keys).agg(
        F.sum("active_evaluations").alias("evaluations"), F.sum("forwarding_mutations").alias("rewrites"),
        F.sum("recovery_failures").alias("recovery_failures"), F.sum("determinism_failures").alias("determinism_failures"),
    ).withColumn("treatment_exercised", F.col("rewrites") > 0).withColumn(
        "decision",
        F.when(F.col("rewrites") == 0, "blocked_no_active_candidate_applicability").otherwise("pilot_quality_requires_follow_up"),
    )


def provider_gate(rows: DataFrame, keys: list[str], control: str, treatment: str) -> DataFrame:
    """Equal request counts per pair, no errors, complete analyses, and the forwarded-byte reduction."""
    metrics = ["provider_requests", "provider_errors", "snapshots", "complete_snapshots"]
    paired = pair_runs(rows, keys, control, treatment, metrics)
    gates = paired.groupBy(*keys).agg(
        F.bool_and(F.col("c_provider_requests") == F.col("t_provider_requests")).alias("cardinality_matched"),
        (F.sum(F.col("c_provider_errors") + F.col("t_provider_errors")) == 0).alias("forwarding_reachable"),
        F.bool_and((F.col("c_snapshots") == F.col("c_complete_snapshots")) & (F.col("t_snapshots") == F.col("t_complete_snapshots"))).alias("analysis_complete"),
    )
    sizes = phase_medians(rows, keys, "arm", "forwarded_bytes", control, treatment).select(
        *keys, ratio(F.col("baseline_median") - F.col("current_median"), "baseline_median").alias("median_byte_reduction")
    )
    return join_on_nullable(gates, sizes, keys)


def run_summary(requests: DataFrame, attempts: DataFrame, usage: DataFrame) -> DataFrame:
    """Counts, errors, usage sums and ceiling-rank latencies of one run, as one row."""
    from ..functions.labels import provider_error

    counts = requests.agg(F.count(F.lit(1)).alias("requests"))
    tries = attempts.agg(F.count(F.lit(1)).alias("attempts"), count_where(provider_error()).alias("errors"))
    sums = usage.agg(*[F.sum(c).alias(c) for c in ("input_total", "input_uncached", "input_cached", "output_total", "output_reasoning")])
    transports = requests.select(F.coalesce("transport", F.lit("unavailable")).alias("t")).distinct().agg(F.count(F.lit(1)).alias("transports"))
    out = counts.crossJoin(tries).crossJoin(sums).crossJoin(transports)
    for column in ("ttfb_us", "ttft_us", "duration_us"):
        ranks = [Rank(f"{column}_p50", 0.50, "ceil"), Rank(f"{column}_p95", 0.95, "ceil")]
        out = out.crossJoin(exact_percentiles(attempts, [], column, ranks).drop("count"))
    return out


def deterministic_assignment(tasks: DataFrame, experiment: str, task: str, arms: tuple[str, str]) -> DataFrame:
    """Seed per task and arm and the order of the pair, both from digests of the ids."""
    digest = lambda *parts: F.sha2(F.concat_ws(":", *parts), 256)
    order = digest(F.lit(experiment), F.lit("order"), F.col(task).cast("string"))
    first = F.conv(F.substring(order, 1, 2), 16, 10).cast("int") % 2 == 0
    planned = tasks.select(
        task, F.when(first, "control_first").otherwise("treatment_first").alias("pair_order"), F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")
    )
    seed = F.conv(F.substring(digest(F.lit(experiment), F.col(task).cast("string"), F.col("arm")), 1, 16), 16, 10).cast("decimal(20,0)")
    return planned.withColumn("seed", seed)


def agent_error_class(text: Column | str) -> Column:
    """Class of an agent's error text."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    return (
        F.when(text.contains("sandbox") | text.contains("permission denied"), "sandbox_or_permission")
        .when(text.contains("not found") | text.contains("no such file"), "not_found")
        .when(text.contains("recursion"), "recursion")
        .when(text != "", "other")
    )


def final_outcome(messages: DataFrame, keys: list[str], order: str, text: str, passed: str, failed: str) -> DataFrame:
    """Outcome told by the last message: the failed or passed sentinel, else unknown."""
    final = F.lower(F.trim(F.max_by(text, order)))
    return messages.groupBy(*keys).agg(
        F.when(final == failed.lower(), "failed").when(final == passed.lower(), "passed").otherwise("unknown").alias("outcome")
    )
