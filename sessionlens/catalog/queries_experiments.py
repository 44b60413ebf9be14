"""Experiment statistics and set algebra over arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, views
from ..plans import experiments as ex
from ..sources.bindings import arm_blocks, arm_requests, read, runs, star_trace
from .queries_core import rounded
from .registry import query

METRICS = ["provider_requests", "input_uncached", "duration_us", "tool_calls"]


def paired(spark, root):
    return ex.index_pairs(runs(spark, root), ["experiment"], ["run_id"])


_LONG = "select experiment, arm, unnest(['provider_requests', 'input_uncached', 'duration_us', 'tool_calls']) as metric, unnest([2, input_uncached, duration_us, tool_calls]) as value from t_runs"


@query(
    "E01_arm_totals",
    """select experiment, arm, metric, cast(sum(value) as bigint) as total, count(*) as runs, quantile_cont(value, 0.5) as median
       from l group by 1, 2, 3""",
    l=_LONG,
)
def arm_totals(spark, root):
    return ex.arm_totals(runs(spark, root), ["experiment", "arm"], METRICS)


_PAIRED = """select c.experiment, unnest(['provider_requests', 'input_uncached', 'duration_us', 'tool_calls']) as metric,
    unnest([0, t.input_uncached - c.input_uncached, t.duration_us - c.duration_us, t.tool_calls - c.tool_calls]) as delta
  from t_runs c join t_runs t on t.experiment = c.experiment and t.pair_index = c.pair_index and t.arm = 'treatment' where c.arm = 'control'"""


@query(
    "E02_paired_deltas",
    """select experiment, metric, min(delta) as min, max(delta) as max, count(*) filter (delta > 0) as positive,
         count(*) filter (delta < 0) as negative, count(*) filter (delta = 0) as zero, quantile_cont(delta, 0.5) as median from p group by 1, 2""",
    p=_PAIRED,
)
def paired_deltas(spark, root):
    return ex.paired_deltas(paired(spark, root), ["experiment"], "control", "treatment", METRICS)


@query(
    "J11_pair_index",
    "select run_id, experiment, arm, pair_index from t_runs",
)
def pair_index(spark, root):
    return paired(spark, root).select("run_id", "experiment", "arm", "pair_index")


@query(
    "E03_paired_verdict",
    """select c.experiment, count(*) as pairs, bool_and(c.provider_errors = 0 and t.provider_errors = 0) as invariant_gate,
         cast(null as boolean) as shadow_gate, (5000 * count(*) - sum(t.source_emitted_bytes)) / (5000.0 * count(*)) >= 0.2 as active_gate,
         sum(t.input_uncached) < sum(c.input_uncached) and quantile_cont(t.input_uncached - c.input_uncached, 0.5) < 0
           and sum(t.command_retries) <= sum(c.command_retries) + 1 and sum(t.tool_calls) <= sum(c.tool_calls) + 1 as positive_gate,
         round((5000 * count(*) - sum(t.source_emitted_bytes))::double / (5000 * count(*)), 9) as source_reduction,
         case when bool_and(c.provider_errors = 0 and t.provider_errors = 0) and sum(t.input_uncached) < sum(c.input_uncached)
           and quantile_cont(t.input_uncached - c.input_uncached, 0.5) < 0 and sum(t.command_retries) <= sum(c.command_retries) + 1
           and sum(t.tool_calls) <= sum(c.tool_calls) + 1 then 'pass' else 'reject' end as decision
       from t_runs c join t_runs t on t.experiment = c.experiment and t.pair_index = c.pair_index and t.arm = 'treatment'
       where c.arm = 'control' group by 1""",
)
def paired_verdict(spark, root):
    out = ex.paired_verdict(paired(spark, root), ["experiment"], "control", "treatment", "active")
    return rounded(out, "source_reduction")


def phase_rows(spark, root):
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("dispatch_us", "duration_us")])
    return runs(spark, root).select("experiment", "arm", F.explode(pairs).alias("p")).select("experiment", "arm", "p.*")


@query(
    "E05_phase_medians",
    """select experiment, metric, b as baseline_median, c as current_median, c - b as delta, round((c - b) / nullif(b, 0), 9) as relative_delta from (
         select experiment, metric, quantile_cont(value, 0.5) filter (arm = 'control') as b, quantile_cont(value, 0.5) filter (arm = 'treatment') as c
         from (select experiment, arm, unnest(['dispatch_us', 'duration_us']) as metric, unnest([dispatch_us, duration_us]) as value from t_runs) group by 1, 2)""",
)
def phase_medians(spark, root):
    return rounded(ex.phase_medians(phase_rows(spark, root), ["experiment", "metric"], "arm", "value", "control", "treatment"), "relative_delta")


@query("E04_bootstrap_interval")
def bootstrap_interval(spark, root):
    return ex.bootstrap_median_delta(phase_rows(spark, root), ["experiment", "metric"], "arm", "value", "control", "treatment", 1000)


@query("E06_noise_envelope")
def noise_envelope(spark, root):
    rows = phase_rows(spark, root)
    keys = ["experiment", "metric"]
    target = ex.compare_phases(rows, keys, "arm", "value", "control", "treatment", 500)
    halves = rows.where("arm = 'control'").withColumn("half", F.when(F.pmod(F.xxhash64("value"), F.lit(2)) == 0, "a").otherwise("b"))
    same = ex.compare_phases(halves, keys, "half", "value", "a", "b", 500)
    return ex.accept_within_envelope(target, ex.noise_envelope(same, keys), keys)


# --- stable maps and set algebra ------------------------------------------------------------------------------


def maps(spark, root):
    return ex.stable_map(arm_blocks(spark, root), ["arm"])


def _w(condition, source="v_stable"):
    return f"(select cast(coalesce(sum(weight), 0) as bigint) from {source} where {condition})"


def _minus(left, right):
    return _w(f"arm = '{left}' and fp not in (select fp from v_stable where arm = '{right}')")


@query("D48_stable_block_map", "select arm, fp, weight from v_stable")
def stable_block_map(spark, root):
    return maps(spark, root)


@query(
    "X01_map_difference",
    f"select {_minus('config_a', 'no_plugins')} as removed_tokens, {_minus('no_extensions', 'config_a')} as added_tokens",
)
def map_difference(spark, root):
    m = maps(spark, root)
    a, b, c = (ex.arm_of(m, n) for n in ("config_a", "no_plugins", "no_extensions"))
    return ex.weight_of(ex.only_in(a, b), "removed_tokens").crossJoin(ex.weight_of(ex.only_in(c, a), "added_tokens"))


_COMMON = "select fp, min(weight) as weight, min(weight) = max(weight) as consistent from v_stable group by fp having count(distinct arm) = 7"


@query("X02_common_blocks", "select * from c", c=_COMMON)
def common_blocks(spark, root):
    return ex.common_blocks(maps(spark, root), "arm", 7)


_REMOVED = "select fp, weight from v_stable where arm = 'config_a' and fp not in (select fp from v_stable where arm = '{0}')"


@query(
    "X03_explained_removal",
    """select (select cast(coalesce(sum(weight), 0) as bigint) from r5 where fp in (select fp from s)) as explained_tokens,
         (select cast(coalesce(sum(weight), 0) as bigint) from r5 where fp not in (select fp from s)) as interaction_only_tokens""",
    r5=_REMOVED.format("no_extensions"),
    s=" union ".join(f"select fp from ({_REMOVED.format(a)})" for a in ("no_plugins", "no_memories", "no_hooks")),
)
def explained_removal(spark, root):
    return decomposition(spark, root).select("explained_tokens", "interaction_only_tokens")


@query(
    "X04_map_equality",
    """select count(*) filter (a.fp is null or b.fp is null) as unmatched, count(*) filter (a.weight <> b.weight) as different,
         count(*) filter (a.fp is null or b.fp is null or a.weight <> b.weight) = 0 as equal
       from (select * from v_stable where arm = 'config_a') a full join (select * from v_stable where arm = 'no_plugins') b on a.fp = b.fp""",
)
def map_equality(spark, root):
    m = maps(spark, root)
    return ex.maps_equal(ex.arm_of(m, "config_a"), ex.arm_of(m, "no_plugins"))


@query(
    "E07_arm_aggregation",
    """select arm, fp, min(weight) as weight from (select arm, run, fp, min(n) * min(lo) as weight from (
           select arm, run, request_id, fp, count(*) as n, min(tokens) as lo, max(tokens) as hi from t_arm_blocks group by all) p group by arm, run, fp
         having count(*) = (select count(distinct request_id) from t_arm_blocks b where b.arm = p.arm and b.run = p.run) and min(n) = max(n) and min(lo) = max(hi)) s
       group by arm, fp having count(distinct run) = (select count(distinct run) from t_arm_blocks b where b.arm = s.arm) and min(weight) = max(weight)""",
)
def arm_aggregation(spark, root):
    return ex.combine_runs(ex.stable_map(arm_blocks(spark, root), ["arm", "run"]))


@query(
    "E08_source_attribution",
    f"""select cast(coalesce(sum(weight), 0) as bigint) as common_tokens, coalesce(bool_and(consistent), true) as weight_consistent,
         {_minus('config_a', 'ignored')} as config_a_only_tokens, {_minus('ignored', 'config_a')} as ignored_only_tokens,
         {_minus('no_hooks', 'ignored')} as workspace_only_tokens, {_minus('ignored', 'no_hooks')} as workspace_removed_tokens
       from (select fp, min(weight) as weight, min(weight) = max(weight) as consistent from v_stable where arm in ('config_a', 'ignored', 'no_hooks')
             group by fp having count(distinct arm) = 3)""",
)
def source_attribution(spark, root):
    return ex.attribution(maps(spark, root), "config_a", "ignored", {"workspace": "no_hooks"})


LAYERS = {"plugins": "no_plugins", "memories": "no_memories", "hooks": "no_hooks"}


def decomposition(spark, root):
    return ex.layer_decomposition(maps(spark, root), "config_a", "config_b", LAYERS, "no_extensions", "ignored")


@query(
    "E09_layer_decomposition",
    "select true as baseline_match, " + ", ".join(
        f"{_minus('config_a', arm)} as {name}_removed_tokens, {_minus(arm, 'config_a')} as {name}_added_tokens"
        for name, arm in {**LAYERS, "combined": "no_extensions"}.items()
    ) + f", {_minus('no_extensions', 'ignored')} as combined_only_tokens, {_minus('ignored', 'no_extensions')} as ignored_only_tokens",
)
def layer_decomposition(spark, root):
    return decomposition(spark, root).drop("explained_tokens", "interaction_only_tokens")


def instruction_blocks(trace):
    """Human-authored text blocks of the latest snapshots, by request and session."""
    latest = views.latest_snapshots(trace.snapshots).select("snapshot_id", "session_id", F.col("provider_request_id").alias("request_id"))
    rows = trace.blocks.where("kind = 'text' and origin = 'human_authored'").join(latest, "snapshot_id")
    return rows.select(F.col("exact_fp").alias("fp"), F.col("estimated_tokens").alias("tokens"), "request_id", "session_id")


_RECUR = """select cast(coalesce(sum(t) filter (r >= 2), 0) as bigint) as cross_request_tokens, cast(coalesce(sum(t) filter (s >= 2), 0) as bigint) as cross_session_tokens,
    cast(coalesce(sum(t - one) filter (r >= 2), 0) as bigint) as repeat_exposure_tokens, cast(coalesce(sum(t), 0) as bigint) as tokens,
    cast(round_even(coalesce(sum(t - one) filter (r >= 2), 0) * 10000.0::double / nullif(sum(t), 0), 0) as bigint) as repeat_share_bp
  from (select exact_fp, count(distinct l.provider_request_id) as r, count(distinct l.session_id) as s, sum(estimated_tokens) as t, min(estimated_tokens) as one
        from v_latest l join t_blocks b on b.snapshot_id = l.snapshot_id where kind = 'text' and origin = 'human_authored' group by 1)"""


@query("D47_instruction_recurrence", _RECUR)
def instruction_recurrence(spark, root):
    return ex.recurrence(instruction_blocks(star_trace(spark, root)))


@query(
    "E15_instruction_surface",
    "select r.*, (select count(*) from v_latest) as requests_observed, (select count(*) from v_latest where status = 'complete' and explicit_request_complete"
    " and correlation_status = 'correlated') as complete_observations, (select round_even(count(*) filter (status = 'complete' and explicit_request_complete"
    " and correlation_status = 'correlated') * 10000.0 / count(*), 0)::bigint from v_latest) as observation_coverage_bp from r",
    r=_RECUR,
)
def instruction_surface(spark, root):
    from ..functions.measures import basis_points_half_even, count_where

    trace = star_trace(spark, root)
    full = (F.col("status") == "complete") & F.col("explicit_request_complete") & (F.col("correlation_status") == "correlated")
    seen = views.latest_snapshots(trace.snapshots).agg(
        F.count(F.lit(1)).alias("requests_observed"), count_where(full).alias("complete_observations")
    ).withColumn("observation_coverage_bp", basis_points_half_even("complete_observations", "requests_observed"))
    return ex.recurrence(instruction_blocks(trace)).crossJoin(seen)


@query(
    "F06_basis_points",
    """select o_orderkey, case when o_orderkey % 31 <> 0 then least(10000, (o_orderkey % 29) * 10000 // (o_orderkey % 31)) end as truncated_bp,
         case when o_orderkey % 31 <> 0 then least(10000, cast(round_even((o_orderkey % 29) * 10000.0::double / (o_orderkey % 31), 0) as bigint)) end as half_even_bp
       from orders""",
)
def basis_point_rules(spark, root):
    from ..functions.measures import basis_points, basis_points_half_even

    a, b = F.col("o_orderkey") % 29, F.col("o_orderkey") % 31
    return read(spark, root, "orders").select(
        "o_orderkey", basis_points(a, b).alias("truncated_bp"), basis_points_half_even(a, b).alias("half_even_bp")
    )


@query(
    "E17_tool_surface_verdict",
    "select schema_coverage_bp, tool_definitions_exposed > 0 and schema_bytes > 0 and estimated_schema_tokens > 0 as exposure_observed,"
    " case when schema_coverage_bp = 10000 then 'shadow_evidence_ready_for_policy_design' else 'insufficient_shadow_evidence' end as decision"
    " from (select least(10000, count(*) filter (m.tool_count is not null and m.repeated_schema_tokens is not null) * 10000 // count(*)) as schema_coverage_bp,"
    " sum(m.tool_count) as tool_definitions_exposed, sum(m.schema_bytes) as schema_bytes, sum(m.estimated_schema_tokens) as estimated_schema_tokens"
    " from v_latest l left join t_metrics m on m.snapshot_id = l.snapshot_id)",
)
def tool_surface_verdict(spark, root):
    return ex.tool_surface_verdict(quality.tool_surface(star_trace(spark, root)), F.lit(True))


# --- crossover and cache keys -----------------------------------------------------------------------------------

ORDER = ("control", "null", "treatment")
_SCHED = """select * from (values (0, 0, 'control'), (0, 1, 'null'), (0, 2, 'treatment'), (1, 0, 'null'), (1, 1, 'treatment'), (1, 2, 'control'),
  (2, 0, 'treatment'), (2, 1, 'control'), (2, 2, 'null'), (3, 0, 'control'), (3, 1, 'treatment'), (3, 2, 'null'), (4, 0, 'treatment'), (4, 1, 'null'),
  (4, 2, 'control'), (5, 0, 'null'), (5, 1, 'control'), (5, 2, 'treatment')) s(round, position, arm)"""
_D = "abs({0} - {1}) / greatest(({0} + {1}) / 2.0, 1.0)"


@query(
    "E11_schedule_usage",
    "select arm, position, count(*) as requests, cast(sum(uncached_input_tokens) as bigint) as uncached from t_arm_requests join sched using (arm, round) group by 1, 2",
    sched=_SCHED,
)
def schedule_usage(spark, root):
    rows = arm_requests(spark, root).join(ex.williams_schedule(spark, ORDER), ["arm", "round"])
    return rows.groupBy("arm", "position").agg(F.count(F.lit(1)).alias("requests"), F.sum("uncached_input_tokens").alias("uncached"))


@query(
    "E10_crossover",
    f"""select round({_D.format('ci', 'ni')}, 9) as null_input_distance, round({_D.format('cu', 'nu')}, 9) as null_uncached_distance,
         round(p.d, 9) as null_position_distance, round((ti - ci) / ci, 9) as input_tokens_change, round((tu - cu) / cu, 9) as uncached_input_tokens_change,
         case when {_D.format('ci', 'ni')} <= 0.02 and {_D.format('cu', 'nu')} <= 0.1 and p.d <= 0.2 then 'eligible_for_quality_gated_follow_up'
           else 'blocked_by_cache_controls' end as interpretation
       from (select sum(input_tokens) filter (arm = 'control')::double as ci, sum(input_tokens) filter (arm = 'null')::double as ni,
               sum(input_tokens) filter (arm = 'treatment')::double as ti, sum(uncached_input_tokens) filter (arm = 'control')::double as cu,
               sum(uncached_input_tokens) filter (arm = 'null')::double as nu, sum(uncached_input_tokens) filter (arm = 'treatment')::double as tu from t_arm_requests) t,
         (select max({_D.format('c', 'n')}) as d from (select position, sum(uncached_input_tokens) filter (arm = 'control')::double as c,
            sum(uncached_input_tokens) filter (arm = 'null')::double as n from t_arm_requests join sched using (arm, round) group by 1)) p""",
    sched=_SCHED,
)
def crossover(spark, root):
    out = ex.crossover(arm_requests(spark, root), ex.williams_schedule(spark, ORDER), *ORDER).select(
        "null_input_distance", "null_uncached_distance", "null_position_distance", "input_tokens_change", "uncached_input_tokens_change", "interpretation"
    )
    return rounded(out, "null_input_distance", "null_uncached_distance", "null_position_distance", "input_tokens_change", "uncached_input_tokens_change")


@query(
    "F23_relative_distance",
    f"""select round, round({_D.format('c', 'n')}, 9) as distance, round((n - c) / c, 9) as change from (select round,
         sum(uncached_input_tokens) filter (arm = 'control')::double as c, sum(uncached_input_tokens) filter (arm = 'null')::double as n from t_arm_requests group by 1)""",
)
def relative_distances(spark, root):
    from ..functions.measures import relative_change, relative_distance

    value = lambda arm: F.sum(F.when(F.col("arm") == arm, F.col("uncached_input_tokens")))
    out = arm_requests(spark, root).groupBy("round").agg(
        relative_distance(value("control"), value("null")).alias("distance"), relative_change(value("control"), value("null")).alias("change")
    )
    return rounded(out, "distance", "change")


_FIRST = "select * from t_arm_requests qualify row_number() over (partition by arm, round order by created_us, request_id) = 1"


@query(
    "E12_manifest_mismatches",
    " union all ".join(
        f"select '{f}' as field, count(*) filter (n > 1) as mismatches from (select round, count(distinct {f}) as n from first_of group by 1)"
        for f in ("model", "tool_count", "effort", "input_tokens")
    ),
    first_of=_FIRST,
)
def manifest_mismatches(spark, root):
    first = ex.first_requests(arm_requests(spark, root), ["arm", "round"], "created_us")
    return ex.field_mismatches(first, ["round"], ["model", "tool_count", "effort", "input_tokens"])


@query(
    "E13_cache_attribution",
    f"""select round({_D.format('a', 'b')}, 9) as enabled_pair, round({_D.format('a', 'c')}, 9) as implicit_disabled, round({_D.format('b', 'c')}, 9) as enabled_disabled,
         case when {_D.format('a', 'b')} <= 0.1 and {_D.format('a', 'c')} >= 0.2 and {_D.format('b', 'c')} >= 0.2 then 'effective_hooks_state_associated'
           when {_D.format('a', 'b')} > 0.1 then 'explicit_override_or_uncontrolled_variance' else 'phase_divergence_not_reproduced' end as classification
       from (select sum(uncached_input_tokens) filter (arm = 'control')::double as a, sum(uncached_input_tokens) filter (arm = 'null')::double as b,
               sum(uncached_input_tokens) filter (arm = 'treatment')::double as c from t_arm_requests)""",
)
def cache_attribution(spark, root):
    usage = ex.arm_usage(arm_requests(spark, root), ["arm"])
    return rounded(ex.cache_attribution(usage, *ORDER, F.lit(True)), "enabled_pair", "implicit_disabled", "enabled_disabled")


_RECORDS = """select ['control', 'null', 'treatment'][o_orderkey % 3 + 1] as arm, (o_orderkey // 3) % 6 as round, o_orderkey as request_index,
    case when o_orderkey % 5003 = 0 then 'absent' else 'present' end as cache_key_status,
    case when o_orderkey % 5003 <> 0 then (o_orderkey % 3) * 10 + (o_orderkey // 3) % 6 end as equality_class from orders"""


@query(
    "E14_equality_study",
    """select t.runs, t.requests, t.stable as within_run_stable, c.classes, s.present, s.absent, x.n as cross_arm_equalities,
         case when t.runs <> 18 then 'insufficient_equality_evidence' when s.absent = t.requests then 'cache_key_absent'
           when s.present = t.requests and c.classes = 1 then 'one_shared_cache_key_class'
           when s.present = t.requests and t.stable and c.classes = 18 and x.n = 0 then 'session_scoped_cache_key_classes'
           when s.present = t.requests then 'mixed_cache_key_classes' else 'incomplete_cache_key_presence' end as classification
       from (select count(*) as runs, cast(sum(n) as bigint) as requests, bool_and(k = 1 and p) as stable from (select arm, round, count(*) as n,
               count(distinct equality_class) as k, bool_and(cache_key_status = 'present') as p from rec group by 1, 2)) t,
         (select count(distinct equality_class) as classes from rec) c,
         (select count(*) filter (cache_key_status = 'present') as present, count(*) filter (cache_key_status = 'absent') as absent from rec) s,
         (select cast(0 as bigint) as n) x""",
    rec=_RECORDS,
)
def equality_study(spark, root):
    records = read(spark, root, "orders").select(
        F.expr("element_at(array('control', 'null', 'treatment'), cast(o_orderkey % 3 + 1 as int))").alias("arm"),
        F.expr("(o_orderkey div 3) % 6").alias("round"), F.col("o_orderkey").alias("request_index"),
        F.expr("case when o_orderkey % 5003 = 0 then 'absent' else 'present' end").alias("cache_key_status"),
        F.expr("case when o_orderkey % 5003 <> 0 then (o_orderkey % 3) * 10 + (o_orderkey div 3) % 6 end").alias("equality_class"),
    )
    return ex.equality_study(records, 18)


# --- verdicts ---------------------------------------------------------------------------------------------------


@query(
    "E16_counter_delta",
    """select a.experiment, a.i - b.i as input_uncached, a.d - b.d as duration_us from (select experiment, cast(sum(input_uncached) as bigint) as i,
         cast(sum(duration_us) as bigint) as d from t_runs group by 1) a join (select experiment, cast(sum(input_uncached) filter (run_id % 4 = 0) as bigint) as i,
         cast(case when experiment = '2' then null else sum(duration_us) filter (run_id % 4 = 0) end as bigint) as d from t_runs group by 1) b using (experiment)""",
)
def counter_delta(spark, root):
    rows = runs(spark, root)
    total = lambda df: df.groupBy("experiment").agg(F.sum("input_uncached").alias("input_uncached"), F.sum("duration_us").alias("duration_us"))
    before = total(rows.where("run_id % 4 = 0")).withColumn("duration_us", F.when(F.col("experiment") != "2", F.col("duration_us")))
    return ex.counter_delta(before, total(rows), ["experiment"], ["input_uncached", "duration_us"])


@query(
    "E18_pilot_verdict",
    """select experiment, count(*) as evaluations, count(*) as rewrites, 0 as recovery_failures, cast(sum(determinism_failures) as bigint) as determinism_failures,
         true as treatment_exercised, 'pilot_quality_requires_follow_up' as decision from t_runs group by 1""",
)
def pilot_verdict(spark, root):
    return ex.pilot_verdict(runs(spark, root), ["experiment"])


@query(
    "E19_provider_gate",
    """select g.experiment, g.m as cardinality_matched, g.e as forwarding_reachable, true as analysis_complete, round((c - t) / c, 9) as median_byte_reduction
       from (select c.experiment, true as m, sum(c.provider_errors + t.provider_errors) = 0 as e from t_runs c join t_runs t on t.experiment = c.experiment
               and t.pair_index = c.pair_index and t.arm = 'treatment' where c.arm = 'control' group by 1) g
       join (select experiment, quantile_cont(forwarded_bytes, 0.5) filter (arm = 'control') as c, quantile_cont(forwarded_bytes, 0.5) filter (arm = 'treatment') as t
             from t_runs group by 1) z using (experiment)""",
)
def provider_gate(spark, root):
    return rounded(ex.provider_gate(paired(spark, root), ["experiment"], "control", "treatment"), "median_byte_reduction")


def _ceil(column, p):
    return (f"(select {column} from (select {column}, row_number() over (order by {column}) as r, count(*) over () as n from t_attempts where {column} is not null)"
            f" where r = greatest(1, least(n, cast(floor(n * {p}::double + 0.999999) as bigint))))")


@query(
    "D43_run_summary",
    f"""select (select count(*) from t_requests) as requests, (select count(*) from t_attempts) as attempts, (select count(*) from t_attempts
           where coalesce(status, 'unknown') <> 'completed' or error_code is not null or transport_error is not null) as errors,
         u.*, (select count(distinct coalesce(transport, 'unavailable')) from t_requests) as transports,
         {_ceil('ttfb_us', 0.5)} as ttfb_us_p50, {_ceil('ttfb_us', 0.95)} as ttfb_us_p95, {_ceil('ttft_us', 0.5)} as ttft_us_p50, {_ceil('ttft_us', 0.95)} as ttft_us_p95,
         {_ceil('duration_us', 0.5)} as duration_us_p50, {_ceil('duration_us', 0.95)} as duration_us_p95
       from (select cast(sum(input_total) as bigint) as input_total, cast(sum(input_uncached) as bigint) as input_uncached, cast(sum(input_cached) as bigint) as input_cached,
               cast(sum(output_total) as bigint) as output_total, cast(sum(output_reasoning) as bigint) as output_reasoning from t_usage) u""",
)
def run_summary(spark, root):
    trace = star_trace(spark, root)
    return ex.run_summary(trace.requests, trace.attempts, trace.usage)


@query(
    "F03_ceiling_rank",
    f"select {_ceil('duration_us', 0.5)} as p50, {_ceil('duration_us', 0.95)} as p95",
)
def ceiling_rank(spark, root):
    from ..functions.ranking import Rank, exact_percentiles

    return exact_percentiles(
        star_trace(spark, root).attempts, [], "duration_us", [Rank("p50", 0.50, "ceil"), Rank("p95", 0.95, "ceil")]
    ).drop("count")


@query(
    "F04_other_ranks",
    """select compressor_id, l[(n - 1) // 2 + 1] as p50, l[least(n - 1, cast(floor(n * 0.95::double) as bigint)) + 1] as p95
       from (select compressor_id, list_sort(list(processing_us)) as l, count(*) as n from t_candidates group by 1)""",
)
def other_ranks(spark, root):
    from ..functions.ranking import Rank, exact_percentiles

    return exact_percentiles(
        star_trace(spark, root).candidates, ["compressor_id"], "processing_us", [Rank("p50", 0, "middle"), Rank("p95", 0.95, "truncated")]
    ).drop("count")


@query(
    "F24_assignment",
    """select task_id, arm, case when ('0x' || substr(o, 1, 2))::int % 2 = 0 then 'control_first' else 'treatment_first' end as pair_order, substr(d, 1, 16) as seed_hex
       from (select p_partkey as task_id, arm, sha256('exp:order:' || p_partkey) as o, sha256('exp:' || p_partkey || ':' || arm) as d
             from part, (values ('Control'), ('Treatment')) a(arm))""",
)
def assignment(spark, root):
    tasks = read(spark, root, "part").select(F.col("p_partkey").alias("task_id"))
    out = ex.deterministic_assignment(tasks, "exp", "task_id", ("Control", "Treatment"))
    seed = F.lower(F.lpad(F.conv(F.col("seed").cast("string"), 10, 16), 16, "0"))
    return out.select("task_id", "arm", "pair_order", seed.alias("seed_hex"))


@query(
    "F26_error_class",
    """select coalesce(case when contains(t, 'sandbox') or contains(t, 'permission denied') then 'sandbox_or_permission'
         when contains(t, 'not found') or contains(t, 'no such file') then 'not_found' when contains(t, 'recursion') then 'recursion' when t <> '' then 'other' end, 'none') as class,
         count(*) as attempts from (select lower(case l_suppkey % 6 when 0 then 'Sandbox denied' when 1 then 'No such file' when 2 then 'recursion limit' when 3 then ''
           when 4 then 'boom' else 'Permission Denied' end) as t from lineitem) group by 1""",
)
def error_class(spark, root):
    text = F.expr(
        "case l_suppkey % 6 when 0 then 'Sandbox denied' when 1 then 'No such file' when 2 then 'recursion limit' when 3 then '' when 4 then 'boom'"
        " else 'Permission Denied' end"
    )
    return read(spark, root, "lineitem").groupBy(F.coalesce(ex.agent_error_class(text), F.lit("none")).alias("class")).agg(
        F.count(F.lit(1)).alias("attempts")
    )


@query(
    "F26_final_outcome",
    """select conv_id, case lower(trim(arg_max(m, turn))) when 'tests failed' then 'failed' when 'tests passed' then 'passed' else 'unknown' end as outcome
       from (select conv_id, turn, case turn % 3 when 0 then ' Tests passed ' when 1 then 'TESTS FAILED' else text end as m from conversations) group by 1""",
)
def final_outcome(spark, root):
    rows = read(spark, root, "conversations").withColumn("m", F.expr("case turn % 3 when 0 then ' Tests passed ' when 1 then 'TESTS FAILED' else text end"))
    return ex.final_outcome(rows, ["conv_id"], "turn", "m", "Tests passed", "Tests failed")
