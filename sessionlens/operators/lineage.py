"""Tool-result lineages: how long a result stays in context, and what evicting it would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import byte_quarter_tokens, token_bucket
from ..functions.measures import ratio
from ..functions.ranking import distribution, join_on_nullable, numbered, running_sum
from ..sources.trace import Trace
from .views import HOUR_US

KEY = ["session_id", "tool_call_id", "exact_fp"]
AGES = (1, 2, 3, 5, 10)
# Estimated tokens of the stub left behind and of the recovery tool's schema.
STUB_TOKENS = 24
SCHEMA_TOKENS = 88
# Policies as (id, minimum age or None for never, minimum tokens).
POLICIES = (("E0", None, 0), ("E1", 1, 0), ("E2", 2, 0), ("E3", 3, 0), ("E4", 2, 512), ("E5", 2, 2048))
SIZES = ("<256", "256-1K", "1K-4K", "4K-16K", ">16K")


def request_order(trace: Trace) -> DataFrame:
    """1-based request ordinal per session over complete snapshots that have blocks."""
    filled = trace.blocks.select("snapshot_id").distinct()
    rows = trace.snapshots.where("status = 'complete'").join(filled, "snapshot_id", "left_semi")
    when = F.coalesce(F.nullif("completed_at_us", F.lit(0)), F.nullif("started_at_us", F.lit(0)), F.lit(0))
    open_ended = F.col("completed_at_us").isNull()
    bucket = open_ended.cast("bigint") * 1000000000 + F.floor(when / HOUR_US)
    return numbered(
        rows.withColumn("__when", when), ["session_id"], [open_ended.asc(), F.col("__when").asc(), F.col("snapshot_id").asc()],
        "request_ordinal", bucket,
    ).select("snapshot_id", "session_id", "provider_request_id", "request_ordinal")


def occurrences(trace: Trace) -> DataFrame:
    """Blocks of complete snapshots with request ordinal and a token count that is never NULL."""
    labels = trace.workloads.select("session_id", "workload")
    kinds = trace.requests.select(F.col("request_id").alias("provider_request_id"), "request_kind")
    return (
        trace.blocks.join(request_order(trace), "snapshot_id")
        .join(labels, "session_id", "left")
        .join(kinds, "provider_request_id", "left")
        .withColumn("tokens", F.coalesce("estimated_tokens", byte_quarter_tokens("raw_bytes")))
        .withColumn("workload", F.coalesce("workload", F.lit("unmapped")))
    )


def exclusions(rows: DataFrame) -> DataFrame:
    """Tool results that cannot be followed, by reason."""
    reason = F.when(F.coalesce("tool_call_id", F.lit("")) == "", "missing_tool_call_id").when(
        F.coalesce("exact_fp", F.lit("")) == "", "missing_exact_fingerprint"
    )
    return (
        rows.where("kind = 'tool_result'").select(reason.alias("reason")).where("reason is not null")
        .groupBy("reason").agg(F.count(F.lit(1)).alias("blocks"))
    )


def followed(rows: DataFrame) -> DataFrame:
    """Tool results with a call association and an exact fingerprint; anything else fails closed."""
    return rows.where(
        "kind = 'tool_result' and coalesce(tool_call_id, '') <> '' and coalesce(exact_fp, '') <> ''"
    )


_CARRIED = ("ordinal", "block_id", "tokens", "raw_bytes", "detected_kind", "tool_name", "workload", "semantic_fp")


def lineages(rows: DataFrame) -> DataFrame:
    """One row per (session, call, exact fingerprint); folds per request first. Results are dealt once, by lineage: both
    folds and joins by lineage follow that deal."""
    dealt = followed(rows).select(*KEY, "request_ordinal", *_CARRIED).repartition(*KEY)
    per_request = dealt.groupBy(*KEY, "request_ordinal").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens").alias("exposure"),
        F.min(F.struct(*_CARRIED)).alias("first"),
    )
    grouped = per_request.groupBy(*KEY).agg(
        F.min("request_ordinal").alias("first_seen"),
        F.max("request_ordinal").alias("last_seen"),
        F.count(F.lit(1)).alias("requests_present"),
        F.sum("n").alias("occurrences"),
        F.sum("exposure").alias("cumulative_exposure"),
        F.min_by(F.struct("n", "first"), F.col("request_ordinal")).alias("start"),
    )
    return grouped.select(
        *KEY, "first_seen", "last_seen", "requests_present", "occurrences", "cumulative_exposure",
        (F.col("last_seen") - F.col("first_seen")).alias("requests_after_creation"),
        (F.col("occurrences") - F.col("start.n")).alias("exact_reappearances"),
        F.col("start.first.tokens").alias("lineage_tokens"),
        F.col("start.first.raw_bytes").alias("lineage_bytes"),
        F.coalesce(F.nullif("start.first.detected_kind", F.lit("")), F.lit("unknown")).alias("content_kind"),
        F.coalesce(F.nullif("start.first.tool_name", F.lit("")), F.lit("unknown")).alias("tool_family"),
        F.col("start.first.workload").alias("workload"),
        F.col("start.first.semantic_fp").alias("lineage_semantic_fp"),
    )


def semantic_reappearances(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per lineage: later rows of other lineages of the session that share its semantic fingerprint.

    Counted as (all later rows with that fingerprint) - (own later rows), from running totals per
    fingerprint, so no pairs of rows are formed.
    """
    keyed = followed(rows).where("semantic_fp is not null")
    per_request = keyed.groupBy("session_id", "semantic_fp", "request_ordinal").agg(F.count(F.lit(1)).alias("n"))
    totals = keyed.groupBy("session_id", "semantic_fp").agg(F.count(F.lit(1)).alias("total"))
    upto = running_sum(
        per_request, ["session_id", "semantic_fp"], [F.col("request_ordinal").asc()], F.col("n"), "through",
        F.floor(F.col("request_ordinal") / 512),
    ).join(totals, ["session_id", "semantic_fp"])
    later = upto.select(
        "session_id", F.col("semantic_fp").alias("lineage_semantic_fp"), F.col("request_ordinal").alias("first_seen"),
        (F.col("total") - F.col("through")).alias("later"),
    )
    own = (
        keyed.select(*KEY, "semantic_fp", "request_ordinal").repartition(*KEY)
        .groupBy(*KEY, "semantic_fp", "request_ordinal").agg(F.count(F.lit(1)).alias("n"))
        .join(found.select(*KEY, "first_seen", "lineage_semantic_fp"), KEY)
        .where("semantic_fp = lineage_semantic_fp and request_ordinal > first_seen")
        .groupBy(*KEY).agg(F.sum("n").alias("own_later"))
    )
    return (
        found.join(later, ["session_id", "lineage_semantic_fp", "first_seen"], "left")
        .join(own, KEY, "left")
        .withColumn(
            "semantic_reappearances", F.coalesce("later", F.lit(0)) - F.coalesce("own_later", F.lit(0))
        )
        .drop("later", "own_later")
    )


def historical(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences after the first request of their lineage, with age."""
    born = found.select(*KEY, "first_seen", "lineage_tokens")
    return (
        followed(rows).join(born, KEY)
        .where("request_ordinal > first_seen")
        .withColumn("age", F.col("request_ordinal") - F.col("first_seen"))
    )


def _total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum("tokens").alias("__total"))


def age_exposure(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Historical exposure at or above each age; rows fold by age before thresholds apply."""
    by_age = historical(rows, found).groupBy("age").agg(F.sum("tokens").alias("t"))
    ages = F.array(*[F.lit(a).cast("bigint") for a in AGES])
    reached = by_age.select(F.explode(F.filter(ages, lambda a: a <= F.col("age"))).alias("age_at_least"), "t")
    grid = rows.sparkSession.range(1).select(F.explode(ages).alias("age_at_least"))
    summed = reached.groupBy("age_at_least").agg(F.sum("t").alias("exposure"))
    return (
        grid.join(summed, "age_at_least", "left")
        .crossJoin(F.broadcast(_total(rows)))
        .select("age_at_least", F.coalesce("exposure", F.lit(0)).alias("exposure"),
                ratio(F.coalesce("exposure", F.lit(0)), "__total").alias("share_of_context"))
    )


def size_age_matrix(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Historical results and exposure by lineage size and minimum age; empty cells are zero."""
    cells = historical(rows, found).groupBy(token_bucket("lineage_tokens").alias("size"), "age").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")
    )
    ages = F.array(*[F.lit(a).cast("bigint") for a in AGES])
    reached = cells.select("size", F.explode(F.filter(ages, lambda a: a <= F.col("age"))).alias("age_at_least"), "n", "t")
    summed = reached.groupBy("size", "age_at_least").agg(F.sum("n").alias("results"), F.sum("t").alias("exposure"))
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SIZES])).alias("size")).select(
        "size", F.explode(ages).alias("age_at_least")
    )
    return (
        grid.join(summed, ["size", "age_at_least"], "left")
        .crossJoin(F.broadcast(_total(rows)))
        .select("size", "age_at_least", F.coalesce("results", F.lit(0)).alias("results"),
                F.coalesce("exposure", F.lit(0)).alias("exposure"),
                ratio(F.coalesce("exposure", F.lit(0)), "__total").alias("share_of_context"))
    )


def lifetime_distributions(found: DataFrame) -> DataFrame:
    """Lifetime in requests over four groupings: kind and tool, kind, tool, workload."""
    key = lambda c, t, w: F.struct(c.alias("content_kind"), t.alias("tool_family"), w.alias("workload"))
    every = F.lit("all")
    content, tool, workload = F.col("content_kind"), F.col("tool_family"), F.col("workload")
    keys = F.array(key(content, tool, every), key(content, every, every), key(every, tool, every), key(every, every, workload))
    long = found.select(F.explode(keys).alias("k"), "requests_after_creation").select("k.*", "requests_after_creation")
    return distribution(long, ["content_kind", "tool_family", "workload"], "requests_after_creation")


def prefix_risk(prefix_ratio: Column) -> Column:
    """Cache risk of changing content at this relative offset."""
    return (
        F.when(prefix_ratio.isNull(), "Unknown").when(prefix_ratio >= 0.9, "Low").when(prefix_ratio >= 0.5, "Medium")
        .otherwise("High")
    )


def _selected(rows: DataFrame, found: DataFrame, policies=POLICIES) -> DataFrame:
    """Historical occurrences with the policies that would evict them, and their cache risk."""
    rules = F.array(*[
        F.when((F.col("age") >= age) & (F.col("lineage_tokens") >= size), F.lit(name))
        for name, age, size in policies if age is not None
    ])
    bytes_of = rows.groupBy("snapshot_id").agg(F.sum("raw_bytes").alias("__bytes"))
    return (
        historical(rows, found)
        .join(bytes_of, "snapshot_id")
        .withColumn("prefix_ratio", ratio("raw_value_start", "__bytes"))
        .withColumn("policy", F.explode(F.array_compact(rules)))
        .withColumn("risk", prefix_risk(F.col("prefix_ratio")))
    )


def eviction_policies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Gross, stub, schema overhead and net reduction per policy, with the cache-risk mix."""
    per_session = (
        _selected(rows, found).groupBy("policy", "session_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("gross"),
            *[F.sum((F.col("risk") == r).cast("bigint")).alias(f"risk_{r.lower()}") for r in ("Low", "Medium", "High", "Unknown")],
        )
    )
    # The schema is sent once per request of an affected session.
    snapshots = rows.groupBy("session_id", "snapshot_id").agg(F.lit(1).alias("x")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("snapshots")
    )
    risks = [f"risk_{r}" for r in ("low", "medium", "high", "unknown")]
    summed = per_session.join(snapshots, "session_id").groupBy("policy").agg(
        F.sum("n").alias("selected"), F.sum("gross").alias("gross"), F.sum("snapshots").alias("snapshots"),
        *[F.sum(r).alias(r) for r in risks],
    )
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p[0]) for p in POLICIES])).alias("policy"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    stub = zero("selected") * STUB_TOKENS
    schema = zero("snapshots") * SCHEMA_TOKENS
    net = zero("gross") - stub - schema
    return (
        grid.join(summed, "policy", "left").crossJoin(F.broadcast(_total(rows)))
        .select(
            "policy", zero("selected").alias("selected"), zero("gross").alias("gross"), stub.alias("stub_overhead"),
            schema.alias("schema_overhead"), net.alias("net"), ratio(net, "__total").alias("net_share"),
            *[zero(r).alias(r) for r in risks],
        )
    )


def eviction_gate(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Best policy and whether eviction is worth a closer look."""
    policies = eviction_policies(rows, found)
    best = policies.agg(
        F.min_by(F.struct("policy", "net_share"), F.struct((-F.coalesce("net_share", F.lit(float("-inf")))).alias("s"), "policy")).alias("b")
    ).select(F.col("b.policy").alias("best_policy"), F.col("b.net_share").alias("best_net_share"))
    past = historical(rows, found).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("historical_exposure"))
    last = rows.groupBy("session_id").agg(F.max("request_ordinal").alias("__last"))
    follow = found.join(last, "session_id").agg(
        F.count(F.lit(1)).alias("lineages"),
        F.count(F.when(F.col("__last") > F.col("first_seen"), 1)).alias("lineages_with_follow_up"),
    )
    marked = rows.where(F.coalesce("request_kind", F.lit("")).startswith("compaction")).select("snapshot_id").distinct().agg(
        F.count(F.lit(1)).alias("compaction_snapshots")
    )
    share = ratio("historical_exposure", "__total")
    worth = (F.coalesce(share, F.lit(0.0)) >= 0.10) | (F.coalesce("best_net_share", F.lit(0.0)) >= 0.05)
    return (
        best.crossJoin(past).crossJoin(follow).crossJoin(marked).crossJoin(_total(rows))
        .select(
            "best_policy", "best_net_share", "historical_exposure", share.alias("historical_share"), "lineages",
            "lineages_with_follow_up", "compaction_snapshots",
            F.when(F.col("lineages_with_follow_up") == 0, "insufficient_follow_up_observation")
            .when(worth, "eviction_may_be_investigated").otherwise("close_without_runtime_eviction").alias("decision"),
        )
    )


def eviction_candidates(rows: DataFrame, found: DataFrame, policies: tuple[str, ...], limit: int) -> DataFrame:
    """Bounded, ordered candidate list; the schema overhead of a policy is spread over its candidates.

    Each candidate carries overhead div n, and the first (overhead mod n) carry one token more.
    """
    chosen = tuple(p for p in POLICIES if p[0] in policies)
    order = ["policy", "session_id", "tool_call_id", "exact_fp", "request_ordinal", "ordinal", "block_id"]
    top = _selected(rows, found, chosen).orderBy(*order).limit(limit)
    sessions = top.select("policy", "session_id").distinct()
    snapshots = rows.groupBy("session_id", "snapshot_id").agg(F.lit(1).alias("x")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("snapshots")
    )
    budget = sessions.join(snapshots, "session_id").groupBy("policy").agg((F.sum("snapshots") * SCHEMA_TOKENS).alias("budget"))
    counts = top.groupBy("policy").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(top, ["policy"], [F.col(c) for c in order[1:]], "place")  # bounded by `limit`
    share = F.expr("budget div n") + ((F.col("place") - 1) < F.expr("budget % n")).cast("bigint")
    return placed.join(F.broadcast(budget.join(counts, "policy")), "policy").select(
        "policy", "session_id", "tool_call_id", "exact_fp", "block_id", "age", "tokens", share.alias("schema_share"),
        (F.col("tokens") - STUB_TOKENS - share).alias("net"), "risk", "prefix_ratio",
    )
