"""Repetition and persistence inside sessions: everything after a first occurrence.

These are set forms: rows fold to one row per (session, fingerprint, snapshot), then to one per
(session, fingerprint). No row is ranked. Rows are dealt once, by session and fingerprint: a session or a fingerprint
holding a third of all rows is many tasks, what one session has of one fingerprint is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import or_unknown, ratio
from ..functions.ranking import distribution, numbered
from ..sources.trace import Trace
from .composition import subtotal_by
from .views import ordered_snapshots, placed_blocks


def _keyed(blocks: DataFrame) -> DataFrame:
    """One row per block and known fingerprint: field `exact` or `semantic`, fingerprint `fp`."""
    fields = F.array(
        F.struct(F.lit("semantic").alias("field"), F.col("semantic_fp").alias("fp")),
        F.struct(F.lit("exact").alias("field"), F.col("exact_fp").alias("fp")),
    )
    return (
        blocks.withColumn("__f", F.explode(fields))
        .select("*", F.col("__f.field").alias("field"), F.col("__f.fp").alias("fp"))
        .drop("__f")
        .where("fp is not null")
        .withColumn("tokens", F.coalesce("estimated_tokens", F.lit(0)))
    )


def _packed(field: Column, fp: Column) -> Column:
    """Field and fingerprint as bytes: one for the field, one for the form, then the digest. Hexadecimal digests take half
    their letters; nothing else is touched, so different fingerprints stay different."""
    tag = F.when(field == "exact", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    digits = F.when(fp.rlike("^([0-9a-f]{2})+$"), F.concat(F.unhex(F.lit("00")), F.unhex(fp)))
    return F.concat(tag, F.coalesce(digits, F.concat(F.unhex(F.lit("01")), fp.cast("binary"))))


def _dealt(blocks: DataFrame, labels: list[Column]) -> DataFrame:
    """Keyed rows, narrow, dealt by (session, fingerprint): what follows with these among its keys needs no other shuffle."""
    rows = _keyed(blocks).select(
        "session_id", _packed(F.col("field"), F.col("fp")).alias("__key"), "snapshot_order", "ordinal", "block_id", "estimated_tokens", *labels
    )
    return rows.repartition("session_id", "__key").withColumn("tokens", F.coalesce("estimated_tokens", F.lit(0)))


def _per_fingerprint(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Dealt rows folded to one per (session, field, fingerprint)."""
    per_snapshot = rows.groupBy("session_id", "__key", "snapshot_order").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens").alias("tokens"),
        F.min(F.struct("ordinal", "block_id", "estimated_tokens", *labels)).alias("first"),
    )
    folded = per_snapshot.groupBy("session_id", "__key").agg(
        F.sum("n").alias("n"),
        F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("persistence"),
        F.sum(F.col("n") - 1).alias("within_blocks"),
        # integer pieces of tokens*(n-1)/n cannot be added exactly as doubles in any order, so the
        # fractions are summed as decimals
        F.sum((F.col("tokens") * (F.col("n") - 1)).cast("decimal(38,12)") / F.col("n")).alias("within_tokens"),
        F.min_by(F.struct("n", "tokens", "first"), F.col("snapshot_order")).alias("start"),
    )
    field = F.when(F.substring("__key", 1, 1) == F.unhex(F.lit("00")), "exact").otherwise("semantic")
    return folded.withColumn("field", field)


def fingerprint_groups(blocks: DataFrame, labels: list[str]) -> DataFrame:
    """One row per (session, field, fingerprint).

    `n`, `tokens`: all occurrences; `persistence`: distinct snapshots; `start`: the occurrences in the earliest
    snapshot and the first of them, with its `labels`; `within_*`: repeats inside snapshots.
    """
    return _per_fingerprint(_dealt(blocks, [F.col(c) for c in labels]), labels)


def _detected_blocks(trace: Trace) -> DataFrame:
    return placed_blocks(trace).withColumn("detected", or_unknown("detected_kind"))


def repetition_facts(trace: Trace) -> DataFrame:
    """Sums over the fingerprint groups of one field, content kind of the first occurrence and persistence.

    One small table that session repetition, persistence, presence and ranking are read from. Semantic
    and exact digests are both counted; their key spaces do not overlap.
    """
    first = F.col("start.first.estimated_tokens")
    return fingerprint_groups(_detected_blocks(trace), ["detected"]).groupBy(
        "field", F.col("start.first.detected").alias("detected"), "persistence"
    ).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") - 1).alias("repeated_blocks"),
        F.sum(F.col("tokens") - F.coalesce(first, F.lit(0))).alias("repeated_tokens"),
        F.sum("within_blocks").alias("within_blocks"),
        F.sum("within_tokens").alias("within_tokens"),
        F.sum(F.col("n") - F.col("start.n")).alias("cross_blocks"),
        F.sum(F.col("tokens") - F.col("start.tokens")).alias("cross_tokens"),
        F.sum(first).alias("first_tokens"),
    )


def presence_facts(trace: Trace) -> DataFrame:
    """Per content kind: estimated tokens, fingerprints known and the tokens they stand for."""
    known = F.col("semantic_fp").isNotNull().cast("bigint") + F.col("exact_fp").isNotNull().cast("bigint")
    return _detected_blocks(trace).groupBy("detected").agg(
        F.sum("estimated_tokens").alias("estimated_tokens"), F.sum(known).alias("known"),
        F.sum(known * F.coalesce("estimated_tokens", F.lit(0))).alias("effective_tokens"),
    )


def session_repetition(trace: Trace, facts: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """Repeated blocks and tokens per field, split into within one request and across requests."""
    facts = repetition_facts(trace) if facts is None else facts
    present = placed_blocks(trace) if present is None else present
    total = present.agg(F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_token_total"))
    return (
        facts.groupBy("field")
        .agg(
            F.sum("repeated_blocks").alias("repeated_blocks"),
            F.sum("repeated_tokens").alias("repeated_tokens"),
            F.sum("within_blocks").alias("within_blocks"),
            F.bround(F.sum("within_tokens"), 0).cast("bigint").alias("within_tokens"),
            F.sum("cross_blocks").alias("cross_blocks"),
            F.sum("cross_tokens").alias("cross_tokens"),
        )
        .crossJoin(F.broadcast(total))
        .withColumn("repeated_token_share", ratio("repeated_tokens", "estimated_token_total"))
    )


def persistence_distribution(trace: Trace, facts: DataFrame | None = None) -> DataFrame:
    """Distribution of distinct snapshots per fingerprint, overall (`all`) and by first content kind."""
    facts = repetition_facts(trace) if facts is None else facts
    kinds = F.array(F.lit("all"), F.col("detected"))
    long = facts.select(F.explode(kinds).alias("name"), "persistence", "groups")
    average = long.groupBy("name").agg(_average_persistence())
    return distribution(long, ["name"], "persistence", weight="groups").join(average, "name")


def _average_persistence() -> Column:
    return (F.sum(F.col("persistence") * F.col("groups")) / F.sum("groups")).alias("average")


def effective_presence(trace: Trace, facts: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """Tokens present, unique information, redundancy, mean persistence and redundant exposure by kind."""
    facts = repetition_facts(trace) if facts is None else facts
    present = presence_facts(trace) if present is None else present
    first = facts.groupBy("detected").agg(
        F.coalesce(F.sum("first_tokens"), F.lit(0)).alias("__first"),
        F.coalesce(F.sum(F.when(F.col("field") == "semantic", F.col("first_tokens"))), F.lit(0)).alias("unique_tokens"),
        _average_persistence().alias("average_persistence"),
    )
    return (
        present.where("known > 0").select("detected", "effective_tokens").join(first, "detected", "left")
        .select(
            F.col("detected").alias("name"),
            "effective_tokens",
            F.coalesce("unique_tokens", F.lit(0)).alias("unique_tokens"),
            ratio("effective_tokens", "unique_tokens").alias("redundancy_factor"),
            "average_persistence",
            (F.col("effective_tokens") - F.coalesce("__first", F.lit(0))).alias("repeated_tokens"),
        )
        .withColumn(
            "redundant_exposure", F.col("repeated_tokens") * F.coalesce("average_persistence", F.lit(1.0))
        )
    )


#: Keys that blocks without a fingerprint are dealt over.
UNKEYED = 4096


def _all_keyed(blocks: DataFrame, names: list[str]) -> DataFrame:
    """Blocks with their packed fingerprints, one row each; every block is the `lead` of one row, and one without
    fingerprints has a row whose key is a number."""
    semantic, exact = F.col("__semantic"), F.col("__exact")
    unkeyed = F.concat(F.unhex(F.lit("02")), F.pmod(F.xxhash64("block_id", "ordinal"), F.lit(UNKEYED)).cast("string").cast("binary"))
    rows = F.array(
        F.struct(F.coalesce(semantic, F.when(exact.isNull(), unkeyed)).alias("key"), F.lit(True).alias("lead")),
        F.struct(exact.alias("key"), semantic.isNull().alias("lead")),
    )
    kept = ["session_id", "snapshot_order", "ordinal", "block_id", "estimated_tokens", *names]
    return blocks.select(*kept, F.explode(rows).alias("__r")).where("__r.key is not null").select(
        *kept, F.col("__r.key").alias("__key"), F.col("__r.lead").alias("lead")
    )


def repetition_by_group(trace: Trace, fields: list[str]) -> DataFrame:
    """Repetition and persistence broken down by structural columns.

    Blocks meet their snapshots once, with fingerprints as bytes, and are dealt once, by session and fingerprint; sums,
    first occurrences and persistence come from the same folded rows.
    """
    names = [f"g_{f}" for f in fields]
    packed = lambda field: F.when(F.col(f"{field}_fp").isNotNull(), _packed(F.lit(field), F.col(f"{field}_fp"))).alias(f"__{field}")
    blocks = trace.blocks.select(
        "snapshot_id", "ordinal", "block_id", "estimated_tokens", *[or_unknown(f).alias(g) for f, g in zip(fields, names)], packed("semantic"), packed("exact")
    )
    place = ordered_snapshots(trace.snapshots).select("snapshot_id", "session_id", "snapshot_order")
    known, lead = F.coalesce("estimated_tokens", F.lit(0)), F.col("lead")
    per_snapshot = _all_keyed(blocks.join(place, "snapshot_id"), names).repartition("session_id", "__key").groupBy(
        "session_id", "__key", *names, "snapshot_order"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(known).alias("tokens"), F.count(F.when(lead, 1)).alias("blocks"),
        F.sum(F.when(lead, F.col("estimated_tokens"))).alias("estimated"),
        F.min(F.struct("ordinal", "block_id", "estimated_tokens", *names)).alias("first"),
    )
    folded = per_snapshot.groupBy("session_id", "__key", *names).agg(
        *[F.sum(c).alias(c) for c in ("n", "tokens", "blocks", "estimated")], F.count(F.lit(1)).alias("persistence"),
        F.min(F.struct("snapshot_order", "first")).alias("start"),
    )
    tag = F.substring("__key", 1, 1)
    of = {field: tag == F.unhex(F.lit(code)) for field, code in (("exact", "00"), ("semantic", "01"))}
    begun = F.row_number().over(Window.partitionBy("session_id", "__key").orderBy("start")) == 1
    first = folded.withColumn("__begun", begun).withColumn("__tokens", F.coalesce("start.first.estimated_tokens", F.lit(0)))
    keyed = F.when(of["exact"] | of["semantic"], F.col("persistence"))
    repeated = []
    for field, here in of.items():
        new = here & F.col("__begun")
        repeated += [
            (F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)) - F.count(F.when(new, 1))).alias(f"{field}_repeated_blocks"),
            (F.coalesce(F.sum(F.when(here, F.col("tokens"))), F.lit(0)) - F.coalesce(F.sum(F.when(new, F.col("__tokens"))), F.lit(0))).alias(f"{field}_repeated_tokens"),
        ]
    unique = F.coalesce(F.sum(F.when(of["semantic"] & F.col("__begun"), F.col("__tokens"))), F.lit(0))
    groups = first.groupBy(*names).agg(
        F.sum("blocks").alias("block_count"), F.coalesce(F.sum("estimated"), F.lit(0)).alias("estimated_tokens"), *repeated, unique.alias("unique_tokens"),
        F.avg(keyed).alias("average_persistence"), F.max(keyed).alias("max_persistence"),
    )
    whole = F.sum("estimated_tokens").over(Window.partitionBy())  # one row a group
    return groups.withColumn("__all", whole).select(
        *[F.col(g).alias(f) for f, g in zip(fields, names)],
        "block_count", "estimated_tokens", ratio("estimated_tokens", "__all").alias("token_share"),
        "exact_repeated_blocks", "exact_repeated_tokens", "semantic_repeated_blocks", "semantic_repeated_tokens", "unique_tokens",
        ratio("estimated_tokens", "unique_tokens").alias("redundancy_factor"),
        "average_persistence", "max_persistence",
    )


#: Rows of one fingerprint in one session that one task may number.
LARGE_FINGERPRINT = 1 << 18


def occurrence_index(trace: Trace, column: str = "exact_fp") -> DataFrame:
    """(block_id, occurrence): rank of each block among the blocks of its session sharing its fingerprint (1 = first).

    Only the rows' places are dealt, once, by session and fingerprint. Fingerprints with more than `LARGE_FINGERPRINT` rows
    in a session take buckets of snapshots.
    """
    rows = placed_blocks(trace).where(F.col(column).isNotNull()).select(
        "session_id", _packed(F.lit("exact"), F.col(column)).alias("__key"), "snapshot_order", "ordinal", "block_id"
    )
    return numbered(
        rows, ["session_id", "__key"], [F.col("snapshot_order").asc(), F.col("ordinal").asc()], "occurrence",
        F.floor(F.col("snapshot_order") / 256), most=LARGE_FINGERPRINT,
    ).select("block_id", "occurrence")


# How controllable a content kind is and how safe changing it is; anything else 0.4 / 0.4.
CONTROLS = {
    "tool_definition": (1.0, 0.95), "tool_result": (0.9, 0.85), "json": (0.9, 0.8),
    "search_results": (0.9, 0.85), "logs": (0.8, 0.7), "test_results": (0.8, 0.75),
    "source_code": (0.5, 0.45), "diff": (0.5, 0.5), "plain_text": (0.7, 0.7),
    "assistant_history": (0.3, 0.3), "unknown": (0.2, 0.2),
}


def opportunity_ranking(
    trace: Trace, alias_log: bool = False, facts: DataFrame | None = None, present: DataFrame | None = None
) -> DataFrame:
    """Content kinds ranked by share, redundancy, persistence, confidence, control and safety.

    The weight table is keyed `logs`; `alias_log` gives the detector's `log` the same weights.
    """
    controls = dict(CONTROLS)
    if alias_log:
        controls["log"] = controls["logs"]
    weights = F.create_map(*[F.lit(v) for k, (c, _) in controls.items() for v in (k, c)])
    safety = F.create_map(*[F.lit(v) for k, (_, s) in controls.items() for v in (k, s)])
    detected = subtotal_by(trace.blocks, "detected_kind").select("name", "estimated_tokens", "token_share")
    details = effective_presence(trace, facts, present).select(
        "name", "redundancy_factor", F.col("average_persistence").alias("persistence")
    )
    # A zero or missing factor counts as 1, both for the row and for the maximum.
    one = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(c))
    tops = details.agg(
        F.coalesce(F.max(one("redundancy_factor")), F.lit(1.0)).alias("__r"),
        F.coalesce(F.max(one("persistence")), F.lit(1.0)).alias("__p"),
    )
    estimator = trace.blocks.agg(ratio(F.count("estimated_tokens"), F.count(F.lit(1))).alias("__e"))
    semantic = trace.metrics.agg(
        (F.sum("semantic_coverage_bp") / (F.count("semantic_coverage_bp") * 10000.0)).alias("__s")
    )
    confidence = F.coalesce("__e", F.lit(0.0)) * F.coalesce("__s", F.lit(0.0))
    control = F.coalesce(weights[F.col("name")], F.lit(0.4))
    safe = F.coalesce(safety[F.col("name")], F.lit(0.4))
    score = (
        F.coalesce("token_share", F.lit(0.0)) * (one("redundancy_factor") / F.col("__r"))
        * (one("persistence") / F.col("__p")) * confidence * control * safe
    )
    return (
        detected.join(details, "name", "left")
        .crossJoin(F.broadcast(tops.crossJoin(estimator).crossJoin(semantic)))
        .select(
            "name", score.alias("priority_score"), "estimated_tokens", "token_share", "redundancy_factor",
            "persistence", confidence.alias("measurement_confidence"), control.alias("controllability"),
            safe.alias("semantic_safety"),
        )
        .orderBy(F.col("priority_score").desc(), "name")
    )


def top_ranked(ranking: DataFrame, k: int = 3) -> DataFrame:
    """Names of the k best candidates in rank order (the ranking has one row per content kind)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("priority_score")).alias("s"), "name")))
    return ranking.agg(F.transform(F.slice(ordered, 1, k), lambda r: r["name"]).alias("top"))


def opportunities_view(trace: Trace) -> DataFrame:
    """Ranking beside effective presence."""
    presence = effective_presence(trace).select("name", "effective_tokens", "unique_tokens", "redundant_exposure")
    return opportunity_ranking(trace).join(presence, "name", "left")


def stable_prefix(trace: Trace) -> DataFrame:
    """Stable-prefix totals and the delta roll-up; a total without any value stays NULL."""
    prefix = trace.metrics.agg(
        F.coalesce(F.sum("stable_prefix_estimate"), F.lit(0)).alias("prefix_tokens"),
        F.avg("stable_prefix_estimate").alias("mean_prefix_tokens"),
    )
    total = trace.blocks.agg(F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("__total"))
    rolled = trace.deltas.agg(
        *[F.sum(c).alias(c) for c in ("repeated_blocks", "new_blocks", "changed_blocks", "removed_blocks",
                                      "repeated_tokens", "new_tokens", "common_prefix_tokens")]
    )
    return (
        prefix.crossJoin(total).withColumn("prefix_share", ratio("prefix_tokens", "__total")).drop("__total")
        .crossJoin(rolled)
    )
