"""Snapshot deltas: what repeats, changes, appears and disappears between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import count_where
from ..functions.ranking import numbered
from ..sources.trace import Trace
from .views import ordered_snapshots


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with its predecessor in the session.

    Places are unique per session, so this is an equi join on (session, place) instead of a window
    over a session that may be very long.
    """
    placed = ordered_snapshots(snapshots)
    before = placed.select(
        "session_id", (F.col("snapshot_order") + 1).alias("snapshot_order"),
        F.col("snapshot_id").alias("previous_snapshot_id"), F.col("status").alias("previous_status"),
    )
    return placed.join(before, ["session_id", "snapshot_order"]).select(
        "session_id", F.col("snapshot_id").alias("current_snapshot_id"), "previous_snapshot_id",
        F.col("status").alias("current_status"), "previous_status",
    )


#: Positions in one piece of a snapshot, for row numbers and for the common prefix; blocks of a snapshot, and of both
#: sides of a pair, that one task may take.
PIECE, LARGE = 4096, 1 << 17


def context_deltas(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Delta per pair: exact multiset match first, then semantic match among the leftovers.

    Both sides of a pair are stacked. Pairs of up to `LARGE` blocks are dealt by pair once and matched where they are.
    Larger ones must not land in one task: matching is work inside one fingerprint of a pair, so their rows are dealt
    by (pair, exact fingerprint) and then by (pair, semantic fingerprint); rows without a fingerprint match
    nothing and are dealt by their position. Their common prefix is found in pieces of `PIECE` positions,
    whose first mismatches meet as one row a piece. No step on them has the pair alone as its key but the last
    sums, which are combined before they are shuffled: a snapshot with a tenth of all blocks is spread
    over as many tasks as the others.
    """
    columns = ["position", "exact_fp", "semantic_fp", "estimated_tokens"]
    size = blocks.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("size"))
    limits = (
        pairs.join(size.select(F.col("snapshot_id").alias("current_snapshot_id"), F.col("size").alias("cs")),
                   "current_snapshot_id", "left")
        .join(size.select(F.col("snapshot_id").alias("previous_snapshot_id"), F.col("size").alias("ps")),
              "previous_snapshot_id", "left")
        .select(
            "current_snapshot_id", "previous_snapshot_id",
            F.coalesce("cs", F.lit(0)).alias("cs"), F.coalesce("ps", F.lit(0)).alias("ps"),
            (
                (F.coalesce("current_status", F.lit("")) != "complete")
                | (F.coalesce("previous_status", F.lit("")) != "complete")
            ).alias("limited"),
        )
    )
    placed = blocks if "position" in blocks.columns else numbered(
        blocks.select("snapshot_id", "ordinal", *columns[1:]), ["snapshot_id"], [F.col("ordinal")], "position", F.floor(F.col("ordinal") / PIECE), most=LARGE
    )
    kept = placed.select("snapshot_id", *columns)

    def sides(some: DataFrame) -> DataFrame:
        side = lambda column, now: some.select(
            F.col("current_snapshot_id").alias("pair"), F.col(column).alias("snapshot_id")
        ).join(kept, "snapshot_id").select("pair", F.lit(now).alias("now"), *columns)
        return side("current_snapshot_id", True).unionByName(side("previous_snapshot_id", False))

    # fewer pairs are large than blocks are in two snapshots a `LARGE`th
    is_large = F.col("cs") + F.col("ps") > LARGE
    rows = sides(F.broadcast(limits.where(is_large)))
    counted = _matched(rows).join(_prefixes(rows), "pair").unionByName(_compared(sides(limits.where(~is_large))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    cut = F.col("cs") == F.col("ps")
    unsure = F.col("limited") & ~F.coalesce("__mismatch", F.lit(False)) & cut
    empty = F.col("pair").isNull()  # neither side has a block
    return limits.join(counted, limits.current_snapshot_id == counted.pair, "left").select(
        "current_snapshot_id", "previous_snapshot_id",
        F.when(F.col("limited"), "resource_limit").otherwise("complete").alias("status"),
        zero("repeated_blocks").alias("repeated_blocks"), zero("new_blocks").alias("new_blocks"),
        zero("changed_blocks").alias("changed_blocks"), zero("removed_blocks").alias("removed_blocks"),
        F.when(empty, F.lit(0)).otherwise(F.col("repeated_tokens")).alias("repeated_tokens"),
        F.when(empty, F.lit(0)).otherwise(F.col("new_tokens")).alias("new_tokens"),
        F.when(~unsure, zero("__prefix")).alias("common_prefix_blocks"),
        F.when(~unsure, F.when(empty, F.lit(0)).otherwise(F.col("__prefix_tokens"))).alias("common_prefix_tokens"),
    )


def _tokens(flag: str) -> Column:
    """Tokens of the flagged rows, NULL if one of them has none."""
    return F.when(
        count_where(F.col(flag) & F.col("estimated_tokens").isNull()) == 0,
        F.coalesce(F.sum(F.when(F.col(flag), F.col("estimated_tokens"))), F.lit(0)),
    )


def _compared(rows: DataFrame) -> DataFrame:
    """`_matched` and `_prefixes` of small pairs, which are dealt once."""
    here = Window.partitionBy("pair", "position")
    of = lambda side: F.max(F.when(side, F.col("exact_fp"))).over(here)
    met = rows.repartition("pair").withColumn("both", F.count(F.lit(1)).over(here) == 2)
    met = met.withColumn("same", F.coalesce(F.col("both") & (of(F.col("now")) == of(~F.col("now"))), F.lit(False)))
    met = met.withColumn("stop", F.min(F.when(~F.col("same"), F.col("position"))).over(Window.partitionBy("pair")))
    clean = F.col("now") & (F.col("stop").isNull() | (F.col("position") < F.col("stop")))
    met = met.withColumn("mismatch", F.col("both") & ~F.col("same")).withColumn("clean", clean).drop("both", "same", "stop")
    return _matched(met, dealt=True)


def _matched(rows: DataFrame, dealt: bool = False) -> DataFrame:
    """Repeated, changed, new and removed blocks of each pair; `dealt` rows are together by pair and hold what the common
    prefix is summed from."""
    deal = lambda frame, column: frame if dealt else frame.repartition("pair", column)
    prefix = ["mismatch", "clean"] if dealt else []
    now, then = F.col("now"), ~F.col("now")
    alone = F.concat(F.lit("#"), F.col("now").cast("string"), F.col("position").cast("string"))  # a fingerprint is hex
    over = lambda *keys: Window.partitionBy("pair", *keys)
    rank = lambda *keys: F.row_number().over(over(*keys).orderBy("position"))
    total = lambda condition, *keys: F.sum(condition.cast("int")).over(over(*keys))
    known = F.col("exact_fp").isNotNull()
    step = deal(rows.withColumn("__exact", F.coalesce("exact_fp", alone)), "__exact")
    step = step.withColumn("repeated", now & known & (rank("__exact", "now") <= total(then, "__exact")))
    step = step.withColumn("used", total(F.col("repeated"), "__exact")).withColumn(
        "preferred",
        then & known & (rank("__exact", "semantic_fp", "now") <= total(F.col("repeated"), "__exact", "semantic_fp")),
    )
    step = step.withColumn("open", F.col("used") - total(F.col("preferred"), "__exact")).withColumn(
        "taken",
        F.col("preferred")
        | (then & known & ~F.col("preferred") & (rank("__exact", "now", "preferred") <= F.col("open"))),
    )
    step = step.withColumn("left_over", then & ~F.col("taken")).withColumn(
        "seeks", now & ~F.col("repeated") & F.col("semantic_fp").isNotNull()
    )
    step = step.select("pair", "now", "position", "semantic_fp", "estimated_tokens", "repeated", "left_over", "seeks", *prefix)
    step = deal(step.withColumn("__semantic", F.coalesce("semantic_fp", alone)), "__semantic")
    step = step.withColumn("changed", F.col("seeks") & (rank("__semantic", "seeks") <= total(F.col("left_over"), "__semantic")))
    step = step.withColumn("new", now & ~F.col("repeated") & ~F.col("changed"))
    return step.groupBy("pair").agg(
        count_where(F.col("repeated")).alias("repeated_blocks"),
        count_where(F.col("changed")).alias("changed_blocks"),
        count_where(F.col("new")).alias("new_blocks"),
        (count_where(F.col("left_over")) - count_where(F.col("changed"))).alias("removed_blocks"),
        _tokens("repeated").alias("repeated_tokens"),
        _tokens("new").alias("new_tokens"),
        *([F.bool_or("mismatch").alias("__mismatch"), count_where(F.col("clean")).alias("__prefix"), _tokens("clean").alias("__prefix_tokens")] if dealt else []),
    )


def _prefixes(rows: DataFrame) -> DataFrame:
    """Length and tokens of the common prefix of each pair, and whether the two sides differ at a common position."""
    now = F.col("now")
    piece = F.floor((F.col("position") - 1) / PIECE)
    met = rows.withColumn("piece", piece).repartition("pair", "piece").groupBy("pair", "piece", "position").agg(
        F.max(F.when(now, F.col("exact_fp"))).alias("here"),
        F.max(F.when(~now, F.col("exact_fp"))).alias("there"),
        (F.count(F.lit(1)) == 2).alias("both"),
        F.bool_or(now).alias("now"),
        F.max(F.when(now, F.col("estimated_tokens"))).alias("estimated_tokens"),
    )
    met = met.withColumn("same", F.coalesce(F.col("both") & (F.col("here") == F.col("there")), F.lit(False)))
    so_far = Window.partitionBy("pair", "piece").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("clean", F.bool_and("same").over(so_far))
    pieces = met.groupBy("pair", "piece").agg(
        F.bool_and("same").alias("whole"),
        F.bool_or(F.col("both") & ~F.col("same")).alias("mismatch"),
        count_where(F.col("clean") & F.col("now")).alias("n"),
        count_where(F.col("clean") & F.col("estimated_tokens").isNull()).alias("unknown"),
        F.sum(F.when(F.col("clean"), F.col("estimated_tokens"))).alias("tokens"),
    )
    # the pieces up to the first that is not common as a whole
    broken = pieces.groupBy("pair").agg(F.min(F.when(~F.col("whole"), F.col("piece"))).alias("last"), F.bool_or("mismatch").alias("__mismatch"))
    counts = F.col("last").isNull() | (F.col("piece") <= F.col("last"))
    return pieces.join(broken, "pair").groupBy("pair").agg(
        F.first("__mismatch").alias("__mismatch"),
        F.coalesce(F.sum(F.when(counts, F.col("n"))), F.lit(0)).alias("__prefix"),
        F.when(F.coalesce(F.sum(F.when(counts, F.col("unknown"))), F.lit(0)) == 0, F.coalesce(F.sum(F.when(counts, F.col("tokens"))), F.lit(0))).alias("__prefix_tokens"),
    )


def trace_deltas(trace: Trace) -> DataFrame:
    return context_deltas(snapshot_pairs(trace.snapshots), trace.blocks)


def reconcile(
    frame: DataFrame, local: str, provider: str, context_status: str, comparable=None
) -> DataFrame:
    """Compare the local estimate with provider input: comparability first, residual only if allowed."""
    allowed = F.lit(True) if comparable is None else comparable
    status = (
        F.when(F.col(provider).isNull(), "missing_provider_usage")
        .when(F.col(local).isNull(), "missing_local_estimate")
        .when(~allowed, "not_comparable")
        .when(F.col(context_status) == "explicit_only", "comparable_approximate")
        .otherwise("partial_visibility")
    )
    residual = F.when(status.isin("comparable_approximate", "partial_visibility"), F.col(provider) - F.col(local))
    return frame.withColumn("comparability", status).withColumn("residual_tokens", residual)


def survival(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Survived tokens by content kind between a `before` and an `after` snapshot per pair.

    Matching is a multiset match on the semantic, else exact, fingerprint in block order: the later side is one count a
    fingerprint, and the earlier side is ranked in pieces, so that no pair and no fingerprint is gathered.
    """
    fingerprint = F.coalesce("semantic_fp", "exact_fp")
    field = F.when(F.col("semantic_fp").isNotNull(), "semantic").otherwise("exact")
    rows = blocks.select(
        "snapshot_id", "ordinal", "estimated_tokens", fingerprint.alias("fp"), field.alias("field"),
        F.coalesce(F.nullif("detected_kind", F.lit("")), F.lit("unknown")).alias("name"),
    )
    before = pairs.select("pair", F.col("before_id").alias("snapshot_id")).join(rows, "snapshot_id").where(
        "estimated_tokens is not null"
    )
    after = pairs.select("pair", F.col("after_id").alias("snapshot_id")).join(rows, "snapshot_id").where("fp is not null")
    later = after.groupBy("pair", "field", "fp").agg(F.count(F.lit(1)).alias("later"))
    ranked = numbered(before, ["pair", "field", "fp"], [F.col("ordinal")], "rank", F.floor(F.col("ordinal") / PIECE))
    matched = ranked.join(later, ["pair", "field", "fp"], "left").withColumn("kept", F.col("rank") <= F.col("later"))
    return matched.groupBy("pair", "name").agg(
        F.sum("estimated_tokens").alias("before_tokens"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("estimated_tokens"))), F.lit(0)).alias("survived_tokens"),
    )
