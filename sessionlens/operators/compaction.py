"""Compaction: windows between compactions, the snapshots around them and what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import migrated_kind
from ..functions.measures import count_where, ratio
from ..functions.ranking import distribution, running_sum
from ..schema import COMPACTION_KINDS
from ..sources.trace import Trace
from .delta import survival
from .views import ordered_snapshots, request_usage


def _marked(trace: Trace) -> DataFrame:
    """Snapshots in session order with a compaction flag and the number of compactions before."""
    kinds = trace.requests.select(
        F.col("request_id").alias("provider_request_id"),
        migrated_kind("request_kind").isin(*COMPACTION_KINDS).alias("__c"),
    )
    placed = ordered_snapshots(trace.snapshots).join(kinds, "provider_request_id", "left").withColumn(
        "is_compaction", F.coalesce("__c", F.lit(False))
    )
    upto = running_sum(
        placed, ["session_id"], [F.col("snapshot_order").asc()], F.col("is_compaction").cast("bigint"),
        "through", F.floor(F.col("snapshot_order") / 512),
    )
    # A compaction closes the window it follows.
    return upto.withColumn("window_index", F.col("through") - F.col("is_compaction").cast("bigint"))


def _window_frame(trace: Trace) -> DataFrame:
    """One row per session window with its first and last snapshot and token sums."""
    visible = trace.blocks.groupBy("snapshot_id").agg(F.sum("estimated_tokens").alias("visible"))
    provider = request_usage(trace).select(
        F.col("request_id").alias("provider_request_id"), F.col("input_total").alias("provider")
    )
    marked = _marked(trace)
    counts = marked.groupBy("session_id").agg(count_where(F.col("is_compaction")).alias("compactions")).where(
        "compactions > 0"
    )
    ordinary = (
        marked.where(~F.col("is_compaction"))
        .join(visible, "snapshot_id", "left")
        .join(provider, "provider_request_id", "left")
    )
    filled = ordinary.groupBy("session_id", "window_index").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("visible").alias("visible_estimated_tokens"),
        F.sum("provider").alias("provider_input_tokens"),
        F.min_by(F.struct("snapshot_id", "visible"), F.col("snapshot_order")).alias("first"),
        F.max_by(F.struct("snapshot_id", "visible"), F.col("snapshot_order")).alias("last"),
    )
    grid = counts.select("session_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("compactions"))).alias("window_index"))
    return grid.join(filled, ["session_id", "window_index"], "left").withColumn(
        "requests", F.coalesce("requests", F.lit(0))
    )


def compaction_windows(trace: Trace) -> DataFrame:
    """n compactions split a session into n+1 windows; empty windows stay in."""
    return _window_frame(trace).select(
        "session_id", "window_index", "requests", "visible_estimated_tokens", "provider_input_tokens"
    )


def compaction_pairs(trace: Trace) -> DataFrame:
    """Each compaction with the nearest ordinary snapshot before and after it.

    Works on windows (one row per compaction), not on snapshots: the last snapshot of the nearest
    non-empty earlier window and the first one of the nearest non-empty later window.
    """
    frame = _window_frame(trace)
    order = Window.partitionBy("session_id").orderBy("window_index")
    backward = order.rowsBetween(Window.unboundedPreceding, -1)
    forward = order.rowsBetween(0, Window.unboundedFollowing)
    paired = frame.select(
        "session_id",
        F.col("window_index").alias("compaction_index"),
        F.last("last", ignorenulls=True).over(backward).alias("before"),
        F.first("first", ignorenulls=True).over(forward).alias("after"),
    ).where("compaction_index > 0 and before is not null and after is not null")
    before, after = F.col("before.visible"), F.col("after.visible")
    return paired.select(
        F.concat_ws(":", F.col("session_id").cast("string"), F.col("compaction_index").cast("string")).alias("pair"),
        "session_id",
        "compaction_index",
        F.col("before.snapshot_id").alias("before_id"),
        F.col("after.snapshot_id").alias("after_id"),
        before.alias("before_tokens"),
        after.alias("after_tokens"),
        ratio(before - after, before).alias("context_reduction"),
    )


def compaction_survival(trace: Trace) -> DataFrame:
    """Token-weighted survival by content kind over all compactions."""
    per_pair = survival(compaction_pairs(trace), trace.blocks)
    return per_pair.groupBy("name").agg(
        F.sum("before_tokens").alias("before_tokens"), F.sum("survived_tokens").alias("survived_tokens")
    ).withColumn("survival_share", ratio("survived_tokens", "before_tokens"))


def compaction_summary(trace: Trace) -> DataFrame:
    """Counts by protocol, trigger and observed output, pairs and the reduction distribution."""
    requests = trace.requests.withColumn("kind", migrated_kind("request_kind")).where(
        F.col("kind").isin(*COMPACTION_KINDS)
    )
    outputs = trace.attempts.where("compaction_output_seen").select("request_id").distinct().withColumn(
        "__seen", F.lit(True)
    )
    counts = requests.join(outputs, "request_id", "left").agg(
        F.count(F.lit(1)).alias("requests"),
        count_where(F.col("kind") == "compaction_v2").alias("v2_requests"),
        count_where(F.col("kind") == "compaction_legacy").alias("legacy_requests"),
        F.count("compaction_trigger").alias("trigger_seen"),
        F.count("__seen").alias("output_seen"),
    )
    pairs = compaction_pairs(trace)
    total = pairs.agg(F.count(F.lit(1)).alias("pre_post_pairs"))
    spread = distribution(pairs, [], "context_reduction", width=0.01)
    renamed = spread.select(*[F.col(c).alias(f"reduction_{c}") for c in spread.columns])
    return counts.crossJoin(total).crossJoin(renamed)


def trigger_counts(trace: Trace) -> DataFrame:
    """Compaction requests per trigger."""
    rows = trace.requests.where(migrated_kind("request_kind").isin(*COMPACTION_KINDS))
    return rows.where("compaction_trigger is not null").groupBy("compaction_trigger").agg(
        F.count(F.lit(1)).alias("requests")
    )
