"""The append-only event log: sink, running counters, drop accounting, stale sessions, live deltas."""

from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import count_where
from ..operators.delta import context_deltas
from ..sources.trace import Trace

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Folders that ids are dealt over by their hash; a micro-batch reads those that its own ids fall into.
BUCKETS = 256


def append_events(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Start the append-only sink: an event id enters the log once, however late its repeats come.

    The log is laid out by writer, batch and hash of the id. A micro-batch reads the ids of the buckets that its own
    ids fall into, and leaves out what stands there already; so reading grows with the batch, not with the
    log. It writes to a folder of its query's id and its number: a batch that is run again writes the same
    again, and a query with a new checkpoint never touches what others wrote. No event is dropped for
    being late. The number of buckets must stay the same for the life of a log.
    """
    writer: list[str] = []

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not writer:  # the id that the checkpoint keeps for the query
            writer.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        own = f"{writer[0]}-{number}"
        fresh = batch.dropDuplicates(["event_id"]).withColumn("bucket", F.pmod(F.xxhash64(F.col("event_id").cast("string")), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if touched and root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            logged = spark.read.parquet(path).where(F.col("bucket").isin(touched) & (F.col("batch") != own)).select("event_id", "bucket")
            fresh = fresh.join(logged, ["event_id", "bucket"], "left_anti")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={own}")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counters(events: DataFrame) -> DataFrame:
    """Running count per session and event type."""
    return events.groupBy("session_id", "event_type").agg(F.count(F.lit(1)).alias("events"))


def windowed_counters(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The same with bounded state: counts per window, closed by the watermark."""
    source = events.withWatermark("timestamp", delay) if events.isStreaming else events
    return source.groupBy(F.window("timestamp", size), "event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("window_start"), "event_type", "events"
    )


def run_to_table(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is available and read its result: the rows of all micro-batches, or of the last in
    complete mode. Each is written to a folder of its number, so one that is run again writes the same again."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(path)
    if mode == "complete":
        written = written.where(F.col("batch") == written.agg(F.max("batch")).first()[0])
    return written.drop("batch")


def drop_accounting(events: DataFrame, key: str) -> DataFrame:
    """Admitted, processed and dropped work per key, and whether the counters agree.

    Expects `admitted`, `processed`, `dropped` and per-reason columns `dropped_<reason>`.
    """
    reasons = [c for c in events.columns if c.startswith("dropped_")]
    sums = events.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("admitted", "processed", "dropped", *reasons)])
    by_reason = sum((F.col(c) for c in reasons), F.lit(0))
    return sums.withColumn("balanced", F.col("admitted") == F.col("processed") + F.col("dropped")).withColumn(
        "reasons_agree", by_reason == F.col("dropped")
    )


def close_stale_sessions(trace: Trace, recovered_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, snapshots and new events after recovery; running it again changes nothing.

    Active and closing sessions become stale; snapshots that never finished become partial and get
    one recovery event each.
    """
    at = F.lit(recovered_at).cast("timestamp")
    open_session = F.col("state").isin("active", "closing")
    sessions = trace.sessions.withColumn(
        "ended_at", F.when(open_session, F.coalesce("ended_at", at)).otherwise(F.col("ended_at"))
    ).withColumn("state", F.when(open_session, "stale").otherwise(F.col("state")))
    unfinished = F.col("completed_at_us").isNull() & F.col("recovered_at_us").isNull()
    snapshots = trace.snapshots.withColumn("__open", unfinished)
    events = snapshots.where("__open").select(
        "session_id", F.lit("context.analysis.partial").alias("event_type"), at.alias("timestamp"),
        F.to_json(F.struct(F.lit("startup_recovery").alias("reason"), F.col("snapshot_id").cast("string").alias("snapshot_id"))).alias("payload"),
    )
    snapshots = (
        snapshots.withColumn("status", F.when(F.col("__open"), "partial").otherwise(F.col("status")))
        .withColumn("recovered_at_us", F.when(F.col("__open"), F.unix_micros(at)).otherwise(F.col("recovered_at_us")))
        .drop("__open")
    )
    return sessions, snapshots, events


def stale_after(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions as runs of events without a longer gap. On a stream each is written once, when the watermark has passed its
    end; those still open at the end of what is available stay in the state."""
    source = events.withWatermark("timestamp", gap) if events.isStreaming else events
    return source.groupBy(F.session_window("timestamp", gap), "session_id").agg(F.count(F.lit(1)).alias("events")).select(
        "session_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("stale_at"), "events"
    )


#: Groups that the ids of `seen_before` are dealt over by their hash; a micro-batch costs a call a group, not a call an id.
SEEN_GROUPS = 256
_NEVER = -(1 << 63)


def seen_before(ids: DataFrame, expiry: str, key: str = "id") -> DataFrame:
    """Whether an id was seen in the time `expiry` before, for every row of a stream of (`key`, timestamp).

    State holds one time an id, the last one seen, in one row for all ids of a hash group. A time goes when the watermark has
    passed it by the expiry; an id that comes back later is new again. Rows of an id are taken in the order of their
    times within a micro-batch; the stream brings batches in that order, apart from lateness below the watermark.
    Returns (`key`, timestamp, seen).
    """
    span = pd.Timedelta(expiry).value // 1000

    def step(group, batches: Iterator[pd.DataFrame], state):
        names, last = pickle.loads(state.get[0]) if state.exists else ([], np.zeros(0, np.int64))
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            came, at = rows["name"].to_numpy(object), rows["at"].to_numpy(np.int64)
            codes, firsts = pd.factorize(np.append(np.array(names, object), came), use_na_sentinel=False)
            late = np.full(len(firsts), _NEVER)  # the last time of every id, kept or come
            late[codes[: len(names)]] = last
            codes = codes[len(names) :]
            order = np.lexsort((at, at == _NEVER, codes))  # unknown times last
            codes, at = codes[order], at[order]
            begins = np.append(True, codes[1:] != codes[:-1])
            before = np.where(begins, late[codes], np.append(_NEVER, at[:-1]))
            known = (before != _NEVER) & (at != _NEVER)
            seen = known & (np.where(known, at, 0) - np.where(known, before, 0) <= span)
            np.maximum.at(late, codes, at)
            names, last = [x if isinstance(x, str) else None for x in firsts], late
            yield pd.DataFrame({"name": [names[c] for c in codes], "at": at, "seen": seen})
        ends = (last + span) // 1000 + 1
        kept = (last != _NEVER) & (ends > state.getCurrentWatermarkMs())
        if not kept.any():
            if state.exists:
                state.remove()
            return
        state.update((pickle.dumps(([x for x, k in zip(names, kept) if k], last[kept])),))
        state.setTimeoutTimestamp(int(ends[kept].min()))

    kind = ids.schema[key].dataType
    source = ids.select(
        F.col(key).cast("string").alias("name"), "timestamp", F.coalesce(F.unix_micros("timestamp"), F.lit(_NEVER)).alias("at"),
        F.pmod(F.xxhash64(key), F.lit(SEEN_GROUPS)).alias("group"),
    ).withWatermark("timestamp", "0 seconds")
    out = source.groupBy("group").applyInPandasWithState(step, "name string, at bigint, seen boolean", "kept binary", "append", "EventTimeTimeout")
    return out.select(F.col("name").cast(kind).alias(key), F.timestamp_micros(F.when(F.col("at") != _NEVER, F.col("at"))).alias("timestamp"), "seen")


# --- live deltas -------------------------------------------------------------------------------------------


def live_deltas(snapshots: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Delta of each arriving snapshot against the session's previous one, by the batch operator.

    Expects a stream of (session_id, snapshot_id, position, blocks) with blocks an array of (exact, semantic,
    tokens). A micro-batch reads the last snapshot of each session from the table its predecessor
    left, and writes its deltas and the new last snapshots to folders named by its number: a batch that
    is run again writes the same again. Returns all deltas.
    """
    last = "session_id bigint, snapshot_id bigint, position bigint, blocks array<struct<exact: string, semantic: string, tokens: bigint>>"

    def step(arrived: DataFrame, number: int) -> None:
        own = arrived.sparkSession
        before = own.read.schema(last).parquet(f"{folder}/last/{number - 1}") if number else own.createDataFrame([], last)
        rows = before.unionByName(arrived.select("session_id", "snapshot_id", "position", "blocks"))
        in_order = Window.partitionBy("session_id").orderBy("position")  # what one batch brings of a session
        pairs = rows.select(
            "session_id", F.col("snapshot_id").alias("current_snapshot_id"), F.lag("snapshot_id").over(in_order).alias("previous_snapshot_id"),
            F.lit("complete").alias("current_status"), F.lit("complete").alias("previous_status"),
        ).where("previous_snapshot_id is not null")
        blocks = rows.select("snapshot_id", F.posexplode("blocks").alias("ordinal", "b")).select(
            "snapshot_id", (F.col("ordinal") + 1).alias("position"), F.col("b.exact").alias("exact_fp"), F.col("b.semantic").alias("semantic_fp"), F.col("b.tokens").alias("estimated_tokens")
        )
        found = context_deltas(pairs, blocks).join(pairs.select("session_id", "current_snapshot_id"), "current_snapshot_id")
        found.select(*LIVE).write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")
        newest = rows.groupBy("session_id").agg(F.max_by(F.struct("snapshot_id", "position", "blocks"), "position").alias("s")).select("session_id", "s.*")
        newest.write.mode("overwrite").parquet(f"{folder}/last/{number}")

    query = snapshots.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/deltas").select(*LIVE)


LIVE = (
    "session_id", "current_snapshot_id", "previous_snapshot_id", "repeated_blocks", "changed_blocks", "new_blocks", "removed_blocks",
    "repeated_tokens", "new_tokens", "common_prefix_blocks",
)


def recovery_counts(trace: Trace, recovered_at) -> DataFrame:
    """What a recovery run would change."""
    sessions, snapshots, events = close_stale_sessions(trace, recovered_at)
    before = trace.sessions.agg(count_where(F.col("state").isin("active", "closing")).alias("recovered_sessions"))
    return (
        before.crossJoin(sessions.agg(count_where(F.col("state") == "stale").alias("stale_sessions")))
        .crossJoin(events.agg(F.count(F.lit(1)).alias("recovered_snapshots")))
        .crossJoin(snapshots.agg(count_where(F.col("status") == "partial").alias("partial_snapshots")))
    )
