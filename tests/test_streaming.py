"""Streams: any cut of a stream and any batch split give the batch result."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionlens.session import new_folder
from sessionlens.streaming import eventlog, sse

BODIES = {
    1: 'event: response.created\ndata: {"response":{"id":"r1","model":"m"}}\n\nevent: response.completed\ndata: {"response":{"usage":{"input_tokens":10}}}\n\nevent: late\ndata: {"usage":{"input_tokens":9}}\n\n',
    2: ': ping\r\n\r\nevent: response.created\r\ndata: {"response":\r\ndata: {"id":"r2"}}\r\n\r\nevent: response.output_text.delta\r\ndata: {oops\r\n\r\n',
    3: 'event: response.failed\rdata: {"response":{"error":{"code":"overloaded"}}}\r\rdata: x\r\r',
    4: 'event: response.in_progress\ndata: {bad\n\nevent: response.completed\ndata: {"response":{}}',
}


def chunks(width):
    rows = []
    for attempt, body in BODIES.items():
        parts = [body[i:i + width] for i in range(0, len(body), width)]
        rows += [(attempt, i, part, "disconnect" if i == len(parts) - 1 else None) for i, part in enumerate(parts)]
    return rows


SCHEMA = "attempt_id bigint, seq bigint, chunk string, closing string"


def batch_fold(spark, width):
    frame = spark.createDataFrame(chunks(width), SCHEMA)
    closings = frame.where("closing is not null").select("attempt_id", "closing")
    return {r.attempt_id: r.asDict() for r in sse.fold_events(sse.frame_events(frame), closings).collect()}


@pytest.fixture(scope="module")
def expected(spark):
    return batch_fold(spark, 10_000)


def test_fold_values(expected):
    assert expected[1]["state"] == "completed" and expected[1]["late_events"] == 1 and expected[1]["usage"] == '{"input_tokens":10}'
    assert expected[2]["state"] == "disconnected" and expected[2]["response_id"] == "r2"
    assert expected[3]["error_code"] == "overloaded" and expected[3]["late_events"] == 1
    assert expected[4]["terminal"] and expected[4]["status"] == "partial"


@pytest.mark.parametrize("width", [1, 2, 3, 7, 31])
def test_batch_fold_is_invariant_to_cuts(spark, expected, width):
    assert batch_fold(spark, width) == expected


def test_framing_of_random_streams(spark):
    """Names and data of events against the sequential form, for streams of every mix of line ends cut anywhere."""
    rng, rows, expected = random.Random(5), [], {}
    words = ["data: a", "data:b", "data", "event: e", "event:f", ": note", "id: 4", "data:  two", "", "", ""]
    for attempt in range(300):
        ends = rng.choice([["\n"], ["\r\n"], ["\r"], ["\n", "\r", "\r\n"]])
        body = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40))) + rng.choice(["", "data: last"])
        expected[attempt] = sse.cut_events(body, final=True)[0]
        seq = rng.choice([0, 1000, 1020])  # some attempts cross from one piece to the next
        while body:
            n = rng.choice([0, 1, 1, 2, 5, 30])
            rows.append((attempt, seq, body[:n] or rng.choice(["", None]), None))
            body, seq = body[n:], seq + 1
    got = {a: [] for a in expected}
    for r in sse.frame_events(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("attempt_id", "event_no").collect():
        assert r.event_no == len(got[r.attempt_id])
        got[r.attempt_id].append((r.event, r.data))
    assert got == expected


def test_long_attempt_is_spread(spark):
    """One attempt with most of the chunks: no task of the shuffles holds most of them."""
    rows = spark.range(40_000).select(
        F.lit(1).cast("bigint").alias("attempt_id"), F.col("id").alias("seq"),
        F.concat(F.lit("data: "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "\n").otherwise("\n\n")).alias("chunk"), F.lit(None).cast("string").alias("closing"),
    )
    events = sse.frame_events(rows)
    assert events.count() == sum(1 for i in range(40_000) if i % 3 or i == 39_999)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = events.groupBy(F.spark_partition_id().alias('p')).count().agg(F.max('count').alias('most'), F.count('*').alias('tasks')).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread.tasks > 1 and spread.most < 20_000


@pytest.mark.parametrize("width", list(range(1, 40)))
def test_stateful_fold_matches(expected, width):
    for attempt, body in BODIES.items():
        rest, seen = "", sse.NOTHING
        for start in range(0, len(body), width):
            events, rest = sse.cut_events(rest + body[start:start + width])
            seen = sse.observe(seen, events)
        seen = sse.observe(seen, sse.cut_events(rest, final=True)[0])
        assert {"attempt_id": attempt, **sse.closed(seen, "disconnect")} == expected[attempt]


def test_stream_over_several_batches(spark, expected):
    folder = new_folder(spark, "t")
    rows = chunks(11)
    for i in range(0, len(rows), 9):
        spark.createDataFrame(rows[i:i + 9], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = eventlog.run_to_table(sse.observe_stream(stream), spark, f"{folder}/out", f"{folder}/state", "append")
    assert {r.attempt_id: r.asDict() for r in got.collect()} == expected


def test_live_deltas_match_pairs(spark):
    rng = random.Random(4)
    history = {s: [[(rng.choice("ABC"), rng.choice(["s", None]), rng.choice([1, None])) for _ in range(rng.randrange(5))] for _ in range(4)] for s in (1, 2)}
    schema = "session_id bigint, snapshot_id bigint, position bigint, blocks array<struct<exact: string, semantic: string, tokens: bigint>>"
    folder = new_folder(spark, "t")
    for turn in range(4):
        rows = [(s, s * 10 + turn, turn, h[turn]) for s, h in history.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = {r.current_snapshot_id: r for r in eventlog.live_deltas(stream, spark, folder).collect()}
    for s, h in history.items():
        for turn in range(1, 4):
            before, after, row = h[turn - 1], h[turn], got[s * 10 + turn]
            old, new = Counter(b[0] for b in before), Counter(b[0] for b in after)
            repeated = sum((old & new).values())
            same = [a[0] == b[0] for a, b in zip(before, after)]
            assert row.repeated_blocks == repeated and row.changed_blocks + row.new_blocks == len(after) - repeated
            assert row.removed_blocks == len(before) - repeated - row.changed_blocks
            assert row.common_prefix_blocks == (same.index(False) if False in same else len(same))
            assert row.previous_snapshot_id == s * 10 + turn - 1


def test_stale_gap(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 600), ("a", 9000)], "session_id string, s bigint").withColumn("timestamp", F.timestamp_seconds("s"))
    assert sorted(r.events for r in eventlog.stale_after(rows).collect()) == [1, 2]


def test_log_takes_an_event_once_however_late(spark):
    folder = new_folder(spark, "t")
    schema = "event_id bigint, timestamp timestamp"
    for rows in ([(1, 0), (1, 0), (2, 90000)], [(1, 200000), (3, 5)], [(2, 1), (4, 300000)]):
        spark.createDataFrame(rows, "event_id bigint, s bigint").select("event_id", F.timestamp_seconds("s").alias("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        eventlog.append_events(stream, f"{folder}/log", f"{folder}/state").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{folder}/log").collect()) == [1, 2, 3, 4]


def test_log_survives_a_new_checkpoint(spark):
    """Another query with a checkpoint of its own adds to a log, and repeats of logged events stay out."""
    folder = new_folder(spark, "log")
    rows = lambda ids: spark.createDataFrame([(i, "t") for i in ids], "event_id string, event_type string")
    rows("aab").write.parquet(f"{folder}/one")
    rows("cab").write.parquet(f"{folder}/two")
    for source, state in (("one", "s1"), ("two", "s2"), ("one", "s3"), ("two", "s2")):
        stream = spark.readStream.schema("event_id string, event_type string").parquet(f"{folder}/{source}")
        eventlog.append_events(stream, f"{folder}/log", f"{folder}/{state}", buckets=8).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{folder}/log").collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("width", [3, 31])
def test_fold_with_its_state_in_tables(spark, expected, width):
    """Attempts over several micro-batches, one that ends early and one that comes back, without a call an attempt."""
    folder = new_folder(spark, "observed")
    for part in range(3):
        rows = [(a, i, t, c) for a, i, t, c in chunks(width) if min(i // (width * 4), 2) == part]
        rows += [(9, part, None, "cancel" if part == 1 else None)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = {r.attempt_id: r.asDict() for r in sse.observe_to_table(stream, folder).collect()}
    assert found.pop(9)["state"] == "cancelled"
    assert found == expected
