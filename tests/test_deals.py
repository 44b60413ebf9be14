"""Repetition by group from one deal, and ids seen before by hash groups, against plain loops."""

import random
import re
from datetime import datetime, timedelta

from __spark_entry__ import queries

from sessionlens.operators import repetition
from sessionlens.sources.trace import Trace
from sessionlens.streaming import eventlog

DATA = "/root/testdata/sf0.001"


def _placed(spark, rng):
    fp = lambda n: rng.choice([None, "", *(f"{i:064x}" for i in range(n))])
    blocks = [(s, rng.randrange(4), f"b{i % 50}", rng.choice([None, 3, 7]), rng.choice([None, "", "o1", "o2"]), rng.choice(["k1", "k2"]), fp(4), fp(3)) for i, s in enumerate(rng.choice([0, 1, 2, 3, 4, 9]) for _ in range(120))]
    snapshots = [(s, rng.choice([None, 1, 2]) if s else 1, s, order) for order, s in enumerate([0, 1, 2, 3, 3, 4])]
    return blocks, snapshots, Trace({
        "blocks": spark.createDataFrame(blocks, "snapshot_id long, ordinal int, block_id string, estimated_tokens long, origin string, kind string, exact_fp string, semantic_fp string"),
        "snapshots": spark.createDataFrame(snapshots, "snapshot_id long, session_id long, provider_request_id long, snapshot_order long"),
    })


def _by_hand(blocks, snapshots):
    name = lambda v: v or "unknown"
    rows = [(session, order, b) for b in blocks for s, session, _, order in snapshots if s == b[0]]
    low = lambda v: (v is not None, v or 0)
    out = {}
    for g in {(name(b[4]), name(b[5])) for _, _, b in rows}:
        mine = [r for r in rows if (name(r[2][4]), name(r[2][5])) == g]
        found = [len(mine), sum(b[3] or 0 for _, _, b in mine)]
        spans = {}
        for column in (6, 7):
            firsts = {}
            for session, order, b in rows:
                if b[column] is not None:
                    place = (order, b[1], b[2], low(b[3]), name(b[4]), name(b[5]))
                    firsts[session, b[column]] = min(place, firsts.get((session, b[column]), place))
            keyed = [(s, o, b) for s, o, b in mine if b[column] is not None]
            new = [f for f in firsts.values() if f[4:] == g]
            found += [len(keyed) - len(new), sum(b[3] or 0 for _, _, b in keyed) - sum(f[3][1] for f in new)]
            for s, o, b in keyed:
                spans.setdefault((column, s, b[column]), set()).add(o)
        sizes = [len(v) for v in spans.values()]
        out[g] = (*found, sum(f[3][1] for f in new), sum(sizes) / len(sizes) if sizes else None, max(sizes, default=None))
    return out


def test_repetition_by_group_counts_every_block_once(spark):
    """Blocks without fingerprints, with one or both, of repeated snapshots and in sessions without an id."""
    for seed in range(3):
        blocks, snapshots, trace = _placed(spark, random.Random(seed))
        got = {(r.origin, r.kind): (r.block_count, r.estimated_tokens, r.exact_repeated_blocks, r.exact_repeated_tokens, r.semantic_repeated_blocks, r.semantic_repeated_tokens, r.unique_tokens, r.average_persistence, r.max_persistence) for r in repetition.repetition_by_group(trace, ["origin", "kind"]).collect()}
        assert got == _by_hand(blocks, snapshots)


def test_repetition_by_group_joins_and_deals_once(spark):
    found = queries()["D32_repetition_by_group"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert found.count("REPARTITION_BY_COL") == 1 and len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", found)) == 1


def test_seen_ids_take_a_call_a_group(spark, tmp_path, monkeypatch):
    """Times of ids over several micro-batches, with expiry, missing ids, numbers as ids and more ids than groups."""
    monkeypatch.setattr(eventlog, "SEEN_GROUPS", 3)
    rng, start = random.Random(8), datetime(2024, 1, 1)
    for kind, ids in (("string", ["a", "b", "", None, *(f"u{i}" for i in range(20))]), ("long", [1, 2**60 + 1, 2**60 + 2, None])):
        rows = sorted(((rng.choice(ids), start + timedelta(microseconds=rng.randrange(6 * 3_600_000_000))) for _ in range(150)), key=lambda r: r[1])
        folder = str(tmp_path / kind)
        for i in range(3):
            spark.createDataFrame(rows[50 * i : 50 * (i + 1)], f"id {kind}, timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(f"id {kind}, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        seen = eventlog.seen_before(stream, "30 minutes")
        assert "group" in seen._jdf.queryExecution().analyzed().toString()
        got = sorted(map(str, eventlog.run_to_table(seen, spark, f"{folder}/out", f"{folder}/state", "append").collect()))
        last, want = {}, []
        for name, at in rows:
            want.append((name, at, name in last and at - last[name] <= timedelta(minutes=30)))
            last[name] = at
        assert got == sorted(f"Row(id={n!r}, timestamp={t!r}, seen={s})" for n, t, s in want)
