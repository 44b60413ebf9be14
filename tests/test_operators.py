"""Operators against literal fixtures and brute force."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.functions.jsontext import NAME, block_fold, block_runs
from sessionlens.operators import blocktext, composition, delta, ingest, lineage, quality, reduce, sessions
from sessionlens.plans import experiments
from sessionlens.sources.trace import Trace, UnknownSessions, cohort
from sessionlens.streaming.eventlog import close_stale_sessions

from trace_maker import generate_trace


@pytest.fixture(scope="module")
def synthetic(spark):
    return generate_trace(spark)


def test_synthetic_overview(synthetic):
    row = quality.overview(synthetic).collect()[0]
    assert row.session_count == 4 and row.request_count == 16 and row.input_tokens == 24400
    assert row.quality_status == "degraded" and row.input_tokens_source == "provider_reported"


def test_allow_lists(synthetic):
    with pytest.raises(ValueError):
        composition.composition(synthetic.blocks, "raw_bytes")
    with pytest.raises(ValueError):
        sessions.sort_column("state", "asc")
    with pytest.raises(ValueError):
        sessions.sort_column("created_at", "up")


def test_unknown_session_is_an_error(spark, synthetic):
    with pytest.raises(UnknownSessions):
        cohort(synthetic.replace(events=spark.createDataFrame([], "session_id string")), spark.createDataFrame([("nobody",)], "session_id string"))


def test_paging_reports_the_next_offset(synthetic):
    first = sessions.sessions_page(synthetic, limit=3).collect()
    last = sessions.sessions_page(synthetic, limit=3, offset=3).collect()
    assert len(first) == 3 and {r.next_offset for r in first} == {3}
    assert len(last) == 1 and last[0].next_offset is None


DELTA = "snapshot_id bigint, ordinal bigint, exact_fp string, semantic_fp string, estimated_tokens bigint"


def run_delta(spark, before, after, status="complete"):
    blocks = [(1, i, *b) for i, b in enumerate(before)] + [(2, i, *b) for i, b in enumerate(after)]
    pairs = spark.createDataFrame([(2, 1, status, "complete")], "current_snapshot_id bigint, previous_snapshot_id bigint, current_status string, previous_status string")
    return delta.context_deltas(pairs, spark.createDataFrame(blocks, DELTA)).collect()[0]


def test_delta_fixture(spark):
    before = [("A", "s1", 5), ("B", "s2", 3), ("B", "s2", 3), ("C", "s3", 2)]
    after = [("A", "s1", 5), ("B", "s2", 3), ("D", "s3", 4), ("E", None, None)]
    row = run_delta(spark, before, after)
    assert (row.repeated_blocks, row.repeated_tokens) == (2, 8)
    assert (row.changed_blocks, row.new_blocks, row.removed_blocks) == (1, 1, 1)
    assert row.new_tokens is None and (row.common_prefix_blocks, row.common_prefix_tokens) == (2, 8)
    assert run_delta(spark, before, after, "partial").status == "resource_limit"


def test_delta_of_very_long_snapshots(spark):
    before = [(f"A{i}", None, 1) for i in range(9000)]
    row = run_delta(spark, before, [*before, ("B", None, 1)])
    assert (row.status, row.repeated_blocks, row.new_blocks, row.common_prefix_blocks) == ("complete", 9000, 1, 9000)


def delta_by_fingerprint(before, after):
    """The delta rules said per fingerprint: which blocks pair off exactly, then by meaning."""
    repeated, fresh, left = [], [], []
    for exact in {b[0] for b in [*before, *after]}:
        old, now = [b for b in before if b[0] == exact], [b for b in after if b[0] == exact]
        pairs = min(len(old), len(now))
        repeated += now[:pairs]
        fresh += now[pairs:]
        wanted = Counter(b[1] for b in now[:pairs])
        of_meaning = {m: [i for i, b in enumerate(old) if b[1] == m][:n] for m, n in wanted.items()}
        used = [i for places in of_meaning.values() for i in places]
        used += [i for i in range(len(old)) if i not in used][: pairs - len(used)]
        left += [b for i, b in enumerate(old) if i not in used]
    meanings = lambda blocks: Counter(b[1] for b in blocks if b[1] is not None)
    quota, new = meanings(fresh) & meanings(left), []
    changed = sum(quota.values())
    for b in (b for b in after if any(b is f for f in fresh)):
        if quota[b[1]] > 0:
            quota[b[1]] -= 1
        else:
            new.append(b)
    tokens = lambda blocks: None if any(b[2] is None for b in blocks) else sum(b[2] for b in blocks)
    same = [a[0] == b[0] for a, b in zip(before, after)]
    return {
        "repeated_blocks": len(repeated), "changed_blocks": changed, "new_blocks": len(new), "removed_blocks": len(left) - changed,
        "repeated_tokens": tokens(repeated), "new_tokens": tokens(new), "common_prefix_blocks": same.index(False) if False in same else len(same),
    }


def test_delta_against_brute_force(spark):
    rng = random.Random(5)
    blocks, pairs, want = [], [], {}
    for case in range(40):
        sides = []
        for side in (0, 1):
            sides.append([tuple([rng.choice("ABCD"), rng.choice(["s", "t", None]), rng.choice([1, 2, None])]) for _ in range(rng.randrange(7))])
            blocks += [(case * 2 + side, i, *b) for i, b in enumerate(sides[-1])]
        pairs.append((case * 2 + 1, case * 2, "complete", "complete"))
        want[case * 2 + 1] = delta_by_fingerprint(*sides)
    frame = spark.createDataFrame(pairs, "current_snapshot_id bigint, previous_snapshot_id bigint, current_status string, previous_status string")
    for row in delta.context_deltas(frame, spark.createDataFrame(blocks, DELTA)).collect():
        expected = want[row.current_snapshot_id]
        assert {k: row[k] for k in expected} == expected


def lineage_rows(spark):
    columns = ("block_id string, session_id string, request_ordinal bigint, ordinal bigint, kind string, raw_bytes bigint, tokens bigint, exact_fp string,"
               " semantic_fp string, tool_call_id string, raw_value_start bigint, snapshot_id string, detected_kind string, tool_name string, workload string, request_kind string")
    data = [
        ("a1", "a", 1, 1, "tool_result", 4000, 1000, "01", "11", "call-a", 3600), ("a2", "a", 2, 1, "tool_result", 4000, 1000, "01", "11", "call-a", 3600),
        ("a3", "a", 3, 1, "tool_result", 4000, 1000, "01", "11", "call-a", 3600), ("same", "a", 2, 2, "tool_result", 4000, 1000, "01", "11", "call-b", 3600),
        ("other", "b", 1, 1, "tool_result", 4000, 1000, "01", "11", "call-a", 3600), ("missing", "a", 2, 3, "tool_result", 800, 200, "02", "12", None, 100),
        ("c1", "a", 1, 0, "text", 400, 100, "03", "13", None, 0), ("c2", "a", 2, 0, "text", 400, 100, "04", "14", None, 0), ("c3", "a", 3, 0, "text", 400, 100, "05", "15", None, 0),
    ]
    return spark.createDataFrame([d + (f"{d[1]}r{d[2]}", "json", None, "w", "compaction_v2" if d[2] == 3 else "turn") for d in data], columns)


def test_lineage_fixture(spark):
    rows = lineage_rows(spark)
    found = lineage.lineages(rows)
    assert found.count() == 3
    assert [tuple(r) for r in lineage.exclusions(rows).collect()] == [("missing_tool_call_id", 1)]
    gate = lineage.eviction_gate(rows, found).collect()[0]
    assert gate.historical_exposure == 2000 and gate.compaction_snapshots == 1 and gate.lineages_with_follow_up == 2
    e2 = [r for r in lineage.eviction_policies(rows, found).collect() if r.policy == "E2"][0]
    assert e2.selected == 1 and e2.net == e2.gross - e2.stub_overhead - e2.schema_overhead
    again = {r.tool_call_id: r.semantic_reappearances for r in lineage.semantic_reappearances(rows, found).where("session_id = 'a'").collect()}
    assert again == {"call-a": 1, "call-b": 1}


@pytest.mark.parametrize(
    "usage,want",
    [
        ('{"input_tokens":10,"input_tokens_details":{"cached_tokens":3},"output_tokens":8,"output_tokens_details":{"reasoning_tokens":5},"total_tokens":18}', (7, "final", False)),
        ('{"input_tokens":10,"input_tokens_details":{"cached_tokens":12}}', (None, "partial", True)),
        ('{"input_tokens":10,"output_tokens":4,"total_tokens":15}', (None, "partial", False)),
        ("{}", (None, "unavailable", False)),
        ("oops", (None, "unavailable", False)),
    ],
)
def test_usage_normalisation(spark, usage, want):
    row = ingest.normalize_usage(spark.createDataFrame([(usage,)], "usage string")).collect()[0]
    assert (row.input_uncached, row.usage_status, row.cached_exceeds_input) == want


def test_detector_table(spark):
    cases = {
        '{"a": [1, 2]}': ("json", "high"), '{"a":1}\n{"a":2}\n{"a":3}\n': ("ndjson", "high"), '{"a":1} x': ("unknown", "low"),
        "src/lib.rs:10:needle\nsrc/lib.rs:11:other\nsrc/main.rs:4:needle": ("search_results", "high"),
        "2024-01-01T00:00:00 a\n2024-01-01T00:00:01 b\n2024-01-01 00:00:02 c\n": ("log", "high"),
        "diff --git a b\n--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y\n": ("diff", "high"), "test a ... ok\ntest result: ok. 1 passed; 0 failed\n": ("test_results", "high"),
        "use a;\nfn f() {\n}\n": ("source_code", "high"), "just some plain words here": ("plain_text", "medium"), "a\x00b": ("binary_like", "high"), "": ("unknown", "low"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r.text: (r.detected_kind, r.confidence) for r in blocktext.detect(rows).collect()}
    assert got == cases


def test_features_fixture(spark):
    row = blocktext.features(blocktext.detect(spark.createDataFrame([("a\nb\na\n",)], "text string"))).collect()[0]
    assert (row.line_count, row.duplicate_line_ppm, row.unique_line_ppm) == (3, 333333, 666666)


def test_search_forms(spark):
    plain = "src/lib.rs:10:needle\nsrc/lib.rs:11:other\nsrc/main.rs:4:needle"
    grouped = "src/lib.rs:\n10\tneedle\n11\tother\nsrc/main.rs:\n4\tneedle\n"
    lines = "\n".join(json.dumps({"type": "match", "data": {"path": {"text": f}, "line_number": n, "lines": {"text": t + "\n"}}})
                      for f, n, t in [("src/lib.rs", 10, "needle"), ("src/lib.rs", 11, "other"), ("src/main.rs", 4, "needle")])
    rows = spark.createDataFrame([(1, plain), (2, grouped), (3, lines)], "id int, text string")
    found = {}
    for r in blocktext.search_rows(rows, "id").collect():
        found.setdefault(r.id, []).append((r.file, r.line, r.text))
    want = [("src/lib.rs", 10, "needle"), ("src/lib.rs", 11, "other"), ("src/main.rs", 4, "needle")]
    assert {k: sorted(v) for k, v in found.items()} == {1: want, 2: want, 3: want}


def test_search_inside_one_json_string(spark):
    body = json.dumps({"exit": 0, "out": "\n".join(f"src/file.rs:{i}:let value = {i}" for i in range(30))})
    rows = spark.createDataFrame([(body,)], "text string").withColumn("detected_kind", F.lit("json"))
    got = reduce.propose(rows, ["search.result_projection"]).collect()[0].candidate
    assert json.loads(got)["out"].startswith("[search results]\nsrc/file.rs:\n0\t") and got.startswith('{"exit": 0')


def unfold(folded):
    out = []
    for line in folded.split("\n")[1:-1]:
        head, _, rest = line.partition("lines=")
        out += json.loads(rest) * (int(head.strip().removeprefix("repeat=")) if head else 1)
    return "".join(out)


def test_block_fold_round_trip():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice(["a\n", "b\n", "c\r\n"]) for _ in range(rng.randrange(20))) + rng.choice(["", "end"])
        folded = block_fold(text)
        if folded is not None:
            assert folded.startswith(NAME) and unfold(folded) == text
    assert [n for n, _ in block_runs(["a\n", "b\n"] * 4)] == [4]


def test_gate_is_never_worse(spark):
    rows = spark.createDataFrame([("same\n" * 50,), ("one\ntwo\n",)], "text string").withColumn("detected_kind", F.lit("plain_text"))
    got = [r.status for r in reduce.evaluate(reduce.propose(rows, ["text.readable_line_fold", "text.noop"])).collect()]
    assert sorted(got) == ["applicable", "no_improvement", "no_improvement", "not_applicable"]


def test_bootstrap_interval_is_close_to_resampling(spark):
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1000, 51), rng.integers(200, 1200, 40)
    rows = spark.createDataFrame([("a", int(v)) for v in a] + [("b", int(v)) for v in b], "side string, v bigint").withColumn("m", F.lit("m"))
    got = experiments.bootstrap_median_delta(rows, ["m"], "side", "v", "a", "b", 2000).collect()[0]
    draws = np.sort([np.median(rng.choice(b, b.size)) - np.median(rng.choice(a, a.size)) for _ in range(4000)])
    assert abs(got.lower_95 - draws[99]) < 90 and abs(got.upper_95 - draws[3900]) < 90


def test_recovery_is_idempotent(spark):
    trace = Trace({
        "sessions": spark.createDataFrame([("a", "active", None), ("b", "closed", None)], "session_id string, state string, ended_at timestamp"),
        "snapshots": spark.createDataFrame([("x", "a", "complete", None, None), ("y", "b", "complete", 1, None)],
                                           "snapshot_id string, session_id string, status string, completed_at_us bigint, recovered_at_us bigint"),
    })
    sessions_1, snapshots_1, events_1 = close_stale_sessions(trace, "2025-01-01 00:00:00")
    assert events_1.count() == 1
    again = close_stale_sessions(Trace({"sessions": sessions_1, "snapshots": snapshots_1}), "2026-01-01 00:00:00")
    assert again[2].count() == 0 and sorted(again[0].collect()) == sorted(sessions_1.collect())


def test_results_do_not_depend_on_partitioning(synthetic):
    scattered = synthetic.replace(blocks=synthetic.blocks.repartition(13), requests=synthetic.requests.repartition(5))
    for group in ("kind", "detected_kind"):
        key = lambda r: r.name
        assert sorted(composition.composition(scattered.blocks, group).collect(), key=key) == sorted(composition.composition(synthetic.blocks, group).collect(), key=key)
    assert sorted(sessions.session_rollup(scattered).collect()) == sorted(sessions.session_rollup(synthetic).collect())


def test_folds_give_their_texts_back(spark):
    """The inverse of both folds on awkward lines; where white space is ambiguous the gate says so."""
    from sessionlens.operators import reduce as red

    texts = ["a\na\na\nb\n", "no fold", "x x\n" * 5 + "end", 'q "quoted" \\ back\n' * 3, "t1 INFO one\nt2 INFO two\nt3 INFO three\n", "é ü\té\né ü\té\n", "\n\n\n",
             "t1  $1\\ one\nt2  $1\\ two\n", "t1 INFO  two gaps\nt2 INFO  two gaps again\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("detected_kind", F.lit("plain_text"))
    for name, lossy in (("text.readable_line_fold", set()), ("text.log_prefix_fold", {8}), ("text.noop", set())):
        got = {r.id: r.failure for r in red.gated(rows, name).select("id", "failure").collect()}
        assert {i for i, f in got.items() if f == "recovery_failed"} == lossy and "internal_error" not in got.values(), (name, got)
        assert any(f is None for f in got.values())
    json = spark.createDataFrame([(1, '{"a" : 1,\n "b": [1, "x y"]}')], "id int, text string").withColumn("detected_kind", F.lit("json"))
    assert [r.failure for r in red.gated(json, "json.minify").select("failure").collect()] == [None]


def test_deltas_do_not_depend_on_the_size_of_a_pair(spark, monkeypatch):
    """Small pairs are compared where they are, large ones by fingerprint; both ways give the same rows."""
    rng = random.Random(5)
    fp = lambda n: rng.choice([None, *(f"f{i}" for i in range(n))])
    blocks = spark.createDataFrame(
        [(s, o, fp(5), fp(3), rng.choice([None, 3, 7, 9])) for s in range(12) for o in range(rng.randrange(14))],
        "snapshot_id bigint, ordinal bigint, exact_fp string, semantic_fp string, estimated_tokens bigint",
    )
    prefixed = blocks.where("snapshot_id = 3").withColumn("snapshot_id", F.lit(20).cast("bigint"))
    pairs = spark.createDataFrame([(i, i - 1, "complete" if i % 4 else "partial", "complete") for i in range(1, 13)] + [(20, 3, "complete", "complete")], "current_snapshot_id bigint, previous_snapshot_id bigint, current_status string, previous_status string")
    found = []
    for large in (0, 9, 1000):
        monkeypatch.setattr(delta, "LARGE", large)
        found.append(sorted(delta.context_deltas(pairs, blocks.unionByName(prefixed)).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 13


def test_signals_are_counted_where_a_rule_asks(spark):
    """Counters of a document are not counted for its kind, and `sig` still holds them; guards find what patterns find."""
    texts = ['{"error": 1}', "ok \nERROR: it Panicked\n", "--- FAIL: x\n[ RUN      ] y\n", "a WARNING\n12:00:00 go\n", "The quick brown fox jumps\n", None, ""]
    rows = blocktext.detect(spark.createDataFrame([(t,) for t in texts], "text string"))
    plan = rows.select("detected_kind")._jdf.queryExecution().optimizedPlan().toString()
    assert "traceback" not in plan  # words of errors are in no rule
    want = blocktext.with_signals(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r.text: r.sig for r in rows.collect()} == {r.text: r.sig for r in want.collect()}
    assert {r.text: r.sig.error_lines for r in rows.collect()} == {texts[0]: 1, texts[1]: 1, texts[2]: 0, texts[3]: 0, texts[4]: 0, None: None, "": 0}
