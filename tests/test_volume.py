"""Shuffles: what is dealt, how often and how wide."""

import re

import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F
from __spark_entry__ import queries
from trace_maker import generate_trace

from sessionlens.functions.ranking import distribution, numbered
from sessionlens.functions.jsontext import are_plain, parse_search
from sessionlens.operators import blocktext, lineage, missing, repetition
from sessionlens.plans import baseline
from sessionlens.sources.trace import Trace


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_are_dealt_once(spark):
    """Folds by snapshot and by group follow one deal by session and fingerprint."""
    found = plan(repetition.repetition_by_group(generate_trace(spark), ["origin", "kind"]))
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found)
    assert any("__key" in d for d in dealt)
    assert all(re.sub(r"#\d+L?", "", d) == "session_id, __key, 4" for d in dealt if "__key" in d or "fp#" in d)


def test_packed_fingerprints_stay_different(spark):
    texts = ["ab", "AB", "abc", "", "\x00ab", "6162", "ab" * 32, "é"]
    rows = spark.createDataFrame([(f, t) for f in ("exact", "semantic") for t in texts], "field string, fp string")
    packed = {bytes(r.k) for r in rows.select(repetition._packed(F.col("field"), F.col("fp")).alias("k")).collect()}
    assert len(packed) == 2 * len(texts) and max(map(len, packed)) == 34


def test_sections_read_stored_facts(spark):
    """Repetition, persistence, presence and ranking of the report come from two small stored tables."""
    trace = generate_trace(spark)
    facts, present = baseline._stored(repetition.repetition_facts(trace), "facts"), baseline._stored(repetition.presence_facts(trace), "present")
    for stored, lazy in (
        (repetition.session_repetition(trace, facts, present), repetition.session_repetition(trace)),
        (repetition.persistence_distribution(trace, facts), repetition.persistence_distribution(trace)),
        (repetition.effective_presence(trace, facts, present), repetition.effective_presence(trace)),
        (repetition.opportunity_ranking(trace, facts=facts, present=present), repetition.opportunity_ranking(trace)),
    ):
        assert "semantic_fp" not in plan(stored)
        assert sorted(map(str, stored.collect())) == sorted(map(str, lazy.collect()))


def test_weighted_distribution(spark):
    folded = spark.createDataFrame([("a", 3, 5), ("a", 9, 2), ("b", 1, 1), ("b", 4, 3)], "k string, v bigint, n bigint")
    long = folded.select("k", "v", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    assert sorted(distribution(folded, ["k"], "v", weight="n").collect()) == sorted(distribution(long, ["k"], "v").collect())


def test_numbering_is_dealt_to_tasks_by_size(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    out = numbered(rows, ["k"], [F.col("id")], "n", F.floor(F.col("id") / 10), most=1000, tasks=9)
    assert re.search(r"hashpartitioning\(k#\d+L, 9\)", plan(out))
    assert sorted(out.collect()) == sorted(numbered(rows, ["k"], [F.col("id")], "n", F.floor(F.col("id") / 10)).collect())


def test_occurrences_without_buckets(spark):
    """Only places are dealt, and small fingerprint groups once."""
    trace = generate_trace(spark)
    out = repetition.occurrence_index(trace)
    assert out.columns == ["block_id", "occurrence"]
    assert "raw_bytes" not in plan(out)
    ranked = {r.block_id: r.occurrence for r in out.collect()}
    assert ranked["block-0-0-0"] == 1 and ranked["block-0-3-0"] == 4


def test_plain_search_output_needs_no_parser(spark):
    """Texts of plain matches take one pattern, with the parser's results; all others go to the parser."""
    plain = ["src/a.rs:10:x\nsrc/a.rs:9:y:z\nB.rs:+3: at :9: \u00e9\n", "true:1:t\nnull:2:n", "a b:1:x\x85y", "a:1:x"]
    other = ["", "\n[search results]\n", "a:1:", "a b:1:", "a:1:x\r\n", "src/lib.rs:\n10\tneedle", "a:1:x\nloose", "a:1:x\n\nb:2:y", '{"type":"begin"}\na:1:x',
             " a:1:x", "a:x:1", "1:2:3", ":1:x", "\u00e9:1:x", "true", '{"type":"match"}', None]
    assert are_plain(pa.array(plain + other)).tolist() == [True] * len(plain) + [False] * len(other)
    rows = spark.createDataFrame(list(enumerate(plain + other)), "id int, text string")
    found = {}
    for r in blocktext.search_rows(rows, "id").orderBy("id", "position").collect():
        found.setdefault(r.id, []).append((r.file, r.line, r.text))
    parsed = {i: parse_search(t) for i, t in enumerate(plain + other) if t is not None}
    assert found == {i: p[0] for i, p in parsed.items() if p}
    left = sorted((r.id, r.line) for r in blocktext.search_leftovers(rows, "id").collect())
    assert left == sorted((i, line) for i, p in parsed.items() if p for line in p[1])


def test_lineages_are_dealt_once(spark):
    """Both folds of lineages follow one deal by session, call and fingerprint."""
    kinds = "session_id bigint, tool_call_id string, exact_fp string, request_ordinal bigint, ordinal int, block_id string, tokens bigint, raw_bytes bigint, detected_kind string, tool_name string, workload string, semantic_fp string, kind string"
    rows = spark.createDataFrame([(1, "c", "f", r, o, f"{r}-{o}", 5, 9, None, None, "w", "s", "tool_result") for r, o in ((1, 0), (1, 1), (3, 0))], kinds)
    out = lineage.lineages(rows)
    assert len(re.findall("hashpartitioning", plan(out))) == 1
    (row,) = out.collect()
    assert (row.first_seen, row.last_seen, row.occurrences, row.exact_reappearances, row.lineage_tokens) == (1, 3, 3, 1, 5)


def _requests(spark):
    rows = [(10 * s + i, 10 * s + i, "/v1/responses", "POST", 500 + i, "turn" if i % 3 else None, None) for s in range(3) for i in range(7)]
    operations = [(10 * s + i, s if s else None) for s in range(3) for i in range(7)] + [(11, 2)]
    empty = lambda kinds: spark.createDataFrame([], kinds)
    return Trace({
        "requests": spark.createDataFrame([*rows, rows[8]], "request_id long, operation_id long, route string, method string, request_bytes long, request_kind string, observation_status string"),
        "operations": spark.createDataFrame(operations, "operation_id long, session_id long"),
        "workloads": spark.createDataFrame([(1, "w", "serial"), (2, "a", "serial"), (2, "b", "serial")], "session_id long, workload string, concurrency_mode string"),
        "snapshots": spark.createDataFrame([(1, 11, "complete", "correlated", 5, None)], "snapshot_id long, provider_request_id long, status string, correlation_status string, completed_at_us long, recovered_at_us long"),
        "events": empty("seq long, session_id long, event_type string, payload string"),
        "blocks": spark.createDataFrame([(1, 7), (1, 8)], "snapshot_id long, estimated_tokens long"),
    })


def test_turns_need_requests_only(spark, monkeypatch):
    """Turns are those of the strata, with repeated requests, sessions and labels, and in large sessions; the query reads no line items."""
    trace = _requests(spark)
    expected = sorted(map(str, missing.strata(trace).select("request_id", "turn_index", "session_request_count").collect()))
    assert len(expected) > 21
    for stored, most in ((False, 1 << 18), (True, 1 << 18), (True, 3)):
        monkeypatch.setattr(missing, "LARGE_SESSION", most)
        assert sorted(map(str, missing.turn_index(trace, stored).collect())) == expected
    query = plan(queries()["W06_turn_index"](spark, DATA))
    assert not re.search("l_orderkey|estimated_tokens|/lines-|snapshot_id", query)


def test_strata_are_derived_once(spark):
    """The quartiles, turns and counts of the strata read one stored table."""
    query = plan(queries()["D26_missingness"](spark, DATA))
    assert not re.search("l_orderkey|o_orderkey|/lines-", query)
