"""Content kinds told from whole batches, against the counters of each text; what the queries over them read and derive."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from __spark_entry__ import queries

from sessionlens.functions import detection
from sessionlens.functions.jsontext import depth, document_facts, line_facts, strict
from sessionlens.operators import blocktext
from sessionlens.sources import bindings

LINES = (
    "src/a.rs:10:x", "a.rs:12\x85", "b.py:7", "- x", "--- a", "--- ", "+++ b", "+ y", "@@ -1 +1 @@", "diff --git a b", "2024-01-01T00:00:01 INFO x", "[12:00:00]",
    "ERROR: bad", "xWARN", "  note[1]", "test a ... ok", "test b ok  ", "--- PASS: t", "ok 1", "x PASSED", "\u2713 good", "test result: ok. 1 passed; 0 failed",
    "running 3 tests", "fn f() {", "}", "use a;", "import os", "// c", "def f():", "label:  ", "label:\x85", "a:\u2028", "just some plain words here", "été à la plage avec élan",
    "日本語 の テキスト です", "1", "01", "NaN", "true", '"s"', '{"a":1}', '{"a":[1,{"b":2}]}', "[1,2]", "[1,", "", " \t", "\x0b", "\r", "\x01\x02", "\x00", "\xa0{}", "key: value",
)


def expected(s, js):
    """The rules, asked one after the other of the counters of one text."""
    of = lambda part, percent, whole=None: (s.considered if whole is None else whole) > 0 and part * 100 >= (s.considered if whole is None else whole) * percent
    n, pair = s.considered, s.diff_old_files >= 1 and s.diff_new_files >= 1
    tests = n >= 2 and s.test_markers > 0 and of(s.test_markers, 30)
    marks = (s.code_declarations > 0) + (s.code_imports > 0) + (s.code_comments > 0)
    dense, lined = of(s.code_punctuation, 50), n >= 2 and (js.line_containers or 0) >= 2
    rules = (
        (s.bytes == 0, "unknown/low"), (s.nul, "binary_like/high"), (s.bytes and s.controls * 100 >= s.bytes * 5, "binary_like/medium"),
        (js.document and not js.too_deep, "json/high"), (js.too_deep, "unknown/low"), (lined and n >= 3 and js.line_values == n, "ndjson/high"), (lined and of(js.line_values, 80), "ndjson/medium"),
        (s.diff_hunks and (pair or s.diff_headers), "diff/high"), ((s.diff_hunks or pair) and s.diff_marks - s.diff_old_files - s.diff_new_files >= 2, "diff/medium"),
        (tests and s.test_summaries, "test_results/high"), (tests and s.test_markers >= 2, "test_results/medium"),
        (n >= 3 and of(s.path_lines, 80), "search_results/high"), (n >= 2 and of(s.path_lines, 50), "search_results/medium"),
        (n >= 3 and of(s.timestamps, 80), "log/high"), (n >= 2 and (of(s.timestamps, 50) or n >= 3 and of(s.levels, 50)), "log/medium"),
        (marks >= 2 and dense and n >= 3, "source_code/high"), ((marks >= 2 and n >= 2) or (marks and dense and n >= 3), "source_code/medium"),
        (n >= 1 and not dense and of(s.words, 300) and of(s.letters, 60, s.visible), "plain_text/medium"), (True, "unknown/low"),
    )
    return next(name for fires, name in rules if fires)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_kinds_follow_from_the_counters(spark, monkeypatch, piece):
    monkeypatch.setattr(detection, "PIECE", piece)
    rng = random.Random(3)
    pick = lambda: "\n".join(rng.choice(pool) for pool in [rng.sample(LINES, rng.randint(1, 5))] for _ in range(rng.randint(0, 7))) + rng.choice(["", "\n"])
    texts = [*(pick() for _ in range(600)), "[" * 64 + "]" * 64, "[" * 65 + "]" * 65, " " * 99 + "fn x y\nuse z;\n", "\ufeff{}", '{"a":1e999}', '"\\u12"', "1" * 5000, "a:", "1"]
    rows = blocktext.with_signals(spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("nul", F.contains("text", F.lit("\x00"))))
    found = rows.select("i", F.struct("sig.*", "nul").alias("sig"), "js").collect()
    got = detection.verdicts_of(pa.array(texts))
    assert {r.i: detection.VERDICTS[got[r.i]] for r in found} == {r.i: expected(r.sig, r.js) for r in found}
    assert detection.verdicts_of(pa.array([], pa.string())).tolist() == []


def test_null_text_is_unknown(spark):
    rows = blocktext.detect(spark.createDataFrame([(None, "text"), ("{}", "opaque"), ("{}", None)], "text string, kind string"), F.col("kind"))
    assert [(r.detected_kind, r.confidence) for r in rows.orderBy("text", "kind").collect()] == [("unknown", "low"), ("json", "high"), ("unknown", "low")]


def test_documents_of_a_pattern_are_documents():
    rng = random.Random(4)
    parts = ['"a"', '"\\n"', '"\\x"', "1", "-0.5e3", "01", "true", "nul", "{", "}", "[", "]", ",", ":", " ", "\n", "\x0b", '"\t"', "9" * 19]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(20000)] + ['[{"a": [1], "b": {}}]', '{"a":{"b":[1]}}', "[[[]]]"]
    codes = detection._documents(pa.array(texts), detection._matched(pa.array(texts), detection.MAY_BE_JSON))

    def parsed(text):
        try:
            strict(text)
        except ValueError:
            return False
        return True

    assert [t for t, c in zip(texts, codes) if parsed(t) != (c >= 0)] == []
    assert all((document_facts(t) is not None) == parsed(t) for t in texts)
    assert line_facts('{"a":[1]}\n1\n[]\nx\n\xa0true\n"a') == (4, 2, 2) and depth([[{"a": [1]}], 2]) == 4 and depth(3) == 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["C07_detect_outputs", "C13_json_shape", "C13_text_shape", "D46_semantic_coverage"])
def test_texts_are_looked_at_once(spark, name):
    """One pass tells the kinds, and no counter of a text is derived beside it."""
    found = plan(queries()[name](spark, "/root/testdata/sf0.001"))
    assert found.count("_detected(") == 1 and found.count("json_facts(") == 0 and "regexp_extract_all" not in found


def test_dealt_tables_hold_the_columns_asked_for(spark, monkeypatch):
    monkeypatch.setattr(bindings, "HEAVY_TASK", 1)
    rows = bindings.read_text(spark, "/root/testdata/sf0.001", "orders", "o_orderkey")
    stored = spark.read.parquet(*rows.inputFiles())
    assert stored.columns == ["o_orderkey"]
    assert sorted(rows.collect()) == sorted(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey").collect())
    assert bindings.read_text(spark, "/root/testdata/sf0.001", "orders", "o_custkey", "o_orderkey").columns == ["o_custkey", "o_orderkey"]
