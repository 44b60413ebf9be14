"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re
import textwrap

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlens.llm import common, jaccard, language, licences, mixing, neighbours, pieces, quality, sharding, suffixes, tokenfile
from sessionlens.session import new_folder

LONG = "some words that go on and on with numbers %d and letters in between. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __text string, id int, shared int, kept string, `text_` int"
TEXTS = [None, "", "one two three", "one two three", "".join(LONG % i for i in range(3000)), "x " * 50 + "\n\n  tab\there é 😀 <|endoftext|>", "12 34 !!"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 2 else "en", None if i == 3 else "s", len(t or ""), "c", "d", 1, None, None, 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, 5, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_tokens(spark, odd, none):
    for frame, n in ((odd, 9), (none, 0)):
        path = new_folder(spark, "tokens")
        tokenfile.write_tokens(frame, path, public_tokenizers.path("byte_bpe_50k.json"))
        got = tokenfile.read_digests(spark, path).collect()
        assert len(got) == n and {r.n_tokens for r in got if r.doc_id in (0, 1)} == ({1} if n else set())
        if n:
            starts = sorted((r.start, r.n_tokens) for r in got)
            assert all(a + b == c for (a, b), (c, _) in zip(starts, starts[1:])) and starts[0][0] == 0
            assert {tuple(r.ids) for r in tokenfile.fetch(spark, path, [1, 2]).collect() if r.doc_id == 1} == {(0,)}
            places = tokenfile.index(spark, path)
            assert {(r.start, r.n_tokens) for r in places.collect()} == set(starts)


def test_near_duplicates(odd, none):
    got = by_id(jaccard.near_duplicates(odd))
    assert len(got) == 7 and got[0].n_shingles == 0 and got[0].component_id == 0 and got[1].component_id == 1
    assert got[2].n_shingles == 1 and got[3].component_id == 2 and got[6].component_id == 6
    assert jaccard.near_duplicates(none).count() == 0


def test_texts_of_others_stay(spark):
    """A filter lets all named rows through and few others, before any shuffle, however long the list is."""
    rows = spark.range(-3000, 3000).select("id", F.lit("text").alias("words")).unionByName(spark.createDataFrame([(None, "x")], "id long, words string"))
    known = rows.where("id % 7 = 0").select("id")
    passed = common.may_be_among(rows, "id", known)
    assert passed.columns == ["id", "words"] and known.join(passed, "id", "left_anti").count() == 0
    assert known.count() <= passed.count() < 900 and passed.where("id IS NULL").count() == 0
    assert common.may_be_among(rows, "id", known.limit(0)).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = jaccard._sets(rows.select(F.col("id").alias("doc_id"), F.col("words").alias("text")), known.selectExpr("id", "1L AS sig_a", "2L AS sig_b"))
        found = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastNestedLoopJoin" in found and "SortMergeJoin" in found


def test_last_stage_remembers_little(monkeypatch, odd):
    """Its workers serve all stages of the pipeline: what they keep there is a fraction of what op4 keeps."""
    asked = {}
    monkeypatch.setattr(corpus_pipeline, "encoded", lambda docs, *args, **named: asked.update(named) or pieces.encoded(docs, *args, **named))
    corpus_pipeline.pieces(odd.sparkSession, odd, "")
    assert 0 < asked.get("remembered", pieces.REMEMBERED) <= pieces.REMEMBERED // 4


def test_repeats(odd, none):
    got = by_id(suffixes.without_repeats(odd, with_text=True))
    assert len(got) == 7 and (got[0].n_bytes, got[0].n_removed) == (0, 0) and got[3].n_removed == 0
    assert got[5].n_removed == 0 or got[5].n_spans >= 1
    assert suffixes.without_repeats(none).count() == 0


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_a_bucket_is_a_file(spark, monkeypatch, broadcast):
    """Candidates are dealt by doc_id alone: no task writes a file for every bucket, and a join that dealt them is enough."""
    import hashlib

    passage = "".join(LONG % i for i in range(4))
    texts = {i: f"{i:04} own words {'abc' * (i % 7)} {passage if i % 2 else i * 'z'} the end of {i}" for i in range(120)}
    rows = [*texts.items(), (5, texts[5]), (7, "another text under a known doc_id " * 9), (9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []

    def watched(spark, frame, *more):
        seen.append((frame._jdf.queryExecution().executedPlan().toString(), common.bucketed(spark, frame, *more)))
        return seen[-1][1]

    monkeypatch.setattr(suffixes, "bucketed", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = by_id(suffixes.without_repeats(frame))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    [(plan, table)] = seen
    assert len(table.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert broadcast != "-1" or not re.search(r"hashpartitioning\([^)]*\), REPARTITION", plan)
    for i in (7, 9):
        texts[i] = min([t or "" for k, t in rows if k == i], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    windows, want = set(), {}
    for i, text in texts.items():
        data, gone = text.encode(), set()
        for k in range(len(data) - 99):
            gone |= set(range(k, k + 100)) if data[k : k + 100] in windows else set()
            windows.add(data[k : k + 100])
        want[i] = (len(data), len(gone), hashlib.sha256(bytes(b for k, b in enumerate(data) if k not in gone)).hexdigest())
    assert {i: (r.n_bytes, r.n_removed, r.kept_sha256) for i, r in got.items()} == want and sum(w[1] > 0 for w in want.values()) > 50


def test_rows_stay_whole(spark, odd, none):
    empty = language.train(none.select("text", "lang"))
    model = language.train(odd.select("text", "lang"))
    for frame, n in ((odd, 9), (none, 0)):
        assert quality.measured(frame, keep=tuple(odd.columns)).count() == n
        assert pieces.encoded(frame, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "text_", "kept")).count() == n
        assert mixing.mix(frame.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).count() == n
        assert sharding.place(frame, "doc_id", ["a", "b"], 31).count() == n
        plain = frame.select("doc_id", "text", F.col("text_").alias("c"))
        assert language.identified(plain, model).count() == n
        assert {r.lang_pred for r in language.identified(plain, empty).collect()} <= {"und"}
    named = by_id(language.identified(odd.select("doc_id", "text"), model))
    assert named[0].lang_pred == "und" and named[6].lang_pred == "und" and named[2].lang_pred == "en" and named[0].spans == []
    with pytest.raises(ValueError):
        sharding.place(sharding.place(odd, "doc_id", ["a"], 31), "doc_id", ["a"], 31)


def test_licences(spark, odd, none):
    text = "Intro\nreleased under the  MIT license\n"
    more = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    got = licences.scanned(more, {"MIT": "Released under the MIT License."}, 0.8).collect()
    assert [(r.doc_id, r.licence, r.dice) for r in got if r.line == 2] == [(1, "MIT", 1.0)] * 2
    assert licences.scanned(none, {"MIT": "a b"}, 0.8).count() == 0 and licences.scanned(odd, {}, 0.8).count() == 0


def test_licence_passages(spark, odd, none):
    from sessionlens.llm.query_op8 import LEAST, TEMPLATES

    wrapped = "\n".join(textwrap.wrap("MIT License Copyright (c) 2020 Somebody " + TEMPLATES["MIT permission"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of what follows. It comes as is and without any warranty of any kind, express or implied, and nobody is liable for claims or damages.", 80))
    header = "\n".join("# " + x for x in textwrap.wrap(TEMPLATES["Apache-2.0 header"], 70)) + "\nimport os\n" + "\n".join(f"value_{i} = call(os.name, {i})" for i in range(20))
    inside = "Some notes about the tool and how to use it. Released under the MIT License. See the web page for more."
    twice = " and then ".join([TEMPLATES["MIT"]] * 2)
    texts = [wrapped, header, inside, twice, None, "", "mit", "the license of the software is hereby granted to the public " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.licence) for r in licences.scanned(docs, TEMPLATES, LEAST).where("doc_id < 3").collect()} <= {(1, "Apache-2.0")}
    got = licences.passages(docs, TEMPLATES, LEAST).collect()
    assert {(r.doc_id, r.licence) for r in got if r.doc_id in (0, 2)} == {(0, "MIT permission"), (2, "MIT")}
    assert {r.licence for r in got if r.doc_id == 1} == {"Apache-2.0", "Apache-2.0 header"}
    assert [(r.word, r.n_words, r.dice) for r in got if r.doc_id == 2] == [(11, 5, 1.0)]
    assert sorted(r.word for r in got if r.doc_id == 3) == [1, 8] and not [r for r in got if r.doc_id > 3]

    for r in got:  # against plain Python: no window of the same size bounds is better than the best reported one
        words, wanted = (re.findall("[a-z0-9]+", x.lower()) for x in (texts[r.doc_id], TEMPLATES[r.licence]))
        pairs, t = list(zip(words, words[1:])), set(zip(wanted, wanted[1:]))
        dice = lambda u: 2 * len(u & t) / (len(u) + len(t))
        assert r.dice == pytest.approx(dice(set(pairs[r.word - 1 : r.word + r.n_words - 2])))
        sizes = range(1, int((len(wanted) - 1) * 1.5) + 1)
        top = max(dice(set(pairs[i : i + n])) for i in range(len(pairs)) for n in sizes)
        assert max(x.dice for x in got if (x.doc_id, x.licence) == (r.doc_id, r.licence)) == pytest.approx(top)
    assert [(r.word, r.n_words) for r in licences.passages(docs, {"one": "MIT"}, 0.8).where("doc_id = 2").collect()] == [(14, 1)]
    assert licences.passages(none, {"MIT": "a b"}, 0.8).count() == 0 and licences.passages(odd, {}, 0.8).count() == 0


def test_cutoffs_of_the_null_stratum(spark):
    schema = "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in quality.MEASURES)
    rows = [(i, None if i % 2 else "en", 100, 500, 0, 0, 10, 0) for i in range(4000)]  # good: no symbols, no repeats, words of five letters
    beyond = [(4000, None, 100, 500, 400, 0, 10, 0), (4001, "en", 100, 500, 400, 0, 10, 0)]
    chosen = quality.cutoffs(spark.createDataFrame(rows, schema).drop("doc_id"))
    found = {(r.stratum, r.rule): r.cutoff for r in chosen.collect()}
    assert {r for s, r in found if s is None} == {r for s, r in found if s == "en"} == set(quality.RULES)
    kept = by_id(quality.judged(spark.createDataFrame(rows[:2] + beyond, schema), chosen))
    assert [kept[i].kept for i in (0, 1, 4000, 4001)] == [True, True, False, False]


def test_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(1, 12)]
    rows += [(20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, None, 1.0]), (23, [float("nan"), 1.0, 1.0]), (24, [1.0]), (None, [1.0, 1.0, 1.0]), rows[0]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = neighbours.nearest(frame, frame.where("vec_id in (3, 20, 21)"), k=20).orderBy("rank").collect()
    want = sorted(((-sum(a * b for a, b in zip(v, rows[2][1])), i) for i, v in rows[:11] if i != 3))
    assert [(r.query_id, r.vec_id) for r in got] == [(3, i) for _, i in want] and [r.score for r in got] == [-s for s, _ in want]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(same, same.where("vec_id = 5"), k=4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert neighbours.nearest(same.limit(0), same, k=4).count() == 0 and neighbours.nearest(same, same.limit(0), k=4).count() == 0


def test_pipeline(spark, odd, none):
    for frame in (odd, none):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if stage is not corpus_pipeline.pieces:
                assert out.dtypes == frame.dtypes
            docs = out
        assert docs.where("not round_trip").count() == 0


def test_licences_with_clashing_names(spark):
    frame = spark.createDataFrame([(1, "Released under the MIT License.", "s", 7, "n", 1, 2, "d")], "doc_id long, text string, size string, fitting int, name string, low int, line int, dice string")
    everything = ("doc_id", "size", "fitting", "name", "low", "line", "dice")
    [row] = licences.scanned(frame, {"MIT": "Released under the MIT License."}, 0.8, keep=everything).collect()
    assert row.asDict() == {"doc_id": 1, "size": "s", "fitting": 7, "name": "n", "low": 1, "line": 2, "dice": "d", "line_": 1, "licence": "MIT", "dice_": 1.0}
    [row] = licences.passages(frame, {"MIT": "Released under the MIT License."}, 0.8, keep=everything).collect()
    assert row.dice == "d" and row.dice_ == 1.0 and row.word == 1 and row.name == "n"


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_anchors_miss_nothing(spark, least):
    """Units made of parts of templates: those that the pattern passes over have too low a Dice."""
    import random

    from sessionlens.llm.query_op8 import TEMPLATES

    rng, rows = random.Random(3), []
    for i in range(400):
        words = re.sub("[^a-z0-9]+", " ", rng.choice(list(TEMPLATES.values())).lower()).split()
        kept = [w for w in words if rng.random() < rng.choice([0.5, 0.8, 0.95])] + rng.sample(["one", "two", "three"], rng.randrange(3))
        rows.append((i, " ".join(kept)))
    sets = {k: set(zip(w, w[1:])) or set(w) for k, v in TEMPLATES.items() for w in [re.sub("[^a-z0-9]+", " ", v.lower()).split()]}
    want = set()
    for i, text in rows:
        w = text.split()
        mine = set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w}
        want |= {(i, k) for k, s in sets.items() if mine and 2 * len(mine & s) / (len(mine) + len(s)) >= least}
    got = licences.scanned(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES, least).select("doc_id", "licence").collect()
    assert {tuple(r) for r in got} == want and len(want) > 5


def test_thinned_memory_gives_the_same_pieces():
    """Stretches that come back stay, others are searched again: results do not depend on what a worker remembers."""
    import random

    path = public_tokenizers.path("piece_bpe_32k.model")
    small, large = pieces.Segmenter(path, 3, 60), pieces.Segmenter(path, 3)
    rng = random.Random(9)
    words = ["word", "other", "läuft", "naïve", "x", "tokenization", "日本", "😀"] + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    for _ in range(40):
        texts = [" ".join(rng.choices(words, weights=[30] * 8 + [1] * 300, k=12)) for _ in range(3)]
        got = [(b.tolist(), s, [x.tolist() for x in l]) for b, s, l in small.best(texts)]
        want = [(b.tolist(), s, [x.tolist() for x in l]) for b, s, l in large.best(texts)]
        assert got == want
    assert len(small.place) <= 60 + 40 and {"▁word", "▁other"} <= set(small.place)


def test_signs_are_no_letters(spark):
    texts = ["×", "。", "١٢٣ ४५", "÷ 12 «»", "a", "日", None]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    learnt = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de")], "text string, lang string")
    got = by_id(language.identified(frame, language.train(learnt), keep=("doc_id", "score")))
    assert [got[i].lang_pred == "und" for i in range(7)] == [True, True, True, True, False, False, True]
    assert all(got[i].score == "s" for i in range(7)) and got[0].score_ == 0 and got[0].spans == [] and got[4].score_ == 1 and len(got[4].spans) == 1
