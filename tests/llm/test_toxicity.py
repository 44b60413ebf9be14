"""The chain field against sums over all labellings, odd texts, and accuracy on held-out documents."""

import itertools

import numpy as np
import pandas as pd

from sessionlens.llm import query_op13, toxicity
from sessionlens.llm.toxicity import Field, Model, fitted, tokens


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    t = tokens([b"one two three four. five six", b"", None, b"seven! eight nine ten eleven"])
    assert t.length.tolist() == [4, 2, 1, 4]
    field = Field(np.unique(t.feature), rng.normal(size=len(np.unique(t.feature))), rng.normal(size=5))
    p, pairs = field.marginals(t)
    token, at = field.known(t)
    bias, start, rise, fall, stay = field.scores
    own = np.bincount(token, weights=field.weights[at], minlength=len(p)) + bias
    step = {(0, 0): 0.0, (0, 1): rise, (1, 0): fall, (1, 1): stay}
    pair = 0
    for first, n in zip(t.first, t.length):
        ways = list(itertools.product((0, 1), repeat=int(n)))
        scores = np.exp([sum(own[first + i] * y[i] for i in range(n)) + start * y[0] + sum(step[y[i], y[i + 1]] for i in range(n - 1)) for y in ways])
        scores /= scores.sum()
        for i in range(n):
            assert np.isclose(p[first + i], sum(s for s, y in zip(scores, ways) if y[i]))
        for i in range(n - 1):
            for k, states in enumerate(((0, 1), (1, 0), (1, 1))):
                assert np.isclose(pairs[pair, k], sum(s for s, y in zip(scores, ways) if y[i : i + 2] == states))
            pair += 1
    assert pair == len(pairs)


TOXIC = ["you are a Blargon and fool. Nice day", "what a blargonish thing, blargon", "Blargon blargon! go", "the ÉLBLARG is a blargon"] * 5
CLEAN = ["you are a friend and nice. Good day", "what a lovely thing, dear", "go with them! go", "the ELM is a tree"] * 15


def test_tagging():
    texts = [x.encode() for x in TOXIC + CLEAN]
    toxic = np.array([1] * len(TOXIC) + [0] * len(CLEAN))
    model = Model(fitted(texts, toxic), np.array([-3.0, 6.0, 0.0, 0.0]))
    spans = lambda text: [(s["start"], s["stop"]) for s in toxicity._spans(*model.scores([text.encode()])[:2], 1).to_pylist()[0]]
    assert spans("É so BLARGON blargons. Blargon it is") == [(5, 21), (23, 30)]
    assert spans("a lovely day") == [] and spans("") == []
    _, _, score = model.scores([b"oh blargon", b"oh dear", None, b""])
    assert score[0] > 0.5 > score[1] and score[2] == score[3]


SCHEMA = "doc_id long, text string, score string, spans int, text_ int"


def test_odd_rows(spark):
    texts = TOXIC + CLEAN + [None, "", "12 !!", "blargon " * 60_000, "fine words " * 60_000]
    rows = [(i, t, "s", 1, 2) for i, t in enumerate(texts)] + [(None, "blargon blargon", "s", 1, 2), (0, TOXIC[0], "s", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, int(i < len(TOXIC))) for i in range(len(TOXIC) + len(CLEAN))] + [(0, 0), (1, None), (2, 7), (None, 1), (10**6, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model, keep=("doc_id", "score", "spans", "text_")).toPandas()
    assert len(got) == len(rows) and (got.score == "s").all() and (got.spans == 1).all() and got.score_.between(0, 1).all()
    n = len(TOXIC) + len(CLEAN)
    by_id = got.drop_duplicates("doc_id").set_index("doc_id").score_
    assert (by_id[range(len(TOXIC))] > 0.5).all() and (by_id[range(len(TOXIC), n)] < 0.5).all()
    assert by_id[n] == by_id[n + 1] < 0.5 and by_id[n + 3] > 0.5 > by_id[n + 4]
    assert toxicity.scored(docs.limit(0), model).count() == 0
    for some, share in ((labels.where("toxic = 0"), 0), (labels.limit(0), 0), (labels.where("toxic = 1"), 1)):
        one = toxicity.scored(docs.limit(3), toxicity.train(docs, some)).toPandas()
        assert np.allclose(one.score, share, atol=1e-6)


def test_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    got = query_op13.toxicity(spark, data).toPandas().merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    bad, good = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert len(held) > 50 and (bad[:, None] > good).mean() > 0.85
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 1 and (held[held.toxic == 1].predicted.sum()) >= 0.6 * len(bad)
