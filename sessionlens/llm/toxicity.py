"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

A chain is a sentence; its tokens are runs of letters and are toxic (1) or not (0). A token's features
are its word and its first bytes, a few lengths of them; one weight a feature, and scores for starting
toxic and for each change of state. The forward and backward passes keep the log odds of the two states
only, one number a token, for all chains of a megabyte of text at once.

Labels are given for documents. Tokens are labelled from them: features that stand in toxic documents
far more often than elsewhere, by a likelihood ratio test over all features, mark the tokens of toxic
documents; tokens of other documents are clean. Weights maximise the regularised likelihood of these
labels. A document's marginals give how many toxic tokens to expect, the surest one and the share of
them; a logistic function of these, fitted on documents that the field was not trained on (two folds),
is the score. Spans are runs of tokens with a marginal of a half or more.

The model is fitted on a bounded sample: `SAMPLE` labelled documents of each class with texts of up to
`SAMPLE_TEXT` bytes, picked by a hash. Every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .words import Text, mixed, pieces

#: Labelled documents of each class that the model is fitted on, and the longest text among them.
SAMPLE, SAMPLE_TEXT = 1500, 32 << 10
#: Lengths of the beginnings of words, in bytes.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A feature needs so many toxic documents; a marking feature is so many times as frequent in them.
SUPPORT, TIMES, ERROR = 3, 4.0, 0.05
ROUNDS, RATE, RIDGE = 40, 0.25, 1e-3

_LETTER, _END = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_END[[*b".!?\n\r"]] = True


@dataclass
class Tokens:
    """Tokens of texts: their places, documents and chains, and pairs (token, feature hash)."""

    text: Text
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first token of each chain
    length: np.ndarray  # tokens of each chain
    token: np.ndarray
    feature: np.ndarray


def tokens(texts: list[bytes | None]) -> Tokens:
    text = Text([t or b"" for t in texts], fold_case=True)
    data = text.data
    # capital Latin letters of two bytes, whose small ones have two as well
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[wide] += 32
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = _LETTER[data]
    turn = np.diff(inside)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    ends = np.concatenate(([0], np.cumsum(_END[data])))
    new = np.ones(len(begin), bool)
    new[1:] = ends[begin[1:]] > ends[end[:-1]]
    first = np.flatnonzero(new)
    every = np.arange(len(begin))
    token, feature = [every], [text.hashes(begin, end)]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - begin >= k)
        token.append(long)
        feature.append(mixed(text.hashes(begin[long], begin[long] + k) + np.uint64(k)))
    return Tokens(text, begin, end, text.owner(begin), first, np.diff(np.append(first, len(begin))), np.concatenate(token), np.concatenate(feature))


@dataclass
class Field:
    """Feature hashes, rising, with their weights; `scores`: bias, start, clean to toxic, toxic to clean, toxic to toxic."""

    features: np.ndarray
    weights: np.ndarray
    scores: np.ndarray

    def known(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (token, place of the feature) of the features that have a weight."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not hasattr(self, "_marks"):
            self._marks = np.zeros(1 << 20, bool)
            self._marks[self.features & np.uint64((1 << 20) - 1)] = True
        likely = np.flatnonzero(self._marks[t.feature & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.features, t.feature[likely]), len(self.features) - 1)
        hit = self.features[at] == t.feature[likely]
        return t.token[likely[hit]], at[hit]

    def marginals(self, t: Tokens, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each token is toxic, and of each pair of states between neighbours (3 columns: 01, 10, 11)."""
        token, at = known or self.known(t)
        bias, start, rise, fall, stay = self.scores
        own = np.bincount(token, weights=self.weights[at], minlength=len(t.begin)) + bias
        ahead, behind = np.zeros(len(own)), np.zeros(len(own))
        order = np.argsort(-t.length, kind="stable")
        first, length = t.first[order], t.length[order]
        steps = int(length[0]) if len(length) else 0
        longer = np.searchsorted(-length, -np.arange(steps))  # chains with more than s tokens
        ahead[first] = own[first] + start
        for s in range(1, steps):
            here = first[: longer[s]] + s
            before = ahead[here - 1]
            ahead[here] = own[here] + np.logaddexp(rise, before + stay) - np.logaddexp(0, before + fall)
        for s in range(steps - 2, -1, -1):
            here = first[: longer[s + 1]] + s
            after = behind[here + 1] + own[here + 1]
            behind[here] = np.logaddexp(fall, stay + after) - np.logaddexp(0, rise + after)
        p = 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))
        inner = np.ones(len(own), bool)
        inner[t.first] = False
        right = np.flatnonzero(inner)
        after = own[right] + behind[right]
        pairs = np.stack([np.zeros(len(right)), rise + after, ahead[right - 1] + fall, ahead[right - 1] + stay + after], axis=1)
        pairs = np.exp(pairs - pairs.max(axis=1, keepdims=True)) if len(right) else pairs
        return p, (pairs / pairs.sum(axis=1, keepdims=True))[:, 1:]


def _labels(t: Tokens, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with enough support, and a label for every token."""
    features, at = np.unique(t.feature, return_inverse=True)
    pair, times = np.unique(t.doc[t.token] * len(features) + at, return_counts=True)
    doc, feature = pair // max(len(features), 1), pair % max(len(features), 1)
    bad = toxic[doc] > 0
    count = lambda which, weight=None: np.bincount(feature[which], weights=None if weight is None else weight[which], minlength=len(features))
    with_bad, with_good, often = count(bad), count(~bad), np.minimum(times, 4).astype(float)
    n_bad, n_good = max(int((toxic > 0).sum()), 1), max(int((toxic == 0).sum()), 1)
    ratio = (count(bad, often) + 0.5) / n_bad / ((count(~bad, often) + 0.5) / n_good)

    def term(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share = (with_bad + with_good) / (n_bad + n_good)
    test = 2 * (term(with_bad, n_bad * share) + term(with_good, n_good * share) + term(n_bad - with_bad, n_bad * (1 - share)) + term(n_good - with_good, n_good * (1 - share)))
    fit = with_bad >= SUPPORT
    marking = fit & (ratio >= TIMES) & (test >= 2 * np.log(max(int(fit.sum()), 1) / ERROR))
    label = np.zeros(len(t.begin), bool)
    label[t.token[marking[at]]] = True
    return features[fit], label & (toxic[t.doc] > 0)


def fitted(texts: list[bytes], toxic: np.ndarray) -> Field:
    """The field of labelled texts, by gradients of the whole likelihood with a step size for each weight."""
    t = tokens(texts)
    features, label = _labels(t, toxic)
    field = Field(features, np.zeros(len(features)), np.array([-3.0, 0.0, 0.0, 0.0, 0.0]))
    known = field.known(t)
    inner = np.ones(len(t.begin), bool)
    inner[t.first] = False
    right = np.flatnonzero(inner)
    left_is, right_is = label[right - 1], label[right]
    seen = np.array([label.sum(), label[t.first].sum(), (~left_is & right_is).sum(), (left_is & ~right_is).sum(), (left_is & right_is).sum()], float)
    n = max(len(t.begin), 1)
    mean, square = np.zeros(len(features) + 5), np.zeros(len(features) + 5)
    for step in range(1, ROUNDS + 1):
        p, pairs = field.marginals(t, known)
        of_scores = np.array([p.sum(), p[t.first].sum(), *pairs.sum(axis=0)]) - seen
        of_weights = np.bincount(known[1], weights=(p - label)[known[0]], minlength=len(features))
        slope = np.concatenate([of_weights, of_scores]) / n + RIDGE / n * np.concatenate([field.weights, field.scores])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-12)
        field.weights, field.scores = field.weights - move[: len(features)], field.scores - move[len(features) :]
    return field


def measures(t: Tokens, p: np.ndarray, n: int) -> np.ndarray:
    """Of each text: 1, expected toxic tokens (log), the surest, their share (log)."""
    total, size = np.bincount(t.doc, weights=p, minlength=n), np.bincount(t.doc, minlength=n)
    surest = np.zeros(n)
    np.maximum.at(surest, t.doc, p)
    return np.stack([np.ones(n), np.log1p(total), surest, np.log((total + 0.05) / (size + 5))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a small penalty."""
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ beta
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, slope)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    field: Field
    beta: np.ndarray

    def scores(self, texts: list[bytes | None]) -> tuple[Tokens, np.ndarray, np.ndarray]:
        t = tokens(texts)
        p, _ = self.field.marginals(t)
        return t, p, 1 / (1 + np.exp(-np.clip(measures(t, p, len(texts)) @ self.beta, -30, 30)))


_MODEL_SQL = "features binary, weights binary, scores binary, beta binary"


def _learn(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("draw", "ascending"), ("text", "ascending")])
    texts, toxic = rows["text"].cast(pa.large_binary()).to_pylist(), np.asarray(rows["toxic"], np.int64)
    # a class's weight brings the sample back to the share of the class among all labels
    weight = np.asarray(rows["total"], float) / np.bincount(toxic, minlength=2)[toxic]
    x, half = np.zeros((len(texts), 4)), np.arange(len(texts)) % 2
    for side in (0, 1):
        mine, others = np.flatnonzero(half == side), np.flatnonzero(half != side)
        field = fitted([texts[i] for i in others], toxic[others])
        t = tokens([texts[i] for i in mine])
        x[mine] = measures(t, field.marginals(t)[0], len(mine))
    beta = _logistic(x, toxic, weight / weight.sum() * len(texts))
    field = fitted(texts, toxic)
    data = (field.features.astype("<u8"), field.weights.astype("<f8"), field.scores.astype("<f8"), beta.astype("<f8"))
    return pa.table([pa.array([d.tobytes()], pa.binary()) for d in data], names=["features", "weights", "scores", "beta"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from `docs` (doc_id, text) and `labels` (doc_id, toxic: 1 toxic, 0 not; others and nulls do not count).

    An id with several labels is toxic if one of them is. Without labelled texts of both classes every
    score is the share of toxic labels, 0 if there are none.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = known.withColumn("draw", F.xxhash64(F.col("doc_id").cast("string")))
    parts = [drawn.where(F.col("toxic") == c).orderBy("draw", "doc_id").limit(SAMPLE) for c in (0, 1)]
    wanted = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * SAMPLE rows of numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT)
    total = F.when(F.col("toxic") == 1, sizes.get(1, 0)).otherwise(sizes.get(0, 0)).alias("total")
    sample = texts.join(wanted, "doc_id").select("text", "toxic", "draw", total)
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()} if len(sizes) == 2 else {}
    if len(counts) < 2:
        share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
        level = np.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return Model(Field(np.zeros(0, np.uint64), np.zeros(0), np.array([-30.0, 0, 0, 0, 0])), np.array([level, 0, 0, 0]))
    [row] = sample.groupBy().applyInArrow(_learn, _MODEL_SQL).collect()
    return Model(Field(np.frombuffer(row.features, "<u8"), np.frombuffer(row.weights, "<f8"), np.frombuffer(row.scores, "<f8")), np.frombuffer(row.beta, "<f8"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("toxicity", pa.float64())]))


def _spans(t: Tokens, p: np.ndarray, n: int) -> pa.Array:
    """Runs of toxic tokens of each text: code points from `start` to `stop`, and the mean marginal."""
    toxic = np.flatnonzero(p >= 0.5)
    chain = np.searchsorted(t.first, toxic, "right")
    new = np.ones(len(toxic), bool)
    new[1:] = (toxic[1:] != toxic[:-1] + 1) | (chain[1:] != chain[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(toxic)))
    low, high = toxic[begin], toxic[begin + size - 1] if len(begin) else toxic
    points = np.concatenate(([0], np.cumsum((t.text.data & 0xC0) != 0x80)))
    doc = t.doc[low]
    base = points[t.text.begin[doc]]
    mean = np.add.reduceat(p[toxic], begin) / size if len(begin) else np.zeros(0)
    edges = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    parts = [pa.array(points[t.begin[low]] - base), pa.array(points[t.end[high]] - base), pa.array(mean)]
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(parts, fields=list(_SPANS.value_type)))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `score` (0 to 1) and `spans`, the toxic parts of the text, for every row of `docs`.

    Null and empty texts have no spans and the score of a text without tokens. Equal texts have equal
    scores. Texts are read whole. Columns of `keep` that are named as results keep their names, and the
    results get an underscore. No rows: no result rows.
    """
    [score, spans, own] = fresh(docs.select(*keep), "score", "spans", "text_")
    source = docs.select(*keep, F.col(text).alias(own))
    names = [*keep, score, spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in pieces(batch, own):
                t, p, found = model.scores(texts)
                part = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found), _spans(t, p, len(texts))], names=names)

    kinds = {score: "double", spans: "array<struct<start: bigint, stop: bigint, toxicity: double>>"}
    schema = source.select(*keep, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).schema
    return source.mapInArrow(run, schema)
