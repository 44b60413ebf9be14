"""Language of mixed-language text: word scores, script ranges and a Viterbi pass.

Training counts byte trigrams (hashed to `FEATURES` cells) and the scripts of words per language,
over all training rows; the counts are combined in each task and summed by Spark, and the model is
`FEATURES` numbers a language, whatever the corpus. A word's score for a language is its trigrams'
log probability. The script of a word (from its UTF-8 ranges) leaves only languages that write a
noticeable part of their words in it. A Viterbi pass over the words, with a penalty for each switch
of language, labels every word; neighbouring words of a label form a span. A text's language is the
one with most letters.

Prediction is one pass over the texts without a shuffle: hot sources and copies do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .words import LOWER, SPACE, Text, pieces

FEATURES = 1 << 16
NONE = "und"

# Scripts by UTF-8 lead bytes (fixed values of the encoding). 0: no letter.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
_SCRIPT = np.zeros(256, np.uint8)
for _lead, _name in (
    ([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "latin"),
    ([0xCD, 0xCE, 0xCF], "greek"),
    (range(0xD0, 0xD5), "cyrillic"),
    ([0xD6, 0xD7], "hebrew"),
    (range(0xD8, 0xDD), "arabic"),
    ([0xE0], "indic"),
    ([0xE3], "kana"),
    (range(0xE4, 0xEA), "han"),
    (range(0xEA, 0xEE), "hangul"),
    ([0xCA, 0xCB, 0xCC, 0xDD, 0xDE, 0xDF, 0xE1], "other"),
):
    _SCRIPT[list(_lead)] = SCRIPTS.index(_name)

_FOLD = LOWER.copy()
_FOLD[SPACE] = 0x20


@dataclass(frozen=True)
class Model:
    """`scores`: FEATURES x languages, log probabilities; `writes`: scripts x languages, allowed or not."""

    languages: tuple[str, ...]
    scores: np.ndarray
    writes: np.ndarray


def _features(text: Text) -> np.ndarray:
    """The trigram cell around each byte."""
    b = _FOLD[text.data].astype(np.uint32)
    cell = b * np.uint32(0x01000193)
    cell[1:] += b[:-1] * np.uint32(0x9E3779B1)
    cell[:-1] += b[1:] * np.uint32(0x85EBCA77)
    cell ^= cell >> np.uint32(15)
    cell *= np.uint32(0x2C1B3C6D)
    return (cell >> np.uint32(16)).astype(np.int64)


def _letters(text: Text) -> np.ndarray:
    """The script of each byte that begins a letter, else 0."""
    return _SCRIPT[text.data]


def train(labelled: DataFrame, smoothing: float = 0.2, least_share: float = 0.01) -> Model:
    """A model from all rows of `labelled` (text, lang); null texts and null languages teach nothing.

    What comes to the driver is at most FEATURES + 11 counts a language. A script belongs to a
    language that writes at least `least_share` of its words in it. Without rows the model is empty
    and every prediction is `und`.
    """
    width = FEATURES + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for row, texts in pieces(batch, "text"):
                text, of = Text([t or b"" for t in texts]), names[row : row + len(texts)]
                cell, script = _features(text), _letters(text)
                begin, end = text.words()
                wordy = ~SPACE[text.data]
                word_script = np.maximum.reduceat(script, begin) if len(begin) else np.zeros(0, np.uint8)
                owner, byte_owner = text.owner(begin), np.repeat(np.arange(len(text)), text.end - text.begin + 1)
                for name in set(of):
                    mine = np.array([x == name for x in of])
                    got = sums.setdefault(name, np.zeros(width, np.int64))
                    got[:FEATURES] += np.bincount(cell[wordy & mine[byte_owner]], minlength=FEATURES)
                    got[FEATURES:] += np.bincount(word_script[mine[owner]], minlength=len(SCRIPTS))
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(got[at])], names=["lang", "cell", "n"])

    counts = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, cell long, n long")
    found = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    table = np.zeros((width, len(languages)))
    table[found["cell"], [languages.index(x) for x in found["lang"]]] = found["n"]
    seen = table[:FEATURES] + smoothing
    writes = table[FEATURES:] >= np.maximum(1, least_share * table[FEATURES + 1 :].sum(axis=0))
    return Model(languages, np.log(seen / seen.sum(axis=0)).astype(np.float32), writes)


def _emissions(text: Text, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its text, its scores relative to the best language, its number of letters."""
    begin, end = text.words()
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.int64)
    cell, script = _features(text), _letters(text)
    wordy = np.flatnonzero(~SPACE[text.data])
    starts = np.concatenate(([0], np.cumsum(end - begin)[:-1]))
    scores = np.add.reduceat(model.scores[cell[wordy]], starts, axis=0)
    of_word = script[wordy]
    letters = np.add.reduceat((of_word > 0).astype(np.int64), starts)
    writes = model.writes[np.maximum.reduceat(of_word, starts)]
    writes |= ~writes.any(axis=1, keepdims=True)  # a script that no language writes excludes none
    scores = np.where(writes, scores, scores.min(axis=1, keepdims=True) - np.float32(20))
    scores[letters == 0] = 0
    return text.owner(begin), scores - scores.max(axis=1, keepdims=True), letters


def viterbi(owner: np.ndarray, scores: np.ndarray, penalty: float, n: int) -> np.ndarray:
    """The best label of each word; all texts advance together, one word a step."""
    k = scores.shape[1]
    counts = np.bincount(owner, minlength=n)
    by_length = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[by_length]
    counts = counts[by_length]
    label, came = np.zeros(len(owner), np.int8 if k < 128 else np.int32), np.zeros(scores.shape, np.int8 if k < 128 else np.int32)
    best = np.zeros((n, k), np.float32)
    ends = np.searchsorted(-counts, -np.arange(counts[0] if n else 0), "left")  # texts with more than t words
    stay = np.arange(k)
    for t, m in enumerate(ends):
        now = best[:m]
        top = now.argmax(axis=1)
        changed = now[np.arange(m), top] - np.float32(penalty)
        better = changed[:, None] > now
        came[first[:m] + t] = np.where(better, top[:, None], stay)
        best[:m] = np.where(better, changed[:, None], now) + scores[first[:m] + t]
    state = best.argmax(axis=1)
    for t in range(len(ends) - 1, -1, -1):
        m = ends[t]
        at = first[:m] + t
        label[at] = state[:m]
        state[:m] = came[at, state[:m]]
    return label


def identified(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = 12.0, with_spans: bool = True) -> DataFrame:
    """The columns `keep`, `lang_pred`, `score` and, if asked for, `spans`, one row for every row of `docs`.

    `score` is the share of the letters that carry the language. `spans` are (first word, number of
    words, language) in order. Null texts and texts without a letter (by code points: signs, digits and
    marks are none) are `und` with score 0 and no spans. Equal shares go to the language first in name order.
    Where `keep` has a name of a result, the result gets an underscore.
    """
    predicted, score, cuts, own, lettered = fresh(docs.select(*keep), "lang_pred", "score", "spans", "text_", "lettered")
    spans = "array<struct<first:int,words:int,lang:string>>"
    if not model.languages:
        known = {predicted: F.lit(NONE), score: F.lit(0.0), **({cuts: F.array().cast(spans)} if with_spans else {})}
        return docs.select(*keep, *[c.alias(name) for name, c in known.items()])
    names = np.array([*model.languages, NONE], dtype=object)
    n_languages = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in pieces(batch, own, most=1 << 23):
                n, parts, at = len(texts), [], 0
                while at < n:  # features take many bytes a byte of text, the pass over words few
                    stop, size = at, 0
                    while stop < n and (stop == at or size + len(texts[stop] or b"") <= 1 << 20):
                        size += len(texts[stop] or b"")
                        stop += 1
                    owner, scores, letters = _emissions(Text([t or b"" for t in texts[at:stop]]), model)
                    parts.append((owner + at, scores, letters))
                    at = stop
                owner, scores, letters = (np.concatenate(x) for x in zip(*parts))
                label = viterbi(owner, scores, penalty, n)
                mass = np.zeros((n, n_languages + 1))
                np.add.at(mass, (owner, label), letters)
                for i in np.flatnonzero(mass.sum(axis=1) == 0):  # letters outside the script table, if any
                    if any(map(str.isalpha, (texts[i] or b"").decode("utf-8", "replace"))):
                        mass[i] = np.bincount(label[owner == i], minlength=n_languages + 1)
                mass[~np.asarray(batch.column(lettered).slice(row, n).to_pylist(), bool)] = 0
                whole = mass.sum(axis=1)
                pick = np.where(whole > 0, mass[:, :n_languages].argmax(axis=1), n_languages)
                share = np.where(whole > 0, mass.max(axis=1) / np.maximum(whole, 1), 0.0)
                out = [batch.column(c).slice(row, n) for c in keep] + [pa.array(names[pick], pa.string()), pa.array(share)]
                if with_spans:
                    out.append(_spans(owner, label, whole > 0, names, n))
                yield pa.RecordBatch.from_arrays(out, names=columns)

    source = docs.select(*keep, F.col(text).alias(own), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(lettered))
    shape = source.select(*keep, F.lit("").alias(predicted), F.lit(0.0).alias(score), *[F.lit(None).cast(spans).alias(cuts)] * with_spans)
    columns = shape.columns
    return source.mapInArrow(run, shape.schema)


def _spans(owner: np.ndarray, label: np.ndarray, known: np.ndarray, names: np.ndarray, n: int) -> pa.Array:
    shown = known[owner]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
    owner, label, place = owner[shown], label[shown], place[shown]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(owner)))
    offsets = np.searchsorted(owner[first], np.arange(n + 1), "left").astype(np.int32)
    kind = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])
    rows = pa.StructArray.from_arrays([pa.array(place[first], pa.int32()), pa.array(words, pa.int32()), pa.array(names[label[first]], pa.string())], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
