"""Quality rules whose cutoffs come with a guarantee against false rejection.

Measures of every text are set against labelled holdouts. In each stratum (a language) and for each
rule (a measure and a grid of cutoffs, strictest last), the documents labelled good are counted by
grid step. A cutoff may be used if the exact binomial upper bound (Clopper-Pearson) on the share of
good documents that it would reject is at most `most_false` divided over the rules; the bounds hold
together with probability `confidence`, since each of the (strata * rules * grid steps) tests gets
the same part of the allowed error (Bonferroni). The strictest cutoff that passes is chosen; a rule
without one is not used in the stratum, so few labels mean few rejections.

Counts cover all labelled documents. They meet as (stratum, rule, step) counts, combined before the
shuffle; the chosen cutoffs are one row per stratum and rule. Measures need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .words import SPACE, Text, in_sequence, mixed, pieces

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")

#: Rules: a share in ten-thousandths that rejects a document above a cutoff, as (numerator, denominator), and its grid.
RULES = {
    "symbols": ("n_symbols", "word_chars", (2000, 1500, 1000, 700, 500, 300, 200)),
    "dup_lines": ("n_dup_lines", "n_lines", (7000, 6000, 5000, 4000, 3000, 2000)),
    "repeat_words": ("n_repeat_words", "n_words", (4500, 4000, 3500, 3000, 2500, 2000, 1500)),
    "long_words": ("word_chars", "n_words", (200000, 150000, 120000, 100000)),
}


def _measured(texts: list[bytes | None]) -> list[np.ndarray]:
    text = Text([t or b"" for t in texts])
    n = len(text)
    begin, end = text.words()
    owner = text.owner(begin)
    n_words = np.bincount(owner, minlength=n)
    inside = ~SPACE[text.data]
    word_chars = text.total(inside & ((text.data & 0xC0) != 0x80))
    symbols = text.total(SYMBOLS[text.data])
    # lines with a word, and how many of them differ
    first, last = text.lines()
    has_word = np.searchsorted(begin, last) > np.searchsorted(begin, first)
    first, last = first[has_word], last[has_word]
    of = text.owner(first)
    n_lines = np.bincount(of, minlength=n)
    by_text = mixed(np.arange(n, dtype=np.uint64))
    distinct = np.unique(mixed(text.hashes(first, last) + (last - first).astype(np.uint64)) ^ by_text[of], return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(of[distinct], minlength=n)
    # words in windows of three that occur twice or more in their text
    repeated = np.zeros(len(begin), bool)
    if len(begin) >= 3:
        one_text = owner[2:] == owner[:-2]
        at = np.flatnonzero(one_text)
        windows = in_sequence(text.hashes(begin, end), 3)[at] ^ by_text[owner[at]]
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    n_repeat = np.bincount(owner[repeated], minlength=n)
    return [n_words, word_chars, symbols, n_dup_lines, n_lines, n_repeat]


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and MEASURES, one row for every row of `docs`; a null text has no words."""

    [own] = fresh(docs.select(*keep), "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measured(texts) for _, texts in pieces(batch, own)]
            if not parts:
                continue
            found = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=[*keep, *MEASURES])

    source = docs.select(*keep, F.col(text).alias(own))
    schema = source.select(*keep, *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    return source.mapInArrow(run, schema)


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial(n, p), summed from its largest term."""
    i = np.arange(k + 1)
    lg = np.array([lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) for x in i]) if k < 200_000 else None
    if lg is None:
        i = i[-200_000:]  # terms fall geometrically below k when k < n * p
        lg = np.array([lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) for x in i])
    terms = lg + i * log(p) + (n - i) * log1p(-p)
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum()))


def passes(rejected: int, good: int, most: float, error: float) -> bool:
    """Whether the exact upper bound on the rejection rate, at error probability `error`, is at most `most`:
    that many rejections or fewer must have a probability of at most `error` if the rate were `most`."""
    if good == 0 or rejected >= good * most:
        return False
    return _log_tail(rejected, good, most) <= log(error)


def cutoffs(labelled: DataFrame, most_false: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """(stratum, rule, cutoff) from good rows of `labelled` (stratum, MEASURES): the strictest cutoffs that pass."""
    steps = []
    for rule, (top, bottom, grid) in RULES.items():
        share = F.when(F.col(bottom) > 0, F.floor(10000 * F.col(top) / F.col(bottom))).otherwise(0)
        beyond = sum((F.when(share > cut, 1).otherwise(0) for cut in grid), F.lit(0))
        steps.append(F.struct(F.lit(rule).alias("rule"), beyond.alias("step")))
    counts = (
        labelled.select("stratum", F.explode(F.array(*steps)).alias("s"))
        .groupBy("stratum", F.col("s.rule").alias("rule"), F.col("s.step").alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n_strata = labelled.select("stratum").distinct().count()
    part = most_false / len(RULES)

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        rule = found["rule"].iloc[0]
        grid = RULES[rule][2]
        error = (1 - confidence) / (n_strata * sum(len(r[2]) for r in RULES.values()))
        by_step = np.bincount(found["step"], weights=found["n"], minlength=len(grid) + 1).astype(int)
        rejected = by_step[::-1].cumsum()[::-1][1:]  # beyond the first cutoff, the second, ...
        good = [i for i in range(len(grid)) if passes(int(rejected[i]), int(by_step.sum()), part, error)]
        return found[["stratum", "rule"]].iloc[:1].assign(cutoff=int(grid[max(good)]) if good else None).dropna(subset=["cutoff"]).astype({"cutoff": "int64"})

    return counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff long")


def judged(measures: DataFrame, chosen: DataFrame) -> DataFrame:
    """Add `base_failed` and `kept` to rows with `stratum` and MEASURES.

    The base rules are fixed: under 50 words, or more than half of the words in repeated windows. Rows
    of a stratum without cutoffs pass unless the base fails. Null strata are a stratum of their own.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    wide = chosen.groupBy(F.col("stratum").alias("__stratum")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in RULES])
    over = F.lit(False)
    for rule, (top, bottom, _) in RULES.items():
        share = F.when(F.col(bottom) > 0, F.floor(10000 * F.col(top) / F.col(bottom))).otherwise(0)
        over = over | F.coalesce(share > F.col(f"__{rule}"), F.lit(False))
    rows = measures.join(wide, measures["stratum"].eqNullSafe(wide["__stratum"]), "left")
    return rows.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~over).drop("__stratum", *[f"__{r}" for r in RULES])
