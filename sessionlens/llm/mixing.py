"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of the words of the whole corpus by its weight, at most `most_repeats`
times its own size. A source whose target is above its size is repeated whole as often as it fits;
what is left of the budget is filled by picking documents. Documents are counted by exact length,
each length first gives the same part of its documents, and the last stretch of the budget, which is
some times the longest document, is fitted by a bounded-knapsack dynamic programme over the lengths still in stock. Which documents of a length
are taken is decided by a seeded hash, so reruns agree.

Scale: documents are reduced to (source, length, slice) counts before anything meets; a slice is a
range of the seeded hash, so that a source, a length or a group of copies with a third of all rows is
ranked by thousands of tasks' worth of slices. One task of the dynamic programme sees the distinct
lengths of one source, a number bounded by the longest document, never its documents. The capped
shares are worked out over one row per source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the seeded hash inside one (source, length).
SLICES = 4096
#: The dynamic programme fits the last stretch of a budget: so many words, or so many times the longest
#: document, whichever is more.
LAST_STRETCH, LONGEST_TIMES = 1 << 16, 4

PICKS = "source string, size long, epochs long, picked long"


def shares(sizes: DataFrame, weights: tuple[int, ...], most_repeats: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources take `weights` in turn in code-point order, null last. Targets are min(cap, level *
    weight): caps are reached in the order of cap / weight, so each source tests the level that
    holds when all before it are capped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    tested = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # The first source that stays below its cap fixes the level of all after it.
    common = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(common, F.lit(float("inf"))) * F.col("weight"))
    return tested.select("source", "source_size", target.alias("target"))


def fit(sizes: np.ndarray, stock: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that the words come as near `budget` as possible
    from below; lengths are positive and distinct, `stock` counts their documents."""
    order = np.argsort(-sizes, kind="stable")
    size, left = sizes[order].astype(np.int64), stock[order].astype(np.int64)
    total = int((size * left).sum())
    if total <= budget:
        return stock.astype(np.int64)
    # In units of the lengths' common divisor; a rest of the budget below one unit fits nothing.
    unit = int(np.gcd.reduce(size[left > 0]))
    size, budget, total = size // unit, budget // unit, total // unit
    stretch = max(LAST_STRETCH // unit, LONGEST_TIMES * int(size[left > 0].max()))
    # The same part of every length, of all but the last stretch.
    even = max(0, budget - stretch // 2)
    taken = np.array([int(n) * even // total for n in left], dtype=np.int64)
    rest = budget - int((size * taken).sum())
    # Long lengths first until the rest is a stretch: as no length is above a quarter of it, none is left out for its size.
    for i in range(len(size)):
        if rest <= stretch:
            break
        more = min(int(left[i] - taken[i]), (rest - stretch // 2) // int(size[i]))
        if more > 0:
            taken[i] += more
            rest -= more * int(size[i])
    # Bounded knapsack: `by[s]` is the length that first reached the sum s, on top of sums reached before.
    reached, by = np.zeros(rest + 1, dtype=bool), np.full(rest + 1, -1, dtype=np.int32)
    reached[0] = True
    for i in range(len(size)):
        if reached[rest]:
            break
        one, front = int(size[i]), reached.copy()
        for _ in range(min(int(left[i] - taken[i]), rest // one)):
            step = np.zeros_like(front)
            step[one:] = front[: rest + 1 - one]
            front = step & ~reached
            if not front.any():
                break
            reached |= front
            by[front] = i
            if reached[rest]:
                break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        taken[by[at]] += 1
        at -= int(size[by[at]])
    out = np.empty_like(taken)
    out[order] = taken
    return out


def _plan_source(lengths: pd.DataFrame) -> pd.DataFrame:
    """Epochs and picks per length of one source; `lengths`: source, size, n, source_size, target."""
    own, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
    epochs = int(target // own)
    picked = fit(lengths["size"].to_numpy(), lengths["n"].to_numpy(), int(round(target - epochs * own)))
    return pd.DataFrame({"source": lengths["source"], "size": lengths["size"], "epochs": epochs, "picked": picked})


def mix(sized: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, keep_source: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `sized` (doc_id, source, size),
    and its source if asked for.

    `taken` is the words of the document that enter the mix: its size times the repeats of its
    source, once more if it was picked. Sources' sums come as near to their targets as lengths allow.
    A document without words takes nothing. A null source is a source. Repeated rows count as often as
    they stand there; which of equal rows is picked makes no difference to the result. A null doc_id
    hashes like the text 'null'. A source without words has target 0. No rows: no result rows.
    """
    slice_of = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)), F.lit(1 << 40))
    rows = sized.select("doc_id", "source", F.col("size").cast("long").alias("size"), slice_of.alias("draw"))
    rows = rows.withColumn("slice", F.floor(F.col("draw") / ((1 << 40) // SLICES)).cast("int"))
    counts = rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = shares(totals, weights, most_repeats)
    stock = _with(lengths.where("size > 0"), targets, ["source"], "inner")
    plan = stock.groupBy("source").applyInPandas(_plan_source, PICKS)
    # Slices before the last one are taken whole; in the last, the smallest draws.
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = _with(counts.withColumn("ahead", ahead), plan, ["source", "size"], "left")
    cut = cut.select("source", "size", "slice", "epochs", (F.col("picked") - F.col("ahead")).alias("room"))
    place = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id"))
    chosen = _with(rows.withColumn("place", place), cut, ["source", "size", "slice"], "left")
    repeats = F.coalesce(F.col("epochs") + F.when(F.col("place") <= F.col("room"), 1).otherwise(0), F.lit(0))
    out = _with(chosen.select("doc_id", "source", "size", (repeats * F.col("size")).alias("taken")), targets, ["source"], "left")
    return out.select("doc_id", *["source"] * keep_source, "size", "source_size", "target", "taken")


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join on keys that may be null."""
    other = right.withColumnsRenamed({k: f"{k}__" for k in keys})
    on: Column = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"{k}__"])
    return left.join(other, on, how).drop(*[f"{k}__" for k in keys])


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
