"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: principal directions of the unit vectors, turned by the rotation that brings them nearest to
the corners of a cube (alternating signs and an orthogonal fit), one bit a direction. A code is cut
into substrings, each with a table from its value to the rows. Two codes within a Hamming radius
agree in some substring within a part of that radius (the pigeonhole), so probing the values around
each substring of a query finds every code in the radius; those are ranked by the inner product of
the original vectors in double precision. Codes know directions only, so rows are split by norm into
ranges of a factor of sqrt(2), each with tables and a radius of its own: the one that holds `recall`
of the true neighbours within the sample of the range, whose neighbours are farther than those among
all its rows. A query visits the ranges from the largest norms down and leaves out those whose norms
are too small for its k best.

A range's sample has about `SAMPLE` rows at most, chosen by the hash of vec_id (fewer with more than
`FULL_RANGES` ranges); the rotation is fitted on as many of all samples. Every row is indexed:
rows are dealt by a hash of vec_id into shards of about `SHARD_ROWS`, each with its tables, so equal
vectors spread; the stated queries visit the shards in blocks of about `BLOCK_QUERIES`. A shard
returns its k best for each query, and these are merged. Queries that find fewer than k in the radius
are searched again with no limit to the radius, so nobody gets fewer than there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 8192
FULL_RANGES = 32
SHARD_ROWS = 65_536
BLOCK_QUERIES = 8_192
#: Shards at least, so that small tables use several tasks.
LEAST_SHARDS = 12
SUBSTRING = 8

_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    radii: dict[int, int]

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One unsigned 64-bit code a vector."""
        signs = (_unit(vectors) - self.mean) @ self.turn > 0
        return signs @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(sample: np.ndarray, ranges: np.ndarray, k: int, recall: float, rounds: int = 40) -> Coder:
    """Rotation, and a radius for each range of norms, from a sample of vectors (float64, one a row) and their ranges."""
    vectors, first = np.unique(sample, axis=0, return_index=True)
    ranges = ranges[first]
    unit = _unit(vectors[np.linspace(0, len(vectors) - 1, min(SAMPLE, len(vectors))).astype(int)])
    mean = unit.mean(axis=0)
    _, _, directions = np.linalg.svd(unit - mean, full_matrices=False)
    directions = directions[: min(64, vectors.shape[1])].T
    projected = (unit - mean) @ directions
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(directions.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (left @ right).T
    coder = Coder(mean, directions @ turn, {})
    codes = coder.codes(vectors)
    ask = np.linspace(0, len(vectors) - 1, min(256, len(vectors))).astype(int)
    for one in np.unique(ranges):
        rows = np.flatnonzero(ranges == one)
        if len(rows) <= k:
            coder.radii[int(one)] = coder.bits
            continue
        nearness = np.where(ask[:, None] == rows, -np.inf, vectors[ask] @ vectors[rows].T)
        near = rows[np.argpartition(-nearness, k - 1, axis=1)[:, :k]]
        distance = np.bitwise_count(codes[ask][:, None] ^ codes[near])
        coder.radii[int(one)] = int(np.quantile(distance, recall, method="higher"))
    return coder


class Tables:
    """The rows of a shard by the values of each substring of their codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.parts = codes, []
        for low in range(0, bits, SUBSTRING):
            width = min(SUBSTRING, bits - low)
            value = ((codes >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.parts.append((low, width, order, np.searchsorted(value[order], np.arange((1 << width) + 1))))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs from `code` in at most `radius` bits, found by probing."""
        each, over = divmod(min(radius, 64), len(self.parts))
        marked = np.zeros(len(self.codes), bool)
        for n, (low, width, order, begin) in enumerate(self.parts):
            part = each if n <= over else each - 1  # radius + 1 pigeons: the first `over` + 1 parts get one more
            if part < 0:
                continue
            own = int(code >> np.uint64(low)) & ((1 << width) - 1)
            for value in _BALLS[width][min(part, width)] ^ own:
                marked[order[begin[value] : begin[value + 1]]] = True
        rows = np.flatnonzero(marked)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _balls() -> dict[int, list[np.ndarray]]:
    """For each substring width and radius the values within that many bits of zero."""
    out = {}
    for width in range(1, SUBSTRING + 1):
        values = np.arange(1 << width)
        out[width] = [values[np.bitwise_count(values) <= r] for r in range(width + 1)]
    return out


_BALLS = _balls()


def search(base_ids: np.ndarray, base: np.ndarray, ranges: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, coder: Coder, k: int, limited: bool):
    """(query ids, vec ids, scores): for each query its k best rows, within the radius of their range if `limited`;
    ties to the smaller id."""
    codes, parts = coder.codes(base), []
    for one in np.unique(ranges)[::-1]:
        at = np.flatnonzero(ranges == one)
        radius = coder.radii.get(int(one), coder.bits) if limited else coder.bits
        parts.append((at, radius, Tables(codes[at], coder.bits) if radius < coder.bits else None, float(np.linalg.norm(base[at], axis=1).max())))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query_id, query, code in zip(query_ids, queries, coder.codes(queries)):
        rows, score, length = np.zeros(0, np.int64), np.zeros(0), float(np.linalg.norm(query))
        for at, radius, tables, norm in parts:
            if len(rows) == k and score[-1] > norm * length * (1 + 1e-9):
                break
            new = at[tables.within(code, radius)] if tables else at
            new = new[base_ids[new] != query_id]
            rows, score = np.concatenate((rows, new)), np.concatenate((score, (base[new] * query).sum(axis=1)))
            if len(rows) > 4 * k:  # all that tie with the k-th stay for the order below
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[keep], score[keep]
            order = np.lexsort((base_ids[rows], -score))[:k]
            rows, score = rows[order], score[order]
        out.append((np.full(len(rows), query_id), base_ids[rows], score))
    return [np.concatenate(x) for x in zip(*out)]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows by inner product, nearest first.

    `vectors` and `queries` have (vec_id, embedding). A query's own id is no candidate. Rows that take
    no part: null ids, null or zero vectors, vectors with null or non-finite components, and vectors
    whose length differs from the most frequent one (the smaller, if equally frequent). Rows with one
    id count once, with the smallest vector. Ties go to the smaller id. Without rows or queries: no result.
    """
    spark = vectors.sparkSession
    sizes = _usable(vectors).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    dim = sizes[0]["n"]
    base = _usable(vectors).where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("range", _norm_range(F.col("v")))
    asked = _usable(queries).where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = {row["range"]: row["count"] for row in base.groupBy("range").count().collect()}
    most = SAMPLE if len(counts) <= FULL_RANGES else max(1, FULL_RANGES * SAMPLE // len(counts))
    # the share of a range with the smallest remainders of its hashes; a range of few rows as a whole
    shares = F.create_map(*[F.lit(x) for one, n in counts.items() for x in (one, min(1.0, most / n))])
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < shares[F.col("range")] * (1 << 30)
    sample = base.where(chosen).toPandas().sort_values("vec_id")
    coder = fit(np.stack(sample["v"].to_numpy()).astype(np.float64), sample["range"].to_numpy(), k, recall)
    n_rows, n_queries = sum(counts.values()), asked.count()
    shards, blocks = max(LEAST_SHARDS, -(-n_rows // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))

    def visited(asked: DataFrame, limited: bool) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return empty
            ids, found, score = search(
                np.asarray(left["vec_id"].combine_chunks()), _matrix(left["v"], dim), np.asarray(left["range"].combine_chunks()), np.asarray(right["vec_id"].combine_chunks()), _matrix(right["v"], dim), coder, k, limited
            )
            return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
        zero = F.lit(0).cast("long")
        indexed = base.select("vec_id", "v", "range", shard.alias("shard"), F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))).alias("block"))
        asking = asked.select("vec_id", "v", F.explode(F.sequence(zero, F.lit(shards - 1).cast("long"))).alias("shard"), block.alias("block"))
        return indexed.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(run, _FOUND)

    first = stored(spark, visited(asked, True), "neighbours")
    enough = first.groupBy("query_id").count().where(F.col("count") >= min(k, n_rows - 1)).select(F.col("query_id").alias("vec_id"))
    lacking = stored(spark, asked.join(enough, "vec_id", "left_anti"), "lacking")
    found = first
    if not lacking.isEmpty():
        again = visited(lacking, False)
        found = first.join(lacking.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # shards * k rows a query
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _norm_range(v: Column) -> Column:
    """Norms from sqrt(2) ^ (n - 1/2) to sqrt(2) ^ (n + 1/2) are range n; no intermediate value overflows."""
    top = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(F.transform(v, lambda x: (x / top) * (x / top)), F.lit(0.0), lambda a, x: a + x)
    return F.floor(2 * F.log2(top) + F.log2(squares) + 0.5).cast("int")


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
