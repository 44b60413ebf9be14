"""Jaccard join of documents on word shingles by T-occurrence search.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more.
The result is every document's component of links.

1. *Shared shingles.* A linked document shares at least three quarters of its shingles with others.
   Each task sorts the shingle hashes of some megabytes of text, keeps one record a hash and packs the
   records by shard (a range of the hash); a shard counts in how many documents its hashes occur and
   tells the documents. A hash that is common everywhere sends one record a slice, so no shard is hot.
   Documents with less than three quarters shared are done; most are.
2. *Equal sets* are one vertex, represented by the smallest doc_id. Vertices count again what they share
   with each other, which bounds their overlap with any: most copies of a copy drop out as too different.
3. *Hubs.* Vertices with an equal min-hash are compared with one of them, the one that shares most of
   its shingles (in a group of near copies, the original): one comparison a vertex and min-hash. This
   joins large groups into components without looking at their pairs.
4. *T-occurrence search.* What hubs may have missed is found exactly: two linked documents have a
   common shingle among the first quarter (plus one) of their shingles in any fixed order; the order
   puts common shingles last. Lists of documents under such a shingle that stay within one component
   drop out by aggregation; the others form cells by their least component. In a cell, the
   inverted lists of a document's shingles are searched by DivideSkip: the longest lists are set
   aside, the short ones merged and counted, and documents that could still reach the required
   overlap are probed in the long ones by binary search. Only documents of different components
   meet. A cell above `BLOCK` documents is searched in pairs of blocks, so tasks stay bounded.
5. *Components* of all links.

Hashes have 64 bits, 48 in a set that is sent to be compared with another. Step 1 uses 32 bits inside a shard, where a chance match only keeps a document
for the exact steps. Texts that a filter of the documents kept by step 1 lets through cross the network once; the others never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, common_bits, may_be_among, stored
from .components import components
from .packed import by_shard, filter_place, home_of, runs, shard_of, unpack
from .words import Text, in_sequence, mixed, pieces

WORDS = 5
#: Similarity as a fraction of whole numbers.
TOP, BOTTOM = 75, 100
#: Bytes of text whose hashes are sorted together before they leave a task.
SLICE = 8 << 20
#: Documents in one search of step 4.
BLOCK = 1024
#: A shingle in so many documents or more is common: it comes last in the order of step 4.
COMMON = 32
MIN_HASHES = 4


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, ordered by both. A text with fewer words has them all as one shingle."""
    text = Text([t or b"" for t in texts], fold_case=True)
    begin, end = text.words()
    owner, words = text.owner(begin), text.hashes(begin, end)
    inside = owner[WORDS - 1 :] == owner[: len(owner) - WORDS + 1] if len(owner) >= WORDS else np.zeros(0, bool)
    found = [in_sequence(words, WORDS)[inside]] if len(owner) >= WORDS else []
    of = [owner[: len(inside)][inside]]
    counts = np.bincount(owner, minlength=len(text))
    first = np.cumsum(counts) - counts
    for n in range(1, WORDS):
        short = np.flatnonzero(counts == n)
        if len(short):
            found.append(mixed(in_sequence(words, n)[first[short]] + np.uint64(n)))
            of.append(short)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    return of[new], found[new]


def signatures(of: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums a text that are equal for equal sets."""
    out = np.zeros((2, n), np.uint64)
    np.add.at(out[0], of, mixed(found))
    np.add.at(out[1], of, mixed(found ^ np.uint64(0x5BF03635)))
    return out.view(np.int64)


_RECORDS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("shared", pa.int64()), ("common", pa.int64()), ("payload", pa.binary())])
_REPLIES = "doc_id long, n long, sig_a long, sig_b long, shared long, common long"


Read = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Read:
    for batch in batches:
        for row, texts in pieces(batch, "text"):
            yield np.asarray(batch.column("doc_id").slice(row, len(texts)), np.int64), *shingles(texts), sum(len(t or b"") for t in texts)


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Read:
    for batch in batches:
        sets = [unpacked(x.as_buffer()) for x in batch.column("shingles")]
        if sets:
            found = np.concatenate(sets)
            yield np.asarray(batch.column("id"), np.int64), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), found, 8 * len(found)


def sharing(docs: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Read] = _read_texts) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n, sig_a, sig_b and how many of its shingles stand in other rows;
    and rows (common) with places of the filter for common shingles."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def records(ids: list[np.ndarray], of: list[np.ndarray], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, found = np.concatenate(ids), np.concatenate(found)
        of = np.concatenate(of)
        n, (sig_a, sig_b) = np.bincount(of, minlength=len(ids)), signatures(of, found, len(ids))
        shard, key = shard_of(found, shards)
        order = np.lexsort((key, shard))
        shard, key, of = shard[order], key[order], of[order]
        begin, count = runs(key, shard)
        shared = np.bincount(of[np.repeat(count > 1, count)], minlength=len(ids))
        doc = np.where(count > 1, 0, ids[of[begin]] if len(begin) else 0)
        whole = len(ids)
        yield _batch(doc_id=ids, n=n, sig_a=sig_a, sig_b=sig_b, shared=shared, shard=(np.arange(whole) % shards).astype(np.int32))
        full, payload = by_shard(shard[begin], key[begin], doc, count, shards)
        yield _batch(shard=full, payload=payload)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of, found, held, n = [], [], [], 0, 0
        for doc_ids, a, b, size in read(batches):
            ids.append(doc_ids)
            of.append(a + n)
            found.append(b)
            n, held = n + len(doc_ids), held + size
            if held >= SLICE:
                yield from records(ids, of, found)
                ids, of, found, held, n = [], [], [], 0, 0
        if ids:
            yield from records(ids, of, found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            docs_only = batch.filter(pc.is_null(batch.column("payload")))
            if docs_only.num_rows:
                home = home_of(np.asarray(docs_only.column("doc_id"), np.int64), shards)
                yield docs_only.set_column(0, "shard", pa.array(home))
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                if payload.is_valid:
                    parts.setdefault(shard, []).append(unpack(payload.as_py()))
        for shard, got in parts.items():
            key, doc, count = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(key, kind="stable")
            key, doc, count = key[order], doc[order], count[order].astype(np.int64)
            begin, slices = runs(key)
            total = np.add.reduceat(count, begin)
            told, times = np.unique(doc[np.repeat(slices > 1, slices) & (count == 1)], return_counts=True)
            home = home_of(told, shards)
            order = np.argsort(home, kind="stable")
            full, replies = by_shard(home[order], np.zeros(len(told), np.uint32), told[order], times[order], shards)
            yield _batch(shard=full, payload=replies)
            places = np.unique(filter_place(key[begin[total >= COMMON]].astype(np.uint64) | (np.uint64(shard) << np.uint64(32))))
            yield _batch(common=places, shard=(places % shards).astype(np.int32))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, told, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            plain = pc.is_null(batch.column("payload"))
            rows.append(batch.filter(plain).drop_columns(["shard", "payload"]))
            for payload in batch.filter(pc.invert(plain)).column("payload"):
                _, docs, counts = unpack(payload.as_py())
                told.append(docs)
                times.append(counts.astype(np.int64))
        told, at = np.unique(np.concatenate(told), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(times), minlength=len(told)).astype(np.int64)
        for batch in rows:
            ids = np.asarray(batch.column("doc_id").fill_null(-1), np.int64)
            place = np.minimum(np.searchsorted(told, ids), max(len(told) - 1, 0))
            more = np.where(told[place] == ids, sums[place], 0) if len(told) else np.zeros(len(ids), np.int64)
            yield batch.set_column(4, "shared", pc.add(batch.column("shared"), pa.array(more)))

    schema = ", ".join(f"{f.name} {'int' if f.name == 'shard' else 'binary' if f.name == 'payload' else 'long'}" for f in _RECORDS)
    counted = docs.mapInArrow(scan, schema).repartitionById(shards, F.col("shard")).mapInArrow(meet, schema)
    return counted.repartitionById(shards, F.col("shard")).mapInArrow(total, _REPLIES)


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _RECORDS], schema=_RECORDS)


def _required(n: int) -> int:
    """The overlap that a set of n shingles needs at least with a set it links to."""
    return -(-n * TOP // BOTTOM)


def linked(common: int, a: int, b: int) -> bool:
    return common > 0 and BOTTOM * common >= TOP * (a + b - common)


def packed(hashes: np.ndarray) -> bytes:
    """A set as its rising 48-bit hashes; sets are compared in pairs, where these tell shingles apart."""
    return np.sort(hashes & _LOW).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


_LOW = np.uint64((1 << 48) - 1)


def _sets(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, n, shingles) of the documents in `kept` (id, sig_a, sig_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want_a, want_b, ids = (np.asarray(batch.column(c), np.int64) for c in ("sig_a", "sig_b", "id"))
            for row, texts in pieces(batch, "text"):
                of, found = shingles(texts)
                begin = np.searchsorted(of, np.arange(len(texts) + 1))
                sig_a, sig_b = signatures(of, found, len(texts))
                # another text under the same doc_id is passed over
                fine = np.flatnonzero((sig_a == want_a[row : row + len(texts)]) & (sig_b == want_b[row : row + len(texts)]))
                sizes = np.diff(begin)[fine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + fine]), pa.array(sizes.astype(np.int64)), pa.array([packed(found[begin[i] : begin[i + 1]]) for i in fine], pa.binary())],
                    names=["id", "n", "shingles"],
                )

    # Whether the list is small enough for a broadcast or not, texts that it does not name stay where they are.
    rows = may_be_among(docs.select(F.col("doc_id").alias("id"), "text"), "id", kept).join(kept.select("id", "sig_a", "sig_b"), "id")
    return rows.mapInArrow(run, "id long, n long, shingles binary")


def _keys(sets: DataFrame, common: np.ndarray, shards: int) -> DataFrame:
    """(id, n, shared, most, first, mins): the shingles in the first part of the order, and the min-hashes. `most` is the
    greatest size of a set that may link: the overlap of two sets is at least 3/7 of their sizes, at most `shared`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(common, bitorder="little")
        for batch in batches:
            first, mins = [], []
            for data in batch.column("shingles"):
                mine = unpacked(data.as_buffer())
                shard, key = shard_of(mine, shards)
                last = bits[filter_place(key.astype(np.uint64) | (shard.astype(np.uint64) << np.uint64(32)))]
                first.append(mine[np.lexsort((mixed(mine), last))][: len(mine) - _required(len(mine)) + 1].view(np.int64).tolist())
                mins.append([int(mixed(mine ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min().astype(np.int64)) for k in range(1, MIN_HASHES + 1)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "shared", "most")), pa.array(first, longs), pa.array(mins, longs)], names=["id", "n", "shared", "most", "first", "mins"])

    most = F.floor(F.col("shared") * (TOP + BOTTOM) / TOP - F.col("n") + F.lit(1e-9))
    live = sets.withColumn("most", most).where(BOTTOM * F.col("shared") >= TOP * F.col("n"))
    return live.select("id", "n", "shared", "most", "shingles").mapInArrow(run, "id long, n long, shared long, most long, first array<long>, mins array<long>")


def _hub_links(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links between vertices and the hubs of their min-hashes."""
    keyed = keys.select("id", "n", "most", "shared", F.posexplode("mins").alias("k", "least"))
    rank = F.struct((F.col("shared") / F.col("n")).alias("share"), (-F.col("id")).alias("minus"), "n", "most")
    hubs = keyed.groupBy("k", "least").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = hubs.select("k", "least", (-F.col("best.minus")).alias("hub"), F.col("best.n").alias("hub_n"), F.col("best.most").alias("hub_most"))
    pairs = keyed.join(hubs, ["k", "least"]).where("id <> hub AND n <= hub_most AND hub_n <= most").select("id", "hub").distinct()
    with_set = sets.join(pairs, "id")
    close = with_set.join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(batch.column("id").to_pylist(), batch.column("hub").to_pylist(), batch.column("shingles"), batch.column("hub_shingles")):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return close.select("id", "hub", "shingles", "hub_shingles").mapInArrow(compare, "u long, v long")


def divide_skip(sets: list[np.ndarray], groups: np.ndarray, most: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join sets of different groups, enough of them to connect all groups that any link connects.

    `sets` are sorted distinct hashes, `most` the greatest size of a set that each may link with. With
    `sides`, only sets of different sides are compared. The
    search asks each set, from small to large, for the smaller sets that share at least as many
    shingles as it needs.
    """
    by_size = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in by_size])
    values = np.concatenate([sets[i] for i in by_size])
    order = np.argsort(values, kind="stable")
    lists, ranks = values[order], np.repeat(np.arange(len(sets)), sizes)[order]  # inverted lists, members rising
    limit, label = np.asarray(most)[by_size], np.unique(groups, return_inverse=True)[1]
    out = []
    for rank, i in enumerate(by_size):
        mine = sets[i]
        low, need = np.searchsorted(sizes, _required(len(mine))), _required(len(mine))
        fit = np.flatnonzero(limit[low:rank] >= len(mine)) + low
        fit = fit[(sizes[fit] <= most[i]) & (label[by_size[fit]] != label[i])]
        if sides is not None:
            fit = fit[sides[by_size[fit]] != sides[i]]
        if not len(fit):
            continue
        begin, end = np.searchsorted(lists, mine), np.searchsorted(lists, mine, "right")
        length = end - begin
        n_long = int(min(need - 1, need / (0.01 * np.log(max(length.max(), 2)) + 1)))
        by_length = np.argsort(length)
        short, long = by_length[: len(mine) - n_long], by_length[len(mine) - n_long :]
        merged = np.concatenate([ranks[begin[k] : end[k]] for k in short])
        counts = np.bincount(merged, minlength=len(sets))
        fit = fit[counts[fit] >= need - n_long]
        common = counts[fit]
        for done, k in enumerate(long[::-1]):  # longest first
            if not len(fit):
                break
            members = ranks[begin[k] : end[k]]
            at = np.minimum(np.searchsorted(members, fit), max(len(members) - 1, 0))
            common = common + (members[at] == fit) if len(members) else common
            able = common + (n_long - 1 - done) >= need
            fit, common = fit[able], common[able]
        for other, overlap in zip(fit.tolist(), common.tolist()):
            j = by_size[other]
            if label[i] != label[j] and linked(overlap, len(mine), int(sizes[other])):
                out.append((int(i), int(j)))
                label[label == label[i]] = label[j]
    return out


def _search(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): the links between vertices of different components that step 4 finds; `keys` has `component`."""
    posted = keys.select("id", "component", "n", "most", F.explode("first").alias("shingle"))
    several = posted.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least_n"), F.max("most").alias("greatest"))
    # A set can link in a cell only with one that is small enough for it and for which it is small enough.
    met = posted.join(several.where("low < high").select("shingle", "least_n", "greatest"), "shingle").where("least_n <= most AND n <= greatest")
    met = stored(keys.sparkSession, met.select("shingle", "id", "component", "most"), "met")  # few of the posted rows, read twice
    lists = met.groupBy("shingle").agg(F.min("component").alias("cell"), F.max("component").alias("high"))
    # Lists with the same least component are one cell, so that two sets seldom meet twice.
    members = met.join(lists.where("cell < high").select("shingle", "cell"), "shingle").select("cell", "id", "component", "most").distinct()
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = members.join(sizes, "cell")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("cell", "id", "component", "most", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    filled = members.join(sets.select("id", "shingles"), "id")

    def run(cell: pa.Table) -> pa.Table:
        found_sets = [unpacked(x.as_buffer()) for x in cell["shingles"]]
        ids, group, block, most = (np.asarray(cell[c].combine_chunks()) for c in ("id", "component", "block", "most"))
        sides = block if cell["a"][0].as_py() != cell["b"][0].as_py() else None
        found = divide_skip(found_sets, group, most, sides)
        return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.int64()), "v": pa.array([ids[j] for _, j in found], pa.int64())})

    return filled.groupBy("cell", "a", "b").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every doc_id of `docs` (doc_id, text).

    A null or wordless text has no shingles and links with nothing, as does a text unlike all others:
    its component is its own id. Rows that repeat a doc_id are one document: with equal texts one set,
    with different texts the largest set counts and the links of all. Rows without a doc_id have no
    place in a component and are left out. No rows: no result.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = sharing(rows).where("n IS NOT NULL").groupBy("doc_id", "sig_a", "sig_b").agg(F.max("n").alias("n"), F.max("shared").alias("shared"))
    texts = stored(spark, told, "sharing")
    kept = texts.where("n > 0").where(BOTTOM * F.col("shared") >= TOP * F.col("n"))
    kept = stored(spark, kept.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("id")), "kept")
    sets = bucketed(spark, _sets(rows, kept), "id", shards, "sets")  # every later join on id leaves them in place
    # Equal texts are one vertex now: what each shares with other vertices is less than what it shared with rows.
    told = stored(spark, sharing(sets.select("id", "shingles"), _read_sets), "sharing")
    shared = told.where("n IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("shared").alias("shared"))
    keys = stored(spark, _keys(sets.join(shared, "id"), common_bits(told), shards), "keys")
    hubs = stored(spark, _hub_links(keys, sets), "hubs")
    near = components(hubs)
    grouped = keys.join(near.select(F.col("v").alias("id"), "m"), "id", "left").withColumn("component", F.coalesce("m", "id"))
    more = _search(grouped, sets)
    # Texts under one doc_id belong together.
    named = texts.where("n > 0").join(kept.select("sig_a", "sig_b", "id"), ["sig_a", "sig_b"], "left").select("doc_id", "n", F.coalesce("id", "doc_id").alias("id"))
    several = named.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u < v").select("u", "v")
    whole = components(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(more).unionByName(several))
    out = texts.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    least = named.groupBy("doc_id").agg(F.min("id").alias("id")).join(whole.select(F.col("v").alias("id"), "m"), "id", "left")
    least = least.select("doc_id", F.coalesce("m", "id").alias("component_id"))
    return out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
