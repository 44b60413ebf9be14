"""Exact removal of repeated passages by suffix sorting.

A byte goes if it lies in a string of `LENGTH` bytes that also starts earlier: in a smaller doc_id, or
in the same document at an earlier byte. Sorting all suffixes of a corpus would move every byte a
hundred times, so the corpus is first cut down to what can repeat.

1. *Anchors.* Every window of LENGTH bytes has an anchor, the K-gram in it with the smallest hash.
   Equal windows have equal anchors at equal places. Anchors are some three in a hundred bytes; their
   hashes are packed by shard, and documents are told which of their anchors occur twice or more.
   Documents without one, and copies of whole documents (which go entirely), are done.
2. *Contexts.* The windows with one anchor are neighbours; the bytes they cover are its context.
   Equal contexts, known by their hashes, are combined inside a task and then over all: all but the
   first go without further ado. Only where an anchor has different contexts, their bytes are needed.
   The texts that may lose something lie in a table bucketed by doc_id, so they cross the network once.
3. *Suffix sorting* of the contexts that meet under an anchor: of the suffixes at window starts, those smaller than
   their successor are sorted directly, to LENGTH bytes; the others follow from one scan over the
   buckets of first bytes, each from the place of its successor. Neighbours in the order with a common
   prefix of LENGTH bytes are equal windows; all but the first window go.
4. An anchor with very many occurrences could bring many different contexts together (the rims of a
   passage that a third of all documents share). Its windows go one by one instead: combined in the
   task, then by hash over all tasks, and only the first stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, common_bits, stored
from .packed import by_shard, filter_place, home_of, runs, shard_of, unpack
from .words import Text, mixed, pieces

LENGTH = 100
K = 48
SLICE = 8 << 20
#: Occurrences from which an anchor's windows are compared one by one (step 4). Below, the contexts of an anchor,
#: under 200 bytes each, take at most some ten megabytes of one task.
COMMON = 1 << 16
#: Bytes of contexts sorted together.
TOGETHER = 2 << 20

_SEPARATOR = 0xFF  # in no UTF-8 text


class Anchors:
    """The anchors of a piece of texts: owner, first and last window start in the text, hash, and the piece."""

    def __init__(self, texts: list[bytes | None]):
        self.text = text = Text([t or b"" for t in texts])
        data = text.data
        n = len(data)
        if n < LENGTH:
            self.owner = self.first = self.last = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        at = np.arange(n - K + 1)
        grams = text.hashes(at, at + K)
        least = (grams & ~np.uint64((1 << 28) - 1)) | at.astype(np.uint64)
        width = 1
        span = LENGTH - K + 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & np.uint64((1 << 28) - 1)).astype(np.int64)  # of the window at each start
        ends = np.minimum(text.end - LENGTH + 1, len(anchor))
        fine = np.zeros(len(anchor) + 1, np.int32)  # windows inside one text
        whole = ends > text.begin
        fine[text.begin[whole]] += 1
        np.add.at(fine, ends[whole], -1)
        starts = np.flatnonzero(np.cumsum(fine)[:-1])
        begin, size = runs(anchor[starts], text.owner(starts))
        self.owner = text.owner(starts[begin])
        offset = text.begin[self.owner]
        self.first, self.last = starts[begin] - offset, starts[begin] + size - 1 - offset
        self.hash = grams[anchor[starts[begin]]]
        self.place = anchor[starts[begin]] - starts[begin]

    def span(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each context in the piece."""
        offset = self.text.begin[self.owner]
        return self.first + offset, self.last + offset + LENGTH


_RECORDS = pa.schema([("shard", pa.int32()), ("origin", pa.int32()), ("doc_id", pa.int64()), ("keys", pa.binary()), ("common", pa.int64()), ("payload", pa.binary())])


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _by_doc(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each document with the distinct keys that stand beside it."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    begin, _ = runs(key, doc)
    doc, key = doc[begin], key[begin]
    begin, size = runs(doc)
    return doc[begin], [key[a : a + n].tobytes() for a, n in zip(begin, size)]


def _repeating(docs: DataFrame, shards: int) -> DataFrame:
    """Rows (doc_id, keys) with anchors that occur twice or more, and rows (common) with places of the filter."""

    def records(ids: np.ndarray, of: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard, key = shard_of(found, shards)
        order = np.lexsort((key, shard))
        shard, key, of = shard[order], key[order], of[order]
        begin, count = runs(key, shard)
        several = np.repeat(count > 1, count)
        told, keys = _by_doc(ids[of[several]], key[several].astype(np.uint64) | (shard[several].astype(np.uint64) << np.uint64(32)))
        yield _batch(_RECORDS, doc_id=told, keys=keys, shard=home_of(told, shards))
        full, payload = by_shard(shard[begin], key[begin], np.where(count > 1, 0, ids[of[begin]]), count, shards)
        yield _batch(_RECORDS, shard=full, payload=payload)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, parts in _slices(batches):
            of = np.concatenate([a.owner + n for n, a in parts])
            if len(of):
                yield from records(ids, of, np.concatenate([a.hash for _, a in parts]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            told = batch.filter(pc.is_null(batch.column("payload")))
            if told.num_rows:
                yield told
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                if payload.is_valid:
                    got.setdefault(shard, []).append(unpack(payload.as_py()))
        for shard, found in got.items():
            key, doc, count = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key, kind="stable")
            key, doc, count = key[order], doc[order], count[order].astype(np.int64)
            begin, slices = runs(key)
            key64 = key.astype(np.uint64) | (np.uint64(shard) << np.uint64(32))
            tell = np.repeat(slices > 1, slices) & (count == 1)
            doc, key_ = doc[tell], key[tell]
            home = home_of(doc, shards)
            order = np.argsort(home, kind="stable")  # keys stay in order
            full, replies = by_shard(home[order], key_[order], doc[order], np.ones(len(doc), np.int64), shards)
            yield _batch(_RECORDS, shard=full, origin=np.full(len(full), shard, np.int32), payload=replies)
            often = begin[np.add.reduceat(count, begin) >= COMMON]
            places = np.unique(filter_place(key64[often]))
            yield _batch(_RECORDS, common=places, shard=(places % shards).astype(np.int32))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            plain = batch.filter(pc.is_valid(batch.column("common")))
            yield plain.drop_columns(["shard", "origin", "payload"])
            for doc_id, keys, origin, payload in zip(*(batch.column(c) for c in ("doc_id", "keys", "origin", "payload"))):
                if keys.is_valid:
                    key.append(np.frombuffer(keys.as_buffer(), np.uint64))
                    doc.append(np.full(len(key[-1]), doc_id.as_py()))
                elif payload.is_valid:
                    found, docs, _ = unpack(payload.as_py())
                    key.append(found.astype(np.uint64) | (np.uint64(origin.as_py()) << np.uint64(32)))
                    doc.append(docs)
        told, keys = _by_doc(np.concatenate(doc), np.concatenate(key))
        yield _batch(_RECORDS, doc_id=told, keys=keys).drop_columns(["shard", "origin", "payload"])

    kinds = "shard int, origin int, doc_id long, keys binary, common long, payload binary"
    met = docs.mapInArrow(scan, kinds).repartitionById(shards, F.col("shard")).mapInArrow(meet, kinds)
    return met.repartitionById(shards, F.col("shard")).mapInArrow(gather, "doc_id long, keys binary, common long")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[int, Anchors]]]]:
    """Runs of about SLICE bytes: their doc_ids, and anchors piece by piece with the number of texts before."""
    ids, parts, held, n = [], [], 0, 0
    for batch in batches:
        for row, texts in pieces(batch, "text"):
            ids.append(np.asarray(batch.column("doc_id").slice(row, len(texts)), np.int64))
            found = Anchors(texts)
            parts.append((n, found))
            n, held = n + len(texts), held + len(found.text.data)
            found.text = None  # only owners and hashes are needed
            if held >= SLICE:
                yield np.concatenate(ids), parts
                ids, parts, held, n = [], [], 0, 0
    if ids:
        yield np.concatenate(ids), parts


_OCCURRENCES = pa.schema(
    [("anchor", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("window_a", pa.int64()), ("window_b", pa.int64())]
)


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of window starts, those that touch made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)
    begin = np.flatnonzero(new)
    return dict(doc_id=doc[begin], first=first[begin], last=np.maximum.reduceat(last, begin) if len(begin) else last)


def _occurrences(candidates: DataFrame, common: np.ndarray, shards: int) -> DataFrame:
    """Of `candidates` (doc_id, text, keys): rows (doc_id, first, last) with window starts that are known to repeat
    earlier ones, rows with the first occurrence of each context in the task, and rows with single windows."""

    def gather(batch: pa.RecordBatch, row: int, texts: list[bytes | None], bits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(anchor, context, doc, first, last) of contexts, and (hash, second hash, doc, start) of single windows."""
        anchors = Anchors(texts)
        ids = np.asarray(batch.column("doc_id").slice(row, len(texts)), np.int64)
        shard, key = shard_of(anchors.hash, shards)
        key64 = key.astype(np.uint64) | (shard.astype(np.uint64) << np.uint64(32))
        edges = np.searchsorted(anchors.owner, np.arange(len(texts) + 1))
        told = np.zeros(len(key64), bool)
        for i, keys in enumerate(batch.column("keys").slice(row, len(texts))):
            mine = np.frombuffer(keys.as_buffer(), np.uint64)
            told[edges[i] : edges[i + 1]] = np.isin(key64[edges[i] : edges[i + 1]], mine)
        if not told.any():
            return [], []
        often = told & bits[filter_place(key64)].astype(bool)
        begin, end = anchors.span()
        doc, text = ids[anchors.owner], anchors.text
        at = np.flatnonzero(told & ~often)
        context = mixed(text.hashes(begin[at], end[at]) + mixed(anchors.hash[at] ^ (anchors.place[at] << 20 | (end - begin)[at]).astype(np.uint64)))
        contexts = [anchors.hash[at].view(np.int64), context.view(np.int64), doc[at], anchors.first[at], anchors.last[at]]
        at = np.flatnonzero(often)
        size = anchors.last[at] - anchors.first[at] + 1
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = np.repeat(begin[at], size) + step
        second = mixed(text.hashes(start, start + LENGTH // 2) ^ np.uint64(0x1234567))
        windows = [text.hashes(start, start + LENGTH).view(np.int64), second.view(np.int64), np.repeat(doc[at], size), np.repeat(anchors.first[at], size) + step]
        return contexts, windows

    def combine(contexts: list, windows: list) -> Iterator[pa.RecordBatch]:
        """The first of equal contexts and windows go on, the windows of the others are known to repeat."""
        if contexts:
            anchor, context, doc, first, last = (np.concatenate(x) for x in zip(*contexts))
            order = np.lexsort((first, doc, context, anchor))
            anchor, context, doc, first, last = (x[order] for x in (anchor, context, doc, first, last))
            head, size = runs(context, anchor)
            yield _batch(_OCCURRENCES, anchor=anchor[head], context=context[head], doc_id=doc[head], first=first[head], last=last[head])
            lead = np.repeat(head, size)
            again = (doc != doc[lead]) | (first != first[lead])  # a repeated row is the same document
            yield _batch(_OCCURRENCES, **_joined(doc[again], first[again], last[again]))
        if windows:
            a, b, doc, first = (np.concatenate(x) for x in zip(*windows))
            order = np.lexsort((first, doc, b, a))
            a, b, doc, first = (x[order] for x in (a, b, doc, first))
            head, size = runs(a, b)
            yield _batch(_OCCURRENCES, window_a=a[head], window_b=b[head], doc_id=doc[head], first=first[head], last=first[head])
            lead = np.repeat(head, size)
            again = (doc != doc[lead]) | (first != first[lead])
            yield _batch(_OCCURRENCES, **_joined(doc[again], first[again], first[again]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(common, bitorder="little")
        contexts, windows, held = [], [], 0
        for batch in batches:
            for row, texts in pieces(batch, "text"):
                more, single = gather(batch, row, texts, bits)
                contexts += [more] if len(more) else []
                windows += [single] if len(single) and len(single[0]) else []
                held += sum(len(t or b"") for t in texts) + 32 * sum(len(w[0]) for w in windows[-1:])
                if held >= SLICE:
                    yield from combine(contexts, windows)
                    contexts, windows, held = [], [], 0
        yield from combine(contexts, windows)

    schema = ", ".join(f"{f.name} long" for f in _OCCURRENCES)
    return candidates.mapInArrow(run, schema)


def _sort_directly(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in the order of the LENGTH bytes from them; `data` has LENGTH bytes and more after each."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)

    def word(positions: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[positions]).view(">u8").ravel().astype(np.uint64)

    order = at[np.argsort(word(at), kind="stable")]
    begin, size = runs(word(order))
    group = np.repeat(begin, size)  # where each position's run of equals begins
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    for depth in range(8, LENGTH, 8):
        if not len(open_):
            break
        key, of = word(order[open_] + depth), group[open_]
        if LENGTH - depth < 8:
            key >>= np.uint64(8 * (8 - (LENGTH - depth)))
        by = np.lexsort((key, of))
        order[open_], key = order[open_[by]], key[by]  # runs stay in place, so `of` stays as it is
        begin, size = runs(key, of)
        group[open_] = np.repeat(open_[begin], size)
        open_ = open_[np.repeat(size > 1, size)]
    return order


def two_stage(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted positions (a flag a byte), and some after them, in the order of their suffixes to LENGTH bytes.

    A suffix smaller than its successor is sorted directly. Any other begins with a byte at least as
    great as its successor's: when the buckets of first bytes are scanned upwards, the successors in a
    bucket come in order and give the order of what stands before them.
    """
    edge, size = runs(data)
    following = np.append(data[edge[1:]], 0)
    rises = np.repeat(following > data[edge], size)  # smaller than the successor
    # A suffix that follows from its successor needs that one too, up to the next direct one.
    need = wanted.copy()
    chain = np.flatnonzero(need & ~rises) + 1
    while len(chain):
        chain = chain[~need[chain]]
        need[chain] = True
        chain = chain[~rises[chain]] + 1
    direct = _sort_directly(data, np.flatnonzero(need & rises))
    heads = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in np.flatnonzero(np.bincount(data[need], minlength=256)):
        induced = waiting[byte]
        last = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        while len(last):  # runs of the byte itself
            before = last[last > 0] - 1
            last = before[need[before] & ~rises[before] & (data[before] == byte)]
            induced.append(last)
        bucket = np.concatenate([*induced, direct[heads[byte] : heads[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[need[before] & ~rises[before] & (data[before] > byte)]
        order = np.argsort(data[before], kind="stable")
        before = before[order]
        begin, size = runs(data[before])
        for a, n in zip(begin, size):
            waiting[data[before[a]]].append(before[a : a + n])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position but the first the bytes it has in common with the one before it in the order, LENGTH at most."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    live = np.arange(len(out))
    for depth in range(LENGTH):
        live = live[data[order[live] + depth] == data[order[live + 1] + depth]]
        out[live] = depth + 1
    return out


def _repeated(contexts: list[bytes], doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """Of the windows of some contexts, those that equal an earlier one, as runs of window starts."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer((bytes([_SEPARATOR])).join(contexts) + bytes([_SEPARATOR]) * (LENGTH + 8), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = last - first + 1
    starts = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    owner, place = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
    owner[starts] = np.repeat(doc, n)
    place[starts] = starts - np.repeat(begin, n) + np.repeat(first, n)
    order = two_stage(data, wanted)
    order = order[wanted[order]]
    same = common_prefixes(data, order) >= LENGTH
    group = np.concatenate(([0], np.cumsum(~same)))
    by = np.lexsort((place[order], owner[order], group))
    order, group = order[by], group[by]
    head, size = runs(group)
    lead = np.repeat(order[head], size)
    again = order[(owner[order] != owner[lead]) | (place[order] != place[lead])]
    return _joined(owner[again], place[again], place[again])


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor in portions of about `most` bytes, no anchor cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        anchor = np.asarray(batch.column("anchor"))
        if sum(b.nbytes for b in held) >= most and len(anchor) and anchor[0] != anchor[-1]:
            cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1  # the last anchor may go on
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    return {c: np.asarray(rows[c].combine_chunks()) for c in ("anchor", "context", "doc_id", "first", "last")}


def _first_contexts(occurrences: DataFrame, shards: int) -> DataFrame:
    """Rows (doc_id, first, last) with the windows of contexts that stand earlier, and rows with all columns: the first
    occurrence of each context whose anchor has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, TOGETHER):
            cols = _columns(rows)
            begin, size = runs(cols["context"], cols["anchor"])
            head = np.repeat(begin, size)
            rest = np.flatnonzero((cols["doc_id"] != cols["doc_id"][head]) | (cols["first"] != cols["first"][head]))
            yield _batch(_CONTEXTS, **_joined(cols["doc_id"][rest], cols["first"][rest], cols["last"][rest]))
            _, many = runs(cols["anchor"][begin])
            open_ = begin[np.repeat(many > 1, many)]
            yield _batch(_CONTEXTS, **{c: v[open_] for c, v in cols.items()})

    seldom = occurrences.where("anchor IS NOT NULL").select("anchor", "context", "doc_id", "first", "last")
    met = seldom.repartition(shards, "anchor").sortWithinPartitions("anchor", "context", "doc_id", "first")
    return met.mapInArrow(run, "anchor long, context long, doc_id long, first long, last long")


def _resolved(contexts: DataFrame, candidates: DataFrame, shards: int) -> DataFrame:
    """(doc_id, first, last): window starts that repeat earlier ones, among different contexts with one anchor."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
                data = text.as_py().encode()
                cols = {c: pa.array([w[c] for w in wanted], pa.int64()) for c in ("anchor", "context", "first", "last")}
                cut = pa.array([data[w["first"] : w["last"] + LENGTH] for w in wanted], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([doc_id] * len(wanted), pa.int64()), cut], names=[*cols, "doc_id", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, TOGETHER):
            cols = _columns(rows)
            yield _batch(_FLAGS, **_repeated(rows["bytes"].to_pylist(), cols["doc_id"], cols["first"], cols["last"]))

    wanted = contexts.where("anchor IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "context", "first", "last")).alias("wanted"))
    cut = candidates.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(read, "anchor long, context long, first long, last long, doc_id long, bytes binary")
    met = cut.repartition(shards, "anchor").sortWithinPartitions("anchor", "context", "doc_id", "first")
    return met.mapInArrow(sort, "doc_id long, first long, last long")


_CONTEXTS = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_FLAGS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _windows(occurrences: DataFrame) -> DataFrame:
    """(doc_id, first, last) of single windows that equal an earlier one."""
    windows = occurrences.where("window_a IS NOT NULL").select("window_a", "window_b", "doc_id", "first")
    heads = windows.groupBy("window_a", "window_b").agg(F.min(F.struct("doc_id", "first")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = windows.join(heads, ["window_a", "window_b"]).where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("first") != F.col("head.first")))
    return again.select("doc_id", "first", F.col("first").alias("last"))


def _cut(data: bytes, spans: list) -> tuple[int, int, bytes]:
    """(bytes removed, removed runs, what stays) when windows starting in the spans go."""
    edges = sorted((s["first"], s["last"] + LENGTH) for s in spans)
    merged: list[list[int]] = []
    for a, b in edges:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return sum(b - a for a, b in merged), len(merged), b"".join(kept)


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every doc_id of `docs` (doc_id, text); if `with_text`
    also `kept`, the text that stays without the rests of characters cut in two (null where nothing goes), and
    `sha256` of the whole text.

    A null text is empty; texts under LENGTH bytes lose nothing. Rows that repeat a doc_id with an
    equal text are one document; of different texts under one doc_id the one with the smallest sha256
    is the document. Rows without a doc_id have no place in the order and are left out. No rows: no result.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    each = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    one = each.groupBy("doc_id").agg(F.min(F.struct("sha", "n_bytes")).alias("s")).select("doc_id", "s.*")
    one = stored(spark, one, "digests")
    originals = one.groupBy("sha").agg(F.min("doc_id").alias("original"))
    told = stored(spark, _repeating(rows.where(F.octet_length("text") >= LENGTH), shards), "anchors")
    keys = told.where("keys IS NOT NULL").select("doc_id", "keys")
    wanted = one.join(originals, "sha").where("doc_id = original").select("doc_id", "sha").join(keys, "doc_id")
    # Digests are equal if one begins with the other. As an equality this would be a second key of the join, which would then
    # deal the texts by both keys; dealt by doc_id alone they stand as the buckets want them, and are not dealt again.
    candidates = rows.join(wanted, "doc_id").where(F.col("sha").startswith(F.sha2("text", 256))).select("doc_id", "text", "keys")
    candidates = bucketed(spark, candidates.repartition(shards, "doc_id"), "doc_id", shards, "candidates")
    occurrences = stored(spark, _occurrences(candidates, common_bits(told), shards), "occurrences")
    known = occurrences.where("anchor IS NULL AND window_a IS NULL").select("doc_id", "first", "last")
    contexts = stored(spark, _first_contexts(occurrences, shards), "contexts")
    known = known.unionByName(contexts.where("anchor IS NULL").select("doc_id", "first", "last"))
    flags = known.unionByName(_resolved(contexts, candidates, shards)).unionByName(_windows(occurrences))
    spans = flags.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # no more than its bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in pieces(batch, "text", 1 << 22):
                part = batch.slice(row, len(texts))
                got = [_cut(t or b"", s) for t, s in zip(texts, part.column("spans").to_pylist())]
                arrays = [part.column("doc_id"), *(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got])]
                names = ["doc_id", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array([g[2].decode("utf-8", "ignore") for g in got], pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    results = candidates.select("doc_id", "text").join(spans, "doc_id").mapInArrow(cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
    results = results.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "of")
    whole = one.join(originals, "sha")
    out = whole.join(results, whole["doc_id"] == results["of"], "left")
    copy = (F.col("doc_id") != F.col("original")) & (F.col("n_bytes") >= LENGTH)
    picked = [
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        picked += [F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"), F.col("sha").alias("sha256")]
    return out.select(*picked)
