"""Phrases that stand together more often than their parts, mined with counting quotient filters.

Texts are cut into pieces and words; a phrase is a run of words inside a piece. Only phrases whose
parts are frequent can be frequent, so lengths are counted one after the other:

1. A task turns each slice of texts into a stream of word numbers and counts its words. Shards of the
   words, ranges of a hash, add up the counts; frequent words become ids, and each slice learns those
   of its words.
2. For every length, a slice packs each run whose first n - 1 words and last n - 1 words are frequent
   into one number, (id of the first n - 1 words, id of the last word), and counts these numbers in
   counting quotient filters (`quotient`), one a shard of the permuted numbers.
3. A shard merges the filters of all slices. Frequent numbers become ids of that length, and each
   slice gets back those that it has, to find longer runs with. Filters are lossless: all counts are exact.

A word or phrase that is everywhere is one entry a slice. Shards are as many as the words need, so
none grows with the corpus. No dictionary is broadcast; slices meet their ids in joins by slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, bucketed, stored
from .quotient import Filter, permuted, restored
from .words import LOWER, Text, mixed, pieces

#: Bytes of texts in a slice, and words in a shard.
SLICE, SHARD = 8 << 20, 1 << 24
LONGEST = 5
UNKNOWN = "und"

_GAP, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte by byte of all of them."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(4, n).T).view("<u4").ravel()


def stream(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of texts as numbers from 1, with a 0 wherever a piece ends; the words by number; and their counts."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~(_GAP | _CUT)[data]
    turn = np.diff(inside)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    letters = pa.py_buffer(data[inside[1:].view(bool)].tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), letters]).dictionary_encode()
    number = np.asarray(words.indices, np.int64) + 1
    cuts = np.concatenate(([0], np.cumsum(_CUT[data])))
    cut = cuts[begin[1:]] > cuts[end[:-1]] if len(begin) else np.zeros(0, bool)
    return np.insert(number, np.flatnonzero(cut) + 1, 0), words.dictionary, np.bincount(number, minlength=len(words.dictionary) + 1)[1:]


_SLICES = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("stream", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice: its language, its number of words, their stream, and its words with their counts."""
    made, waiting, sizes = TaskContext.get().partitionId() << 32, {}, {}

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made
        numbers, words, counts = stream(waiting.pop(lang))
        spelt = zstandard.ZstdCompressor(level=1).compress(b" ".join(words.to_pylist()))
        row = {"slice": made, "lang": lang, "n": int(counts.sum()), "stream": packed(numbers), "words": spelt, "counts": packed(counts)}
        made, sizes[lang] = made + 1, 0
        yield pa.RecordBatch.from_pylist([row], schema=_SLICES)

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for row, texts in pieces(batch, "text"):
            for lang, text in zip(langs[row : row + len(texts)], texts):
                waiting.setdefault(lang, []).append(text or b"")
                sizes[lang] = sizes.get(lang, 0) + len(text or b"") + 1
                if sizes[lang] >= SLICE:
                    yield from flush(lang)
            if sum(sizes.values()) >= 4 * SLICE:  # many languages with little each
                for lang in list(waiting):
                    yield from flush(lang)
    for lang in list(waiting):
        yield from flush(lang)


_DEALT = pa.schema([("shard", pa.int64()), ("slice", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("local", pa.binary()), ("counts", pa.binary())])


def _dealt(batches: Iterator[pa.RecordBatch], shard_bits: int) -> Iterator[pa.RecordBatch]:
    """The words of slices by shard, a range of the hashes of language and word."""
    for batch in batches:
        for made, lang, data, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "lang", "words", "counts"))):
            spelt, counts = zstandard.ZstdDecompressor().decompress(data), unpacked(counts)
            if not len(counts):
                continue
            text = Text([spelt])
            hashes = mixed(text.hashes(*text.words()) + np.uint64(zlib.crc32(lang.encode())))
            shard = (hashes >> np.uint64(64 - shard_bits)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            words = pa.array(spelt.split(b" "), pa.large_binary()).take(pa.array(order)).to_pylist()
            edges = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
            rows = [
                {"shard": int(shard[order[a]]), "slice": made, "lang": lang, "words": b" ".join(words[a:b]), "local": packed(order[a:b] + 1), "counts": packed(counts[order[a:b]])}
                for a, b in zip(edges[:-1], edges[1:])
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_DEALT)


_NAMED = pa.schema([("shard", pa.int64()), ("rank", pa.int64()), ("lang", pa.string()), ("spelt", pa.string()), ("f", pa.int64()), ("slice", pa.int64()), ("values", pa.binary()), ("ranks", pa.binary())])
_NAMED_SQL = "shard long, rank long, lang string, spelt string, f long, slice long, `values` binary, ranks binary"


def _name(key: tuple, rows: pa.Table, least: int) -> pa.Table:
    """The frequent words of a shard, ranked, and for each slice its numbers of those that it has."""
    parts = [x.as_py().split(b" ") for x in rows["words"]]
    sizes, counts = [len(p) for p in parts], np.concatenate([unpacked(x.as_py()) for x in rows["counts"]]).astype(np.int64)
    langs, of = np.unique(np.array(rows["lang"].to_pylist(), object), return_inverse=True)
    # one number for each pair of a language and a word
    words = pa.array([w for p in parts for w in p], pa.large_binary()).dictionary_encode()
    pairs, at = np.unique(np.asarray(words.indices, np.int64) * len(langs) + np.repeat(of, sizes), return_inverse=True)
    total = np.bincount(at, weights=counts).astype(np.int64)
    frequent = np.flatnonzero(total >= least)
    n = len(frequent)
    rank = np.full(len(pairs), -1)
    rank[frequent] = np.arange(n)
    spelt = words.dictionary.take(pa.array(pairs[frequent] // len(langs))).cast(pa.binary()).cast(pa.string())
    table = {"shard": np.full(n, key[0].as_py()), "rank": np.arange(n), "lang": langs[pairs[frequent] % len(langs)], "spelt": spelt, "f": total[frequent]}
    out = [pa.table({f.name: pa.array(table[f.name], f.type) if f.name in table else pa.nulls(n, f.type) for f in _NAMED})]
    replies, end = [], 0
    for made, local, size in zip(rows["slice"].to_pylist(), rows["local"], sizes):
        mine, end = rank[at[end : end + size]], end + size
        hit = mine >= 0
        if hit.any():
            replies.append({"shard": key[0].as_py(), "slice": made, "values": packed(unpacked(local.as_py())[hit]), "ranks": packed(mine[hit])})
    return pa.concat_tables([*out, pa.Table.from_pylist(replies, schema=_NAMED)])


def keyed(words: np.ndarray, starts: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of n words that may be frequent, and their packed numbers.

    `starts` has, at each place, the id of the run of n - 1 words that begins there, or 0.
    """
    last = len(words) - n + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    fine = (starts[:last] > 0) & (words[n - 1 :] > 0)
    if n > 2:
        fine &= starts[1 : last + 1] > 0
    at = np.flatnonzero(fine)
    return at, (starts[at].astype(np.uint64) << np.uint64(bits)) | words[at + n - 1].astype(np.uint64)


def _filters(made: int, keys: np.ndarray, bits: int, shard_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(slice, shard, filter) of packed numbers; the upper bits of a permuted number are its shard."""
    if not len(keys):
        return
    whole = Filter.of(permuted(keys, bits), bits)
    inner = bits - shard_bits
    shard = (whole.values >> np.uint64(inner)).astype(np.int64) if shard_bits else np.zeros(len(whole.values), np.int64)
    edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    low = whole.values & np.uint64((1 << inner) - 1)
    for a, b in zip(edges[:-1], edges[1:]):
        yield made, int(shard[a]), Filter(inner, low[a:b], whole.counts[a:b]).to_bytes()


_FILTERS = pa.schema([("slice", pa.int64()), ("shard", pa.int64()), ("filter", pa.binary())])
_FILTERS_SQL = "slice long, shard long, filter binary"


@dataclass(frozen=True)
class Level:
    """Runs of n words: bits of a packed number, and how many of them, permuted, are the shard."""

    n: int
    bits: int
    shard_bits: int


def _step(key: tuple, streams: pa.Table, replies: pa.Table, levels: list[Level], word_bits: int) -> pa.Table:
    """The filters of a slice for the last of `levels`, from its stream and the replies for all lengths before.

    The ids of words (0: a cut or a word that is not frequent) and then of longer and longer runs come from
    the replies again at each length, so that nothing of a slice but its stream is kept between lengths.
    """
    made = key[0].as_py()
    if not streams.num_rows or not replies.num_rows:
        return _FILTERS.empty_table()
    local = unpacked(streams["stream"][0].as_py())
    known = np.zeros(int(local.max(initial=0)) + 1, np.int64)
    told = {}
    for n, shard, shift, values, ranks in zip(*(replies[c].to_pylist() for c in ("n", "shard", "shift", "values", "ranks"))):
        ids = unpacked(ranks).astype(np.int64) + shift + 1
        if n == 1:
            known[unpacked(values)] = ids
        else:
            told.setdefault(n, []).append((shard, Filter.from_bytes(values).values, ids))
    words = known[local]
    words = words[(words > 0) | (np.append(words[1:], 0) > 0)]  # one 0 between runs
    starts = words
    for level in levels[:-1]:
        if level.n not in told:
            return _FILTERS.empty_table()
        at, keys = keyed(words, starts, level.n, word_bits)
        inner = np.uint64(level.bits - level.shard_bits)
        values = np.concatenate([v | (np.uint64(shard) << inner if level.shard_bits else np.uint64(0)) for shard, v, _ in told[level.n]])
        ids = np.concatenate([i for *_, i in told[level.n]])
        order = np.argsort(values)
        values, ids = values[order], ids[order]
        wanted = permuted(keys, level.bits)
        place = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        found = values[place] == wanted
        starts = np.zeros(len(words), np.int64)
        starts[at[found]] = ids[place[found]]
    last = levels[-1]
    _, keys = keyed(words, starts, last.n, word_bits)
    rows = [{"slice": s, "shard": shard, "filter": data} for s, shard, data in _filters(made, keys, last.bits, last.shard_bits)]
    return pa.Table.from_pylist(rows, schema=_FILTERS)


_MET = pa.schema([("shard", pa.int64()), ("rank", pa.int64()), ("prefix", pa.int64()), ("word", pa.int64()), ("f", pa.int64()), ("slice", pa.int64()), ("values", pa.binary()), ("ranks", pa.binary())])
_MET_SQL = "shard long, rank long, prefix long, word long, f long, slice long, `values` binary, ranks binary"


def _meet(key: tuple, rows: pa.Table, least: int, word_bits: int, bits: int, shard_bits: int) -> pa.Table:
    """The frequent numbers of a shard, ranked, and for each slice those that it has."""
    shard = key[0].as_py()
    parts = [Filter.from_bytes(x.as_py()) for x in rows["filter"]]
    whole = Filter.merged(parts)
    inner = whole.bits
    frequent = np.flatnonzero(whole.counts >= least)
    values, n = whole.values[frequent], len(frequent)
    full = restored(values | np.uint64(shard << inner) if shard_bits else values, bits)
    table = {"shard": np.full(n, shard), "rank": np.arange(n), "prefix": (full >> np.uint64(word_bits)).astype(np.int64), "word": (full & np.uint64((1 << word_bits) - 1)).astype(np.int64), "f": whole.counts[frequent]}
    out = [pa.table({f.name: pa.array(table[f.name], f.type) if f.name in table else pa.nulls(n, f.type) for f in _MET})]
    replies = []
    for made, part in zip(rows["slice"].to_pylist(), parts):
        if not n:
            break
        place = np.minimum(np.searchsorted(values, part.values), n - 1)
        hit = values[place] == part.values
        if hit.any():
            answer = Filter(inner, part.values[hit], np.ones(int(hit.sum()), np.int64))
            replies.append({"shard": shard, "slice": made, "values": answer.to_bytes(), "ranks": packed(place[hit])})
    return pa.concat_tables([*out, pa.Table.from_pylist(replies, schema=_MET)])


def _with(fn, *settings):
    return lambda key, rows: fn(key, rows, *settings)


def _with_both(fn, *settings):
    return lambda key, rows, others: fn(key, rows, others, *settings)


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _strides(met: DataFrame) -> tuple[int, int]:
    """How many entries are frequent, and the bits that hold any rank of a shard: an entry's id is its shard's number
    followed by that many bits of its rank, so no shard needs to know the others' sizes."""
    n, top = met.where("f IS NOT NULL").agg(F.count(F.lit(1)), F.max("rank")).first()
    return n, _bits((top or 0) + 1)


def _id(bits: int) -> Column:
    """Ids begin at 1."""
    return F.col("rank") + _shift(bits) + 1


def _shift(bits: int) -> Column:
    return F.shiftleft(F.col("shard"), bits)


def counted(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f, parts) of every phrase of 1 to `longest` words that occurs `least` times or more in its language,
    where parts[k] is the count of its first k + 1 words; and (lang, n), the words of each language.

    `docs` has lang and text; a null language is `und`, a null text is empty.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs["text"].alias("text"))
    slices = bucketed(spark, rows.mapInArrow(_sliced, "slice long, lang string, n long, stream binary, words binary, counts binary"), "slice", buckets, "slices")
    sizes = stored(spark, slices.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "sizes")
    n_words = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(_bits(n_words // SHARD), (buckets - 1).bit_length(), 1)  # bits

    def shard_bits(bits: int) -> int:
        return min(bits - 1, shards)

    dealt = slices.select("slice", "lang", "words", "counts").mapInArrow(lambda batches, s=shards: _dealt(batches, s), "shard long, slice long, lang string, words binary, local binary, counts binary")
    named = stored(spark, dealt.groupBy("shard").applyInArrow(_with(_name, least), _NAMED_SQL), "named")
    rank_bits = _strides(named)[1]
    words = named.where("f IS NOT NULL").select(_id(rank_bits).alias("id"), "lang", F.col("spelt").alias("word"), "f")
    words = stored(spark, words, "vocabulary")
    word_bits = _bits(words.agg(F.max("id")).first()[0] or 0)
    answers = lambda met, n, bits: met.where("f IS NULL").select("slice", F.lit(n).alias("n"), "shard", _shift(bits).alias("shift"), "values", "ranks")
    replies = answers(named, 1, rank_bits)
    streams = slices.select("slice", "stream")  # in buckets, so never shuffled
    phrases = [words.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("parts"))]
    levels, start_bits = [], word_bits
    for n in range(2, longest + 1):
        bits = start_bits + word_bits
        levels = [*levels, Level(n, bits, shard_bits(bits))]
        step, meet = _with_both(_step, levels, word_bits), _with(_meet, least, word_bits, bits, levels[-1].shard_bits)
        filters = streams.groupBy("slice").cogroup(apart(replies).groupBy("slice")).applyInArrow(step, _FILTERS_SQL)
        met = stored(spark, filters.groupBy("shard").applyInArrow(meet, _MET_SQL), "met")
        found = met.where("f IS NOT NULL")
        n_found, rank_bits = _strides(met)
        if not n_found:
            break
        numbered = found.select(_id(rank_bits).alias("id"), "prefix", "word", "f")
        before = phrases[-1].select(F.col("id").alias("prefix"), "lang", "words", "parts")
        last = words.select(F.col("id").alias("word"), F.col("word").alias("spelt"))
        whole = numbered.join(before, "prefix").join(last, "word")
        phrases.append(stored(spark, whole.select("id", "lang", F.concat("words", F.array("spelt")).alias("words"), "f", F.concat("parts", F.array("f")).alias("parts")), "phrases"))
        replies, start_bits = replies.unionByName(answers(met, n, rank_bits)), levels[-1].shard_bits + rank_bits
    whole = phrases[0].drop("id")
    for more in phrases[1:]:
        whole = whole.unionByName(more.drop("id"))
    return whole, sizes


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, most: int = 2000, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` best phrases of each language.

    A phrase of 2 to `longest` words with a >= `least` occurrences is cut where floor(1000 a n / (l r)) is
    least, l and r being the counts of its parts and n the words of the language; the earliest of equal
    cuts counts. A phrase inside a longer one that has `share` percent of its occurrences or more is
    left out. Ranks go by score and a, falling, and phrase, rising by UTF-8 bytes. Null languages are
    `und`, null and empty texts have no words, repeated rows count each, long texts are read whole,
    other columns of `docs` are not touched. No rows: no result rows.
    """
    spark = docs.sparkSession
    phrases, sizes = counted(docs, least, longest)
    spelt = stored(spark, phrases.withColumn("phrase", F.array_join("words", " ")), "spelt")
    candidates = spelt.where(F.size("words") > 1)
    # Of the phrases around a candidate, those longer by one word have the most occurrences.
    longer = candidates.where(F.size("words") > 2).select("lang", "f", F.explode(F.array(_joined(1, F.size("words") - 1), _joined(2, F.size("words") - 1))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    free = candidates.join(covered, ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < share * F.col("f"))).drop("above")
    cut = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", F.element_at("parts", F.col("k")).alias("l"), _joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    parts = spelt.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(parts, ["lang", "rest"]).join(sizes, "lang")
    # products may pass 64 bits: whole decimals
    score = F.expr("(1000BD * cast(a AS decimal(17,0)) * cast(n AS decimal(17,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _joined(first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")
