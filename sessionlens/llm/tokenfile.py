"""Token ids of documents in a binary table that gives back any short document at once.

A table of tokens is a folder of Parquet files. A row is a block of about `BLOCK` bytes of
neighbouring documents in doc_id order: `payload` holds one zstandard frame a document, compressed
alone with a dictionary that all frames share; `doc_ids`, `offsets` (where a frame begins, and the
end of the last), `n_tokens` and `ahead` (ids of the partition before the block) index it; `dictionary_hash`
names the dictionary the frames need. A reader of the index prunes the payload away; a reader of one
document reads the index, one row, and decompresses one frame. The dictionary is a table beside it.

The order comes from one range shuffle of the texts by doc_id, which splits evenly whatever the
sources or copies. Blocks are written by Spark's own writer, so a lost task or executor leaves
nothing behind. Where a document starts is summed from blocks to partitions to the corpus; only the
per-partition totals, one row a task, meet in one place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoder import encoder

BLOCK = 1 << 20
END = 0
#: The dictionary is trained on at most so many documents, those with the smallest hash of doc_id
#: among texts of at most SAMPLE_CHARS characters; it only makes frames smaller.
SAMPLE = 1000
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 1 << 16

_BLOCKS = "partition int, block int, doc_ids array<long>, offsets array<long>, n_tokens array<long>, ahead long, width int, dictionary_hash string, payload binary"


def _ids(batch: pa.RecordBatch, tokenizer: str) -> Iterator[tuple[int | None, bytes]]:
    encode = encoder(tokenizer)
    end = np.array([END], encode.dtype).tobytes()
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        yield doc_id, encode.encode(text.as_py() or "") + end


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary from a bounded sample of serialized id arrays; empty for no documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [ids for batch in batches for _, ids in _ids(batch, tokenizer)]
        yield pa.RecordBatch.from_arrays([pa.array([_trained(samples)], pa.binary())], names=["dictionary"])

    short = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    sample = short.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).coalesce(1)
    return max((bytes(r[0]) for r in sample.mapInArrow(run, "dictionary binary").collect()), key=len, default=b"")


def _trained(samples: list[bytes]) -> bytes:
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if size < 256 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform to train on: its bytes serve as the dictionary
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode every whole text of `docs` (doc_id, text) and write blocks and dictionary below `path`.

    A null text is empty; every document ends with id 0. Rows with a null doc_id come first, rows of
    one doc_id in text order; repeated rows are written as often as they stand there. No rows: empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    data = train_dictionary(rows, tokenizer)
    name = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(name, bytearray(data))], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).dtype.itemsize
        packer = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(data), write_content_size=True)
        part, block, ahead, ids, frames, counts, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            return pa.RecordBatch.from_pylist(
                [dict(partition=part, block=block, doc_ids=ids, offsets=offsets, n_tokens=counts, ahead=ahead, width=width, dictionary_hash=name, payload=b"".join(frames))],
                schema=schema,
            )

        for batch in batches:
            for doc_id, found in _ids(batch, tokenizer):
                ids.append(doc_id)
                frames.append(packer.compress(found))
                counts.append(len(found) // width)
                held += len(frames[-1])
                if held >= BLOCK:
                    yield row()
                    ahead, block, ids, frames, counts, held = ahead + sum(counts), block + 1, [], [], [], 0
        if ids:
            yield row()

    schema = _arrow_schema()
    ordered = rows.repartitionByRange(*_tasks(spark), F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _BLOCKS).write.parquet(f"{path}/blocks")


def _tasks(spark: SparkSession) -> tuple[int, ...]:
    return (max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism),)


def _arrow_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema(
        [("partition", pa.int32()), ("block", pa.int32()), ("doc_ids", longs), ("offsets", longs), ("n_tokens", longs), ("ahead", pa.int64()), ("width", pa.int32()), ("dictionary_hash", pa.string()), ("payload", pa.binary())]
    )


def _unpacker(dictionaries: dict[str, bytes], name: str) -> zstandard.ZstdDecompressor:
    if hashlib.sha256(dictionaries[name]).hexdigest() != name:
        raise ValueError("the dictionary is not the one the frames were written with")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionaries[name]))


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r[0]: bytes(r[1]) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, partition, block, place, start, offset, size, n_tokens): where every document is; payloads are not read."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("partition").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))  # one row a task
    each = blocks.join(ahead, "partition").select(
        "partition", "block", (F.col("ahead") + F.col("earlier")).alias("from"), "n_tokens", "offsets", F.posexplode("doc_ids").alias("place", "doc_id")
    )
    within = F.aggregate(F.slice("n_tokens", 1, F.col("place")), F.lit(0).cast("long"), lambda a, x: a + x)
    offset, after = F.col("offsets")[F.col("place")], F.col("offsets")[F.col("place") + 1]
    return each.select(
        "doc_id", "partition", "block", "place", (F.col("from") + within).alias("start"), offset.alias("offset"), (after - offset).alias("size"), F.col("n_tokens")[F.col("place")].alias("n_tokens")
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decompressed ids."""
    dictionaries = _dictionaries(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("partition").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))  # one row a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                unpack, kind, out = _unpacker(dictionaries, b["dictionary_hash"]), f"<u{b['width']}", []
                for i in range(len(b["doc_ids"])):
                    ids = np.frombuffer(unpack.decompress(b["payload"][b["offsets"][i] : b["offsets"][i + 1]]), kind).astype("<u4")
                    out.append((len(ids), zlib.crc32(ids.tobytes())))
                n = np.array([x[0] for x in out], np.int64)
                start = b["ahead"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["partition"]] * len(n), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array([x[1] for x in out], pa.int64())],
                    names=["partition", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    read = blocks.mapInArrow(run, "partition int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(ahead), "partition").select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids array<int>) of the documents asked for: only their frames are decompressed."""
    dictionaries = _dictionaries(spark, path)
    chosen = set(wanted)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(w)) for w in chosen]).cast("array<long>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                unpack = _unpacker(dictionaries, b["dictionary_hash"])
                at = [i for i, d in enumerate(b["doc_ids"]) if d in chosen]
                ids = [np.frombuffer(unpack.decompress(b["payload"][b["offsets"][i] : b["offsets"][i + 1]]), f"<u{b['width']}").tolist() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([b["doc_ids"][i] for i in at], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<int>")
