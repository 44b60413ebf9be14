"""Records of hashes packed by shard, so that counting them moves few bytes and no row a hash.

A task sorts the hashes of some megabytes of text and packs, for each shard of the hash space, the 32
bits that tell hashes apart inside it, the document of each and how often it stands in the slice. A
shard unpacks what all tasks sent and counts. A hash that is common everywhere is one record a slice.
"""

from __future__ import annotations

import numpy as np
import zstandard

from .words import mixed

#: Bits of the filters that mark common hashes; where one fills up, it marks more than it should.
FILTER_BITS = 1 << 23


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _flat(data: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def pack(keys: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Records of a shard: keys rising, the document of each (0 where several), how many documents."""
    ids, refs = np.unique(docs, return_inverse=True)
    body = _planes(np.diff(ids, prepend=0)) + _planes(np.diff(keys, prepend=np.uint32(0))) + _planes(refs.astype(np.uint32)) + _planes(counts.astype(np.uint32))
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(ids), len(keys)], np.int64).tobytes() + body)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(payload))
    n_ids, n = np.frombuffer(data, np.int64, 2).tolist()
    at, out = 16, []
    for kind, m in (("<i8", n_ids), ("<u4", n), ("<u4", n), ("<u4", n)):
        out.append(_flat(data[at:], kind, m))
        at += np.dtype(kind).itemsize * m
    ids, keys = np.cumsum(out[0]), np.cumsum(out[1], dtype=np.uint32)
    return keys, ids[out[2]], out[3]


def filter_place(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32), hashes.astype(np.uint32)


def runs(sorted_keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal keys (and equal `more`)."""
    new = np.ones(len(sorted_keys), bool)
    if len(sorted_keys):
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        for other in more:
            new[1:] |= other[1:] != other[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(sorted_keys)))


def by_shard(shard: np.ndarray, key: np.ndarray, doc: np.ndarray, count: np.ndarray, shards: int) -> tuple[np.ndarray, list[bytes]]:
    """Shards with records and their packed records; the input is sorted by shard and key."""
    edges = np.searchsorted(shard, np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edges))
    return full.astype(np.int32), [pack(key[a:b], doc[a:b], count[a:b]) for a, b in zip(edges[full], edges[full + 1])]


def home_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """The shard at which what concerns a document meets."""
    return (mixed(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int32)
