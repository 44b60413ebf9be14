"""The Merkle manifest against a tree built with plain hashes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sessionlens.llm import merkle, query_op12

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(digests):
    """(root, proofs, folder): `folder(i, digest)` is the root with leaf i replaced."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])

    def steps(i):
        for level in levels[:-1]:
            run = i // 16 * 16
            yield level[run : run + 16], i - run
            i //= 16

    def proof(i):
        return "".join("".join(run[:k] + run[k + 1 :]) for run, k in steps(i))

    def fold(i, digest):
        for run, k in steps(i):
            digest = h([*run[:k], digest, *run[k + 1 :]])
        return digest

    return levels[-1][0], proof, fold


def expected(rows):
    trees = defaultdict(list)
    for row in rows:
        own = h([field(row[f]) for f in FIELDS])
        changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        text = row["text"]
        other = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees[row["source"]].append((row["doc_id"] is not None, row["doc_id"], own, h([field((row | {"text": other})[f]) for f in FIELDS]) if changed else own))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        built[name] = climb([x[2] for x in trees[name]])
    root, proof, fold = climb([built[n][0] for n in names])
    out = []
    for place, name in enumerate(names):
        sub, inner_proof, inner_fold = built[name]
        for i, (_, doc, own, other) in enumerate(trees[name]):
            got = fold(place, inner_fold(i, other))
            out.append((doc, own, sub, root, h([inner_proof(i), proof(place)]), got, got == root))
    return sorted(out, key=repr)


def actual(frame):
    got = merkle.manifest(
        frame, FIELDS, changes={"text": query_op12.lowered("text")}, changed=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    )
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest int, leaf string, pos long"


def test_blocks():
    rng = np.random.default_rng(1)
    for n in range(17):
        digests, state = rng.integers(0, 256, (n, 32), dtype=np.uint8), merkle.begun(1)
        for d in digests:
            state = merkle.absorb(state, merkle.blocks(d[None]))
        assert merkle.finished(state, n)[0].tobytes() == hashlib.sha256("".join(d.tobytes().hex() for d in digests).encode()).digest()


def test_resumed_without_left_siblings():
    digests = np.random.default_rng(2).integers(0, 256, (37, 32), dtype=np.uint8)
    level, parents = merkle.Level.over(digests)
    changed = np.random.default_rng(3).integers(0, 256, (37, 32), dtype=np.uint8)
    at = np.arange(37)
    want = []
    for i in range(37):
        run = [d.tobytes().hex() for d in digests[i // 16 * 16 : i // 16 * 16 + 16]]
        run[i % 16] = changed[i].tobytes().hex()
        want.append(h(run))
    for run in range(3):  # the first child of a run is on the left of all others
        level.children[run, 0] = 0
    got = level.resumed(at // 16, at % 16, changed)
    assert [g.tobytes().hex() for g in got] == want and len(parents) == 3


def test_odd_rows_and_sources(spark):
    rows = [(None, None, None, None, None), (None, "a", "x", 1, "No Id"), (1, None, None, 3, ""), (2, "é", "en", 5, "One two"), (2, "é", "en", 5, "One two"), (2, "é", "en", 5, "Other"),
            (15, "a", None, 0, "Long " * 200_000), (20, "A", "en", 1, "quiet"), (-7, "a", "", 1, "ÀB")]
    rows += [(i, f"s{i % 40}", "en", i, f"Text {i}") for i in range(100, 400)]
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    assert actual(frame) == expected([dict(zip(FIELDS, r)) for r in rows])
    assert actual(frame.limit(0)) == []
    one = [(5, "only", None, 1, "Text")]
    assert actual(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in one], SCHEMA)) == expected([dict(zip(FIELDS, r)) for r in one])


def test_source_of_many_tiles(spark):
    """Sources below, at and above one tile."""
    ids = list(range(9000))
    random.Random(4).shuffle(ids)
    rows = [(i, "big" if i < 8200 else "tile" if i < 8216 else "rest", "en", i, f"T{i}") for i in ids]
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    assert actual(frame) == expected([dict(zip(FIELDS, r)) for r in rows])


def test_query_against_its_twin(spark):
    data = "/root/testdata/sf0.001"
    got = query_op12.merkle_manifest(spark, data)
    columns = sorted(got.columns)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = db.execute(f"select {', '.join(columns)} from ({query_op12.SQL})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
