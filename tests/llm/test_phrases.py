"""Collocations against plain counting, and the counting quotient filter by itself."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sessionlens.llm import phrases
from sessionlens.llm.quotient import Filter, permuted, restored

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 13, 24, 33, 47, 63, 64])
def test_filter_is_lossless(bits):
    rng = np.random.default_rng(bits)
    if bits <= 13:
        every = np.arange(1 << bits, dtype=np.uint64)
        assert len(np.unique(permuted(every, bits))) == 1 << bits
    values = rng.integers(0, 1 << min(bits, 63), 5000, dtype=np.uint64)
    values = np.concatenate([values, values[:700], values[:50]])
    assert (restored(permuted(values, bits), bits) == values).all()
    want = Counter(permuted(values, bits).tolist())
    halves = [Filter.from_bytes(Filter.of(permuted(v, bits), bits).to_bytes()) for v in (values[:3000], values[3000:], values[:0])]
    got = Filter.from_bytes(Filter.merged(halves).to_bytes())
    assert dict(zip(got.values.tolist(), got.counts.tolist())) == want
    assert got.count(permuted(values[:10], bits)).tolist() == [want[v] for v in permuted(values[:10], bits).tolist()]


def expected(rows, least, longest, most):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= least and len(p) > 1}
        ranked = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            cuts = [(1000 * a * sizes[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, word string, slice int, n int, score string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def actual(spark, rows, *settings):
    frame = spark.createDataFrame([(i, t, lang, "w", 1, 2, "s") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(9)  # slices end with tasks
    return sorted(tuple(r) for r in phrases.collocations(frame, *settings).select(*COLUMNS).collect())


def test_odd_texts(spark):
    rows = [("en", "To be, or not to be: that is THE question\tof to be. to  be"), ("en", None), (None, ""), (None, "to be to be to be"), ("und", "to be to be\x0bto be"),
            ("en", "É to be é to be … to be; to\xa0be to\nbe"), ("de", "a"), ("xx", "a b c d e f " * 30), ("xx", "a b c d e f"), ("xx", "a b c d e f"), ("long", "very long text " * 30000)]
    for least in (1, 2, 3):
        assert actual(spark, rows, least, 5, 50, 100) == expected(rows, least, 5, 50)
    assert actual(spark, rows, 10**6, 5, 50, 100) == []
    assert actual(spark, [], 1, 5, 50, 100) == []


def test_many_slices(spark):
    rng = np.random.default_rng(7)
    vocabulary = np.array([f"w{i}" for i in range(300)] + ["the"] * 150)
    rows = [(["en", "de", None][i % 3], " ".join(rng.choice(vocabulary, 200)) + (". the same closing words here" if i % 2 else "")) for i in range(400)]
    assert actual(spark, rows, 12, 5, 2000, 100) == expected(rows, 12, 5, 2000)


def test_entries_are_numbered_without_a_join(spark):
    """An id is its shard's number and its rank, so replies meet no table of shards."""
    met = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (3, 0, 9), (3, None, None)], "shard long, rank long, f long")
    n, bits = phrases._strides(met)
    ids = [r.i for r in met.where("f IS NOT NULL").select(phrases._id(bits).alias("i")).collect()]
    assert n == 3 and len(set(ids)) == 3 and min(ids) == 1 and max(ids) < 1 << (2 + bits + 1)
