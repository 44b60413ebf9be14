"""Registered queries of the training-data operators against plain Python on a small table."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionlens.llm import neighbours, query_op1, query_op2, query_op4, query_op5, query_op6, query_op7, query_op9, query_op10, sharding, suffixes
from sessionlens.llm.pieces import MARK, Segmenter

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")


def test_token_ids(spark, docs):
    got = query_op1.token_ids(spark, DATA).toPandas().sort_values("doc_id")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in docs.text]
    n = np.array([len(x) for x in ids])
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.n_tokens.tolist() == n.tolist()
    assert got.start.tolist() == (np.cumsum(n) - n).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_near_duplicates(spark, docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = WORD.findall(t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[a] < least[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[b], changed = least[a], True
    got = query_op2.duplicates(spark, DATA).toPandas().set_index("doc_id")
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert got.component_id.to_dict() == least


@pytest.mark.parametrize("common", [2, 1 << 16])
def test_repeated_passages(spark, docs, monkeypatch, common):
    monkeypatch.setattr(suffixes, "COMMON", common)
    seen, want = set(), {}
    for i, t in zip(docs.doc_id, docs.text):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                gone[k : k + 100] = True
            seen.add(window)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in query_op9.repeats(spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == want


def test_two_stage_order():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 100, 600).astype(np.uint8), np.full(40, 98, np.uint8), np.full(200, 255, np.uint8)])
    wanted = np.zeros(len(data), bool)
    wanted[:560] = True
    order = suffixes.two_stage(data, wanted)
    order = order[wanted[order]]
    assert order.tolist() == sorted(range(560), key=lambda i: data[i : i + 640].tobytes())


def test_quality(spark, docs):
    got = query_op6.quality(spark, DATA).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(windows)
        repeated = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        row = got.loc[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (row.base_failed and row.kept)


def test_cutoffs_keep_their_promise():
    from sessionlens.llm.quality import passes

    # Of 1000 good documents 20 are rejected: at most 5 % is certain enough, at most 2.5 % is not.
    assert passes(20, 1000, 0.05, 0.001) and not passes(20, 1000, 0.025, 0.001)
    assert not passes(0, 10, 0.05, 0.05) and passes(0, 100, 0.05, 0.05) and not passes(0, 0, 0.05, 0.05)


def test_language(spark, docs):
    got = query_op7.language(spark, DATA).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_mixed_language_spans(spark):
    from sessionlens.llm.language import identified, train

    text = {"en": "the house and the garden with that thing ", "ru": "дом и сад это хорошо ", "de": "das haus und der garten mit dem ding "}
    model = train(spark.createDataFrame([(t * 20, k) for k, t in text.items()], "text string, lang string"))
    row = identified(spark.createDataFrame([(1, text["en"] * 3 + text["ru"] * 2 + text["de"] * 2)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "de"] and sum(s.words for s in row.spans) == 50 and row.lang_pred == "en"


def test_mixing(spark, docs):
    got = query_op10.mixed(spark, DATA).toPandas().merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert got["size"].tolist() == [len(WORD.findall(t)) for t in got.text]
    sizes = got.groupby("source")["size"].sum().sort_index(key=lambda k: k.map(lambda s: s.encode()))
    total, target, capped = sizes.sum(), {}, {}
    weight = {s: 1 + i % 3 for i, s in enumerate(sizes.index)}
    while True:
        rest = total - sum(capped.values())
        free = sum(w for s, w in weight.items() if s not in capped)
        target = {s: capped.get(s, rest * w / max(free, 1)) for s, w in weight.items()}
        over = {s: 3.0 * sizes[s] for s in target if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s, part in got.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(target[s]) and part.source_size.iloc[0] == sizes[s]
        assert abs(part.taken.sum() - target[s]) <= max(1, part["size"].max() / 2) and (part.taken <= 3 * part["size"]).all()
        assert part.loc[part["size"] > 0, "taken"].mod(part.loc[part["size"] > 0, "size"]).eq(0).all()


@pytest.mark.parametrize("least, greatest", [(2, 30), (100, 5000), (50_000, 300_000), (10**6, 2 * 10**6)])
def test_fit_is_best(least, greatest):
    from sessionlens.llm.mixing import LAST_STRETCH, LONGEST_TIMES, fit

    assert fit(np.array([100000, 90000]), np.array([1, 1]), 100000).tolist() == [1, 0]
    assert fit(np.array([200000, 70000]), np.array([1, 3]), 140000).tolist() == [0, 2]
    rng = np.random.default_rng(least)
    for _ in range(40 if greatest < 10**5 else 12):
        sizes = rng.choice(np.arange(least, greatest), 4, replace=False)
        stock = rng.integers(1, 4, 4)
        budget = int(rng.integers(0, int((sizes * stock).sum()) + 5))
        taken = fit(sizes, stock, budget)
        assert (taken <= stock).all() and (taken >= 0).all() and (sizes * taken).sum() <= budget
        sums = {0}
        for s, n in zip(sizes, stock):
            sums = {x + int(s) * k for x in sums for k in range(int(n) + 1)}
        best = max(x for x in sums if x <= budget)
        if budget <= max(LAST_STRETCH, LONGEST_TIMES * sizes.max()) // 2 or budget >= (sizes * stock).sum():
            assert (sizes * taken).sum() == best
        else:  # a part is taken evenly first
            assert (sizes * taken).sum() > budget - sizes.min()


def test_neighbours(spark):
    table = pd.read_parquet(f"{DATA}/embeddings.parquet")
    vectors, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = query_op5.neighbours(spark, DATA).toPandas()
    found = 0
    for q, part in got.groupby("query_id"):
        score = vectors @ vectors[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        found += len(set(best) & set(part.vec_id))
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, min(20, len(ids) - 1) + 1)) and (part.score.diff().dropna() <= 1e-12).all()
    assert found / len(got) >= 0.9 and got.query_id.nunique() == (ids % 20 == 0).sum()


@pytest.mark.parametrize("n_large", [15, 60])
def test_neighbours_of_mixed_norms(spark, monkeypatch, n_large):
    monkeypatch.setattr(neighbours, "SAMPLE", 512)
    vectors = np.random.default_rng(11).normal(size=(6000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # The large rows are those that a sample by the smallest hash misses.
    order = [r.id for r in spark.range(len(vectors)).orderBy(F.xxhash64("id")).collect()]
    vectors[order[-n_large:]] *= 20
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": list(vectors)}), "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, frame.where("vec_id < 100"), k=20).toPandas()
    found = 0
    for q, part in got.groupby("query_id"):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        found += len(set(np.argsort(-score)[:20]) & set(part.vec_id))
    assert len(got) == 2000 and found / 2000 >= 0.97, found / 2000


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 40, 500, dtype=np.uint64)
    tables = neighbours.Tables(codes, 40)
    for radius in (0, 3, 7, 12, 20):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[3]) <= radius)
        assert tables.within(codes[3], radius).tolist() == want.tolist()


@pytest.mark.parametrize("n", [2, 3])
def test_n_best_pieces(n):
    segmenter = Segmenter(public_tokenizers.path("piece_bpe_32k.model"), n)

    def every(text, score=0.0):
        if not text:
            return [score]
        out = [x for k in range(1, len(text) + 1) if text[:k] in segmenter.piece for x in every(text[k:], score + segmenter.piece[text[:k]][1])]
        return out + ([] if text[0] in segmenter.piece else every(text[1:], score + segmenter.unknown))

    for text in ["hello", "the cat, é", "  a  b ", "x\ny😀z", "aa aa", "!!", "▁a", ""]:
        [(ids, scores, _)] = segmenter.best([text])
        assert scores == sorted(every((MARK + text.replace(" ", MARK)) if text else ""), reverse=True)[:n]
        assert segmenter.decode(ids.tolist()).decode() == text.replace(MARK, " ")
        assert [s for s, _ in segmenter.all_best(text)] == scores


def test_pieces_of_documents(spark, docs):
    got = query_op4.pieces(spark, DATA).toPandas()
    assert got.round_trip.all() and len(got) == len(docs)


def test_lookup_table(spark):
    names, size = ["a", "b", "c"], 31
    orders = [[(int(hashlib.md5(n.encode()).hexdigest()[:15], 16) % size + j * (int(hashlib.md5(n.encode()).hexdigest()[15:30], 16) % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner: dict[int, str] = {}
    for turn in range(size):
        owner[next(s for s in orders[turn % 3] if s not in owner)] = names[turn % 3]
    assert {r.slot: r.shard for r in sharding.lookup_table(spark, names, size).collect()} == owner
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 30)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as pipeline

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = pipeline.language(spark, frame, DATA)
    assert kept.columns == frame.columns and kept.count() == len(docs)
    parts = {r.doc_id: r.component_id for r in query_op2.duplicates(spark, DATA).collect()}
    once = pipeline.near_duplicate(spark, frame, DATA)
    assert {r.doc_id for r in once.select("doc_id").collect()} == {i for i, c in parts.items() if i == c}
    cut = {r.doc_id: r.n_removed for r in query_op9.repeats(spark, DATA).collect()}
    size = {i: len(t.encode()) for i, t in zip(docs.doc_id, docs.text)}
    left = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, frame, DATA).collect()}
    assert set(left) == {i for i in size if cut[i] < size[i]} and all(abs(len(left[i].encode()) - size[i] + cut[i]) <= 6 * (cut[i] > 0) for i in left)
    taken = {r.doc_id: r.taken // r["size"] for r in query_op10.mixed(spark, DATA).collect() if r.taken}
    assert Counter(r.doc_id for r in pipeline.mixed(spark, frame, DATA).select("doc_id").collect()) == taken
    assert pipeline.pieces(spark, frame, DATA).where("round_trip").count() == len(docs)


def test_three_best_with_their_ids(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    segmenter = Segmenter(path, 3)

    def every(text):
        if not text:
            return [(0.0, ())]
        return [(segmenter.piece[text[:k]][1] + s, (segmenter.piece[text[:k]][0], *ids)) for k in range(1, len(text) + 1) if text[:k] in segmenter.piece for s, ids in every(text[k:])]

    for text in ("hello", "the cat", "aa aa", "in a house"):
        paths = dict((ids, s) for s, ids in every(MARK + text.replace(" ", MARK)))
        found = segmenter.all_best(text)
        assert len(found) == len({tuple(ids) for _, ids in found}) == 3
        assert [paths[tuple(ids)] for _, ids in found] == pytest.approx(sorted(paths.values(), reverse=True)[:3])
        assert [segmenter.decode(ids).decode() for _, ids in found] == [text] * 3

    import corpus_pipeline

    docs = spark.createDataFrame([(1, "s", "the cat, é"), (2, "s", ""), (3, "s", "in a house")], "doc_id long, source string, text string")
    crcs = lambda lists: [zlib.crc32(np.array(x, "<u4").tobytes()) for x in lists]
    staged = {r.doc_id: r for r in corpus_pipeline.pieces(spark, docs, "").collect()}
    assert [staged[3].n_best_ids, staged[3].scores] == [[ids for _, ids in segmenter.all_best("in a house")], [s for s, _ in segmenter.all_best("in a house")]]
    assert staged[1].n_best_ids[0] == staged[1].ids and len(staged[1].n_best_ids) == 3 and staged[2].n_best_ids == [[]]
    got = {r.doc_id: r for r in query_op4.digested(docs, path).collect()}
    assert all(got[i].n_best_crc32 == crcs(staged[i].n_best_ids) and got[i].ids_crc32 == got[i].n_best_crc32[0] for i in got)
    assert {len(r.n_best_crc32) for r in query_op4.pieces(spark, DATA).collect()} == {3}
