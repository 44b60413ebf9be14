"""N-best segmentation into sentence pieces, and decoding.

A text becomes `space + text` with spaces written as U+2581, as the model's own normaliser does. Its
pieces form a lattice over the characters; a segmentation's score is the sum of its pieces' scores in
the model file. A forward Viterbi pass gives the best score up to every position, which is the exact
heuristic of a backward A-star search: hypotheses grow from the end of the text, ordered by score so
far plus the Viterbi score before them, and leave the queue in the order of their final score.

No piece spans two neighbouring characters that stand together in no piece, so the lattice of a text
falls apart at such places, above all before words. The search runs on these stretches, whose results
repeat and are remembered; a text's best list is the best list of sums over them, found with a
queue as well. Characters outside the vocabulary become their UTF-8 byte pieces, at a fixed penalty.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .words import pieces

MARK = "▁"
_STEP = 0x5851F42D4C957F2D

#: Stretches remembered by a worker, about 300 bytes each. Beyond that the ones that came back stay, half of it
#: at most; forgotten ones are searched again. A stage that shares its workers with others should remember fewer.
REMEMBERED = 250_000

Path = tuple[float, tuple[int, ...]]


class Segmenter:
    """Best lists of texts under the pieces and scores of a model file."""

    def __init__(self, path: str, n: int, remembered: int = REMEMBERED):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.remembered, ids = n, remembered, range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.piece = {model.id_to_piece(i): (i, model.get_score(i)) for i in normal}
                # Every beginning of a piece: its id and score, if it is a piece itself, and whether a longer piece begins with it.
        longer = {p[:i] for p in self.piece for i in range(1, len(p))}
        self.beginning = {p: (*self.piece.get(p, (None, 0.0)), p in longer) for p in longer.union(self.piece)}
        self.together = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.unknown = min(s for _, s in self.piece.values() if s > -1e8) - 10.0
        self.surface = [b""] * len(ids)
        for p, (i, _) in self.piece.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        # Characters by number, and the pairs that stand together.
        letters = sorted({c for p in self.piece for c in p})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.pairs = np.zeros((len(letters) + 1,) * 2, bool)
        for a, b in self.together:
            self.pairs[self.number[ord(a)], self.number[ord(b)]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.used, self.ids = 0, np.zeros(1 << 16, np.uint16 if len(self.surface) <= 1 << 16 else np.uint32)
        self.scores, self.spans, self.uses = np.zeros((1 << 12, self.n), np.float64), np.zeros((1 << 12, self.n, 2), np.int64), np.zeros(1 << 12, np.int32)

    def thin(self) -> None:
        """Keep what was used again since the last time, the most used half of what a worker may remember at most."""
        n = len(self.place)
        keep = np.flatnonzero(self.uses[:n] > 1)
        half = self.remembered // 2
        if len(keep) > half:
            keep = np.sort(keep[np.argpartition(-self.uses[keep], half)[:half]])
        names = list(self.place)  # in the order of their rows
        self.place = {names[r]: i for i, r in enumerate(keep.tolist())}
        size = max(1 << 12, 1 << int(len(keep)).bit_length())
        spans, scores, uses = np.zeros((size, self.n, 2), np.int64), np.zeros((size, self.n), np.float64), np.zeros(size, np.int32)
        begin, length = self.spans[keep].reshape(-1, 2).T
        ends = np.cumsum(length)
        self.used = int(ends[-1]) if len(ends) else 0
        ids = np.zeros(max(1 << 16, 1 << self.used.bit_length()), self.ids.dtype)
        ids[: self.used] = self.ids[np.arange(self.used) + np.repeat(begin - ends + length, length)]
        spans[: len(keep)] = np.stack([ends - length, length], axis=1).reshape(-1, self.n, 2)
        scores[: len(keep)], uses[: len(keep)] = self.scores[keep], self.uses[keep] // 2
        self.ids, self.spans, self.scores, self.uses = ids, spans, scores, uses

    def search(self, text: str) -> list[Path]:
        """The n best segmentations of a stretch of text, best first; among equal scores the first one found."""
        size, beginning = len(text), self.beginning
        ending: list[list[tuple]] = [[] for _ in range(size + 1)]
        best = [0.0] + [-np.inf] * size
        for i in range(size):
            here, alone = best[i], True
            for j in range(i + 1, size + 1):
                known = beginning.get(text[i:j])
                if known is None:
                    break
                found, value, more = known
                if found is not None:
                    ending[j].append((i, found, value))
                    if here + value > best[j]:
                        best[j] = here + value
                    if j == i + 1:
                        alone = False
                if not more:
                    break
            if alone:
                ending[i + 1].append((i, tuple(self.bytes[b] for b in text[i].encode()), self.unknown))
                best[i + 1] = max(best[i + 1], here + self.unknown)
        out: list[Path] = []
        # (minus the final score, order of arrival, position, score so far, pieces after it)
        queue: list[tuple] = [(-best[size], 0, size, 0.0, None)]
        # Final scores are exact, so each hypothesis is one segmentation: only the n best of all ever queued can come out.
        tops, n = [-best[size]], self.n
        arrival, pop, push = 0, heapq.heappop, heapq.heappush
        while queue:
            _, _, at, score, after = pop(queue)
            while at:  # follow the best way down, queue the others
                down, top = None, best[at]
                for start, found, value in ending[at]:
                    whole = best[start] + value
                    if down is None and whole == top:
                        down = start, score + value, (found, after)
                        continue
                    cost = -(score + value + best[start])
                    if len(tops) == n:
                        if cost >= tops[-1]:
                            continue
                        tops.pop()
                    bisect.insort(tops, cost)
                    arrival += 1
                    push(queue, (cost, arrival, start, score + value, (found, after)))
                at, score, after = down
            ids: list[int] = []
            while after:
                found, after = after
                ids.extend(found) if type(found) is tuple else ids.append(found)
            out.append((score, tuple(ids)))
            if len(out) == self.n:
                break
        return out

    def stretches(self, text: str) -> list[str]:
        """A text as the model sees it, cut at neighbours that no piece holds together."""
        if not text:
            return []
        shown = MARK + text.replace(" ", MARK)
        numbers = self.number[np.frombuffer(shown.encode("utf-32-le"), "<u4")]
        cuts = (np.flatnonzero(~self.pairs[numbers[:-1], numbers[1:]]) + 1).tolist()
        return [shown[a:b] for a, b in zip([0, *cuts], [*cuts, len(shown)])]

    def learn(self, stretches: set[str]) -> None:
        """Search stretches and keep their best lists, scores and ids, as rows of arrays."""
        new = list(stretches.difference(self.place))
        if len(self.place) + len(new) > self.remembered and self.place:
            self.thin()
            new = list(stretches.difference(self.place))
        row = len(self.place)
        while row + len(new) > len(self.spans):
            self.scores, self.spans, self.uses = (np.concatenate([x] * 2) for x in (self.scores, self.spans, self.uses))
        for stretch in new:
            found = self.search(stretch)
            self.uses[row] = 0
            self.scores[row] = [score for score, _ in found] + [-np.inf] * (self.n - len(found))
            for rank, (_, ids) in enumerate(found):
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids] * 2)
                self.ids[self.used : self.used + len(ids)] = ids
                self.spans[row, rank] = self.used, len(ids)
                self.used += len(ids)
            self.spans[row, len(found) :] = 0
            self.place[stretch] = row
            row += 1

    def best(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[float], list[np.ndarray]]]:
        """For each text: ids of its best segmentation, its n best scores, and the ids of each of these, the best first."""
        cut = [self.stretches(t) for t in texts]
        self.learn(set().union(*cut))
        for stretches in cut:
            if not stretches:
                none = np.zeros(0, self.ids.dtype)
                yield none, [0.0], [none]
                continue
            rows = np.fromiter(map(self.place.__getitem__, stretches), np.int64, len(stretches))
            self.uses[rows] += 1
            begin, size = self.spans[rows, 0].T
            ends = np.cumsum(size)
            ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]
            scores = self.scores[rows]
            total = float(scores[:, 0].sum())
            if self.n == 1:
                yield ids, [total], [ids]
                continue
            # A list of n needs no more than the n - 1 stretches whose second choice costs least.
            loss = scores[:, :1] - scores
            options: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])]
            for p in _least(loss[:, 1], self.n - 1):
                ranks = [(float(loss[p, r]), r) for r in range(self.n) if loss[p, r] < np.inf]
                options = heapq.nsmallest(self.n, ((c + l, w + [(int(p), r)] * (r > 0)) for c, w in options for l, r in ranks), key=lambda o: o[0])
            lists = []
            for _, changes in options:
                parts, at = [], 0
                for p, rank in sorted(changes):
                    other, n = self.spans[rows[p], rank]
                    parts += [ids[at : ends[p] - size[p]], self.ids[other : other + n]]
                    at = ends[p]
                lists.append(np.concatenate([*parts, ids[at:]]) if parts else ids)
            yield ids, [total - c for c, _ in options], lists

    def all_best(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text with their ids."""
        [(_, scores, lists)] = self.best([text])
        return [(s, ids.tolist()) for s, ids in zip(scores, lists)]

    def decode(self, ids) -> bytes:
        """The text of ids, without the space put in front; bytes that are no text stay as they are."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest values, equal ones in order."""
    n = min(n, len(values))
    edge = np.partition(values, n - 1)[n - 1]
    at = np.flatnonzero(values <= edge)
    return at[np.argsort(values[at], kind="stable")][:n]


_LOADED: dict[tuple[str, int, int], Segmenter] = {}


def segmenter(path: str, n: int, remembered: int) -> Segmenter:
    """The worker's segmenter for a model file."""
    key = path, n, remembered
    if key not in _LOADED:
        _LOADED[key] = Segmenter(*key)
    return _LOADED[key]


def _runs(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    for row, texts in pieces(batch, column, most):
        yield row, [(t or b"").decode() for t in texts]


def _offsets(lists: list) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_offsets(ids)), pa.array(np.concatenate(ids).astype(np.int32)))


def encoded(docs: DataFrame, model: str, n_best: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",), remembered: int = REMEMBERED) -> DataFrame:
    """The columns `keep`, `ids` (best segmentation), `scores` (n best, falling), `n_best_ids` (the ids of each of these)
    and `decoded`, the text that the ids give back.

    Null and empty texts have no ids, the one score 0 with an empty list of ids, and the empty text. A text has fewer scores than
    `n_best` only if it has fewer segmentations. Decoding gives the text back, but for U+2581, which
    the model cannot tell from a space. One row for every row of `docs`; no shuffle.
    """

    [own] = fresh(docs.select(*keep), "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = segmenter(model, n_best, remembered)
        for batch in batches:
            for row, texts in _runs(batch, own, 1 << 20):  # whole results are held, so fewer texts at a time
                part, ids, scores, every, back = batch.slice(row, len(texts)), [], [], [], []
                for best, top, lists in found.best(texts):
                    ids.append(best)
                    scores.append(top)
                    every.append(lists)
                    back.append(found.decode(best.tolist()).decode("utf-8", "replace"))
                nested = pa.ListArray.from_arrays(pa.array(_offsets(every)), _lists([x for lists in every for x in lists]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), _lists(ids), pa.array(scores, pa.list_(pa.float64())), nested, pa.array(back, pa.string())],
                    names=names,
                )

    source = docs.select(*keep, F.col(text).alias(own))
    names = [*keep, "ids", "scores", "n_best_ids", "decoded"]
    kinds = {"ids": "array<int>", "scores": "array<double>", "n_best_ids": "array<array<int>>", "decoded": "string"}
    schema = source.select(*keep, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).schema
    return source.mapInArrow(run, schema)


def digested(docs: DataFrame, model: str, n_best: int = 3, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_pieces, score, scores, ids_crc32, n_best_crc32, round_trip): what `encoded` finds, without carrying ids
    and texts out of the task. `ids_crc32` is over the best ids as little-endian unsigned 32-bit numbers, `n_best_crc32`
    has the same of each of the n best segmentations; `round_trip` says that decoding the ids gives the text (null: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = segmenter(model, n_best, remembered)
        for batch in batches:
            n, scores, crc, same = [], [], [], []  # crc: of each of the n best
            for _, texts in _runs(batch, "text"):
                for text, (best, top, lists) in zip(texts, found.best(texts)):
                    n.append(len(best))
                    scores.append(top)
                    crc.append([zlib.crc32(x.astype("<u4").tobytes()) for x in lists])
                    same.append(found.decode(best.tolist()) == text.replace(MARK, " ").encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([s[0] for s in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array([c[0] for c in crc], pa.int64()), pa.array(crc, pa.list_(pa.int64())), pa.array(same, pa.bool_())],
                names=["doc_id", "n_pieces", "score", "scores", "ids_crc32", "n_best_crc32", "round_trip"],
            )

    source = docs.select("doc_id", "text")
    kinds = {"n_pieces": "long", "score": "double", "scores": "array<double>", "ids_crc32": "long", "n_best_crc32": "array<long>", "round_trip": "boolean"}
    return source.mapInArrow(run, source.select("doc_id", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).schema)
