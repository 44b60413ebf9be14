"""Merkle manifest of a table: a tree of digests whose parents keep the hash states before each child.

A row is a leaf, the digest of its fields. Sixteen neighbouring digests, written as hex text, make a
parent. A digest in hex is exactly one block of SHA-256, so the state of the hash before child k is
eight 32-bit numbers: the *midstate*, which a parent keeps for each of its children. Replacing a child
resumes the midstate of its slot and takes in the replacement and the siblings on its right; those on
its left are never read again.

Every tree (a source) is cut into tiles of 16 ** `LEVELS` leaves by position. A task builds the levels
inside tiles; tile roots are the leaves of the next storey, and after few storeys one node is left.
Roots of trees, in order of the trees' names, make the root of all in the same way. Then every tile
gets its path to the root (midstate and children of each level above it), handed down storey by
storey, and leaves meet only the parents of their own tile and that path. So a source with a third of
all rows is many tiles, and no task sees more than one tile at a time.

Positions come from a range partitioning by (tree, order, digest) and the row counts of its parts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, positions, stored

#: Children of a parent, and levels inside a tile.
FAN, LEVELS = 16, 3
TILE = FAN**LEVELS
_ALL = "all"

# Fixed values of SHA-256: the fractional parts of the roots of the first primes.
_PRIMES = [p for p in range(2, 312) if all(p % d for d in range(2, int(p**0.5) + 1))]


def _root_bits(p: int, power: int) -> int:
    """The first 32 bits of the fraction of the square (2) or cube (3) root of p."""
    wanted, low, high = p << (32 * power), 0, 1 << 40
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= wanted else (low, middle)
    return low & 0xFFFFFFFF


_START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_ROUND = [np.uint32(_root_bits(p, 3)) for p in _PRIMES[:64]]
_HEX = np.array([int.from_bytes(b"%02x" % b, "big") for b in range(256)], np.uint32)
#: Blocks hashed side by side, so that the arrays of a round stay in the cache.
_ABREAST = 8192


def blocks(digests: np.ndarray) -> np.ndarray:
    """(16, n) words of the blocks that n raw digests make as hex text."""
    pairs = _HEX[digests]
    return np.ascontiguousarray(((pairs[:, 0::2] << np.uint32(16)) | pairs[:, 1::2]).T)


def absorb(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n) each."""
    n = states.shape[1]
    if n <= _ABREAST:
        return _absorb(states, words)
    return np.concatenate([_absorb(states[:, a : a + _ABREAST], words[:, a : a + _ABREAST]) for a in range(0, n, _ABREAST)], axis=1)


def _absorb(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    half, twice, other = np.uint64(32), np.empty(states.shape[1], np.uint64), np.empty(states.shape[1], np.uint64)

    def turned(x: np.ndarray, first: int, *more: int) -> np.ndarray:
        """The exclusive or of x turned right by each number, in 64 bits that hold x twice."""
        np.copyto(twice, x)
        np.left_shift(twice, half, out=other)
        np.bitwise_or(twice, other, out=twice)
        out = twice >> np.uint64(first)
        for k in more:
            np.right_shift(twice, np.uint64(k), out=other)
            np.bitwise_xor(out, other, out=out)
        return out.astype(np.uint32)

    w = list(words)
    for t in range(16, 64):
        one, two = turned(w[t - 15], 7, 18), turned(w[t - 2], 17, 19)
        one ^= w[t - 15] >> np.uint32(3)
        two ^= w[t - 2] >> np.uint32(10)
        one += two
        one += w[t - 16]
        one += w[t - 7]
        w.append(one)
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        one = turned(e, 6, 11, 25)
        one += g ^ (e & (f ^ g))
        one += h
        one += w[t]
        one += _ROUND[t]
        two = turned(a, 2, 13, 22)
        two += (a & b) ^ (c & (a ^ b))
        two += one
        one += d
        a, b, c, d, e, f, g, h = two, a, b, c, one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


def begun(n: int) -> np.ndarray:
    return np.repeat(_START[:, None], n, axis=1)


def finished(states: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Raw digests (n, 32) of states that took `taken` whole blocks."""
    bits = np.broadcast_to(np.asarray(taken, np.uint64), states.shape[1:]) * np.uint64(512)
    last = np.zeros((16, states.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[14], last[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return np.ascontiguousarray(absorb(states, last).T).astype(">u4").view(np.uint8).reshape(-1, 32)


@dataclass
class Level:
    """Parents of one level: children (r, 16, 32), midstate before each child (r, 16, 8), number of children (r,)."""

    children: np.ndarray
    midstates: np.ndarray
    size: np.ndarray

    @staticmethod
    def over(digests: np.ndarray) -> tuple[Level, np.ndarray]:
        """The level above neighbouring digests, and the digests of its parents."""
        runs = -(-len(digests) // FAN)
        children = np.zeros((runs, FAN, 32), np.uint8)
        children.reshape(-1, 32)[: len(digests)] = digests
        size = np.full(runs, FAN, np.int64)
        size[-1] = len(digests) - FAN * (runs - 1)
        midstates, state = np.zeros((runs, FAN, 8), np.uint32), begun(runs)
        for slot in range(FAN):
            here = np.flatnonzero(size > slot)
            midstates[here, slot] = state[:, here].T
            state[:, here] = absorb(state[:, here], blocks(children[here, slot]))
        return Level(children, midstates, size), finished(state, size)

    def resumed(self, run: np.ndarray, slot: np.ndarray, replacement: np.ndarray) -> np.ndarray:
        """Digests of parents in which one child is replaced: from its midstate over it and what is on its right."""
        size = self.size[run]
        state = absorb(np.ascontiguousarray(self.midstates[run, slot].T), blocks(replacement))
        for step in range(1, FAN):
            here = np.flatnonzero(slot + step < size)
            if not len(here):
                break
            state[:, here] = absorb(state[:, here], blocks(self.children[run[here], slot[here] + step]))
        return finished(state, size)

    def texts(self) -> list[bytes]:
        """The children of each parent as hex text."""
        return [c[:n].tobytes().hex().encode() for c, n in zip(self.children, self.size)]


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


#: One level of a path, as bytes.
_STEP = np.dtype([("size", "<i8"), ("slot", "<i8"), ("midstate", "<u4", 8), ("children", "u1", (FAN, 32))])


def _steps(path: bytes) -> list[tuple[Level, int]]:
    return [(Level(s["children"][None], _placed(s), s["size"][None]), int(s["slot"])) for s in np.frombuffer(path, _STEP)]


def _placed(step: np.void) -> np.ndarray:
    out = np.zeros((1, FAN, 8), np.uint32)
    out[0, int(step["slot"])] = step["midstate"]
    return out


def _raw(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, 32)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    fixed = pa.binary(flat[:1].nbytes or 32)
    return pa.FixedSizeBinaryArray.from_buffers(fixed, len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


_PARENTS = "tree string, tile long, n long, level int, run long, size long, children binary, midstates binary, digest binary, top boolean"


def _storey(nodes: DataFrame) -> DataFrame:
    """Parents inside the tiles of nodes (tree, pos, n, digest); `top` marks the root of a tile."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        tree, tile = (k.as_py() for k in key)
        rows = rows.sort_by("pos")
        n, digests, out = rows["n"][0].as_py(), _raw(rows["digest"]), []
        for level in range(min(LEVELS, height(n))):
            parents, digests = Level.over(digests)
            out.append((level, parents, digests))
        count = sum(len(d) for _, _, d in out)
        get = lambda pick: np.concatenate([pick(*x) for x in out])
        return pa.table(
            {
                "tree": pa.array([tree] * count, pa.string()),
                "tile": pa.array(np.full(count, tile, np.int64)),
                "n": pa.array(np.full(count, n, np.int64)),
                "level": pa.array(get(lambda l, p, d: np.full(len(d), l, np.int32))),
                "run": pa.array(get(lambda l, p, d: np.arange(len(d)))),
                "size": pa.array(get(lambda l, p, d: p.size)),
                "children": _binary(get(lambda l, p, d: p.children)),
                "midstates": _binary(get(lambda l, p, d: p.midstates)),
                "digest": _binary(get(lambda l, p, d: d)),
                "top": pa.array(get(lambda l, p, d: np.full(len(d), l == out[-1][0]))),
            }
        )

    # a tree of one node has nothing above it
    return nodes.where("n > 1").withColumn("tile", _tile("pos")).select("tree", "tile", "pos", "n", "digest").groupBy("tree", "tile").applyInArrow(build, _PARENTS)


def _tile(pos: str) -> Column:
    return F.floor(F.col(pos) / TILE).cast("long")


def _levels(parents: pa.Table) -> list[Level]:
    out = []
    for level in range(LEVELS):
        here = parents.filter(pc.equal(parents["level"], level)).sort_by("run")
        if here.num_rows:
            children = np.frombuffer(b"".join(here["children"].to_pylist()), np.uint8).reshape(-1, FAN, 32)
            midstates = np.frombuffer(b"".join(here["midstates"].to_pylist()), np.uint32).reshape(-1, FAN, 8)
            out.append(Level(children, midstates, np.asarray(here["size"], np.int64)))
    return out


def _storeys(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All storeys above nodes (tree, pos, n, digest), the lowest first, and (tree, digest) of the roots."""
    spark = nodes.sparkSession
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots, out = [nodes.where("n = 1").select("tree", "digest")], []
    while most > 1:
        parents = stored(spark, _storey(nodes), "parents")
        out.append(parents)
        above = F.ceil(F.col("n") / TILE).cast("long")
        nodes = parents.where("top").select("tree", F.col("tile").alias("pos"), above.alias("n"), "digest")
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most // TILE)
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionByName(more)
    return out, whole


_PATHS = "tree string, pos long, path binary"


def _hand(key: tuple, parents: pa.Table, over: pa.Table) -> pa.Table:
    """The path of every child of a tile: its levels inside the tile, then the path of the tile."""
    if not parents.num_rows:
        return pa.table({"tree": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), "path": pa.array([], pa.binary())})
    tree, tile = (k.as_py() for k in key)
    levels, rest = _levels(parents), over["path"][0].as_py()
    at = np.arange(int(levels[0].size.sum()))
    run, steps = at, np.zeros((len(at), len(levels)), _STEP)
    for depth, level in enumerate(levels):
        run, slot = run // FAN, run % FAN
        steps[:, depth]["size"], steps[:, depth]["slot"] = level.size[run], slot
        steps[:, depth]["midstate"], steps[:, depth]["children"] = level.midstates[run, slot], level.children[run]
    return pa.table({"tree": pa.array([tree] * len(at), pa.string()), "pos": pa.array(at + tile * TILE), "path": pa.array([s.tobytes() + rest for s in steps], pa.binary())})


def _of_children(parents: DataFrame, tiles: DataFrame) -> DataFrame:
    return parents.groupBy("tree", "tile").cogroup(apart(tiles).groupBy("tree", "tile")).applyInArrow(_hand, _PATHS)


def _of_tiles(storeys: list[DataFrame], trees: DataFrame) -> DataFrame:
    """(tree, tile, path) of the tiles of the lowest storey from (tree, path) of the trees, handed down storey by storey.

    Trees end in different storeys: a tile that is its tree's last has the path of the tree.
    """
    known = None
    for parents in reversed(storeys):
        last = parents.where(F.col("top") & (F.col("n") <= TILE)).select("tree", "tile").join(trees, "tree").select("tree", "tile", "path")
        if known is None:
            known = last
        else:
            known = last.unionByName(_of_children(above, known).select("tree", F.col("pos").alias("tile"), "path"))
        above = parents
    return known


def leaf(columns: list[Column]) -> Column:
    """The digest of fields: each `-` if null, else its UTF-8 byte count, a colon and its value."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


#: Marks the row of a tile that holds its path, among the rows of its parents.
_PATH = -1
_FOLDED = "doc_id long, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary"


def _proofs(at: np.ndarray, inside: list[Level], outside: list[tuple[Level, int]]) -> pa.Array:
    """The digest of the siblings of each leaf, level by level, left to right."""
    texts = [level.texts() for level in inside]
    above = [(level.texts()[0], 64 * slot) for level, slot in outside]
    rest = b"".join(text[:k] + text[k + 64 :] for text, k in above)
    out = []
    for place in at.tolist():
        proof = hashlib.sha256()
        for level in texts:
            place, slot = divmod(place, FAN)
            text = level[place]
            proof.update(text[: 64 * slot])
            proof.update(text[64 * slot + 64 :])
        proof.update(rest)
        out.append(proof.digest())
    return pa.array(out, pa.binary())


def _fold(key: tuple, rows: pa.Table, around: pa.Table) -> pa.Table:
    """The leaves of a tile, their proofs, and the root with each replaced."""
    names = [f.split()[0] for f in _FOLDED.split(", ")]
    if not rows.num_rows:
        return pa.table({c: pa.array([], pa.int64() if c == "doc_id" else pa.binary()) for c in names})
    path = around.filter(pc.equal(around["level"], _PATH))["children"][0].as_py()
    folded = _raw(pc.coalesce(rows["replaced"], rows["digest"]))
    at = np.asarray(rows["pos"], np.int64) % TILE
    inside, outside = _levels(around), _steps(path[:-32])
    proofs = _proofs(at, inside, outside)
    for level, fixed in [*((x, None) for x in inside), *outside]:
        run, slot = (at // FAN, at % FAN) if fixed is None else (np.zeros_like(at), np.full_like(at, fixed))
        folded = level.resumed(run, slot, folded)
        at = at // FAN
    root = path[-32:]
    if outside:  # what the parent on top has
        level, slot = outside[-1]
        root = level.resumed(np.zeros(1, np.int64), np.full(1, slot), level.children[0, slot][None]).tobytes()
    same = lambda x: pa.array([x] * len(at), pa.binary())
    return pa.table([rows["doc_id"], rows["digest"], same(path[-32:]), same(root), proofs, _binary(folded)], names=names)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changes: dict[str, Column] | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) for every row of `docs`, digests in hex.

    `fields` are the columns a leaf hashes; `doc_id` and `source` of `docs` place it. Where `changed`
    holds, the leaf is replaced by that of the row with `changes` (field: column) and folded into the
    root; other rows fold their own leaf. Nulls are hashed as `-`; a null source is a tree of its own
    and comes first, as does a null doc_id within its source. Rows that repeat a doc_id are leaves of
    their own, in the order of their digests. Texts are hashed whole, wherever they are read. Other
    columns of `docs` are not touched. No rows: no result rows.
    """
    spark = docs.sparkSession
    own = leaf([docs[f] for f in fields])
    other = leaf([(changes or {}).get(f, docs[f]) for f in fields])
    replaced = F.when(F.coalesce(changed, F.lit(False)), other) if changed is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("-"))  # "-" sorts before "="
    leaves = docs.select(docs["doc_id"].cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(own).alias("digest"), F.unhex(replaced).alias("replaced"))
    placed = stored(spark, positions(stored(spark, leaves, "leaves"), [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]), "placed")
    storeys, subroots = _storeys(placed.select("tree", "pos", "n", "digest"))
    subroots = stored(spark, subroots, "subroots")
    # The trees' roots are the leaves of the tree of all.
    named = positions(subroots.select(F.lit(_ALL).alias("tree"), F.col("tree").alias("name"), "digest"), [F.col("name").asc()])
    named = stored(spark, named, "named")
    upper, _ = _storeys(named.select("tree", "pos", "n", "digest"))
    nothing = F.unhex(F.lit("")).alias("path")
    if upper:
        tops = _of_tiles(upper, named.select("tree").limit(1).select("tree", nothing))
        paths = named.join(_of_children(upper[0], tops).select("pos", "path"), "pos")
    else:
        paths = named.withColumn("path", nothing)
    # A path ends with the subroot of its tree.
    paths = stored(spark, paths.select(F.col("name").alias("tree"), F.concat("path", "digest").alias("path")), "paths")
    # A tree of one leaf has no parents: its leaf has the path of the tree.
    over = placed.where("n = 1").select("tree").join(paths, "tree").select("tree", F.lit(0).cast("long").alias("tile"), "path")
    if storeys:
        over = over.unionByName(_of_tiles(storeys, paths))
    number = F.lit(0).cast("long")
    parents = over.select("tree", "tile", F.lit(_PATH).alias("level"), number.alias("run"), number.alias("size"), F.col("path").alias("children"), nothing.alias("midstates"))
    if storeys:
        parents = parents.unionByName(storeys[0].select(*parents.columns))
    rows = placed.select("doc_id", "tree", _tile("pos").alias("tile"), "pos", "digest", "replaced")

    folded = rows.groupBy("tree", "tile").cogroup(apart(parents).groupBy("tree", "tile")).applyInArrow(_fold, _FOLDED)
    shown = folded.select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
