"""Small per-row helpers for what JVM expressions cannot say: strict JSON and greedy scans.

They run inside Arrow-batched pandas UDFs; a caller passes NULL for rows that need no look.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: its helpers travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_DEPTH = 64
NAME = "Agenttrace"  # heads every readable rendering


class Duplicate(ValueError):
    """A JSON object repeats a key."""


def _no_constant(name: str):
    raise ValueError(name)


def _unique(pairs):
    found = dict(pairs)
    if len(found) != len(pairs):
        raise Duplicate()
    return found


class _Decoder(json.JSONDecoder):
    """A decoder that is made once, and again where it travels to."""

    def __init__(self, unique: bool = False):
        self.unique = unique
        super().__init__(parse_constant=_no_constant, object_pairs_hook=_unique if unique else None)

    def __reduce__(self):
        return _Decoder, (self.unique,)


_LOOSE, _STRICT = _Decoder(), _Decoder(unique=True)


def strict(text: str, unique: bool = False):
    """Parse exactly one JSON document; NaN and Infinity are not JSON."""
    return (_STRICT if unique else _LOOSE).decode(text)


_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_CLOSING = {"{": "}", "[": "]", '"': '"'}


def _may_be_value(text: str) -> bool:
    """Whether a text without white space around it ends as the JSON value does that it begins as."""
    closing = _CLOSING.get(text[:1])
    return text[-1] == closing if closing else text in ("true", "false", "null") or _NUMBER.fullmatch(text) is not None


_COMPACT = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def compact(value) -> str:
    """Compact rendering with keys in sorted order."""
    return _COMPACT.encode(value)


def depth(value) -> int:
    """Container nesting: 0 for a scalar, 1 for a flat container."""
    deepest, level = 0, [value] if isinstance(value, (dict, list)) else []
    while level:
        deepest += 1
        children = chain.from_iterable(v.values() if isinstance(v, dict) else v for v in level)
        level = [v for v in children if v.__class__ is dict or v.__class__ is list]
    return deepest


def _row(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _LONG, _INT, _FLAG = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
FACTS = _row(
    document=_FLAG, too_deep=_FLAG, items=_LONG, depth=_INT, line_values=_LONG, line_containers=_LONG, line_depth=_INT
)
CANDIDATE = _row(candidate=_TEXT, failure=_TEXT)


def document_facts(text: str) -> tuple | None:
    """Facts of a text that is one JSON document."""
    if not _may_be_value(text.strip(" \t\n\r")):
        return None
    try:
        value = strict(text)
        nested = depth(value)
    except (ValueError, RecursionError):
        return None
    return True, nested > MAX_DEPTH, len(value) if isinstance(value, (dict, list)) else 1, nested, 0, 0, 0


def line_facts(text: str) -> tuple[int, int, int]:
    """JSON values among the lines of a text, containers among them and how deep these are."""
    values = containers = deepest = 0
    for line in text.split("\n"):
        line = line.strip()
        if not line or not _may_be_value(line):
            continue
        try:
            value = strict(line)
        except (ValueError, RecursionError):
            continue
        values += 1
        if line[0] in "{[":
            containers += 1
            deepest = max(deepest, depth(value))
    return values, containers, deepest


def _facts(text: str):
    return document_facts(text) or (False, False, None, None, *line_facts(text))


@F.pandas_udf(FACTS)
def json_facts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Whether a text is one JSON document or JSON lines, with item counts and depth."""
    names = FACTS.names
    for batch in texts:
        rows = [_facts(t) if isinstance(t, str) else (None,) * 7 for t in batch]
        frame = pd.DataFrame(rows, columns=names, dtype=object)
        yield frame


# --- JSON candidates -----------------------------------------------------------------------------


def _uniform(value):
    """Rows and key order of a uniform array of objects, or None."""
    if not isinstance(value, list) or len(value) < 2 or not isinstance(value[0], dict) or not value[0]:
        return None
    keys = sorted(value[0])
    if any(not isinstance(row, dict) or row.keys() != value[0].keys() for row in value):
        return None
    return keys, [[row[k] for k in keys] for row in value]


def tabular(value):
    shaped = _uniform(value)
    return None if shaped is None else compact(["table2", *shaped])


def readable(value, style: str):
    shaped = _uniform(value)
    if shaped is None:
        return None
    keys, rows = shaped
    if style == "table":
        body = ["fields\t" + compact(keys)] + ["row\t" + compact(r) for r in rows]
        return f"{NAME} table v1\n" + "\n".join(body) + "\n"
    if style == "records":
        return f"{NAME} records v1\nfields: {compact(keys)}\n" + "".join(compact(r) + "\n" for r in rows)
    head = "fields(" + ",".join(compact(k) for k in keys) + "): \n"
    return f"{NAME} key-elision v1\n" + head + "".join(
        f"({compact(r)[1:-1]})\n" for r in rows  # a row as a list, without its brackets
    )


def subtrees(value):
    """Containers occurring more than once (8 bytes or more) become references to definitions."""
    counts: dict[str, int] = {}

    def count(node):
        if isinstance(node, (dict, list)):
            for child in node.values() if isinstance(node, dict) else node:
                count(child)
            key = compact(node)
            counts[key] = counts.get(key, 0) + 1

    count(value)
    defined = sorted(k for k, n in counts.items() if n > 1 and len(k.encode()) >= 8)
    if not defined:
        return None
    places = {k: i for i, k in enumerate(defined)}

    def factor(node, root=False):
        if not isinstance(node, (dict, list)):
            return node
        if not root and compact(node) in places:
            return ["$same_as", places[compact(node)]]
        if isinstance(node, dict):
            return {k: factor(v) for k, v in node.items()}
        return [factor(v) for v in node]

    return compact(["shared3", [json.loads(k) for k in defined], factor(value, True)])


def without_empty(value):
    """Drop object fields that are null, "", [] or {}; a child emptied by this stays."""
    if isinstance(value, dict):
        return {k: without_empty(v) for k, v in value.items() if v is not None and v != "" and v != [] and v != {}}
    if isinstance(value, list):
        return [without_empty(v) for v in value]
    return value


def common_values(value):
    """Scalar fields equal in every row move to `common`."""
    if not isinstance(value, list) or len(value) < 2 or not isinstance(value[0], dict) or not value[0]:
        return None
    first = value[0]
    if any(not isinstance(row, dict) for row in value) or any(row.keys() != first.keys() for row in value):
        return None
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool) and isinstance(a, float) == isinstance(b, float)
    shared = {
        k: v for k, v in first.items()
        if not isinstance(v, (dict, list)) and all(same(row[k], v) for row in value)
    }
    if not shared:
        return None
    return compact({"common": shared, "rows": [{k: v for k, v in row.items() if k not in shared} for row in value]})


HEAD_LINES = TAIL_LINES = 24


def shell_projection(value):
    """Head and tail of a long shell output inside its JSON envelope."""
    if not isinstance(value, dict) or ("exit_code" not in value and "status" not in value):
        return None
    key = next((k for k in ("stdout", "output") if isinstance(value.get(k), str) and "\n" in value[k]), None)
    if key is None:
        return None
    lines = value[key].split("\n")
    omitted = len(lines) - HEAD_LINES - TAIL_LINES
    if omitted <= 1:
        return None
    marker = f"[{NAME} omitted {omitted} output lines; local recovery is available]"
    return compact({**value, key: "\n".join([*lines[:HEAD_LINES], marker, *lines[-TAIL_LINES:]])})


def _json_candidate(text: str, candidate: str):
    loose = candidate == "json.empty_noise_fields"
    try:
        value = strict(text, unique=not loose)
    except Duplicate:
        return None, "not_applicable"
    except (ValueError, RecursionError):
        return None, "invalid_input"
    out = {
        "json.tabular": lambda: tabular(value),
        "json.readable_table": lambda: readable(value, "table"),
        "json.compact_records": lambda: readable(value, "records"),
        "json.key_elision": lambda: readable(value, "elision"),
        "json.repeated_subtree": lambda: subtrees(value),
        "json.empty_noise_fields": lambda: compact(without_empty(value)),
        "json.repeated_value_elision": lambda: common_values(value),
        "shell.diagnostic_projection": lambda: shell_projection(value),
    }[candidate]()
    return out, None if out is not None else "not_applicable"


# --- text candidates -------------------------------------------------------------------------------


def block_runs(lines: list[str]):
    """Cover of the lines by repeated patterns of 2 to 8 lines: from each place on, the pattern over the most lines.

    For each pattern size, line i is compared with line i + size once; the length of the run of equal
    pairs from a place gives the repeats there.
    """
    n = len(lines)
    ids = pd.factorize(pd.Series(lines, dtype=object))[0] if n else np.zeros(0, int)
    covered, repeats = np.ones(n, int), {1: np.ones(n, int)}
    sizes = np.ones(n, int)
    for size in range(2, 9):
        if 2 * size > n:
            break
        equal = ids[:-size] == ids[size:]
        stop = np.flatnonzero(np.append(~equal, True))
        run = stop[np.searchsorted(stop, np.arange(len(equal)))] - np.arange(len(equal))
        repeats[size] = np.pad(run // size + 1, (0, size), constant_values=1)
        gain = np.where(repeats[size] > 1, size * repeats[size], 0)
        sizes, covered = np.where(gain > covered, size, sizes), np.maximum(covered, gain)
    at = 0
    while at < n:
        size = int(sizes[at])
        yield int(repeats[size][at]), lines[at : at + size]
        at += int(covered[at])


def block_fold(text: str):
    runs = list(block_runs(_split_kept(text)))
    if not any(times > 1 for times, _ in runs):
        return None
    head = lambda times: f"repeat={times} lines=" if times > 1 else "lines="
    return f"{NAME} block-fold v1\n" + "".join(head(n) + compact(lines) + "\n" for n, lines in runs)


def _split_kept(text: str) -> list[str]:
    parts = text.split("\n")
    kept = [p + "\n" for p in parts[:-1]]
    return kept + [parts[-1]] if parts[-1] else kept


@F.pandas_udf(CANDIDATE)
def structured_candidate(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(text, candidate id) -> candidate text, or why there is none."""
    for texts, ids in parts:
        rows = []
        for text, name in zip(texts, ids):
            if not isinstance(text, str):
                rows.append((None, None))
            elif name == "text.readable_block_fold":
                folded = block_fold(text)
                rows.append((folded, None if folded is not None else "not_applicable"))
            else:
                rows.append(_json_candidate(text, name))
        yield pd.DataFrame(rows, columns=["candidate", "failure"])


# --- search output -----------------------------------------------------------------------------------

MATCHES = _row(matches=T.ArrayType(_row(file=_TEXT, line=_LONG, text=_TEXT)), leftovers=T.ArrayType(_TEXT))


_HEADING = re.compile(r"[^ ]+:")
_UNDER_HEADING = re.compile(r"\+?([0-9]+)\t(.*)", re.DOTALL)
_PLAIN = re.compile(r"([^:]*):\+?([0-9]+):(.*)", re.DOTALL)
_JSON_START = re.compile(r"\s*[{\[\"\-0-9tfn]")
_QUIET_EVENTS = {"begin", "end", "summary"}


class _Malformed(Exception):
    """A match event without its fields: the text is no search output."""


def _grouped_lines(text: str) -> list[tuple[str | None, str]]:
    """Lines that carry something, each with the heading it stands under."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    lines = [x for x in lines if x and x != "[search results]"]
    is_heading = [bool(_HEADING.fullmatch(x)) for x in lines]
    headings = accumulate(zip(lines, is_heading), lambda h, x: x[0][:-1] if x[1] else h, initial="")
    return [(h or None, x) for h, x, own in zip(islice(headings, 1, None), lines, is_heading) if not own]


def _json_line(line: str) -> tuple[list, list] | None:
    """(matches, leftovers) of a line that is a JSON value."""
    if not _JSON_START.match(line):
        return None
    try:
        value = strict(line)
    except (ValueError, RecursionError):
        return None
    kind = value.get("type") if isinstance(value, dict) else None
    if kind != "match":
        return [], [] if kind in _QUIET_EVENTS else ["structured_event"]
    try:
        data = value["data"]
        file, number, body = data["path"]["text"], data["line_number"], data["lines"]["text"].rstrip("\r\n")
    except (KeyError, TypeError, AttributeError) as error:
        raise _Malformed from error
    if not isinstance(file, str) or not isinstance(number, int) or number < 0:
        raise _Malformed
    return [(file, number, body)], []


def _read_line(heading: str | None, line: str) -> tuple[list, list]:
    under = _UNDER_HEADING.fullmatch(line) if heading is not None else None
    if under:
        return [(heading, int(under[1]), under[2].replace("\\n", "\n"))], []
    value = _json_line(line)
    if value is not None:
        return value
    plain = _PLAIN.fullmatch(line)
    return ([(plain[1], int(plain[2]), plain[3])], []) if plain else ([], [line])


def parse_search(text: str):
    """Matches and other lines of `path:line:text`, grouped or JSON-lines search output."""
    try:
        read = [_read_line(h, x) for h, x in _grouped_lines(text)]
    except _Malformed:
        return None
    matches = sorted(m for found, _ in read for m in found)
    return (matches, [x for _, rest in read for x in rest]) if matches else None


# Paths that begin so are no JSON, and a line that ends in a colon may be a heading.
_PLAIN_LINE = r"[A-Za-z_./][^:\r\n]*:\+?[0-9]{1,18}:[^\r\n]*[^:\r\n]"
_ALL_PLAIN = rf"\A(?:{_PLAIN_LINE}\n)*{_PLAIN_LINE}\n?\z"
_PARTS = r"(?s)\A(?P<file>[^:]*):\+?(?P<line>[0-9]+):(?P<text>.*)\z"
_MATCH = pa.struct([("file", pa.string()), ("line", pa.int64()), ("text", pa.string())])


def are_plain(texts: pa.Array) -> np.ndarray:
    """Texts of nothing but plain matches, which need no parser."""
    return pc.fill_null(pc.match_substring_regex(texts, _ALL_PLAIN), False).to_numpy(zero_copy_only=False)


def plain_matches(texts: pa.Array) -> pa.ListArray:
    """Sorted matches of such texts, read as columns."""
    lists = pc.split_pattern(pc.utf8_rtrim(texts, "\n"), "\n")
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    parts = pc.extract_regex(lists.flatten(), _PARTS)
    columns = {"file": parts.field("file"), "line": parts.field("line").cast(pa.int64()), "text": parts.field("text")}
    table = pa.table({"of": np.repeat(np.arange(len(texts)), np.diff(ends)), **columns})
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names])).combine_chunks()
    values = pa.StructArray.from_arrays([pa.concat_arrays(table[f.name].chunks).cast(f.type) if table.num_rows else pa.array([], f.type) for f in _MATCH], fields=list(_MATCH))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


@F.arrow_udf(MATCHES)
def search_matches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts to their matches and other lines; null where there is no search output."""
    for batch in texts:
        batch = batch.cast(pa.string())
        plain = are_plain(batch)
        rest = np.flatnonzero(~plain)
        found = [parse_search(t) if t is not None else None for t in batch.take(pa.array(rest)).to_pylist()]
        parsed = [None if f is None else [dict(zip(("file", "line", "text"), m)) for m in f[0]] for f in found]
        matches = pa.concat_arrays([plain_matches(batch.filter(pa.array(plain))), pa.array(parsed, pa.list_(_MATCH)).cast(pa.list_(_MATCH))])
        left = pa.array([[]] * int(plain.sum()) + [None if f is None else f[1] for f in found], pa.list_(pa.string()))
        back = pa.array(np.argsort(np.append(np.flatnonzero(plain), rest), kind="stable"))
        yield pa.StructArray.from_arrays([matches.take(back), left.take(back)], ["matches", "leftovers"])


def render_search(matches) -> str:
    """Matches grouped by file under a fixed header."""
    out, last = ["[search results]\n"], None
    for file, number, text in matches:
        if file != last:
            out.append(f"{file}:\n")
            last = file
        escaped = text.replace("\n", "\\n")
        out.append(f"{number}\t{escaped}\n")
    return "".join(out)


# --- JSON shape ---------------------------------------------------------------------------------------

SHAPE = _row(
    root_kind=_TEXT, array_length=_LONG, key_count=_LONG, homogeneity_bp=_LONG, primitive_bp=_LONG, nested_bp=_LONG
)


def _shape(text: str):
    try:
        value = strict(text)
    except (ValueError, RecursionError):
        return (None,) * 6
    share = lambda part, whole: part * 10000 // whole if whole else 0
    if isinstance(value, dict):
        return "object", None, len(value), None, None, None
    if isinstance(value, list):
        size = len(value)
        if all(isinstance(v, dict) for v in value):
            keys = value[0].keys() if value else ()
            same = sum(v.keys() == keys for v in value)
            cells = [isinstance(c, (dict, list)) for v in value for c in v.values()]
            nested = sum(cells)
            return ("array_object", size, len(keys), share(same, size),
                    share(len(cells) - nested, len(cells)), share(nested, len(cells)))
        containers = sum(isinstance(v, (dict, list)) for v in value)
        kind = "array_nested" if containers == size else "array_scalar" if containers == 0 else "array_heterogeneous"
        return kind, size, None, None, None, None
    kind = {str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    return kind, None, None, None, None, None


@F.arrow_udf(SHAPE)
def json_shape(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Shape of each JSON text; null fields for null."""
    for batch in texts:
        rows = [(None,) * 6 if t is None else _shape(t) for t in (x.as_py() for x in batch)]
        kinds = [pa.string() if f.dataType == _TEXT else pa.int64() for f in SHAPE]
        columns = zip(*rows) if rows else [()] * 6
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SHAPE.names)


def _envelope(text: str):
    """Search output inside exactly one string of a JSON document; the rest stays byte for byte."""
    try:
        strict(text)
    except (ValueError, RecursionError):
        return None, "not_applicable"
    tokens = list(re.finditer(r'"(?:[^"\\]|\\.)*"', text))
    hits = [(m, found) for m in tokens if (found := parse_search(json.loads(m.group()))) is not None]
    if len(hits) != 1:
        return None, "not_applicable"
    match, found = hits[0]
    view = json.dumps(render_search(found[0]), ensure_ascii=False)
    if len(view.encode()) >= len(match.group().encode()):
        return None, "not_applicable"
    if len(found[0]) < 2:
        return None, "no_improvement"
    return text[: match.start()] + view + text[match.end():], None


@F.pandas_udf(CANDIDATE)
def search_view(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Grouped view of search output, plain or inside a JSON envelope."""
    for batch in texts:
        rows = []
        for text in batch:
            found = parse_search(text) if isinstance(text, str) else None
            if not isinstance(text, str):
                rows.append((None, None))
            elif found is None:
                rows.append(_envelope(text))
            elif len(found[0]) < 2:
                rows.append((None, "no_improvement"))
            else:
                rows.append((render_search(found[0]), None))
        yield pd.DataFrame(rows, columns=["candidate", "failure"])
