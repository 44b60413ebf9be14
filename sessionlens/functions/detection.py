"""Content kind of texts, told from whole Arrow batches: bytes are looked at as arrays, and a pattern sees only lines that
can match it. Rules are asked in their precedence, each on the texts that no earlier one has named."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .jsontext import document_facts, line_facts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text looked at together, so that what is derived from them takes some 50 MB.
PIECE = 1 << 20

FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("confidence", T.StringType())])
VERDICTS = (
    "unknown/low", "binary_like/high", "binary_like/medium", "json/high", "ndjson/high", "ndjson/medium", "diff/high", "diff/medium",
    "test_results/high", "test_results/medium", "search_results/high", "search_results/medium", "log/high", "log/medium",
    "source_code/high", "source_code/medium", "plain_text/medium",
)
CODES = {name: code for code, name in enumerate(VERDICTS)}

# Java's \s, the same without the newline, and Java's $ where only the last line of a text lacks its newline.
_S, _B, _N, _END = r"[ \t\n\x{0B}\f\r]", r"[ \t\x{0B}\f\r]", r"[^ \t\n\x{0B}\f\r]", r"[\x{85}\x{2028}\x{2029}]?\z"
_EOL = rf"(?:\n|{_END})"
MAY_BE_JSON = rf'\A{_S}*(?:[\[{{"]|-?[0-9]|(?:true|false|null){_S}*{_END})'
# A line that can be a JSON object or array once white space of any kind around it is gone.
_U = r"[ \t\x{0B}\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CONTAINER = rf"\A{_U}*(?:\{{[^\n]*\}}|\[[^\n]*\]){_U}*\n?\z"


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _flat_documents(levels: int) -> str:
    """JSON documents of so many levels of containers at most, with whole numbers of up to 18 digits."""
    blank = r"[ \t\n\r]*"
    string = r'"(?:[^"\\\x{00}-\x{1F}]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"'
    scalar = value = string + r"|-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null"
    for _ in range(levels):
        field = f"{string}{blank}:{blank}(?:{value}){blank}"
        item = f"(?:{value}){blank}"
        value = rf"{scalar}|\{{{blank}(?:{field}(?:,{blank}{field})*)?\}}|\[{blank}(?:{item}(?:,{blank}{item})*)?\]"
    return rf"\A{blank}(?:{value}){blank}\z"


FLAT_DOCUMENT = _flat_documents(2)


def _started(prefixes) -> str:
    closed, spaced = [p for p in prefixes if not p.endswith(" ")], [p for p in prefixes if p.endswith(" ")]
    return rf"\A{_B}*" + _any([*closed, *([_any(spaced) + rf"[^\n]*{_N}"] if spaced else [])])


# The line patterns of `text.LINE_PATTERNS` for one line with its newline, in the syntax of Arrow's matcher.
LINES = {
    "diff_headers": rf"\A{_B}*(?:diff --git |Index: )[^\n]*{_N}",
    "diff_old_files": rf"\A{_B}*--- [^\n]*{_N}",
    "diff_new_files": rf"\A{_B}*\+\+\+ [^\n]*{_N}",
    "diff_hunks": rf"\A{_B}*@@(?:[^\n]*-[^\n]*@@|[^\n]*@@[^\n]*-)",
    "timestamps": rf"\A{_B}*[\[(]?(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt _][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}|[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})",
    "levels": rf"(?:\A|[^A-Za-z]){_any(tx.LOG_LEVELS)}(?:[^A-Za-z]|\z)|\A{_B}*(?:error|warning|note)[:\[]",
    "path_lines": rf"\A{_B}*(?:(?:[^ \t\n\x{{0B}}\f\r:/-][^ \t\n\x{{0B}}\f\r:/]*)?/[^ \t\n\x{{0B}}\f\r:]*"
    rf"|[^ \t\n\x{{0B}}\f\r:-][^ \t\n\x{{0B}}\f\r:]*\.[A-Za-z][A-Za-z0-9]{{0,7}}):[0-9]+(?:[: \t\n\x{{0B}}\f\r]|{_END})",
    "test_markers": rf"\A{_B}*(?:test [^\n]*(?: \.\.\. [^\n]*{_N}| ok{_B}*{_EOL})|{_any(tx.TEST_PREFIXES)}|{_any(tx.TEST_WORDS)}[^\n]*{_N}"
    rf"|{_N}[^\n]* (?:PASSED|FAILED))",
    "test_summaries": rf"\A{_B}*(?:test result:|Tests run:|OK \(|FAILED \(|Ran [^\n]*{_N}|running [^\n]* tests{_B}*{_EOL}"
    rf"|{_N}[^\n]* passed[^\n]* (?:failed|skipped|ignored|total)|{_N}[^\n]* (?:failed|skipped|ignored|total)[^\n]* passed)",
    "code_declarations": _started(tx.DECLARATIONS),
    "code_imports": _started(tx.IMPORTS),
    "code_comments": _started(tx.COMMENTS),
    "colon_ends": rf":{_B}*{_EOL}",
}
NEEDLES = {name: _any(re.escape(n) for n in tx.NEEDLES[name]) for name in ("test_markers", "levels")}


def _bytes_in(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_BLANKS, _DIGITS, _PUNCTUATION = _bytes_in(" \t\x0b\f\r"), _bytes_in("0123456789"), _bytes_in("{};()=[]>")
_CONTROLS = _bytes_in("".join(map(chr, (*range(1, 9), 11, 12, *range(14, 27), *range(28, 32), 127))))
_CODE_HEADS = _bytes_in("".join(p.replace("\\", "")[0] for p in (*tx.DECLARATIONS, *tx.IMPORTS, *tx.COMMENTS)))
_BRACKETS = _bytes_in("[{")
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _character_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and white space among the first `size` characters, made once by a worker."""
    if size not in _TABLES:
        letters = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
        blanks = np.zeros(size, bool)
        spaces = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
        blanks[[c for c in spaces if c < size]] = True
        _TABLES[size] = letters, blanks
    return _TABLES[size]


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts without nulls, and where each begins."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _matched(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


class Lines:
    """The lines of some texts: whose each is, where it begins and which byte it begins with after blanks."""

    def __init__(self, texts: pa.Array):
        self.texts, self.n = texts, len(texts)
        self.data, self.offsets = _parts(texts)
        offsets = self.offsets
        breaks = np.flatnonzero(self.data == 10)
        before = np.searchsorted(breaks, offsets)
        first = before[:-1] + np.arange(self.n)
        self.of = np.repeat(np.arange(self.n), np.diff(before) + 1)
        inner = np.ones(len(self.of), bool)
        inner[first] = False
        self.starts = np.empty(len(self.of), np.int64)
        self.starts[first], self.starts[inner] = offsets[:-1], breaks + 1
        final = np.append(first[1:], len(self.of))[: self.n] - 1
        inner[:] = True
        inner[final] = False
        stops = np.empty(len(self.of), np.int64)
        stops[final], stops[inner] = offsets[1:], breaks
        at = self._visible_from(stops)
        self.has = at < stops
        self.heads = np.full(len(at), 10, np.uint8)
        self.heads[self.has] = self.data[at[self.has]]
        self.considered = self.total(np.flatnonzero(self.has))

    def _visible_from(self, stops: np.ndarray) -> np.ndarray:
        at = self.starts.copy()
        todo = np.flatnonzero(at < stops)
        for _ in range(32):
            todo = todo[_BLANKS[self.data[at[todo]]]]
            if not todo.size:
                return at
            at[todo] += 1
            todo = todo[at[todo] < stops[todo]]
        visible = np.append(np.flatnonzero(~_BLANKS[self.data]), len(self.data))
        at[todo] = np.minimum(visible[np.searchsorted(visible, at[todo])], stops[todo])
        return at

    def total(self, lines: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[lines], minlength=self.n)

    def headed(self, heads: np.ndarray) -> np.ndarray:
        return np.flatnonzero(heads[self.heads] & self.has)

    def matching(self, name: str, lines: np.ndarray) -> np.ndarray:
        """Those of the lines that match a pattern."""
        return lines[_matched(self.taken(lines), LINES[name])] if lines.size else lines

    def taken(self, lines: np.ndarray) -> pa.Array:
        offsets = np.append(self.starts, len(self.data)).astype(np.int32)
        every = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(self.data))
        return every.take(pa.array(lines))

    def counted(self, name: str, lines: np.ndarray) -> np.ndarray:
        return self.total(self.matching(name, lines))

    def lines_at(self, places: np.ndarray) -> np.ndarray:
        """Lines in which there are the places, which ascend."""
        lines = np.searchsorted(self.starts, places, "right") - 1
        return lines[np.diff(lines, prepend=-1) > 0]

    def of_texts(self, texts: np.ndarray) -> np.ndarray:
        return np.flatnonzero(texts[self.of] & self.has)


def _share(part: np.ndarray, whole: np.ndarray, percent: int) -> np.ndarray:
    return (whole > 0) & (part * 100 >= whole * percent)


def _documents(texts: pa.Array, plausible: np.ndarray) -> np.ndarray:
    """Codes of the texts that are one JSON document, -1 for others. What a pattern does not know is parsed."""
    codes, places = np.full(len(texts), -1), np.flatnonzero(plausible)
    some = texts.take(pa.array(places))
    flat = _matched(some, FLAT_DOCUMENT)
    codes[places[flat]] = CODES["json/high"]
    for i, text in zip(places[~flat].tolist(), some.filter(pa.array(~flat)).to_pylist()):
        facts = document_facts(text)
        if facts:
            codes[i] = CODES["unknown/low" if facts[1] else "json/high"]
    return codes


def _json_lines(x: Lines, plausible: np.ndarray) -> list[tuple[np.ndarray, str]]:
    opened = np.flatnonzero((x.data | 32) == 123)
    possible = (x.considered >= 2) & (np.diff(np.searchsorted(opened, x.offsets)) >= 2)
    possible &= plausible | (x.total(x.headed(_BRACKETS)) >= 2)
    if possible.any():
        lines = x.of_texts(possible)
        possible = x.total(lines[_matched(x.taken(lines), _CONTAINER)]) >= 2
    values = np.zeros(x.n, int)
    for i, text in zip(np.flatnonzero(possible).tolist(), x.texts.filter(pa.array(possible)).to_pylist()):
        found, containers, _ = line_facts(text)
        values[i] = found if containers >= 2 else 0
    return [((values > 0) & (x.considered >= 3) & (values == x.considered), "ndjson/high"), ((values > 0) & _share(values, x.considered, 80), "ndjson/medium")]


def _diff(x: Lines) -> list[tuple[np.ndarray, str]]:
    minus, plus = x.headed(_bytes_in("-")), x.headed(_bytes_in("+"))
    hunks, old, new = x.counted("diff_hunks", x.headed(_bytes_in("@"))), x.counted("diff_old_files", minus), x.counted("diff_new_files", plus)
    pair = (old >= 1) & (new >= 1)
    headed = x.headed(_bytes_in("dI"))
    headers = x.counted("diff_headers", headed[(hunks >= 1)[x.of[headed]]])
    changes = x.total(minus) + x.total(plus) - old - new
    return [((hunks >= 1) & (pair | (headers >= 1)), "diff/high"), (((hunks >= 1) | pair) & (changes >= 2), "diff/medium")]


def _tests(x: Lines) -> list[tuple[np.ndarray, str]]:
    possible = (x.considered >= 2) & _matched(x.texts, NEEDLES["test_markers"])
    markers = x.counted("test_markers", x.of_texts(possible)) if possible.any() else np.zeros(x.n, int)
    tests = (x.considered >= 2) & (markers > 0) & _share(markers, x.considered, 30)
    summary = x.counted("test_summaries", x.of_texts(tests)) >= 1
    return [(tests & summary, "test_results/high"), (tests & (markers >= 2), "test_results/medium")]


def _searches(x: Lines) -> list[tuple[np.ndarray, str]]:
    colons = np.flatnonzero(x.data[:-1] == 58)
    paths = x.counted("path_lines", x.lines_at(colons[_DIGITS[x.data[colons + 1]]]))
    return [
        ((x.considered >= 3) & _share(paths, x.considered, 80), "search_results/high"),
        ((x.considered >= 2) & _share(paths, x.considered, 50), "search_results/medium"),
    ]


def _logs(x: Lines) -> list[tuple[np.ndarray, str]]:
    stamps = x.counted("timestamps", x.headed(_DIGITS | _bytes_in("[(")))
    stamped = (x.considered >= 2) & _share(stamps, x.considered, 50)
    possible = (x.considered >= 3) & ~stamped
    possible[possible] = _matched(x.texts.filter(pa.array(possible)), NEEDLES["levels"])
    levels = x.counted("levels", x.of_texts(possible))
    return [
        ((x.considered >= 3) & _share(stamps, x.considered, 80), "log/high"),
        (stamped | ((x.considered >= 3) & _share(levels, x.considered, 50)), "log/medium"),
    ]


def _last_colons(x: Lines) -> np.ndarray:
    """Places of colons that may be the last of their line: before white space, a byte above ASCII or a text's end."""
    colons = np.flatnonzero(x.data == 58)
    after = x.data[np.minimum(colons + 1, len(x.data) - 1)]
    kept = (after == 10) | (after > 127) | _BLANKS[after]
    finals = x.offsets[1:][np.diff(x.offsets) > 0] - 1
    kept[np.searchsorted(colons, finals[x.data[finals] == 58])] = True
    return colons[kept]


def _code_or_prose(x: Lines) -> list[tuple[np.ndarray, str]]:
    n = x.considered
    marked = x.lines_at(np.flatnonzero(_PUNCTUATION[x.data]))
    rest = np.zeros(len(x.of), bool)
    rest[x.lines_at(_last_colons(x))] = True
    rest[marked] = False
    dense = _share(x.total(marked) + x.counted("colon_ends", np.flatnonzero(rest)), n, 50)
    headed = x.headed(_CODE_HEADS)
    headed = headed[(n >= 2)[x.of[headed]]]
    marks = sum((x.counted(name, headed) > 0).astype(int) for name in ("code_declarations", "code_imports", "code_comments"))
    high = (marks >= 2) & dense & (n >= 3)
    medium = ((marks >= 2) & (n >= 2)) | ((marks >= 1) & dense & (n >= 3))
    prose = (n >= 1) & ~dense & ~high & ~medium
    if prose.any():
        letters, visible, words = _characters(x.texts.filter(pa.array(prose)))
        prose[prose] = _share(words, n[prose], 300) & _share(letters, visible, 60)
    return [(high, "source_code/high"), (medium, "source_code/medium"), (prose, "plain_text/medium")]


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, visible characters and words of each text."""
    data, offsets = _parts(texts)
    wide = len(data) > 0 and data.max() > 127
    letter, blank = _character_tables(0x110000 if wide else 128)
    if wide:
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        data, offsets = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), begins[offsets]
    visible = ~blank[data]
    begun = visible.copy()
    begun[1:] &= ~visible[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begun[firsts] = visible[firsts]

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    return total(letter[data]), total(visible), total(begun)


def _settle(texts: pa.Array, verdicts: np.ndarray, plausible: np.ndarray) -> None:
    """Codes of the kinds of texts, where they are still -1."""
    data, offsets = _parts(texts)
    size = np.diff(offsets)
    odd = np.flatnonzero(((data < 32) & (data != 10)) | (data == 127))
    inside = lambda places: np.diff(np.searchsorted(places, offsets))
    controls = inside(odd[_CONTROLS[data[odd]]])
    verdicts[_share(controls, size, 5)] = CODES["binary_like/medium"]
    verdicts[inside(odd[data[odd] == 0]) > 0] = CODES["binary_like/high"]
    verdicts[size == 0] = CODES["unknown/low"]
    lines = None
    for rules in (_json_lines, _diff, _tests, _searches, _logs, _code_or_prose):
        left = np.flatnonzero(verdicts < 0)
        if not left.size:
            break
        if lines is None or left.size < lines.n:
            lines = Lines(texts.take(pa.array(left)))
        for fires, name in rules(lines, plausible[left]) if rules is _json_lines else rules(lines):
            verdicts[left[fires & (verdicts[left] < 0)]] = CODES[name]
    verdicts[verdicts < 0] = CODES["unknown/low"]


def verdicts_of(texts: pa.Array) -> np.ndarray:
    """Code of each text's kind; texts without nulls."""
    plausible = _matched(texts, MAY_BE_JSON)
    verdicts = _documents(texts, plausible)
    for at, piece in _pieces(texts):
        here = slice(at, at + len(piece))
        _settle(piece, verdicts[here], plausible[here])
    return verdicts


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in stretches of some `PIECE` bytes; a text of more is one of its own."""
    _, offsets = _parts(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


@F.arrow_udf(FOUND)
def _detected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    split = [v.split("/") for v in VERDICTS]
    kinds, sures = (pa.array([v[i] for v in split]) for i in (0, 1))
    for batch in batches:
        codes = pa.array(verdicts_of(pc.fill_null(batch.cast(pa.string()), "")))
        yield pa.StructArray.from_arrays([kinds.take(codes), sures.take(codes)], FOUND.names)


#: Content kind and confidence of each text; unknown for null. Filters on its result must not be moved below it, which
#: would look at all texts twice.
detected = _detected.asNondeterministic()
