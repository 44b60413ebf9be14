"""Text measures as JVM-side column expressions: tokens, fingerprints, prefixes, line signals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# One match per charge: word runs cost one token per 4 characters begun, blank runs one per 4 full,
# every other character one. Characters above U+07FF cost a second one.
TOKEN_CHARGES = r"[A-Za-z0-9_]{1,4}|[ \t]{4}|[^A-Za-z0-9_ \t]"
WIDE_CHARACTERS = r"[^\x{00}-\x{07FF}]"
CONTROL_CHARACTERS = r"[\x{01}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"


def structural_tokens(text: Column | str) -> Column:
    """Structural token estimate; NULL for NULL and for binary-like text.

    Text with a NUL, or with control characters above a twentieth of its length, is binary-like.
    Pure ASCII text (equal byte and character length) skips the second pass.
    """
    text = _col(text)
    wide = F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(
        F.regexp_count(text, F.lit(WIDE_CHARACTERS))
    )
    binary = F.contains(text, F.lit("\x00")) | (
        F.regexp_count(text, F.lit(CONTROL_CHARACTERS)) * CONTROL_DIVISOR > F.length(text)
    )
    # Each charge becomes one character, left-over blanks go away: the length is the count. Unlike a
    # list of matches this allocates nothing per charge.
    charged = F.translate(F.regexp_replace(text, TOKEN_CHARGES, "x"), " \t", "")
    return F.when(~binary, (F.length(charged) + wide).cast("bigint"))


# Fixed value: one control character in this many marks text as binary-like.
CONTROL_DIVISOR = 20


def exact_fingerprint(text: Column | str) -> Column:
    """SHA-256 of the raw bytes, in hex."""
    return F.sha2(F.encode(_col(text), "utf-8"), 256)


def semantic_fingerprint(kind: Column | str, role: Column | str, text: Column | str, version: int = 1) -> Column:
    """SHA-256 of version, kind, role and decoded text; only text, message and tool_result blocks."""
    kind, role, text = _col(kind), _col(role), _col(text)
    material = F.concat(
        F.unhex(F.lit(f"{version:08x}")), F.encode(kind, "utf-8"), F.encode(role, "utf-8"), F.encode(text, "utf-8")
    )
    return F.when(kind.isin("text", "message", "tool_result"), F.sha2(material, 256))


def common_prefix(left: Column | str, right: Column | str) -> Column:
    """Length in bytes of the common prefix of two strings.

    Bisection on the length (31 halvings cover any string) keeps the work linear and in the JVM.
    """
    a, b = F.encode(_col(left), "utf-8"), F.encode(_col(right), "utf-8")
    top = F.least(F.octet_length(a), F.octet_length(b))
    start = F.struct(F.lit(0).alias("lo"), top.alias("hi"))

    def halve(state: Column, _step: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        same = F.substr(a, F.lit(1), middle) == F.substr(b, F.lit(1), middle)
        return F.struct(
            F.when(same, middle).otherwise(state["lo"]).alias("lo"),
            F.when(same, state["hi"]).otherwise(F.greatest(state["lo"], middle - 1)).alias("hi"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve, lambda state: state["lo"])
    return F.when(top.isNotNull(), found)


def feature_lines(text: Column | str) -> Column:
    """Lines as features see them: split on newline, one carriage return stripped, no empty tail."""
    parts = F.transform(F.split(_col(text), "\n", -1), lambda line: F.regexp_replace(line, "\r$", ""))
    tail_empty = F.element_at(F.split(_col(text), "\n", -1), -1) == ""
    return F.when(tail_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def kept_lines(text: Column | str) -> Column:
    """Lines with their terminators, as folds and reducers see them."""
    return F.filter(F.split(_col(text), r"(?<=\n)", -1), lambda line: line != "")


# White space as text formats define it (the regex class \s is ASCII only).
BLANK = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PAD = r"\n[^\S\n]*"  # start of a line and its indentation

# Word lists the detector recognises.
DECLARATIONS = (
    "fn ", "pub ", "def ", "class ", "func ", "function ", "impl ", "struct ", "enum ", "trait ", "interface ",
    "public ", "private ", "protected ", "const ", "let ", "var ", "type ", "namespace ",
)
IMPORTS = ("import ", "from ", "use ", "using ", "#include", "package ", r"require\(")
COMMENTS = ("//", r"/\*", "#!", "<!--")
LOG_LEVELS = (
    "TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL", "NOTICE", "SEVERE",
)
ERROR_WORDS = ("error", "errors", "fatal", "panic", "panicked", "exception", "traceback")
WARNING_WORDS = ("warning", "warnings", "warn", "deprecated")
TEST_PREFIXES = (
    "--- PASS", "--- FAIL", "--- SKIP", r"\[ RUN      \]", r"\[       OK \]", r"\[  FAILED  \]", "\u2713", "\u2717",
)
TEST_WORDS = ("PASS ", "FAIL ", "ok ", "not ok ")


def _started(prefixes) -> str:
    """A line starting with one of the prefixes; one that ends in a blank needs text after it."""
    closed = [p for p in prefixes if not p.endswith(" ")]
    spaced = [p for p in prefixes if p.endswith(" ")]
    parts = list(closed)
    if spaced:
        parts.append("(?:" + "|".join(spaced) + r")[^\n]*[^\s]")
    return PAD + "(?:" + "|".join(parts) + ")"


def _worded(words) -> str:
    """A line holding one of the words as a whole ASCII word, in any case."""
    return r"\n(?:[^\n]*[^A-Za-z0-9_\n])?(?i:" + "|".join(words) + r")(?:[^A-Za-z0-9_]|$)"


# One pattern per signal over text in which every newline is doubled: a match may then consume the
# newline that ends its line without hiding the start of the next one.
LINE_PATTERNS = {
    "considered": PAD + r"[^\s]",
    "json_starts": PAD + r"[\[{]",
    "diff_headers": PAD + r"(?:diff --git |Index: )[^\n]*[^\s]",
    "diff_old_files": PAD + r"--- [^\n]*[^\s]",
    "diff_new_files": PAD + r"\+\+\+ [^\n]*[^\s]",
    "diff_marks": PAD + r"[+-]",
    "diff_hunks": PAD + r"@@(?:[^\n]*-[^\n]*@@|[^\n]*@@[^\n]*-)",
    "timestamps": PAD + r"[\[(]?(?:\d{4}-\d{2}-\d{2}[Tt _]\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2})",
    "levels": r"\n(?:(?:[^\n]*[^A-Za-z\n])?(?:" + "|".join(LOG_LEVELS)
    + r")(?:[^A-Za-z]|$)|[^\S\n]*(?:error|warning|note)[:\[])",
    "path_lines": PAD + r"(?:(?:[^\s:/-][^\s:/]*)?/[^\s:]*|[^\s:-][^\s:]*\.[A-Za-z][A-Za-z0-9]{0,7}):\d+(?:[:\s]|$)",
    "test_markers": r"\n(?:[^\S\n]*test [^\n]*(?: \.\.\. [^\n]*[^\s]| ok[^\S\n]*(?:\n|$))|[^\S\n]*(?:"
    + "|".join(TEST_PREFIXES) + r")|[^\S\n]*(?:" + "|".join(TEST_WORDS)
    + r")[^\n]*[^\s]|[^\S\n]*[^\s][^\n]* (?:PASSED|FAILED))",
    "test_summaries": r"\n[^\S\n]*(?:test result:|Tests run:|OK \(|FAILED \(|Ran [^\n]*[^\s]"
    r"|running [^\n]* tests[^\S\n]*(?:\n|$)|[^\s][^\n]* passed[^\n]* (?:failed|skipped|ignored|total)"
    r"|[^\s][^\n]* (?:failed|skipped|ignored|total)[^\n]* passed)",
    "code_declarations": _started(DECLARATIONS),
    "code_imports": _started(IMPORTS),
    "code_comments": _started(COMMENTS),
    "code_punctuation": r"\n(?:[^\n]*[{};()=\[\]>]|[^\n]*:[^\S\n]*(?:\n|$))",
    "error_lines": _worded(ERROR_WORDS),
    "warning_lines": _worded(WARNING_WORDS),
}
# The same counts in a form that scans each line once: the word is found with look-arounds and the
# rest of its line is consumed, so a line counts once without an anchored, backtracking prefix.
SCAN_PATTERNS = {
    "levels": r"(?:(?<![A-Za-z])(?:" + "|".join(LOG_LEVELS) + r")(?![A-Za-z])|(?<=\n)[^\S\n]*(?:error|warning|note)[:\[])[^\n]*",
    "error_lines": r"(?<![A-Za-z0-9_])(?i:" + "|".join(ERROR_WORDS) + r")(?![A-Za-z0-9_])[^\n]*",
    "warning_lines": r"(?<![A-Za-z0-9_])(?i:" + "|".join(WARNING_WORDS) + r")(?![A-Za-z0-9_])[^\n]*",
    "code_punctuation": r"[{};()=\[\]>][^\n]*|:[^\S\n]*(?:\n|$)",
}
TEXT_PATTERNS = {
    "letters": r"\p{L}",
    "visible": f"[^{BLANK}]",
    "words": f"[^{BLANK}]+",
    "controls": r"[\x{01}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1A}\x{1C}-\x{1F}\x{7F}]",
}


def _removed(text: Column, pattern: str) -> Column:
    """Characters a pattern covers, counted by what its removal leaves."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


# Strings without which a pattern finds nothing; looking for them is much cheaper than a match. `WORD_NEEDLES` are for
# patterns that ignore case, and are looked for in the lower-cased text; they have no i, whose lower case depends on the place.
NEEDLES = {
    "json_starts": ("[", "{"),
    "diff_headers": ("diff --git ", "Index: "),
    "diff_old_files": ("--- ",),
    "diff_new_files": ("+++ ",),
    "diff_marks": ("+", "-"),
    "diff_hunks": ("@@",),
    "timestamps": (":",),
    "levels": ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL", "NOTICE", "SEVERE", "error", "warning", "note"),
    "path_lines": (":",),
    "test_markers": ("test ", "PASS", "FAIL", "--- SKIP", "[ RUN ", "[       OK ]", "ok ", "\u2713", "\u2717"),
    "test_summaries": ("test result:", "Tests run:", "OK (", "FAILED (", "Ran ", "running ", " passed"),
}
WORD_NEEDLES = {"error_lines": ("error", "fatal", "pan", "except", "traceback"), "warning_lines": ("warn", "deprecated")}


def doubled(text: Column) -> Column:
    """The text with a newline before it and every newline doubled, as line patterns want it."""
    return F.concat(F.lit("\n"), F.replace(text, F.lit("\n"), F.lit("\n\n")))


def line_count(name: str, text: Column, twice: Column) -> Column:
    """Matches of a line pattern, given the text and its doubled form."""
    found = F.regexp_count(twice, F.lit(SCAN_PATTERNS.get(name, LINE_PATTERNS[name])))
    needles = [F.contains(text, F.lit(n)) for n in NEEDLES.get(name, ())]
    needles += [F.contains(F.lower(text), F.lit(n)) for n in WORD_NEEDLES.get(name, ())]
    return F.when(~reduce(or_, needles), F.lit(0)).otherwise(found) if needles else found


def signal_counts(text: Column, twice: Column) -> dict[str, Column]:
    """All signal counters of a text by name, as native expressions (no lambda, no UDF)."""
    ascii_only = F.octet_length(text) == F.length(text)
    # A word starts at a visible character that no visible character precedes.
    words = F.when(ascii_only, _removed(text, r"(?<!\S)\S")).otherwise(_removed(text, f"(?<![^{BLANK}])[^{BLANK}]"))
    visible = F.when(ascii_only, F.length(text) - _removed(text, r"\s+")).otherwise(
        F.length(text) - _removed(text, f"[{BLANK}]+")
    )
    return {
        **{name: line_count(name, text, twice) for name in LINE_PATTERNS},
        "letters": _removed(text, r"\p{L}+"),
        "visible": visible,
        "words": words,
        "controls": F.regexp_count(text, F.lit(TEXT_PATTERNS["controls"])),
    }


def line_signals(text: Column | str) -> list[Column]:
    """All signal counters of a text as columns."""
    text = _col(text)
    return [count.alias(name) for name, count in signal_counts(text, doubled(text)).items()]
