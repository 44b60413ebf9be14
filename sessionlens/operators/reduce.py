"""Reduction candidates and their gate.

A candidate job yields rows (block, candidate id, candidate text or reason). Line-based candidates
are native array expressions over the text of the row; the JSON and greedy ones are Arrow-batched
helpers. `evaluate` gates all of them the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from ..functions.jsontext import NAME, search_view, structured_candidate
from ..functions.labels import cache_risk
from ..functions.text import common_prefix, kept_lines, structural_tokens

# Reducers leave smaller inputs as they are; such rows stay, with the status below_minimum.
MIN_REDUCER_BYTES = 256
MIN_NOISE_BYTES = 128


def _quoted(value: Column) -> Column:
    """A string as a JSON literal."""
    wrapped = F.to_json(F.struct(value.alias("s")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def _run_starts(lines: Column, same: Callable[[Column, Column], Column]) -> Column:
    """0-based positions where a run of adjacent equal lines begins."""
    positions = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(positions, lambda i: (i == 0) | ~same(F.get(lines, i), F.get(lines, i - 1)))
    return F.when(F.size(lines) > 0, starts).otherwise(F.expr("cast(array() as array<int>)"))


def _run_length(lines: Column, starts: Column, k: Column) -> Column:
    return F.coalesce(F.get(starts, k + 1), F.size(lines)) - F.get(starts, k)


def with_line_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `lines` (with terminators) and `starts` of runs of equal adjacent lines."""
    staged = df.withColumn("lines", kept_lines(text))
    return staged.withColumn("starts", _run_starts(F.col("lines"), lambda a, b: a == b))


def line_runs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Run-length rows (position, line, repeats) of each text."""
    runs = with_line_runs(df.select(key, text), text)
    lines, starts = F.col("lines"), F.col("starts")
    packed = F.transform(
        starts, lambda i, k: F.struct(F.get(lines, i).alias("line"), _run_length(lines, starts, k).alias("repeats"))
    )
    return runs.select(key, F.posexplode(packed).alias("run", "r")).select(key, "run", "r.line", "r.repeats")


def line_fold(df: DataFrame, text: str = "text") -> DataFrame:
    """`text.readable_line_fold`: adjacent equal lines as `repeat=n line="..."`."""
    runs = with_line_runs(df, text)
    lines, starts = F.col("lines"), F.col("starts")
    rendered = F.transform(
        starts,
        lambda i, k: F.concat(
            F.when(_run_length(lines, starts, k) >= 2, F.concat(F.lit("repeat="), _run_length(lines, starts, k).cast("string"), F.lit(" ")))
            .otherwise(F.lit("")),
            F.lit("line="), _quoted(F.get(lines, i)), F.lit("\n"),
        ),
    )
    folded = F.concat(F.lit(f"{NAME} line-fold v1\n"), F.array_join(rendered, ""))
    applies = F.size(starts) < F.size(lines)
    return (
        runs.withColumn("candidate", F.when(applies, folded))
        .withColumn("failure", F.when(~applies, "not_applicable"))
        .drop("lines", "starts")
    )


SECOND_TOKEN = r"^[ \t\n\f\r]*[^ \t\n\f\r]+[ \t\n\f\r]+([^ \t\n\f\r]+[ \t\n\f\r])"
AROUND_TOKEN = r"^([ \t\n\f\r]*[^ \t\n\f\r]+[ \t\n\f\r]+)([^ \t\n\f\r]+)(?=[ \t\n\f\r])"


def prefix_fold(df: DataFrame, text: str = "text") -> DataFrame:
    """`text.log_prefix_fold`: adjacent lines sharing their second token are folded under it."""
    staged = df.withColumn("lines", kept_lines(text)).withColumn(
        "prefixes",
        F.transform("lines", lambda l: F.when(F.octet_length(F.regexp_extract(l, SECOND_TOKEN, 1)) >= 3, F.regexp_extract(l, SECOND_TOKEN, 1))),
    )
    lines, prefixes, starts = F.col("lines"), F.col("prefixes"), F.col("starts")
    positions = F.sequence(F.lit(0), F.size(lines) - 1)
    opens = F.filter(
        positions,
        lambda i: (i == 0) | F.get(prefixes, i).isNull() | F.get(prefixes, i - 1).isNull()
        | (F.get(prefixes, i) != F.get(prefixes, i - 1)),
    )
    staged = staged.withColumn("starts", F.when(F.size(lines) > 0, opens).otherwise(F.expr("cast(array() as array<int>)")))
    tail = lambda l: _quoted(F.regexp_replace(l, AROUND_TOKEN, "$1"))

    def render(i: Column, k: Column) -> Column:
        length = _run_length(lines, starts, k)
        tails = F.transform(F.slice(lines, i + 1, length), tail)
        folded = F.concat(
            F.lit("prefix="), _quoted(F.get(prefixes, i)), F.lit(" tails=["), F.array_join(tails, ","), F.lit("]\n")
        )
        return F.when(length >= 2, folded).otherwise(F.concat(F.lit("line="), _quoted(F.get(lines, i)), F.lit("\n")))

    candidate = F.concat(F.lit(f"{NAME} log-prefix-fold v1\n"), F.array_join(F.transform(starts, render), ""))
    applies = F.size(starts) < F.size(lines)
    return (
        staged.withColumn("candidate", F.when(applies, candidate))
        .withColumn("failure", F.when(~applies, "not_applicable"))
        .drop("lines", "prefixes", "starts")
    )


def minify(df: DataFrame, text: str = "text") -> DataFrame:
    """`json.minify`: white space outside strings is dropped; the document must be strict JSON."""
    squeezed = F.regexp_replace(F.col(text), r'("(?:[^"\\]|\\.)*")|[ \t\n\r\f]+', "$1")
    # `json.empty_noise_fields` parses loosely; strictness with unique keys comes from the tabular check.
    checked = df.withColumn("__c", structured_candidate(F.col(text), F.lit("json.tabular")))
    invalid = F.coalesce(F.col("__c.failure") == "invalid_input", F.lit(False))
    return (
        checked.withColumn("candidate", F.when(~invalid, squeezed))
        .withColumn("failure", F.when(invalid, "invalid_input"))
        .drop("__c")
    )


def unchanged(df: DataFrame, text: str = "text") -> DataFrame:
    """The no-op controls."""
    return df.withColumn("candidate", F.col(text)).withColumn("failure", F.lit(None).cast("string"))


def _structured(name: str):
    def run(df: DataFrame, text: str = "text") -> DataFrame:
        out = df.withColumn("__c", structured_candidate(F.col(text), F.lit(name)))
        return out.withColumn("candidate", F.col("__c.candidate")).withColumn("failure", F.col("__c.failure")).drop("__c")

    return run


def search_projection(df: DataFrame, text: str = "text") -> DataFrame:
    """`search.result_projection`: matches sorted and grouped by file."""
    out = df.withColumn("__c", search_view(F.col(text)))
    return out.withColumn("candidate", F.col("__c.candidate")).withColumn("failure", F.col("__c.failure")).drop("__c")


# The candidate registry: id -> (kinds of content it reads, readability of its output, job).
REGISTRY: dict[str, tuple[tuple[str, ...], str, Callable[[DataFrame, str], DataFrame]]] = {
    "json.noop": (("json",), "provider_compatible_control", unchanged),
    "json.minify": (("json",), "provider_compatible_control", minify),
    "json.tabular": (("json",), "opaque_custom_encoding", _structured("json.tabular")),
    "json.repeated_subtree": (("json",), "opaque_custom_encoding", _structured("json.repeated_subtree")),
    "json.readable_table": (("json",), "human_readable_structured", _structured("json.readable_table")),
    "json.compact_records": (("json",), "human_readable_structured", _structured("json.compact_records")),
    "json.key_elision": (("json",), "human_readable_structured", _structured("json.key_elision")),
    "text.noop": (("plain_text",), "provider_compatible_control", unchanged),
    "text.repeated_line": (("plain_text",), "opaque_custom_encoding", line_fold),
    "text.repeated_run": (("plain_text",), "opaque_custom_encoding", _structured("text.readable_block_fold")),
    "text.readable_line_fold": (("plain_text",), "human_readable_structured", line_fold),
    "text.readable_block_fold": (("plain_text",), "human_readable_structured", _structured("text.readable_block_fold")),
    "text.log_prefix_fold": (("plain_text",), "human_readable_structured", prefix_fold),
    "json.empty_noise_fields": (("json",), "human_readable_structured", _structured("json.empty_noise_fields")),
    "json.repeated_value_elision": (("json",), "human_readable_structured", _structured("json.repeated_value_elision")),
    "shell.diagnostic_projection": (("json",), "human_readable_structured", _structured("shell.diagnostic_projection")),
    "search.result_projection": (("json", "plain_text"), "human_readable_structured", search_projection),
}
REDUCERS = {
    "json.empty_noise_fields": MIN_NOISE_BYTES, "json.repeated_value_elision": MIN_REDUCER_BYTES,
    "shell.diagnostic_projection": MIN_REDUCER_BYTES, "search.result_projection": MIN_REDUCER_BYTES,
}


def readability(candidate: Column | str) -> Column:
    """How readable the output of a compressor is."""
    candidate = F.col(candidate) if isinstance(candidate, str) else candidate
    names = F.create_map(*[F.lit(v) for k, (_, r, _) in REGISTRY.items() if k not in REDUCERS for v in (k, r)])
    return F.coalesce(names[candidate], F.lit("opaque_custom_encoding"))


def register_compressor(
    name: str, kinds: tuple[str, ...], job: Callable[[DataFrame, str], DataFrame], readable: str = "opaque_custom_encoding",
    min_bytes: int | None = None,
) -> None:
    """Add a candidate of one's own; with `min_bytes` it is a reducer that keeps small inputs as they are."""
    REGISTRY[name] = (kinds, readable, job)
    if min_bytes is not None:
        REDUCERS[name] = min_bytes


def candidate_plan(blocks: DataFrame) -> DataFrame:
    """Candidates to evaluate per block: by content kind, size and tool or shell family.

    Expects kind, detected_kind, raw_bytes, tool_family and shell_family. The candidate list is a
    literal array, so the plan is a per-row expression: no join, no shuffle, no ranking.
    """
    json_kind = F.col("detected_kind") == "json"
    plans = []
    for name, (kinds, _, _) in REGISTRY.items():
        wanted = F.col("detected_kind").isin(*kinds)
        if name in REDUCERS:
            wanted = wanted & (F.col("raw_bytes") >= REDUCERS[name])
        if name == "shell.diagnostic_projection":
            wanted = wanted & (F.col("tool_family") == "shell_generic")
        if name == "search.result_projection":
            wanted = wanted & (json_kind | (F.col("shell_family") == "search"))
        plans.append(F.when(wanted, F.lit(name)))
    ids = F.array_compact(F.array(*plans))
    return blocks.where("kind = 'tool_result'").withColumn("candidate_id", F.explode(ids))


def propose(blocks: DataFrame, candidates: list[str], text: str = "text") -> DataFrame:
    """Run the named candidates over the blocks that carry their kind of content."""
    out = None
    for name in candidates:
        kinds, readable, job = REGISTRY[name]
        rows = blocks.where(F.col("detected_kind").isin(*kinds))
        part = job(rows, text)
        if name in REDUCERS:
            small = F.octet_length(text) < REDUCERS[name]
            part = part.withColumn("candidate", F.when(~small, F.col("candidate"))).withColumn("failure", F.when(small, "below_minimum").otherwise(F.col("failure")))
        part = part.withColumn("candidate_id", F.lit(name)).withColumn("readability", F.lit(readable))
        out = part if out is None else out.unionByName(part)
    return out


SPACES = r"[ \t\n\f\r]"


def _literal(quoted: Column) -> Column:
    """The string of a JSON literal."""
    return F.from_json(F.concat(F.lit('{"s":'), quoted, F.lit("}")), "s string")["s"]


def unfolded(candidate: Column | str) -> Column:
    """The text of a line fold or a prefix fold; NULL where the candidate is none.

    A folded token goes back before the last white space after the first token of its line. A line with more white space
    behind its second token comes back changed, which the gate finds out.
    """
    candidate = F.col(candidate) if isinstance(candidate, str) else candidate
    rows = F.filter(F.slice(F.split(candidate, "\n"), 2, F.size(F.split(candidate, "\n"))), lambda r: r != "")

    def under(tail: Column, token: Column) -> Column:
        head = F.regexp_extract(tail, f"^({SPACES}*[^ \\t\\n\\f\\r]+{SPACES}+)(?={SPACES})", 1)
        return F.concat(head, token, F.substr(tail, F.length(head) + 1))

    def read(row: Column) -> Column:
        prefix = _literal(F.regexp_extract(row, r'^prefix=("(?:[^"\\]|\\.)*") tails=', 1))
        tails = F.from_json(F.regexp_extract(row, r" tails=(\[.*\])$", 1), "array<string>")
        token = F.substr(prefix, F.lit(1), F.length(prefix) - 1)
        many = F.array_join(F.transform(tails, lambda t: under(t, token)), "")
        times = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(row, r"^repeat=(\d+) line=", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(1))
        return F.when(row.startswith("prefix="), many).otherwise(F.repeat(_literal(F.regexp_extract(row, r'^(?:repeat=\d+ )?line=(".*")$', 1)), times))

    return F.array_join(F.transform(rows, read), "")


def _same_document(candidate: Column, text: Column) -> Column:
    return F.to_json(F.try_parse_json(candidate)) == F.to_json(F.try_parse_json(text))


# How the gate knows that a candidate gives its text back: (candidate, text) -> condition.
INVERSES: dict[str, Callable[[Column, Column], Column]] = {
    "json.noop": lambda c, t: c == t,
    "text.noop": lambda c, t: c == t,
    "json.minify": _same_document,
    "text.readable_line_fold": lambda c, t: unfolded(c) == t,
    "text.log_prefix_fold": lambda c, t: unfolded(c) == t,
}


def gated(
    blocks: DataFrame, name: str, text: str = "text", job: Callable[[DataFrame, str], DataFrame] | None = None,
    inverse: Callable[[Column, Column], Column] | None = None, min_bytes: int | None = None,
) -> DataFrame:
    """A candidate proposed twice and recovered: like `propose` for one candidate, with two more failures.

    `internal_error`: the second evaluation differs from the first. `recovery_failed`: the inverse does not
    give the text back. Both come after the candidate's own failure and before the sizes, which `evaluate`
    looks at. `job`, `inverse` and `min_bytes` default to those of the registry; without an inverse only the second
    evaluation counts, and texts below `min_bytes` stay as they are. Everything is decided on the row.
    """
    kinds, readable, known = REGISTRY.get(name, (None, "opaque_custom_encoding", job))
    job, inverse = job or known, inverse or INVERSES.get(name)
    rows = blocks if kinds is None else blocks.where(F.col("detected_kind").isin(*kinds))
    first = job(rows, text).withColumnsRenamed({"candidate": "__first", "failure": "__failure"})
    both = job(first, text)
    differs = ~F.col("candidate").eqNullSafe(F.col("__first"))
    lost = F.lit(False) if inverse is None else F.col("__first").isNotNull() & ~F.coalesce(inverse(F.col("__first"), F.col(text)), F.lit(False))
    least = min_bytes if min_bytes is not None else REDUCERS.get(name)
    small = F.lit(False) if least is None else F.octet_length(text) < least
    failure = F.when(small, "below_minimum").when(F.col("__failure").isNotNull(), F.col("__failure")).when(differs, "internal_error").when(lost, "recovery_failed")
    out = both.withColumn("failure", failure).withColumn("candidate", F.when(~small, F.col("__first"))).drop("__first", "__failure")
    return out.withColumn("candidate_id", F.lit(name)).withColumn("readability", F.lit(readable))


def evaluate(proposed: DataFrame, text: str = "text") -> DataFrame:
    """Gate a candidate: its own failure (with `gated`, also of determinism and recovery), then never worse in bytes and in tokens.

    The originals stay in place beside the candidates, so recovery is the original itself. Optional
    columns `request_offset`, `request_bytes` and `persistence` give the preserved prefix and risk.
    """
    have = set(proposed.columns)
    size = F.octet_length(text).cast("bigint")
    output = F.octet_length("candidate").cast("bigint")
    sized = (
        proposed.withColumn("input_bytes", size)
        .withColumn("output_bytes", output)
        .withColumn("input_tokens", structural_tokens(text))
        .withColumn("output_tokens", structural_tokens("candidate"))
        .withColumn("prefix_bytes", common_prefix(text, "candidate").cast("bigint"))
    )
    no_gain = (F.col("output_bytes") >= F.col("input_bytes")) | F.coalesce(
        F.col("output_tokens") >= F.col("input_tokens"), F.lit(False)
    )
    status = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("candidate").isNull(), "not_applicable")
        .when(no_gain, "no_improvement")
        .otherwise("applicable")
    )
    offset = F.col("request_offset") if "request_offset" in have else F.lit(0).cast("bigint")
    whole = F.col("request_bytes") if "request_bytes" in have else F.col("input_bytes")
    persistence = F.col("persistence") if "persistence" in have else F.lit(None).cast("bigint")
    basis = F.when(
        whole > 0, F.least(F.lit(10000).cast("bigint"), F.call_function("div", (offset + F.col("prefix_bytes")) * 10000, whole))
    )
    return (
        sized.withColumn("status", status)
        .withColumn("bytes_delta", F.col("input_bytes") - F.col("output_bytes"))
        .withColumn("token_delta", F.col("input_tokens") - F.col("output_tokens"))
        .withColumn("prefix_bp", basis)
        .withColumn("cache_risk", cache_risk(basis, persistence))
    )


# --- reducers of tool output streams -------------------------------------------------------------------


def _quarter(size: Column) -> Column:
    return F.ceil(size / 4).cast("bigint")


def _judged(df: DataFrame, applies: Column, hint: Column, body: Column, raw: str) -> DataFrame:
    """Attach candidate, sizes and the never-worse verdict; the hint's bytes count."""
    out = df.withColumn("applicable", applies).withColumn("hint", F.when(applies, hint).otherwise(F.lit("")))
    out = out.withColumn("candidate", F.concat("hint", F.when(applies, body).otherwise(F.col(raw))))
    raw_size, size = F.octet_length(raw).cast("bigint"), F.octet_length("candidate").cast("bigint")
    return (
        out.withColumn("raw_bytes", raw_size)
        .withColumn("candidate_bytes", size)
        .withColumn("hint_bytes", F.octet_length("hint").cast("bigint"))
        .withColumn("raw_tokens", _quarter(raw_size))
        .withColumn("candidate_tokens", _quarter(size))
        .withColumn("accepted", applies & (size < raw_size) & (_quarter(size) < _quarter(raw_size)))
        .drop("hint")
    )


def _where_lines(text: Column | str, drop: Callable[[Column], Column]) -> tuple[Column, Column]:
    """Text without the dropped lines, and how many were dropped."""
    lines = kept_lines(text)
    return F.array_join(F.filter(lines, lambda l: ~drop(l)), ""), F.size(F.filter(lines, drop)).cast("bigint")


PROGRESS = r"^\s*(?:Compiling|Checking|Downloading|Downloaded) "
PROGRESS_AND_END = r"^\s*(?:Compiling|Checking|Downloading|Downloaded|Finished) "
PASSING = r"^\s*test .* \.\.\. ok\s*$"
RUNNING = r"^\s*running .* tests\s*$"


def cargo_test(df: DataFrame, stdout: str = "stdout", stderr: str = "stderr", command: str | None = None) -> DataFrame:
    """Drop passing test lines and progress lines; failures and summaries stay."""
    out, _ = _where_lines(stdout, lambda l: l.rlike(PASSING) | l.rlike(RUNNING))
    _, passing = _where_lines(stdout, lambda l: l.rlike(PASSING))
    err, progress = _where_lines(stderr, lambda l: l.rlike(PROGRESS_AND_END))
    tail = "; recovery available when active.]\n" if command is None else f". Full output: {command}]\n"
    hint = F.concat(
        F.lit(f"[{NAME}: "), passing.cast("string"), F.lit(" passing test lines and "), progress.cast("string"),
        F.lit(" progress lines omitted" + tail),
    )
    staged = df.withColumn("__raw", F.concat(stdout, stderr)).withColumn("omitted_tests", passing).withColumn(
        "omitted_progress", progress
    )
    applies = (F.col("omitted_tests") > 0) | (F.col("omitted_progress") > 0)
    return _judged(staged, applies, hint, F.concat(out, err), "__raw").drop("__raw")


def cargo_check(df: DataFrame, stderr: str = "stderr", keep_finished: bool = True, command: str | None = None) -> DataFrame:
    """Drop progress lines; version 2 (and the lint variant) keeps the `Finished` line."""
    pattern = PROGRESS if keep_finished else PROGRESS_AND_END
    body, dropped = _where_lines(stderr, lambda l: l.rlike(pattern))
    tail = "; recovery available when active.]\n" if command is None else f". Full output: {command}]\n"
    hint = F.concat(F.lit(f"[{NAME}: "), dropped.cast("string"), F.lit(" Cargo progress lines omitted" + tail))
    staged = df.withColumn("omitted_progress", dropped)
    return _judged(staged, F.col("omitted_progress") > 0, hint, body, stderr)


NUMBERED = r":[0-9]+:"


def ripgrep(df: DataFrame, stdout: str = "stdout", command: str | None = None) -> DataFrame:
    """Group adjacent matches by path; one ambiguous line rejects the whole output."""
    staged = df.withColumn("__lines", kept_lines(stdout))
    lines = F.col("__lines")
    # An ambiguous line has more than one `:digits:`; two may share a colon, hence the doubling.
    splits = lambda l: F.regexp_count(F.replace(l, F.lit(":"), F.lit("::")), F.lit(NUMBERED))
    path = lambda l: F.regexp_extract(l, r"(?s)^(.*?):([0-9]+):(.*)$", 1)
    body = F.transform(
        lines,
        lambda l, i: F.concat(
            F.when((i > 0) & (path(l) == path(F.get(lines, i - 1))), F.lit("")).otherwise(F.concat(path(l), F.lit(":\n"))),
            F.lit("  "), F.regexp_replace(l, r"(?s)^(.*?):([0-9]+):(.*)$", "$2:$3"),
        ),
    )
    applies = (F.size(lines) > 0) & F.forall(lines, lambda l: splits(l) == 1)
    hint = F.lit("") if command is None else F.concat(
        F.lit(f"[{NAME}: grouped "), F.size(lines).cast("string"), F.lit(f" matches by file. Exact output: {command}]\n")
    )
    staged = staged.withColumn("grouped_lines", F.when(applies, F.size(lines).cast("bigint")).otherwise(F.lit(0)))
    return _judged(staged, applies, hint, F.array_join(body, ""), stdout).drop("__lines")


# What a status output must begin with and contain.
STATUS_HEADS = r"^(?:On branch |HEAD detached at |HEAD detached from |Not currently on any branch\.\r?(?:\n|$))"
STATUS_SECTIONS = (
    "Changes to be committed:\n", "Changes not staged for commit:\n", "Untracked files:\n", "Unmerged paths:\n",
)


def git_status(df: DataFrame, stdout: str = "stdout", command: str | None = None) -> DataFrame:
    """Drop `(use "...")` hints from a recognised status output."""
    text = F.col(stdout)
    body, dropped = _where_lines(stdout, lambda l: l.rlike(r'^  \(use ".*\)\s*$'))
    section = F.lit(False)
    for name in STATUS_SECTIONS:
        section = section | text.contains(name)
    staged = df.withColumn("omitted_hints", F.when(text.rlike(STATUS_HEADS) & section, dropped).otherwise(F.lit(0)))
    hint = F.lit("") if command is None else F.concat(
        F.lit(f"[{NAME}: "), dropped.cast("string"), F.lit(f" status hints omitted; full: {command}]\n")
    )
    return _judged(staged, F.col("omitted_hints") > 0, hint, body, stdout)


# Reducers of tool output as (id, command family, mode, decision).
POLICIES = (
    ("cargo_test_v1_shadow", "cargo_test", "shadow", "shadow_only"),
    ("cargo_test_v1_active", "cargo_test", "active", "accepted_opt_in"),
    ("cargo_check_v1_shadow", "cargo_check", "shadow", "shadow_only"),
    ("cargo_check_v1_active", "cargo_check", "active", "rejected"),
    ("cargo_check_v2_shadow", "cargo_check", "shadow", "shadow_only"),
    ("cargo_check_v2_active", "cargo_check", "active", "accepted_opt_in"),
    ("cargo_clippy_v1_shadow", "cargo_clippy", "shadow", "rejected"),
    ("rg_v1_shadow", "ripgrep", "shadow", "shadow_only"),
    ("rg_v1_active", "ripgrep", "active", "accepted_opt_in"),
    ("git_status_v1_shadow", "git_status", "shadow", "shadow_only"),
    ("git_status_v1_active", "git_status", "active", "rejected"),
)


def policies(spark) -> DataFrame:
    return spark.createDataFrame(POLICIES, "reducer_id string, command_family string, mode string, decision string")


def active_allowed(df: DataFrame, reducer: str = "reducer_id", family: str = "command_family") -> DataFrame:
    """Add `active_allowed`: an accepted active policy of the same command family."""
    registry = F.broadcast(policies(df.sparkSession).select(
        F.col("reducer_id").alias("__r"), F.col("command_family").alias("__f"), F.col("mode").alias("__m"), F.col("decision").alias("__d")
    ))  # 11 rows
    joined = df.join(registry, F.col(reducer) == F.col("__r"), "left")
    allowed = (F.col("__f") == F.col(family)) & (F.col("__m") == "active") & (F.col("__d") == "accepted_opt_in")
    return joined.withColumn("active_allowed", F.coalesce(allowed, F.lit(False))).drop("__r", "__f", "__m", "__d")


def register_reducer(spark, name: str, reducer: Callable[[str], str | None], min_bytes: int = 0) -> None:
    """Register a reducer of one's own as the table function `name(TABLE(t), column => 'c', decision => 'd')`.

    Its rows are those of the table, whatever columns it has, with `candidate`, `candidate_bytes`, `accepted`
    (shorter, and the text has `min_bytes` or more), `applied` and `output`: an accepted candidate is put
    in the text's place only where the policy decision is accepted_opt_in. A null text, or None from the
    reducer, is no candidate. Names of the table that are like results get the results an underscore.
    """

    class Reduce:
        @staticmethod
        def analyze(row: AnalyzeArgument, column: AnalyzeArgument, decision: AnalyzeArgument) -> AnalyzeResult:
            schema, taken = StructType(list(row.dataType.fields)), {f.name.lower() for f in row.dataType.fields}
            for field, kind in (("candidate", StringType()), ("candidate_bytes", LongType()), ("accepted", BooleanType()), ("applied", BooleanType()), ("output", StringType())):
                while field in taken:
                    field += "_"
                schema = schema.add(field, kind)
            return AnalyzeResult(schema=schema)

        def eval(self, row: Row, column: str, decision: str):
            text = row[column]
            candidate = None if text is None else reducer(text)
            size = None if candidate is None else len(candidate.encode())
            raw = 0 if text is None else len(text.encode())
            accepted = size is not None and raw >= min_bytes and size < raw
            applied = accepted and decision == "accepted_opt_in"
            yield (*row, candidate, size, accepted, applied, candidate if applied else text)

    spark.udtf.register(name, udtf(Reduce))
