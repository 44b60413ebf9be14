"""Labels, predicates and small scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TURN_ROUTES


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- requests and attempts ---------------------------------------------------------------------


def analysis_eligible() -> Column:
    """A turn, or a POST on a route that carries turns."""
    route = F.lower(F.btrim(F.coalesce("route", F.lit("unknown")), F.lit("/")))
    posted = (F.lower(F.coalesce("method", F.lit(""))) == "post") & route.isin(*TURN_ROUTES)
    return F.coalesce(F.col("request_kind") == "turn", F.lit(False)) | posted


def provider_error() -> Column:
    """The attempt did not complete cleanly."""
    return (
        (F.coalesce("status", F.lit("unknown")) != "completed")
        | F.col("error_code").isNotNull()
        | F.col("transport_error").isNotNull()
    )


def migrated_kind(kind: Column | str) -> Column:
    """Old `compaction` rows are the legacy protocol."""
    kind = _col(kind)
    return F.when(kind == "compaction", F.lit("compaction_legacy")).otherwise(kind)


def attempt_status(
    request_kind: Column | str,
    transport_error: Column | str,
    status_code: Column | str,
    outcome: Column | str,
    ended: Column | str,
    response_state: Column | str,
    response_status: Column | str,
    error_code: Column | str,
) -> Column:
    """Attempt lifecycle from all evidence; `response_state` NULL means no response was observed."""
    kind, transport, code = _col(request_kind), _col(transport_error), _col(status_code)
    outcome, ended, state = _col(outcome), _col(ended), _col(response_state)
    bad_code = F.coalesce(~code.between(200, 299), F.lit(False))
    failed = bad_code | (outcome == "failed")
    open_ended = F.when(ended, "incomplete").otherwise("started")
    by_outcome = (
        F.when(outcome == "cancelled", "cancelled")
        .when(outcome == "disconnected", "disconnected")
        .when(outcome == "in_progress", open_ended)
    )
    compaction = (
        F.when(transport.isNotNull() | failed, "errored")
        .when(outcome == "completed", "completed")
        .when(outcome == "incomplete", "incomplete")
        .otherwise(by_outcome)
    )
    unanswered = F.when(failed, "errored").when(outcome.isin("incomplete", "completed"), "incomplete").otherwise(
        by_outcome
    )
    cancelled = (
        F.coalesce(_col(response_status) == "cancelled", F.lit(False))
        | (state == "cancelled")
        | (outcome == "cancelled")
    )
    answered = (
        F.when(cancelled, "cancelled")
        .when(failed | _col(error_code).isNotNull() | (state == "failed"), "errored")
        .when(state == "completed", "completed")
        .when((state == "disconnected") | (outcome == "disconnected"), "disconnected")
        .otherwise("incomplete")
    )
    return (
        F.when(F.coalesce(kind.startswith("compaction"), F.lit(False)), compaction)
        .when(transport.isNotNull(), "errored")
        .when(state.isNull(), unanswered)
        .otherwise(answered)
    )


def operation_status(status: Column | str) -> Column:
    """Terminal operation state of a finished attempt, NULL while it runs."""
    status = _col(status)
    return F.when(status.isin("completed", "incomplete", "cancelled", "errored", "disconnected"), status)


def terminal_event(status: Column | str) -> Column:
    """Name of the single terminal event a finished attempt supports."""
    status = _col(status)
    return (
        F.when(status == "completed", "provider.response.completed")
        .when(status.isin("incomplete", "cancelled", "disconnected"), "provider.response.incomplete")
        .when(status == "errored", "provider.response.failed")
    )


# --- tools and shells ----------------------------------------------------------------------------

# Tool families and the name parts that identify them, first match wins.
TOOL_FAMILIES = (
    ("version_control", ("git", "hg", "svn", "version_control", "diff")),
    ("search", ("search", "grep", "rg", "ripgrep", "find")),
    ("tests", ("test", "pytest", "vitest", "jest", "cargo_nextest")),
    ("lint", ("lint", "clippy", "eslint", "ruff", "mypy")),
    ("build", ("build", "compile", "cargo_check", "make")),
    ("dependency", ("dependenc", "package", "npm", "pnpm", "cargo_tree", "resolver")),
    ("filesystem", ("file", "filesystem", "directory", "ls", "tree", "glob")),
    ("structured_data", ("json", "structured", "csv", "jq")),
    ("shell_generic", ("shell", "exec", "command", "run")),
)


def tool_family(name: Column | str) -> Column:
    """Family of a tool name; NULL and unmatched names are `unknown`."""
    normal = F.regexp_replace(F.lower(_col(name)), "-", "_")
    out = None
    for family, parts in TOOL_FAMILIES:
        hit = normal.rlike("|".join(parts))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("unknown")


# Per shell family, markers of which one suffices, and pairs of marker groups of which
# both must occur.
SHELL_MARKERS = (
    ("search", ("rg ", 'rg"', "grep", "ripgrep", "search"), ((("match",), ("line_number",)),)),
    (
        "tests",
        ("cargo test", "pytest", "tox", "npm test", "vitest", "jest"),
        ((("passed", "failed", "skipped", "test session"), ("test", "pytest")), (("passed",), ("failed",))),
    ),
    ("build", ("cargo build", "cargo check", "make", "compile", "compiling", "built", "build finished"), ()),
    ("lint", ("clippy", "ruff", "eslint", "mypy", "lint"), ((("warning:", "error:"), ("diagnostic",)),)),
    ("dependency", ("cargo tree", "npm install", "npm ls", "pnpm", "dependency", "resolver"), ()),
    ("version_control", ("git ", 'git"', "git status", "git diff", "git log"), ()),
)


def _has_any(signal: Column, markers) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | signal.contains(marker)
    return hit


def shell_side(signal: Column | str) -> Column:
    """Family one side (command or output) points to, NULL if none; the whole text is the signal."""
    text = F.lower(_col(signal))
    out = None
    for family, single, pairs in SHELL_MARKERS:
        hit = _has_any(text, single)
        for left, right in pairs:
            hit = hit | (_has_any(text, left) & _has_any(text, right))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def shell_family(command: Column | str, output: Column | str) -> Column:
    """Family of a shell call; disagreement of command and output is `unknown`."""
    left, right = shell_side(command), shell_side(output)
    some = (F.length(F.coalesce(_col(command), F.lit(""))) > 0) | (F.length(F.coalesce(_col(output), F.lit(""))) > 0)
    return (
        F.when(left.isNotNull() & right.isNotNull() & (left != right), "unknown")
        .when(F.coalesce(left, right).isNotNull(), F.coalesce(left, right))
        .when(some, "generic")
        .otherwise("unknown")
    )


# Compressor id prefixes and their tool family.
COMPRESSOR_PREFIXES = (
    ("search.", "search"), ("tests.", "tests"), ("build.", "build"), ("lint.", "lint"),
    ("dependency.", "dependency"), ("version_control.", "version_control"), ("shell.", "shell_generic"),
    ("json.", "generic_control"), ("text.", "generic_control"),
)


def compressor_family(compressor: Column | str) -> Column:
    compressor = _col(compressor)
    out = None
    for prefix, family in COMPRESSOR_PREFIXES:
        hit = compressor.startswith(prefix)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("unknown")


# --- sizes, risks, buckets -----------------------------------------------------------------------


def length_bucket(value: Column | str, missing: str = "unavailable") -> Column:
    value = _col(value)
    return (
        F.when(value.isNull(), missing)
        .when(value <= 0, "0")
        .when(value == 1, "1")
        .when(value < 10, "2-9")
        .when(value < 100, "10-99")
        .when(value < 1000, "100-999")
        .otherwise("1000+")
    )


# Upper limits (exclusive, then inclusive of nothing) of token size buckets.
TOKEN_BUCKETS = ((256, "<256"), (1024, "256-1K"), (4096, "1K-4K"), (16384, "4K-16K"))


def token_bucket(tokens: Column | str) -> Column:
    tokens = _col(tokens)
    out = None
    for limit, name in TOKEN_BUCKETS:
        out = F.when(tokens < limit, name) if out is None else out.when(tokens < limit, name)
    return out.otherwise(">16K")


def byte_bucket(size: Column | str) -> Column:
    size = _col(size)
    return F.when(size < 1024, "<1KiB").when(size < 1048576, "1KiB-1MiB").otherwise(">=1MiB")


def quartile_label(value: Column | str, q1: Column, q2: Column, q3: Column) -> Column:
    """Label from inclusive boundaries; unknown value or boundary gives `unknown`."""
    value = _col(value)
    return (
        F.when(value.isNull() | q1.isNull(), "unknown")
        .when(value <= q1, "q1")
        .when(value <= q2, "q2")
        .when(value <= q3, "q3")
        .otherwise("q4")
    )


def cache_risk(prefix_bp: Column | str, persistence: Column | str) -> Column:
    """Risk of disturbing the provider cache, from the preserved prefix and persistence."""
    prefix_bp = _col(prefix_bp)
    return (
        F.when(prefix_bp.isNull(), "unknown")
        .when((prefix_bp >= 9000) & (F.coalesce(_col(persistence), F.lit(0)) > 1), "low")
        .when(prefix_bp >= 5000, "medium")
        .otherwise("high")
    )


def byte_quarter_tokens(size: Column | str) -> Column:
    """A quarter of the bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(_col(size) / 4))


def context_status(
    previous: Column, conversation: Column, items: Column, prompt: Column, opaque: Column,
    files: Column, images: Column, complete: Column,
) -> Column:
    """Logical context status from the visibility flags."""
    managed = previous | conversation | items | prompt | opaque
    external = files | images
    return (
        F.when(managed & external, "mixed_partial")
        .when(managed, "provider_managed_partial")
        .when(external, "external_references_partial")
        .when(complete, "explicit_only")
        .otherwise("unknown")
    )


def role_of(text: Column | str) -> Column:
    text = _col(text)
    return F.when(text.isin("system", "developer", "user", "assistant", "tool"), text).otherwise("unknown")


def origin_of_role(role: Column | str) -> Column:
    role = _col(role)
    return (
        F.when(role.isin("system", "developer", "user"), "human_authored")
        .when(role == "assistant", "agent_generated")
        .when(role == "tool", "tool_generated")
        .otherwise("unknown")
    )


def recovery_id(fingerprint: Column | str) -> Column:
    """Handle of a recoverable original: the first eight bytes of its fingerprint."""
    return F.concat(F.lit("recovery-"), F.substring(_col(fingerprint), 1, 16))


def text_handle(value: Column | str, max_bytes: int) -> Column:
    """Bounded text with a truncation flag and the hash of the whole value."""
    raw = F.encode(_col(value), "utf-8")
    return F.struct(
        F.decode(F.substring(raw, 1, max_bytes), "utf-8").alias("text"),
        (F.octet_length(raw) > max_bytes).alias("truncated"),
        F.sha2(raw, 256).alias("hash"),
    )
