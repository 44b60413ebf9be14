"""Characterise block text: content kind, line and JSON features, opportunity signals, shape, parsers.

Text never crosses a shuffle here: every measure is computed on the row that holds the text, by native expressions, or on
Arrow batches of such rows. A Python parser sees only rows that can be JSON at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detection import detected
from ..functions.jsontext import json_facts, json_shape, search_matches
from ..functions.labels import length_bucket
from ..functions.measures import basis_points, complete_sum, count_where, parts_per_million
from ..functions.text import doubled, feature_lines, line_count, line_signals, structural_tokens

# Kinds whose content is held elsewhere, so there is nothing to inspect.
UNINSPECTABLE = (
    "image_reference", "file_reference", "item_reference", "prompt_reference", "provider_state_reference",
    "opaque", "opaque_reasoning",
)
MAY_BE_JSON = r'^\s*(?:[\[{"]|-?\d|(?:true|false|null)\s*$)'


def with_signals(df: DataFrame, text: str = "text", kind: str | None = None) -> DataFrame:
    """Add struct columns `sig` (line counters) and `js` (JSON facts)."""
    content = F.col(text)
    counted = df.withColumn("sig", F.struct(*line_signals(text), F.octet_length(content).alias("bytes")))
    plausible = content.rlike(MAY_BE_JSON) | (F.col("sig.json_starts") >= 2)
    return counted.withColumn("js", json_facts(F.when(plausible, content)))


def detect(df: DataFrame, kind: Column | None = None) -> DataFrame:
    """Add `sig`, `js`, `detected_kind` and `confidence` for the column `text`.

    Rules in fixed precedence (`functions/detection.py`) look at whole batches of texts, each text once; what `sig` and
    `js` hold is found where it is read.
    """
    content = F.col("text")
    plausible = content.rlike(MAY_BE_JSON) | (line_count("json_starts", content, doubled(content)) >= 2)
    out = df.withColumn("__found", detected("text"))
    found = lambda field, other: (
        F.col(f"__found.{field}") if kind is None else F.when(kind.isin(*UNINSPECTABLE), other).otherwise(F.col(f"__found.{field}"))
    ).alias(field if field == "confidence" else "detected_kind")
    return out.select(
        *df.columns, F.struct(*line_signals("text"), F.octet_length("text").alias("bytes")).alias("sig"), json_facts(F.when(plausible, content)).alias("js"),
        found("kind", "unknown"), found("confidence", "low"),
    )


def features(df: DataFrame) -> DataFrame:
    """Add line and JSON features to a detected frame (whole texts, ratios in parts per million)."""
    lines = F.col("__lines")
    distinct = F.col("__distinct")
    count = F.size(lines).cast("bigint")
    unique = F.size(distinct).cast("bigint")
    bytes_of = lambda array: F.octet_length(F.array_join(array, ""))
    all_bytes = bytes_of(lines).cast("bigint")
    textual = F.col("detected_kind") != "binary_like"
    is_json, is_lines = F.col("detected_kind") == "json", F.col("detected_kind") == "ndjson"
    per_million = lambda part, whole: F.when(textual, parts_per_million(part, whole))
    prepared = df.withColumn("__lines", feature_lines("text")).withColumn("__distinct", F.array_distinct("__lines"))
    return prepared.select(
        *df.columns,
        F.octet_length("text").cast("bigint").alias("raw_bytes"),
        F.when(textual, count).alias("line_count"),
        F.when(textual & (count > 0), F.array_max(F.transform(lines, F.octet_length)).cast("bigint")).alias("max_line_bytes"),
        per_million(count - unique, count).alias("duplicate_line_ppm"),
        per_million(unique, count).alias("unique_line_ppm"),
        per_million(F.col("sig.error_lines").cast("bigint"), count).alias("error_line_ppm"),
        per_million(F.col("sig.warning_lines").cast("bigint"), count).alias("warning_line_ppm"),
        per_million(all_bytes - bytes_of(distinct).cast("bigint"), all_bytes).alias("repetition_ppm"),
        F.when(is_json, F.col("js.items")).when(is_lines, F.col("js.line_containers")).alias("json_item_count"),
        F.when(is_json, F.col("js.depth")).when(is_lines, F.col("js.line_depth")).alias("json_depth"),
    )


def opportunity_signals(kind: Column, repeated: Column) -> Column:
    """Names of the structural signals that fire; a low-confidence detection never fires one."""
    sure = F.col("confidence").isin("medium", "high")
    found = lambda name: (F.col("detected_kind") == name) & sure
    size = F.col("raw_bytes")
    counted = lambda n: F.coalesce(F.col("line_count") >= n, F.lit(False))
    duplicates = lambda ppm: F.coalesce(F.col("duplicate_line_ppm") >= ppm, F.lit(False))
    rules = {
        "large_tool_result": (kind == "tool_result") & (size >= 8192),
        "high_duplication": counted(8) & duplicates(500000),
        "homogeneous_json": (found("json") | found("ndjson"))
        & F.coalesce((F.col("json_item_count") >= 8) & (F.col("json_depth") <= 6), F.lit(False)),
        "repetitive_logs": found("log") & counted(32) & duplicates(200000),
        "large_search_result": found("search_results") & (size >= 8192),
        "large_test_output": found("test_results") & (size >= 8192),
        "large_tool_schema": (kind == "tool_definition") & (size >= 4096),
        "repeated_history": repeated & (size >= 1024),
    }
    return F.array_compact(F.array(*[F.when(fires, F.lit(name)) for name, fires in rules.items()]))


def shape(df: DataFrame) -> DataFrame:
    """Add the shape of JSON blocks and of plain text blocks."""
    is_json, is_text = F.col("detected_kind") == "json", F.col("detected_kind") == "plain_text"
    lines = feature_lines("text")
    words = r"^[^\S\n]*\S+[^\S\n]+\S+[^\S\n]+\S"
    log_like = F.size(F.filter(lines, lambda l: l.rlike(words) & l.contains(" ")))
    text_shape = (
        F.when(F.size(F.array_distinct(lines)) < F.size(lines), "duplicate_lines")
        .when(log_like * 2 >= F.greatest(F.size(lines), F.lit(1)), "logs_like")
        .otherwise("plain")
    )
    looked = df.withColumn("__s", json_shape(F.when(is_json, F.col("text"))))
    bucket = lambda name: F.when(F.col(f"__s.{name}").isNotNull(), length_bucket(F.col(f"__s.{name}")))
    return looked.select(
        *df.columns,
        F.col("__s.root_kind").alias("json_root_kind"),
        bucket("array_length").alias("json_array_length_bucket"),
        bucket("key_count").alias("json_key_count_bucket"),
        F.col("__s.homogeneity_bp").alias("json_homogeneity_bp"),
        F.col("__s.primitive_bp").alias("json_primitive_bp"),
        F.col("__s.nested_bp").alias("json_nested_bp"),
        F.when(is_text, text_shape).alias("text_shape"),
    )


def estimate_totals(df: DataFrame, keys: list[str], tokens: str, estimator: str = "estimator") -> DataFrame:
    """Unknown-preserving estimate totals: observed, estimated, subtotal, complete total, one estimator.

    The estimator is named only when every estimate came from the same one.
    """
    known = F.col(tokens).isNotNull()
    names = F.when(known, F.col(estimator))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed_blocks"),
        count_where(known).alias("estimated_blocks"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("subtotal"),
        complete_sum(tokens).alias("complete_total"),
        F.when(F.min(names) == F.max(names), F.min(names)).alias("estimator"),
    )


def semantic_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of blocks with a known content kind, in basis points."""
    known = F.coalesce("detected_kind", F.lit("unknown")) != "unknown"
    return df.groupBy(*keys).agg(
        basis_points(count_where(known), F.count(F.lit(1))).alias("semantic_coverage_bp")
    )


# --- parsers -----------------------------------------------------------------------------------------


def search_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Match rows (file, line, text) of search output, in sorted order per block."""
    parsed = df.select(key, search_matches(F.col(text)).alias("__p"))
    return parsed.select(key, F.posexplode("__p.matches").alias("position", "m")).select(key, "position", "m.*")


def search_leftovers(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of search output that are no match."""
    parsed = df.select(key, search_matches(F.col(text)).alias("__p"))
    return parsed.select(key, F.explode("__p.leftovers").alias("line"))


def test_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Failures (id, message) and summary lines of test-runner output."""
    line = F.regexp_replace(F.col("raw"), "\r$", "")
    exploded = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("position", "raw")).select(
        key, "position", line.alias("line")
    )
    failed = F.col("line").startswith("FAILED ")
    rest = F.substring("line", 8, 2147483647)
    split = F.instr(rest, " - ")
    summary = F.col("line").rlike(" (?:passed|failed|error|skipped)")
    return (
        exploded.where(failed | summary)
        .select(
            key, "position",
            F.when(failed, "failure").otherwise("summary").alias("entry"),
            F.when(failed, F.trim(F.when(split > 0, F.substr(rest, F.lit(1), split - 1)).otherwise(rest))).alias("identifier"),
            F.when(failed, F.when(split > 0, F.trim(F.substr(rest, split + 3))).otherwise(""))
            .otherwise(F.trim("line")).alias("message"),
        )
    )


def test_counts(text: Column | str) -> list[Column]:
    """Passed and failed counts summed over the runner's result lines."""
    text = F.col(text) if isinstance(text, str) else text
    total = lambda word: F.aggregate(
        F.regexp_extract_all(text, F.lit(rf"(\d+) {word}"), F.lit(1)), F.lit(0).cast("bigint"),
        lambda a, n: a + n.cast("bigint"),
    )
    return [total("passed").alias("passed"), total("failed").alias("failed")]


def search_answer(text: Column | str) -> list[Column]:
    """Answer key of a search: non-blank lines and distinct file prefixes."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(text, "\n"), lambda l: F.trim(l) != "")
    files = F.array_distinct(F.transform(F.filter(lines, lambda l: l.contains(":")), lambda l: F.split_part(l, F.lit(":"), F.lit(1))))
    return [F.size(lines).cast("bigint").alias("matches"), F.size(files).cast("bigint").alias("files")]


def tokens_of(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("estimated_tokens", structural_tokens(text)).withColumn("estimator", F.lit("structural_heuristic"))
