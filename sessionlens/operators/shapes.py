"""Wide snapshot metrics and structural inventories of blocks and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import byte_bucket, tool_family
from ..functions.measures import count_where, or_label, ratio
from ..functions.ranking import Rank, exact_percentiles, join_on_nullable
from ..schema import BLOCK_KINDS, ORIGINS, ROLES


def snapshot_metrics(snapshots: DataFrame, blocks: DataFrame) -> DataFrame:
    """Token totals of every snapshot by kind, role and origin, shares, and schema totals.

    A total is unknown if one of its blocks has no estimate. A class without blocks is 0 in a
    complete snapshot and unknown otherwise. Repetition inside a snapshot needs one fold by
    fingerprint first, so the wide aggregate runs over folded rows too.
    """
    known = F.col("estimated_tokens").isNotNull()
    full = F.col("status") == "complete"

    def gated(condition: Column, name: str) -> list[Column]:
        return [
            count_where(condition).alias(f"__n_{name}"),
            count_where(condition & ~known).alias(f"__m_{name}"),
            F.coalesce(F.sum(F.when(condition, F.col("estimated_tokens"))), F.lit(0)).alias(f"__t_{name}"),
        ]

    classes = {"all": F.lit(True)}
    for column, values in (("kind", BLOCK_KINDS), ("role", ROLES), ("origin", ORIGINS)):
        for value in values:
            classes[f"{column}_{value}"] = F.col(column) == value
    definition = F.col("kind") == "tool_definition"
    wide = blocks.groupBy("snapshot_id").agg(
        *[c for name, condition in classes.items() for c in gated(F.coalesce(condition, F.lit(False)), name)],
        F.sum("raw_bytes").alias("explicit_bytes"),
        F.sum(F.when(definition, F.col("raw_bytes"))).alias("__schema_bytes"),
        F.max(F.when(definition, F.col("raw_bytes"))).alias("__largest_schema"),
    )
    folded = blocks.groupBy("snapshot_id", "exact_fp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_tokens").alias("t"), count_where(~known).alias("missing"),
        count_where(definition).alias("dn"), F.sum(F.when(definition, F.col("estimated_tokens"))).alias("dt"), count_where(definition & ~known).alias("dm"),
    )

    def part(condition: Column, tokens: str, missing: str, name: str) -> list[Column]:
        return [
            count_where(condition).alias(f"__g_{name}"),
            F.when(F.coalesce(F.sum(F.when(condition, F.col(missing))), F.lit(0)) == 0, F.coalesce(F.sum(F.when(condition, F.col(tokens))), F.lit(0))).alias(f"__s_{name}"),
        ]

    spread = folded.groupBy("snapshot_id").agg(
        *part(F.col("n") == 1, "t", "missing", "unique"), *part(F.col("n") > 1, "t", "missing", "repeated"), *part(F.col("dn") > 1, "dt", "dm", "schema")
    )
    joined = snapshots.select("snapshot_id", "status").join(wide, "snapshot_id", "left").join(spread, "snapshot_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda name: F.when((zero(f"__n_{name}") == 0) & ~full, F.lit(None)).when(zero(f"__m_{name}") == 0, zero(f"__t_{name}"))
    visible = total("all")
    share = lambda value: F.when(visible > 0, value / visible)
    content = lambda name: F.when(zero(f"__g_{name}") > 0, share(F.col(f"__s_{name}"))).when(full, F.lit(0.0))
    counted = lambda value: F.when((zero(value) == 0) & ~full, F.lit(None)).otherwise(zero(value))
    return joined.select(
        "snapshot_id", "explicit_bytes", visible.alias("visible_estimated_tokens"),
        *[total(name).alias(f"tokens_{name}") for name in classes if name != "all"],
        share(total("kind_tool_definition")).alias("tool_definition_share"), share(total("kind_tool_result")).alias("tool_result_share"),
        share(total("origin_human_authored")).alias("human_text_share"), share(total("kind_assistant_history")).alias("assistant_history_share"),
        content("unique").alias("unique_content_share"), content("repeated").alias("repeated_content_share"),
        counted("__n_kind_tool_definition").alias("tool_count"), counted("__schema_bytes").alias("schema_bytes"), counted("__largest_schema").alias("largest_tool_schema"),
        F.when((zero("__n_kind_tool_definition") == 0) & full, F.lit(0)).otherwise(total("kind_tool_definition")).alias("estimated_schema_tokens"),
        F.when(zero("__g_schema") > 0, F.col("__s_schema")).when(full, F.lit(0)).alias("repeated_schema_tokens"),
    )


def signal_union(blocks: DataFrame, signals: str = "signals") -> DataFrame:
    """Distinct opportunity signals of each snapshot (a closed set of eight names)."""
    return blocks.select("snapshot_id", F.explode(signals).alias("signal")).distinct().groupBy("snapshot_id").agg(
        F.array_sort(F.collect_set("signal")).alias("signals")
    )


def candidate_coverage(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evaluations by compressor, input size bucket and content kind."""
    kinds = blocks.select("block_id", or_label("detected_kind").alias("detected_kind"))
    return candidates.join(kinds, "block_id").groupBy("compressor_id", byte_bucket("input_bytes").alias("size_bucket"), "detected_kind").agg(
        F.count(F.lit(1)).alias("evaluations")
    )


def family_characterisation(blocks: DataFrame) -> DataFrame:
    """Tool results by tool family and content kind: tokens, exposure, sizes (floor rank), repeats."""
    rows = blocks.where("origin = 'tool_generated' and kind = 'tool_result'").select(
        tool_family("tool_name").alias("family"), or_label("detected_kind").alias("detected_kind"),
        F.coalesce("estimated_tokens", F.lit(0)).alias("tokens"), F.coalesce("raw_bytes", F.lit(0)).alias("size"), "exact_fp",
    )
    keys = ["family", "detected_kind"]
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.sum("tokens").alias("estimated_tokens"), F.sum("size").alias("raw_bytes"))
    ranks = [Rank(f"raw_bytes_p{int(p * 100)}", p, "floor") for p in (0.50, 0.90, 0.95, 0.99)]
    sizes = exact_percentiles(rows, keys, "size", ranks).drop("count")
    copies = rows.where("exact_fp is not null").groupBy(*keys, "exact_fp").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_fingerprints"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_blocks")
    )
    whole = totals.agg(F.sum("estimated_tokens").alias("__all"))
    out = join_on_nullable(join_on_nullable(totals, sizes, keys), copies, keys, "left").crossJoin(F.broadcast(whole))
    return out.select(
        *keys, "blocks", "estimated_tokens", "raw_bytes", ratio("estimated_tokens", "__all").alias("exposure_share"), *[r.name for r in ranks],
        F.coalesce("unique_fingerprints", F.lit(0)).alias("unique_fingerprints"), F.coalesce("repeated_blocks", F.lit(0)).alias("repeated_blocks"),
    )


def shape_counts(blocks: DataFrame, item_count: str, depth: str, lines: str, duplicates: Column) -> DataFrame:
    """JSON and text shapes of tool results with blocks, tokens and bytes."""
    items, deep = F.col(item_count), F.col(depth)
    json_shape = F.when(items.isNull(), "object_or_scalar").when(deep > 1, "nested_array_or_object").otherwise("array_or_object")
    text_shape = F.when(duplicates > 0, "duplicate_lines").when(F.col(lines) > 1, "multi_line").otherwise("single_line_or_empty")
    shape = F.when(F.col("detected_kind") == "json", json_shape).when(F.col("detected_kind") == "plain_text", text_shape)
    return blocks.where("origin = 'tool_generated' and kind = 'tool_result'").groupBy("detected_kind", shape.alias("shape")).agg(
        F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("estimated_tokens"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes")
    ).where("shape is not null")


def group_inventory(blocks: DataFrame) -> DataFrame:
    """Structural groups with size extremes and the number of blocks that name a tool."""
    keys = ["origin", "kind", "role", "detected_kind"]
    return blocks.groupBy(*[or_label(k).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.sum("estimated_tokens").alias("estimated_tokens"),
        F.min("raw_bytes").alias("min_bytes"), F.max("raw_bytes").alias("max_bytes"), F.count("tool_name").alias("named_blocks"),
    )


def first_target(inventory: DataFrame) -> DataFrame:
    """The heaviest tool-result group a reduction could address."""
    fits = inventory.where(
        (F.col("origin") == "tool_generated") & (F.col("kind") == "tool_result") & F.col("detected_kind").isin("plain_text", "search_results", "json")
    )
    return fits.orderBy(F.coalesce("estimated_tokens", F.lit(0)).desc(), F.col("blocks").desc(), "origin", "kind", "role", "detected_kind").limit(1)
