"""Token usage totals under the completeness rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import (
    PROVIDER, complete_sum, difference_if_positive, guarded, ratio, source_tag,
)
from ..sources.trace import Trace
from .views import latest_snapshots, request_usage

COUNTERS = ("input_total", "input_cached", "input_uncached", "output_total", "output_reasoning")


def _totals(present: Column | str | None = None) -> list[Column]:
    return [guarded(complete_sum(c, present)).alias(f"__{c}") for c in COUNTERS]


def _published() -> list[Column]:
    """Totals, the derived uncached count and the cache ratio, each with its source tag."""
    uncached = F.coalesce(
        F.col("__input_uncached"), difference_if_positive("__input_total", "__input_cached")
    )
    named = {
        "input_tokens": F.col("__input_total"),
        "cached_input_tokens": F.col("__input_cached"),
        "uncached_input_tokens": uncached,
        "output_tokens": F.col("__output_total"),
        "reasoning_tokens": F.col("__output_reasoning"),
        "cache_ratio": ratio("__input_cached", "__input_total"),
    }
    out = []
    for name, value in named.items():
        out += [value.alias(name), source_tag(value, PROVIDER).alias(f"{name}_source")]
    return out


def usage_summary(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Summary over request facts (one row per request), overall or per key."""
    keys = keys or []
    totals = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("request_count"), *_totals())
    return totals.select(*keys, "request_count", *_published())


def total_usage(trace: Trace, session_id=None) -> DataFrame:
    """Usage of all requests, or of one session."""
    facts = request_usage(trace)
    if session_id is not None:
        facts = facts.where(F.col("session_id") == F.lit(session_id))
    return usage_summary(facts)


def session_usage(trace: Trace) -> DataFrame:
    """Usage per session."""
    return usage_summary(request_usage(trace), ["session_id"])


def analyzed_usage(trace: Trace) -> DataFrame:
    """Usage of the requests that have a latest snapshot."""
    analyzed = latest_snapshots(trace.snapshots).select(F.col("provider_request_id").alias("request_id"))
    requests = trace.requests.join(analyzed, "request_id", "left_semi")
    return usage_summary(request_usage(trace, requests))
