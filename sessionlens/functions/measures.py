"""Measures that keep "unknown" apart from "zero".

A total is published only if every contributing row carried a value; a ratio is NULL when either
side is NULL or the denominator is zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVIDER = "provider_reported"
LOCAL = "locally_estimated"
UNAVAILABLE = "unavailable"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def complete_sum(value: Column | str, present: Column | str | None = None) -> Column:
    """Sum over the group, NULL unless the group has rows and every row has a value.

    `present` restricts which rows count as contributing (it must be non-NULL on those), which is
    what a left join needs: rows without a partner do not count.
    """
    value = _col(value)
    rows = F.count(F.lit(1)) if present is None else F.count(_col(present))
    return F.when((rows > 0) & (F.count(value) == rows), F.sum(value))


def guarded(value: Column | str) -> Column:
    """Counters are unsigned: a negative stored value reads as unknown."""
    value = _col(value)
    return F.when(value >= 0, value)


def nonnegative(value: Column | str) -> Column:
    """Counters where a missing or negative value reads as zero."""
    value = _col(value)
    return F.when(value >= 0, value).otherwise(F.lit(0))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator as double; NULL for a NULL side or a zero denominator."""
    top, bottom = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(bottom != 0, top / bottom)


def basis_points(numerator: Column | str, denominator: Column | str) -> Column:
    """Truncating share in 1/10000, clamped to 10000."""
    top, bottom = _col(numerator), _col(denominator)
    share = F.call_function("div", top * F.lit(10000).cast("bigint"), bottom)
    return F.when(bottom != 0, F.least(F.lit(10000).cast("bigint"), share))


def basis_points_half_even(numerator: Column | str, denominator: Column | str) -> Column:
    """Share in 1/10000, rounded half to even, clamped to 10000."""
    top, bottom = _col(numerator).cast("double"), _col(denominator).cast("double")
    share = F.bround(top * 10000.0 / bottom, 0).cast("bigint")
    return F.when(bottom != 0, F.least(F.lit(10000).cast("bigint"), share))


def parts_per_million(numerator: Column | str, denominator: Column | str) -> Column:
    """Truncating share in 1/1000000; a numerator above the denominator saturates."""
    top, bottom = _col(numerator), _col(denominator)
    scaled = F.least(top, bottom) * F.lit(1000000).cast("bigint")
    return F.when(bottom != 0, F.call_function("div", scaled, bottom))


def difference_if_positive(total: Column | str, part: Column | str) -> Column:
    """total - part, NULL if it would be negative or a side is unknown."""
    total, part = _col(total), _col(part)
    return F.when(total >= part, total - part)


def source_tag(value: Column | str, source: str) -> Column:
    """Where a published number came from; `unavailable` for an unknown one."""
    return F.when(_col(value).isNull(), F.lit(UNAVAILABLE)).otherwise(F.lit(source))


def metric(value: Column | str, source: str) -> Column:
    """Value and its source tag side by side."""
    value = _col(value)
    return F.struct(value.alias("value"), source_tag(value, source).alias("source"))


def count_where(condition: Column) -> Column:
    """Number of rows where the condition holds (0 for an empty group)."""
    return F.count(F.when(condition, F.lit(1)))


def or_label(value: Column | str, label: str = "unavailable") -> Column:
    """NULL becomes the label."""
    return F.coalesce(_col(value), F.lit(label))


def or_unknown(value: Column | str) -> Column:
    """NULL and the empty string become `unknown`."""
    return F.coalesce(F.nullif(_col(value).cast("string"), F.lit("")), F.lit("unknown"))


def relative_distance(left: Column | str, right: Column | str) -> Column:
    """|a-b| over the mean of both, the mean being at least 1."""
    left, right = _col(left).cast("double"), _col(right).cast("double")
    return F.abs(left - right) / F.greatest((left + right) / 2.0, F.lit(1.0))


def relative_change(control: Column | str, treatment: Column | str) -> Column:
    """(treatment - control) / control."""
    return ratio(_col(treatment) - _col(control), control)
