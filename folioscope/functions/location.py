"""Arithmetic between characters, locations, percentages and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope import config


def locations_of_length(n_chars: Column, chars: int = config.LOCATION_CHARS) -> Column:
    return F.greatest(F.lit(1), F.ceil(n_chars / F.lit(chars))).cast("int")


def percentage_of(location: Column, total: Column) -> Column:
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), location / total * 100.0))
    return F.when(total <= 0, F.lit(0.0)).otherwise(share)


def location_of_percentage(pct: Column, total: Column) -> Column:
    """Rounds half to even, as the lookup by percentage does."""
    inside = F.greatest(F.lit(1), F.least(total, F.bround(pct / 100.0 * total).cast("int")))
    return F.when((pct <= 0) | (total <= 0), F.lit(1)).when(pct >= 100, total).otherwise(inside).cast("int")


def truncated_location_of_percentage(pct: Column, total: Column) -> Column:
    """Truncates, as the progress update does."""
    return F.greatest(F.lit(1), F.least(total, (pct / 100.0 * total).cast("int"))).cast("int")


def boundary_of(location: Column, total: Column) -> Column:
    """Last location a question may see; an unread book allows location 1."""
    total = F.coalesce(F.nullif(total, F.lit(0)), F.lit(config.DEFAULT_TOTAL_LOCATIONS))
    return F.when(location.isNull() | (location <= 0), F.lit(1)).otherwise(F.least(location, total)).cast("int")


def clamp_location(location: Column, total: Column) -> Column:
    low = F.greatest(F.lit(1), location)
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.least(low, total)).otherwise(low).cast("int")


def location_of_scroll(start: Column, end: Column, fraction: Column) -> Column:
    """Location inside a chapter for a scroll fraction between 0 and 1."""
    raw = F.floor(start + (end - start + 1) * fraction).cast("int")
    return F.greatest(start, F.least(end, raw)).cast("int")
