"""Scalar functions: parsing, clamping, rates and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(x, low: float, high: float) -> Column:
    """Within bounds; null stays null, which least and greatest would skip."""
    return F.when(col(x).isNotNull(), F.greatest(F.least(col(x), F.lit(high)), F.lit(low)))


def parsed_int(x, default: int, low: int | None = None, high: int | None = None) -> Column:
    """The whole number within bounds; what isn't one is the default, bounds or not."""
    return _parsed(col(x).try_cast("int"), default, low, high)


def parsed_double(x, default: float, low: float | None = None, high: float | None = None) -> Column:
    return _parsed(col(x).try_cast("double"), default, low, high)


def _parsed(n: Column, default, low, high) -> Column:
    bound = n if low is None else F.greatest(n, F.lit(low))
    bound = bound if high is None else F.least(bound, F.lit(high))
    return F.when(n.isNull(), F.lit(default)).otherwise(bound)


def least_documents(total, absolute: int | None = None, fraction: float | None = None) -> Column:
    """Documents a term must occur in; an absolute number goes before a fraction."""
    return F.lit(absolute) if absolute is not None else F.ceil(F.lit(fraction) * col(total))


def as_fraction(x) -> Column:
    """Percentages above one become fractions."""
    return F.when(col(x) > 1, col(x) / 100).otherwise(col(x))


def iso_utc(ts) -> Column:
    """RFC 3339 in UTC; the session's time zone is UTC."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_from_text(text, now) -> Column:
    """A date text as RFC 3339; ``now`` where it can't be read."""
    return iso_utc(F.coalesce(F.try_to_timestamp(col(text)), col(now)))


def age_seconds(ts, now) -> Column:
    return F.unix_timestamp(col(now)) - F.unix_timestamp(col(ts))


def wordy(value, names: list[str]) -> Column:
    """The first of several possibly missing fields that isn't null, as text."""
    return F.coalesce(*(F.get_json_object(col(value), f"$.{n}") for n in names))
