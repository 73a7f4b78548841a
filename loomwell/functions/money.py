"""Exact decimal costs and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,12)"
# HTTP statuses after which a request is tried again.
RETRYABLE = (408, 409, 429, 500, 502, 503, 504)


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cost of a request; rates are per million tokens."""
    total = tokens_in.cast("decimal(18,0)") * rate_in.cast("decimal(12,6)") + tokens_out.cast("decimal(18,0)") * rate_out.cast("decimal(12,6)")
    return (total * F.lit("0.000001").cast("decimal(7,6)")).cast(MONEY)


def report(c: Column) -> Column:
    """Six places, halves away from zero."""
    return F.round(c.cast(MONEY), 6)


def report_even(c: Column, places: int = 2) -> Column:
    """Doubles of a report, halves to the even digit."""
    return F.bround(c.cast("double"), places)


def retry_delay(attempt: Column, *, initial: float = 2.0, factor: float = 2.0, most: float = 8.0, hint: Column | None = None) -> Column:
    """Seconds before the next attempt; a longer hint of the server wins."""
    delay = F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(most))
    return delay if hint is None else F.greatest(delay, F.coalesce(hint.cast("double"), F.lit(0.0)))


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)
