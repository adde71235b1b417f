"""Dates in the notations of sources, as Column expressions that do not depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def published_on(raw: Column, first_year: int = 1990, last_year: int = 2100) -> Column:
    """The day on which an ad was published.

    An ISO date or moment; a moment with an offset counts in UTC, one without as written. Other texts count if their
    first ten characters are an ISO date. Anything else, and years outside the bounds, is null.
    """
    text = F.trim(raw)
    part = lambda k: F.regexp_extract(text, _ISO, k)
    number = lambda c: F.coalesce(F.try_to_number(F.nullif(c, F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")
    zone = part(7)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = number(F.substring(digits, 1, 2)) * 60 + number(F.substring(digits, 3, 2))
    shift = F.when(F.startswith(zone, F.lit("-")), -minutes).when(F.startswith(zone, F.lit("+")), minutes).otherwise(0)
    of_day = number(part(4)) * 60 + number(part(5)) - shift
    sound = (number(part(4)) < 24) & (number(part(5)) < 60) & (number(part(6)) < 60)
    exact = F.when(F.rlike(text, F.lit(_ISO)) & sound, F.date_add(day, F.floor(of_day / 1440).cast("int")))
    plain = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    found = F.coalesce(exact, plain)
    return F.when(F.year(found).between(first_year, last_year), found)


def german_date(text: Column) -> Column:
    """The first dd.mm.yyyy in a text as an ISO date string, or null."""
    pattern = r"(\d{2})\.(\d{2})\.(\d{4})"
    return F.when(F.rlike(text, F.lit(pattern)), F.concat_ws("-", *[F.regexp_extract(text, pattern, k) for k in (3, 2, 1)]))


def rate_per_minute(found: Column, started_at: Column, now: Column) -> Column:
    """Items a minute since a start, rounded half to even; null before any time has passed."""
    elapsed = F.greatest(F.lit(0), F.timestamp_diff("SECOND", started_at, now))
    return F.when(elapsed > 0, F.bround(found / (elapsed / 60)).cast("int"))
