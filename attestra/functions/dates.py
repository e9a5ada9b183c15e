"""Dates in text, ages, decay and staleness. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which evidence counts half, and after which a field is stale.
HALF_LIFE_DAYS = 30.0
STALE_DAYS = {"fast": 14.0, "stable": 365.0, "default": 45.0}
FAST_HINTS = (
    "revenue", "funding", "raised", "amount", "valuation", "market_cap",
    "headcount", "employee_count", "price", "stock", "cap",
    "date", "updated", "posted", "published", "status", "openings",
    "deadline", "closing", "series", "round", "arr",
)
STABLE_HINTS = (
    "name", "founded", "location", "hq", "website", "url", "domain",
    "industry", "sector", "description", "ceo", "founder", "owner", "parent",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: The formats of a date, in the order in which they are tried.
DATE_FORMATS = ("yyyy-M-d", "d MMM yyyy", "MMM d, yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy")


def iso_date(text: Column) -> Column:
    """The first format that reads the text, as an ISO date; else the text."""
    plain = F.btrim(text)
    guards = (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", r"^[0-9]{4}$")
    tries = [F.when(plain.rlike(g), F.try_to_timestamp(F.initcap(plain), F.lit(f))) for g, f in zip(guards, DATE_FORMATS, strict=True)]
    return F.coalesce(*[F.date_format(t, "yyyy-MM-dd") for t in tries], text)


def date_parts(text: Column, temporal_name: Column) -> Column:
    """struct(year, month, day) of the shapes that the profile reads; a bare year only where the field's name speaks of time."""
    plain = F.btrim(text)
    group = lambda p, i: F.regexp_extract(plain, p, i)
    number = lambda p, i: group(p, i).cast("int")
    month = lambda p, i: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(group(p, i), F.lit(3)))).cast("int")
    ymd, dmy = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    words, named, year = r"^([0-9]{1,2})\s+([A-Za-z]{3,9})\s+([0-9]{4})$", r"^([A-Za-z]{3,9})\s+([0-9]{1,2}),?\s+([0-9]{4})$", r"^([0-9]{4})$"
    made = lambda y, m, d: F.struct(y.alias("year"), m.alias("month"), d.alias("day"))
    least = lambda c: F.greatest(c, F.lit(1))
    return (
        F.when(plain.rlike(ymd), made(number(ymd, 1), least(number(ymd, 2)), least(number(ymd, 3))))
        .when(plain.rlike(dmy), made(number(dmy, 3), least(number(dmy, 2)), least(number(dmy, 1))))
        .when(plain.rlike(words) & (month(words, 2) > 0), made(number(words, 3), month(words, 2), number(words, 1)))
        .when(plain.rlike(named) & (month(named, 1) > 0), made(number(named, 3), month(named, 1), number(named, 2)))
        .when(plain.rlike(year) & temporal_name, made(number(year, 1), F.lit(0), F.lit(0)))
    )


def is_temporal_name(field: Column) -> Column:
    return field.rlike(r"(?i)(year|yr|date|month|day|since|until|deadline|founded|launched|established|incorporated|announced|published|updated|created)")


def age_days(when: Column, now: Column) -> Column:
    """Days from ``when`` to ``now``, never below 0; null if it never happened."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(when)) / F.lit(86_400_000_000.0))


def decay(when: Column, now: Column) -> Column:
    """0.5 per half-life; evidence without a time has not aged."""
    return F.pow(F.lit(0.5), F.coalesce(age_days(when, now), F.lit(0.0)) / F.lit(HALF_LIFE_DAYS))


def stale_after_days(field: Column) -> Column:
    low = F.lower(field)
    return F.when(low.rlike("|".join(FAST_HINTS)), STALE_DAYS["fast"]).when(low.rlike("|".join(STABLE_HINTS)), STALE_DAYS["stable"]).otherwise(STALE_DAYS["default"])


def retry_after_seconds(text: Column, now: Column) -> Column:
    """A Retry-After header as seconds, 300 at most; HTTP dates count from ``now``; 0 if unreadable."""
    plain = F.btrim(text)
    at = F.try_to_timestamp(F.regexp_replace(plain, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)?$"), plain.cast("double")).otherwise(F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros(now)) / F.lit(1e6)))
    return F.least(F.lit(300.0), F.coalesce(seconds, F.lit(0.0)))
