"""Ratings and dates as they are written, and dates by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rating(c: Column) -> Column:
    """A rating from a number, or from the ratingValue of a JSON object."""
    number = "^[0-9]+(\\.[0-9]+)?$"
    inner = F.when(F.trim(c).startswith("{"), F.get_json_object(c, "$.ratingValue"))
    return F.when(F.trim(c).rlike(number), F.trim(c)).when(inner.rlike(number), inner).try_cast("decimal(10,4)")


def review_date(c: Column, fetched: Column) -> Column:
    """The date of a review: ISO, day month year, a long form, or so many units before it was fetched; months and years by month."""
    t = F.trim(c)
    iso = F.try_to_date(F.regexp_extract(t, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    short = F.try_to_date(F.regexp_extract(t, "^([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})$", 1), "d MMM yyyy")
    long_ = F.try_to_date(F.regexp_extract(t, "^[A-Z][a-z]{2}, ([A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}) at", 1), "MMM d, yyyy")
    ago = lambda i: F.regexp_extract(F.lower(t), "^(an?|[0-9]+) (day|week|month|year)s? ago$", i)
    n = F.when(ago(1).isin("a", "an"), F.lit(1)).otherwise(ago(1).try_cast("int"))
    day = F.to_date(fetched)
    months = F.when(ago(2) == "year", n * 12).when(ago(2) == "month", n)
    days = F.when(ago(2) == "week", n * 7).when(ago(2) == "day", n)
    back = F.when(months.isNotNull(), F.trunc(F.add_months(day, -months), "month")).when(days.isNotNull(), F.date_sub(day, days))
    return F.coalesce(iso, short, long_, back)


def next_review(verified: Column, planned: Column, expires: Column) -> Column:
    """The planned day, a week before expiry at the latest, the day after verification at the earliest."""
    return F.greatest(F.date_add(verified, 1), F.least(planned, F.date_sub(expires, 7)))


def earliest_booking(now_utc: Column, zone: Column) -> Column:
    """Two days after today's date where the requester is; in UTC where the zone is unknown."""
    return F.date_add(F.to_date(F.from_utc_timestamp(now_utc, F.coalesce(zone, F.lit("UTC")))), 2)
