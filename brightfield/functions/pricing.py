"""Comparable prices and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightfield.functions.text import blank_to_null

COMPARABLE_UNITS = ("service", "session", "visit")


def comparable(amount: Column, unit: Column, audience: Column, units: tuple[str, ...] = COMPARABLE_UNITS) -> Column:
    """A positive retail price for one of the units; a blank unit is a service, a blank audience retail."""
    return (amount > 0) & F.coalesce(blank_to_null(unit), F.lit("service")).isin(*units) & (F.coalesce(blank_to_null(audience), F.lit("retail")) == "retail")


def shown(amount: Column, most: Column, currency: Column, kind: Column, unit: Column) -> Column:
    """A price as text: two decimals unless whole, ranges, "from" prices, and other units."""
    n = lambda c: F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))
    base = F.concat_ws(" ", F.upper(currency), F.when(most > amount, F.concat(n(amount), F.lit("-"), n(most))).otherwise(n(amount)))
    base = F.when(kind == "starting_at", F.concat(F.lit("From "), base)).otherwise(base)
    return F.when(unit.isNull() | (unit == "service"), base).otherwise(F.concat(base, F.lit(" per "), unit))
