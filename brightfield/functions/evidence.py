"""What a page or record says about a place: hours, addresses, images, coordinates, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightfield.functions.text import blank_to_null

#: The days of structured opening hours and the keys of an entry.
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
HOUR_KEYS = ("day", "open", "close", "closed", "by_appointment")


def valid_hours(hours: Column) -> Column:
    """Structured hours: an array of seven entries at least with known keys, days of the week, all of them, and in every entry
    exactly one of closed, by appointment, or an opening and a closing time."""
    maps = F.from_json(hours, "array<map<string,string>>")
    time = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
    flag = lambda m, k: F.coalesce(m[k] == "true", F.lit(False)).cast("int")
    timed = lambda m: (F.coalesce(m["open"].rlike(time), F.lit(False)) & F.coalesce(m["close"].rlike(time), F.lit(False))).cast("int")
    entry = lambda m: (F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, HOUR_KEYS)))) == 0) & F.coalesce(m["day"].isin(*DAYS), F.lit(False)) & (flag(m, "closed") + flag(m, "by_appointment") + timed(m) == 1)
    every = F.size(F.array_distinct(F.transform(maps, lambda m: m["day"]))) == len(DAYS)
    return F.coalesce((F.size(maps) >= len(DAYS)) & F.forall(maps, entry) & every, F.lit(False))


def address_text(*parts: Column) -> Column:
    """An address without blank or repeated parts."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*map(blank_to_null, parts)))), ", ")


def place_label(city: Column, region: Column, country: Column) -> Column:
    """City, region and country, without a region that repeats the country or names a continent."""
    shown = F.when(~F.lower(region).isin("europe", "asia", "africa", "america", "oceania") & (F.lower(region) != F.lower(country)), region)
    return F.concat_ws(", ", blank_to_null(city), blank_to_null(shown), blank_to_null(country))


def offering_label(label: Column) -> Column:
    """A label without the same name twice ("A - A"), its first letter large."""
    parts = F.split(F.trim(label), "\\s+-\\s+")
    same = F.forall(parts, lambda p: F.lower(p) == F.lower(parts[0]))
    bare = F.when(same, parts[0]).otherwise(F.trim(label))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)))
