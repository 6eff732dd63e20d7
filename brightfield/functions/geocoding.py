"""Whether a geocoder's answer is about the place that was asked for, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightfield.functions.binding import let
from brightfield.functions.geo import usable
from brightfield.functions.text import fold

# Words that say nothing in a street, and the names of countries.
PLAIN_STREET_WORDS = tuple("avenue ave boulevard blvd building bldg drive dr floor fl highway hwy lane ln place pl road rd route rte street st suite ste unit way".split())
COUNTRY_NAMES: dict[str, tuple[str, ...]] = {
    "AE": ("united arab emirates", "uae"), "AR": ("argentina",), "AT": ("austria",), "AU": ("australia",), "BE": ("belgium",), "BR": ("brazil", "brasil"), "CA": ("canada",),
    "CH": ("switzerland", "schweiz", "suisse", "svizzera"), "CL": ("chile",), "CO": ("colombia",), "CR": ("costa rica",), "CZ": ("czechia", "czech republic"), "DE": ("germany", "deutschland"), "DK": ("denmark",),
    "ES": ("spain", "espana"), "FI": ("finland",), "FR": ("france",), "GB": ("united kingdom", "uk", "england", "scotland", "wales", "northern ireland"), "GR": ("greece",), "ID": ("indonesia",),
    "IE": ("ireland",), "IL": ("israel",), "IN": ("india",), "IS": ("iceland",), "IT": ("italy", "italia"), "JP": ("japan",), "KR": ("south korea", "republic of korea"), "MX": ("mexico",), "MY": ("malaysia",),
    "NL": ("netherlands",), "NO": ("norway",), "NZ": ("new zealand",), "PA": ("panama",), "PE": ("peru",), "PH": ("philippines",), "PL": ("poland",), "PT": ("portugal",), "QA": ("qatar",), "SA": ("saudi arabia",),
    "SE": ("sweden",), "SG": ("singapore",), "TH": ("thailand",), "TR": ("turkiye", "turkey"), "US": ("united states", "united states of america", "usa"), "ZA": ("south africa",),
}


def plain(c: Column) -> Column:
    """Folded ASCII letters and digits with single spaces, "&" read as "and"; empty for null."""
    return F.trim(F.regexp_replace(F.replace(fold(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def says(plain_text: Column, plain_phrase: Column) -> Column:
    """Whether whole words of a plain text are a phrase that is not empty."""
    return (plain_text != "") & (plain_phrase != "") & F.concat(F.lit(" "), plain_text, F.lit(" ")).contains(F.concat(F.lit(" "), plain_phrase, F.lit(" ")))


def street_match(expected: Column, actual: Column) -> Column:
    """struct(match, strong, number): the first number of a plain street, and two of its telling words, or all if they are fewer."""
    number = F.nullif(F.regexp_extract(expected, "\\b[0-9]+[a-z]?\\b", 0), F.lit(""))
    telling = F.filter(F.array_distinct(F.split(expected, " ")), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+[a-z]?$") & ~w.isin(*PLAIN_STREET_WORDS))
    shared = F.size(F.array_intersect(telling, F.split(actual, " ")))
    found = F.struct(number.alias("number"), F.coalesce(F.array_contains(F.split(actual, " "), number), F.lit(False)).alias("same"), F.size(telling).alias("telling"), shared.alias("shared"))

    def of(x: Column) -> Column:
        words = (x["telling"] > 0) & (x["shared"] >= F.least(x["telling"], F.lit(2)))
        there = (expected != "") & (actual != "")
        return F.struct((there & words & (x["number"].isNull() | x["same"])).alias("match"), (there & x["same"] & (x["shared"] >= 2)).alias("strong"), (there & x["same"]).alias("number"))

    return let(found, of)


def country_match(address: Column, code: Column, names: Mapping[str, Sequence[str]] = COUNTRY_NAMES) -> Column:
    """Whether the longest country name in a plain address is the code's; null if it names none, or the code is not known."""
    every = F.array(*[F.struct(F.lit(-len(n)).alias("size"), F.lit(i).alias("turn"), F.lit(k).alias("code"), F.lit(n).alias("name")) for i, (k, n) in enumerate((k, n) for k, some in names.items() for n in some)])
    found = F.array_min(F.filter(every, lambda x: says(address, x["name"])))
    return F.when(F.upper(F.trim(code)).isin(*names), found["code"] == F.upper(F.trim(code)))


def validated(latitude: Column, longitude: Column, formatted: Column, address: Column, locality: Column, region: Column, postal: Column, code: Column) -> Column:
    """struct(valid, reason, street, locality, region, postal, country) of an answer's coordinates and formatted address.

    The street must match, in its locality or postal code, or else its region, or else its country; a place without a street needs its
    locality and one of these. An address in another country never matches.
    """
    texts = F.struct(plain(formatted).alias("actual"), plain(address).alias("address"), plain(locality).alias("locality"), plain(region).alias("region"), F.replace(plain(postal), F.lit(" "), F.lit("")).alias("postal"))

    def judged(t: Column) -> Column:
        checks = F.struct(
            street_match(t["address"], t["actual"]).alias("street"),
            says(t["actual"], t["locality"]).alias("locality"),
            says(t["actual"], t["region"]).alias("region"),
            ((t["postal"] != "") & (t["actual"] != "") & F.replace(t["actual"], F.lit(" "), F.lit("")).contains(t["postal"])).alias("postal"),
            country_match(t["actual"], code).alias("country"),
        )

        def decided(x: Column) -> Column:
            named = F.coalesce(x["country"], F.lit(False))
            context = F.when((t["locality"] != "") | (t["postal"] != ""), x["locality"] | x["postal"]).when(t["region"] != "", x["region"]).otherwise(named | x["street"]["strong"])
            beside = F.when(t["postal"] != "", x["postal"]).when(t["region"] != "", x["region"]).otherwise(named)
            same = F.when(t["address"] != "", x["street"]["match"] & context).when(t["locality"] != "", x["locality"] & beside).otherwise(F.lit(False))
            same = same & F.coalesce(x["country"], F.lit(True))
            there, written = usable(latitude, longitude), F.trim(F.coalesce(formatted, F.lit(""))) != ""
            wrong = F.when(F.coalesce(~x["country"], F.lit(False)), "country_mismatch").otherwise("address_identity_mismatch")
            reason = F.when(~there, "coordinates_out_of_range").when(~written, "formatted_address_missing").when(~same, wrong).otherwise("identity_validated")
            return F.struct((there & written & same).alias("valid"), reason.alias("reason"), x["street"]["match"].alias("street"), x["locality"].alias("locality"), x["region"].alias("region"), x["postal"].alias("postal"), x["country"].alias("country"))

        return let(checks, decided)

    return let(texts, judged)
