"""Markup as column expressions: character references, tags and their attributes, visible text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightfield.functions.binding import let

# References by name.
NAMED = {"&apos;": "'", "&gt;": ">", "&lt;": "<", "&quot;": '"', "&nbsp;": "\xa0"}
_AMPERSAND = "(?i)&(amp|#0{0,5}38|#x0{0,4}26);"


def decoded(c: Column) -> Column:
    """``c`` with its character references decoded, once; unknown names and numbers beyond Unicode stay."""
    value = lambda n: F.when(F.lower(n).startswith("x"), F.conv(F.substring(n, 2, 6), 16, 10)).otherwise(n).cast("int")
    char = lambda v: F.decode(F.unhex(F.lpad(F.hex(v.cast("bigint")), 8, "0")), "UTF-32")
    fine = lambda x: x["v"].between(1, 0x10FFFF) & ~x["v"].between(0xD800, 0xDFFF) & (x["v"] != 38)

    def all_of(t: Column) -> Column:
        numbers = F.array_distinct(F.regexp_extract_all(t, F.lit("&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))
        known = F.filter(F.transform(numbers, lambda n: F.struct(n.alias("n"), value(n).alias("v"))), fine)
        out = t
        for name, letter in NAMED.items():
            out = F.regexp_replace(out, f"(?i){name}", letter)
        every = F.aggregate(known, out, lambda text, x: F.replace(text, F.concat(F.lit("&#"), x["n"], F.lit(";")), char(x["v"])))
        return F.regexp_replace(every, _AMPERSAND, "&")

    return let(c, lambda t: F.when(t.contains("&"), all_of(t)).otherwise(t))


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s\\xa0]+", " "))


def visible_text(html: Column) -> Column:
    """Text outside of scripts, styles and tags, decoded."""
    bare = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", " ")
    return decoded(F.regexp_replace(bare, "<[^>]+>", " "))


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of an attribute in a tag; empty if it has none."""
    found = F.regexp_extract(tag, f"(?is)(?:^|[\\s\"'/]){name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)", 1)
    return decoded(F.regexp_replace(found, "^[\"']|[\"']$", ""))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?i)<{name}\\b[^>]*>"), F.lit(0))
