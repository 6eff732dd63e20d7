"""Normalising names, terms, addresses, numbers and links, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightfield.functions.binding import let


def _decomposed(c: str) -> str:
    """The lower-case compatibility decomposition of a character without its marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M")).lower()


_LETTERS = [c for c in map(chr, range(0xA0, 0x10000)) if unicodedata.category(c)[0] in "LN" and not 0xAC00 <= ord(c) < 0xD7A4]
#: Letters and digits whose decomposition is one other character, and that character; those that become several (ligatures).
_SINGLE = {c: d for c in _LETTERS if len(d := _decomposed(c)) == 1 and d != c.lower() and c == c.lower()}
_SEVERAL = {c: d for c in _LETTERS if len(d := _decomposed(c)) > 1 and d.isalnum() and c == c.lower()}


def _ranges(chars: str) -> str:
    """A character class of some characters, ascending, as ranges: a long list of single ones is slow to match."""
    out: list[list[int]] = []
    for k in map(ord, chars):
        if out and k == out[-1][1] + 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


# Letters that fold to others without a decomposition.
_PAIRS = {"æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "đ": "d", "þ": "th", "ø": "o", "ł": "l", "ı": "i"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def fold(c: Column) -> Column:
    """Lower case, compatibility forms as plain letters and digits, without marks, composed or not."""
    plain = F.translate(F.regexp_replace(F.lower(c), "\\p{M}+", ""), "".join(_SINGLE), "".join(_SINGLE.values()))
    several = lambda t: F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(_several_map(), x), x)), "")
    plain = let(plain, lambda t: F.when(t.rlike("[^\\x00-\\x{132}]") & t.rlike(_ranges("".join(_SEVERAL))), several(t)).otherwise(t))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _PAIRS.items(), plain)


def _several_map() -> Column:
    return F.map_from_arrays(F.split(F.lit("".join(_SEVERAL)), ""), F.split(F.lit("\n".join(_SEVERAL.values())), "\n"))


def human_text(c: Column) -> Column:
    """Folded words, "&" read as "and", everything but letters and digits as one space."""
    named = F.replace(fold(c), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(named, "[^\\p{L}\\p{N}]+", " "))


def alnum_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def search_term(c: Column) -> Column:
    """A query term: plus spelled out, letters and digits parted, iv for intravenous, plurals folded."""
    t = fold(F.regexp_replace(c, "[™®]", ""))
    t = F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    t = F.regexp_replace(F.regexp_replace(t, "([a-z])([0-9])", "$1 $2"), "([0-9])([a-z])", "$1 $2")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    t = F.regexp_replace(t, "\\bintravenous\\b", "iv")
    return F.regexp_replace(F.regexp_replace(t, "\\b([a-z]{3,})ies\\b", "$1y"), "\\b([a-z]{3,}[^s\\W])s\\b", "$1")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_base(name: Column, locality: Column) -> Column:
    """The slug of a name, followed by the locality's unless it is contained already."""
    a, b = slug(name), slug(locality)
    return F.when((b == "") | b.isNull() | a.contains(b), a).otherwise(F.concat_ws("-", a, b))


def word_trigrams(c: Column) -> Column:
    """Distinct trigrams of every word, padded by two blanks before and one behind."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def string_trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), c, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


#: Public suffixes of two labels, and hosts shared by unrelated sites.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "co.nz", "com.br", "co.jp", "co.za", "com.mx", "com.sg")
GENERIC_DOMAINS = ("facebook.com", "instagram.com", "google.com", "linktr.ee", "wixsite.com", "squarespace.com", "wordpress.com")


def host(url: Column) -> Column:
    u = F.lower(F.trim(url))
    u = F.when(u.rlike("^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    return blank_to_null(F.regexp_replace(F.regexp_extract(u, "^[a-z][a-z0-9+.-]*://([^/?#:@]+)", 1), "^www\\d*\\.", ""))


def registrable_domain(url: Column) -> Column:
    labels = F.split(host(url), "\\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    return F.when(n < 2, None).when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


#: Query parameters that only track.
TRACKING = "^(utm_[a-z]+|fbclid|gclid|msclkid|mc_[a-z]+|ref)$"


def without_tracking(url: Column) -> Column:
    """A link without tracking parameters and fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    path, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, "^[^?]*\\?", ""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING)), "&")
    return F.when(F.coalesce(kept, F.lit("")) == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def e164(phone: Column, dialing_code: Column, keeps_trunk_zero: Column) -> Column:
    """International form of a phone number, null unless 8 to 15 digits."""
    raw = F.trim(phone)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    national = F.when(keeps_trunk_zero, digits).otherwise(F.regexp_replace(digits, "^0", ""))
    full = F.when(raw.startswith("+"), digits).when(digits.startswith("00"), F.regexp_replace(digits, "^00", ""))
    full = full.when((dialing_code == "1") & (F.length(digits) == 11) & digits.startswith("1"), digits).otherwise(F.concat(dialing_code, national))
    return F.when(F.length(full).between(8, 15), F.concat(F.lit("+"), full))


def email(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return F.when(e.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]{2,}$") & (F.length(e) <= 254), e)


def metric(c: Column) -> Column:
    """A written amount as a number: currency signs and thousands go, k and m multiply, a dash is null."""
    t = F.lower(F.regexp_replace(F.trim(c), "[$€£,\\s]", ""))
    number = F.regexp_extract(t, "^(-?[0-9]+(?:\\.[0-9]+)?)[km]?$", 1).try_cast("double")
    return number * F.when(t.endswith("k"), 1e3).when(t.endswith("m"), 1e6).otherwise(1.0)


def keyword_in_place(keyword: Column, suffix: Column) -> Column:
    """A keyword for a place: "near me" becomes the place, which is appended where absent; null past 12 words or 180 characters."""
    k = F.lower(F.trim(F.regexp_replace(keyword, "\\s+", " ")))
    near = F.regexp_replace(k, "\\b(near me|nearby)\\b", " ")
    k = F.trim(F.regexp_replace(F.when(near.contains(suffix), near).otherwise(F.concat_ws(" ", near, suffix)), "\\s+", " "))
    return F.when((F.size(F.split(k, " ")) <= 12) & (F.length(k) <= 180), k)


def tokens(c: Column) -> Column:
    """Words of a full-text search: lower-case letters with their marks, and digits, of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{M}\\p{N}]+"), F.lit(0))


#: What the agents of robots hold.
ROBOTS = "bot|crawler|spider|scrapy|curl|wget|python-requests|httpclient|preview|validator|lighthouse"


def is_bot(agent: Column) -> Column:
    a = F.lower(F.coalesce(agent, F.lit("")))
    return (a == "") | a.rlike(ROBOTS)
