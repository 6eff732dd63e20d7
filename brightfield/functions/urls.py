"""Web addresses as column expressions: taking them apart, resolving references, comparing origins.

Only http and https count; everything else, addresses with a user name, and malformed hosts are null. Dot segments go, "%2e" counts as a
dot, default ports and fragments go, white space at the ends and line breaks anywhere go, back slashes are slashes, and characters that
may not stand in a path or query are percent-encoded. Host names are lower-cased; names outside of ASCII are not accepted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightfield.functions.binding import let

_UNSAFE = "[^!-~]|[\"<>`{}]"


def _clean(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\n\\r]", "")
    return F.regexp_replace(c, "#.*$", "")


def _encoded(c: Column) -> Column:
    """``c`` with unsafe characters percent-encoded."""
    one = lambda ch: F.when(ch.rlike(_UNSAFE), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)
    return let(c, lambda v: F.when(v.rlike(_UNSAFE), F.array_join(F.transform(F.split(v, ""), one), "")).otherwise(v))


def _authority(scheme: Column, raw: Column) -> Column:
    """Host and port in lower case, without a default port; null if malformed."""
    low = F.regexp_replace(F.lower(raw), F.when(scheme == "http", F.lit(":(80)?$")).otherwise(F.lit(":(443)?$")), F.lit(""))
    return let(low, lambda v: F.when(v.rlike("^[a-z0-9_-]+(\\.[a-z0-9_-]+)*\\.?(:[0-9]{1,5})?$"), v))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, without "." and ".." segments."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    plain = F.transform(segments, lambda s: F.when(F.lower(s).rlike("^(\\.|%2e){1,2}$"), F.regexp_replace(F.lower(s), "%2e", ".")).otherwise(s))
    done = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    walked = lambda x: F.concat(F.lit("/"), F.array_join(F.aggregate(x, F.array().cast("array<string>"), done), "/"))
    ended = lambda x: let(walked(x), lambda y: F.when(F.element_at(x, -1).isin(".", "..") & ~y.endswith("/"), F.concat(y, F.lit("/"))).otherwise(y))
    return let(path, lambda v: F.when(v.rlike("(?i)/(\\.|%2e)"), let(plain, ended)).otherwise(v))


def _split_path(tail: Column) -> tuple[Column, Column]:
    """Path and query of what follows an authority, or of a reference; back slashes of the path are slashes."""
    return F.translate(F.regexp_replace(tail, "\\?.*$", ""), "\\", "/"), F.regexp_extract(tail, "\\?.*$", 0)


def parts(url: Column) -> Column:
    """struct(scheme, authority, path, query) of an absolute address, null if it is none. The query keeps its "?"."""

    def of(x: Column) -> Column:
        path, query = _split_path(x["tail"])
        whole = F.struct(x["scheme"].alias("scheme"), x["authority"].alias("authority"), without_dots(_encoded(F.when(path == "", F.lit("/")).otherwise(path))).alias("path"), _encoded(query).alias("query"))
        return F.when(x["authority"].isNotNull(), whole)

    scheme = lambda u: F.lower(F.regexp_extract(u, "(?i)^(https?):[/\\\\]{2}", 1))
    rest = lambda u: F.regexp_replace(u, "^[A-Za-z]+:[/\\\\]+", "")
    parted = lambda y: F.struct(y["scheme"].alias("scheme"), _authority(y["scheme"], F.regexp_extract(y["rest"], "^[^/\\\\?]*", 0)).alias("authority"), F.regexp_replace(y["rest"], "^[^/\\\\?]*", "").alias("tail"))
    known = lambda y: F.when(y["scheme"] != "", let(parted(y), of))
    return let(_clean(url), lambda u: let(F.struct(scheme(u).alias("scheme"), rest(u).alias("rest")), known))


def joined(p: Column) -> Column:
    """The address of parts(); null if they are."""
    return F.concat(p["scheme"], F.lit("://"), p["authority"], p["path"], p["query"])


def origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["authority"])


def absolute(url: Column) -> Column:
    return let(parts(url), joined)


def reference(ref: Column) -> Column:
    """struct(kind, whole, path, query) of a reference: what resolved() needs, looked at once."""

    def of(r: Column) -> Column:
        path, query = _split_path(r)
        kind = lambda p: F.when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute").when(p.startswith("//"), "host").when(p.startswith("/"), "root").when(p != "", "relative").when(r != "", "query").otherwise("same")
        return let(path, lambda p: F.struct(kind(p).alias("kind"), r.alias("whole"), p.alias("path"), _encoded(query).alias("query")))

    return let(_clean(ref), of)


def resolved(ref: Column, base: Column) -> Column:
    """The absolute address of a reference() on a page with the parts() ``base``; null if there is none."""

    def of(x: Column) -> Column:
        r, b = x["ref"], x["base"]
        kind, path = r["kind"], r["path"]
        whole = F.when(kind == "absolute", r["whole"]).otherwise(F.concat(b["scheme"], F.lit(":"), F.translate(r["whole"], "\\", "/")))
        own = F.when(kind == "root", path).when(kind == "relative", F.concat(F.regexp_extract(b["path"], "^.*/", 0), path))
        here = F.when(kind.isin("root", "relative"), without_dots(_encoded(own))).otherwise(b["path"])
        query = F.when(kind == "same", b["query"]).otherwise(r["query"])
        return F.when(kind.isin("absolute", "host"), absolute(whole)).otherwise(F.concat(origin(b), here, query))

    return let(F.struct(ref.alias("ref"), base.alias("base")), of)


def canonical(url: Column) -> Column:
    """An absolute address without slashes at the end of its path, but for a path of one slash."""
    bare = lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    of = lambda u: F.concat(F.regexp_extract(u, "^[a-z]+://[^/?]+", 0), let(F.regexp_extract(u, "^[a-z]+://[^/?]+([^?]*)", 1), bare), F.regexp_extract(u, "\\?.*$", 0))
    return let(url, of)
