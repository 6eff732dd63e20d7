"""Rules over written text: menu terms, hours, requests, ratings, amounts, identity checks, decisions between proposals.

The raw texts are made of table columns by expressions that Spark and DuckDB share; each rule then reads the text, once as a column
expression here and once more, on its own, in the query's SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.functions import dates, evidence, geocoding, markup, text
from brightfield.functions.binding import let
from brightfield.operators.components import written
from brightfield.plans import crawl
from brightfield.raw import duck, made, made_sql, pick
from brightfield.registry import query
from brightfield.roles import active, locations, offerings, read, sql

_K, _P, _S = "c_custkey", "p_partkey", "s_suppkey"
_FOLD = "strip_accents(lower(coalesce({c}, '')))"
_WORDS = "trim(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g'))"

# ---- menu terms ----

# What a menu term loses or writes otherwise, in turn; the first before, the others after the text is folded to words.
MENU_PRICES = r"(?:[$€£¥]|\b(?:usd|eur|gbp|cad|aud|nzd|chf|aed|sgd|jpy|mxn)\b)\s*[0-9,.]+"
MENU_WORDS = (
    (r"\b(bpc|aod|cjc|tb|pt)([0-9])", r"\1 \2"),
    (r"\bmotsc\b", "mots c"),
    (r"\bghkcu\b", "ghk cu"),
    (r"\bintravenous\b", "iv"),
    (r"\bnad plus\b", "nad"),
    (r"\bv o 2\b", "vo2"),
    (r"\b[0-9]+(?:\.[0-9]+)?\s*(?:minutes?|mins?|hours?|hrs?|sessions?|visits?|packs?|units?|mg|mcg|g|ml|cc|iu|oz)\b", " "),
    (r"\b(?:new patient|initial|introductory|follow up|members?|specials?|promotion|packages?|bundles?|virtual|online)\b", " "),
)


def menu_term(c: Column) -> Column:
    """A menu's item without prices, amounts and offers, its names written one way."""
    words = text.human_text(F.regexp_replace(F.lower(c), MENU_PRICES, " "))
    words = reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1].replace("\\", "$")), MENU_WORDS, words)
    return F.trim(F.regexp_replace(words, "\\s+", " "))


def _menu_sql(c: str) -> str:
    made_ = f"trim(regexp_replace(replace(strip_accents(regexp_replace(lower({c}), '{MENU_PRICES}', ' ', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, by in MENU_WORDS:
        made_ = f"regexp_replace({made_}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({made_}, '\\s+', ' ', 'g'))"


_MENU_ITEMS = {"id": _P, "raw": pick(_P, "'New Patient ' || p_name || ' $1,200.50 - ' || CAST(p_size AS STRING) || ' minutes'", "'BPC157 & CJC1295 ' || p_type || ' ' || CAST(p_size AS STRING) || ' mg'", "'MOTSc / GHKCu Intravenous NAD plus 2 Sessions'", "'V.O.2 test EUR 90, package of 3 visits: ' || p_name", "'Initial  Glp-1 (follow up) 10 units, Online'", "p_name || ' £45.00 pt141 1.5 hrs usd' || CAST(p_size AS STRING)")}


@query("n4_menu_terms", f"SELECT id, {_menu_sql('raw')} AS term FROM ({made_sql(_MENU_ITEMS, 'part')})")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return made(read(spark, d, "part"), _MENU_ITEMS).select("id", menu_term(F.col("raw")).alias("term"))


# ---- extracted offerings ----

# The least confidence, and labels of navigation.
CONFIDENT = 0.85
NAVIGATION = ("services", "treatments", "menu", "pricing", "book now", "learn more")


def judged_offerings(raw: DataFrame, pages: DataFrame, mapped: DataFrame) -> DataFrame:
    """``raw`` (id, name, confidence, source, evidence, price, currency) with ``decision``: accepted, or why not.

    ``pages`` (url, content) were crawled, ``mapped`` (term, treatment_id) has the known terms. Accepted offerings of one term whose
    prices differ lose them: "price_conflict". Each term is decided by aggregates, so many copies of an offering cost little.
    """
    plain = lambda c: text.human_text(F.coalesce(F.col(c), F.lit("")))
    within = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    # A page is folded once, and what it says of an offering is known before terms are looked up.
    p = pages.select(F.col("url").alias("source"), F.when(F.col("content").isNotNull(), plain("content")).alias("page"))
    r = raw.select("id", "name", "confidence", "source", "price", "currency", F.when(F.trim("name") != "", menu_term(F.col("name"))).alias("term"), plain("evidence").alias("said"), plain("name").alias("called"))
    r = r.join(p, "source", "left").select("id", "term", "confidence", "price", "currency", F.col("page").isNull().alias("uncrawled"), ((F.col("said") != "") & within("page").contains(F.trim("said"))).alias("quoted"), within("said").contains(F.trim("called")).alias("named"))
    reason = (
        F.when(F.coalesce("term", F.lit("")) == "", "missing_or_invalid_name")
        .when(~F.coalesce(F.col("confidence").between(CONFIDENT, 1.0), F.lit(False)), "below_confidence_threshold")
        .when(F.col("term").isin(*NAVIGATION), "generic_or_navigation_label")
        .when(F.col("uncrawled"), "source_page_not_crawled")
        .when(~F.col("quoted"), "evidence_not_found_on_page")
        .when(~F.col("named"), "service_name_not_in_evidence")
        .when(~F.col("term").contains(" ") & F.col("treatment_id").isNull(), "unmapped_single_word_not_specific")
    )
    r = written(r.join(mapped, "term", "left").select("id", "term", "treatment_id", "price", "currency", reason.alias("reason")), "offerings")
    price = F.concat_ws(" ", F.coalesce(F.col("price").cast("string"), F.lit("none")), "currency")
    prices = r.where("reason IS NULL").groupBy("term").agg(F.count_distinct(price).alias("prices"))
    made_ = r.join(prices, "term", "left")
    decision = F.coalesce("reason", F.when(F.col("prices") > 1, "price_conflict").otherwise("accepted"))
    return made_.select("id", "term", "treatment_id", decision.alias("decision"), F.when(decision == "accepted", F.col("price")).alias("price"))


_EXTRACTED = {
    "id": _K, "name": pick(_K, "'Red Widget 30 min'", "'small ring'", "'services'", "'Widget'", "'  '", "'Blue Bolt (new patient)'", "'gadget deluxe ' || CAST(c_custkey % 50 AS STRING)"),
    "confidence": pick("(c_custkey div 7)", "0.9", "0.99", "0.5", "CAST(NULL AS DOUBLE)", "1.5", "0.85"), "source": "'https://h' || CAST(c_custkey % 8 AS STRING) || '.example.org/menu'",
    "evidence": pick("(c_custkey div 3)", "'We offer RED Widget 30 min, and small  ring'", "'Blue bolt (New patient); widget!'", "'nothing of it'", "'gadget deluxe ' || CAST(c_custkey % 50 AS STRING)"),
    "price": pick("(c_custkey div 5)", "CAST(c_custkey % 90 AS DOUBLE)", "45.0", "CAST(NULL AS DOUBLE)"), "currency": pick("(c_custkey div 2)", "'USD'", "'USD'", "'EUR'"),
}


_MENU_PAGES = {"url": "'https://h' || CAST(c_custkey % 6 AS STRING) || '.example.org/menu'", "t": "'We offer Red  widget 30 min, and small ring. Blue bolt (new patient); widget! gadget deluxe ' || CAST(c_custkey % 50 AS STRING)"}


def _menu_pages(spark: SparkSession, d: str) -> DataFrame:
    """One page for each of six hosts, with all that its customers are told; offerings name two hosts more, which were not crawled."""
    rows = made(read(spark, d, "customer"), _MENU_PAGES).distinct()
    return rows.groupBy("url").agg(F.array_join(F.sort_array(F.collect_list("t")), " ").alias("content"))  # fifty texts at most


@query("x3_offering_decisions", f"""WITH raw AS ({made_sql(_EXTRACTED, 'customer')}), pages AS (SELECT url, string_agg(t, ' ' ORDER BY t) AS content FROM (SELECT DISTINCT * FROM ({made_sql(_MENU_PAGES, 'customer')})) GROUP BY 1),
mapped AS (SELECT {_menu_sql('p_name')} AS term, min(p_partkey) AS treatment_id FROM part GROUP BY 1), t AS (SELECT raw.*, CASE WHEN trim(name) <> '' THEN {_menu_sql('name')} END AS term, content, {_WORDS.format(c='evidence')} AS e, {_WORDS.format(c='content')} AS p, {_WORDS.format(c='name')} AS n FROM raw LEFT JOIN pages ON url = source),
j AS (SELECT t.*, treatment_id, CASE WHEN coalesce(term, '') = '' THEN 'missing_or_invalid_name' WHEN NOT coalesce(confidence >= 0.85 AND confidence <= 1, false) THEN 'below_confidence_threshold' WHEN term IN ({", ".join(f"'{x}'" for x in NAVIGATION)}) THEN 'generic_or_navigation_label'
  WHEN content IS NULL THEN 'source_page_not_crawled' WHEN e = '' OR NOT contains(p, e) THEN 'evidence_not_found_on_page' WHEN NOT contains(e, n) THEN 'service_name_not_in_evidence' WHEN NOT contains(term, ' ') AND treatment_id IS NULL THEN 'unmapped_single_word_not_specific' END AS reason FROM t LEFT JOIN mapped USING (term)),
c AS (SELECT term, count(DISTINCT (coalesce(price, -1), currency)) AS prices FROM j WHERE reason IS NULL GROUP BY 1)
SELECT id, j.term, treatment_id, coalesce(reason, CASE WHEN prices > 1 THEN 'price_conflict' ELSE 'accepted' END) AS decision, CASE WHEN reason IS NULL AND prices = 1 THEN price END AS price FROM j LEFT JOIN c ON c.term = j.term""")
def x3(spark: SparkSession, d: str) -> DataFrame:
    mapped = read(spark, d, "part").groupBy(menu_term(F.col("p_name")).alias("term")).agg(F.min("p_partkey").alias("treatment_id"))
    return judged_offerings(made(read(spark, d, "customer"), _EXTRACTED), _menu_pages(spark, d), mapped)


# ---- hours, ratings, amounts, requests ----


def _week(days: int, more: str = "") -> str:
    return "[" + ",".join(f'{{"day":"{day}","open":"09:00","close":"17:00"{more}}}' for day in evidence.DAYS[:days]) + "]"


_HOURS = {"id": _S, "hours": pick(_S, *[f"'{x}'" for x in (
    _week(7), _week(6), _week(7, ',"closed":true'), _week(6)[:-1] + ',{"day":"sunday","closed":true}]', _week(7, ',"note":"x"'), _week(6)[:-1] + ',{"day":"sunday","by_appointment":true}]',
    _week(6)[:-1] + ',{"day":"monday","closed":true}]', _week(7).replace("17:00", "25:00"), "{}", _week(6)[:-1] + ',{"day":"sunday","closed":false}]')])}


@query("p25_opening_hours", f"""WITH h AS ({made_sql(_HOURS, 'supplier')}), e AS (SELECT id, unnest(from_json(hours, '["JSON"]')) AS e FROM h WHERE json_type(hours) = 'ARRAY'),
k AS (SELECT id, e->>'day' AS day, len(list_filter(json_keys(e), lambda x: x NOT IN ('day', 'open', 'close', 'closed', 'by_appointment'))) = 0 AND e->>'day' IN ({", ".join(f"'{x}'" for x in evidence.DAYS)})
  AND CAST(coalesce(e->>'closed' = 'true', false) AS INT) + CAST(coalesce(e->>'by_appointment' = 'true', false) AS INT) + CAST(coalesce(regexp_matches(e->>'open', '^([01][0-9]|2[0-3]):[0-5][0-9]$') AND regexp_matches(e->>'close', '^([01][0-9]|2[0-3]):[0-5][0-9]$'), false) AS INT) = 1 AS fine FROM e)
SELECT h.id, coalesce((SELECT count(*) >= 7 AND bool_and(coalesce(fine, false)) AND count(DISTINCT day) = 7 FROM k WHERE k.id = h.id), false) AS valid FROM h""")
def p25(spark: SparkSession, d: str) -> DataFrame:
    """Hours written for every supplier: whole, short, doubled, with two kinds in one entry, unknown keys or impossible times."""
    return made(read(spark, d, "supplier"), _HOURS).select("id", evidence.valid_hours(F.col("hours")).alias("valid"))


_RATINGS = {"id": _K, "raw": pick(_K, "'n/a'", "CAST(c_custkey % 50 AS STRING)", "' 4.' || CAST(c_custkey % 10 AS STRING) || ' '", "'{\"ratingValue\": \"3.' || CAST(c_custkey % 10 AS STRING) || '\"}'", "'{\"ratingValue\": ' || CAST(c_custkey % 5 AS STRING) || '}'", "'{\"rating\": 4}'", "'{broken'", "'-1'", "''", None, "'4,5'")}


@query("t1_ratings", f"""SELECT id, CAST(CASE WHEN regexp_matches(trim(raw), '^[0-9]+([.][0-9]+)?$') THEN trim(raw) WHEN trim(raw) LIKE '{{%' AND json_valid(trim(raw)) AND regexp_matches(json_extract_string(CASE WHEN json_valid(trim(raw)) THEN trim(raw) ELSE '{{}}' END, '$.ratingValue'), '^[0-9]+([.][0-9]+)?$')
  THEN json_extract_string(CASE WHEN json_valid(trim(raw)) THEN trim(raw) ELSE '{{}}' END, '$.ratingValue') END AS DOUBLE) AS rating FROM ({made_sql(_RATINGS, 'customer')})""")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return made(read(spark, d, "customer"), _RATINGS).select("id", dates.rating(F.col("raw")).cast("double").alias("rating"))


_METRICS = {"id": _P, "raw": pick(_P, "CAST(p_size AS STRING) || 'k'", "'$' || CAST(p_size AS STRING) || ',000'", "CAST(p_size AS STRING) || '.5M'", "'—'", "' 1 2' || CAST(p_size AS STRING)", "'-'", "'€1.2K'", None, "''", "'n/a'", "'-3.5'")}


@query("r5_metrics", f"""WITH t AS (SELECT id, lower(regexp_replace(raw, '[$€£,\\s]', '', 'g')) AS t FROM ({made_sql(_METRICS, 'part')}))
SELECT id, CASE WHEN regexp_matches(t, '^-?[0-9]+([.][0-9]+)?[km]?$') THEN CAST(regexp_extract(t, '^-?[0-9]+([.][0-9]+)?') AS DOUBLE) * CASE right(t, 1) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END END AS metric FROM t""")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return made(read(spark, d, "part"), _METRICS).select("id", text.metric(F.col("raw")).alias("metric"))


#: Treatments that one request may name.
MOST_TREATMENTS = 25


def whole_numbers(c: Column) -> Column:
    """The distinct whole numbers that the parts of a comma-separated list begin with, in order, so many at most."""
    begun = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.regexp_extract(F.trim(x), "^[+-]?[0-9]{1,15}", 0).try_cast("bigint"))
    return F.slice(F.array_distinct(F.array_compact(begun)), 1, MOST_TREATMENTS)


def number_begun(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?", 0).try_cast("double")


_REQUESTS = {
    "id": _K, "treatments": pick(_K, "CAST(c_custkey AS STRING) || ', 7abc ,x,7,-3'", "'" + ",".join(map(str, range(1, 31))) + "'", "''", None, "' 12 ,012, 1.5'"),
    "country": pick(_K, "' de '", "'germany'", "'U1'", "'FR'", None, "''"), "lat": pick(_K, "'48.5deg'", "'-91'", "'x'", "'.5'", "'1e2'", "'90'", None),
}


@query("p27_requests", f"""WITH q AS ({made_sql(_REQUESTS, 'customer')}), n AS (SELECT id, TRY_CAST(regexp_extract(trim(t), '^[+-]?[0-9]+') AS BIGINT) AS n, turn FROM (SELECT id, unnest(string_split(treatments, ',')) AS t, generate_subscripts(string_split(treatments, ','), 1) AS turn FROM q)),
f AS (SELECT id, n, min(turn) AS turn FROM n WHERE n IS NOT NULL GROUP BY 1, 2), g AS (SELECT id, string_agg(n, ',' ORDER BY turn) AS treatments FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS place FROM f) WHERE place <= 25 GROUP BY 1),
l AS (SELECT id, TRY_CAST(regexp_extract(trim(lat), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AS DOUBLE) AS latitude FROM q)
SELECT q.id, coalesce(g.treatments, '') AS treatments, CASE WHEN regexp_matches(upper(trim(country)), '^[A-Z]{{2}}$') THEN upper(trim(country)) END AS country, CASE WHEN latitude BETWEEN -90 AND 90 THEN latitude END AS latitude FROM q LEFT JOIN g USING (id) JOIN l USING (id)""")
def p27(spark: SparkSession, d: str) -> DataFrame:
    """Request parameters, checked: distinct whole treatment ids, two-letter countries, bounded coordinates."""
    q = made(read(spark, d, "customer"), _REQUESTS)
    country, lat = F.upper(F.trim("country")), number_begun(F.col("lat"))
    ids = F.array_join(F.transform(whole_numbers(F.col("treatments")), lambda n: n.cast("string")), ",")
    return q.select("id", ids.alias("treatments"), F.when(country.rlike("^[A-Z]{2}$"), country).alias("country"), F.when(lat.between(-90, 90), lat).alias("latitude"))


# ---- identity ----


def street_evidence(page: Column, address: Column) -> Column:
    """Whether the words of a plain page hold a street's number and half of its telling words; without a number, two of them and half."""
    street = geocoding.plain(F.substring_index(F.coalesce(address, F.lit("")), ",", 1))

    def of(s: Column) -> Column:
        words = F.split(s, " ")
        numbers = F.filter(words, lambda w: w.rlike("^[0-9]+[a-z]?$"))
        telling = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*geocoding.PLAIN_STREET_WORDS) & ~w.rlike("^[0-9]+[a-z]?$"))
        there = lambda x: F.size(F.filter(x, lambda w: F.array_contains(page, w)))
        return let(F.struct(F.size(numbers).alias("n"), there(numbers).alias("n_there"), F.size(telling).alias("t"), there(telling).alias("t_there")), judged)

    def judged(x: Column) -> Column:
        half = F.greatest(F.lit(1), F.ceil(x["t"] / 2).cast("int"))
        return ((x["n"] > 0) & (x["n_there"] > 0) & (x["t"] > 0) & (x["t_there"] >= half)) | ((x["n"] == 0) & (x["t"] >= 2) & (x["t_there"] >= F.greatest(F.lit(2), half)))

    return let(street, of)


_SEEN = "list_distinct(string_split(trim(regexp_replace(replace(" + _FOLD.format(c="replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&')") + ", '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '))"
_STREETS = pick("page_id", "CAST(page_id % 89 + 1 AS STRING) || ' ' || place || ' Street, x'", "place || ' Harbour Road'", "CAST(page_id % 89 + 1 AS STRING) || 'b Long Harbour Road'", "CAST(page_id % 89 + 1 AS STRING)", "'Long Acre'", "''")


@query("x6_address_evidence", f"""WITH {crawl.CRAWLED}, p AS (SELECT page_id, {_SEEN} AS seen, string_split(trim(regexp_replace({_FOLD.format(c="split_part(a, ',', 1)")}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM (SELECT *, {duck(_STREETS)} AS a FROM crawled)),
q AS (SELECT page_id, seen, list_filter(w, lambda x: regexp_matches(x, '^[0-9]+[a-z]?$')) AS n, list_filter(w, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+[a-z]?$') AND x NOT IN ({", ".join(f"'{x}'" for x in geocoding.PLAIN_STREET_WORDS)})) AS t FROM p),
r AS (SELECT page_id, len(n) AS n, len(list_filter(n, lambda x: list_contains(seen, x))) AS nn, len(t) AS t, len(list_filter(t, lambda x: list_contains(seen, x))) AS tt FROM q)
SELECT page_id, (n > 0 AND nn > 0 AND t > 0 AND tt >= greatest(1, ceil(t / 2.0))) OR (n = 0 AND t >= 2 AND tt >= greatest(2, ceil(t / 2.0))) AS found FROM r""")
def x6(spark: SparkSession, d: str) -> DataFrame:
    pages = crawl.crawled(spark, d).withColumn("address", F.expr(_STREETS))
    seen = F.array_distinct(F.split(geocoding.plain(markup.visible_text(F.col("html"))), " "))
    return pages.select("page_id", "address", seen.alias("seen")).select("page_id", street_evidence(F.col("seen"), F.col("address")).alias("found"))


# How streets are written short, and what of an address is a unit.
SHORT = {"north": "n", "south": "s", "east": "e", "west": "w", "street": "st", "avenue": "ave", "road": "rd", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "highway": "hwy"}
UNIT = "\\b(suite|ste|unit|floor|fl|level|building|bldg|room|office)\\b.*$"


def written_address(c: Column) -> Column:
    """struct(number, street, postal, localities) of an address in one line: all in one spelling."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.trim), lambda x: x != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    bare = geocoding.plain(F.regexp_replace(F.regexp_replace(F.lower(first), UNIT, ""), "#\\s*\\w+.*$", ""))
    street = F.regexp_replace(bare, "^[0-9]+\\s+", "")
    for long_, short in SHORT.items():
        street = F.regexp_replace(street, f"\\b{long_}\\b", short)
    five = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("\\b([0-9]{5})(?:-[0-9]{4})?\\b"), F.lit(1))
    return F.struct(
        F.lower(F.regexp_extract(first, "(?:^|\\s)([0-9]+[A-Za-z]?)(?=\\s|$)", 1)).alias("number"), street.alias("street"), F.element_at(F.concat(F.array(F.lit("")), five), -1).alias("postal"),
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), geocoding.plain).alias("localities"),
    )


def same_address(asked: Column, found: Column, city: Column, zip_: Column) -> Column:
    """struct(verified, number, street, postal, locality): house number and postal code agree, or, without a code, street and locality."""

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        number = (a["number"] != "") & (a["number"] == b["number"])
        street = (a["street"] != "") & (a["street"] == b["street"])
        postal = F.coalesce((a["postal"] != "") & (a["postal"] == F.substring(F.trim(zip_), 1, 5)), F.lit(False))
        place = F.coalesce((geocoding.plain(city) != "") & F.array_contains(a["localities"], geocoding.plain(city)), F.lit(False))
        verified = number & F.when(a["postal"] != "", postal).otherwise(street & place)
        return F.struct(verified.alias("verified"), number.alias("number"), street.alias("street"), postal.alias("postal"), place.alias("locality"))

    return let(F.struct(written_address(asked).alias("a"), written_address(found).alias("b")), of)


_CENSUS = {
    "id": _K, "asked": pick(_K, "CAST(c_custkey % 50 + 1 AS STRING) || ' North Main Street, Springfield, IL 62704'", "CAST(c_custkey % 50 + 1 AS STRING) || 'a Oak Avenue Suite 4, Lyon'", "'Main Street, Lyon 69001'", "CAST(c_custkey % 50 + 1 AS STRING) || ' Elm Rd #12, San José, CA'", None),
    "found": pick("(c_custkey div 5)", "CAST(c_custkey % 50 + 1 AS STRING) || ' N MAIN ST, SPRINGFIELD, IL, 62704'", "CAST(c_custkey % 50 + 1 AS STRING) || 'A OAK AVE, LYON'", "CAST(c_custkey % 50 + 2 AS STRING) || ' N MAIN ST, SPRINGFIELD'", "CAST(c_custkey % 50 + 1 AS STRING) || ' ELM RD, SAN JOSE, CA, 95112'"),
    "city": pick("(c_custkey div 5)", "'Springfield'", "'LYON'", "'Springfield'", "'San Jose'"), "zip": pick("(c_custkey div 3)", "'62704-1234'", None, "'62704'", "'1'"),
}


def _address_sql(c: str, k: str) -> str:
    first = f"coalesce(list_filter([trim(x) FOR x IN string_split(coalesce({c}, ''), ',')], lambda x: x <> '')[1], '')"
    street = f"regexp_replace(trim(regexp_replace(strip_accents(regexp_replace(regexp_replace(lower({first}), '{UNIT}', ''), '#\\s*\\w+.*$', '')), '[^a-z0-9]+', ' ', 'g')), '^[0-9]+\\s+', '')"
    for long_, short in SHORT.items():
        street = f"regexp_replace({street}, '\\b{long_}\\b', '{short}', 'g')"
    return f"lower(regexp_extract({first}, '(?:^|\\s)([0-9]+[A-Za-z]?)(?:\\s|$)', 1)) AS number_{k}, {street} AS street_{k}, coalesce(regexp_extract_all({c}, '\\b([0-9]{{5}})(?:-[0-9]{{4}})?\\b', 1)[-1], '') AS postal_{k}"


@query("x8_address_identity", f"""WITH raw AS ({made_sql(_CENSUS, 'customer')}), p AS (SELECT *, {_address_sql('asked', 'a')}, {_address_sql('found', 'b')}, [trim(regexp_replace(strip_accents(lower(x)), '[^a-z0-9]+', ' ', 'g')) FOR x IN string_split(asked, ',')][2:] AS places FROM raw),
m AS (SELECT id, postal_a, number_a <> '' AND number_a = number_b AS number, street_a <> '' AND street_a = street_b AS street, coalesce(postal_a <> '' AND postal_a = substr(zip, 1, 5), false) AS postal, coalesce(list_contains(places, trim(regexp_replace(strip_accents(lower(city)), '[^a-z0-9]+', ' ', 'g'))), false) AS locality FROM p)
SELECT id, number AND CASE WHEN postal_a <> '' THEN postal ELSE street AND locality END AS verified, number, street, postal, locality FROM m""")
def x8(spark: SparkSession, d: str) -> DataFrame:
    raw = made(read(spark, d, "customer"), _CENSUS)
    return raw.select("id", same_address(F.col("asked"), F.col("found"), F.col("city"), F.col("zip")).alias("x")).select("id", "x.*")


# Words that say nothing in a name, and hosts that belong to no place.
PLAIN_NAME_WORDS = tuple("and care center centre clinic clinics health hospital medical of spa the therapy wellness".split())
SHARED_HOSTS = ("facebook.com", "instagram.com", "yelp.com", "google.com", "linkedin.com")


def telling_words(plain: Column) -> Column:
    return F.filter(F.array_distinct(F.split(plain, " ")), lambda w: (F.length(w) >= 3) & ~w.isin(*PLAIN_NAME_WORDS))


def site_identity(name: Column, locality: Column, postal: Column, website: Column, said: Column) -> Column:
    """Whether a web site is a place's own: its domain and what is said of it hold a telling word of the name, and that the place."""
    host = text.host(website)
    texts = F.struct(geocoding.plain(name).alias("name"), geocoding.plain(locality).alias("locality"), geocoding.plain(postal).alias("postal"), host.alias("host"), geocoding.plain(said).alias("said"))

    def of(t: Column) -> Column:
        words, bare = telling_words(t["name"]), F.regexp_replace(t["host"], "[^a-z0-9]", "")
        in_domain = F.exists(words, lambda w: bare.contains(w))
        in_text = F.exists(words, lambda w: F.array_contains(F.split(t["said"], " "), w))
        placed = geocoding.says(t["said"], t["locality"]) | geocoding.says(t["said"], t["postal"])
        shared = t["host"].isNull() | F.exists(F.array(*map(F.lit, SHARED_HOSTS)), lambda h: (t["host"] == h) | t["host"].endswith(F.concat(F.lit("."), h)))
        return F.when(F.trim(F.coalesce(website, F.lit(""))) == "", "missing_or_invalid_website").when(shared, "generic_or_directory_domain").when(~in_domain, "domain_name_mismatch").when(~in_text, "name_evidence_mismatch").when(~placed, "locality_or_address_evidence_mismatch").otherwise("official_evidence_match")

    return let(texts, of)


def place_identity(name: Column, address: Column, locality: Column, postal: Column, shown: Column, formatted: Column) -> Column:
    """Whether a provider's place is the location: a telling word of its name, and its postal code, locality or two words of its address."""
    texts = F.struct(*[geocoding.plain(c).alias(k) for k, c in (("name", name), ("address", address), ("locality", locality), ("postal", postal), ("shown", shown), ("formatted", formatted))])

    def of(t: Column) -> Column:
        named = (t["name"] != "") & (t["shown"] != "") & ((t["name"] == t["shown"]) | F.arrays_overlap(telling_words(t["name"]), F.split(t["shown"], " ")))
        words = F.filter(F.split(t["address"], " "), lambda w: F.length(w) >= 2)
        shared = F.size(F.filter(words, lambda w: F.array_contains(F.split(t["formatted"], " "), w)))
        unknown = F.concat(t["address"], t["locality"], t["postal"]) == ""
        placed = geocoding.says(t["formatted"], t["postal"]) | geocoding.says(t["formatted"], t["locality"]) | (shared >= F.least(F.lit(2), F.size(words)))
        return named & (unknown | ((t["formatted"] != "") & placed))

    return let(texts, of)


_SITES = {
    "id": _K, "name": pick(_K, "'Harbour Health Clinic'", "'The Spa'", "'Königs Therapy Center'", "'Oak & Elm'"), "locality": pick("(c_custkey div 4)", "'Lyon'", "'San José'", "''"), "postal": pick("(c_custkey div 3)", "'69001'", None), "address": pick("(c_custkey div 5)", "'12 Rue Haute'", "''", None),
    "website": pick("(c_custkey div 2)", "'https://www.Harbour-Lyon.example.org/x'", "'konigs.example.org'", "'https://m.facebook.com/harbour'", "''", "'https://oakelm.example.net'", None),
    "said": pick("(c_custkey div 7)", "'Harbour house in Lyon'", "'KÖNIGS, San Jose 69001'", "'oak elm of nowhere'", "'12 haute rue, harbour'", "''"),
}
_PLAIN = lambda c: f"trim(regexp_replace(replace({_FOLD.format(c=c)}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query("x10_x11_site_identity", f"""WITH raw AS ({made_sql(_SITES, 'customer')}), t AS (SELECT id, website, {_PLAIN('name')} AS n, {_PLAIN('locality')} AS l, {_PLAIN('postal')} AS p, {_PLAIN('address')} AS a, {_PLAIN('said')} AS s,
  nullif(regexp_replace(regexp_extract(CASE WHEN regexp_matches(lower(trim(website)), '^[a-z]+://') THEN lower(trim(website)) ELSE 'https://' || lower(trim(website)) END, '^[a-z]+://([^/?#:@]+)', 1), '^www[0-9]*[.]', ''), '') AS h FROM raw),
w AS (SELECT *, list_filter(list_distinct(string_split(n, ' ')), lambda x: length(x) >= 3 AND x NOT IN ({", ".join(f"'{x}'" for x in PLAIN_NAME_WORDS)})) AS words, string_split(s, ' ') AS said, list_filter(string_split(a, ' '), lambda x: length(x) >= 2) AS aw FROM t),
j AS (SELECT *, (l <> '' AND contains(' ' || s || ' ', ' ' || l || ' ')) AS in_l, (p <> '' AND contains(' ' || s || ' ', ' ' || p || ' ')) AS in_p, len(list_intersect(words, said)) > 0 AS named FROM w)
SELECT id, CASE WHEN trim(coalesce(website, '')) = '' THEN 'missing_or_invalid_website' WHEN h IS NULL OR {" OR ".join(f"h = '{x}' OR h LIKE '%.{x}'" for x in SHARED_HOSTS)} THEN 'generic_or_directory_domain' WHEN len(list_filter(words, lambda x: contains(regexp_replace(h, '[^a-z0-9]', '', 'g'), x))) = 0 THEN 'domain_name_mismatch'
  WHEN NOT named THEN 'name_evidence_mismatch' WHEN NOT (in_l OR in_p) THEN 'locality_or_address_evidence_mismatch' ELSE 'official_evidence_match' END AS site,
  n <> '' AND s <> '' AND (n = s OR named) AND (a || l || p = '' OR in_p OR in_l OR len(list_filter(aw, lambda x: list_contains(said, x))) >= least(2, len(aw))) AS place FROM j""")
def x10(spark: SparkSession, d: str) -> DataFrame:
    c = {k: F.col(k) for k in _SITES}
    site = site_identity(c["name"], c["locality"], c["postal"], c["website"], c["said"])
    place = place_identity(c["name"], c["address"], c["locality"], c["postal"], c["said"], c["said"])
    return made(read(spark, d, "customer"), _SITES).select("id", site.alias("site"), place.alias("place"))


# ---- evidence of treatments, kinds of images ----


@query("x7_term_evidence", f"""WITH {crawl.CRAWLED}, s AS (SELECT page_id, ' ' || trim(regexp_replace({_FOLD.format(c="regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g')")}, '[^a-z0-9]+', ' ', 'g')) || ' ' AS seen FROM crawled),
names AS (SELECT min(p_partkey) AS treatment_id, lower(p_name) AS name FROM part GROUP BY 2) SELECT page_id, treatment_id FROM s JOIN names ON contains(seen, ' ' || name || ' ')""")
def x7(spark: SparkSession, d: str) -> DataFrame:
    """The treatments that a page names. Phrases of a page as long as the names are meet them in an equi-join."""
    names = read(spark, d, "part").groupBy(geocoding.plain(F.col("p_name")).alias("phrase")).agg(F.min("p_partkey").alias("treatment_id"))
    lengths = [r.n for r in names.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect()]  # few
    words = crawl.crawled(spark, d).select("page_id", F.split(geocoding.plain(markup.visible_text(F.col("html"))), " ").alias("w"))
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    phrases = F.flatten(F.array(*map(of_length, lengths)))
    return words.select("page_id", F.explode(F.array_distinct(phrases)).alias("phrase")).join(names, "phrase").select("page_id", "treatment_id")


# What tells an image's kind, in turn, with the certainty.
IMAGE_KINDS = (
    ("junk", 0.99, "favicon|sprite|tracking|pixel|placeholder|blank|transparent|loader|spinner|spacer|beacon|doubleclick|googleadservices|pagead|analytics|maps\\.gstatic|maps\\.google|googleapis\\.com/maps|/vt/lyrs=|\\b1x1\\b"),
    ("logo", 0.96, "\\b(logo|logomark|wordmark|brandmark|brand mark|identity mark)\\b"),
    ("text_graphic", 0.94, "\\b(infographic|flyer|poster|brochure|menu|price list|promotion|promotional|coupon|certificate|award graphic|quote card|testimonial card|text graphic)\\b"),
    ("photo", 0.9, "\\b(clinic interior|clinic exterior|treatment room|therapy room|waiting room|reception area|facility exterior|facility interior|staff photo|team photo|doctor portrait|practitioner portrait|patient treatment|therapy session|medical equipment|sauna room|pool area)\\b"),
)


def image_kind(c: Column) -> Column:
    """struct(kind, certainty) by the first rule that an image's addresses and text meet; null if none."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(sure).cast("double").alias("certainty"))) for kind, sure, pattern in IMAGE_KINDS])


_IMAGES = {"id": _K, "url": "'https://cdn.example.org/' || " + pick(_K, "'pixel.gif'", "'brand-logo.png'", "'a.jpg'", "'1x1.png'", "'blogosphere.jpg'", "'summer-flyer.jpg'", "'b.webp'"), "alt": pick("(c_custkey div 2)", "'Our Waiting Room'", "'Price List 2024'", None, "'a brand mark'", "'harbour'")}


@query("x18_image_kinds", f"SELECT id, {'CASE ' + ' '.join(f'WHEN regexp_matches(t, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, _, p in IMAGE_KINDS) + ' END'} AS kind, {'CASE ' + ' '.join(f'WHEN regexp_matches(t, {chr(39)}{p}{chr(39)}) THEN CAST({s} AS DOUBLE)' for _, s, p in IMAGE_KINDS) + ' END'} AS certainty FROM (SELECT id, lower(concat_ws(' ', url, alt)) AS t FROM ({made_sql(_IMAGES, 'customer')}))")
def x18(spark: SparkSession, d: str) -> DataFrame:
    images = made(read(spark, d, "customer"), _IMAGES)
    return images.select("id", image_kind(F.concat_ws(" ", "url", "alt")).alias("x")).select("id", "x.kind", "x.certainty")


# ---- providers, proposals, clicks, states ----

# Providers of place matches, the first preferred.
PROVIDERS = ("google_places", "google", "google_maps")
_MATCHES = {"id": "event_id", "location_id": "user_id", "provider": pick("event_id", "'Google'", "' google_places '", "'yelp'", "'GOOGLE_MAPS'", None), "place_id": pick("(event_id div 2)", "'p' || CAST(user_id AS STRING)", "' q' || CAST(event_id % 3 AS STRING)", "''")}
_REVIEWS = {"id": "event_id", "location_id": "user_id", "name": pick("event_id", "'r' || CAST(event_id % 40 AS STRING)", None, "' '"), "author": pick("(event_id div 2)", "'Ann'", "'ANN '", "''", "'Bob'"), "body": pick("(event_id div 3)", "'good'", "'Good'", None, "'bad'"), "rating": pick("(event_id div 5)", "5", None, "4"), "day": pick("(event_id div 7)", "'2024-01-01'", None)}


def distinct_matches(matches: DataFrame) -> DataFrame:
    """Of every location's matches the first for each provider's place: by provider, then as they came. Others than known providers go."""
    names = F.array(*map(F.lit, PROVIDERS))
    m = matches.withColumn("provider", F.lower(F.trim("provider"))).withColumn("place_id", F.trim("place_id")).withColumn("priority", F.array_position(names, F.col("provider"))).where("priority > 0 AND place_id <> ''")
    return m.groupBy("location_id", "place_id").agg(F.min(F.struct("priority", "id", "provider")).alias("x")).select("location_id", "place_id", "x.provider", "x.id")


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """Of every location's reviews the first for each provider's id, or, without one, for each content; empty ones go."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    content = F.concat_ws("\x00", F.lower(said(F.col("author"))), F.lower(said(F.col("body"))), F.coalesce(F.col("rating").cast("string"), F.lit("")), F.coalesce("day", F.lit("")))
    key = F.when(said(F.col("name")) != "", F.concat(F.lit("id:"), said(F.col("name")))).otherwise(F.concat(F.lit("content:"), content))
    kept = reviews.where((said(F.col("author")) != "") | (said(F.col("body")) != "") | F.col("rating").isNotNull())
    return kept.groupBy("location_id", key.alias("key")).agg(F.min("id").alias("id")).select("location_id", "id")


@query("d20_provider_matches", f"""WITH m AS (SELECT id, location_id, lower(trim(provider)) AS provider, trim(place_id) AS place_id FROM ({made_sql(_MATCHES, 'events')})), p AS (SELECT *, list_position(['google_places', 'google', 'google_maps'], provider) AS priority FROM m WHERE place_id <> '')
SELECT location_id, place_id, provider, id FROM p WHERE priority > 0 QUALIFY row_number() OVER (PARTITION BY location_id, place_id ORDER BY priority, id) = 1""")
def d20(spark: SparkSession, d: str) -> DataFrame:
    return distinct_matches(made(read(spark, d, "events"), _MATCHES))


@query("d20_d21_provider_dedupe", f"""WITH r AS (SELECT *, trim(coalesce(name, '')) AS n, trim(coalesce(author, '')) AS a, trim(coalesce(body, '')) AS b FROM ({made_sql(_REVIEWS, 'events')}))
SELECT location_id, id FROM r WHERE a <> '' OR b <> '' OR rating IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location_id, CASE WHEN n <> '' THEN n END, CASE WHEN n = '' THEN lower(a) END, CASE WHEN n = '' THEN lower(b) END, CASE WHEN n = '' THEN rating END, CASE WHEN n = '' THEN day END ORDER BY id) = 1""")
def d21(spark: SparkSession, d: str) -> DataFrame:
    return distinct_reviews(made(read(spark, d, "events"), _REVIEWS))


_PROPOSALS = {
    "candidate": "c_custkey div 6", "street": pick(_K, "'12 Main St'", "'12 MAIN ST.'", "'7 Oak Ave'", "'12 Main St'", "''", "CAST(c_custkey % 40 AS STRING) || ' Elm Rd'"), "locality": pick("(c_custkey div 2)", "'Lyon'", "'LYON'", "'Paris'", None, "'Lyon 1er'"), "postal": pick("(c_custkey div 3)", "'69001'", "'69 002'", None, "'69001'"),
}
_WANTED = {"candidate": "s_suppkey", "street": pick(_S, "'12 main st'", "'7 oak ave'", "'99 None'"), "locality": pick(_S, "'lyon'", "'lyon'", "'Paris'", "''"), "postal": pick(_S, "'69001'", "'69002'", None)}


def decided_proposals(wanted: DataFrame, proposals: DataFrame) -> DataFrame:
    """For every candidate (candidate, street, locality, postal) the proposal to take: the only one in its locality, else the only
    one with its street, else the only one with its postal code; else why there is none.

    Equal proposals count once, and a candidate's proposals are counted, never gathered.
    """
    key = lambda c: geocoding.plain(F.col(c))
    p = proposals.where(key("street") != "").select("candidate", key("street").alias("p_street"), key("locality").alias("p_locality"), F.replace(key("postal"), F.lit(" "), F.lit("")).alias("p_postal")).distinct()
    w = wanted.select("candidate", key("street").alias("w_street"), key("locality").alias("w_locality"), F.replace(key("postal"), F.lit(" "), F.lit("")).alias("w_postal"))
    near = (F.col("w_locality") == "") | (F.col("p_locality") == "") | F.col("p_locality").contains(F.col("w_locality")) | F.col("w_locality").contains(F.col("p_locality"))
    x = w.join(p, "candidate", "left").withColumn("near", F.col("p_street").isNotNull() & near)
    shown = F.concat_ws("|", "p_street", "p_locality", "p_postal")
    street, postal = F.col("near") & (F.col("p_street") == F.col("w_street")), F.col("near") & (F.col("p_postal") == F.col("w_postal")) & (F.col("w_postal") != "")
    n = x.groupBy("candidate").agg(F.count("p_street").alias("every"), *[f(c) for k, c in (("near", F.col("near")), ("street", street), ("postal", postal)) for f in (lambda c, k=k: F.count_if(c).alias(k), lambda c, k=k: F.min(F.when(c, shown)).alias(f"of_{k}"))])
    one = F.when(F.col("near") == 1, F.col("of_near")).when(F.col("street") == 1, F.col("of_street")).when(F.col("postal") == 1, F.col("of_postal"))
    decision = F.when(F.col("every") == 0, "no_structured_address").when(F.col("near") == 0, "no_locality_match").when(one.isNotNull(), "accepted").otherwise("ambiguous")
    return n.select("candidate", decision.alias("decision"), F.when(F.col("near") > 0, one).alias("proposal"), F.col("every").alias("proposals"))


@query("d24_address_cascade", f"""WITH p AS (SELECT DISTINCT candidate, {_PLAIN('street')} AS ps, {_PLAIN('locality')} AS pl, replace({_PLAIN('postal')}, ' ', '') AS pp FROM ({made_sql(_PROPOSALS, 'customer')}) WHERE {_PLAIN('street')} <> ''),
w AS (SELECT candidate, {_PLAIN('street')} AS ws, {_PLAIN('locality')} AS wl, replace({_PLAIN('postal')}, ' ', '') AS wp FROM ({made_sql(_WANTED, 'supplier')})),
x AS (SELECT *, ps IS NOT NULL AND (wl = '' OR pl = '' OR contains(pl, wl) OR contains(wl, pl)) AS near, concat_ws('|', ps, pl, pp) AS shown FROM w LEFT JOIN p USING (candidate)),
n AS (SELECT candidate, count(ps) AS every, count(*) FILTER (WHERE near) AS near, min(shown) FILTER (WHERE near) AS a, count(*) FILTER (WHERE near AND ps = ws) AS street, min(shown) FILTER (WHERE near AND ps = ws) AS b, count(*) FILTER (WHERE near AND pp = wp AND wp <> '') AS postal, min(shown) FILTER (WHERE near AND pp = wp AND wp <> '') AS c FROM x GROUP BY 1)
SELECT candidate, CASE WHEN every = 0 THEN 'no_structured_address' WHEN near = 0 THEN 'no_locality_match' WHEN near = 1 OR street = 1 OR postal = 1 THEN 'accepted' ELSE 'ambiguous' END AS decision, CASE WHEN near = 1 THEN a WHEN near > 0 AND street = 1 THEN b WHEN near > 0 AND postal = 1 THEN c END AS proposal, every AS proposals FROM n""")
def d24(spark: SparkSession, d: str) -> DataFrame:
    return decided_proposals(made(read(spark, d, "supplier"), _WANTED), made(read(spark, d, "customer"), _PROPOSALS))


_CLICKS = {
    "id": "page_id", "request": "'https://dir.example.org/out?to=x' || " + pick("page_id", "'&source_page=/given/' || CAST(page_id AS STRING)", "'&from=card'", "''", "'&source_page=&from=list%20row'"),
    "referrer": pick("(page_id div 4)", "'https://dir.example.org/a/b?c=d#e'", "'https://other.example.org/x'", None, "url"), "agent": pick("(page_id div 3)", "'Mozilla/5.0 (X11)'", "'Googlebot/2.1'", "'curl/8.0'", "''", None),
}


def click_rows(requests: DataFrame) -> DataFrame:
    """Click records of requests (id, request, referrer, agent): the named source page, else the path of a referrer of the own origin; the
    named place in the page; the agent only as a digest, robots marked."""
    param = lambda name: F.nullif(F.trim(F.try_url_decode(F.regexp_extract("request", f"[?&]{name}=([^&#]*)", 1))), F.lit(""))
    origin = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z]+://[^/?#]+", 0))
    path = F.regexp_extract("referrer", "^[A-Za-z]+://[^/?#]+([^#]*)", 1)
    own = F.when((origin("referrer") != "") & (origin("referrer") == origin("request")), F.when(path == "", "/").otherwise(path))
    return requests.select("id", F.coalesce(param("source_page"), own).alias("source_page"), param("from").alias("internal_from"), F.sha2(F.coalesce("agent", F.lit("")), 256).alias("agent_hash"), text.is_bot(F.col("agent")).alias("is_bot"))


@query("q16_click_log", f"""SELECT id, coalesce(nullif(trim(url_decode(regexp_extract(request, '[?&]source_page=([^&#]*)', 1))), ''), CASE WHEN lower(regexp_extract(referrer, '^[A-Za-z]+://[^/?#]+')) = 'https://dir.example.org' THEN CASE WHEN regexp_extract(referrer, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(referrer, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) END END) AS source_page,
  nullif(trim(url_decode(regexp_extract(request, '[?&]from=([^&#]*)', 1))), '') AS internal_from, sha256(coalesce(agent, '')) AS agent_hash, coalesce(agent, '') = '' OR regexp_matches(lower(agent), '{text.ROBOTS}') AS is_bot FROM ({made_sql(_CLICKS, 'pages')})""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return click_rows(made(read(spark, d, "pages"), _CLICKS))


# States of a treatment, and whether a page and a menu show them.
STATES = {
    "approved_drug": (True, True), "approved_drug_discontinued": (True, True), "cleared_or_approved_device": (True, True), "product_specific": (True, False), "device_specific": (True, False),
    "no_matching_approved_drug": (True, True), "not_applicable": (False, False), "not_determined": (False, False),
}
_STATES = {"id": _P, "status": pick(_P, *[f"'{s}'" for s in STATES], "'Approved_Drug'", None, "''")}


@query("n29_status_labels", f"SELECT id, CASE WHEN status IN ({', '.join(repr(s) for s, v in STATES.items() if v[0])}) THEN status END AS shown, CASE WHEN status IN ({', '.join(repr(s) for s, v in STATES.items() if v[1])}) THEN status END AS in_menu, coalesce(status IN ({', '.join(map(repr, STATES))}), false) AS known FROM ({made_sql(_STATES, 'part')})")
def n29(spark: SparkSession, d: str) -> DataFrame:
    flags = F.create_map(*[x for s, (page, menu) in STATES.items() for x in (F.lit(s), F.struct(F.lit(page).alias("page"), F.lit(menu).alias("menu")))])
    s = made(read(spark, d, "part"), _STATES).withColumn("x", flags[F.col("status")])
    return s.select("id", F.when(F.col("x.page"), F.col("status")).alias("shown"), F.when(F.col("x.menu"), F.col("status")).alias("in_menu"), F.col("x").isNotNull().alias("known"))


# ---- search that resolves its words ----


def resolved_terms(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(q, treatment_id): the only treatment whose name a query is, else the only one of whose synonym, else of whose name it begins.

    ``queries`` (q) and ``names`` (treatment_id, name, synonym) meet in three equi-joins; for the last, a name is cut after each word.
    """
    n = names.select("treatment_id", F.lower(F.trim("name")).alias("name"), F.lower(F.trim("synonym")).alias("synonym"))
    q = queries.select("q", F.lower(F.trim("q")).alias("term")).where("term <> ''")
    words = F.split("name", " ")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    tiers = [n.select("treatment_id", F.col("name").alias("term"), F.lit(1).alias("tier")), n.select("treatment_id", F.col("synonym").alias("term"), F.lit(2).alias("tier")), n.where(F.size(words) > 1).select("treatment_id", F.explode(starts).alias("term"), F.lit(3).alias("tier"))]
    counted = reduce(DataFrame.unionByName, tiers).groupBy("term", "tier").agg(F.count_distinct("treatment_id").alias("n"), F.min("treatment_id").alias("treatment_id"))
    first = q.join(counted, "term").groupBy("q").agg(F.min(F.struct("tier", "n", "treatment_id")).alias("x"))
    return first.where("x.n = 1").select("q", "x.treatment_id")


def searched(queries: DataFrame, names: DataFrame, places: DataFrame, offers: DataFrame) -> DataFrame:
    """(q, treatment_id, location_id, least): for a query that names one treatment the active places that offer it, with its least
    price; for any other the places whose name holds all of its words."""
    known = resolved_terms(queries, names)
    wanted = offers.join(known.select("treatment_id").distinct(), "treatment_id", "left_semi")
    by_term = known.join(wanted.groupBy("treatment_id", "location_id").agg(F.min(F.when(F.col("price_amount") > 0, F.col("price_amount"))).alias("least")), "treatment_id")
    by_term = by_term.join(places.select(F.col("id").alias("location_id")), "location_id", "left_semi").select("q", "treatment_id", "location_id", "least")
    # A place that holds all words of a query holds its rarest word: only there they meet.
    other = queries.join(known.select("q"), "q", "left_anti").select("q", F.array_distinct(text.tokens(F.col("q"))).alias("asked"))
    held = places.select(F.col("id").alias("location_id"), F.array_distinct(text.tokens(F.concat_ws(" ", "name", "locality", "country_code"))).alias("held")).withColumn("word", F.explode("held"))
    words = other.withColumn("word", F.explode("asked"))
    counted = held.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = words.join(counted, "word").groupBy("q", "asked").agg(F.count("*").alias("known"), F.min(F.struct("n", "word")).alias("x")).where(F.col("known") == F.size("asked"))
    by_words = rarest.select("q", "asked", "x.word").join(held, "word").where(F.size(F.array_except("asked", "held")) == 0)
    return by_term.unionByName(by_words.select("q", F.lit(None).cast("bigint").alias("treatment_id"), "location_id", F.lit(None).cast(by_term.schema["least"].dataType).alias("least")))


_NAMED = "lower(p_name || ' ' || CAST(p_partkey % 97 AS VARCHAR))"
_QUESTIONS = "(SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN ' ' || upper(p_name) || ' ' || CAST(p_partkey % 97 AS VARCHAR) WHEN 1 THEN p_type || ' ' || p_brand WHEN 2 THEN p_name WHEN 3 THEN 'machinery nation_' || CAST(p_partkey % 25 AS VARCHAR) ELSE 'no such thing' END AS q FROM part)"


@query("e1_search", sql(f""", names AS (SELECT p_partkey AS treatment_id, {_NAMED} AS name, lower(p_type || ' ' || p_brand) AS synonym FROM part), q AS (SELECT q, lower(trim(q)) AS term FROM {_QUESTIONS}),
h AS (SELECT q, treatment_id, 1 AS tier FROM q JOIN names ON name = term UNION ALL SELECT q, treatment_id, 2 FROM q JOIN names ON synonym = term UNION ALL SELECT q, treatment_id, 3 FROM q JOIN names ON starts_with(name, term || ' ')),
t AS (SELECT q, tier, count(DISTINCT treatment_id) AS n, min(treatment_id) AS treatment_id FROM h GROUP BY 1, 2), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY q ORDER BY tier) = 1), k AS (SELECT q, treatment_id FROM f WHERE n = 1),
a AS (SELECT * FROM locations WHERE status = 'active'), w AS (SELECT q, unnest(list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'))) AS word, len(list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'))) AS n FROM q WHERE q NOT IN (SELECT q FROM k)),
v AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(name || ' ' || locality || ' ' || country_code), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'))) AS word FROM a)
SELECT q, k.treatment_id, location_id, min(CASE WHEN price_amount > 0 THEN price_amount END) AS least FROM k JOIN offerings o ON o.treatment_id = k.treatment_id JOIN a ON a.id = location_id GROUP BY 1, 2, 3
UNION ALL SELECT q, NULL, id, NULL FROM w JOIN v USING (word) GROUP BY q, n, id HAVING count(*) = n""", "locations", "offerings"))
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Queries as people write them: resolved to a treatment where they can be, else searched by word."""
    part = read(spark, d, "part")
    number = (F.col("p_partkey") % 97).cast("string")
    names = part.select(F.col("p_partkey").alias("treatment_id"), F.concat_ws(" ", "p_name", number).alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("synonym"))
    k = F.col("p_partkey") % 5
    asked = F.when(k == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), number)).when(k == 1, F.concat_ws(" ", "p_type", "p_brand")).when(k == 2, F.col("p_name")).when(k == 3, F.concat(F.lit("machinery nation_"), (F.col("p_partkey") % 25).cast("string"))).otherwise("no such thing")
    return searched(part.select(asked.alias("q")).distinct(), names, active(locations(spark, d)), offerings(spark, d))
