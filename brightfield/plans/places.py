"""Places found elsewhere: geocoder answers, discovered candidates, licence registries, trial records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.functions import geocoding, text, urls
from brightfield.functions.binding import let
from brightfield.functions.geocoding import COUNTRY_NAMES, PLAIN_STREET_WORDS
from brightfield.raw import duck, pick
from brightfield.registry import query
from brightfield.roles import read


# ---- geocoder answers ----

_NUMBER = "CAST(c_custkey % 50 + 1 AS STRING) || CASE WHEN c_custkey % 9 = 0 THEN 'a' ELSE '' END"
_STREET = pick("c_custkey", "'Harbour'", "'Old Mill'", "'Saint Marie'", "'Königs'") + " || ' ' || " + pick("c_custkey", "'Street'", "'Ave'", "'Road'")
_COUNTRY_OF = pick("{k}", "'Canada'", "'USA'", "'Deutschland'", "'United Kingdom'", "'France'", "'Republic of Korea'", "'Nowhere'")
_ASKED = {
    "id": "c_custkey",
    "address": f"CASE WHEN c_custkey % 8 = 7 THEN NULL ELSE {_NUMBER} || ' ' || {_STREET} END",
    "locality": "CASE WHEN c_custkey % 10 = 3 THEN '' ELSE c_mktsegment END",
    "region": pick("c_custkey", "'Ontario'", None, "'Île-de-France'"),
    "postal_code": pick("c_custkey", "'K1A 0B' || CAST(c_custkey % 7 AS STRING)", None, "CAST(10000 + c_custkey AS STRING)", "''"),
    "country_code": pick("c_custkey", "'CA'", "' us '", "'DE'", "'GB'", "'FR'", "'KR'", "'XX'"),
    "latitude": "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0.0 WHEN c_custkey % 17 = 0 THEN 91.5 ELSE CAST(c_custkey % 80 AS DOUBLE) END",
    "longitude": "CASE WHEN c_custkey % 11 = 0 THEN 0.0 ELSE CAST(c_custkey % 170 AS DOUBLE) END",
    "formatted": pick(
        "(c_custkey div 3)",
        f"{_NUMBER} || ' ' || {_STREET} || ', ' || c_mktsegment || ', ' || {_COUNTRY_OF.format(k='c_custkey')}",
        f"'1' || {_NUMBER} || ' ' || {_STREET} || ', ' || c_mktsegment",
        f"{_NUMBER} || ' Other Street, ' || c_mktsegment || ', ' || {_COUNTRY_OF.format(k='c_custkey')}",
        f"upper({_STREET}) || ' ' || {_NUMBER} || '; 10' || CAST(c_custkey AS STRING) || ' K1A-0B' || CAST(c_custkey % 7 AS STRING) || ' & more'",
        f"{_NUMBER} || ' ' || {_STREET} || ', ' || c_mktsegment || ', ' || {_COUNTRY_OF.format(k='(c_custkey + 1)')}",
        "'  '",
        f"c_mktsegment || ', Ontario, Ile de France, ' || {_COUNTRY_OF.format(k='c_custkey')}",
    ),
}


def _plain_sql(c: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower(coalesce({c}, ''))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


_NAMES = ", ".join(f"('{code}', '{name}')" for code, names in COUNTRY_NAMES.items() for name in names)


@query("x9_geocode_answers", f"""WITH asked AS (SELECT {", ".join(f"{duck(v)} AS {k}" for k, v in _ASKED.items())} FROM customer), names(code, name) AS (VALUES {_NAMES}),
t AS (SELECT *, {_plain_sql('formatted')} AS f, {_plain_sql('address')} AS a, {_plain_sql('locality')} AS l, {_plain_sql('region')} AS r, replace({_plain_sql('postal_code')}, ' ', '') AS p, upper(trim(country_code)) AS c FROM asked),
u AS (SELECT *, nullif(regexp_extract(a, '\\b[0-9]+[a-z]?\\b'), '') AS number, list_filter(list_distinct(string_split(a, ' ')), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+[a-z]?$') AND w NOT IN ({", ".join(f"'{w}'" for w in PLAIN_STREET_WORDS)})) AS words FROM t),
country AS (SELECT id, arg_max(n.code, length(n.name)) AS named FROM t JOIN names n ON contains(' ' || f || ' ', ' ' || n.name || ' ') GROUP BY id),
v AS (SELECT u.*, a <> '' AND f <> '' AND len(words) > 0 AND len(list_intersect(words, string_split(f, ' '))) >= least(2, len(words)) AND (number IS NULL OR list_contains(string_split(f, ' '), number)) AS street,
  a <> '' AND f <> '' AND number IS NOT NULL AND list_contains(string_split(f, ' '), number) AND len(list_intersect(words, string_split(f, ' '))) >= 2 AS strong,
  l <> '' AND f <> '' AND contains(' ' || f || ' ', ' ' || l || ' ') AS in_locality, r <> '' AND f <> '' AND contains(' ' || f || ' ', ' ' || r || ' ') AS in_region, p <> '' AND f <> '' AND contains(replace(f, ' ', ''), p) AS in_postal,
  CASE WHEN c IN (SELECT code FROM names) AND named IS NOT NULL THEN named = c END AS in_country FROM u LEFT JOIN country USING (id)),
w AS (SELECT *, coalesce(in_country, true) AND CASE WHEN a <> '' THEN street AND CASE WHEN l <> '' OR p <> '' THEN in_locality OR in_postal WHEN r <> '' THEN in_region ELSE coalesce(in_country, false) OR strong END
  WHEN l <> '' THEN in_locality AND CASE WHEN p <> '' THEN in_postal WHEN r <> '' THEN in_region ELSE coalesce(in_country, false) END ELSE false END AS same,
  coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0), false) AS there, trim(coalesce(formatted, '')) <> '' AS written FROM v)
SELECT id, there AND written AND same AS valid, CASE WHEN NOT there THEN 'coordinates_out_of_range' WHEN NOT written THEN 'formatted_address_missing' WHEN same THEN 'identity_validated' WHEN in_country = false THEN 'country_mismatch' ELSE 'address_identity_mismatch' END AS reason,
  street, in_locality AS locality, in_region AS region, in_postal AS postal, in_country AS country FROM w""")
def x9(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "customer").select(*[F.expr(v).alias(k) for k, v in _ASKED.items()])
    columns = [F.col(c) for c in ("latitude", "longitude", "formatted", "address", "locality", "region", "postal_code", "country_code")]
    return asked.select("id", geocoding.validated(*columns).alias("x")).select("id", "x.*")


# ---- discovered candidates ----

# Texts that stand for nothing, codes of regions and countries by name, and states that a later sighting never changes.
NOTHING = "^(null|none|n/a|unknown|not available)$"
REGIONS = {
    "ALABAMA": "AL", "ARIZONA": "AZ", "CALIFORNIA": "CA", "COLORADO": "CO", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "ILLINOIS": "IL", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "NEVADA": "NV",
    "NEW JERSEY": "NJ", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "PENNSYLVANIA": "PA", "TEXAS": "TX", "VIRGINIA": "VA", "WASHINGTON": "WA", "BRITISH COLUMBIA": "BC", "ONTARIO": "ON", "QUEBEC": "QC", "QUÉBEC": "QC",
    "BAVARIA": "BY", "BAYERN": "BY", "GREATER LONDON": "LONDON", "BALEARIC ISLANDS": "IB", "ILLES BALEARS": "IB", "IBIZA": "IB", "ÎLE-DE-FRANCE": "IDF", "ILE-DE-FRANCE": "IDF", "PARIS": "IDF", "QUINTANA ROO": "QR",
    "MEXICO CITY": "CMX", "CIUDAD DE MÉXICO": "CMX", "CDMX": "CMX", "WESTERN CAPE": "WC", "LISBOA": "LISBON", "QATAR": "DOHA", "QA": "DOHA",
}
COUNTRIES = {
    "CANADA": "CA", "GERMANY": "DE", "SPAIN": "ES", "FRANCE": "FR", "INDONESIA": "ID", "MEXICO": "MX", "PORTUGAL": "PT", "QATAR": "QA", "SINGAPORE": "SG", "THAILAND": "TH", "UAE": "AE", "UNITED ARAB EMIRATES": "AE",
    "UK": "GB", "UNITED KINGDOM": "GB", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "SOUTH AFRICA": "ZA",
}
SETTLED = ("existing_match", "ready", "rejected", "promoted")
NUMBERED_COUNTRIES = ("US", "CA")


def said(c: Column) -> Column:
    """Trimmed text, null where it says nothing."""
    t = F.trim(c)
    return F.when((t != "") & ~F.lower(t).rlike(NOTHING), t)


def _code(c: Column, codes: dict[str, str], default: str) -> Column:
    up = F.upper(F.coalesce(said(c), F.lit(default)))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[up], up)


def _identity(c: Column) -> Column:
    return F.trim(F.regexp_replace(text.fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def _site(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, "^[a-z]+://([^/?]+)", 1), "^www\\.", ""), ":[0-9]+$", "")


def same_family(a: Column, b: Column) -> Column:
    """Whether two hosts are one, or one is a part of the other's domain."""
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))


def normalised_places(found: DataFrame, regions: tuple[str, ...] = ("CA",), countries: tuple[str, ...] = ("US",)) -> DataFrame:
    """``found`` (turn, name, website, address, locality, region, country, email, evidence, citations, offerings) as candidates.

    The candidate key is a hash of name, address, places and web site without their spelling; a place counts as discovered if it has a
    physical address in a wanted region, and a link of its own that a citation's site corroborates; else it needs review.
    """
    links = lambda c: F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda u: urls.absolute(said(u)))))
    made = found.select(
        "turn", said(F.col("name")).alias("name"), urls.absolute(said(F.col("website"))).alias("website"), said(F.col("address")).alias("address"), said(F.col("locality")).alias("locality"),
        _code(F.col("region"), REGIONS, regions[0]).alias("region"), _code(F.col("country"), COUNTRIES, countries[0]).alias("country"), F.lower(said(F.col("email"))).alias("email"),
        links("evidence").alias("evidence"), links("citations").alias("citations"), F.coalesce("offerings", F.array().cast("array<string>")).alias("offerings"),
    ).where(F.col("name").isNotNull())
    web = F.concat(_site(F.col("website")), F.regexp_replace(F.regexp_extract("website", "^[a-z]+://[^/?]+([^?]*)", 1), "/+$", ""))
    key = F.sha2(F.concat_ws("|", *[_identity(F.col(c)) for c in ("name", "address", "locality", "region", "country")], F.coalesce(web, F.lit(""))), 256)
    own = F.transform(F.array_compact(F.concat(F.array("website"), F.col("evidence"))), _site)
    cited = F.transform("citations", _site)
    corroborated = F.exists(own, lambda a: F.exists(cited, lambda b: same_family(a, b)))
    first = F.trim(F.substring_index("address", ",", 1))
    words = F.size(F.filter(F.split(first, "\\s+"), lambda w: w.rlike("(?i)[a-z]{2,}")))
    physical = F.col("address").rlike("(?i)[a-z]") & (F.col("address").rlike("[0-9]") | (~F.col("country").isin(*NUMBERED_COUNTRIES) & (words >= 2) & (_identity(first) != _identity(F.col("locality")))))
    linked = F.col("website").isNotNull() | (F.size("evidence") > 0)
    wanted = F.coalesce(physical, F.lit(False)) & F.col("locality").isNotNull() & F.col("region").isin(*regions) & F.col("country").isin(*countries) & linked & corroborated
    made = made.withColumn("candidate_key", key).withColumn("status", F.when(wanted, "discovered").otherwise("needs_review"))
    valid = F.when(F.col("email").rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"), F.col("email"))
    return made.withColumn("email", valid).drop("citations")


def merged_candidates(sightings: DataFrame) -> DataFrame:
    """All sightings of a candidate as one row, as if each were merged into the stored one in its turn.

    Every part of the merge is an aggregate that combines before the shuffle: the first value that is not null, the union of links, the
    longest list of offerings (the first of equals), and the highest status, of which a settled one never changes.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("turn", c)))[c].alias(c)
    rank = F.when(F.col("status").isin(*SETTLED), 2).when(F.col("status") == "discovered", 1).otherwise(0)
    longest = F.max(F.struct(F.size("offerings").alias("n"), (-F.col("turn")).alias("turn"), "offerings"))["offerings"]
    # Links are united one by one, so a candidate that is seen very often never holds more than its distinct links in a row.
    each = sightings.select("candidate_key", F.explode("evidence").alias("link")).distinct()
    united = each.groupBy("candidate_key").agg(F.sort_array(F.collect_list("link")).alias("evidence"))
    one = sightings.groupBy("candidate_key").agg(
        F.count("*").alias("sightings"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        *[first(c) for c in ("name", "website", "address", "locality", "region", "country", "email")],
        longest.alias("offerings"), F.max(F.struct(rank.alias("rank"), (-F.col("turn")).alias("turn"), "status"))["status"].alias("status"),
    )
    return one.join(united, "candidate_key", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


_P = "(c_custkey div 3)"
_FOUND = {
    "turn": "c_custkey",
    "name": pick("c_custkey", f"'Café  No. ' || CAST({_P} AS STRING)", f"'CAFE no ' || CAST({_P} AS STRING)", f"CASE WHEN {_P} % 6 = 0 THEN 'n/a' ELSE 'cafe No: ' || CAST({_P} AS STRING) END"),
    "website": pick(_P, "'HTTPS://WWW.Site' || CAST(c_custkey div 3 AS STRING) || '.example.org/home/'", None, "CASE WHEN c_custkey % 3 = 0 THEN 'https://site' || CAST(c_custkey div 3 AS STRING) || '.example.org/home' ELSE 'https://www.site' || CAST(c_custkey div 3 AS STRING) || '.example.org/home//?x=1' END", "'not an address'"),
    "address": pick(_P, "'12 Main St.'", "CASE WHEN c_custkey % 3 = 1 THEN '7 Rue' ELSE '7, rue' END", "'Long Acre House, Soho'", None, "'9'"),
    "locality": pick(_P, "'Oakland'", "'OAKLAND '", "'unknown'"),
    "region": pick(_P, "'California'", None, "'ca'", "'Texas'"),
    "country": pick(_P, "'United States'", None, "'FRANCE'", "'us'", "'US'"),
    "email": pick("c_custkey", None, "'Mail@Example.org'", "'no mail'"),
    "evidence_1": pick("c_custkey", f"'https://blog.site' || CAST({_P} AS STRING) || '.example.org/a b#c'", "'mailto:x@y.z'", f"'https://list.example.net/' || CAST({_P} AS STRING)"),
    "citation": pick(_P, "'https://site' || CAST(c_custkey div 3 AS STRING) || '.example.org'", "'https://list.example.net/all'", "'https://ample.org/'", None, "'https://example.org/'"),
    "n_offerings": "c_custkey % 4",
}


def discoveries(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "customer").select(*[F.expr(v).alias(k) for k, v in _FOUND.items()])
    offered = F.when(F.col("n_offerings") > 0, F.transform(F.expr("sequence(1, cast(n_offerings as int))"), lambda i: F.concat(F.lit("offer "), i.cast("string"), F.lit(" of "), F.col("turn").cast("string"))))
    return raw.withColumn("evidence", F.array("evidence_1")).withColumn("citations", F.array("citation")).withColumn("offerings", offered)


_SAID = lambda c: f"CASE WHEN trim({c}) <> '' AND NOT regexp_matches(lower(trim({c})), '{NOTHING}') THEN trim({c}) END"
_URL = lambda c: f"CASE WHEN regexp_matches(lower({c}), '^https?://') THEN lower(regexp_extract({c}, '^[A-Za-z]+://[^/?#]+')) || replace(CASE WHEN regexp_extract({c}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({c}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) END, ' ', '%20') || regexp_extract({c}, '[?][^#]*') END"
_HOST = lambda c: f"regexp_replace(regexp_extract({c}, '^[a-z]+://([^/?]+)', 1), '^www[.]', '')"
_IDENTITY = lambda c: f"trim(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_MAP = lambda codes: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in codes.items()) + "}"

_CANDIDATES = f"""raw AS (SELECT {", ".join(f"{duck(v)} AS {k}" for k, v in _FOUND.items())} FROM customer),
texts AS (SELECT turn, {_SAID('name')} AS name, {_URL('website')} AS website, {_SAID('address')} AS address, {_SAID('locality')} AS locality, upper(coalesce({_SAID('region')}, 'CA')) AS r0, upper(coalesce({_SAID('country')}, 'US')) AS c0, lower(email) AS mail, {_URL('evidence_1')} AS evidence, {_URL('citation')} AS citation, n_offerings FROM raw),
coded AS (SELECT *, coalesce({_MAP(REGIONS)}[r0], r0) AS region, coalesce({_MAP(COUNTRIES)}[c0], c0) AS country, CASE WHEN regexp_matches(mail, '^[^\\s@]+@[^\\s@]+[.][^\\s@]+$') THEN mail END AS email FROM texts WHERE name IS NOT NULL),
hosts AS (SELECT *, {_HOST('website')} AS h1, {_HOST('evidence')} AS h2, {_HOST('citation')} AS hc, trim(split_part(address, ',', 1)) AS first FROM coded),
judged AS (SELECT *, coalesce(hc <> '' AND ((h1 <> '' AND (h1 = hc OR h1 LIKE '%.' || hc OR hc LIKE '%.' || h1)) OR (h2 <> '' AND (h2 = hc OR h2 LIKE '%.' || hc OR hc LIKE '%.' || h2))), false) OR coalesce(h1 <> '' AND (h1 = hc OR h1 LIKE '%.' || hc OR hc LIKE '%.' || h1), false) OR coalesce(h2 <> '' AND (h2 = hc OR h2 LIKE '%.' || hc OR hc LIKE '%.' || h2), false) AS corroborated,
  coalesce(regexp_matches(address, '[A-Za-z]') AND (regexp_matches(address, '[0-9]') OR (country NOT IN ('US', 'CA') AND len(list_filter(regexp_split_to_array(first, '\\s+'), lambda w: regexp_matches(w, '[A-Za-z]{{2,}}'))) >= 2 AND {_IDENTITY('first')} <> {_IDENTITY('locality')})), false) AS physical FROM hosts),
keyed AS (SELECT *, sha256({" || '|' || ".join(_IDENTITY(c) for c in ("name", "address", "locality", "region", "country"))} || '|' || coalesce(h1 || regexp_replace(regexp_extract(website, '^[a-z]+://[^/?]+([^?]*)', 1), '/+$', ''), '')) AS candidate_key,
  CASE WHEN physical AND locality IS NOT NULL AND region = 'CA' AND country = 'US' AND (website IS NOT NULL OR evidence IS NOT NULL) AND corroborated THEN 'discovered' ELSE 'needs_review' END AS status FROM judged)"""


@query("x16_discovered_places", f"WITH {_CANDIDATES} SELECT turn, candidate_key, name, website, address, locality, region, country, email, coalesce(evidence, '') AS evidence, n_offerings, status FROM keyed")
def x16(spark: SparkSession, d: str) -> DataFrame:
    made = normalised_places(discoveries(spark, d))
    return made.select("turn", "candidate_key", "name", "website", "address", "locality", "region", "country", "email", F.array_join("evidence", " ").alias("evidence"), F.size("offerings").cast("bigint").alias("n_offerings"), "status")


def stored_candidates(made: DataFrame) -> DataFrame:
    """What an earlier campaign stored: every seventh place, in some state, before all other turns."""
    state = F.when(F.col("turn") % 4 == 0, "promoted").when(F.col("turn") % 4 == 1, "rejected").when(F.col("turn") % 4 == 2, "discovered").otherwise("needs_review")
    return made.where(F.col("turn") % 7 == 0).withColumn("status", state).withColumn("email", F.lit(None).cast("string")).withColumn("turn", F.col("turn") - 1_000_000_000)


@query("c18_candidate_merge", f"""WITH {_CANDIDATES}, stored AS (SELECT * REPLACE (turn - 1000000000 AS turn, NULL AS email, CASE turn % 4 WHEN 0 THEN 'promoted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'discovered' ELSE 'needs_review' END AS status) FROM keyed WHERE turn % 7 = 0),
every AS (SELECT turn AS made_in, * FROM keyed UNION ALL SELECT turn + 1000000000, * FROM stored)
SELECT candidate_key, count(*) AS sightings, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(name, turn) AS name, arg_min(website, turn) AS website, arg_min(address, turn) AS address, arg_min(email, turn) AS email,
  array_to_string(list_sort(list_distinct(list(evidence))), ' ') AS evidence, max(n_offerings) AS n_offerings, coalesce(arg_min(made_in, -n_offerings * 10000000000 + turn) FILTER (WHERE n_offerings > 0), -1) AS offered_in,
  coalesce(arg_min(status, turn) FILTER (WHERE status IN ('existing_match', 'ready', 'rejected', 'promoted')), CASE WHEN bool_or(status = 'discovered') THEN 'discovered' ELSE 'needs_review' END) AS status
FROM every GROUP BY candidate_key""")
def c18_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stored candidates and new sightings, merged."""
    made = normalised_places(discoveries(spark, d))
    one = merged_candidates(made.unionByName(stored_candidates(made)))
    offered = F.coalesce(F.regexp_extract(F.get("offerings", F.lit(0)), "of ([0-9]+)$", 1).cast("bigint"), F.lit(-1))
    return one.select("candidate_key", "sightings", "first_turn", "last_turn", "name", "website", "address", "email", F.array_join("evidence", " ").alias("evidence"), F.size("offerings").cast("bigint").alias("n_offerings"), offered.alias("offered_in"), "status")


# ---- licence registries ----

# Licence types of physicians by board, and the board whose types tell the degree.
LICENCE_TYPES = {
    "TX": ("Physician License",),
    "WA": (
        "Physician And Surgeon License",
        "Physician and Surgeon License Interstate Medical Licensure Compact",
        "Osteopathic Physician & Surgeon License",
        "Osteopathic Physician and Surgeon License Interstate Medical Licensure Compact",
    ),
}
TITLES = "\\b(dr|doctor)\\b\\.?"
DEGREES = "\\b(m\\.?d|d\\.?o|f\\.?a\\.?c\\.?s|f\\.?a\\.?a\\.?d)\\b\\.?"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


def name_token(c: Column) -> Column:
    return F.regexp_replace(text.fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def person_name(c: Column) -> Column:
    """struct(first, last) of a written name without titles, degrees and suffixes; null with fewer than two words."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text.fold(F.coalesce(c, F.lit(""))), TITLES, " "), DEGREES, " "), "[^a-z' -]+", " ")
    words = F.filter(F.split(F.trim(bare), "\\s+"), lambda w: (w != "") & ~w.isin(*SUFFIXES))
    return let(words, lambda w: F.when(F.size(w) >= 2, F.struct(name_token(F.element_at(w, 1)).alias("first"), name_token(F.element_at(w, -1)).alias("last"))))


def degree_of(c: Column) -> Column:
    letters = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", ""))
    return F.when(letters.startswith("DO"), "DO").when(letters.startswith("MD"), "MD")


def usable_licences(records: DataFrame, today: str) -> DataFrame:
    """``records`` (board, number, first_name, last_name, type, current, discipline, degree, expires, city) that may prove a licence:
    of a physician, current, without measures against it, and not expired. (board, first, last, degree, city, number)"""
    types = F.create_map(*[F.lit(x) for board, names in LICENCE_TYPES.items() for x in (board, F.array(*map(F.lit, names)))])
    texas = F.col("board") == "TX"
    current = F.when(texas, F.upper("current") == "Y").otherwise(F.lower("current") == "active")
    clean = F.when(texas, F.upper("discipline") == "NONE").otherwise(F.lower("discipline") == "no")
    fresh = F.col("expires").isNull() | (F.col("expires") >= today)
    degree = F.when(texas, F.upper(name_token(F.col("degree")))).otherwise(F.when(F.lower("type").contains("osteopathic"), "DO").otherwise("MD"))
    first = name_token(F.when(texas, F.split(F.trim("first_name"), "\\s+")[0]).otherwise(F.col("first_name")))
    kept = records.where(F.array_contains(types[F.col("board")], F.col("type")) & current & clean & fresh)
    return kept.select("board", first.alias("first"), name_token(F.col("last_name")).alias("last"), degree.alias("degree"), name_token(F.col("city")).alias("city"), "number")


def registry_matches(clinicians: DataFrame, records: DataFrame, today: str) -> DataFrame:
    """``clinicians`` (id, board, full_name, credentials, locality) with outcome, number and eligible licences.

    One licence of the name (and degree, where the clinician gives one) verifies; of several the only one in the locality does. The
    registry is counted by name, and by name and city, before it meets the clinicians, so that a common name pairs nobody with nobody.
    """
    usable = usable_licences(records, today)
    either = usable.withColumn("degree", F.explode(F.array_distinct(F.array("degree", F.lit("*"))))).where("degree IS NOT NULL")
    name = ["board", "first", "last", "degree"]
    by_name = either.groupBy(*name).agg(F.count("*").alias("eligible"), F.min("number").alias("only"))
    by_city = either.groupBy(*name, "city").agg(F.count("*").alias("local"), F.min("number").alias("only_local"))
    asked = clinicians.select("id", "board", person_name(F.col("full_name")).alias("x"), F.coalesce(degree_of(F.col("credentials")), F.lit("*")).alias("degree"), name_token(F.col("locality")).alias("city"))
    asked = asked.select("id", "board", "x.first", "x.last", "degree", "city")
    met = asked.join(by_name, name, "left").join(by_city.where("city <> ''"), [*name, "city"], "left")
    n, here = F.coalesce("eligible", F.lit(0)), F.coalesce("local", F.lit(0))
    number = F.when(n == 1, F.col("only")).when((n > 1) & (here == 1), F.col("only_local"))
    outcome = F.when(F.col("first").isNull(), "invalid_candidate_name").when(~F.col("board").isin(*LICENCE_TYPES), "board_source_unsupported").when(n == 0, "board_record_not_found").when(number.isNull(), "ambiguous_board_match").otherwise("verified")
    return met.select("id", outcome.alias("outcome"), number.alias("number"), n.alias("eligible"))


_K = "c_custkey"
_FIRST = pick(_K, "'Ana'", "'Béla'", "'Carl'", "'Dóra'", "'Eve'")
_LAST = pick(f"({_K} div 5)", "'Smith-'", "'Lee'", "'Müll'") + " || chr(CAST(97 + c_nationkey AS INT)) || 'er'"
_RECORD = {
    "board": pick(_K, "'TX'", "'WA'", "'TX'", "'NY'"), "number": f"'L' || CAST({_K} AS STRING)", "first_name": f"{_FIRST} || CASE WHEN {_K} % 7 = 0 THEN ' Maria' ELSE '' END", "last_name": _LAST,
    "type": pick(_K, "'Physician License'", "'Osteopathic Physician & Surgeon License'", "'Physician License'", "'Nurse'", "'Physician License'", "'Physician And Surgeon License'", "'Acupuncture'"),
    "current": f"CASE WHEN {_K} % 2 = 0 THEN " + pick(_K, "'Y'", "'y'", "'N'") + " ELSE " + pick(_K, "'Active'", "'ACTIVE'", "'Lapsed'") + " END", "discipline": pick(_K, "'None'", "'no'", "'NONE'", "'No'", "'none'", "'no'", "'YES'", "'no'"),
    "degree": pick(f"({_K} div 2)", "'M.D.'", "'DO'", None), "expires": f"CASE {_K} % 6 WHEN 0 THEN NULL WHEN 1 THEN '2023-12-31' ELSE '2025-06-30' END", "city": pick(f"({_K} div 3)", "'San José'", "'OAK-LAND'", "'Lyon'"),
}
_CLINICIAN = {
    "id": _K, "board": pick(_K, "'TX'", "'WA'", "'TX'", "'WA'", "'OR'"), "full_name": pick(f"({_K} div 4)", f"'Dr. ' || {_FIRST} || ' ' || {_LAST} || ', M.D.'", f"upper({_FIRST} || ' X. ' || {_LAST}) || ' Jr'", f"{_FIRST} || ' ' || {_LAST}", "'Doctor No, MD'"),
    "credentials": pick(f"({_K} div 2)", "'M.D., PhD'", None, "'D.O.'"), "locality": pick(f"({_K} div 3)", "'San Jose'", "'Oakland'", "'LYON'", "''"),
}


def registry(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    people = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    made = lambda of: people.select(*[F.expr(v).alias(k) for k, v in of.items()])
    return made(_CLINICIAN), made(_RECORD)


_TOKEN = lambda c: f"regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+', '', 'g')"
TODAY = "2024-07-01"


@query("d27_registry_matches", f"""WITH people AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey), clinicians AS (SELECT {", ".join(f"{duck(v)} AS {k}" for k, v in _CLINICIAN.items())} FROM people),
records AS (SELECT {", ".join(f"{duck(v)} AS {k}" for k, v in _RECORD.items())} FROM people),
usable AS (SELECT board, number, {_TOKEN("CASE WHEN board = 'TX' THEN string_split(trim(first_name), ' ')[1] ELSE first_name END")} AS first, {_TOKEN('last_name')} AS last, {_TOKEN('city')} AS city, CASE WHEN board = 'TX' THEN upper({_TOKEN('degree')}) WHEN contains(lower(type), 'osteopathic') THEN 'DO' ELSE 'MD' END AS degree FROM records
  WHERE CASE board WHEN 'TX' THEN type = 'Physician License' AND upper(current) = 'Y' AND upper(discipline) = 'NONE' WHEN 'WA' THEN type IN ({", ".join(f"'{t}'" for t in LICENCE_TYPES["WA"])}) AND lower(current) = 'active' AND lower(discipline) = 'no' ELSE false END AND (expires IS NULL OR expires >= '{TODAY}')),
words AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(full_name)), '{TITLES}', ' ', 'g'), '{DEGREES}', ' ', 'g'), '[^a-z'' -]+', ' ', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS w,
  CASE WHEN upper(regexp_replace(coalesce(credentials, ''), '[^A-Za-z]', '', 'g')) LIKE 'DO%' THEN 'DO' WHEN upper(regexp_replace(coalesce(credentials, ''), '[^A-Za-z]', '', 'g')) LIKE 'MD%' THEN 'MD' END AS degree FROM clinicians),
met AS (SELECT c.id, c.board, len(w) AS n_words, u.number, u.city = {_TOKEN('locality')} AND u.city <> '' AS local FROM words c LEFT JOIN usable u ON len(w) >= 2 AND u.board = c.board AND u.first = {_TOKEN('w[1]')} AND u.last = {_TOKEN('w[-1]')} AND (c.degree IS NULL OR c.degree = u.degree)),
counted AS (SELECT id, board, n_words, count(number) AS n, min(number) AS lone, count(number) FILTER (WHERE local) AS n_local, min(number) FILTER (WHERE local) AS only_local FROM met GROUP BY ALL)
SELECT id, CASE WHEN n_words < 2 THEN 'invalid_candidate_name' WHEN board NOT IN ('TX', 'WA') THEN 'board_source_unsupported' WHEN n = 0 THEN 'board_record_not_found' WHEN n = 1 OR n_local = 1 THEN 'verified' ELSE 'ambiguous_board_match' END AS outcome,
  CASE WHEN n = 1 THEN lone WHEN n > 1 AND n_local = 1 THEN only_local END AS number, n AS eligible FROM counted""")
def d27(spark: SparkSession, d: str) -> DataFrame:
    clinicians, records = registry(spark, d)
    return registry_matches(clinicians, records, TODAY)


# ---- trial records ----

TRIALS = """struct<totalCount:bigint,studies:array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,
  statusModule:struct<overallStatus:string,lastUpdatePostDateStruct:struct<date:string>>,designModule:struct<phases:array<string>,enrollmentInfo:struct<count:double>>>,hasResults:boolean>>>"""


def trial_summary(response: Column, shown: int = 3) -> Column:
    """struct(total, recruiting, with_results, statuses, records) of a registry's answer: studies without a number, title or status do
    not count, statuses are counted by name, and the first few records come in the answer's order."""
    section = lambda s: s["protocolSection"]
    record = lambda s: F.struct(
        section(s)["identificationModule"]["nctId"].alias("number"), section(s)["identificationModule"]["briefTitle"].alias("title"), section(s)["statusModule"]["overallStatus"].alias("status"),
        F.coalesce(section(s)["designModule"]["phases"], F.array().cast("array<string>")).alias("phases"), section(s)["designModule"]["enrollmentInfo"]["count"].alias("enrollment"),
        F.coalesce(s["hasResults"], F.lit(False)).alias("has_results"), section(s)["statusModule"]["lastUpdatePostDateStruct"]["date"].alias("updated"),
    )
    there = lambda r: F.coalesce((r["number"] != "") & (r["title"] != "") & (r["status"] != ""), F.lit(False))

    def of(x: Column) -> Column:
        def counted(records: Column) -> Column:
            count = lambda status: F.size(F.filter(records, lambda r: r["status"] == status))
            names = F.array_sort(F.array_distinct(F.transform(records, lambda r: r["status"])))
            return F.struct(
                F.coalesce(F.nullif(x["totalCount"], F.lit(0)), F.size(records).cast("bigint")).alias("total"),
                count(F.lit("RECRUITING")).alias("recruiting"),
                F.size(F.filter(records, lambda r: r["has_results"])).alias("with_results"),
                F.transform(names, lambda s: F.struct(s.alias("status"), count(s).alias("n"))).alias("statuses"),
                F.slice(records, 1, shown).alias("records"),
            )

        studies = F.coalesce(x["studies"], F.array().cast("array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string,lastUpdatePostDateStruct:struct<date:string>>,designModule:struct<phases:array<string>,enrollmentInfo:struct<count:double>>>,hasResults:boolean>>"))
        return let(F.filter(F.transform(studies, record), there), counted)

    return let(F.from_json(response, TRIALS), of)


def _study(i: int) -> str:
    k = f"(p_partkey + {i})"
    status = pick(k, "'\"RECRUITING\"'", "'\"COMPLETED\"'", "'null'", "'\"ACTIVE_NOT_RECRUITING\"'", "'\"COMPLETED\"'")
    return (
        f"'{{\"protocolSection\":{{\"identificationModule\":{{\"nctId\":' || CASE WHEN {k} % 13 = 0 THEN 'null' ELSE '\"NCT' || CAST(p_partkey * 10 + {i} AS STRING) || '\"' END || ',\"briefTitle\":\"' || CASE WHEN {k} % 17 = 0 THEN '' ELSE p_name END || '\"}},"
        f"\"statusModule\":{{\"overallStatus\":' || {status} || ',\"lastUpdatePostDateStruct\":{{\"date\":\"2024-0' || CAST({k} % 9 + 1 AS STRING) || '-01\"}}}},\"designModule\":{{\"phases\":[\"PHASE' || CAST({k} % 4 AS STRING) || '\"],"
        f"\"enrollmentInfo\":{{\"count\":' || " + pick(k, "'null'", f"CAST({k} % 300 AS STRING)") + f" || '}}}}}},\"hasResults\":' || " + pick(k, "'true'", "'false'", "'null'") + " || '}'"
    )


_RESPONSE = "'{\"totalCount\":' || " + pick("p_partkey", "'null'", "'0'", "CAST(p_size AS STRING)") + " || ',\"studies\":[{}' || " + " || ".join(f"CASE WHEN p_size % 7 > {i} THEN ',' || {_study(i)} ELSE '' END" for i in range(6)) + " || ']}'"


@query("a45_trial_summary", f"""WITH t AS (SELECT p_partkey AS id, {duck(_RESPONSE)} AS j FROM part), s AS (SELECT id, unnest(from_json(j->'studies', '["JSON"]')) AS s, generate_subscripts(from_json(j->'studies', '["JSON"]'), 1) AS turn FROM t),
r AS (SELECT id, turn, s->'protocolSection'->'identificationModule'->>'nctId' AS number, s->'protocolSection'->'identificationModule'->>'briefTitle' AS title, s->'protocolSection'->'statusModule'->>'overallStatus' AS status,
  CAST(s->'protocolSection'->'designModule'->'enrollmentInfo'->>'count' AS DOUBLE) AS enrollment, coalesce(CAST(s->>'hasResults' AS BOOLEAN), false) AS has_results, s->'protocolSection'->'statusModule'->'lastUpdatePostDateStruct'->>'date' AS updated, s->'protocolSection'->'designModule'->'phases'->>0 AS phase FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS place FROM r WHERE number <> '' AND title <> '' AND status <> ''),
c AS (SELECT id, status, count(*) AS n FROM g GROUP BY 1, 2), n AS (SELECT id, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM c GROUP BY 1),
f AS (SELECT id, count(*) AS found, count(*) FILTER (WHERE status = 'RECRUITING') AS recruiting, count(*) FILTER (WHERE has_results) AS with_results,
  string_agg(number || ' ' || title || ' ' || status || ' ' || phase || ' ' || coalesce(CAST(enrollment AS INT)::VARCHAR, '-') || ' ' || has_results || ' ' || updated, ';' ORDER BY place) FILTER (WHERE place <= 3) AS records FROM g GROUP BY 1)
SELECT t.id, coalesce(nullif(CAST(j->>'totalCount' AS BIGINT), 0), found, 0) AS total, CAST(coalesce(recruiting, 0) AS INT) AS recruiting, CAST(coalesce(with_results, 0) AS INT) AS with_results, coalesce(statuses, '') AS statuses, coalesce(records, '') AS records FROM t LEFT JOIN f USING (id) LEFT JOIN n USING (id)""")
def a45(spark: SparkSession, d: str) -> DataFrame:
    answers = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_RESPONSE).alias("response"))
    found = answers.select("id", trial_summary(F.col("response")).alias("x")).select("id", "x.*")
    shown = lambda r: F.concat_ws(" ", r["number"], r["title"], r["status"], F.get(r["phases"], F.lit(0)), F.coalesce(r["enrollment"].cast("int").cast("string"), F.lit("-")), r["has_results"].cast("string"), r["updated"])
    counts = F.array_join(F.transform("statuses", lambda s: F.concat(s["status"], F.lit("="), s["n"].cast("string"))), ",")
    return found.select("id", "total", "recruiting", "with_results", counts.alias("statuses"), F.array_join(F.transform("records", shown), ";").alias("records"))
