"""Normalisers and small measures over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.functions import geo, pricing, text
from brightfield.operators.similarity import dice_of, dice_percent, rare_first, similar_pairs
from brightfield.registry import query
from brightfield.roles import locations, offerings, read, sql, tasks, treatments

_FOLD = "replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(lower({c})), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'ð', 'd'), 'đ', 'd'), 'þ', 'th'), 'ø', 'o'), 'ł', 'l'), 'ı', 'i')"


@query("n1_human_text", "SELECT doc_id, md5(trim(regexp_replace(replace(" + _FOLD.format(c="coalesce(text, '')") + ", '&', ' and '), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS folded FROM documents")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.human_text(F.coalesce("text", F.lit("")))).alias("folded"))


_TERM = "lower(p_name || ' & ' || p_type || '+' || p_size || 'ml intravenous therapies')"


@query("n2_search_terms", "WITH t AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(replace(replace(" + _TERM + ", '&', ' and '), '+', ' plus '), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g') AS t FROM part), u AS (SELECT id, regexp_replace(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')), '\\bintravenous\\b', 'iv', 'g') AS t FROM t) SELECT id, regexp_replace(regexp_replace(t, '\\b([a-z]{3,})ies\\b', '\\1y', 'g'), '\\b([a-z]{3,}[^s\\W])s\\b', '\\1', 'g') AS term FROM u")
def n2(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" & "), "p_type", F.lit("+"), F.col("p_size").cast("string"), F.lit("ml intravenous therapies"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.search_term(raw).alias("term"))


@query("n3_taxonomy_keys", sql("SELECT id, trim(regexp_replace(lower(brand || ' / ' || name), '[^a-z0-9]+', ' ', 'g')) AS key FROM treatments", "treatments"))
def n3(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).select("id", text.alnum_key(F.concat("brand", F.lit(" / "), "name")).alias("key"))


_WHOLE = "list_distinct([substr('  ' || {c} || '  ', i, 3) FOR i IN range(1, length({c}) + 3)])"


@query("n6_string_dice", f"""WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS t, {_WHOLE.format(c="(p_name || ' ' || p_brand || ' ' || p_type)")} AS g FROM part)
SELECT a.t AS a, b.t AS b, round(2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS dice FROM n a JOIN n b ON a.t < b.t WHERE 200 * len(list_intersect(a.g, b.g)) >= 88 * (len(a.g) + len(b.g))""")
def n6(spark: SparkSession, d: str) -> DataFrame:
    """Labels of parts that share most trigrams of the whole string; every label comes once."""
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    known = rare_first(read(spark, d, "part").select(label.alias("id")).distinct().withColumn("grams", text.string_trigrams(F.col("id"))))
    pairs = similar_pairs(known, known, dice_percent(88)).where("200 * shared >= 88 * (size_a + size_b)")
    return pairs.select("a", "b", F.round(dice_of(pairs), 6).alias("dice"))


def _grams(c: str) -> str:
    return f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN string_split(lower({c}), ' ')]))"


@query("n7_similarity", f"SELECT p_partkey AS id, round(len(list_intersect({_grams('p_name')}, {_grams('p_type')})) / len(list_distinct(list_concat({_grams('p_name')}, {_grams('p_type')}))), 6) AS similarity FROM part")
def n7(spark: SparkSession, d: str) -> DataFrame:
    a, b = text.word_trigrams(F.lower("p_name")), text.word_trigrams(F.lower("p_type"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(text.jaccard(a, b), 6).alias("similarity"))


@query("n11_url_keys", "SELECT page_id, regexp_replace(regexp_replace(lower(split_part(split_part(url, '#', 1), '?', 1)), '^https?://(www\\.)?', ''), '/+$', '') AS key FROM pages")
def n11(spark: SparkSession, d: str) -> DataFrame:
    bare = F.lower(F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)))
    return read(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(bare, "^https?://(www\\.)?", ""), "/+$", "").alias("key"))


@query("n12_phones", """WITH p AS (SELECT c_custkey AS id, c_custkey % 4 AS k, CASE c_custkey % 4 WHEN 0 THEN '+49 (0)30 ' || c_custkey WHEN 1 THEN '0044 20 7946 ' || c_custkey WHEN 2 THEN '1 212 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE '06 ' || (c_custkey % 1000) END AS raw FROM customer),
q AS (SELECT id, k, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM p), r AS (SELECT id, CASE k WHEN 0 THEN digits WHEN 1 THEN substr(digits, 3) WHEN 2 THEN digits ELSE '39' || digits END AS n FROM q)
SELECT id, CASE WHEN length(n) BETWEEN 8 AND 15 THEN '+' || n END AS phone FROM r""")
def n12(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.when(key % 4 == 0, F.concat(F.lit("+49 (0)30 "), key)).when(key % 4 == 1, F.concat(F.lit("0044 20 7946 "), key))
    raw = raw.when(key % 4 == 2, F.concat(F.lit("1 212 555 "), F.lpad((key % 10000).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("06 "), (key % 1000).cast("string")))
    code = F.when(key % 4 == 2, "1").when(key % 4 == 3, "39").otherwise("49")
    return read(spark, d, "customer").select(key.alias("id"), text.e164(raw, code, F.lit(True)).alias("phone"))


@query("n13_emails", "WITH e AS (SELECT s_suppkey AS id, lower(trim(CASE s_suppkey % 3 WHEN 0 THEN ' Office' || s_suppkey || '@Mail.Example ' WHEN 1 THEN 'no address' ELSE 'a@b' END)) AS e FROM supplier) SELECT id, CASE WHEN regexp_matches(e, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]{2,}$') AND length(e) <= 254 THEN e END AS email FROM e")
def n13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" Office"), k, F.lit("@Mail.Example "))).when(k % 3 == 1, "no address").otherwise("a@b")
    return read(spark, d, "supplier").select(k.alias("id"), text.email(raw).alias("email"))


_N = "CASE WHEN {c} = floor({c}) THEN format('{{:,}}', CAST({c} AS BIGINT)) ELSE format('{{:,.2f}}', {c}) END"


@query("n17_prices", sql("""SELECT id, CASE WHEN p IS NULL THEN NULL ELSE CASE WHEN id % 3 = 0 THEN 'From ' ELSE '' END || upper(price_currency) || ' ' || CASE WHEN id % 2 = 0 THEN """ + _N.format(c="p") + " || '-' || " + _N.format(c="(p + 10)") + " ELSE " + _N.format(c="p") + """ END || CASE WHEN price_unit = 'service' THEN '' ELSE ' per ' || price_unit END END AS shown
FROM (SELECT *, floor(price_amount) + (id % 4) * 0.25 AS p FROM offerings)""", "offerings"))
def n17(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).withColumn("p", F.floor("price_amount").cast("double") + (F.col("id") % 4) * F.lit(0.25))
    most = F.when(F.col("id") % 2 == 0, F.col("p") + 10).otherwise(F.col("p"))
    kind = F.when(F.col("id") % 3 == 0, "starting_at").otherwise("exact")
    return o.select("id", F.when(F.col("p").isNotNull(), pricing.shown(F.col("p"), most, F.col("price_currency"), kind, F.col("price_unit"))).alias("shown"))


@query("n20_alnum_keys", "SELECT c_custkey AS id, trim(regexp_replace(lower(c_name || ' · ' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS key FROM customer")
def n20(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alnum_key(F.concat("c_name", F.lit(" · "), "c_mktsegment")).alias("key"))


_AGENTS = ("Mozilla/5.0 (X11)", "Googlebot/2.1", "curl/8.1", None, "Chrome-Lighthouse", "python-requests/2", "Python-urllib/3", "Monitor/1")


@query("n24_robots", "SELECT event_id, coalesce(regexp_matches(lower(agent), '" + text.ROBOTS + "'), true) AS robot FROM (SELECT event_id, [" + ", ".join(f"'{a}'" if a else "NULL" for a in _AGENTS) + "][event_id % 8 + 1] AS agent FROM events)")
def n24(spark: SparkSession, d: str) -> DataFrame:
    agent = F.get(F.array(*[F.lit(a) for a in _AGENTS]), (F.col("event_id") % 8).cast("int"))
    return read(spark, d, "events").select("event_id", text.is_bot(agent).alias("robot"))


@query("n25_country_names", sql("SELECT l.id, coalesce(initcap_(n.n_name), l.country_code) AS country FROM locations l LEFT JOIN nation n ON n.n_name = l.country_code".replace("initcap_(n.n_name)", "upper(substr(n.n_name, 1, 1)) || lower(substr(n.n_name, 2))"), "locations"))
def n25(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "nation").select(F.col("n_name").alias("country_code"), F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 1000))).alias("shown"))
    return locations(spark, d).select("id", "country_code").join(names, "country_code", "left").select("id", F.coalesce("shown", "country_code").alias("country"))


@query("n26_nul_free_json", "SELECT event_id, replace(props, '\"k\"', '\"k' || chr(65533) || '\"') AS props FROM events")
def n26(spark: SparkSession, d: str) -> DataFrame:
    """NUL characters, which stores refuse, become the replacement character."""
    dirty = F.replace("props", F.lit('"k"'), F.concat(F.lit('"k'), F.char(F.lit(0)), F.lit('"')))
    return read(spark, d, "events").select("event_id", F.replace(dirty, F.char(F.lit(0)), F.lit("�")).alias("props"))


@query("n27_token_usage", "WITH u AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k AS prompt, CASE WHEN event_id % 3 = 0 THEN 2 * k ELSE 0 END AS completion, k + CASE WHEN event_id % 3 = 0 THEN 2 * k ELSE 0 END AS total FROM u")
def n27(spark: SparkSession, d: str) -> DataFrame:
    """Usage under either naming; a missing total is the sum."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(k.alias("prompt_tokens"), (2 * k).alias("completion_tokens")))).otherwise(F.to_json(F.struct(k.alias("input_tokens"))))
    field = lambda *names: F.coalesce(*[F.get_json_object("usage", f"$.{n}").cast("bigint") for n in names], F.lit(0))
    u = read(spark, d, "events").select("event_id", raw.alias("usage"))
    u = u.select("event_id", field("prompt_tokens", "input_tokens").alias("prompt"), field("completion_tokens", "output_tokens").alias("completion"), F.get_json_object("usage", "$.total_tokens").cast("bigint").alias("given"))
    return u.select("event_id", "prompt", "completion", F.coalesce("given", F.col("prompt") + F.col("completion")).alias("total"))


@query("n28_geocode_text", sql("SELECT id, array_to_string([x FOR x IN [name, nullif(locality, 'BUILDING'), country_code] IF x IS NOT NULL], ', ') AS query, latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) AS usable FROM locations", "locations"))
def n28(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_distinct(F.array_compact(F.array("name", F.nullif("locality", F.lit("BUILDING")), "country_code")))
    return locations(spark, d).select("id", F.array_join(parts, ", ").alias("query"), geo.usable(F.col("latitude"), F.col("longitude")).alias("usable"))


@query("n30_source_pages", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/given/' || page_id WHEN regexp_matches(url, '^https?://[^/]*\\.example\\.org(/|$)') THEN regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) END AS source FROM pages")
def n30(spark: SparkSession, d: str) -> DataFrame:
    """A named source page, else the referrer's path and query where it is of the own origin."""
    own = F.col("url").rlike("^https?://[^/]*\\.example\\.org(/|$)")
    return read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/given/"), F.col("page_id"))).when(own, F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1)).alias("source"))


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"


@query("m2_kilometres", sql(", f AS (SELECT org_id, min_by(latitude, id) AS latitude, min_by(longitude, id) AS longitude FROM locations GROUP BY 1) SELECT b.id, CASE WHEN b.rating IS NOT NULL THEN round(" + _KM + ", 3) END AS km FROM locations b JOIN f a USING (org_id)", "locations"))
def m2(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the organization's first location; a null coordinate gives null."""
    l = locations(spark, d)
    f = l.groupBy("org_id").agg(F.min_by("latitude", "id").alias("lat1"), F.min_by("longitude", "id").alias("lon1"))
    lat = F.when(F.col("rating").isNotNull(), F.col("latitude"))
    return l.join(f, "org_id").select("id", F.round(geo.haversine(F.col("lat1"), F.col("lon1"), lat, F.col("longitude"), geo.KM), 3).alias("km"))


@query("m4_longitude_band", sql("SELECT id, least(abs(longitude + 179.9), 360 - abs(longitude + 179.9)) <= least(180.0, 2000000.0 / (111320.0 * greatest(abs(cos(radians(latitude))), 1e-6))) AS near FROM locations", "locations"))
def m4(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).select("id", geo.in_longitude_band(F.col("latitude"), F.lit(-179.9), F.col("longitude"), 2_000_000.0).alias("near"))


@query("m5_view_centres", sql(", v AS (SELECT country_code, max(longitude) AS west, min(longitude) AS east FROM locations GROUP BY 1), s AS (SELECT *, (east - west) - 360 * floor((east - west) / 360) AS span FROM v) SELECT country_code, round((west + span / 2 + 180) - 360 * floor((west + span / 2 + 180) / 360) - 180, 6) AS centre FROM s", "locations"))
def m5(spark: SparkSession, d: str) -> DataFrame:
    v = locations(spark, d).groupBy("country_code").agg(F.max("longitude").alias("west"), F.min("longitude").alias("east"))
    span = F.pmod(F.col("east") - F.col("west"), F.lit(360.0))
    return v.select("country_code", F.round(F.pmod(F.col("west") + span / 2 + 180, F.lit(360.0)) - 180, 6).alias("centre"))


@query("m7_percentages", sql("SELECT country_code, CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(rating) / count(*), 2) END AS rated FROM locations GROUP BY 1", "locations"))
def m7(spark: SparkSession, d: str) -> DataFrame:
    share = F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.count("rating") / F.count("*"), 2))
    return locations(spark, d).groupBy("country_code").agg(share.alias("rated"))


@query("t6_stale_claims", sql("SELECT id FROM tasks WHERE status = 'claimed' AND created_at < (SELECT max(created_at) FROM tasks) - INTERVAL 90 MINUTE", "tasks"))
def t6(spark: SparkSession, d: str) -> DataFrame:
    """Claims older than a cutoff before the last event: "now" is data here, so reruns agree."""
    t = tasks(spark, d)
    now = t.agg(F.max("created_at").alias("now"))  # one row
    return t.where("status = 'claimed'").join(F.broadcast(now)).where(F.col("created_at") < F.expr("now - INTERVAL 90 MINUTE")).select("id")


@query("r3_term_arrays", sql("SELECT id, array_to_string([lower(trim(x)) FOR x IN string_split(name || ', ' || category || ',' || brand, ',')], '|') AS terms FROM treatments", "treatments"))
def r3(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a JSON array, each normalised in its row."""
    raw = F.to_json(F.array(F.col("name"), F.concat(F.lit(" "), "category"), F.col("brand")))
    terms = F.transform(F.from_json(raw, "array<string>"), lambda x: F.lower(F.trim(x)))
    return treatments(spark, d).select("id", F.array_join(terms, "|").alias("terms"))


@query("j5_substring_join", sql(", p AS (SELECT DISTINCT lower(substr(name, 1, 4)) AS term FROM treatments) SELECT t.id, p.term FROM treatments t JOIN p ON contains(lower(t.name), p.term)", "treatments"))
def j5_substring(spark: SparkSession, d: str) -> DataFrame:
    """Names that contain a term: candidates share the term's first trigram, an equi-join of distinct names; then the terms are looked for.

    What is exploded is never broadcast: its size is not known before.
    """
    t = treatments(spark, d).select("id", F.lower("name").alias("name"))
    names = t.select("name").distinct()
    terms = names.select(F.substring("name", 1, 4).alias("term")).distinct().withColumn("gram", F.substring("term", 1, 3))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1))), lambda i: F.substring("name", i, F.lit(3))))
    held = names.withColumn("gram", F.explode(grams)).hint("merge").join(terms, "gram").where(F.col("name").contains(F.col("term"))).select("name", "term")
    return t.hint("merge").join(held, "name").select("id", "term")
