"""Catalog analytics: joins, counts, facets, price summaries, city index, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightfield.functions.text import blank_to_null
from brightfield.plans.search import descendants
from brightfield.registry import query
from brightfield.roles import active, locations, offerings, organizations, read, reviews, sql, supplied, treatments

# ---- joins ----


@query("j1_supply_join", sql("SELECT o.id, l.name, t.name AS treatment FROM offerings o JOIN locations l ON l.id = o.location_id JOIN treatments t ON t.id = o.treatment_id WHERE l.status = 'active' AND l.region = 1", "offerings", "locations", "treatments"))
def j1(spark: SparkSession, d: str) -> DataFrame:
    l = active(locations(spark, d)).where("region = 1").select(F.col("id").alias("location_id"), "name")
    t = treatments(spark, d).select(F.col("id").alias("treatment_id"), F.col("name").alias("treatment"))
    return offerings(spark, d).select("id", "location_id", "treatment_id").join(l, "location_id").join(t, "treatment_id").select("id", "name", "treatment")


@query("j2_left_join_extra", sql("SELECT l.id, g.canonical_name FROM locations l LEFT JOIN organizations g ON g.org_id = l.org_id AND g.nation < 12", "locations", "organizations"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).join(organizations(spark, d).where("nation < 12"), "org_id", "left").select("id", "canonical_name")


@query("j4_normalised_join", sql(", s AS (SELECT DISTINCT upper(' ' || n_name || ' ') AS city, n_nationkey AS code FROM nation) SELECT l.id, s.code FROM locations l JOIN s ON lower(trim(s.city)) = lower(trim(l.country_code))", "locations"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "nation").select(F.lower(F.trim(F.upper(F.concat(F.lit(" "), "n_name", F.lit(" "))))).alias("key"), F.col("n_nationkey").alias("code")).distinct()
    return locations(spark, d).select("id", F.lower(F.trim("country_code")).alias("key")).join(s, "key").select("id", "code")


_TERMS = [("brass", 1), ("tin", 2), ("promo", 3), ("steel", 4), ("copper", 5)]
_TERM_SQL = ", p(term, rank) AS (VALUES " + ", ".join(f"('{t}', {r})" for t, r in _TERMS) + ")"


@query("c5_preferred_terms", sql(_TERM_SQL + " SELECT t.id, p.rank FROM treatments t JOIN p ON t.category ILIKE '%' || p.term || '%'", "treatments"))
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Five literal terms: unrolled into the projection, so there is no join at all."""
    hits = F.filter(F.array(*[F.when(F.col("category").ilike(f"%{t}%"), F.lit(r)) for t, r in _TERMS]), lambda x: x.isNotNull())
    return treatments(spark, d).select("id", F.explode(hits).alias("rank"))


_RULES = [("^small", "Brand#11", 7, 10), ("ring$", None, 8, 20), ("r$", "Brand#12", 9, 30), ("^red", None, 6, 20)]
_RULE_SQL = ", rules(pattern, scope, target, priority) AS (VALUES " + ", ".join(f"('{p}', {repr(s) if s else 'NULL'}, {t}, {k})" for p, s, t, k in _RULES) + "), hit AS (SELECT id, target, priority FROM treatments JOIN rules ON regexp_matches(name, pattern) AND (scope IS NULL OR scope = brand))"


def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """Treatments with the rules whose pattern fits their name, in scope: a short list of literal rules, evaluated in place."""
    hit = [F.when(F.col("name").rlike(p) & (F.lit(True) if s is None else F.col("brand") == s), F.struct(F.lit(t).alias("target"), F.lit(k).alias("priority"))) for p, s, t, k in _RULES]
    return treatments(spark, d).select("id", F.inline(F.array_compact(F.array(*hit))))


@query("j6_regex_rules", sql(_RULE_SQL + " SELECT * FROM hit", "treatments"))
def j6(spark: SparkSession, d: str) -> DataFrame:
    return rule_hits(spark, d)


@query("a38_single_winner", sql(_RULE_SQL + ", top AS (SELECT id, max(priority) AS priority FROM hit GROUP BY id) SELECT id, min(target) AS target FROM hit JOIN top USING (id, priority) GROUP BY id HAVING count(DISTINCT target) = 1", "treatments"))
def a38(spark: SparkSession, d: str) -> DataFrame:
    hit = rule_hits(spark, d)
    best = hit.withColumn("top", F.max("priority").over(Window.partitionBy("id"))).where("priority = top")
    return best.groupBy("id").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n")).where("n = 1").select("id", "target")


@query("j7_semi_join", sql("SELECT id FROM locations l WHERE EXISTS (SELECT 1 FROM offerings o WHERE o.location_id = l.id AND price_unit = 'package')", "locations", "offerings"))
def j7(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).join(offerings(spark, d).where("price_unit = 'package'").select(F.col("location_id").alias("id")), "id", "left_semi").select("id")


@query("j8_anti_join", sql("SELECT id FROM locations l WHERE NOT EXISTS (SELECT 1 FROM offerings o WHERE o.location_id = l.id AND price_unit = 'package' AND price_currency = 'R')", "locations", "offerings"))
def j8(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).where("price_unit = 'package' AND price_currency = 'R'").select(F.col("location_id").alias("id"))
    return locations(spark, d).join(o, "id", "left_anti").select("id")


@query("j9_either_exists", sql("SELECT id FROM locations l WHERE EXISTS (SELECT 1 FROM offerings o WHERE o.location_id = l.id AND treatment_id < 5) OR org_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)", "locations", "offerings"))
def j9(spark: SparkSession, d: str) -> DataFrame:
    """Two key sets, united: no join on an OR."""
    l = locations(spark, d).select("id", "org_id")
    a = offerings(spark, d).where("treatment_id < 5").select(F.col("location_id").alias("id"))
    b = l.join(read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("org_id")), "org_id", "left_semi").select("id")
    return l.join(a.unionByName(b), "id", "left_semi").select("id")


@query("j10_lateral_summary", sql(", o AS (SELECT location_id AS id, count(*) AS n, array_to_string(list_sort(list_distinct(list(price_unit))), ',') AS units FROM offerings GROUP BY 1) SELECT l.id, coalesce(n, 0) AS n, coalesce(units, '') AS units FROM locations l LEFT JOIN o USING (id)", "locations", "offerings"))
def j10(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).groupBy(F.col("location_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("price_unit")), ",").alias("units"))
    return locations(spark, d).select("id").join(o, "id", "left").fillna({"n": 0, "units": ""})


@query("j11_latest_row", sql("SELECT location_id, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY updated_at DESC, id DESC) AS turn FROM offerings) WHERE turn = 1", "offerings"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    best = offerings(spark, d).groupBy("location_id").agg(F.max(F.struct("updated_at", "id")).alias("x"))
    return best.select("location_id", "x.id", "x.updated_at")


@query("j16_densify", sql(", w AS (SELECT unnest(range(1, 8)) AS day), o AS (SELECT location_id, isodow(updated_at) AS day, count(*) AS n FROM offerings GROUP BY ALL) SELECT l.id, w.day, coalesce(o.n, 0) AS n FROM locations l CROSS JOIN w LEFT JOIN o ON o.location_id = l.id AND o.day = w.day WHERE l.region = 0", "locations", "offerings"))
def j16(spark: SparkSession, d: str) -> DataFrame:
    """Seven days for every location, by a generator instead of a cross join."""
    o = offerings(spark, d).groupBy(F.col("location_id").alias("id"), (F.weekday("updated_at") + 1).cast("bigint").alias("day")).agg(F.count("*").alias("n"))
    week = locations(spark, d).where("region = 0").select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))).alias("day"))
    return week.join(o, ["id", "day"], "left").fillna(0, ["n"])


@query("j18_place_membership", sql(", m(locality, region) AS (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('FURNITURE', 2)) SELECT l.id FROM locations l JOIN m USING (locality, region)", "locations"))
def j18(spark: SparkSession, d: str) -> DataFrame:
    places = [("BUILDING", 1), ("MACHINERY", 2), ("FURNITURE", 2)]
    keys = F.array(*[F.struct(F.lit(a).alias("locality"), F.lit(b).alias("region")) for a, b in places])
    return locations(spark, d).where(F.array_contains(keys, F.struct("locality", "region"))).select("id")


@query("j19_using", sql(", a AS (SELECT id FROM locations WHERE rating >= 3), b AS (SELECT DISTINCT location_id AS id FROM offerings WHERE price_unit = 'visit') SELECT id FROM a JOIN b USING (id)", "locations", "offerings"))
def j19(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).where("rating >= 3").select("id").join(offerings(spark, d).where("price_unit = 'visit'").select(F.col("location_id").alias("id")).distinct(), "id")


@query("j21_cheapest", sql("SELECT location_id, min(price_amount) AS price, min_by(price_currency, struct_pack(a := price_amount, b := id)) AS currency FROM offerings WHERE price_amount IS NOT NULL GROUP BY 1", "offerings"))
def j21(spark: SparkSession, d: str) -> DataFrame:
    return offerings(spark, d).where("price_amount IS NOT NULL").groupBy("location_id").agg(F.min("price_amount").alias("price"), F.min_by("price_currency", F.struct("price_amount", "id")).alias("currency"))


# ---- aggregates ----


@query("a1_counters", sql("SELECT count(*) AS locations, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE is_virtual) AS virtual, count(rating) AS rated FROM locations", "locations"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).agg(F.count("*").alias("locations"), F.count_if(F.col("status") == "active").alias("active"), F.count_if("is_virtual").alias("virtual"), F.count("rating").alias("rated"))


@query("a2_count_distinct", sql("SELECT count(DISTINCT location_id) AS clinics, count(DISTINCT treatment_id) AS treatments FROM offerings", "offerings"))
def a2(spark: SparkSession, d: str) -> DataFrame:
    return offerings(spark, d).agg(F.count_distinct("location_id").alias("clinics"), F.count_distinct("treatment_id").alias("treatments"))


@query("a3_catalog", sql("SELECT t.id, t.name, count(DISTINCT l.id) AS n FROM treatments t LEFT JOIN offerings o ON o.treatment_id = t.id LEFT JOIN locations l ON l.id = o.location_id WHERE coalesce(l.is_virtual, false) = false GROUP BY t.id, t.name HAVING count(DISTINCT l.id) >= 25", "treatments", "offerings", "locations"))
def a3(spark: SparkSession, d: str) -> DataFrame:
    """The left joins of a treatment without supply, or of supply without a place, count no places, fewer than 25: inner joins suffice."""
    l = locations(spark, d).where(~F.coalesce("is_virtual", F.lit(False))).select(F.col("id").alias("location_id"))
    n = supplied(spark, d, l).groupBy(F.col("treatment_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 25")
    return treatments(spark, d).select("id", "name").distinct().join(n, "id").select("id", "name", "n")


@query("a4_eligible_cities", sql("SELECT count(*) AS cities FROM (SELECT DISTINCT country_code, locality FROM locations WHERE status = 'active')", "locations"))
def a4(spark: SparkSession, d: str) -> DataFrame:
    return active(locations(spark, d)).select("country_code", "locality").distinct().agg(F.count("*").alias("cities"))


@query("a5_summary", sql("SELECT count(*) AS total, count(DISTINCT locality) AS localities, count(DISTINCT country_code) AS countries FROM locations WHERE status = 'active'", "locations"))
def a5(spark: SparkSession, d: str) -> DataFrame:
    return active(locations(spark, d)).agg(F.count("*").alias("total"), F.count_distinct("locality").alias("localities"), F.count_distinct("country_code").alias("countries"))


@query("a6_top_localities", sql("SELECT country_code, locality, max(region) AS region, count(*) AS n FROM locations GROUP BY 1, 2 ORDER BY n DESC, country_code, locality LIMIT 12", "locations"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).groupBy("country_code", "locality").agg(F.max("region").alias("region"), F.count("*").alias("n")).orderBy(F.desc("n"), "country_code", "locality").limit(12)


def price_summary(offers: DataFrame, currency: Column) -> DataFrame:
    """By currency: least and greatest price, offerings, locations."""
    priced = offers.where(F.col("price_amount") > 0)
    return priced.groupBy(currency.alias("currency")).agg(F.min("price_amount").alias("minimum"), F.max("price_amount").alias("maximum"), F.count("*").alias("offerings"), F.count_distinct("location_id").alias("locations"))


_SUMMARY = "SELECT {c} AS currency, min(price_amount) AS minimum, max(price_amount) AS maximum, count(*) AS offerings, count(DISTINCT location_id) AS locations FROM offerings WHERE price_amount > 0 GROUP BY 1"


@query("a7_price_summary", sql(_SUMMARY.format(c="nullif(trim(price_currency), '')"), "offerings"))
def a7(spark: SparkSession, d: str) -> DataFrame:
    return price_summary(offerings(spark, d), blank_to_null(F.col("price_currency")))


@query("a8_search_price_summary", sql(", closure(root, id) AS (SELECT id, id FROM treatments WHERE id = 3 UNION SELECT c.root, t.id FROM closure c JOIN treatments t ON t.parent_id = c.id) " + _SUMMARY.format(c="upper(nullif(trim(price_currency), ''))").replace("> 0", "> 0 AND treatment_id IN (SELECT id FROM closure)"), "offerings", "treatments", recursive=True))
def a8(spark: SparkSession, d: str) -> DataFrame:
    """Prices of what a search for a category finds: its whole tree."""
    wanted = descendants(treatments(spark, d).select("id", "parent_id"), spark.range(3, 4)).select(F.col("id").alias("treatment_id"))
    return price_summary(offerings(spark, d).join(wanted, "treatment_id", "left_semi"), F.upper(blank_to_null(F.col("price_currency"))))


_CITY = """SELECT lower(trim(locality)) AS city_key, country_code, count(*) AS listing_count, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude,
  round(count(*) FILTER (WHERE rating IS NOT NULL) / count(*), 6) AS coverage, min(r.region) AS region FROM locations l
  LEFT JOIN (SELECT lower(trim(locality)) AS k, country_code AS c, min(rating) AS region FROM (SELECT *, count(*) OVER (PARTITION BY lower(trim(locality)), country_code, rating) AS n FROM locations WHERE rating IS NOT NULL AND status = 'active') x
    WHERE n = (SELECT max(n) FROM (SELECT locality, country_code, rating, count(*) AS n FROM locations WHERE rating IS NOT NULL AND status = 'active' GROUP BY ALL) y WHERE lower(trim(y.locality)) = lower(trim(x.locality)) AND y.country_code = x.country_code) GROUP BY 1, 2) r ON r.k = lower(trim(locality)) AND r.c = country_code
  WHERE status = 'active' GROUP BY 1, 2"""


@query("a12_a13_city_index", sql(_CITY, "locations"))
def city_index(spark: SparkSession, d: str) -> DataFrame:
    """The derived city table: centroid, rated share, and the most frequent rating (the smallest among ties)."""
    l = active(locations(spark, d))
    return l.groupBy(F.lower(F.trim("locality")).alias("city_key"), "country_code").agg(
        F.count("*").alias("listing_count"), F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"),
        F.round(F.count("rating") / F.count("*"), 6).alias("coverage"), F.mode("rating", True).alias("region"),
    )


@query("e20_city_lookup", sql(f", c AS ({_CITY}) SELECT * FROM c WHERE city_key = 'building' AND country_code IN ('NATION_3', 'NATION_7', 'NATION_12')", "locations"))
def e20(spark: SparkSession, d: str) -> DataFrame:
    return city_index(spark, d).where("city_key = 'building' AND country_code IN ('NATION_3', 'NATION_7', 'NATION_12')")


@query("a14_sources", sql("SELECT location_id, array_to_string(list_sort(list_distinct(list(CAST(source_id AS VARCHAR)))), ',') AS sources FROM offerings GROUP BY 1", "offerings"))
def a14(spark: SparkSession, d: str) -> DataFrame:
    return offerings(spark, d).groupBy("location_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("source_id").cast("string"))), ",").alias("sources"))


@query("a15_first_ids", sql("SELECT treatment_id, array_to_string(list_sort(list_distinct(list(location_id)))[1:8], ',') AS ids FROM offerings GROUP BY 1", "offerings"))
def a15(spark: SparkSession, d: str) -> DataFrame:
    ids = F.slice(F.sort_array(F.collect_set("location_id")), 1, 8)
    return offerings(spark, d).groupBy("treatment_id").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("a16_shortest_name", sql("SELECT category, arg_min(name, struct_pack(a := length(name), b := name)) AS name FROM treatments GROUP BY 1", "treatments"))
def a16(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).groupBy("category").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))


@query("a17_search_document", sql("SELECT l.id, l.name || ' ' || coalesce(string_agg(DISTINCT price_unit, ' ' ORDER BY price_unit), '') AS search_text FROM locations l LEFT JOIN offerings o ON o.location_id = l.id GROUP BY l.id, l.name", "locations", "offerings"))
def a17(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).groupBy(F.col("location_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("price_unit")), " ").alias("units"))
    return locations(spark, d).join(o, "id", "left").select("id", F.concat("name", F.lit(" "), F.coalesce("units", F.lit(""))).alias("search_text"))


@query("a18_nested_rows", sql("SELECT location_id, to_json(list(struct_pack(u := price_unit, n := n) ORDER BY price_unit)) AS units FROM (SELECT location_id, price_unit, count(*) AS n FROM offerings GROUP BY 1, 2) GROUP BY 1", "offerings"))
def a18(spark: SparkSession, d: str) -> DataFrame:
    n = offerings(spark, d).groupBy("location_id", "price_unit").agg(F.count("*").alias("n"))
    return n.groupBy("location_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("price_unit").alias("u"), "n")))).alias("units"))


@query("a19_counts_object", "SELECT user_id, to_json(map_from_entries(list(struct_pack(k := event_type, v := n) ORDER BY event_type))) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@query("a20_bool_or", sql("SELECT org_id, bool_or(is_virtual) AS any_virtual, bool_and(status = 'active') AS all_active FROM locations GROUP BY 1", "locations"))
def a20(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).groupBy("org_id").agg(F.bool_or("is_virtual").alias("any_virtual"), F.bool_and(F.col("status") == "active").alias("all_active"))


@query("a21_evidence_row", sql("SELECT (SELECT count(*) FROM locations WHERE status = 'active') AS active, (SELECT count(*) FROM offerings WHERE price_amount > 0) AS priced, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM pages WHERE html IS NOT NULL) AS pages", "locations", "offerings"))
def a21(spark: SparkSession, d: str) -> DataFrame:
    """Counters of several tables as one row: one row per table, united, then pivoted by sums."""
    rows = [
        active(locations(spark, d)).agg(F.count("*").alias("n")).withColumn("k", F.lit("active")),
        offerings(spark, d).where("price_amount > 0").agg(F.count("*").alias("n")).withColumn("k", F.lit("priced")),
        reviews(spark, d).agg(F.count_distinct("author").alias("n")).withColumn("k", F.lit("sources")),
        read(spark, d, "pages").where("html IS NOT NULL").agg(F.count("*").alias("n")).withColumn("k", F.lit("pages")),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("active", "priced", "sources", "pages")])


@query("a22_distinct_pairs", sql("SELECT country_code, count(DISTINCT (latitude, longitude)) AS spots FROM locations GROUP BY 1", "locations"))
def a22(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).groupBy("country_code").agg(F.count_distinct(F.struct("latitude", "longitude")).alias("spots"))


@query("a23_facets", sql(", c AS (SELECT 'country' AS facet, country_code AS value, count(*) AS n FROM locations GROUP BY 2), t AS (SELECT 'category' AS facet, category AS value, count(*) AS n FROM offerings o JOIN treatments t ON t.id = o.treatment_id GROUP BY 2), b AS (SELECT 'brand' AS facet, brand AS value, count(DISTINCT location_id) AS n FROM offerings o JOIN treatments t ON t.id = o.treatment_id GROUP BY 2) SELECT * FROM c UNION ALL SELECT * FROM t UNION ALL SELECT * FROM b", "locations", "offerings", "treatments"))
def a23(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).select(F.col("treatment_id").alias("id"), "location_id").join(treatments(spark, d).select("id", "category", "brand"), "id")
    c = locations(spark, d).groupBy(F.lit("country").alias("facet"), F.col("country_code").alias("value")).agg(F.count("*").alias("n"))
    t = o.groupBy(F.lit("category").alias("facet"), F.col("category").alias("value")).agg(F.count("*").alias("n"))
    b = o.groupBy(F.lit("brand").alias("facet"), F.col("brand").alias("value")).agg(F.count_distinct("location_id").alias("n"))
    return c.unionByName(t).unionByName(b)


@query("a24_country_rollup", sql(", i AS (SELECT country_code, locality, count(*) AS n FROM locations GROUP BY 1, 2) SELECT country_code, CAST(sum(n) AS BIGINT) AS listings FROM i GROUP BY 1 HAVING max(lower(country_code)) LIKE 'nation_1%' OR max(lower(country_code)) LIKE 'nation_7%'", "locations"))
def a24(spark: SparkSession, d: str) -> DataFrame:
    i = locations(spark, d).groupBy("country_code", "locality").agg(F.count("*").alias("n"))
    c = i.groupBy("country_code").agg(F.sum("n").alias("listings"), F.max(F.lower("country_code")).alias("name"))
    return c.where(F.col("name").like("nation_1%") | F.col("name").like("nation_7%")).select("country_code", "listings")


@query("a37_chain_cohorts", sql(", m AS (SELECT location_id AS id, count(*) AS menu FROM offerings GROUP BY 1), o AS (SELECT org_id, list_sort(list(coalesce(menu, 0))) AS c, count(DISTINCT country_code) AS places FROM locations LEFT JOIN m USING (id) GROUP BY 1) SELECT org_id, len(c) AS n, c[1] AS least, c[len(c) // 2 + 1] AS upper_median, c[len(c)] AS most FROM o WHERE places >= 2 AND c[len(c)] >= 4", "locations", "offerings"))
def a37(spark: SparkSession, d: str) -> DataFrame:
    m = offerings(spark, d).groupBy(F.col("location_id").alias("id")).agg(F.count("*").alias("menu"))
    o = locations(spark, d).join(m, "id", "left").fillna(0, ["menu"]).groupBy("org_id").agg(F.sort_array(F.collect_list("menu")).alias("c"), F.count_distinct("country_code").alias("places"))
    n = F.size("c")
    return o.where((F.col("places") >= 2) & (F.element_at("c", -1) >= 4)).select("org_id", n.cast("bigint").alias("n"), F.col("c")[0].alias("least"), F.element_at("c", F.floor(n / 2).cast("int") + 1).alias("upper_median"), F.element_at("c", -1).alias("most"))


@query("w15_peer_maximum", sql(", m AS (SELECT location_id AS id, count(*) AS menu FROM offerings GROUP BY 1), x AS (SELECT l.id, coalesce(menu, 0) AS menu, max(coalesce(menu, 0)) OVER (PARTITION BY org_id) AS peer FROM locations l LEFT JOIN m USING (id)) SELECT id, menu, peer FROM x WHERE peer >= 4 AND menu * 2 < peer", "locations", "offerings"))
def w15(spark: SparkSession, d: str) -> DataFrame:
    m = offerings(spark, d).groupBy(F.col("location_id").alias("id")).agg(F.count("*").alias("menu"))
    l = locations(spark, d).join(m, "id", "left").fillna(0, ["menu"]).withColumn("peer", F.max("menu").over(Window.partitionBy("org_id")))
    return l.where("peer >= 4 AND menu * 2 < peer").select("id", "menu", "peer")


@query("a39_unambiguous_terms", sql("SELECT lower(name) || ' ' || lower(brand) AS term, min(id) AS id FROM treatments GROUP BY 1 HAVING count(DISTINCT id) = 1", "treatments"))
def a39(spark: SparkSession, d: str) -> DataFrame:
    g = treatments(spark, d).groupBy(F.concat_ws(" ", F.lower("name"), F.lower("brand")).alias("term")).agg(F.collect_set("id").alias("ids"))
    return g.where(F.size("ids") == 1).select("term", F.col("ids")[0].alias("id"))


@query("a40_conflicts", sql("SELECT org_id, count(DISTINCT rating) AS kinds FROM locations GROUP BY 1 HAVING count(DISTINCT rating) > 3", "locations"))
def a40(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).groupBy("org_id").agg(F.count_distinct("rating").alias("kinds")).where("kinds > 3")


@query("a41_greatest", sql(", o AS (SELECT location_id AS id, count(*) AS n FROM offerings GROUP BY 1) SELECT l.id, greatest(coalesce(review_count, 0), coalesce(n, 0)) AS reviews FROM locations l LEFT JOIN o USING (id)", "locations", "offerings"))
def a41(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).groupBy(F.col("location_id").alias("id")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    return locations(spark, d).join(o, "id", "left").select("id", F.greatest(F.coalesce(F.col("review_count").cast("bigint"), zero), F.coalesce("n", zero)).alias("reviews"))


@query("a42_inferred_chains", sql("SELECT org_id, min(name) AS first_name, count(DISTINCT name) AS names, count(DISTINCT locality) AS localities FROM locations GROUP BY 1 HAVING count(DISTINCT name) > 1 AND count(DISTINCT locality) > 4", "locations"))
def a42(spark: SparkSession, d: str) -> DataFrame:
    g = locations(spark, d).groupBy("org_id").agg(F.min("name").alias("first_name"), F.count_distinct("name").alias("names"), F.count_distinct("locality").alias("localities"))
    return g.where("names > 1 AND localities > 4")


@query("a43_top_per_category", sql("SELECT category, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS turn FROM treatments) WHERE turn <= 4", "treatments"))
def a43(spark: SparkSession, d: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    return treatments(spark, d).withColumn("turn", turn).where("turn <= 4").select("category", "id")


@query("a44_hubs", sql(", s AS (SELECT treatment_id AS id, country_code AS city, count(DISTINCT l.id) AS n FROM offerings o JOIN locations l ON l.id = o.location_id GROUP BY 1, 2) SELECT t.id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, coalesce(string_agg(city || ':' || n, ',' ORDER BY city), '') AS cities FROM treatments t LEFT JOIN s USING (id) GROUP BY 1", "treatments", "offerings", "locations"))
def a44(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).select(F.col("id").alias("location_id"), F.col("country_code").alias("city"))
    s = supplied(spark, d, l).groupBy(F.col("treatment_id").alias("id"), "city").agg(F.count("*").alias("n"))
    h = s.groupBy("id").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("city", "n"))), lambda x: F.concat_ws(":", x["city"], x["n"].cast("string"))), ",").alias("cities"))
    return treatments(spark, d).select("id").join(h, "id", "left").fillna({"total": 0, "cities": ""})


@query("a46_popular", sql("SELECT category, count(*) AS n FROM offerings o JOIN treatments t ON t.id = o.treatment_id WHERE category NOT IN ('ECONOMY TIN', 'PROMO BRASS') GROUP BY 1 ORDER BY n DESC, category LIMIT 12", "offerings", "treatments"))
def a46(spark: SparkSession, d: str) -> DataFrame:
    t = treatments(spark, d).where(~F.col("category").isin("ECONOMY TIN", "PROMO BRASS")).select(F.col("id").alias("treatment_id"), "category")
    return offerings(spark, d).join(t, "treatment_id").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(12)


@query("a47_starting_price", sql("SELECT location_id, coalesce(min(price_amount) FILTER (WHERE price_currency = 'N'), min(price_amount)) AS price FROM offerings GROUP BY 1", "offerings"))
def a47(spark: SparkSession, d: str) -> DataFrame:
    return offerings(spark, d).groupBy("location_id").agg(F.coalesce(F.min(F.when(F.col("price_currency") == "N", F.col("price_amount"))), F.min("price_amount")).alias("price"))


@query("e19_treatment_city_supply", sql("SELECT o.treatment_id, l.locality, l.country_code, count(DISTINCT l.id) AS n FROM offerings o JOIN locations l ON l.id = o.location_id WHERE l.status = 'active' AND NOT l.is_virtual GROUP BY 1, 2, 3 HAVING count(DISTINCT l.id) >= 2", "offerings", "locations"))
def e19(spark: SparkSession, d: str) -> DataFrame:
    l = active(locations(spark, d)).where("NOT is_virtual").select(F.col("id").alias("location_id"), "locality", "country_code")
    return supplied(spark, d, l).groupBy("treatment_id", "locality", "country_code").agg(F.count("*").alias("n")).where("n >= 2")
