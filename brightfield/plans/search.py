"""Directory search: filters, radius ladder, ranking, paging."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightfield.functions import geo, pricing
from brightfield.operators.components import written
from brightfield.registry import query
from brightfield.roles import active, dealt, locations, offerings, read, sql, treatments

PAGE_SIZE = 18
LADDER = (25, 50, 100)
ENOUGH = 5

_MILES = "2 * 3958.7613 * asin(least(1.0, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"


@dataclass
class SearchRequest:
    """Parameters of a directory search, checked: distinct treatment ids (25 at most), two-letter countries, bounded coordinates."""

    treatment_ids: tuple[int, ...] = ()
    country: str | None = None
    latitude: float | None = None
    longitude: float | None = None
    page: int = 0

    @classmethod
    def parse(cls, params: dict[str, str]) -> SearchRequest:
        ids = tuple(dict.fromkeys(int(x) for x in params.get("treatment_id", "").split(",") if x.strip().isdigit()))[:25]
        country = params.get("country", "").strip().upper()

        def number(name: str, most: float) -> float | None:
            try:
                value = float(params.get(name, ""))
            except ValueError:
                return None
            return value if abs(value) <= most else None

        page = params.get("page", "0")
        return cls(ids, country if re.fullmatch("[A-Z]{2}", country) else None, number("lat", 90), number("lng", 180), int(page) if page.isdigit() else 0)


def completeness(menu: Column, price: Column, details: Column) -> Column:
    return F.when(menu & price & details, 0).when(menu & ~price & details, 1).otherwise(2)


def country_points(spark: SparkSession, d: str) -> DataFrame:
    """A query point for each nation: where its cluster is based."""
    return read(spark, d, "nation").select(
        F.col("n_name").alias("city"), F.expr("CAST(-48 + 4 * n_nationkey AS DOUBLE)").alias("latitude"), F.expr("CAST(-168 + 14 * n_nationkey AS DOUBLE)").alias("longitude")
    )


def near_points(points: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """(city, id, distance) within a distance: an equi-join on grid cells of that size, then the exact filter."""
    km = miles * geo.KM / geo.MILES
    p = geo.around_cells(points.select("city", F.col("latitude").alias("plat"), F.col("longitude").alias("plon")), "plat", "plon", km)
    q = geo.in_cell(places, "latitude", "longitude", km)
    distance = geo.haversine(F.col("plat"), F.col("plon"), F.col("latitude"), F.col("longitude"))
    return p.join(q, ["row", "col"]).drop("row", "col").withColumn("distance_miles", distance).where(F.col("distance_miles") <= miles)


def radius_ladder(points: DataFrame, near: DataFrame, rungs: tuple[int, ...] = LADDER, enough: int = ENOUGH) -> DataFrame:
    """For each point the smallest radius with enough of the ``near`` places (city, distance_miles) in it, and the counts of all rungs;
    null where none has enough."""
    counts = [F.count_if(F.col("distance_miles") <= r).alias(f"within_{r}") for r in rungs]
    found = points.select("city").join(near.groupBy("city").agg(*counts), "city", "left").fillna(0, [f"within_{r}" for r in rungs])
    radius = F.coalesce(*[F.when(F.col(f"within_{r}") >= enough, F.lit(r)) for r in rungs])
    return found.withColumn("effective_radius", radius)


_LADDER_SQL = f""", points AS (SELECT n_name AS city, CAST(-48 + 4 * n_nationkey AS DOUBLE) AS latitude, CAST(-168 + 14 * n_nationkey AS DOUBLE) AS longitude FROM nation),
near AS (SELECT p.city, l.*, {_MILES.format(a="p", b="l")} AS distance_miles FROM points p JOIN locations l ON l.status = 'active' AND NOT l.is_virtual),
counts AS (SELECT p.city, count(*) FILTER (WHERE distance_miles <= 25) AS within_25, count(*) FILTER (WHERE distance_miles <= 50) AS within_50, count(*) FILTER (WHERE distance_miles <= 100) AS within_100
  FROM points p LEFT JOIN near USING (city) GROUP BY p.city),
ladder AS (SELECT *, CASE WHEN within_25 >= 5 THEN 25 WHEN within_50 >= 5 THEN 50 WHEN within_100 >= 5 THEN 100 END AS effective_radius FROM counts)"""


@query("a9_radius_bands", sql(_LADDER_SQL + " SELECT * FROM ladder", "locations"))
def a9_radius_bands(spark: SparkSession, d: str) -> DataFrame:
    points = country_points(spark, d)
    return radius_ladder(points, near_points(points, active(locations(spark, d)).where(~F.col("is_virtual")), LADDER[-1]))


@query(
    "e4_city_radius_search",
    sql(
        _LADDER_SQL
        + """, ranked AS (SELECT city, id, name, round(distance_miles, 6) AS distance_miles, effective_radius,
  row_number() OVER (PARTITION BY city ORDER BY rating IS NULL, round(distance_miles, 6), rating DESC NULLS LAST, review_count DESC NULLS LAST, name, id) AS place
  FROM near JOIN ladder USING (city) WHERE distance_miles <= effective_radius)
SELECT * FROM ranked WHERE place <= 18""",
        "locations",
    ),
)
def e4_city_radius_search(spark: SparkSession, d: str) -> DataFrame:
    """The first page around every city, at the smallest radius of the ladder with enough hits.

    Places near the cities are found once and written; the counts of the rungs and the pages read that.
    """
    places = active(locations(spark, d)).where(~F.col("is_virtual")).select("id", "name", "latitude", "longitude", "rating", "review_count")
    points = country_points(spark, d)
    found = written(near_points(points, places, LADDER[-1]).select("city", "id", "name", "rating", "review_count", "distance_miles"), "near")
    ladder = radius_ladder(points, found).where("effective_radius IS NOT NULL").select("city", "effective_radius")
    near = found.join(ladder, "city").where(F.col("distance_miles") <= F.col("effective_radius"))
    near = near.withColumn("distance_miles", F.round("distance_miles", 6))
    order = Window.partitionBy("city").orderBy(F.col("rating").isNull(), "distance_miles", F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), "name", "id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PAGE_SIZE).select("city", "id", "name", "distance_miles", "effective_radius", "place")


@query("p1_active_locations", sql("SELECT id, name, country_code FROM locations WHERE status = 'active'", "locations"))
def p1_active(spark: SparkSession, d: str) -> DataFrame:
    return active(locations(spark, d)).select("id", "name", "country_code")


def unsuppressed(offers: DataFrame, labels: DataFrame) -> DataFrame:
    """Offerings without an active suppression."""
    return offers.join(labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("location_id")).distinct(), "location_id", "left_anti")


@query("p2_active_offerings", sql("SELECT id, location_id FROM offerings o WHERE NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND doc_id = o.location_id)", "offerings"))
def p2_active_offerings(spark: SparkSession, d: str) -> DataFrame:
    return unsuppressed(offerings(spark, d), read(spark, d, "labels")).select("id", "location_id")


_COMPARABLE = "price_amount > 0 AND coalesce(nullif(trim(price_unit), ''), 'service') IN ({units}) AND coalesce(nullif(trim(price_audience), ''), 'retail') = 'retail'"


def _prices(units: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = offerings(spark, d)
        return o.where(pricing.comparable(o["price_amount"], o["price_unit"], o["price_audience"], units)).select("id", "price_amount")

    return run


_UNITS = "'service', 'session', 'visit'"
query("p3_comparable_prices", sql("SELECT id, price_amount FROM offerings WHERE " + _COMPARABLE.format(units=_UNITS), "offerings"))(_prices(pricing.COMPARABLE_UNITS))
query("p4_card_prices", sql("SELECT id, price_amount FROM offerings WHERE " + _COMPARABLE.format(units=_UNITS + ", 'package'"), "offerings"))(_prices((*pricing.COMPARABLE_UNITS, "package")))


@query("p5_name_contains", sql("SELECT id, name FROM locations WHERE name ILIKE '%00001%' OR lower(country_code) LIKE 'fr%' OR lower(locality) = lower('building')", "locations"))
def p5_text_match(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    return l.where(F.col("name").ilike("%00001%") | F.lower("country_code").like("fr%") | (F.lower("locality") == "building")).select("id", "name")


@query("p6_city_prefix", sql(", c AS (SELECT country_code AS city, count(*) AS listing_count FROM locations WHERE status = 'active' GROUP BY 1) SELECT * FROM c WHERE lower(city) LIKE 'c%' OR lower(city) LIKE 'n%' ORDER BY listing_count DESC, city LIMIT 8", "locations"))
def p6_city_prefix(spark: SparkSession, d: str) -> DataFrame:
    c = active(locations(spark, d)).groupBy(F.col("country_code").alias("city")).agg(F.count("*").alias("listing_count"))
    return c.where(F.lower("city").like("c%") | F.lower("city").like("n%")).orderBy(F.desc("listing_count"), "city").limit(8)


@query("p7_tag_facets", sql("SELECT id, brand FROM treatments WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')", "treatments"))
def p7_tags(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).where(F.col("brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")).select("id", "brand")


def entity_lookup(places: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """By id where the key is a number, else by slug or by a slug's alias."""
    if key.isdigit():
        return places.where(F.col("id") == int(key))
    by_alias = aliases.where(F.col("alias") == key).select(F.col("location_id").alias("id"))
    return places.where(F.col("slug") == key).unionByName(places.join(by_alias, "id", "left_semi")).distinct()


_SLUGGED = ", s AS (SELECT id, name, lower(replace(name, '#', '-')) AS slug FROM locations), a AS (SELECT id AS location_id, 'old-' || id AS alias FROM locations WHERE id % 10 = 0)"


@query("p8_entity_lookup", sql(_SLUGGED + " SELECT 'id' AS kind, * FROM s WHERE id = 7 UNION ALL SELECT 'slug', * FROM s WHERE slug = 'customer-000000011' UNION ALL SELECT 'alias', s.* FROM s JOIN a ON a.location_id = s.id WHERE alias = 'old-20'", "locations"))
def p8_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = locations(spark, d).select("id", "name", F.lower(F.replace("name", F.lit("#"), F.lit("-"))).alias("slug"))
    a = s.where(F.col("id") % 10 == 0).select(F.col("id").alias("location_id"), F.concat(F.lit("old-"), "id").alias("alias"))
    found = [entity_lookup(s, a, key).select(F.lit(kind).alias("kind"), "*") for kind, key in (("id", "7"), ("slug", "customer-000000011"), ("alias", "old-20"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "p9_filtered_locations",
    sql("SELECT id, name FROM locations l WHERE status = 'active' AND region = 2 AND locality = 'BUILDING' AND EXISTS (SELECT 1 FROM offerings o WHERE o.location_id = l.id AND treatment_id % 7 = 1) AND EXISTS (SELECT 1 FROM offerings o WHERE o.location_id = l.id AND treatment_id % 7 = 2)", "locations", "offerings"),
)
def p9_filters(spark: SparkSession, d: str) -> DataFrame:
    """One semi-join for each wanted treatment: a location has to offer all."""
    l, o = active(locations(spark, d)).where((F.col("region") == 2) & (F.col("locality") == "BUILDING")), offerings(spark, d)
    for k in (1, 2):
        l = l.join(o.where(F.col("treatment_id") % 7 == k).select(F.col("location_id").alias("id")), "id", "left_semi")
    return l.select("id", "name")


def closure(tree: DataFrame) -> DataFrame:
    """(root, id) for every node and each of its descendants, itself included, whatever the depth.

    Every round joins the pairs that the round before found with all pairs, on both sides, which doubles the depth; what is new is
    written to the shared folder, and nothing is written again. A round that finds nothing is the last, so cycles end too.
    """
    own = tree.select(F.col("id").alias("root"), "id").distinct()
    found = fresh = written(tree.where("parent_id IS NOT NULL AND parent_id <> id").select(F.col("parent_id").alias("root"), "id").distinct(), "closure")
    join = lambda above, below: above.join(below.select(F.col("root").alias("id"), F.col("id").alias("below")), "id").select("root", F.col("below").alias("id"))
    while not fresh.isEmpty():
        further = join(fresh, found).unionByName(join(found, fresh)).where("root <> id").distinct()
        fresh = written(further.join(found, ["root", "id"], "left_anti"), "closure")
        found = found.unionByName(fresh)
    return own.unionByName(found)


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct ids of some roots (id) and of all below them: the children of what was new last, round after round."""
    steps = tree.where("parent_id IS NOT NULL").select("parent_id", "id")
    found = fresh = written(roots.select("id").distinct(), "descendants")
    while not fresh.isEmpty():
        children = steps.join(fresh.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
        fresh = written(children.join(found, "id", "left_anti"), "descendants")
        found = found.unionByName(fresh)
    return found


_CLOSURE = ", closure(root, id) AS (SELECT id, id FROM treatments UNION SELECT c.root, t.id FROM closure c JOIN treatments t ON t.parent_id = c.id)"


@query("a10_descendants", sql(_CLOSURE + " SELECT root, id FROM closure", "treatments", recursive=True))
def a10_descendants(spark: SparkSession, d: str) -> DataFrame:
    return closure(treatments(spark, d).select("id", "parent_id"))


@query("a11_supply_by_root", sql(_CLOSURE + " SELECT root, count(DISTINCT location_id) AS locations, count(*) AS offerings FROM closure JOIN offerings ON treatment_id = closure.id GROUP BY root", "treatments", "offerings", recursive=True))
def a11_supply(spark: SparkSession, d: str) -> DataFrame:
    """Offerings of a treatment and place are counted before they meet the tree; every step's tasks are dealt out by its rows."""
    tree, o = treatments(spark, d).select("id", "parent_id"), offerings(spark, d).select("treatment_id", "location_id")
    pairs = closure(tree).withColumnRenamed("id", "treatment_id")
    rows = read(spark, d, "lineitem").count()
    counts = dealt(o, rows, "treatment_id", "location_id").groupBy("treatment_id", "location_id").agg(F.count("*").alias("n"))
    spread = rows * pairs.count() // max(1, tree.count())  # as many roots for an offering as for a treatment, on the average
    per_place = dealt(pairs.join(counts, "treatment_id").select("root", "location_id", "n"), spread, "root", "location_id").groupBy("root", "location_id").agg(F.sum("n").alias("n"))
    return per_place.groupBy("root").agg(F.count("*").alias("locations"), F.sum("n").alias("offerings"))


@query("p10_category_tree", sql(_CLOSURE + " SELECT id, location_id FROM offerings WHERE treatment_id IN (SELECT id FROM closure WHERE root = 3)", "treatments", "offerings", recursive=True))
def p10_tree(spark: SparkSession, d: str) -> DataFrame:
    wanted = descendants(treatments(spark, d).select("id", "parent_id"), spark.range(3, 4)).select(F.col("id").alias("treatment_id"))
    return offerings(spark, d).join(wanted, "treatment_id", "left_semi").select("id", "location_id")


_BOX = geo.radius_box(-8.0, -28.0, 100)


@query("p11_radius_box", sql(f"SELECT id FROM locations WHERE latitude BETWEEN {_BOX[0]} AND {_BOX[1]} AND longitude BETWEEN {_BOX[2]} AND {_BOX[3]}", "locations"))
def p11_box(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    return l.where(geo.in_box(l["latitude"], l["longitude"], *_BOX)).select("id")


@query("p12_viewport", sql("SELECT id FROM locations WHERE latitude BETWEEN -50 AND 60 AND (longitude >= 150 OR longitude <= -150)", "locations"))
def p12_viewport(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    return l.where(geo.in_box(l["latitude"], l["longitude"], -50, 60, 150, -150)).select("id")


@query("p13_null_safe", sql("SELECT id FROM locations WHERE rating IS DISTINCT FROM 2", "locations"))
def p13_null_safe(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).where(~F.col("rating").eqNullSafe(2)).select("id")


@query("p14_row_null_safe", sql("SELECT id FROM locations WHERE (rating, review_count) IS DISTINCT FROM (region, CAST(id % 40 AS INT))", "locations"))
def p14_row_null_safe(spark: SparkSession, d: str) -> DataFrame:
    same = F.col("rating").eqNullSafe(F.col("region")) & F.col("review_count").eqNullSafe((F.col("id") % 40).cast("int"))
    return locations(spark, d).where(~same).select("id")


@query("p15_ilike_any", sql("SELECT id, category FROM treatments WHERE category ILIKE '%brass%' OR category ILIKE 'promo%' OR category ILIKE '%tin'", "treatments"))
def p15_ilike_any(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).where(F.expr("category ILIKE ANY ('%brass%', 'promo%', '%tin')")).select("id", "category")


@query("p16_regex", sql("SELECT id, name FROM treatments WHERE regexp_matches(name, '^(red|hot) .*r$')", "treatments"))
def p16_regex(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).where(F.col("name").rlike("^(red|hot) .*r$")).select("id", "name")


@query("p17_id_list", sql("SELECT id, status FROM locations WHERE id IN (1, 5, 8, 34, 55)", "locations"))
def p17_ids(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).where(F.col("id").isin(1, 5, 8, 34, 55)).select("id", "status")


@query("p18_json_predicate", sql("SELECT id FROM tasks WHERE CAST(json_extract_string(payload, '$.k') AS INT) BETWEEN 10 AND 20", "tasks"))
def p18_json(spark: SparkSession, d: str) -> DataFrame:
    from brightfield.roles import tasks

    return tasks(spark, d).where(F.get_json_object("payload", "$.k").try_cast("int").between(10, 20)).select("id")


# The words that make a predicate a statement.
_FORBIDDEN = re.compile(
    r"\b(select|insert|update|delete|merge|copy|call|do|create|alter|drop|truncate|grant|revoke|execute|vacuum|analyze|refresh|set|reset|listen|notify|load)\b", re.I
)


def checked_predicate(text: str) -> Column:
    """A free predicate over columns: no statements, comments or calls but IN, ANY and ALL; text in quotes is not looked at."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if not bare.strip() or any(x in bare for x in (";", "--", "/*", "*/")) or _FORBIDDEN.search(bare):
        raise ValueError("the predicate is not allowed")
    for name in re.findall(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\(", bare):
        if name.lower() not in ("in", "any", "all", "and", "or", "not"):
            raise ValueError(f"calls are not allowed: {name}")
    return F.expr(text)


@query("p19_checked_predicate", sql("SELECT id FROM locations WHERE region IN (1, 3) AND (rating > 2 OR locality = 'it''s; DROP')", "locations"))
def p19_predicate(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).where(checked_predicate("region IN (1, 3) AND (rating > 2 OR locality = 'its; DROP')")).select("id")


@query("p20_hard_exclusion", sql("SELECT l.id, EXISTS (SELECT 1 FROM labels WHERE doc_id = l.id AND quality = 1) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l.org_id AND s_acctbal > 5000) AS excluded FROM locations l", "locations"))
def p20_exclusion(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct().withColumn("a", F.lit(True))
    b = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("org_id")).distinct().withColumn("b", F.lit(True))
    return locations(spark, d).join(a, "id", "left").join(b, "org_id", "left").select("id", (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("excluded"))


@query("p21_exclusion_reasons", sql("SELECT id, array_to_string([x FOR x IN [CASE WHEN status <> 'active' THEN 'inactive' END, CASE WHEN is_virtual THEN 'virtual' END, CASE WHEN rating IS NULL THEN 'unrated' END] IF x IS NOT NULL], ',') AS reasons FROM locations", "locations"))
def p21_reasons(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("status") != "active", F.lit("inactive")), F.when(F.col("is_virtual"), F.lit("virtual")), F.when(F.col("rating").isNull(), F.lit("unrated"))))
    return locations(spark, d).select("id", F.array_join(reasons, ",").alias("reasons"))


@query("p22_sitemap_eligible", sql("SELECT id FROM locations WHERE trim(name) <> '' AND (CAST(locality IS NOT NULL AS INT) + CAST(rating IS NOT NULL AS INT) + CAST(NOT is_virtual AS INT) + CAST(review_count > 5 AND review_count IS NOT NULL AS INT)) >= 3", "locations"))
def p22_sitemap(spark: SparkSession, d: str) -> DataFrame:
    signals = [F.col("locality").isNotNull(), F.col("rating").isNotNull(), ~F.col("is_virtual"), F.coalesce(F.col("review_count") > 5, F.lit(False))]
    return locations(spark, d).where((F.trim("name") != "") & (sum(s.cast("int") for s in signals) >= 3)).select("id")


_USABLE = "length({c}) BETWEEN 3 AND 40 AND lower({c}) NOT IN ('unknown', 'various', 'n/a') AND NOT regexp_matches(lower({c}), '[0-9,]|\\b(street|road|avenue|suite)\\b')"


@query("p23_usable_locality", "SELECT p_partkey AS id, p_type AS place FROM part WHERE " + _USABLE.format(c="p_type"))
def p23_locality(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("p_type")
    ok = F.length(c).between(3, 40) & ~F.lower(c).isin("unknown", "various", "n/a") & ~F.lower(c).rlike("[0-9,]|\\b(street|road|avenue|suite)\\b")
    return read(spark, d, "part").where(ok).select(F.col("p_partkey").alias("id"), c.alias("place"))


@query("p24_usable_city", "SELECT DISTINCT n_name AS city FROM nation WHERE trim(n_name) <> '' AND NOT regexp_matches(lower(n_name), ',|virtual|various|unknown')")
def p24_city(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("n_name")
    return read(spark, d, "nation").where((F.trim(c) != "") & ~F.lower(c).rlike(",|virtual|various|unknown")).select(c.alias("city")).distinct()


@query(
    "p26_current_verification",
    sql(
        """, v AS (SELECT s_suppkey AS org_id, n_regionkey AS jurisdiction, DATE '1998-01-01' + CAST(s_suppkey * 37 % 400 AS INT) AS next_review, CASE WHEN s_suppkey % 3 > 0 THEN DATE '1998-01-01' + CAST(s_suppkey * 53 % 300 AS INT) END AS expires FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT l.id FROM locations l JOIN v USING (org_id) WHERE next_review > DATE '1998-06-01' AND (expires IS NULL OR expires >= DATE '1998-06-01') AND region = jurisdiction AND EXISTS (SELECT 1 FROM labels WHERE doc_id = l.id AND quality = 1)""",
        "locations",
    ),
)
def p26_verified(spark: SparkSession, d: str) -> DataFrame:
    """Verified now: a review to come, not expired, in the place's own jurisdiction, and with a verified affiliation."""
    day, base = F.lit("1998-06-01").cast("date"), F.lit("1998-01-01").cast("date")
    home = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("jurisdiction"))
    v = read(spark, d, "supplier").join(home, "s_nationkey").select(F.col("s_suppkey").alias("org_id"), "jurisdiction", F.date_add(base, (F.col("s_suppkey") * 37 % 400).cast("int")).alias("next_review"), F.when(F.col("s_suppkey") % 3 > 0, F.date_add(base, (F.col("s_suppkey") * 53 % 300).cast("int"))).alias("expires"))
    good = v.where((F.col("next_review") > day) & (F.col("expires").isNull() | (F.col("expires") >= day))).select("org_id", F.col("jurisdiction").alias("region"))
    affiliated = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return locations(spark, d).join(good, ["org_id", "region"], "left_semi").join(affiliated, "id", "left_semi").select("id")


# ---- orders and pages ----

_FLAGS = """, menu AS (SELECT DISTINCT location_id FROM offerings), priced AS (SELECT DISTINCT location_id FROM offerings WHERE price_amount > 0 AND price_unit IN ('service', 'session', 'visit') AND price_audience = 'retail'),
flagged AS (SELECT l.*, m.location_id IS NOT NULL AS has_menu, p.location_id IS NOT NULL AS has_price, rating IS NOT NULL AND NOT is_virtual AS has_details FROM locations l LEFT JOIN menu m ON m.location_id = l.id LEFT JOIN priced p ON p.location_id = l.id),
tiered AS (SELECT *, CASE WHEN has_menu AND has_price AND has_details THEN 0 WHEN has_menu AND NOT has_price AND has_details THEN 1 ELSE 2 END AS tier FROM flagged)"""


def with_flags(spark: SparkSession, d: str) -> DataFrame:
    """Locations with has_menu, has_price, has_details and their completeness tier: one pass over the offerings."""
    o = offerings(spark, d)
    priced = pricing.comparable(o["price_amount"], o["price_unit"], o["price_audience"])
    by = o.groupBy(F.col("location_id").alias("id")).agg(F.lit(True).alias("has_menu"), F.bool_or(F.coalesce(priced, F.lit(False))).alias("has_price"))
    l = locations(spark, d).join(by, "id", "left").fillna(False, ["has_menu", "has_price"])
    l = l.withColumn("has_details", F.col("rating").isNotNull() & ~F.col("is_virtual"))
    return l.withColumn("tier", completeness(F.col("has_menu"), F.col("has_price"), F.col("has_details")))


@query("j3_location_flags", sql(_FLAGS + " SELECT id, has_menu, has_price, has_details FROM tiered", "locations", "offerings"))
def j3_flags(spark: SparkSession, d: str) -> DataFrame:
    return with_flags(spark, d).select("id", "has_menu", "has_price", "has_details")


@query("s4_completeness_tier", sql(_FLAGS + " SELECT id, tier FROM tiered", "locations", "offerings"))
def s4_tier(spark: SparkSession, d: str) -> DataFrame:
    return with_flags(spark, d).select("id", "tier")


@query("s1_nulls_last_page", sql("SELECT id, rating, review_count FROM locations ORDER BY rating IS NULL, rating DESC, review_count DESC, id LIMIT 18", "locations"))
def s1_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).orderBy(F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), "id").limit(PAGE_SIZE).select("id", "rating", "review_count")


@query("s3_third_page", sql("SELECT id, name FROM locations WHERE status = 'active' ORDER BY lower(name), id LIMIT 18 OFFSET 36", "locations"))
def s3_page(spark: SparkSession, d: str) -> DataFrame:
    return active(locations(spark, d)).orderBy(F.lower("name"), "id").offset(2 * PAGE_SIZE).limit(PAGE_SIZE).select("id", "name")


@query("s5_treatment_order", sql(_FLAGS + " SELECT id, tier FROM tiered WHERE status = 'active' ORDER BY rating IS NULL, rating DESC, review_count DESC, tier, id LIMIT 18", "locations", "offerings"))
def s5_order(spark: SparkSession, d: str) -> DataFrame:
    return active(with_flags(spark, d)).orderBy(F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), "tier", "id").limit(PAGE_SIZE).select("id", "tier")


_VISITOR = "CASE WHEN locality = 'BUILDING' AND country_code = 'FRANCE' THEN 0 WHEN country_code = 'FRANCE' THEN 1 WHEN region = 3 THEN 2 ELSE 3 END"


def visitor_rank(city: str, country: str, region: int) -> Column:
    here = F.col("country_code") == country
    return F.when((F.col("locality") == city) & here, 0).when(here, 1).when(F.col("region") == region, 2).otherwise(3)


@query("s6_location_aware_order", sql(_FLAGS + f" SELECT id, tier, {_VISITOR} AS proximity FROM tiered WHERE status = 'active' ORDER BY tier, proximity, review_count IS NULL, review_count DESC, rating DESC, name, id LIMIT 80", "locations", "offerings"))
def s6_order(spark: SparkSession, d: str) -> DataFrame:
    l = active(with_flags(spark, d)).withColumn("proximity", visitor_rank("BUILDING", "FRANCE", 3))
    return l.orderBy("tier", "proximity", F.desc_nulls_last("review_count"), F.desc_nulls_last("rating"), "name", "id").limit(80).select("id", "tier", "proximity")


@query("s9_visitor_rank", sql(f"SELECT id, {_VISITOR} AS rank FROM locations", "locations"))
def s9_rank(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).select("id", visitor_rank("BUILDING", "FRANCE", 3).alias("rank"))


@query("s13_nearest_first", sql(f""", top AS (SELECT country_code AS city, count(*) AS n, min(latitude) AS latitude, min(longitude) AS longitude FROM locations GROUP BY 1 ORDER BY n DESC, city LIMIT 8),
v AS (SELECT -8.0 AS latitude, -28.0 AS longitude), m AS (SELECT top.*, round({_MILES.format(a="v", b="top")}, 6) AS miles FROM top, v)
SELECT city, n, CASE WHEN city = (SELECT min_by(city, miles) FROM m) THEN 0 ELSE 1 END AS front FROM m""", "locations"))
def s13_nearest(spark: SparkSession, d: str) -> DataFrame:
    top = locations(spark, d).groupBy(F.col("country_code").alias("city")).agg(F.count("*").alias("n"), F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude")).orderBy(F.desc("n"), "city").limit(8)
    m = top.withColumn("miles", F.round(geo.haversine(F.lit(-8.0), F.lit(-28.0), F.col("latitude"), F.col("longitude")), 6))
    first = m.agg(F.min_by("city", "miles").alias("first"))  # one row
    return m.join(F.broadcast(first)).select("city", "n", F.when(F.col("city") == F.col("first"), 0).otherwise(1).alias("front"))


@query("s15_typeahead", sql(", u AS (SELECT treatment_id AS id, count(DISTINCT location_id) AS n FROM offerings GROUP BY 1) SELECT t.id, t.name, coalesce(n, 0) AS n FROM treatments t LEFT JOIN u USING (id) WHERE lower(t.name) LIKE '%re%' ORDER BY CASE WHEN lower(t.name) LIKE 're%' THEN 0 ELSE 1 END, coalesce(n, 0) DESC, t.name, t.id LIMIT 8", "treatments", "offerings"))
def s15_typeahead(spark: SparkSession, d: str) -> DataFrame:
    t = treatments(spark, d).where(F.lower("name").contains("re"))
    u = offerings(spark, d).join(t.select(F.col("id").alias("treatment_id")), "treatment_id", "left_semi").groupBy(F.col("treatment_id").alias("id")).agg(F.count_distinct("location_id").alias("n"))
    return t.join(u, "id", "left").fillna(0, ["n"]).orderBy(~F.lower("name").startswith("re"), F.desc("n"), "name", "id").limit(8).select("id", "name", "n")


@query("j20_siblings", sql(f"SELECT a.id, b.id AS sibling, round({_MILES.format(a='a', b='b')}, 6) AS miles FROM locations a JOIN locations b ON a.org_id = b.org_id AND a.id <> b.id WHERE a.status = 'active' AND b.status = 'active'", "locations"))
def j20_siblings(spark: SparkSession, d: str) -> DataFrame:
    l = active(locations(spark, d)).select("id", "org_id", "latitude", "longitude")
    r = l.select(F.col("id").alias("sibling"), "org_id", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    return l.join(r, "org_id").where(F.col("id") != F.col("sibling")).select("id", "sibling", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")), 6).alias("miles"))


@query("s10_branch_order", sql(f""", p AS (SELECT a.id, b.id AS sibling, round({_MILES.format(a='a', b='b')}, 6) AS miles, CASE WHEN a.locality = b.locality AND a.country_code = b.country_code THEN 0 WHEN a.country_code = b.country_code THEN 1 ELSE 2 END AS tier, b.review_count
  FROM locations a JOIN locations b ON a.org_id = b.org_id AND a.id <> b.id)
SELECT * EXCLUDE (review_count) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY miles, tier, review_count DESC NULLS LAST, sibling) AS place FROM p) WHERE place <= 12""", "locations"))
def s10_branches(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).select("id", "org_id", "latitude", "longitude", "locality", "country_code", "review_count")
    r = l.select(F.col("id").alias("sibling"), "org_id", *[F.col(c).alias(f"{c}_2") for c in ("latitude", "longitude", "locality", "country_code", "review_count")])
    same = F.col("country_code") == F.col("country_code_2")
    p = l.join(r, "org_id").where(F.col("id") != F.col("sibling"))
    p = p.withColumn("miles", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.col("latitude_2"), F.col("longitude_2")), 6))
    p = p.withColumn("tier", F.when((F.col("locality") == F.col("locality_2")) & same, 0).when(same, 1).otherwise(2))
    order = Window.partitionBy("id").orderBy("miles", "tier", F.desc_nulls_last("review_count_2"), "sibling")
    return p.withColumn("place", F.row_number().over(order)).where("place <= 12").select("id", "sibling", "miles", "tier", "place")
