"""The search's front door: requests, their dispatch, pages of results, landing cards, guarded matches by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightfield.functions import geo, pricing
from brightfield.plans.search import PAGE_SIZE, SearchRequest, visitor_rank
from brightfield.registry import query
from brightfield.roles import active, locations, offerings, sql, treatments

_MILES = "2 * 3958.7613 * asin(least(1.0, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"


def result_page(places: DataFrame, offers: DataFrame, request: SearchRequest) -> DataFrame:
    """A page of places with their distance, cheapest comparable price and the number of all results, best first."""
    priced = pricing.comparable(offers["price_amount"], offers["price_unit"], offers["price_audience"])
    cheapest = offers.where(priced).groupBy(F.col("location_id").alias("id")).agg(F.min("price_amount").alias("min_price"))
    miles = F.lit(None).cast("double") if request.latitude is None or request.longitude is None else F.round(geo.haversine(F.lit(request.latitude), F.lit(request.longitude), F.col("latitude"), F.col("longitude")), 6)
    found = places.join(cheapest, "id", "left").withColumn("miles", miles)
    order = [F.asc_nulls_last("miles"), F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), F.col("id").asc()]
    page = found.orderBy(*order).offset(request.page * PAGE_SIZE).limit(PAGE_SIZE).select("id", "miles", "min_price")
    return page.join(F.broadcast(places.agg(F.count("*").alias("total"))))  # one row


def dispatched(places: DataFrame, request: SearchRequest, view: tuple[float, float, float, float] | None = None, miles: float = 100.0) -> tuple[str, DataFrame]:
    """The mode of a request and the places that it is about: a map view before a country before a radius before all."""
    if view:
        return "viewport", places.where(geo.in_box(F.col("latitude"), F.col("longitude"), *view))
    if request.country:
        return "country", places.where(F.col("country_code") == request.country)
    if request.latitude is not None and request.longitude is not None:
        distance = geo.haversine(F.lit(request.latitude), F.lit(request.longitude), F.col("latitude"), F.col("longitude"))
        south, north, west, east = geo.radius_box(request.latitude, request.longitude, miles)
        return "radius", places.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east) & (distance <= miles))
    return "generic", places


_CHEAP = ", cheap AS (SELECT location_id AS id, min(price_amount) AS min_price FROM offerings WHERE price_amount > 0 AND price_unit IN ('service', 'session', 'visit') AND price_audience = 'retail' GROUP BY 1), a AS (SELECT * FROM locations WHERE status = 'active'), v AS (SELECT -8.0 AS latitude, -28.0 AS longitude)"


def _page_sql(mode: str, where: str, miles: str = "CAST(NULL AS DOUBLE)", offset: int = 0) -> str:
    inner = f"SELECT a.id, {miles} AS miles, min_price, count(*) OVER () AS total, rating, review_count FROM a CROSS JOIN v LEFT JOIN cheap USING (id) WHERE {where}"
    return f"(SELECT '{mode}' AS mode, id, miles, min_price, total FROM ({inner}) ORDER BY miles NULLS LAST, rating DESC NULLS LAST, review_count DESC NULLS LAST, id LIMIT 18 OFFSET {offset})"


_FROM_V = "round(" + _MILES.format(a="v", b="a") + ", 6)"


@query("e2_dispatch", sql(_CHEAP + " " + " UNION ALL ".join([
    _page_sql("viewport", "a.latitude BETWEEN -30 AND 30 AND a.longitude BETWEEN -90 AND 90"), _page_sql("country", "a.country_code = 'NATION_4'"),
    _page_sql("radius", _MILES.format(a="v", b="a") + " <= 100", _FROM_V), _page_sql("generic", "true", offset=18)]), "locations", "offerings"))
def e2(spark: SparkSession, d: str) -> DataFrame:
    """A page of each mode."""
    l, o = active(locations(spark, d)), offerings(spark, d)
    requests = [(SearchRequest(), (-30.0, 30.0, -90.0, 90.0)), (SearchRequest(country="NATION_4"), None), (SearchRequest(latitude=-8.0, longitude=-28.0), None), (SearchRequest(page=1), None)]
    pages = []
    for request, view in requests:
        mode, places = dispatched(l, request, view)
        pages.append(result_page(places, o, request).select(F.lit(mode).alias("mode"), "*"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query("e6_location_payload", sql(_CHEAP + " " + _page_sql("payload", "a.country_code IN ('NATION_10', 'NATION_11')", _FROM_V), "locations", "offerings"))
def e6(spark: SparkSession, d: str) -> DataFrame:
    l = active(locations(spark, d)).where(F.col("country_code").isin("NATION_10", "NATION_11"))
    return result_page(l, offerings(spark, d), SearchRequest(latitude=-8.0, longitude=-28.0)).select(F.lit("payload").alias("mode"), "*")


_CARDS = f""", v AS (SELECT -8.0 AS latitude, -28.0 AS longitude), c AS (SELECT l.id, CASE WHEN locality = 'BUILDING' AND country_code = 'NATION_3' THEN 0 WHEN country_code = 'NATION_3' THEN 1 WHEN region = 3 THEN 2 ELSE 3 END AS proximity, round({_MILES.format(a="v", b="l")}, 6) AS miles
  FROM locations l, v WHERE status = 'active' AND l.id IN (SELECT location_id FROM offerings JOIN treatments t ON t.id = treatment_id WHERE t.category = 'ECONOMY')),
cards AS (SELECT * FROM c ORDER BY proximity, miles, id LIMIT 80)"""


def landing_cards(spark: SparkSession, d: str, category: str, most: int = 80) -> DataFrame:
    t = treatments(spark, d).where(F.col("category") == category).select(F.col("id").alias("treatment_id"))
    o = offerings(spark, d).join(t, "treatment_id", "left_semi").select(F.col("location_id").alias("id"))
    l = active(locations(spark, d)).join(o, "id", "left_semi").withColumn("proximity", visitor_rank("BUILDING", "NATION_3", 3))
    l = l.withColumn("miles", F.round(geo.haversine(F.lit(-8.0), F.lit(-28.0), F.col("latitude"), F.col("longitude")), 6))
    return l.orderBy("proximity", "miles", "id").limit(most).select("id", "proximity", "miles")


@query("e14_treatment_cards", sql(_CARDS + " SELECT * FROM cards", "locations", "offerings", "treatments"))
def e14(spark: SparkSession, d: str) -> DataFrame:
    """The cards of a treatment's landing page: nearest to the visitor first."""
    return landing_cards(spark, d, "ECONOMY")


@query("e15_hydrated_cards", sql(_CARDS + """, n AS (SELECT DISTINCT location_id AS id, name FROM offerings JOIN treatments t ON t.id = treatment_id WHERE location_id IN (SELECT id FROM cards)),
chips AS (SELECT id, string_agg(name, ', ' ORDER BY name) AS chips FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS turn FROM n) WHERE turn <= 3 GROUP BY 1),
cheap AS (SELECT location_id AS id, min(price_amount) AS price FROM offerings WHERE price_amount > 0 AND price_unit IN ('service', 'session', 'visit') AND price_audience = 'retail' GROUP BY 1)
SELECT cards.id, proximity, chips, price FROM cards LEFT JOIN chips USING (id) LEFT JOIN cheap USING (id)""", "locations", "offerings", "treatments"))
def e15(spark: SparkSession, d: str) -> DataFrame:
    """Cards with three treatment names at most and the cheapest comparable price; only the cards' offerings are looked at."""
    cards = landing_cards(spark, d, "ECONOMY")
    o = offerings(spark, d).join(cards.select(F.col("id").alias("location_id")), "location_id", "left_semi")
    named = o.join(treatments(spark, d).select(F.col("id").alias("treatment_id"), "name"), "treatment_id")
    priced = pricing.comparable(F.col("price_amount"), F.col("price_unit"), F.col("price_audience"))
    made = named.groupBy(F.col("location_id").alias("id")).agg(F.array_join(F.slice(F.sort_array(F.collect_set("name")), 1, 3), ", ").alias("chips"), F.min(F.when(priced, F.col("price_amount"))).alias("price"))
    return cards.join(made, "id", "left").select("id", "proximity", "chips", "price")


_METRES = "2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h}))".format(h="greatest(0.0, least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))")


def place_matches(inputs: DataFrame, candidates: DataFrame, metres: float = 100.0, tie: float = 5.0) -> DataFrame:
    """For each input the nearest candidate within a distance, and how sure that is: less where the second is about as near or
    where organization, country or locality speak against it."""
    near = geo.around_cells(inputs, "latitude", "longitude", metres / 1000).select("id", "row", "col", *[F.col(c).alias(f"my_{c}") for c in ("latitude", "longitude", "org_id", "country_code", "locality")])
    near = near.join(geo.in_cell(candidates.withColumnRenamed("id", "candidate"), "latitude", "longitude", metres / 1000), ["row", "col"])
    near = near.withColumn("metres", geo.metres(F.col("my_latitude"), F.col("my_longitude"), F.col("latitude"), F.col("longitude"))).where((F.col("metres") <= metres) & (F.col("id") != F.col("candidate")))
    order = Window.partitionBy("id").orderBy(F.round("metres", 6), "candidate")
    near = near.withColumn("turn", F.row_number().over(order)).withColumn("second", F.lead("metres").over(order)).where("turn = 1")
    same = lambda c: F.col(f"my_{c}") == F.col(c)
    confidence = F.when(F.col("second") - F.col("metres") <= tie, 0.72).when(~same("country_code"), 0.60).when(~same("org_id"), 0.65).when(~same("locality"), 0.68).otherwise(0.84)
    return inputs.select("id").join(near.select("id", "candidate", confidence.alias("sure")), "id", "left").select("id", "candidate", F.coalesce("sure", F.lit(0.35)).alias("confidence"))


@query("d4_place_matches", sql(f""", n AS (SELECT a.id, b.id AS candidate, {_METRES} AS metres, a.country_code = b.country_code AS country, a.org_id = b.org_id AS org, a.locality = b.locality AS place
  FROM locations a JOIN locations b ON a.id <> b.id AND abs(a.latitude - b.latitude) < 0.01 AND abs(a.longitude - b.longitude) < 0.01),
r AS (SELECT *, row_number() OVER w AS turn, lead(metres) OVER w AS second FROM n WHERE metres <= 100 WINDOW w AS (PARTITION BY id ORDER BY round(metres, 6), candidate))
SELECT l.id, candidate, CAST(CASE WHEN candidate IS NULL THEN 0.35 WHEN second - metres <= 5 THEN 0.72 WHEN NOT country THEN 0.60 WHEN NOT org THEN 0.65 WHEN NOT place THEN 0.68 ELSE 0.84 END AS DOUBLE) AS confidence
FROM locations l LEFT JOIN (SELECT * FROM r WHERE turn = 1) USING (id)""", "locations"))
def d4(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).select("id", "latitude", "longitude", "org_id", "country_code", "locality")
    return place_matches(l, l)
