"""Entity resolution: similarity, blocking, pair scores, match cascades, components, survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightfield.functions import dates, geo, text
from brightfield.operators import cover_density
from brightfield.operators.components import components, written
from brightfield.operators.ranges import positions
from brightfield.operators.similarity import jaccard_of, rare_first, representatives, similar_pairs, similar_short_sets
from brightfield.registry import query
from brightfield.roles import active, locations, offerings, organizations, read, sql, treatments

_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"


def nearby_pairs(places: DataFrame, km: float) -> DataFrame:
    """(a, b, km) for pairs within a distance: each place is joined to the grid cells around it, never to all others."""
    p = places.select("id", "latitude", "longitude")
    left = geo.around_cells(p.select(F.col("id").alias("a"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1")), "lat1", "lon1", km)
    pairs = left.join(geo.in_cell(p, "latitude", "longitude", km), ["row", "col"]).where(F.col("a") < F.col("id"))
    distance = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("latitude"), F.col("longitude"), geo.KM)
    return pairs.select("a", F.col("id").alias("b"), distance.alias("km")).where(F.col("km") <= km)


_PAIRS = f", near AS (SELECT a.id AS a, b.id AS b, {_KM} AS km FROM locations a JOIN locations b ON a.id < b.id AND abs(a.latitude - b.latitude) < 0.05 AND abs(a.longitude - b.longitude) < 0.05)"


@query("j13_proximity_pairs", sql(_PAIRS + " SELECT a, b, round(km, 6) AS km FROM near WHERE km <= 1.5", "locations"))
def j13(spark: SparkSession, d: str) -> DataFrame:
    return nearby_pairs(locations(spark, d), 1.5).select("a", "b", F.round("km", 6).alias("km"))


_GRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_filter(string_split({c}, ' '), lambda x: x <> '')]))"
_NAMED = """, named AS (SELECT l.id, l.country_code, l.latitude, l.longitude, trim(regexp_replace(lower(coalesce(canonical_name, '') || ' clinic ' || CASE id % 3 WHEN 0 THEN 'branch' WHEN 1 THEN 'branch 1' ELSE 'branch east' END), '[^a-z0-9]+', ' ', 'g')) AS name
  FROM locations l LEFT JOIN organizations o USING (org_id)),
reps AS (SELECT name, country_code, latitude, longitude, min(id) AS id, count(*) AS copies, replace(name, ' ', '-') AS slug, """ + _GRAMS.format(c="name") + """ AS g FROM named GROUP BY ALL),
pairs AS (SELECT a.id AS a, b.id AS b, a.copies AS copies_a, b.copies AS copies_b, len(list_intersect(a.g, b.g)) AS shared, len(a.g) AS size_a, len(b.g) AS size_b, a.slug AS slug_a, b.slug AS slug_b, """ + _KM.replace("6371.0", "6371000.0") + """ AS metres
  FROM reps a JOIN reps b ON a.id < b.id AND a.country_code IS NOT DISTINCT FROM b.country_code AND abs(a.latitude - b.latitude) < 0.002)"""


def named_locations(spark: SparkSession, d: str) -> DataFrame:
    branch = F.when(F.col("id") % 3 == 0, "branch").when(F.col("id") % 3 == 1, "branch 1").otherwise("branch east")
    l = locations(spark, d).join(organizations(spark, d).select("org_id", "canonical_name"), "org_id", "left")
    name = text.human_text(F.concat(F.coalesce("canonical_name", F.lit("")), F.lit(" clinic "), branch))
    return l.select("id", "country_code", "latitude", "longitude", name.alias("name"))


def nearby_namesakes(places: DataFrame, km: float, percent: int) -> DataFrame:
    """Pairs of places of one country within a distance whose names' trigrams agree, but for those told apart by a number in the slug.

    Places that share name and coordinates are one, with the number of its copies. Grid cells around a place and the rarest trigrams
    of its name are one join key, so neither a town full of places nor a common name makes all pairs meet.
    """
    reps = written(representatives(places, "name", "country_code", "latitude", "longitude"), "places")
    known = written(rare_first(reps.select("id", "country_code", "latitude", "longitude", text.word_trigrams(F.col("name")).alias("grams"))), "names")
    cell = F.xxhash64("row", "col", F.coalesce("country_code", F.lit(""))).alias("cell")  # of countries and distances only those that agree stay
    left = geo.around_cells(known, "latitude", "longitude", km).select("id", cell, "grams")
    pairs = similar_pairs(left, geo.in_cell(known, "latitude", "longitude", km).select("id", cell, "grams"), percent, on=("cell",))
    of = lambda k: reps.select(F.col("id").alias(k), F.coalesce("country_code", F.lit("")).alias(f"country_{k}"), F.col("copies").alias(f"copies_{k}"), F.col("latitude").alias(f"lat_{k}"), F.col("longitude").alias(f"lon_{k}"), text.slug(F.col("name")).alias(f"slug_{k}")).hint("merge")
    pairs = pairs.withColumn("similarity", jaccard_of(pairs)).join(of("a"), "a").join(of("b"), "b").where("country_a = country_b")
    pairs = pairs.withColumn("metres", geo.metres(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where(F.col("metres") <= km * 1000)
    bare = lambda k: F.regexp_replace(f"slug_{k}", "-[0-9]+$", "")
    return pairs.where((F.col("slug_a") != bare("b")) & (F.col("slug_b") != bare("a")))


@query("j12_band_and_name", sql(_NAMED + """ SELECT a, b, copies_a, copies_b, round(shared / (size_a + size_b - shared), 6) AS similarity, round(metres, 3) AS metres FROM pairs
  WHERE 100 * shared >= 85 * (size_a + size_b - shared) AND metres <= 150 AND slug_a <> regexp_replace(slug_b, '-[0-9]+$', '') AND slug_b <> regexp_replace(slug_a, '-[0-9]+$', '')""", "locations", "organizations"))
def j12(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearby_namesakes(named_locations(spark, d), 0.15, 85)
    return pairs.select("a", "b", "copies_a", "copies_b", F.round("similarity", 6).alias("similarity"), F.round("metres", 3).alias("metres"))


_SCORED = _PAIRS + """, coarse AS (SELECT latitude, longitude, count(*) AS n FROM locations GROUP BY 1, 2),
x AS (SELECT l.*, c.n >= 3 AS is_coarse FROM locations l JOIN coarse c USING (latitude, longitude)),
scored AS (SELECT n.a, n.b, CASE WHEN p.locality = q.locality THEN 28 ELSE 0 END + CASE WHEN p.org_id = q.org_id THEN 12 ELSE 0 END + CASE WHEN p.country_code = q.country_code THEN 4 ELSE 0 END
  + CASE WHEN p.is_coarse AND km < 0.001 THEN 2 WHEN km <= 0.03 THEN 15 WHEN km <= 0.5 THEN 10 WHEN km <= 1.5 THEN 5 ELSE 0 END + CASE WHEN p.rating = q.rating THEN 14 ELSE 0 END AS score, km
  FROM near n JOIN x p ON p.id = n.a JOIN x q ON q.id = n.b WHERE km <= 1.5 AND NOT (p.status = 'inactive' AND q.status = 'inactive')),
tiered AS (SELECT *, CASE WHEN score >= 50 THEN 'critical' WHEN score >= 40 THEN 'high' ELSE 'medium' END AS tier FROM scored)"""


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Points for what a pair has in common, a veto for two inactive places, and the tier of the sum."""
    l = locations(spark, d).withColumn("coarse", F.count("*").over(Window.partitionBy("latitude", "longitude")) >= 3)
    fields = ("locality", "org_id", "country_code", "rating", "status", "coarse")
    p, q = [l.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in fields]) for k in ("a", "b")]
    n = nearby_pairs(l, 1.5).join(p, "a").join(q, "b").where("NOT (status_a = 'inactive' AND status_b = 'inactive')")
    same = lambda c, points: F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), points).otherwise(0)
    km = F.col("km")
    spot = F.when(F.col("coarse_a") & (km < 0.001), 2).when(km <= 0.03, 15).when(km <= 0.5, 10).when(km <= 1.5, 5).otherwise(0)
    n = n.withColumn("score", same("locality", 28) + same("org_id", 12) + same("country_code", 4) + spot + same("rating", 14))
    return n.withColumn("tier", F.when(F.col("score") >= 50, "critical").when(F.col("score") >= 40, "high").otherwise("medium"))


@query("d7_d8_pair_scores", sql(_SCORED + " SELECT a, b, score, tier FROM tiered", "locations"))
def d7(spark: SparkSession, d: str) -> DataFrame:
    return scored_pairs(spark, d).select("a", "b", "score", "tier")


@query("s16_pair_order", sql(_SCORED + " SELECT a, b, score FROM tiered ORDER BY score DESC, round(km, 9), a, b LIMIT 50", "locations"))
def s16(spark: SparkSession, d: str) -> DataFrame:
    return scored_pairs(spark, d).orderBy(F.desc("score"), F.round("km", 9), "a", "b").limit(50).select("a", "b", "score")


_REACH = """WITH RECURSIVE {roles}{scored}, e AS (SELECT a, b FROM tiered WHERE tier <> 'medium'), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT x, x FROM s UNION SELECT s.x, r.y FROM s JOIN reach r ON r.x = s.y), c AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY 1)"""


def _reach(body: str) -> str:
    from brightfield.roles import SQL

    return _REACH.format(roles=SQL["locations"], scored=_SCORED) + body


@query("d9_components", _reach(" SELECT * FROM c"))
def d9(spark: SparkSession, d: str) -> DataFrame:
    return components(scored_pairs(spark, d).where("tier <> 'medium'").select("a", "b"))


@query("d10_survivors", _reach(", r AS (SELECT component, id, row_number() OVER (PARTITION BY component ORDER BY review_count DESC NULLS LAST, rating DESC NULLS LAST, id) AS turn FROM c JOIN locations l ON l.id = node) SELECT component, id FROM r WHERE turn = 1"))
def d10(spark: SparkSession, d: str) -> DataFrame:
    """The best member of each component."""
    c = d9(spark, d).join(locations(spark, d).select(F.col("id").alias("node"), "review_count", "rating"), "node")
    turn = F.row_number().over(Window.partitionBy("component").orderBy(F.desc_nulls_last("review_count"), F.desc_nulls_last("rating"), "node"))
    return c.withColumn("turn", turn).where("turn = 1").select("component", F.col("node").alias("id"))


@query("d11_merge", _reach(", m AS (SELECT component, min(l.name) AS name, max(rating) AS rating, CAST(sum(coalesce(review_count, 0)) AS BIGINT) AS reviews, bool_or(is_virtual) AS is_virtual FROM c JOIN locations l ON l.id = node GROUP BY 1) SELECT * FROM m"))
def d11(spark: SparkSession, d: str) -> DataFrame:
    """Field-wise merge of a component."""
    c = d9(spark, d).join(locations(spark, d).withColumnRenamed("id", "node"), "node")
    return c.groupBy("component").agg(F.min("name").alias("name"), F.max("rating").alias("rating"), F.sum(F.coalesce("review_count", F.lit(0))).alias("reviews"), F.bool_or("is_virtual").alias("is_virtual"))


def match_cascade(inputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rules in turn: organization and locality, then name key and country, then within a kilometre, then a slug for review.

    Every rule is its own blocked equi-join; an input takes its first rule with candidates, which is ambiguous with several.
    """
    c = candidates.select(F.col("id").alias("candidate"), "org_id", "locality", "country_code", "name_key", "latitude", "longitude", "slug")
    i = inputs
    rule = lambda rank, df: df.select("input_id", "candidate", F.lit(rank).alias("rank"))
    by_org = rule(1, i.join(c, ["org_id", "locality"]))
    by_name = rule(2, i.join(c, ["name_key", "country_code"]))
    left = geo.around_cells(i.select("input_id", F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1")), "lat1", "lon1", 1.0)
    near = left.join(geo.in_cell(c, "latitude", "longitude", 1.0), ["row", "col"])
    by_place = rule(3, near.where(geo.metres(F.col("lat1"), F.col("lon1"), F.col("latitude"), F.col("longitude")) <= 1000))
    by_slug = rule(4, i.join(c.drop("latitude", "longitude"), "slug"))
    every = by_org.unionByName(by_name).unionByName(by_place).unionByName(by_slug).where("candidate <> input_id").distinct()
    best = every.groupBy("input_id", "rank").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
    best = best.groupBy("input_id").agg(F.min(F.struct("rank", "n", "candidate")).alias("x")).select("input_id", "x.*")
    status = F.when(F.col("rank") == 4, "review").when(F.col("n") > 1, "review").otherwise("matched")
    confidence = F.when(F.col("n") > 1, F.when(F.col("rank") == 1, 0.80).when(F.col("rank") == 2, 0.78).otherwise(0.72)).otherwise(F.when(F.col("rank") == 1, 0.96).when(F.col("rank") == 2, 0.93).when(F.col("rank") == 3, 0.84).otherwise(0.5))
    made = i.select("input_id").join(best, "input_id", "left")
    return made.select("input_id", F.coalesce(F.when(F.col("rank").isNotNull(), status), F.lit("none")).alias("status"), "rank", F.when(status == "matched", F.col("candidate")).alias("candidate"), F.coalesce(F.when(F.col("rank").isNotNull(), confidence), F.lit(0.0)).alias("confidence"))


_CASCADE = """, c AS (SELECT id AS candidate, org_id, locality, country_code, lower(replace(name, '#', ' ')) AS name_key, latitude, longitude, 's' || (id // 2) AS slug FROM locations WHERE status = 'active'),
i AS (SELECT id AS input_id, org_id, locality, country_code, CASE WHEN id % 5 = 0 THEN lower(replace(name, '#', ' ')) ELSE 'x' || id END AS name_key, latitude, longitude, 's' || (id // 2 + 2) AS slug FROM locations),
r AS (SELECT input_id, candidate, 1 AS rank FROM i JOIN c USING (org_id, locality) UNION SELECT input_id, candidate, 2 FROM i JOIN c USING (name_key, country_code)
  UNION SELECT input_id, candidate, 3 FROM i a JOIN c b ON abs(a.latitude - b.latitude) < 0.03 AND abs(a.longitude - b.longitude) < 0.03 WHERE """ + _KM.replace("6371.0", "6371000.0") + """ <= 1000 UNION SELECT input_id, candidate, 4 FROM i JOIN c USING (slug)),
g AS (SELECT input_id, rank, count(*) AS n, min(candidate) AS candidate FROM r WHERE candidate <> input_id GROUP BY 1, 2), t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY rank) = 1)
SELECT i.input_id, CASE WHEN rank IS NULL THEN 'none' WHEN rank = 4 OR n > 1 THEN 'review' ELSE 'matched' END AS status, rank, CASE WHEN rank < 4 AND n = 1 THEN candidate END AS candidate,
  CASE WHEN rank IS NULL THEN 0.0 WHEN n > 1 THEN CASE rank WHEN 1 THEN 0.80 WHEN 2 THEN 0.78 ELSE 0.72 END ELSE CASE rank WHEN 1 THEN 0.96 WHEN 2 THEN 0.93 WHEN 3 THEN 0.84 ELSE 0.5 END END::DOUBLE AS confidence FROM i LEFT JOIN t USING (input_id)"""


@query("d1_match_cascade", sql(_CASCADE.replace("CASE WHEN rank IS NULL THEN 0.0", "CAST(CASE WHEN rank IS NULL THEN 0.0").replace("END END::DOUBLE AS", "END END AS DOUBLE) AS"), "locations"))
def d1(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).withColumn("name_key", F.lower(F.replace("name", F.lit("#"), F.lit(" "))))
    c = active(l).withColumn("slug", F.concat(F.lit("s"), F.expr("id div 2")))
    i = l.select(F.col("id").alias("input_id"), "org_id", "locality", "country_code", F.when(F.col("id") % 5 == 0, F.col("name_key")).otherwise(F.concat(F.lit("x"), "id")).alias("name_key"), "latitude", "longitude", F.concat(F.lit("s"), F.expr("id div 2 + 2")).alias("slug"))
    return match_cascade(i, c)


@query("j14_recall_candidates", sql("""SELECT a.id AS a, b.id AS b FROM locations a JOIN locations b ON a.id < b.id AND a.org_id = b.org_id AND a.locality = b.locality UNION SELECT a.id, b.id FROM locations a JOIN locations b ON a.id < b.id AND a.latitude = b.latitude AND a.longitude = b.longitude""", "locations"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    """The union of blocked equi-joins, never a join on an OR."""
    l = locations(spark, d)

    def block(*keys: str) -> DataFrame:
        p = l.select("id", *keys)
        return p.select(F.col("id").alias("a"), *keys).join(p.select(F.col("id").alias("b"), *keys), list(keys)).where("a < b").select("a", "b")

    return block("org_id", "locality").unionByName(block("latitude", "longitude")).distinct()


@query("d15_display_resolution", sql(""", n AS (SELECT *, price_unit AS term FROM offerings), s AS (SELECT *, max(price_amount) OVER (PARTITION BY location_id, treatment_id, term) AS hi, min(price_amount) OVER (PARTITION BY location_id, treatment_id, term) AS lo, row_number() OVER (PARTITION BY location_id, treatment_id, term ORDER BY price_amount IS NULL, updated_at DESC, id) AS turn,
first_value(id) OVER (PARTITION BY location_id, treatment_id, term ORDER BY price_amount IS NULL, updated_at DESC, id) AS winner FROM n)
SELECT id, winner, CASE WHEN price_amount IS NULL AND hi IS NOT NULL THEN 'unpriced_shadow' WHEN hi IS DISTINCT FROM lo THEN 'price_conflict' ELSE 'same_price' END AS reason FROM s WHERE turn > 1""", "offerings"))
def d15(spark: SparkSession, d: str) -> DataFrame:
    """Offerings of one term at a place: who loses to whom, and why."""
    group = Window.partitionBy("location_id", "treatment_id", "price_unit")
    order = group.orderBy(F.col("price_amount").isNull(), F.desc("updated_at"), "id")
    s = offerings(spark, d).withColumn("hi", F.max("price_amount").over(group)).withColumn("lo", F.min("price_amount").over(group))
    s = s.withColumn("turn", F.row_number().over(order)).withColumn("winner", F.first("id").over(order))
    reason = F.when(F.col("price_amount").isNull() & F.col("hi").isNotNull(), "unpriced_shadow").when(~F.col("hi").eqNullSafe(F.col("lo")), "price_conflict").otherwise("same_price")
    return s.where("turn > 1").select("id", "winner", reason.alias("reason"))


@query("d17_exact_key_match", sql(", k AS (SELECT min(id) AS id, lower(regexp_replace(category, '[^A-Za-z0-9]+', '', 'g')) AS key FROM treatments GROUP BY 2) SELECT t.id, k.id AS matched FROM treatments t JOIN k ON k.key = lower(regexp_replace(t.category, '[^A-Za-z0-9]+', '', 'g'))", "treatments"))
def d17(spark: SparkSession, d: str) -> DataFrame:
    t = treatments(spark, d).select("id", F.lower(F.regexp_replace("category", "[^A-Za-z0-9]+", "")).alias("key"))
    return t.join(t.groupBy("key").agg(F.min("id").alias("matched")), "key").select("id", "matched")


@query("d18_coordinate_consensus", sql("SELECT org_id, country_code, CASE WHEN count(DISTINCT (latitude, longitude)) = 0 THEN 'none' WHEN count(DISTINCT (latitude, longitude)) = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM locations GROUP BY 1, 2", "locations"))
def d18(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct(F.struct("latitude", "longitude"))
    return locations(spark, d).groupBy("org_id", "country_code").agg(F.when(n == 0, "none").when(n == 1, "matched").otherwise("ambiguous").alias("status"))


_PASSES = """, p1 AS (SELECT id, org_id AS target, status AS decision, CAST(60 + id * 7 % 41 AS DOUBLE) / 100 AS confidence FROM locations),
p2 AS (SELECT id, CASE WHEN id % 11 = 0 THEN org_id + 1 ELSE org_id END AS target, CASE WHEN id % 13 = 0 THEN 'other' ELSE status END AS decision, CAST(60 + id * 11 % 41 AS DOUBLE) / 100 AS confidence FROM locations)"""


@query("d19_two_pass_consensus", sql(_PASSES + """ SELECT p1.id, CASE WHEN p1.decision <> p2.decision OR p1.target <> p2.target THEN 'disagreement' WHEN o.org_id IS NULL THEN 'invalid_target'
  WHEN p1.confidence < 0.85 OR p2.confidence < 0.85 THEN 'low_confidence' ELSE 'accepted' END AS outcome, CASE WHEN p1.target = p2.target THEN p1.target END AS target
  FROM p1 JOIN p2 ON p1.id = p2.id LEFT JOIN organizations o ON o.org_id = p1.target""", "locations", "organizations"))
def d19(spark: SparkSession, d: str) -> DataFrame:
    """Two passes decide alike, on an existing target, and both are sure; else why not."""
    l = locations(spark, d)
    sure = lambda k: (60 + F.col("id") * k % 41).cast("double") / 100
    one = l.select("id", F.col("org_id").alias("target"), F.col("status").alias("decision"), sure(7).alias("confidence"))
    two = l.select("id", F.when(F.col("id") % 11 == 0, F.col("org_id") + 1).otherwise(F.col("org_id")).alias("target_2"), F.when(F.col("id") % 13 == 0, "other").otherwise(F.col("status")).alias("decision_2"), sure(11).alias("confidence_2"))
    return two_pass_consensus(one, two, organizations(spark, d).select(F.col("org_id").alias("target")))


def two_pass_consensus(one: DataFrame, two: DataFrame, targets: DataFrame, least: float = 0.85) -> DataFrame:
    both = one.join(two, "id").join(targets.distinct().withColumn("known", F.lit(True)), "target", "left")
    apart = (F.col("decision") != F.col("decision_2")) | (F.col("target") != F.col("target_2"))
    outcome = F.when(apart, "disagreement").when(F.col("known").isNull(), "invalid_target").when((F.col("confidence") < least) | (F.col("confidence_2") < least), "low_confidence").otherwise("accepted")
    return both.select("id", outcome.alias("outcome"), F.when(F.col("target") == F.col("target_2"), F.col("target")).alias("target"))


@query("d22_query_resolution", sql(", q(q) AS (VALUES ('small ring'), ('economy'), ('red')), h AS (SELECT q, id, 1 AS tier FROM q JOIN treatments ON lower(name) = q UNION SELECT q, id, 2 FROM q JOIN treatments ON lower(category) = q UNION SELECT q, id, 3 FROM q JOIN treatments ON starts_with(lower(name), q || ' ')), t AS (SELECT q, tier, count(*) AS n, min(id) AS id FROM h GROUP BY 1, 2) SELECT q, CASE WHEN n = 1 THEN id END AS treatment_id FROM t QUALIFY row_number() OVER (PARTITION BY q ORDER BY tier) = 1", "treatments"))
def d22(spark: SparkSession, d: str) -> DataFrame:
    """Exact name, then exact synonym, then prefix; only a unique hit of the first tier with hits resolves."""
    t = treatments(spark, d).select("id", F.lower("name").alias("name"), F.lower("category").alias("synonym"))
    tier = lambda q: F.when(F.col("name") == q, 1).when(F.col("synonym") == q, 2).when(F.col("name").startswith(q + " "), 3)
    hits = F.array(*[F.struct(F.lit(q).alias("q"), tier(q).alias("tier")) for q in ("small ring", "economy", "red")])
    h = t.select("id", F.inline(hits)).where("tier IS NOT NULL").groupBy("q", "tier").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return h.groupBy("q").agg(F.min(F.struct("tier", "n", "id")).alias("x")).select("q", F.when(F.col("x.n") == 1, F.col("x.id")).alias("treatment_id"))


@query("d23_held_reason", sql(", r AS (SELECT id, CASE WHEN is_virtual THEN 'initial_gate' WHEN rating IS NULL THEN 'official_neither' WHEN locality = 'MACHINERY' THEN 'address_missing' WHEN review_count < 5 THEN 'treatment_missing' WHEN region = 3 THEN 'identity_ambiguity' ELSE 'promotion_review' END AS reason FROM locations) SELECT reason, count(*) AS n FROM r GROUP BY 1", "locations"))
def d23(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("is_virtual"), "initial_gate").when(F.col("rating").isNull(), "official_neither").when(F.col("locality") == "MACHINERY", "address_missing")
    reason = reason.when(F.col("review_count") < 5, "treatment_missing").when(F.col("region") == 3, "identity_ambiguity").otherwise("promotion_review")
    return locations(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("d25_chunks", sql(", n AS (SELECT country_code, id, (row_number() OVER (PARTITION BY country_code ORDER BY id) - 1) // 20 AS chunk FROM locations) SELECT country_code, chunk, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM n GROUP BY 1, 2", "locations"))
def d25(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of twenty places of a country, however many a country has."""
    n = positions(locations(spark, d).select("country_code", "id"), ["country_code"], ["id"]).withColumn("chunk", F.expr("position div 20"))
    return n.groupBy("country_code", "chunk").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("d28_outcomes", sql("SELECT count(*) FILTER (WHERE rating >= 3) AS ready, count(*) FILTER (WHERE rating < 3) AS review, count(*) FILTER (WHERE rating IS NULL) AS no_match FROM locations", "locations"))
def d28(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).agg(F.count_if(F.col("rating") >= 3).alias("ready"), F.count_if(F.col("rating") < 3).alias("review"), F.count_if(F.col("rating").isNull()).alias("no_match"))


# ---- scalar functions over tables ----


@query("n8_slug", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def n8(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.slug(F.concat("p_type", F.lit(" / "), "p_name")).alias("slug"))


_TITLES = f"""WITH t AS (SELECT DISTINCT lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS t FROM pages),
n AS (SELECT t, {_GRAMS.format(c="t")} AS g FROM t WHERE t <> '')"""


@query("n5_trigram_jaccard", _TITLES + """ SELECT a.t AS a, b.t AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity
  FROM n a JOIN n b ON a.t < b.t WHERE 100 * len(list_intersect(a.g, b.g)) >= 45 * len(list_distinct(list_concat(a.g, b.g)))""")
def n5(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages that share most word trigrams; every title comes once."""
    t = read(spark, d, "pages").select(F.lower(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("id")).where("id <> ''").distinct()
    pairs = similar_short_sets(t.withColumn("grams", text.word_trigrams(F.col("id"))), 45)
    return pairs.select("a", "b", F.round(jaccard_of(pairs), 6).alias("similarity"))


@query("n9_hosts", "SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:@]+)', 1), '^www[0-9]*\\.', '') AS host, array_to_string(string_split(regexp_extract(lower(url), '^[a-z]+://([^/?#:@]+)', 1), '.')[-2:], '.') AS domain FROM pages")
def n9(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.registrable_domain(F.col("url")).alias("domain"))


@query("n10_without_tracking", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(ref|utm_[a-z]+)=[^&]*', '\\1'), '&+$', ''), '\\?$', '') AS url FROM pages")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.without_tracking(F.col("url")).alias("url"))


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')"


@query("n21_n22_full_text", f"""WITH q AS (SELECT item_id AS query, {_TOKENS} AS t FROM benchmark), w AS (
  SELECT DISTINCT query, t[1] AS word, 0 AS part FROM q WHERE len(t) >= 3 UNION SELECT query, unnest(t[2:3]), 1 FROM q WHERE len(t) >= 3 UNION SELECT query, t[-1], -1 FROM q WHERE len(t) >= 3),
d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM d),
h AS (SELECT query, doc_id, pos, part, row_number() OVER g AS turn, max(CASE WHEN part = 0 THEN pos END) OVER g AS l0, max(CASE WHEN part = 1 THEN pos END) OVER g AS l1
  FROM p JOIN w USING (word) WINDOW g AS (PARTITION BY query, doc_id ORDER BY pos, part ROWS UNBOUNDED PRECEDING)),
bad AS (SELECT DISTINCT query, doc_id FROM h WHERE part = -1),
c AS (SELECT query, doc_id, least(l0, l1) AS b, min(pos) AS e, min(turn) AS turn FROM h WHERE l0 IS NOT NULL AND l1 IS NOT NULL GROUP BY ALL),
v AS (SELECT c.query, c.doc_id, (e - b) - (c.turn - min(h.turn)) AS noise FROM c JOIN h ON h.query = c.query AND h.doc_id = c.doc_id AND h.pos = c.b GROUP BY c.query, c.doc_id, b, e, c.turn)
SELECT query, doc_id AS id, CAST(count(*) AS INT) AS covers, round(sum(0.1 / (1 + greatest(noise, 0))), 6) AS rank FROM v WHERE (query, doc_id) NOT IN (SELECT (query, doc_id) FROM bad) GROUP BY 1, 2""")
def n21(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the first word of a benchmark item and its second or third, but not its last, ranked by cover density."""
    t = text.tokens(F.coalesce("text", F.lit("")))
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query"), t.alias("t")).where(F.size("t") >= 3)
    queries = q.select("query", F.array(F.slice("t", 1, 1), F.slice("t", 2, 2)).alias("all_of"), F.slice("t", -1, 1).alias("none_of"))
    documents = read(spark, d, "documents").select(F.col("doc_id").alias("id"), cover_density.weighted_words((F.col("text"), "D")).alias("words"))
    return cover_density.ranked_matches(documents, queries).select("query", "id", "covers", F.round("rank", 6).alias("rank"))


@query("n23_hashes", "SELECT doc_id, sha256(source || ':' || doc_id) AS sha, md5(lang) AS lang_key FROM documents")
def n23(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws(":", "source", "doc_id"), 256).alias("sha"), F.md5("lang").alias("lang_key"))


@query("n18_n19_labels", sql("SELECT id, coalesce(nullif(trim(price_unit), ''), 'service') AS unit, CASE price_currency WHEN 'N' THEN 'Norte' WHEN 'R' THEN 'Rand' WHEN 'A' THEN 'Azul' ELSE price_currency END AS currency FROM offerings", "offerings"))
def n18(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"N": "Norte", "R": "Rand", "A": "Azul"}.items() for x in kv])
    o = offerings(spark, d)
    return o.select("id", F.coalesce(text.blank_to_null(F.col("price_unit")), F.lit("service")).alias("unit"), F.coalesce(names[F.col("price_currency")], "price_currency").alias("currency"))


@query("m1_m3_distances", sql(", o AS (SELECT -8.0 AS latitude, -28.0 AS longitude) SELECT b.id, round(" + _KM + ", 6) AS km FROM locations b, o a", "locations"))
def m1(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).select("id", F.round(geo.haversine(F.lit(-8.0), F.lit(-28.0), F.col("latitude"), F.col("longitude"), geo.KM), 6).alias("km"))


@query("t4_next_review", "SELECT s_suppkey AS id, greatest(DATE '2024-01-02', least(DATE '2024-01-01' + CAST(s_suppkey % 90 AS INT), DATE '2024-01-01' + CAST(s_suppkey % 60 AS INT) - 7)) AS due FROM supplier")
def t4(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2024-01-01").cast("date")
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("id"), dates.next_review(day, F.date_add(day, (k % 90).cast("int")), F.date_add(day, (k % 60).cast("int"))).alias("due"))


@query("t3_format_audit", "SELECT count(*) FILTER (WHERE regexp_matches(url, '^https://')) AS secure, count(*) FILTER (WHERE regexp_matches(url, '[?]')) AS with_query, count(*) FILTER (WHERE regexp_matches(url, '#')) AS with_fragment FROM pages")
def t3(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").agg(F.count_if(u.rlike("^https://")).alias("secure"), F.count_if(u.rlike("[?]")).alias("with_query"), F.count_if(u.rlike("#")).alias("with_fragment"))


@query("r7_keywords", sql(", k AS (SELECT id, lower(category) AS core FROM treatments) SELECT id, unnest([core, core || ' near me', core || ' clinic']) AS keyword FROM k", "treatments"))
def r7(spark: SparkSession, d: str) -> DataFrame:
    core = F.lower("category")
    return treatments(spark, d).select("id", F.explode(F.array(core, F.concat(core, F.lit(" near me")), F.concat(core, F.lit(" clinic")))).alias("keyword"))


@query("r6_place_keywords", sql(", k AS (SELECT id, lower(category) AS core FROM treatments) SELECT id, core || ' lyon' AS keyword FROM k", "treatments"))
def r6(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).select("id", text.keyword_in_place(F.concat("category", F.lit(" near me")), F.lit("lyon")).alias("keyword"))


# ---- pages ----


@query("x5_contacts", "SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', 0), '') AS email FROM documents WHERE contains(text, '@')")
def x5(spark: SparkSession, d: str) -> DataFrame:
    e = F.regexp_extract("text", "[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", 0)
    return read(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.nullif(e, F.lit("")).alias("email"))


@query("x14_titles", "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def x14(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("x18_page_kind", "SELECT page_id, CASE WHEN url LIKE '%blog%' THEN 'blog' WHEN url LIKE '%#%' THEN 'anchor' WHEN url LIKE '%?%' THEN 'query' ELSE 'plain' END AS kind FROM pages")
def x18(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.when(u.rlike("blog"), "blog").when(u.rlike("#"), "anchor").when(u.rlike("[?]"), "query").otherwise("plain").alias("kind"))


@query("x17_structured_data", sql("SELECT l.id, to_json(struct_pack(\"@type\" := 'Place', \"name\" := name, \"country\" := country_code)) AS json FROM locations l", "locations"))
def x17(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).select("id", F.to_json(F.struct(F.lit("Place").alias("@type"), "name", F.col("country_code").alias("country"))).alias("json"))
