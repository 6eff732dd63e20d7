"""Hydrated records, landing pages, opening hours, streams as tables, and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightfield.functions import text
from brightfield.operators.components import place_for
from brightfield.registry import query
from brightfield.roles import active, locations, offerings, organizations, read, reviews, sql, tasks, treatments
from brightfield.sources import files


@query("c6_json_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'view'")
def c6(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("event_type = 'view'")
    return e.select("event_id", F.inline(files.json_rows(F.concat(F.lit("["), "props", F.lit("]")), "k int")))


@query("c7_positions", sql("SELECT r.position, l.id, l.name FROM (VALUES (7, 1), (3, 2), (11, 3)) r(id, position) JOIN locations l USING (id)", "locations"))
def c7(spark: SparkSession, d: str) -> DataFrame:
    roots = F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(p).alias("position")) for p, i in enumerate((7, 3, 11), 1)])
    place = F.filter(roots, lambda r: r["id"] == F.col("id"))
    return locations(spark, d).where(F.size(place) > 0).select(place[0]["position"].alias("position"), "id", "name")


@query("c8_array_rows", "SELECT doc_id, unnest(string_split(source || '/' || lang, '/')) AS part FROM documents")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(F.split(F.concat_ws("/", "source", "lang"), "/")).alias("part"))


_MERGE = ", old AS (SELECT id, rating, status FROM locations WHERE id % 3 <> 0), new AS (SELECT id, CAST(5 AS INT) AS rating, 'fresh' AS status FROM locations WHERE id % 4 = 0)"


@query("c17_upsert", sql(_MERGE + " SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NOT NULL AND coalesce(old.status, '') <> 'inactive' THEN new.rating ELSE old.rating END AS rating, CASE WHEN new.id IS NOT NULL AND coalesce(old.status, '') <> 'inactive' THEN new.status ELSE old.status END AS status FROM old FULL JOIN new ON old.id = new.id", "locations"))
def c17(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    old, new = l.where("id % 3 <> 0").select("id", "rating", "status"), l.where("id % 4 = 0").select("id", F.lit(5).alias("rating"), F.lit("fresh").alias("status"))
    return files.upsert(old, new, ["id"], F.col("status") == "inactive")


@query("c18_field_merge", sql(_MERGE + " SELECT coalesce(old.id, new.id) AS id, coalesce(old.rating, new.rating) AS rating, coalesce(old.status, new.status) AS status FROM old FULL JOIN new ON old.id = new.id", "locations"))
def c18(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    return files.merge_fields(l.where("id % 3 <> 0").select("id", "rating", "status"), l.where("id % 4 = 0").select("id", F.lit(5).alias("rating"), F.lit("fresh").alias("status")), ["id"])


@query("c19_insert_absent", sql(_MERGE + " SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)", "locations"))
def c19(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    return files.insert_absent(l.where("id % 3 <> 0").select("id", "rating", "status"), l.where("id % 4 = 0").select("id", F.lit(5).alias("rating"), F.lit("fresh").alias("status")), ["id"])


@query("c20_delete_using", sql("SELECT id FROM offerings WHERE location_id NOT IN (SELECT id FROM locations WHERE is_virtual)", "offerings", "locations"))
def c20(spark: SparkSession, d: str) -> DataFrame:
    return offerings(spark, d).join(locations(spark, d).where("is_virtual").select(F.col("id").alias("location_id")), "location_id", "left_anti").select("id")


@query("j17_keyword_lookup", sql(", k AS (SELECT id, regexp_replace(lower(category), ' (tin|brass)$', '') AS key FROM treatments), m AS (SELECT regexp_replace(lower(category), ' (tin|brass)$', '') AS key, CAST(sum(size) AS BIGINT) AS volume FROM treatments GROUP BY 1) SELECT id, volume FROM k LEFT JOIN m USING (key)", "treatments"))
def j17(spark: SparkSession, d: str) -> DataFrame:
    key = F.regexp_replace(F.lower("category"), " (tin|brass)$", "").alias("key")
    m = treatments(spark, d).groupBy(key).agg(F.sum("size").alias("volume"))
    return treatments(spark, d).select("id", key).join(m, "key", "left").select("id", "volume")


@query("e7_hydrated_locations", sql(""", t AS (SELECT o.location_id AS id, t.name, t.category, row_number() OVER (PARTITION BY o.location_id ORDER BY t.name, t.id) AS turn FROM (SELECT DISTINCT location_id, treatment_id FROM offerings) o JOIN treatments t ON t.id = o.treatment_id),
n AS (SELECT id, string_agg(name, ',' ORDER BY turn) AS treatments FROM t WHERE turn <= 6 GROUP BY 1) SELECT l.id, l.name, coalesce(treatments, '') AS treatments, canonical_name FROM locations l LEFT JOIN n USING (id) LEFT JOIN organizations g USING (org_id)""", "locations", "offerings", "treatments", "organizations"))
def e7(spark: SparkSession, d: str) -> DataFrame:
    """Locations with six of their treatments and their organization."""
    t = treatments(spark, d).select(F.col("id").alias("treatment_id"), "name")
    o = offerings(spark, d).select("location_id", "treatment_id").distinct().join(t, "treatment_id")
    o = o.withColumn("turn", F.row_number().over(Window.partitionBy("location_id").orderBy("name", "treatment_id"))).where("turn <= 6")
    n = o.groupBy(F.col("location_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "name"))), lambda x: x["name"]), ",").alias("treatments"))
    return locations(spark, d).join(n, "id", "left").join(organizations(spark, d), "org_id", "left").select("id", "name", F.coalesce("treatments", F.lit("")).alias("treatments"), "canonical_name")


@query("e8_practitioners", "SELECT s_suppkey AS id, s_name AS name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 48) ORDER BY s_acctbal DESC, s_suppkey LIMIT 18")
def e8(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, d, "supplier").join(seen, "s_suppkey", "left_semi").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(18).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query("e9_location_detail", sql("SELECT l.id, l.name, (SELECT count(*) FROM offerings o WHERE o.location_id = l.id) AS offerings, (SELECT count(*) FROM locations s WHERE s.org_id = l.org_id AND s.id <> l.id) AS siblings FROM locations l WHERE l.id = 42", "locations", "offerings"))
def e9(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).where("id = 42").select("id", "name", "org_id")
    o = offerings(spark, d).where("location_id = 42").agg(F.count("*").alias("offerings")).withColumn("id", F.lit(42).cast("bigint"))
    s = locations(spark, d).where("id <> 42").join(l.select("org_id"), "org_id", "left_semi").groupBy("org_id").agg(F.count("*").alias("siblings"))
    return l.join(o, "id", "left").join(s, "org_id", "left").select("id", "name", "offerings", F.coalesce("siblings", F.lit(0).cast("bigint")).alias("siblings"))


@query("e11_review_groups", sql(", r AS (SELECT author, id, lang, row_number() OVER (PARTITION BY author, lang ORDER BY n_chars DESC, id) AS turn, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS priority FROM reviews) SELECT author, priority, string_agg(id, ',' ORDER BY turn, id) AS ids FROM r WHERE turn <= 5 GROUP BY 1, 2", "reviews"))
def e11(spark: SparkSession, d: str) -> DataFrame:
    r = reviews(spark, d).select("author", "id", "lang", "n_chars")
    r = r.withColumn("turn", F.row_number().over(Window.partitionBy("author", "lang").orderBy(F.desc("n_chars"), "id"))).where("turn <= 5")
    r = r.withColumn("priority", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2))
    return r.groupBy("author", "priority").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("e12_related_searches", sql(", c AS (SELECT country_code, locality, count(*) AS n FROM locations GROUP BY 1, 2), s AS (SELECT l.country_code, l.locality, o.treatment_id, count(*) AS k FROM offerings o JOIN locations l ON l.id = o.location_id GROUP BY 1, 2, 3) SELECT country_code, locality, treatment_id FROM (SELECT s.*, row_number() OVER (PARTITION BY country_code, locality ORDER BY k DESC, treatment_id) AS turn FROM s JOIN c USING (country_code, locality) WHERE n >= 8) WHERE turn <= 3", "locations", "offerings"))
def e12(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).select(F.col("id").alias("location_id"), "country_code", "locality")
    c = l.groupBy("country_code", "locality").agg(F.count("*").alias("n")).where("n >= 8")
    s = offerings(spark, d).join(l, "location_id").groupBy("country_code", "locality", "treatment_id").agg(F.count("*").alias("k")).join(c, ["country_code", "locality"])
    turn = F.row_number().over(Window.partitionBy("country_code", "locality").orderBy(F.desc("k"), "treatment_id"))
    return s.withColumn("turn", turn).where("turn <= 3").select("country_code", "locality", "treatment_id")


@query("e13_s11_landing_cards", sql(", p AS (SELECT id, name, 0 AS source, row_number() OVER (ORDER BY review_count DESC NULLS LAST, id) AS place FROM locations WHERE rating = 4 QUALIFY place <= 30), f AS (SELECT id, name, 1 AS source, row_number() OVER (ORDER BY id) AS place FROM locations WHERE status = 'active' QUALIFY place <= 60) SELECT id, name, source, place FROM (SELECT * FROM p UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, place) = 1", "locations"))
def e13(spark: SparkSession, d: str) -> DataFrame:
    """Two top-k lists in turn, each row where it came first. The windows number only the rows of a top-k."""
    l = locations(spark, d)
    top = l.where("rating = 4").orderBy(F.desc_nulls_last("review_count"), "id").limit(30).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("review_count"), "id"))).withColumn("source", F.lit(0))
    rest = active(l).orderBy("id").limit(60).withColumn("place", F.row_number().over(Window.orderBy("id"))).withColumn("source", F.lit(1))
    both = top.select("id", "name", "source", "place").unionByName(rest.select("id", "name", "source", "place"))
    return both.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("source", "place"))).where("turn = 1").drop("turn")


@query("e18_sitemap", sql("SELECT l.id, o.id IS NOT NULL AS has_offering, p.page_id IS NOT NULL AS has_image FROM locations l LEFT JOIN (SELECT DISTINCT location_id AS id FROM offerings) o ON o.id = l.id LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON p.page_id = l.id WHERE l.status = 'active' AND (o.id IS NOT NULL OR p.page_id IS NOT NULL)", "locations", "offerings"))
def e18(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).select(F.col("location_id").alias("id")).distinct().withColumn("o", F.lit(True))
    p = read(spark, d, "pages").select(F.col("page_id").alias("id")).distinct().withColumn("p", F.lit(True))
    l = active(locations(spark, d)).select("id").join(o, "id", "left").join(p, "id", "left")
    return l.select("id", F.coalesce("o", F.lit(False)).alias("has_offering"), F.coalesce("p", F.lit(False)).alias("has_image")).where("has_offering OR has_image")


@query("d14_import_dedupe", sql(", e AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS k FROM documents WHERE lang = 'en'), x AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS k, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS turn FROM documents WHERE lang <> 'en') SELECT id FROM x WHERE turn = 1 AND k NOT IN (SELECT k FROM e)", "reviews"))
def d14(spark: SparkSession, d: str) -> DataFrame:
    r = reviews(spark, d).select("id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("k"))
    first = r.where("lang <> 'en'").groupBy("k").agg(F.min("id").alias("id"))
    return first.join(r.where("lang = 'en'"), "k", "left_anti").select("id")


@query("d16_shadow_retirement", sql("SELECT id, winner FROM (SELECT s.id, w.id AS winner, row_number() OVER (PARTITION BY s.id ORDER BY w.price_amount, w.id) AS turn FROM offerings s JOIN offerings w ON w.location_id = s.location_id AND w.treatment_id = s.treatment_id AND w.price_amount IS NOT NULL WHERE s.price_amount IS NULL) WHERE turn = 1", "offerings"))
def d16(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d)
    w = o.where("price_amount IS NOT NULL").groupBy("location_id", "treatment_id").agg(F.min(F.struct("price_amount", "id")).alias("w"))
    return o.where("price_amount IS NULL").join(w, ["location_id", "treatment_id"]).select("id", F.col("w.id").alias("winner"))


@query("q3_drift_gate", sql(", a AS (SELECT id FROM locations WHERE rating IS NULL), b AS (SELECT id FROM locations WHERE rating IS NULL AND id % 50 <> 0), x AS (SELECT count(*) AS n FROM (SELECT id FROM a EXCEPT SELECT id FROM b)), y AS (SELECT count(*) AS n FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) SELECT x.n + y.n AS drift, x.n + y.n = 0 AS ready FROM x, y", "locations"))
def q3(spark: SparkSession, d: str) -> DataFrame:
    from brightfield.plans.ledgers import drift

    a = locations(spark, d).where("rating IS NULL").select("id")
    return drift(a, a.where("id % 50 <> 0")).agg(F.count("*").alias("drift"), (F.count("*") == 0).alias("ready"))


@query("r1_opening_hours", "SELECT user_id, string_agg(day || ':' || n, ',' ORDER BY day) AS hours FROM (SELECT u.user_id, d.day, coalesce(e.n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(1, 8)) AS day) d LEFT JOIN (SELECT user_id, isodow(ts) AS day, count(*) AS n FROM events GROUP BY 1, 2) e ON e.user_id = u.user_id AND e.day = d.day) GROUP BY 1")
def r1(spark: SparkSession, d: str) -> DataFrame:
    """Seven days in order for every user: one grouped pass, no cross join."""
    e = read(spark, d, "events").withColumn("day", F.weekday("ts") + 1)
    days = [F.concat(F.lit(f"{k}:"), F.count_if(F.col("day") == k).cast("string")) for k in range(1, 8)]
    return e.groupBy("user_id").agg(F.concat_ws(",", *days).alias("hours"))


@query("r2_json_without_nulls", sql("SELECT id, CASE WHEN rating IS NULL THEN to_json(struct_pack(id := id)) ELSE to_json(struct_pack(id := id, rating := rating)) END AS json FROM locations", "locations"))
def r2(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).select("id", F.to_json(F.struct("id", "rating")).alias("json"))


@query("r4_json_length", "SELECT event_id, CAST(json_array_length('[' || props || ',1]') AS INT) AS n FROM events WHERE event_type = 'view'")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'view'").select("event_id", F.json_array_length(F.concat(F.lit("["), "props", F.lit(",1]"))).alias("n"))


@query("s2_case_insensitive", sql("SELECT id, category FROM treatments ORDER BY lower(category), id LIMIT 40", "treatments"))
def s2(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).orderBy(F.lower("category"), "id").limit(40).select("id", "category")


@query("s12_chips", sql("SELECT location_id, treatment_id, turn FROM (SELECT location_id, treatment_id, row_number() OVER (PARTITION BY location_id ORDER BY CASE WHEN treatment_id % 10 = 3 THEN 0 ELSE 1 END, treatment_id) AS turn FROM (SELECT DISTINCT location_id, treatment_id FROM offerings)) WHERE turn <= 6", "offerings"))
def s12(spark: SparkSession, d: str) -> DataFrame:
    o = offerings(spark, d).select("location_id", "treatment_id").distinct()
    turn = F.row_number().over(Window.partitionBy("location_id").orderBy(F.when(F.col("treatment_id") % 10 == 3, 0).otherwise(1), "treatment_id"))
    return o.withColumn("turn", turn).where("turn <= 6")


@query("s14_suggestions", sql(", u AS (SELECT 0 AS source, country_code AS label, count(*) AS n FROM locations GROUP BY 2 UNION ALL SELECT 1, upper(locality), count(*) FROM locations GROUP BY 2 UNION ALL SELECT 2, n_name, 0 FROM nation) SELECT label, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY source, n DESC) AS turn FROM u) WHERE turn = 1", "locations"))
def s14(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    u = l.groupBy(F.lit(0).alias("source"), F.col("country_code").alias("label")).agg(F.count("*").alias("n"))
    u = u.unionByName(l.groupBy(F.lit(1).alias("source"), F.upper("locality").alias("label")).agg(F.count("*").alias("n")))
    u = u.unionByName(read(spark, d, "nation").select(F.lit(2).alias("source"), F.col("n_name").alias("label"), F.lit(0).cast("bigint").alias("n")))
    turn = F.row_number().over(Window.partitionBy(text.fold(F.col("label"))).orderBy("source", F.desc("n")))
    return u.withColumn("turn", turn).where("turn = 1").select("label", "source")


@query("z3_hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def z3(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the windowed stream."""
    e = read(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


# ---- files there and back ----


@query("c9_c12_delimited", sql("SELECT id, name, category, brand || ', \"' || brand || '\"' AS brand, CAST(parent_id AS VARCHAR) AS parent_id FROM treatments".replace('\\"', '"'), "treatments"))
def c9(spark: SparkSession, d: str) -> DataFrame:
    """Written with quotes where needed and read back: quotes, commas and nulls survive."""
    t = treatments(spark, d).select("id", "name", "category", F.concat("brand", F.lit(', "'), "brand", F.lit('"')).alias("brand"), F.col("parent_id").cast("string"))
    path = place_for(spark, "csv")
    files.write_delimited(t, path)
    return files.read_delimited(spark, path).withColumn("id", F.col("id").cast("bigint"))


@query("c10_report", "SELECT lower(p_name) || ' ' || p_partkey AS keyword, p_size || ',000' AS avg_monthly_searches, p_type AS competition FROM part WHERE p_partkey % 9 <> 4")
def c10(spark: SparkSession, d: str) -> DataFrame:
    """A report with lines of preamble before its header, blank keywords and cells with line breaks, read back by its header."""
    path = place_for(spark, "report")
    line = F.format_string('"%s","%s,000",%s,"a\n""b"""', F.when(F.col("p_partkey") % 9 == 4, " ").otherwise(F.concat(F.lower("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))), F.col("p_size").cast("string"), "p_type")
    body = read(spark, d, "part").select(F.lit(1).alias("turn"), line.alias("value"))
    head = spark.createDataFrame([(0, 'Keyword report\n"1 Jan - 2 Feb, all"\n\nKeyword,Avg. Monthly Searches (exact),Competition,Note')], "turn int, value string")
    head.unionByName(body).repartition(1).sortWithinPartitions("turn").select("value").write.text(path)  # a report is one file
    return files.read_planner(spark, path).select("keyword", F.col("avg_monthly_searches_exact").alias("avg_monthly_searches"), "competition")


@query("c11_semicolons", sql("SELECT id, name || ';x' AS name FROM treatments", "treatments"))
def c11(spark: SparkSession, d: str) -> DataFrame:
    path = place_for(spark, "csv")
    files.write_delimited(treatments(spark, d).select("id", F.concat("name", F.lit(";x")).alias("name")), path, ";")
    return files.read_delimited(spark, path, ";").withColumn("id", F.col("id").cast("bigint"))


@query("c13_csv_objects", sql("SELECT id, to_json(struct_pack(id := CAST(id AS VARCHAR), name := name)) AS object FROM treatments", "treatments"))
def c13(spark: SparkSession, d: str) -> DataFrame:
    """Every row of delimited text as an object of its cells."""
    path = place_for(spark, "csv")
    files.write_delimited(treatments(spark, d).select("id", "name"), path)
    rows = files.read_delimited(spark, path)
    return rows.select(F.col("id").cast("bigint").alias("id"), F.to_json(F.struct(*rows.columns)).alias("object"))


@query("c14_json_lines", sql("SELECT id, task_type, cost FROM tasks", "tasks"))
def c14(spark: SparkSession, d: str) -> DataFrame:
    path = place_for(spark, "json")
    files.write_json_lines(tasks(spark, d).select("id", "task_type", "cost"), path)
    return files.read_json_lines(spark, path, "id bigint, task_type string, cost double")


@query("c16_append_returning", sql("SELECT id FROM locations WHERE is_virtual", "locations"))
def c16(spark: SparkSession, d: str) -> DataFrame:
    return files.append_returning(spark, locations(spark, d).where("is_virtual"), place_for(spark, "appended"), ["id"])


@query("c21_backup", sql("SELECT count(*) AS rows, count(rating) AS rated, CAST(sum(id) AS BIGINT) AS ids FROM locations", "locations"))
def c21(spark: SparkSession, d: str) -> DataFrame:
    """A copy of a table, checked by what it holds."""
    path = place_for(spark, "backup")
    locations(spark, d).write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.count("rating").alias("rated"), F.sum("id").alias("ids"))
