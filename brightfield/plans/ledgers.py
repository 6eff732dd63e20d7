"""Windows, set operations, samples, queues and ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightfield.functions import pricing
from brightfield.operators.ranges import rolling
from brightfield.registry import query
from brightfield.roles import active, import_in_workers, locations, offerings, read, reviews, sql, tasks, treatments

# ---- windows ----


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], most: int = 1) -> DataFrame:
    """The first rows of every key by an order."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__turn", turn).where(F.col("__turn") <= most).drop("__turn")


@query("w1_best_per_rank", sql("SELECT region, id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY rating IS NULL, rating DESC, review_count IS NULL, review_count DESC, id) AS turn FROM locations) WHERE turn = 1", "locations"))
def w1(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(locations(spark, d), ["region"], [F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), "id"]).select("region", "id")


_NORMAL = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query("w2_d13_review_dedupe", sql(f"SELECT id, row_number() OVER w AS turn, first_value(id) OVER w AS winner, count(*) OVER (PARTITION BY md5({_NORMAL})) AS copies FROM reviews WINDOW w AS (PARTITION BY md5({_NORMAL}) ORDER BY n_chars DESC NULLS LAST, id)", "reviews"))
def w2(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal normalised text, their winner and size; keyed by digest, so that texts are not shuffled."""
    r = reviews(spark, d).select("id", "n_chars", F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "\\s+", " "))).alias("key"))
    group = Window.partitionBy("key")
    order = group.orderBy(F.desc_nulls_last("n_chars"), "id")
    return r.select("id", F.row_number().over(order).alias("turn"), F.first("id").over(order).alias("winner"), F.count("*").over(group).alias("copies"))


@query("d13_dedupe_report", sql(f", g AS (SELECT md5({_NORMAL}) AS k, count(*) AS n FROM reviews GROUP BY 1) SELECT count(*) FILTER (WHERE n > 1) AS groups_found, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS rows_deleted FROM g", "reviews"))
def d13(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "\\s+", " ")))
    return reviews(spark, d).groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups_found"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("rows_deleted"))


@query("w3_newest_first", sql("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY rating DESC NULLS LAST, id) AS turn FROM locations) WHERE turn = 1", "locations"))
def w3(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(locations(spark, d), ["org_id"], [F.desc_nulls_last("rating"), "id"]).select("id")


@query("w4_latest_by_payload", sql("SELECT entity_id, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CAST(json_extract_string(payload, '$.k') AS INT) DESC, id DESC) AS turn FROM tasks) WHERE turn = 1", "tasks"))
def w4(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(tasks(spark, d), ["entity_id"], [F.get_json_object("payload", "$.k").try_cast("int").desc(), F.desc("id")]).select("entity_id", "id")


@query("w5_round_robin_sample", sql(", r AS (SELECT id, country_code, md5('s7:' || id) AS h, row_number() OVER (PARTITION BY country_code ORDER BY md5('s7:' || id)) AS turn FROM locations) SELECT id, country_code FROM r ORDER BY turn, h LIMIT 60", "locations"))
def w5(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).select("id", "country_code", F.md5(F.concat(F.lit("s7:"), "id")).alias("h"))
    l = l.withColumn("turn", F.row_number().over(Window.partitionBy("country_code").orderBy("h")))
    return l.orderBy("turn", "h").limit(60).select("id", "country_code")


@query("w6_total_and_first", sql("SELECT org_id, id, total FROM (SELECT *, count(*) OVER (PARTITION BY org_id) AS total, row_number() OVER (PARTITION BY org_id ORDER BY id) AS turn FROM locations) WHERE turn <= 5", "locations"))
def w6(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).withColumn("total", F.count("*").over(Window.partitionBy("org_id")))
    return first_rows(l, ["org_id"], ["id"], 5).select("org_id", "id", "total")


_TIER = "CASE price_unit WHEN 'service' THEN 0 WHEN 'session' THEN 1 WHEN 'visit' THEN 1 WHEN 'package' THEN 2 ELSE 3 END"


@query("w7_cheapest_comparable", sql("SELECT location_id, id, price_amount FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY price_amount, id) AS turn FROM offerings WHERE price_amount > 0 AND price_unit IN ('service', 'session', 'visit') AND price_audience = 'retail') WHERE turn = 1", "offerings"))
def w7(spark: SparkSession, d: str) -> DataFrame:
    """The least row by an aggregate, which combines before the shuffle, instead of a window."""
    o = offerings(spark, d)
    o = o.where(pricing.comparable(o["price_amount"], o["price_unit"], o["price_audience"]))
    return o.groupBy("location_id").agg(F.min(F.struct("price_amount", "id")).alias("x")).select("location_id", "x.id", "x.price_amount")


@query("w8_price_by_tier", sql(f"SELECT location_id, id FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY {_TIER}, price_amount, id) AS turn FROM offerings WHERE price_amount > 0) WHERE turn = 1", "offerings"))
def w8(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("price_unit")
    tier = F.when(u == "service", 0).when(u.isin("session", "visit"), 1).when(u == "package", 2).otherwise(3)
    o = offerings(spark, d).where("price_amount > 0").withColumn("tier", tier)
    return o.groupBy("location_id").agg(F.min(F.struct("tier", "price_amount", "id")).alias("x")).select("location_id", "x.id")


@query("w9_latest_verification", sql("SELECT entity_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS turn FROM tasks WHERE task_type = 'purchase') WHERE turn = 1", "tasks"))
def w9(spark: SparkSession, d: str) -> DataFrame:
    t = tasks(spark, d).where("task_type = 'purchase'")
    return t.groupBy("entity_id").agg(F.max(F.struct("created_at", "id")).alias("x")).select("entity_id", "x.id", "x.created_at")


@query("w12_failure_halt", sql(", o AS (SELECT task_type, id, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS bad FROM tasks), r AS (SELECT task_type, id, CAST(sum(bad) OVER w AS BIGINT) AS failures, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY task_type ORDER BY id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)) SELECT task_type, min(id) AS halted_at FROM r WHERE n = 500 AND failures * 4 > n GROUP BY 1", "tasks"))
def w12(spark: SparkSession, d: str) -> DataFrame:
    """Per task type, the first task at which more than a quarter of the last 500 outcomes are failures."""
    t = rolling(tasks(spark, d).select("task_type", "id", "status"), ["task_type"], ["id"], 500, failures=(F.col("status") == "failed").cast("bigint"))
    return t.where("window_rows = 500 AND failures * 4 > window_rows").groupBy("task_type").agg(F.min("id").alias("halted_at"))


@query("w13_first_image", "SELECT host, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url LIKE '%blog%' DESC, length(html) DESC NULLS LAST, page_id DESC) AS turn FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)) WHERE turn = 1")
def w13(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.col("url").contains("blog").alias("logo"), F.char_length("html").alias("n"))
    return first_rows(p, ["host"], [F.desc("logo"), F.desc_nulls_last("n"), F.desc("page_id")]).select("host", "page_id")


@query("w14_top_reviews", sql("SELECT author, id FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n_chars DESC, id) AS turn FROM reviews) WHERE turn <= 5", "reviews"))
def w14(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(reviews(spark, d).select("author", "id", "n_chars"), ["author"], [F.desc("n_chars"), "id"], 5).select("author", "id")


# ---- sets ----


@query("u1_union_all", sql("SELECT id, 'a' AS kind FROM locations WHERE rating IS NULL UNION ALL SELECT id, 'b' FROM locations WHERE is_virtual", "locations"))
def u1(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    return l.where("rating IS NULL").select("id", F.lit("a").alias("kind")).unionByName(l.where("is_virtual").select("id", F.lit("b").alias("kind")))


@query("u2_union", sql("SELECT lower(name) AS label FROM treatments UNION SELECT lower(category) FROM treatments", "treatments"))
def u2(spark: SparkSession, d: str) -> DataFrame:
    t = treatments(spark, d)
    return t.select(F.lower("name").alias("label")).unionByName(t.select(F.lower("category").alias("label"))).distinct()


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame alone, with their side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


@query("u3_drift", sql(", a AS (SELECT id, rating FROM locations WHERE id % 9 <> 0), b AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE rating END AS rating FROM locations WHERE id % 8 <> 0) (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))", "locations"))
def u3(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    a = l.where("id % 9 <> 0").select("id", "rating")
    return drift(a, l.where("id % 8 <> 0").select("id", F.when(F.col("id") % 11 != 0, F.col("rating")).alias("rating")))


@query("u4_array_union", sql(", s AS (SELECT location_id, list_sort(list_distinct(list(price_unit) FILTER (WHERE price_currency = 'N'))) AS a, list_sort(list_distinct(list(price_unit) FILTER (WHERE price_currency = 'R'))) AS b FROM offerings GROUP BY 1) SELECT location_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS units FROM s", "offerings"))
def u4(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c: F.collect_set(F.when(F.col("price_currency") == c, F.col("price_unit")))
    return offerings(spark, d).groupBy("location_id").agg(F.array_join(F.array_sort(F.array_union(pick("N"), pick("R"))), ",").alias("units"))


@query("u5_resolved_and_new", sql(", a AS (SELECT org_id, id FROM locations WHERE rating IS NULL), b AS (SELECT org_id, id FROM locations WHERE review_count < 10 OR rating IS NULL AND id % 2 = 0) SELECT coalesce(a.org_id, b.org_id) AS org_id, count(*) FILTER (WHERE b.id IS NULL) AS resolved, count(*) FILTER (WHERE a.id IS NULL) AS added FROM a FULL JOIN b ON a.id = b.id GROUP BY 1", "locations"))
def u5(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    a = l.where("rating IS NULL").groupBy("org_id").agg(F.collect_set("id").alias("a"))
    b = l.where("review_count < 10 OR rating IS NULL AND id % 2 = 0").groupBy("org_id").agg(F.collect_set("id").alias("b"))
    none = F.array().cast("array<bigint>")
    both = a.join(b, "org_id", "full").select("org_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.select("org_id", F.size(F.array_except("a", "b")).cast("bigint").alias("resolved"), F.size(F.array_except("b", "a")).cast("bigint").alias("added"))


@query("u6_before_after", sql(", a AS (SELECT country_code, count(*) AS n FROM locations WHERE id % 2 = 0 AND region <> 4 GROUP BY 1), b AS (SELECT country_code, count(*) AS n FROM locations WHERE id % 3 = 0 AND region <> 0 GROUP BY 1) SELECT coalesce(a.country_code, b.country_code) AS country_code, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (country_code)", "locations"))
def u6(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d)
    a = l.where("id % 2 = 0 AND region <> 4").groupBy("country_code").agg(F.count("*").alias("n_before"))
    b = l.where("id % 3 = 0 AND region <> 0").groupBy("country_code").agg(F.count("*").alias("n_after"))
    return a.join(b, "country_code", "full").fillna(0, ["n_before", "n_after"]).withColumn("change", F.col("n_after") - F.col("n_before"))


@query("u7_first_seen", sql("SELECT keyword, id FROM (SELECT lower(category) AS keyword, id, row_number() OVER (PARTITION BY lower(category) ORDER BY size DESC, category, id) AS turn FROM treatments) WHERE turn = 1", "treatments"))
def u7(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(treatments(spark, d).withColumn("keyword", F.lower("category")), ["keyword"], [F.desc("size"), "category", "id"]).select("keyword", "id")


# ---- census and samples ----


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """The wide coverage table: a row per location with its flags and counts."""
    o = offerings(spark, d).groupBy(F.col("location_id").alias("id")).agg(F.count("*").alias("menu"), F.count("price_amount").alias("priced"))
    l = locations(spark, d).join(o, "id", "left").fillna(0, ["menu", "priced"])
    return l.select("id", "country_code", "status", F.col("rating").isNotNull().alias("has_rating"), (F.col("menu") > 0).alias("has_menu"), (F.col("priced") > 0).alias("has_price"), "menu", "priced", "review_count")


_COVERAGE = ", o AS (SELECT location_id AS id, count(*) AS menu, count(price_amount) AS priced FROM offerings GROUP BY 1), coverage AS (SELECT l.id, country_code, status, rating IS NOT NULL AS has_rating, coalesce(menu, 0) > 0 AS has_menu, coalesce(priced, 0) > 0 AS has_price, coalesce(menu, 0) AS menu, coalesce(priced, 0) AS priced, review_count FROM locations l LEFT JOIN o USING (id))"


@query("q2_coverage", sql(_COVERAGE + " SELECT * FROM coverage", "locations", "offerings"))
def q2(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d)


@query("a25_coverage_summary", sql(_COVERAGE + ", u AS (UNPIVOT (SELECT country_code, has_rating, has_menu, has_price FROM coverage) ON has_rating, has_menu, has_price INTO NAME field VALUE ok) SELECT country_code, field, count(*) FILTER (WHERE ok) AS covered, count(*) FILTER (WHERE NOT ok) AS missing, floor(10000.0 * count(*) FILTER (WHERE ok) / count(*) + 0.5) / 100 AS pct FROM u GROUP BY 1, 2", "locations", "offerings"))
def a25(spark: SparkSession, d: str) -> DataFrame:
    u = coverage(spark, d).unpivot(["country_code"], ["has_rating", "has_menu", "has_price"], "field", "ok")
    ok = F.count_if("ok")
    return u.groupBy("country_code", "field").agg(ok.alias("covered"), F.count_if(~F.col("ok")).alias("missing"), (F.floor(10000.0 * ok / F.count("*") + 0.5) / 100).alias("pct"))


@query("a26_gap_cohorts", sql(_COVERAGE + ", g AS (SELECT country_code, 'rating' AS gap, id FROM coverage WHERE NOT has_rating UNION ALL SELECT country_code, 'price', id FROM coverage WHERE has_menu AND NOT has_price UNION ALL SELECT country_code, 'reviews', id FROM coverage WHERE coalesce(review_count, 0) < 3) SELECT country_code, gap, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS digest FROM g GROUP BY 1, 2", "locations", "offerings"))
def a26(spark: SparkSession, d: str) -> DataFrame:
    gaps = F.array_compact(F.array(F.when(~F.col("has_rating"), F.lit("rating")), F.when(F.col("has_menu") & ~F.col("has_price"), F.lit("price")), F.when(F.coalesce("review_count", F.lit(0)) < 3, F.lit("reviews"))))
    return ordered_digests(coverage(spark, d).select("country_code", F.explode(gaps).alias("gap"), "id"))


def ordered_digests(cohorts: DataFrame) -> DataFrame:
    """(country_code, gap, n, digest): SHA-256 of the ids of a cohort, ascending and comma-joined.

    The rows of a cohort pass by in order and go into the digest at once, so no row or task holds a cohort's ids together.
    """
    import_in_workers(cohorts.sparkSession)
    keys = ["country_code", "gap"]
    ordered = cohorts.select(*keys, "id").repartition(*keys).sortWithinPartitions(*keys, "id")
    return ordered.mapInArrow(_digests_of_runs, "country_code string, gap string, n long, digest string")


def _digests_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["country_code", "gap", "n", "digest"], (pa.string(), pa.string(), pa.int64(), pa.string())
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    key, n, known, sha = None, 0, 0, hashlib.sha256()
    for batch in batches:
        done = []
        country, gap, ids = (c.to_pylist() for c in batch.columns)
        for k, run in groupby(range(len(ids)), lambda i: (country[i], gap[i])):
            if k != key:
                if n:
                    done.append((*key, n, sha.hexdigest() if known else None))
                key, n, known, sha = k, 0, 0, hashlib.sha256()
            rows = [ids[i] for i in run]
            some = [str(x) for x in rows if x is not None]
            sha.update(("," * (known > 0 and len(some) > 0) + ",".join(some)).encode())
            n, known = n + len(rows), known + len(some)
        if done:
            yield batch_of(done)
    if n:
        yield batch_of([(*key, n, sha.hexdigest() if known else None)])


@query("q1_stratified_sample", sql(", s AS (SELECT id, country_code, row_number() OVER (PARTITION BY country_code ORDER BY md5('seed1:' || country_code || ':' || id), id) AS turn FROM locations WHERE status = 'active') SELECT id, country_code FROM s WHERE turn <= 8", "locations"))
def q1(spark: SparkSession, d: str) -> DataFrame:
    """The same rows for the same seed, whatever the partitioning."""
    l = active(locations(spark, d)).select("id", "country_code")
    return first_rows(l, ["country_code"], [F.md5(F.concat(F.lit("seed1:"), "country_code", F.lit(":"), "id")), "id"], 8)


@query("q4_post_contact", sql("SELECT id FROM locations l WHERE rating IS NULL AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.entity_id = l.id AND t.task_type = 'click')", "locations", "tasks"))
def q4(spark: SparkSession, d: str) -> DataFrame:
    done = tasks(spark, d).where("task_type = 'click'").select(F.col("entity_id").alias("id"))
    return locations(spark, d).where("rating IS NULL").join(done, "id", "left_anti").select("id")


@query("q5_enqueue_preview", sql(", c AS (SELECT id FROM locations WHERE rating IS NULL) SELECT count(*) AS n, array_to_string(list_sort(list(id))[1:10], ',') AS first_ids FROM c", "locations"))
def q5(spark: SparkSession, d: str) -> DataFrame:
    """The count and the ten least ids: the ids by a top-k, not by collecting all."""
    c = locations(spark, d).where("rating IS NULL").select("id")
    least = c.orderBy("id").limit(10).agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return c.agg(F.count("*").alias("n")).join(F.broadcast(least))  # one row each


@query("q6_enqueue", sql(", c AS (SELECT id AS entity_id FROM locations WHERE rating IS NULL), o AS (SELECT DISTINCT entity_id FROM tasks WHERE status IN ('pending', 'claimed')) SELECT (SELECT count(*) FROM c) AS selected, (SELECT count(*) FROM c WHERE entity_id NOT IN (SELECT entity_id FROM o)) AS inserted", "locations", "tasks"))
def q6(spark: SparkSession, d: str) -> DataFrame:
    c = locations(spark, d).where("rating IS NULL").select(F.col("id").alias("entity_id"))
    o = tasks(spark, d).where("status IN ('pending', 'claimed')").select("entity_id").distinct().withColumn("open", F.lit(True))
    return c.join(o, "entity_id", "left").agg(F.count("*").alias("selected"), F.count_if(F.col("open").isNull()).alias("inserted"))


@query("q7_claim_batch", sql("SELECT id, attempts + 1 AS attempts, 'claimed' AS status FROM tasks WHERE status = 'pending' AND attempts < 2 ORDER BY priority, id LIMIT 25", "tasks"))
def q7(spark: SparkSession, d: str) -> DataFrame:
    """What one claim takes: the first pending tasks with attempts left."""
    t = tasks(spark, d).where("status = 'pending' AND attempts < 2").orderBy("priority", "id").limit(25)
    return t.select("id", (F.col("attempts") + 1).alias("attempts"), F.lit("claimed").alias("status"))


@query("q8_transition", sql("SELECT id, CASE WHEN status = 'failed' AND attempts < 2 AND task_type <> 'purchase' THEN 'pending' WHEN status = 'claimed' THEN 'completed' ELSE status END AS status FROM tasks", "tasks"))
def q8(spark: SparkSession, d: str) -> DataFrame:
    retry = (F.col("status") == "failed") & (F.col("attempts") < 2) & (F.col("task_type") != "purchase")
    return tasks(spark, d).select("id", F.when(retry, "pending").when(F.col("status") == "claimed", "completed").otherwise(F.col("status")).alias("status"))


@query("q9_reap_stale", sql(", m AS (SELECT max(created_at) - INTERVAL 30 MINUTE AS cutoff FROM tasks) SELECT id FROM tasks, m WHERE status = 'claimed' AND created_at < cutoff", "tasks"))
def q9(spark: SparkSession, d: str) -> DataFrame:
    """Claims older than half an hour before the newest task; one at the cutoff stays."""
    t = tasks(spark, d)
    cutoff = t.agg((F.max("created_at") - F.expr("INTERVAL 30 MINUTES")).alias("cutoff"))
    return t.where("status = 'claimed'").join(F.broadcast(cutoff), F.col("created_at") < F.col("cutoff")).select("id")


@query("q10_backlog", sql("SELECT task_type, status, count(*) AS n FROM tasks GROUP BY 1, 2", "tasks"))
def q10(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).groupBy("task_type", "status").agg(F.count("*").alias("n"))


@query("q11_budget", sql(", c AS (SELECT task_type, CAST(sum(CAST(cost AS DECIMAL(18, 4))) AS DOUBLE) AS spent FROM tasks GROUP BY 1) SELECT task_type, spent, spent >= 5000 AS exhausted FROM c", "tasks"))
def q11(spark: SparkSession, d: str) -> DataFrame:
    c = tasks(spark, d).groupBy("task_type").agg(F.sum(F.col("cost").cast("decimal(18,4)")).cast("double").alias("spent"))
    return c.withColumn("exhausted", F.col("spent") >= 5000)


@query("q12_write_guard", sql("SELECT id FROM locations WHERE rating IS NULL AND org_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000)", "locations"))
def q12(spark: SparkSession, d: str) -> DataFrame:
    locked = read(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("org_id"))
    return locations(spark, d).where("rating IS NULL").join(locked, "org_id", "left_anti").select("id")


@query("q13_adopt_or_insert", sql(", w AS (SELECT id AS entity_id, id % 3 AS priority FROM locations), o AS (SELECT entity_id, min(priority) AS priority, max(attempts) AS attempts FROM tasks WHERE status = 'pending' GROUP BY 1) SELECT entity_id, least(w.priority, coalesce(o.priority, w.priority)) AS priority, coalesce(o.attempts, 0) AS attempts, o.entity_id IS NOT NULL AS adopted FROM w LEFT JOIN o USING (entity_id)", "locations", "tasks").replace("o.entity_id IS NOT NULL", "o.attempts IS NOT NULL"))
def q13(spark: SparkSession, d: str) -> DataFrame:
    w = locations(spark, d).select(F.col("id").alias("entity_id"), (F.col("id") % 3).alias("priority"))
    o = tasks(spark, d).where("status = 'pending'").groupBy("entity_id").agg(F.min("priority").alias("old"), F.max("attempts").alias("tries"))
    return w.join(o, "entity_id", "left").select("entity_id", F.least("priority", F.coalesce("old", "priority")).alias("priority"), F.coalesce("tries", F.lit(0)).alias("attempts"), F.col("tries").isNotNull().alias("adopted"))


@query("q14_suppression_cohort", sql(", c AS (SELECT doc_id AS id FROM labels WHERE quality = 0), bad AS (SELECT org_id FROM locations JOIN c USING (id) GROUP BY 1 HAVING count(*) > 3) SELECT l.id FROM locations l JOIN c USING (id) WHERE org_id NOT IN (SELECT org_id FROM bad)", "locations"))
def q14(spark: SparkSession, d: str) -> DataFrame:
    c = locations(spark, d).join(read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id")), "id").select("id", "org_id")
    return c.join(c.groupBy("org_id").agg(F.count("*").alias("n")).where("n > 3"), "org_id", "left_anti").select("id")


@query("q15_reconcile", sql(", e AS (SELECT id FROM locations WHERE status = 'active'), g AS (SELECT entity_id AS id, count(*) AS n FROM tasks WHERE task_type = 'signup' GROUP BY 1) SELECT 'missing' AS kind, e.id FROM e LEFT JOIN g USING (id) WHERE g.n IS NULL UNION ALL SELECT 'unexpected', g.id FROM g LEFT JOIN e ON e.id = g.id WHERE e.id IS NULL UNION ALL SELECT 'duplicate', id FROM g WHERE n > 1", "locations", "tasks"))
def q15(spark: SparkSession, d: str) -> DataFrame:
    e = active(locations(spark, d)).select("id")
    g = tasks(spark, d).where("task_type = 'signup'").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    parts = [e.join(g, "id", "left_anti").select("id"), g.join(e, "id", "left_anti").select("id"), g.where("n > 1").select("id")]
    named = [p.select(F.lit(k).alias("kind"), "id") for k, p in zip(("missing", "unexpected", "duplicate"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("q17_snapshot_digest", sql("SELECT org_id, sha256(string_agg(id || ':' || coalesce(CAST(rating AS VARCHAR), ''), ',' ORDER BY id)) AS digest FROM locations GROUP BY 1", "locations"))
def q17(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("id", "rating"))), lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["rating"].cast("string"), F.lit(""))))
    return locations(spark, d).groupBy("org_id").agg(F.sha2(F.array_join(rows, ","), 256).alias("digest"))


# ---- ledgers ----


@query("a27_cost_rollup", sql(", r AS (SELECT task_type AS provider, status, count(*) AS calls, CAST(sum(CAST(cost AS DECIMAL(18, 4))) AS DOUBLE) AS cost FROM tasks GROUP BY GROUPING SETS ((1, 2), (1), ())) SELECT * FROM r", "tasks"))
def a27(spark: SparkSession, d: str) -> DataFrame:
    """Calls and cost by provider and status, by provider, and in all; the parts add up to the whole."""
    return tasks(spark, d).withColumnRenamed("task_type", "provider").rollup("provider", "status").agg(F.count("*").alias("calls"), F.sum(F.col("cost").cast("decimal(18,4)")).cast("double").alias("cost"))


@query("a28_run_summary", sql("SELECT date_trunc('day', created_at) AS day, count(*) AS calls, CAST(sum(CAST(cost AS DECIMAL(18, 4))) AS DOUBLE) AS cost, CAST(sum(coalesce(CAST(json_extract_string(payload, '$.k') AS INT), 0)) AS BIGINT) AS tokens FROM tasks GROUP BY 1", "tasks"))
def a28(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.coalesce(F.get_json_object("payload", "$.k").try_cast("int"), F.lit(0))
    return tasks(spark, d).groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.col("cost").cast("decimal(18,4)")).cast("double").alias("cost"), F.sum(tokens).alias("tokens"))


@query("a29_outcome_rollup", sql("SELECT task_type, status, CASE WHEN CAST(json_extract_string(payload, '$.k') AS INT) > 50 THEN 'high' ELSE 'low' END AS outcome, count(*) AS n FROM tasks GROUP BY 1, 2, 3", "tasks"))
def a29(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.get_json_object("payload", "$.k").try_cast("int") > 50, "high").otherwise("low")
    return tasks(spark, d).groupBy("task_type", "status", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("a30_change_rollup", sql("SELECT task_type AS action, coalesce(CASE WHEN priority > 2 THEN 'urgent' END, '_none') AS reason, count(DISTINCT entity_id) AS entities FROM tasks GROUP BY 1, 2", "tasks"))
def a30(spark: SparkSession, d: str) -> DataFrame:
    reason = F.coalesce(F.when(F.col("priority") > 2, F.lit("urgent")), F.lit("_none"))
    return tasks(spark, d).groupBy(F.col("task_type").alias("action"), reason.alias("reason")).agg(F.count_distinct("entity_id").alias("entities"))


@query("a31_pattern_key", "SELECT nullif(regexp_extract(source, '^src([1-9][0-9]*)$', 1), '') AS run, count(*) AS n FROM documents GROUP BY 1")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.nullif(F.regexp_extract("source", "^src([1-9][0-9]*)$", 1), F.lit("")).alias("run")).agg(F.count("*").alias("n"))


@query("a32_finish_runs", sql(", c AS (SELECT date_trunc('month', created_at) AS run, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(CAST(cost AS DECIMAL(18, 4))) AS DOUBLE) AS spent FROM tasks GROUP BY 1) SELECT run, failed, spent, CASE WHEN failed * 3 > (SELECT max(failed) FROM c) THEN 'review' ELSE 'done' END AS status FROM c", "tasks"))
def a32(spark: SparkSession, d: str) -> DataFrame:
    c = tasks(spark, d).groupBy(F.date_trunc("month", "created_at").alias("run")).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.col("cost").cast("decimal(18,4)")).cast("double").alias("spent"))
    return c.join(F.broadcast(c.agg(F.max("failed").alias("most")))).select("run", "failed", "spent", F.when(F.col("failed") * 3 > F.col("most"), "review").otherwise("done").alias("status"))


# ---- market ----


@query("a33_keyword_summary", sql("SELECT category, count(*) AS keywords, count(size) FILTER (WHERE size > 20) AS with_volume, CAST(sum(size) AS BIGINT) AS volume FROM treatments GROUP BY 1", "treatments"))
def a33(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).groupBy("category").agg(F.count("*").alias("keywords"), F.count_if(F.col("size") > 20).alias("with_volume"), F.sum("size").alias("volume"))


@query("a34_weighted_median", "SELECT p_brand AS brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18, 4)) * p_size) AS DOUBLE) / sum(p_size) AS average, median(p_size) AS median FROM part GROUP BY 1")
def a34(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    total = F.sum(F.col("p_retailprice").cast("decimal(18,4)") * F.col("p_size")).cast("double")
    return p.groupBy(F.col("p_brand").alias("brand")).agg((total / F.sum("p_size")).alias("average"), F.percentile("p_size", 0.5).alias("median"))


@query("a35_market_summary", sql("SELECT country_code, count(*) AS n, round(count(rating) / count(*), 6) AS rated, median(review_count) AS median_reviews FROM locations GROUP BY 1", "locations"))
def a35(spark: SparkSession, d: str) -> DataFrame:
    return locations(spark, d).groupBy("country_code").agg(F.count("*").alias("n"), F.round(F.count("rating") / F.count("*"), 6).alias("rated"), F.percentile("review_count", 0.5).alias("median_reviews"))


@query("a36_j22_supply", sql(", o AS (SELECT l.country_code AS market, l.id, l.org_id, o.id AS offering, t.brand FROM offerings o JOIN locations l ON l.id = o.location_id JOIN treatments t ON t.id = o.treatment_id), m AS (SELECT market, count(DISTINCT id) AS locations, count(DISTINCT org_id) AS orgs, count(*) AS offerings FROM o GROUP BY 1), p AS (SELECT market, brand, count(DISTINCT id) AS supply FROM o GROUP BY 1, 2) SELECT m.*, coalesce(supply, 0) AS supply FROM m LEFT JOIN p ON p.market = m.market AND p.brand = 'Brand#11'", "offerings", "locations", "treatments"))
def a36(spark: SparkSession, d: str) -> DataFrame:
    l = locations(spark, d).select(F.col("country_code").alias("market"), F.col("id").alias("location_id"), "org_id")
    t = treatments(spark, d).select(F.col("id").alias("treatment_id"), "brand")
    o = offerings(spark, d).join(l, "location_id").join(t, "treatment_id")
    branded = F.when(F.col("brand") == "Brand#11", F.col("location_id"))
    return o.groupBy("market").agg(F.count_distinct("location_id").alias("locations"), F.count_distinct("org_id").alias("orgs"), F.count("*").alias("offerings"), F.count_distinct(branded).alias("supply"))


@query("w10_percentile", sql("SELECT id, cume_dist() OVER (PARTITION BY brand ORDER BY size) AS share FROM treatments", "treatments"))
def w10(spark: SparkSession, d: str) -> DataFrame:
    return treatments(spark, d).select("id", F.cume_dist().over(Window.partitionBy("brand").orderBy("size")).alias("share"))


_SCORE = "floor((40 * cume_dist() OVER (PARTITION BY p_brand ORDER BY ln(1 + p_size)) + 35 * cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + 15 * cume_dist() OVER (PARTITION BY p_brand ORDER BY p_partkey % 97) + 10 * cume_dist() OVER (PARTITION BY p_brand ORDER BY p_partkey % 13)) * 100 + 0.5) / 100"


@query("w11_m6_opportunity", f"SELECT p_partkey AS id, {_SCORE} AS score FROM part")
def w11(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.cume_dist().over(Window.partitionBy("p_brand").orderBy(c))
    score = 40 * share(F.log1p("p_size")) + 35 * share(F.col("p_retailprice")) + 15 * share(F.col("p_partkey") % 97) + 10 * share(F.col("p_partkey") % 13)
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.floor(score * 100 + 0.5) / 100).alias("score"))
