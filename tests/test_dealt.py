"""Steps over large tables are dealt out by rows, joins of exploded rows are not broadcast, places are found by a query's rarest word."""

import pytest

from brightfield import catalog
from brightfield.plans.rules import searched
from brightfield.roles import TASK_ROWS, dealt, locations, supplied
from pyspark.sql import functions as F
from tests.conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_by_rows(spark):
    assert dealt(spark.range(10), 9 * TASK_ROWS + 1, "id").rdd.getNumPartitions() == 10
    assert dealt(spark.range(10), 0, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["a44_hubs", "e19_treatment_city_supply", "a3_catalog", "a11_supply_by_root"])
def test_steps_are_dealt(spark, name):
    assert "REPARTITION_BY_NUM" in plan_of(catalog.queries()[name](spark, SF))


def test_supplied_by_plain_python(spark):
    places = locations(spark, SF).where("id % 3 = 0").select(F.col("id").alias("location_id"), "locality")
    found = [tuple(r) for r in supplied(spark, SF, places).collect()]
    of = {r[0]: r[1] for r in places.collect()}
    orders = dict(spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect())
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    want = {(p, orders[o], of[orders[o]]) for o, p in lines if orders.get(o) in of}
    assert len(found) == len(set(found)) and set(found) == want


def test_exploded_rows_are_not_broadcast(spark):
    assert "Broadcast" not in plan_of(catalog.queries()["j5_substring_join"](spark, SF))


def test_places_are_found_by_the_rarest_word(spark):
    queries = spark.createDataFrame([("common rare",), ("common",), ("common none",), ("rare rare",), ("!",)], "q string")
    names = spark.createDataFrame([(1, "x y", "z")], "treatment_id long, name string, synonym string")
    places = spark.createDataFrame([(i, "common" + " rare" * (i < 3), "common", None) for i in range(20)], "id long, name string, locality string, country_code string")
    offers = spark.createDataFrame([(1, 2, 3.0)], "treatment_id long, location_id long, price_amount double")
    made = searched(queries, names, places, offers)
    want = {("common rare", i) for i in range(3)} | {("rare rare", i) for i in range(3)} | {("common", i) for i in range(20)}
    assert sorted((r.q, r.location_id) for r in made.collect()) == sorted(want)
    assert "hits" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_decisions_are_written_once(spark):
    assert any("brightfield-offerings" in f for f in catalog.queries()["x3_offering_decisions"](spark, SF).inputFiles())


def test_texts_are_read_once(spark):
    assert not any("documents.parquet" in f for f in catalog.queries()["n21_n22_full_text"](spark, SF).inputFiles())
