"""Digests of cohorts are SHA-256 of the ordered ids, also where a cohort comes in many batches."""

import hashlib
import random

from brightfield.plans.ledgers import ordered_digests


def test_ordered_digests(spark):
    rng = random.Random(5)
    cohorts = {("A", "price"): range(9, 120), ("A", "rating"): [7], ("B", "price"): [12, 2, 101], (None, "price"): range(40)}
    rows = [(c, g, i) for (c, g), ids in cohorts.items() for i in ids] + [("B", "price", None)]
    rng.shuffle(rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r.country_code, r.gap): (r.n, r.digest) for r in ordered_digests(spark.createDataFrame(rows, "country_code string, gap string, id long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {k: (len(ids) + (k == ("B", "price")), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()) for k, ids in cohorts.items()}
    assert found == want
