"""Plans against brute force, where tables of the given shape would not show a difference."""

import math
import random

import pytest

from brightfield.functions import geo, text
from brightfield.plans.entities import match_cascade, nearby_pairs, two_pass_consensus
from brightfield.plans.search import closure, near_points


def km(a, b):
    x, y = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y[0] - x[0]) / 2) ** 2 + math.cos(x[0]) * math.cos(y[0]) * math.sin((y[1] - x[1]) / 2) ** 2
    return 2 * geo.KM * math.asin(min(1.0, math.sqrt(h)))


def places(seed, n, reach):
    """Clusters at the equator, far north and south, and on both sides of the antimeridian."""
    rng = random.Random(seed)
    bases = [(0.0, 0.0), (70.0, 25.0), (-84.0, 179.9), (60.0, -179.99), (89.7, 10.0)]
    made = []
    for _ in range(n):
        lat, lon = rng.choice(bases)
        lat, lon = max(-90.0, min(90.0, lat + rng.uniform(-reach, reach))), lon + rng.uniform(-4 * reach, 4 * reach)
        made.append((lat, (lon + 180) % 360 - 180))
    return made


@pytest.mark.parametrize("reach,far", [(0.02, 1.5), (0.3, 25.0)])
def test_nearby_pairs_by_brute_force(spark, reach, far):
    made = places(3, 160, reach)
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(made)], "id long, latitude double, longitude double")
    found = {(r.a, r.b) for r in nearby_pairs(df, far).collect()}
    want = {(i, j) for j in range(len(made)) for i in range(j) if km(made[i], made[j]) <= far}
    assert want and found == want


def test_near_points_by_brute_force(spark):
    made = places(5, 200, 0.5)
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(made)], "id long, latitude double, longitude double")
    cities = [("a", 70.1, 25.5), ("b", -84.0, -179.8), ("c", 60.2, 179.9), ("d", 0.1, 0.1)]
    points = spark.createDataFrame(cities, "city string, latitude double, longitude double")
    found = {(r.city, r.id) for r in near_points(points, df, 25.0).collect()}
    assert found and found == {(c, k) for c, *at in cities for k, p in enumerate(made) if km(at, p) <= 25.0 * geo.KM / geo.MILES}


def test_closure_of_any_depth_and_with_a_cycle(spark):
    rows = [(k, k - 1 if k else None) for k in range(40)] + [(100, 101), (101, 100)]
    found = {(r.root, r.id) for r in closure(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert found == {(i, j) for i in range(40) for j in range(i, 40)} | {(a, b) for a in (100, 101) for b in (100, 101)}


def test_cascade_takes_the_first_rule(spark):
    columns = "org_id long, locality string, country_code string, name_key string, latitude double, longitude double, slug string"
    inputs = spark.createDataFrame([(1, 5, "x", "A", "n1", 1.0, 1.0, "s1"), (2, 9, "y", "B", "n2", 2.0, 2.0, "s2"), (3, 9, "y", "B", "zz", 50.0, 179.999, "s3"), (4, 0, "q", "Q", "none", 9.0, 9.0, "s9")], "input_id long, " + columns)
    found = spark.createDataFrame([(11, 5, "x", "A", "n1", 1.0, 1.0, "a"), (12, 0, "z", "B", "n2", 8.0, 8.0, "b"), (13, 0, "z", "B", "n2", 8.0, 8.0, "c"), (14, 0, "z", "C", "k", 50.0, -179.999, "d"), (15, 1, "w", "Z", "m", -9.0, -9.0, "s9")], "id long, " + columns)
    made = {r.input_id: (r.status, r["rank"], r.candidate) for r in match_cascade(inputs, found).collect()}
    assert made == {1: ("matched", 1, 11), 2: ("review", 2, None), 3: ("matched", 3, 14), 4: ("review", 4, None)}


def test_consensus_of_two_passes(spark):
    one = spark.createDataFrame([(1, 5, "a", 0.9), (2, 5, "a", 0.9), (3, 7, "a", 0.9), (4, 5, "a", 0.9)], "id long, target long, decision string, confidence double")
    two = spark.createDataFrame([(1, 5, "a", 0.85), (2, 5, "b", 0.9), (3, 7, "a", 0.9), (4, 5, "a", 0.8)], "id long, target_2 long, decision_2 string, confidence_2 double")
    made = two_pass_consensus(one, two, spark.createDataFrame([(5,), (5,)], "target long"))
    assert {r.id: r.outcome for r in made.collect()} == {1: "accepted", 2: "disagreement", 3: "invalid_target", 4: "low_confidence"}


def test_letters_fold_composed_or_not(spark):
    df = spark.createDataFrame([("Ångström & Łódź",), ("Việt Nam",), ("é à",), ("ἀρχή",), (None,)], "t string")
    assert [r.t for r in df.select(text.human_text(df["t"]).alias("t")).collect()] == ["angstrom and lodz", "viet nam", "e a", "αρχη", None]
