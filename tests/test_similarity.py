"""Set-similarity joins against brute force over all pairs."""

import random

import pytest

from brightfield.operators.similarity import dice_percent, jaccard_of, rare_first, representatives, similar_pairs, similar_short_sets
from brightfield.plans.entities import nearby_namesakes
from tests.test_plans import km


def sets(seed, n):
    """Sets in families with few changes, with members from rare to very common ones; some empty, some equal."""
    rng = random.Random(seed)
    made = [[], ["z"]]
    while len(made) < n:
        base = rng.choice(made) if rng.random() < 0.7 else [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 30))]
        made.append([w for w in base if rng.random() < 0.97] + [f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 0, 0, 1, 2]))])
    return [sorted(set(m)) for m in made]


def brute(made, percent):
    want = {}
    for j, b in enumerate(made):
        for i, a in enumerate(made[:j]):
            shared, every = len(set(a) & set(b)), len(set(a) | set(b))
            if every and 100 * shared >= percent * every:
                want[i, j] = shared / every
    return want


@pytest.mark.parametrize("percent", [1, 34, 50, 80, 85, 100])
def test_similar_pairs_by_brute_force(spark, percent):
    made = sets(percent, 110)
    known = rare_first(spark.createDataFrame([(k, m + m[:1]) for k, m in enumerate(made)], "id long, grams array<string>"))
    pairs = similar_pairs(known, known, percent)
    found = [(r.a, r.b, r.similarity) for r in pairs.withColumn("similarity", jaccard_of(pairs)).collect()]
    want = brute(made, percent)
    assert len(found) == len(want) and want
    assert all(abs(want[a, b] - s) < 1e-12 for a, b, s in found)


def test_blocks_nulls_and_empty_tables(spark):
    made = sets(3, 60)
    df = spark.createDataFrame([(k, m, k % 3) for k, m in enumerate(made)] + [(900, None, 0), (901, [None], 0)], "id long, grams array<string>, block int")
    known = rare_first(df)
    found = {(r.a, r.b) for r in similar_pairs(known, known, 70, on=("block",)).collect()}
    assert found == {p for p in brute(made, 70) if p[0] % 3 == p[1] % 3}
    assert similar_pairs(known.limit(0), known, 70).count() == 0
    with pytest.raises(ValueError):
        similar_pairs(known, known, 0)


def test_dice_percent_is_a_lower_bound():
    for percent in range(1, 101):
        for size_a in range(1, 30):
            for size_b in range(1, 30):
                for shared in range(1, min(size_a, size_b) + 1):
                    if 200 * shared >= percent * (size_a + size_b):
                        assert 100 * shared >= dice_percent(percent) * (size_a + size_b - shared)


def test_the_plan_never_compares_all_pairs(spark):
    known = rare_first(spark.createDataFrame([(k, m) for k, m in enumerate(sets(1, 20))], "id long, grams array<string>"))
    plan = similar_pairs(known, known, 80)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def grams(name):
    return {f"  {w} "[i : i + 3] for w in name.split() for i in range(len(w) + 1)}


def test_nearby_namesakes_by_brute_force(spark):
    rng = random.Random(9)
    names = ["north star clinic", "north star clinics", "north star clinic 2", "north star clinic 3", "star north clinic", "harbour view", "harbour views", "harbour view dental"]
    bases = [(0.0, 0.0), (52.0, 13.0), (-77.0, 179.9995), (60.0, -179.9995)]
    rows = []
    for k in range(150):
        lat, lon = rng.choice(bases)
        at = (lat + rng.choice([0, 0, 1, -2]) * 0.0006, (lon + rng.choice([0, 0, 1, -3]) * 0.0008 + 180) % 360 - 180)
        rows.append((k, rng.choice(names), rng.choice(["FR", "DE", None]), *at))
    rows += [(1000 + k, "north star clinic", "FR", 52.0, 13.0) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, name string, country_code string, latitude double, longitude double")
    found = {(r.a, r.b): (r.copies_a, r.copies_b) for r in nearby_namesakes(df, 0.15, 85).collect()}
    classes = {}
    for k, *rest in rows:
        classes.setdefault(tuple(rest), []).append(k)
    reps = sorted((min(v), *key, len(v)) for key, v in classes.items())
    slug = lambda n: n.replace(" ", "-")
    bare = lambda n: slug(n).rsplit("-", 1)[0] if slug(n).rsplit("-", 1)[-1].isdigit() else slug(n)
    want = {}
    for j, b in enumerate(reps):
        for a in reps[:j]:
            shared, every = len(grams(a[1]) & grams(b[1])), len(grams(a[1]) | grams(b[1]))
            apart = slug(a[1]) != bare(b[1]) and slug(b[1]) != bare(a[1])
            if a[2] == b[2] and 100 * shared >= 85 * every and km(a[3:5], b[3:5]) * 1000 <= 150 and apart and (a[3:5] != (0.0, 0.0) and b[3:5] != (0.0, 0.0)):
                want[a[0], b[0]] = (a[5], b[5])
    assert want and found == want
    assert any(n > 300 for pair in want.values() for n in pair)
    assert representatives(df, "name", "country_code", "latitude", "longitude").count() == len(reps)


@pytest.mark.parametrize("percent", [1, 45, 85, 100])
def test_similar_short_sets_by_brute_force(spark, percent):
    """Blocks of 30 sets, so that many meet; null and empty sets go."""
    made = sets(percent, 110)
    df = spark.createDataFrame([(k, m + m[:1] + [None]) for k, m in enumerate(made)] + [(900, None), (901, [None])], "id long, grams array<string>")
    pairs = similar_short_sets(df, percent, block=30)
    found = {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in pairs.collect()}
    want = brute(made, percent)
    assert found == {(a, b): (len(set(made[a]) & set(made[b])), len(made[a]), len(made[b])) for a, b in want}
    assert similar_short_sets(df.limit(0), percent).count() == 0


def test_only_numbers_meet(spark):
    """What is exploded and joined on members holds no lists of members: these join the pairs that are left."""
    known = rare_first(spark.createDataFrame([(k, m) for k, m in enumerate(sets(1, 20))], "id long, grams array<string>"))
    plan = similar_pairs(known, known, 85)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect(first_a" not in plan and "array_intersect(all_a" in plan
