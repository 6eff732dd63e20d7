"""Tables of similarity joins are never broadcast, as their files tell nothing of their rows; ranks are where members are few."""

import pytest

from brightfield import catalog
from brightfield.operators import similarity
from brightfield.operators.similarity import rare_first, similar_pairs
from tests.conftest import SF
from tests.test_dealt import plan_of
from tests.test_similarity import brute, sets


def test_sets_are_not_broadcast(spark):
    known = rare_first(spark.createDataFrame([(k, m) for k, m in enumerate(sets(1, 20))], "id long, grams array<string>"))
    assert plan_of(known).count("BroadcastHashJoin") == 1
    read = spark.createDataFrame(known.collect(), known.schema)
    assert "Broadcast" not in plan_of(similar_pairs(read, read, 85))


def test_places_are_not_broadcast(spark):
    assert "Broadcast" not in plan_of(catalog.queries()["j12_band_and_name"](spark, SF))


@pytest.mark.parametrize("few", [0, 10_000])
def test_ranks_of_few_and_of_many_members(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "FEW_MEMBERS", few)
    made = sets(8, 60)
    known = rare_first(spark.createDataFrame(list(enumerate(made)), "id long, grams array<string>"))
    assert ("Broadcast" in plan_of(known)) == (few > 0)
    assert {(r.a, r.b) for r in similar_pairs(known, known, 60).collect()} == set(brute(made, 60))
