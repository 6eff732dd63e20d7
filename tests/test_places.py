"""Geocoder answers, candidate merges, registry matches and trial summaries, case by case and against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brightfield.functions import geocoding
from brightfield.plans import places
from brightfield.roles import read
from tests.conftest import SF

ANSWER = "latitude double, longitude double, formatted string, address string, locality string, region string, postal_code string, country_code string"


@pytest.mark.parametrize(
    "answer,reason",
    [
        ((1.0, 1.0, "12 Harbour St, Lyon, France", "12 Harbour Street", "Lyon", None, None, "FR"), "identity_validated"),
        ((1.0, 1.0, "12 Harbour St, LYÓN", "12 Harbour Street", "Lyon", None, None, "FR"), "identity_validated"),
        ((1.0, 1.0, "13 Harbour St, Lyon, France", "12 Harbour Street", "Lyon", None, None, "FR"), "address_identity_mismatch"),
        ((1.0, 1.0, "12 Harbour St, Lyon, Germany", "12 Harbour Street", "Lyon", None, None, "FR"), "country_mismatch"),
        ((1.0, 1.0, "12 Harbour St, Paris 69 001", "12 Harbour Street", "Lyon", None, "69001", None), "identity_validated"),
        ((1.0, 1.0, "12 Harbour Road, United Kingdom", "12 Old Harbour Road", None, None, "", "GB"), "address_identity_mismatch"),
        ((1.0, 1.0, "12 Old Harbour Road, United Kingdom", "12 Old Harbour Road", None, None, "", "GB"), "identity_validated"),
        ((1.0, 1.0, "12 Old Harbour Road", "12 Old Harbour Road", None, None, None, None), "identity_validated"),
        ((1.0, 1.0, "Lyon, Rhone", None, "Lyon", "Rhône", None, "FR"), "identity_validated"),
        ((1.0, 1.0, "Lyon", None, "Lyon", None, None, "FR"), "address_identity_mismatch"),
        ((1.0, 1.0, "Lyon, France", None, "Lyon", None, None, "fr"), "identity_validated"),
        ((1.0, 1.0, "Seoul, Republic of Korea", None, "Seoul", None, None, "KR"), "identity_validated"),
        ((1.0, 1.0, "New England Road 5, Boston, United States of America", "5 New England Road", "Boston", None, None, "US"), "identity_validated"),
        ((0.0, 0.0, "12 Harbour St, Lyon", "12 Harbour Street", "Lyon", None, None, "FR"), "coordinates_out_of_range"),
        ((None, 1.0, "12 Harbour St, Lyon", "12 Harbour Street", "Lyon", None, None, "FR"), "coordinates_out_of_range"),
        ((1.0, 181.0, None, None, None, None, None, None), "coordinates_out_of_range"),
        ((1.0, 1.0, " ", "12 Harbour Street", "Lyon", None, None, "FR"), "formatted_address_missing"),
        ((1.0, 1.0, "x", None, None, None, None, None), "address_identity_mismatch"),
    ],
)
def test_geocoder_answers(spark, answer, reason):
    df = spark.createDataFrame([answer], ANSWER)
    (row,) = df.select(geocoding.validated(*[F.col(c) for c in df.columns]).alias("x")).select("x.*").collect()
    assert row.reason == reason and row.valid == (reason == "identity_validated")


def test_every_reason_and_state_occurs(spark):
    d = SF.replace("0.001", "0.01")
    assert len({r.reason for r in places.x9(spark, d).select("reason").distinct().collect()}) == 5
    assert {r.status for r in places.c18_candidates(spark, d).select("status").distinct().collect()} == {"discovered", "needs_review", "promoted", "rejected"}
    assert len({r.outcome for r in places.d27(spark, d).select("outcome").distinct().collect()}) == 5


def folded(sightings):
    """Sightings of each candidate merged one after another."""
    kept = {}
    for s in sorted(sightings, key=lambda s: s["turn"]):
        old = kept.get(s["candidate_key"])
        if old is None:
            kept[s["candidate_key"]] = s | {"sightings": 1, "first_turn": s["turn"], "last_turn": s["turn"], "evidence": set(s["evidence"])}
            continue
        for c in ("website", "email"):
            old[c] = old[c] if old[c] is not None else s[c]
        old["evidence"] |= set(s["evidence"])
        old["offerings"] = old["offerings"] if len(old["offerings"]) >= len(s["offerings"]) else s["offerings"]
        if old["status"] not in places.SETTLED:
            old["status"] = "discovered" if "discovered" in (old["status"], s["status"]) else "needs_review"
        old["sightings"] += 1
        old["last_turn"] = s["turn"]
    return {k: (v["sightings"], v["first_turn"], v["last_turn"], v["website"], v["email"], sorted(v["evidence"]), v["offerings"], v["status"]) for k, v in kept.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_like_one_after_another(spark, seed):
    rng = random.Random(seed)
    rows = []
    for turn in rng.sample(range(1000), 260):
        key = rng.choice(["hot", f"k{rng.randrange(40)}"])
        stored = turn < 90 and not any(r["candidate_key"] == key and r["turn"] < 90 for r in rows)
        status = rng.choice([*places.SETTLED, "discovered", "needs_review"]) if stored else rng.choice(["discovered", "needs_review", "needs_review"])
        rows.append({"turn": turn if stored else turn + 100, "candidate_key": key, "name": key, "website": rng.choice([None, "w1", "w2"]), "address": "a", "locality": None, "region": "CA", "country": "US", "email": rng.choice([None, None, "e"]), "evidence": rng.sample("abcdef", rng.randrange(3)), "offerings": [str(turn)] * rng.randrange(4), "status": status})
    turns = [r["turn"] for r in rows]
    rows = [r for k, r in enumerate(rows) if r["turn"] not in turns[:k]]
    df = spark.createDataFrame(rows, "turn long, candidate_key string, name string, website string, address string, locality string, region string, country string, email string, evidence array<string>, offerings array<string>, status string")
    got = {r.candidate_key: (r.sightings, r.first_turn, r.last_turn, r.website, r.email, r.evidence, r.offerings, r.status) for r in places.merged_candidates(df.repartition(7)).collect()}
    assert got == folded(rows)


def test_candidate_keys_ignore_spelling(spark):
    base = {"turn": 1, "name": "Café No. 1", "website": "HTTPS://www.Site.example.org/home/", "address": "12 Main St.", "locality": "Oakland", "region": "California", "country": "United States", "email": None, "evidence": ["https://blog.site.example.org/x"], "citations": ["http://site.example.org"], "offerings": None}
    rows = [base, base | {"turn": 2, "name": " cafe no 1", "website": "https://site.example.org/home", "region": "ca", "country": "us", "address": "12, main st"}, base | {"turn": 3, "website": None, "citations": None}, base | {"turn": 4, "name": " N/A "}, base | {"turn": 5, "address": None, "citations": ["https://notsite.example.org"], "evidence": None}]
    df = spark.createDataFrame(rows, "turn long, name string, website string, address string, locality string, region string, country string, email string, evidence array<string>, citations array<string>, offerings array<string>")
    got = {r.turn: r for r in places.normalised_places(df).collect()}
    assert sorted(got) == [1, 2, 3, 5] and got[1].candidate_key == got[2].candidate_key and len({r.candidate_key for r in got.values()}) == 3
    assert [got[k].status for k in (1, 2, 3, 5)] == ["discovered", "discovered", "needs_review", "needs_review"]
    assert places.merged_candidates(places.normalised_places(df.limit(0))).count() == 0


def test_registry_by_hand_and_with_a_common_name(spark):
    record = {"board": "TX", "number": "L1", "first_name": "Ana Maria", "last_name": "O'Neil", "type": "Physician License", "current": "Y", "discipline": "NONE", "degree": "MD", "expires": None, "city": "Lyon"}
    records = [record, record | {"number": "L2", "degree": "DO", "city": "Oak Land"}, record | {"number": "L3", "expires": "2020-01-01"}, record | {"number": "L4", "type": "Nurse"}, record | {"number": "L5", "discipline": "Fine"}]
    records += [record | {"number": f"M{k:04}", "first_name": "John", "last_name": "Smith", "city": f"City {k}"} for k in range(3000)]
    people = [(1, "TX", "Dr. Ana O'Neil, M.D.", "MD", "x"), (2, "TX", "ANA X ONEIL jr", None, "oakland"), (3, "TX", "Ana O'Neil", None, None), (4, "OR", "Ana O'Neil", None, None), (5, "TX", "Doctor", None, None), (6, "TX", "Bob O'Neil", None, None), (7, "TX", None, None, None)]
    people += [(100 + k, "TX", "John Smith", None, f"city {k}") for k in range(3000)] + [(9000, "TX", "John Smith", "M.D.", "nowhere")]
    schema = ", ".join(f"{k} string" for k in record)
    got = {r.id: (r.outcome, r.number) for r in places.registry_matches(spark.createDataFrame(people, "id long, board string, full_name string, credentials string, locality string"), spark.createDataFrame(records, schema), "2024-01-01").collect()}
    assert [got[k] for k in range(1, 8)] == [("verified", "L1"), ("verified", "L2"), ("ambiguous_board_match", None), ("board_source_unsupported", None), ("invalid_candidate_name", None), ("board_record_not_found", None), ("invalid_candidate_name", None)]
    assert all(got[100 + k] == ("verified", f"M{k:04}") for k in range(3000)) and got[9000] == ("ambiguous_board_match", None)


def test_trial_summaries(spark):
    study = lambda n, status, **more: {"protocolSection": {"identificationModule": {"nctId": n, "briefTitle": "t"}, "statusModule": {"overallStatus": status}}, **more}
    answers = [None, "{broken", "{}", json.dumps({"studies": []}), json.dumps({"totalCount": 9, "studies": [study("1", "RECRUITING", hasResults=True), study(None, "RECRUITING"), study("2", "COMPLETED"), study("3", "RECRUITING"), study("4", "COMPLETED", hasResults=True), study("5", "")]})]
    df = spark.createDataFrame(list(enumerate(answers)), "id int, j string")
    rows = {r.id: r.x for r in df.select("id", places.trial_summary(F.col("j")).alias("x")).collect()}
    assert all(rows[k] is None or (rows[k].total, rows[k].statuses) == (0, []) for k in range(4)) and rows[3].total == 0
    last = rows[4]
    assert (last.total, last.recruiting, last.with_results) == (9, 2, 2) and [(s.status, s.n) for s in last.statuses] == [("COMPLETED", 2), ("RECRUITING", 2)]
    assert [r.number for r in last.records] == ["1", "2", "3"] and last.records[0].has_results and last.records[0].phases == []


def test_places_read_their_tables(spark):
    assert places.x16(spark, SF).count() <= read(spark, SF, "customer").count()
