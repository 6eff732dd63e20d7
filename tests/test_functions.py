import datetime

import pytest
from pyspark.sql import functions as F

from brightfield.functions import dates, geo, pricing, text
from brightfield.operators.components import components
from brightfield.plans.search import SearchRequest, checked_predicate, closure


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    l = F.lit
    assert value(spark, text.human_text(l("Crème & Søn's  Ltd."))) == "creme and son s ltd"
    assert value(spark, text.slug(l("  Été – à Paris! "))) == "ete-a-paris"
    assert value(spark, text.slug_base(l("Spa Lyon"), l("Lyon"))) == "spa-lyon"
    assert value(spark, text.slug_base(l("Spa"), l("Lyon"))) == "spa-lyon"
    assert value(spark, text.blank_to_null(l("  "))) is None
    assert value(spark, text.search_term(l("Intravenous therapies B12+"))) == "iv therapy b 12 plus"
    assert value(spark, text.registrable_domain(l("https://www2.shop.example.co.uk/x?y"))) == "example.co.uk"
    assert value(spark, text.registrable_domain(l("example.com"))) == "example.com"
    assert value(spark, text.without_tracking(l("https://a.b/c?utm_source=x&id=3#top"))) == "https://a.b/c?id=3"
    assert value(spark, text.e164(l("030 1234567"), l("49"), l(False))) == "+49301234567"
    assert value(spark, text.e164(l("1234"), l("1"), l(False))) is None
    assert value(spark, text.email(l(" A@B.Co "))) == "a@b.co"
    assert value(spark, text.email(l("a@b"))) is None
    assert value(spark, text.metric(l("$1,200"))) == 1200.0
    assert value(spark, text.metric(l("1.2k"))) == 1200.0
    assert value(spark, text.metric(l("—"))) is None
    assert value(spark, text.keyword_in_place(l("Yoga near me"), l("lyon"))) == "yoga lyon"
    assert value(spark, text.jaccard(text.word_trigrams(l("cat")), text.word_trigrams(l("cat")))) == 1.0
    assert value(spark, text.dice(text.string_trigrams(l("cat")), text.string_trigrams(l("dog")))) == 0.0
    assert value(spark, text.is_bot(l(""))) is True
    assert value(spark, text.is_bot(l("Mozilla/5.0"))) is False


def test_geo(spark):
    l = F.lit
    assert value(spark, geo.haversine(l(0.0), l(0.0), l(0.0), l(1.0), geo.KM)) == pytest.approx(111.19, abs=0.01)
    assert value(spark, geo.metres(l(0.0), l(0.0), l(1.0), l(1.0))) is None
    assert value(spark, geo.in_box(l(10.0), l(175.0), 0, 20, 170, -170)) is True
    assert value(spark, geo.in_longitude_band(l(0.0), l(179.9999), l(-179.9999), 100.0)) is True
    assert geo.view_centre(170, -170) == -180
    south, north, west, east = geo.radius_box(0, 0, 69)
    assert (south, north, west, east) == (-1, 1, -1, 1)


def test_dates(spark):
    l = F.lit
    day = F.lit("2024-05-20").cast("date")
    assert value(spark, dates.review_date(l("3 weeks ago"), day)) == datetime.date(2024, 4, 29)
    assert value(spark, dates.review_date(l("a month ago"), day)) == datetime.date(2024, 4, 1)
    assert value(spark, dates.review_date(l("12 Jan 2023"), day)) == datetime.date(2023, 1, 12)
    assert value(spark, dates.review_date(l("Mon, May 6, 2024 at 3pm"), day)) == datetime.date(2024, 5, 6)
    assert value(spark, dates.review_date(l("2024-02-03T10:00"), day)) == datetime.date(2024, 2, 3)
    assert value(spark, dates.review_date(l("whenever"), day)) is None
    assert float(value(spark, dates.rating(l('{"ratingValue":"4.5"}')))) == 4.5
    assert value(spark, dates.rating(l("good"))) is None


def test_prices(spark):
    l = F.lit
    assert value(spark, pricing.comparable(l(5.0), l(" "), l(None).cast("string"))) is True
    assert value(spark, pricing.comparable(l(5.0), l("package"), l("retail"))) is False
    assert value(spark, pricing.shown(l(50.0), l(80.5), l("eur"), l("range"), l("session"))) == "EUR 50-80.50 per session"


def test_request():
    r = SearchRequest.parse({"treatment_id": "3,3,x,5", "country": "fr", "lat": "91", "lng": "2.5", "page": "2"})
    assert r == SearchRequest((3, 5), "FR", None, 2.5, 2)


def test_predicates():
    for bad in ("id = 1; DROP TABLE x", "sleep(5) = 1", "id IN (SELECT 1)", "id = 1 -- x"):
        with pytest.raises(ValueError):
            checked_predicate(bad)
    # no session is needed to see that text in quotes is not looked at


def test_closure_ends_on_a_cycle(spark):
    tree = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent_id long")
    assert {tuple(r) for r in closure(tree).select("root", "id").collect()} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3)}


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 8), (3, 4), (4, 5), (5, 6)], "a long, b long")
    assert {tuple(r) for r in components(pairs).collect()} == {(k, 1) for k in range(1, 7)} | {(7, 7), (8, 7), (9, 7)}
    assert components(pairs.limit(0)).count() == 0
