"""Rows without an id."""

from brightfield.llm import near_dedup
from tests.llm.test_operators import prose


def test_near_dedup_of_rows_without_an_id(spark):
    text = prose(1, 40)
    rows = [(1, text), (2, text), (None, text), (None, prose(2, 40)), (None, prose(2, 40)), (None, None), (3, prose(3, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.find_components(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 36, 1, True), (2, 36, 1, False), (None, 36, 1, False), (None, 36, None, True), (None, 36, None, True), (None, 0, None, True), (3, 36, 3, True)], key=str)
    assert near_dedup.kept_documents(docs).count() == 6
