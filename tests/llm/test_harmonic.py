"""Harmonic packing against whole texts encoded by the library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfield.llm import harmonic, queries
from brightfield.llm.common import table
from brightfield.llm.token_ids import tokenizer_path
from tests.conftest import SF
from tests.llm.test_operators import ODD, documents, prose


def encoded(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(harmonic.TOKENIZER))
    return [np.array([*e.ids, harmonic.END_ID], "<u4").tobytes() for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def assert_packed(rows, ids):
    """Every id lies in one piece, sequences have no gaps, and there is little padding. ``ids``: by doc_id, all copies of it."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert docs.keys() == ids.keys()
    for doc, pieces in docs.items():
        whole = ids[doc]
        copies = sum(r.start == 0 for r in pieces)
        assert sum(r.length for r in pieces) == copies * len(whole) // 4
        for r in pieces:
            assert r.doc_tokens == len(whole) // 4
            assert r.ids_crc32 == zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)]) and r.length > 0
        if copies == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    padding = 0
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= harmonic.CAPACITY
        padding += 0 if at & (at - 1) == 0 else harmonic.CAPACITY - at
    assert padding <= 0.01 * sum(r.length for r in rows)


def test_cuts():
    for rest in range(harmonic.CAPACITY):
        made = harmonic.cuts(rest)
        assert sum(made) == rest and all(made) and len(made) <= 4
        for n in made:
            k = harmonic.CAPACITY // n
            assert n <= harmonic.TINY or harmonic.CAPACITY - k * n <= max(harmonic.SLACK, k)


def test_harmonic_packing_of_odd_texts(spark):
    texts = [*ODD, *[prose(k, 3 + 29 * k) for k in range(60)], prose(1, 32), prose(1, 32), prose(2, 6000)]
    docs = documents(spark, texts).withColumn("sequence_id", F.lit("x")).withColumn("part", F.lit(None)).repartition(23)
    assert_packed(harmonic.pack_documents(docs).collect(), dict(enumerate(encoded(texts))))


def test_harmonic_packing_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "x y"), (2, None)], "doc_id long, text string")
    rows = harmonic.pack_documents(docs).collect()
    assert_packed(rows, dict(zip([1, None, 2], encoded(["a b c", "x y", None]), strict=True)))
    assert harmonic.pack_documents(docs.limit(0)).columns == harmonic.pack_documents(docs).columns
    assert harmonic.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 70])
def test_harmonic_packing_of_the_table(spark, parts):
    docs = table(spark, SF, "documents").repartition(parts)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = harmonic.pack_documents(docs).collect()
    assert_packed(rows, dict(zip(texts, encoded(texts.values()), strict=True)))
    per_document = len(rows) / len(texts)
    assert per_document < 5


def test_harmonic_query(spark):
    made = queries.queries()["op11_harmonic"](spark, SF)
    assert made.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert made.select("doc_id").distinct().count() == table(spark, SF, "documents").count()
