"""Folding against the standard library's decomposition."""

import unicodedata

from pyspark.sql import functions as F

from brightfield.functions import text


def want(s):
    out = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.category(c).startswith("M")).lower()
    for a, b in text._PAIRS.items():
        out = out.replace(a, b)
    return out


def test_every_letter_and_digit_of_common_scripts(spark):
    ranges = [(0x20, 0x7F), (0xA0, 0x370), (0x370, 0x600), (0x1E00, 0x2000), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2474), (0xFB00, 0xFB07), (0xFF10, 0xFF5B)]
    chars = [chr(k) for a, b in ranges for k in range(a, b) if unicodedata.category(chr(k))[0] in "LN"]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", text.fold(F.col("c")).alias("f")).collect()
    wrong = [(r.c, r.f, want(r.c)) for r in rows if r.f != want(r.c) and want(r.c).isalnum()]
    assert not wrong, wrong[:9]


def test_texts(spark):
    given = {"Ｆｕｌｌ ① ﬁne ŉ ǆ": "full 1 fine ʼn dz", "Å Ł Ø ß İ": "a l o ss i", "Été": "ete", "": "", "x½": "x½"}
    rows = spark.createDataFrame([(k,) for k in given], "c string").select("c", text.fold(F.col("c")).alias("f")).collect()
    assert {r.c: r.f for r in rows} == given
