"""Full-text matches of many queries at once, ranked by cover density.

A query is a list of groups: a document must hold a word of every group, and none of the excluded words. A cover is a shortest stretch
of words that holds a word of every group; it counts the harmonic mean of its query words' weights, divided by one more than the
number of other words in it. A document's rank is the sum over its covers, so that query words close together count more.

Words of documents meet the words of the queries in an equi-join, once for each document and word, which tells the documents that a
query matches; only then do their positions join, once for each document, however many queries match it. The covers of a document
are found in one pass over its hits: a cover ends at the first hit for which its beginning moves on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightfield.functions import text
from brightfield.operators.components import written

#: The weights of a word's label.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
_EXCLUDED = -1


def weighted_words(*fields: tuple[Column, str]) -> Column:
    """Words of several fields, one after another, each with the weight of its field's label; a null field is empty."""
    of = lambda c, label: F.transform(text.tokens(F.coalesce(c, F.lit(""))), lambda w: F.struct(w.alias("word"), F.lit(WEIGHTS[label]).alias("weight")))
    return F.concat(*[of(c, label) for c, label in fields])


def query_words(queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, word, part, parts): the group that a word belongs to, counted from 0, -1 for excluded words; queries without groups go.

    ``queries`` has the columns all_of (array of arrays of words) and none_of (array of words, or null).
    """
    groups = F.filter(F.transform("all_of", lambda g: F.array_distinct(F.array_compact(g))), lambda g: F.size(g) > 0)
    q = queries.select(*keys, groups.alias("groups"), F.coalesce("none_of", F.array().cast("array<string>")).alias("none_of")).where(F.size("groups") > 0)
    wanted = F.flatten(F.transform("groups", lambda g, i: F.transform(g, lambda w: F.struct(w.alias("word"), i.alias("part")))))
    unwanted = F.transform("none_of", lambda w: F.struct(w.alias("word"), F.lit(_EXCLUDED).alias("part")))
    return q.select(*keys, F.size("groups").alias("parts"), F.inline(F.concat(wanted, unwanted))).distinct()


def _covers(hits: Column, parts: Column) -> Column:
    """struct(covers, rank) of a document's hits, structs (position, part, weight) in order of position.

    For every part the last hit is kept, with its number and the sum of inverse weights before it. The earliest of them begins the
    shortest stretch that ends here; it is a cover when it begins later than the one before.
    """
    nowhere = F.struct(F.lit(-1).alias("position"), F.lit(0).alias("number"), F.lit(0.0).alias("before"))
    start = F.struct(F.array_repeat(nowhere, parts).alias("last"), F.lit(-1).alias("begun"), F.lit(0).alias("number"), F.lit(0.0).alias("inverse"), F.lit(0).alias("covers"), F.lit(0.0).alias("rank"))

    def step(s: Column, hit: Column) -> Column:
        here = F.struct(hit["position"].alias("position"), s["number"].alias("number"), s["inverse"].alias("before"))
        last = F.transform(s["last"], lambda old, i: F.when(i == hit["part"], here).otherwise(old))
        first = F.array_min(last)
        inverse = s["inverse"] + 1 / hit["weight"]
        is_cover = first["position"] > s["begun"]
        held = s["number"] - first["number"] + 1
        noise = F.greatest(hit["position"] - first["position"] - held + 1, F.lit(0))
        value = held / (inverse - first["before"]) / (1 + noise)
        return F.struct(
            last.alias("last"),
            F.when(is_cover, first["position"]).otherwise(s["begun"]).alias("begun"),
            (s["number"] + 1).alias("number"),
            inverse.alias("inverse"),
            (s["covers"] + is_cover.cast("int")).alias("covers"),
            (s["rank"] + F.when(is_cover, value).otherwise(0.0)).alias("rank"),
        )

    return F.aggregate(hits, start, step, lambda s: F.struct(s["covers"].alias("covers"), s["rank"].alias("rank")))


def ranked_matches(documents: DataFrame, queries: DataFrame, id_column: str = "id", keys: Sequence[str] = ("query",)) -> DataFrame:
    """(keys, id, covers, rank) of every document that a query matches. ``documents``: id and words, as from weighted_words()."""
    words = query_words(queries, keys)
    placed = documents.select(F.col(id_column).alias("id"), F.posexplode("words").alias("position", "x")).select("id", "position", "x.word", "x.weight")
    hits = placed.join(words.select("word").distinct(), "word", "left_semi")
    per_word = written(hits.groupBy("id", "word").agg(F.collect_list(F.struct("position", "weight")).alias("places")), "words")  # texts are read once
    held = per_word.select("id", "word").join(words, "word").groupBy(*keys, "parts", "id").agg(F.collect_set("part").alias("held"))
    matched = held.where((F.size("held") == F.col("parts")) & ~F.array_contains("held", _EXCLUDED)).select(*keys, "parts", "id")
    by_document = per_word.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("places"))
    wanted = words.where(F.col("part") >= 0).groupBy(*keys).agg(F.collect_list(F.struct("word", "part")).alias("wanted"))
    of_word = lambda places, w: F.transform(F.coalesce(F.try_element_at(places, w["word"]), F.array().cast("array<struct<position:int,weight:double>>")), lambda p: F.struct(p["position"].alias("position"), w["part"].alias("part"), p["weight"].alias("weight")))
    met = matched.join(wanted, list(keys)).join(by_document, "id").withColumn("hits", F.sort_array(F.flatten(F.transform("wanted", lambda w: of_word(F.col("places"), w)))))
    return met.select(*keys, "id", _covers(F.col("hits"), F.col("parts")).alias("x")).select(*keys, "id", "x.covers", "x.rank")
