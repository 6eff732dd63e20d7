"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame operations only.

A text's paragraphs are its lines; longer ones are cut after every sixteen words (a word of over sixteen characters counts once for
every sixteen), so that a long line or a text without blanks has several pieces too. Every distinct piece becomes a 64-bit key: a
hash of the piece whose low bits hold its length. A sketch has three tables of cells; a key is added to one cell of each, where
keys are counted and XORed, and their check hashes XORed. Sketches subtract cell by cell: what two texts share cancels out. A cell
left with one key gives it up; peeling such cells recovers the differing keys of either side. When that fails, the keys are
sketched again with four times the cells: each quarter, by bits of the check hash, gets a sketch of its own, and a quarter that
fails is quartered again. Should the largest sketches fail too, the keys themselves are compared.

The likeness of two texts is the length of the pieces they share over that of all their distinct pieces.

Defined cases: a null text counts as empty; texts without words have an empty sketch, and two of those are alike (1.0); repeats
of a piece count once; rows with equal ids are ordered by a hash of their texts, and equal rows have the same next document;
documents without an id come last; a row that is alone comes next after itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightfield.llm.common import materialise, text_of

#: Words of a piece; characters of a word, and blanks after it, that count as one.
PIECE, WORD, BLANKS = 16, 16, 15
TABLES, CELLS = 3, 20
#: Turns of peeling; every turn peels all cells that hold one key.
TURNS = 14
#: Times that a failed sketch is quartered part by part; then a part's sketches grow fourfold all at once, so many times.
QUARTERED, GROWN = 2, 8

_PIECES = rf"(?:\S{{1,{WORD}}}+[^\S\n]{{0,{BLANKS}}}+){{1,{PIECE}}}+"
#: The bits of a key that hold the piece's length, which is below PIECE * (WORD + BLANKS) + 1.
_LENGTH = 511


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7))


def _key(k: Column, c: Column) -> Column:
    """A key with its check hash and its cell in each table."""
    place = lambda t: F.pmod(F.shiftrightunsigned(c, 10 * t), F.lit(CELLS)).cast("int")
    return F.struct(k.alias("k"), c.alias("c"), *[place(t).alias(f"p{t}") for t in range(TABLES)])


def paragraph_keys(text: Column) -> Column:
    """The distinct pieces of a text as keys."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    key = lambda p: F.xxhash64(p).bitwiseAND(F.lit(~_LENGTH)).bitwiseOR(F.char_length(p).cast("bigint"))
    checked = F.transform(F.array_distinct(F.transform(pieces, key)), lambda k: F.struct(k.alias("k"), _check(k).alias("c")))
    return F.transform(checked, lambda x: _key(x["k"], x["c"]))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def _by_cell(keys: Column, value: Callable[[Column, Column], Column]) -> Column:
    """``value`` of (cell number, the keys in that cell) for the cells of the three tables in turn."""
    numbers = F.array(*[F.lit(i) for i in range(CELLS)])

    def table(t: int) -> Column:
        return F.transform(numbers, lambda i: value(i + t * CELLS, F.filter(keys, lambda x: x[f"p{t}"] == i)))

    return F.concat(*[table(t) for t in range(TABLES)])


def sketch(keys: Column) -> Column:
    """The cells of keys."""
    zero = _cell(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    add = lambda a, x: _cell(a["n"] + 1, a["k"].bitwiseXOR(x["k"]), a["c"].bitwiseXOR(x["c"]))
    return _by_cell(keys, lambda _, mine: F.aggregate(mine, zero, add))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column) -> Column:
    """(ok, found): the keys (n, k) of a difference, n = 1 for those of the first text and -1 for the second's."""
    start = F.struct(F.lit(True).alias("more"), cells.alias("cells"), F.array().cast("array<struct<n:int,k:bigint>>").alias("found"))

    def turn(state: Column, _: Column) -> Column:
        lone = F.array_distinct(F.filter(state["cells"], lambda x: ((x["n"] == 1) | (x["n"] == -1)) & (x["c"] == _check(x["k"]))))
        pure = F.transform(lone, lambda x: F.struct(x["n"].alias("n"), *[_key(x["k"], x["c"])[f].alias(f) for f in ("k", "c", *[f"p{t}" for t in range(TABLES)])]))
        take = lambda a, p: _cell(a["n"] - p["n"], a["k"].bitwiseXOR(p["k"]), a["c"].bitwiseXOR(p["c"]))

        def without(p: Column) -> Column:
            rest = _by_cell(p, lambda i, mine: F.aggregate(mine, state["cells"][i], take))
            more = F.concat(state["found"], F.transform(p, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"))))
            stopped = F.struct(F.lit(False).alias("more"), state["cells"].alias("cells"), state["found"].alias("found"))
            return F.when(F.size(p) == 0, stopped).otherwise(F.struct(F.lit(True).alias("more"), rest.alias("cells"), more.alias("found")))

        return F.when(state["more"], _let(pure, without)).otherwise(state)

    done = lambda s: F.struct(F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)).alias("ok"), s["found"].alias("found"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(TURNS)]), start, turn, done)


def _grown(keys_a: Column, keys_b: Column, peeled: Column) -> Column:
    """A failed difference again with 4, 16, 64, ... sketches, to which the check hash deals the keys."""

    def sketches(n: Column) -> Column:
        def one(b: Column) -> Column:
            mine = lambda x: F.pmod(F.shiftrightunsigned(x["c"], 42), n) == b
            cells = lambda keys: _let(F.filter(keys, mine), sketch)
            return peel(subtract(cells(keys_a), cells(keys_b)))

        parts = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), one)
        return _let(parts, lambda p: F.struct(F.forall(p, lambda x: x["ok"]).alias("ok"), F.flatten(F.transform(p, lambda x: x["found"])).alias("found")))

    sizes = F.array(*[F.lit(4**k).cast("bigint") for k in range(1, GROWN + 1)])
    return F.aggregate(sizes, peeled, lambda state, n: F.when(state["ok"], state).otherwise(sketches(n)))


def difference(keys_a: Column, cells_a: Column, keys_b: Column, cells_b: Column, level: int = 0) -> Column:
    """(ok, found) for two texts: their sketches' difference peeled, or its quarters' differences where it cannot be."""
    peeled = peel(subtract(cells_a, cells_b))
    if level == QUARTERED:
        return _grown(keys_a, keys_b, peeled)

    def quarter(q: Column) -> Column:
        mine = lambda x: F.shiftrightunsigned(x["c"], 36 + 2 * level).bitwiseAND(F.lit(3).cast("bigint")) == q
        return _let(F.filter(keys_a, mine), lambda a: _let(F.filter(keys_b, mine), lambda b: difference(a, sketch(a), b, sketch(b), level + 1)))

    def quartered() -> Column:
        parts = F.transform(F.array(*[F.lit(q).cast("bigint") for q in range(4)]), quarter)
        return _let(parts, lambda p: F.struct(F.forall(p, lambda x: x["ok"]).alias("ok"), F.flatten(F.transform(p, lambda x: x["found"])).alias("found")))

    return _let(peeled, lambda p: F.when(p["ok"], p).otherwise(quartered()))


def _length(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, x: a + x["k"].bitwiseAND(F.lit(_LENGTH)))


def likeness(keys_a: Column, cells_a: Column, keys_b: Column, cells_b: Column) -> Column:
    """Shared over all distinct length, 0 to 1."""

    def share(a: Column, left: Column, right: Column) -> Column:
        return _let(F.struct(a.alias("a"), left.alias("left"), right.alias("right")), lambda x: F.when(x["a"] + x["right"] == 0, F.lit(1.0)).otherwise((x["a"] - x["left"]) / (x["a"] + x["right"])))

    def of(found: Column) -> Column:
        only = lambda n: _length(F.filter(found["found"], lambda x: x["n"] == n))
        compared = share(_length(keys_a), _length(F.array_except(keys_a, keys_b)), _length(F.array_except(keys_b, keys_a)))
        return F.when(found["ok"], share(_length(keys_a), only(1), only(-1))).otherwise(compared)

    return _let(difference(keys_a, cells_a, keys_b, cells_b), of)


def written(keys: Column, cells: Column) -> Column:
    """A sketch as text: the pieces' whole length, then every cell's count, key and half of its check, in base64."""
    fixed = lambda value, digits: F.lpad(F.hex(value), digits, "0")
    cell = lambda x: F.concat(fixed(x["n"].cast("bigint"), 8), fixed(x["k"], 16), F.substring(fixed(x["c"], 16), 9, 8))
    return F.base64(F.unhex(F.concat(fixed(_length(keys), 16), F.array_join(F.transform(cells, cell), ""))))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` in a struct ``doc`` with ``keys``, ``cells`` and ``fingerprint`` of its text."""
    rows = docs.select(F.struct("*").alias("doc"), paragraph_keys(text_of(text)).alias("keys"))
    rows = rows.select("doc", "keys", sketch(F.col("keys")).alias("cells"))
    return rows.select("doc", "keys", "cells", written(F.col("keys"), F.col("cells")).alias("fingerprint"))


def next_ids(rows: DataFrame) -> DataFrame:
    """For every distinct row key (h, g): n, and (next_h, next_g) of the next by descending doc_id, then h; after the last the first.

    Only ids, hashes and lengths are sorted, in ranges; every range's first row is the next one of the last row before it.
    """
    order = F.col("doc_id").desc_nulls_last(), F.col("h").asc()
    ids = rows.select("doc_id", "h", "g", "n").distinct().repartitionByRange(*order).withColumn("bucket", F.spark_partition_id())
    ids = materialise(ids, "fingerprint-ids")
    within = Window.partitionBy("bucket").orderBy(*order)
    ids = ids.withColumn("after", F.lead(F.struct("h", "g")).over(within)).withColumn("turn", F.row_number().over(within))
    heads = ids.where("turn = 1").select("bucket", F.struct("h", "g").alias("head"))
    buckets = Window.orderBy("bucket")  # a row per range
    first = F.first("head").over(buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(buckets), first).alias("head"))
    made = ids.join(heads, "bucket").withColumn("after", F.coalesce("after", "head"))
    return made.select("h", "g", "n", F.col("after.h").alias("next_h"), F.col("after.g").alias("next_g"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys (of its pieces), next_id, borrowed (a third of its length of the next document's beginning) and next_keys.

    Rows are known by two hashes, of id and text and of the text. Texts are shuffled once by them; of the next document only the
    borrowed part and the keys move. Both joins read the same columns of them, so one shuffle serves both.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g"), F.char_length("text").cast("bigint").alias("n"), "text")
    pairs = next_ids(rows).select(F.col("next_h").alias("h"), F.col("next_g").alias("g"), F.col("h").alias("for_h"), F.col("g").alias("for_g"), F.col("n").alias("for_n"))
    lent = rows.drop("n").join(pairs, ["h", "g"])
    lent = lent.select(F.col("for_h").alias("h"), F.col("for_g").alias("g"), F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.floor(F.col("for_n") / 3).cast("int")).alias("borrowed"), paragraph_keys(F.col("text")).alias("next_keys"))
    lent = lent.groupBy("h", "g").agg(F.any_value("next_id").alias("next_id"), F.any_value("borrowed").alias("borrowed"), F.any_value("next_keys").alias("next_keys"))
    return rows.drop("n").join(lent, ["h", "g"]).select("doc_id", "text", paragraph_keys(F.col("text")).alias("keys"), "next_id", "borrowed", "next_keys")


def edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to the edited text and to the next document.

    The edited text has its last third (by floor) replaced by as much of the next document's beginning.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), "borrowed"))
    rows = rows.select("doc_id", "n_chars", "next_id", F.sha2("edited", 256).alias("edited_sha256"), "keys", paragraph_keys(F.col("edited")).alias("edited_keys"), "next_keys")
    rows = rows.select("*", *[sketch(F.col(c)).alias(c.replace("keys", "cells")) for c in ("keys", "edited_keys", "next_keys")])
    mine = F.col("keys"), F.col("cells")
    near = lambda c: likeness(*mine, F.col(f"{c}_keys"), F.col(f"{c}_cells"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(*mine).alias("fingerprint"),
        written(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
        "next_id",
    )
