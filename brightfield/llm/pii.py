"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall generators propose spans: the strict base patterns (whose valid matches always count), and looser ones for the same
kinds (spelled-out or bracketed signs, other separators, no leading plus). Boosted trees judge the loose ones by format and context.
Nobody labels personal data, so they are fitted on examples written for the purpose: addresses and numbers in loose formats, and dates,
versions, order numbers, sums and the like that only look so, in varying company; the same number of them whatever the table.
A proposal that fails its kind's arithmetic is never chosen. A threshold per kind is calibrated on held-out examples for a wanted
precision. The fitted trees become one SQL expression over the proposals of a row, so detection is a narrow projection without shuffle.

No span crosses a line end, so texts are searched line by line, and offsets are summed in two levels: the work grows with a text's
length, whatever the number of spans.

Defined cases: a null or empty text has no spans; offsets count code points, ends are exclusive; proposals that overlap a base
span are dropped, and of two that overlap the better scored one stays, the earlier of equals; repeated rows are handled alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Written examples that the trees are fitted on, a quarter of them for the thresholds.
EXAMPLES = 8_000
TREES, DEPTH = 12, 4
PRECISION = 0.98
LEAST_EXAMPLES = 20
CONTEXT = 24
#: Items of a group in sums and sweeps of two levels.
GROUP = 256

#: The base patterns. Quantifiers are possessive where nothing after them could need what they hold; a match may
#: start inside a run of its class only where the last match ended, as the runs' other starts could only give less.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?(?:@|[(\[{]\x20?(?:at|AT)\x20?[)\]}])\x20?", r"\x20?(?:\.|[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}])\x20?"
PROPOSED = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20.\-/]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20.\-/]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
_CUES = {"email": "(?i)mail|contact|write|schreib", "ip": "(?i)\\bip\\b|host|server|addr", "card": "(?i)card|karte|carte|tarjeta|visa|credit", "phone": "(?i)tel|phone|fon\\b|call|mobil|fax"}
_AGAINST = "(?i)version|release|section|chapter|isbn|issn|order|invoice|track|serial|page|date|since|between|total|sum|price|model|part|build|\\bno\\.?|#|\\bv\\.?$|[$€£]"
FEATURES = ("kind", "chars", "digits", "letters", "marks", "blanks", "groups", "luhn", "most_part", "first_part", "brackets", "plus", "before", "after", "cue", "against")
#: What a line must hold to have any span or proposal.
_ANY = "[0-9@]|[(\\[{]\x20?(?i:at)\x20?[)\\]}]"
_SPAN = "struct<start:int,kind:int,stop:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _grouped(values: Column) -> Column:
    """An array in slices of GROUP."""
    last = F.greatest(F.floor((F.size(values) - 1) / GROUP).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(values, g * GROUP + 1, F.lit(GROUP)))


def _before(values: Column) -> Column:
    """For every item of an integer array the sum of those before it."""
    def scan(items: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    total = lambda g: F.aggregate(g, F.lit(0), lambda t, x: t + x)
    return _let(_grouped(values), lambda groups: F.flatten(F.zip_with(groups, scan(F.transform(groups, total), F.lit(0)), scan)))


def _lines(text: Column) -> Column:
    """The lines of a text that may have spans, as (at, line)."""
    return _let(F.split(text, "\n", -1), lambda lines: F.filter(F.zip_with(_before(F.transform(lines, lambda x: F.char_length(x) + 1)), lines, lambda at, x: F.struct(at.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(_ANY)))


def _needs(kind: str, text: Column) -> Column:
    return text.rlike("@|(?i)[(\\[{]\x20?at\x20?[)\\]}]") if kind == "email" else text.rlike("[0-9]")


def _matches(kind: str, pattern: str, text: Column) -> Column:
    """Leftmost matches as (a, b, hit, left, right): the text is cut at the matches, and the pieces' lengths add up to the offsets."""
    empty = F.array().cast("array<struct<a:int,b:int,hit:string,left:string,right:string>>")

    def placed(x: Column) -> Column:
        found = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("hit"), g.alias("left")))
        found = F.zip_with(found, F.slice(x["gaps"], F.lit(2), F.size(x["hits"])), lambda y, g: F.struct(y["gap"].alias("gap"), y["hit"].alias("hit"), y["left"].alias("left"), g.alias("right")))
        return _let(found, lambda f: F.zip_with(_before(F.transform(f, lambda y: y["gap"] + F.char_length(y["hit"]))), f, span))

    def span(at: Column, y: Column) -> Column:
        a = at + y["gap"]
        return F.struct(a.alias("a"), (a + F.char_length(y["hit"])).alias("b"), y["hit"].alias("hit"), y["left"].alias("left"), y["right"].alias("right"))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(_needs(kind, text), _let(both, lambda x: F.when(F.size(x["hits"]) > 0, placed(x)).otherwise(empty))).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check: from the right, every second one is doubled."""
    def worth(d: Column, i: Column) -> Column:
        n = d.try_cast("int")
        twice = 2 * n
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), worth), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _part_fits(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, "\\."), _part_fits)
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(12, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _base_of(line: Column) -> Column:
    """Valid base matches of a line as (start, kind, stop); kind is its place in KINDS."""
    def of(k: int, kind: str) -> Column:
        valid = F.filter(_matches(kind, BASE[kind], line), lambda m: _valid(kind, m["hit"]))
        return F.transform(valid, lambda m: F.struct(m["a"].alias("start"), F.lit(k).alias("kind"), m["b"].alias("stop")))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def base_spans(text: Column) -> Column:
    """Valid base matches as (start, kind, stop), by start, then kind as listed."""
    moved = lambda x: F.transform(_base_of(x["line"]), lambda m: F.struct((m["start"] + x["at"]).alias("start"), m["kind"].alias("kind"), (m["stop"] + x["at"]).alias("stop")))
    return F.array_sort(F.flatten(F.transform(_lines(text), moved)))


def _count(hit: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(hit, f"[^{pattern}]", ""))


def proposals(line: Column) -> Column:
    """Matches of the loose patterns in a line, with their features; context reaches to the last proposal of the kind at most."""
    def of(k: int, kind: str) -> Column:
        def featured(m: Column) -> Column:
            hit, digits = m["hit"], _digits(m["hit"])
            before, after = F.substring(m["left"], -CONTEXT, CONTEXT), F.substring(m["right"], 1, 1)
            parts = F.transform(F.filter(F.split(hit, "[^0-9]+"), lambda p: p != ""), lambda p: F.coalesce(p.try_cast("double"), F.lit(1e9)))
            luhn = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
            numbers = {
                "kind": F.lit(k),
                "chars": F.char_length(hit),
                "digits": F.length(digits),
                "letters": _count(hit, "A-Za-z"),
                "marks": _count(hit, "@./\\-"),
                "blanks": _count(hit, "\\x20"),
                "groups": F.size(parts),
                "luhn": luhn.cast("int"),
                "most_part": F.coalesce(F.array_max(parts), F.lit(0.0)),
                "first_part": F.coalesce(F.get(parts, F.lit(0)), F.lit(0.0)),
                "brackets": _count(hit, "(){}\\[\\]"),
                "plus": hit.rlike("^(\\+|00)").cast("int"),
                "before": F.when(before.rlike("[\\p{L}0-9_=]$"), 2).when(before.rlike("\\S$"), 1).otherwise(0),
                "after": F.when(after.rlike("^[\\p{L}0-9_=]"), 2).when(after.rlike("^\\S"), 1).otherwise(0),
                "cue": before.rlike(_CUES[kind]).cast("int"),
                "against": before.rlike(_AGAINST).cast("int"),
            }
            fails = {"email": F.lit(False), "ip": F.array_max(parts) > 255, "card": ~luhn, "phone": ~F.length(digits).between(9, 15)}[kind]
            return F.struct(m["a"].alias("start"), F.lit(k).alias("kind_"), m["b"].alias("stop"), fails.alias("fails"), *[v.cast("double").alias(n) for n, v in numbers.items()])

        return F.transform(_matches(kind, PROPOSED[kind], line), featured)

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def _swept(base: Column, scored: Column) -> Column:
    """Of scored proposals (start, kind, stop, score) those that no base span and no better proposal overlaps: one sweep by start."""
    kind = "struct<start:int,mine:int,kind:int,stop:int,score:double>"
    item = lambda x, mine, score: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x["kind"].alias("kind"), x["stop"].alias("stop"), score.alias("score"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: item(x, 0, F.lit(0.0))), F.transform(scored, lambda x: item(x, 1, x["score"]))))
    state = lambda taken, held, out: F.struct(taken.alias("taken"), held.alias("held"), out.alias("out"))
    start = state(F.lit(0), F.lit(None).cast(kind), F.array().cast(f"array<{_SPAN}>"))

    def emitted(s: Column) -> Column:
        span = F.struct(s["held"]["start"].alias("start"), s["held"]["kind"].alias("kind"), s["held"]["stop"].alias("stop"))
        return F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], span))

    def step(s: Column, x: Column) -> Column:
        none, apart = F.lit(None).cast(kind), s["held"].isNull() | (x["start"] >= s["held"]["stop"])
        base_next = state(F.greatest(s["taken"], x["stop"]), none, F.when(apart, emitted(s)).otherwise(s["out"]))
        better = F.when(x["score"] > s["held"]["score"], x).otherwise(s["held"])
        mine_next = F.when(x["start"] < s["taken"], s).when(apart, state(s["taken"], x, emitted(s))).otherwise(state(s["taken"], better, s["out"]))
        return F.when(x["mine"] == 0, base_next).otherwise(mine_next)

    def group(s: Column, g: Column) -> Column:
        empty = F.array().cast(f"array<{_SPAN}>")
        return _let(F.aggregate(g, state(s["taken"], s["held"], empty), step), lambda t: state(t["taken"], t["held"], F.concat(s["out"], t["out"])))

    return F.aggregate(_grouped(every), start, group, emitted)


@dataclass
class Detector:
    """Fitted (weight, tree) pairs and the least margin of each kind that chooses a proposal; a kind without one chooses none."""

    trees: list[tuple[float, tuple]] = field(default_factory=list)
    least: dict[int, float] = field(default_factory=dict)

    def chosen(self, found: Column, base: Column) -> Column:
        """The proposals of a line that are personal data by their score and apart from its base spans."""
        wanted = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in self.least.items() for v in kv]), x["kind"]), F.lit(1e9))
        scored = F.transform(F.filter(found, lambda x: ~x["fails"]), lambda x: F.struct(x["start"].alias("start"), x["kind_"].alias("kind"), x["stop"].alias("stop"), self._margin(x).alias("score")))
        good = F.filter(scored, lambda x: x["score"] >= wanted(x))
        return _let(good, lambda g: F.when(F.size(g) > 0, _swept(base, g)).otherwise(F.array().cast(f"array<{_SPAN}>")))

    def _margin(self, x: Column) -> Column:
        def node(tree: tuple) -> Column:
            if len(tree) == 1:
                return F.lit(tree[0])
            name, cut, left, right = tree
            return F.when(x[name] <= cut, node(left)).otherwise(node(right))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * node(tree)
        return total


def _tree(node) -> tuple:
    if node.subtreeDepth() == 0:
        return (float(node.prediction()),)
    split = node.split()
    return (FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def examples(spark: SparkSession, number: int = EXAMPLES) -> DataFrame:
    """Written examples: n, line, start, stop, kind of what is meant, and label (1: personal data, 0: it only looks so)."""
    n = F.col("n")
    draw = lambda k, most: F.pmod(F.xxhash64(n, F.lit(k)), F.lit(most)).cast("int")
    one = lambda k, *of: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), draw(k, len(of)) + 1)
    digits = lambda k, length: F.lpad(F.pmod(F.xxhash64(n, F.lit(k)), F.lit(10**length)).cast("string"), length, "0")
    number_of = lambda k, least, most: (draw(k, most - least + 1) + least).cast("string")
    name = F.concat(one(1, "anna", "b.meyer", "john_doe", "k7", "maria.lopez", "x", "office"), one(2, "", F.lit(""), number_of(3, 1, 99)))
    at, dot = one(4, "@", " @ ", " (at) ", "[at]", "(at)", " [AT] "), one(5, ".", " (dot) ", "[dot]", " . ", ".", "[.]")
    email = F.concat(name, at, one(6, "mail", "host7", "example", "uni-bonn", "firma"), dot, one(7, "com", "org", "de", "net", "co.uk"))
    ip_dot = one(8, ".", "[.]", "(.)", "[dot]", " (dot) ")
    ip = F.concat_ws("", number_of(9, 1, 254), ip_dot, number_of(10, 0, 255), ip_dot, number_of(11, 0, 255), ip_dot, number_of(12, 1, 254))
    body = F.concat(one(13, "4", "51", "34", "6011"), digits(14, 18)).substr(1, 15)
    check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: _luhn(F.concat(body, d)))[0]
    plain = F.concat(body, check)
    sign = one(15, "-", " ", ".", "/", " - ", "")
    card = F.concat_ws("", F.substring(plain, 1, 4), sign, F.substring(plain, 5, 4), sign, F.substring(plain, 9, 4), sign, F.substring(plain, 13, 4))
    area, local, line_ = number_of(16, 201, 989), number_of(17, 200, 999), digits(18, 4)
    gap = one(19, "-", " ", ".")
    phone = one(20, F.concat(F.lit("("), area, F.lit(") "), local, F.lit("-"), line_), F.concat(area, gap, local, gap, line_), F.concat(F.lit("00"), number_of(21, 31, 49), F.lit(" "), area, gap, local, gap, line_),
                F.concat(F.lit("0"), area, F.lit("/"), local, F.lit(" "), line_), F.concat(F.lit("+"), number_of(22, 31, 49), F.lit("-"), area, F.lit("-"), local, F.lit("-"), line_))
    day, month, year = F.lpad(number_of(23, 1, 28), 2, "0"), F.lpad(number_of(24, 1, 12), 2, "0"), number_of(25, 1900, 2030)
    no_email = one(26, F.concat(number_of(27, 2, 40), F.lit(" @ "), number_of(28, 1, 90), F.lit("."), digits(29, 2)), F.concat(F.lit("pkg@"), number_of(30, 0, 20), F.lit("."), number_of(31, 0, 20), F.lit("."), number_of(32, 0, 20)), F.concat(F.lit("look (at) fig . "), number_of(33, 1, 9)))
    no_ip = F.concat_ws(".", number_of(34, 0, 12), number_of(35, 0, 20), number_of(36, 0, 40), number_of(37, 0, 99))
    no_card = one(38, F.concat(body, check), F.concat(digits(39, 4), F.lit("."), digits(40, 4), F.lit("."), digits(41, 4), F.lit("."), digits(42, 4)), F.concat(F.lit("978-3-"), digits(43, 2), F.lit("-"), digits(44, 6), F.lit("-"), digits(45, 1)))
    no_phone = one(46, F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), year, F.lit("-"), month, F.lit("-"), day), F.concat(day, F.lit("."), month, F.lit("."), year, F.lit(" "), number_of(47, 10, 23), F.lit(" "), number_of(48, 10, 59)),
                   F.concat(number_of(49, 1, 999), F.lit("."), digits(50, 3), F.lit("."), digits(51, 3), F.lit("."), digits(52, 3)), F.concat(number_of(53, 10, 99), F.lit(" "), number_of(54, 10, 999), F.lit(" "), number_of(55, 10, 999), F.lit(" "), number_of(56, 10, 99)),
                   F.concat(year, F.lit("-"), number_of(57, 1900, 2030), F.lit("-"), digits(58, 3)))
    kind, label = draw(59, len(KINDS)), draw(60, 2)
    pick = lambda *of: F.element_at(F.array(*of), kind + 1)
    hit = F.when(label == 1, pick(email, ip, card, phone)).otherwise(pick(no_email, no_ip, no_card, no_phone))
    cue = pick(one(61, "mail ", "contact: ", "write to "), one(62, "host ", "server at ", "ip "), one(63, "card ", "visa no: ", "credit card "), one(64, "call ", "tel. ", "phone: ", "fax "))
    against = one(65, "version ", "order no. ", "section ", "on ", "pages ", "isbn ", "total ", "between ", "build v", "invoice #", "price $", "dated ")
    neutral = one(66, "the ", "and of ", "ist ", "reached us ", "(", "", "see also ", ": ")
    lead = F.when(label == 1, one(67, cue, cue, neutral)).otherwise(one(68, against, against, neutral))
    line = F.concat(one(69, "", "some words before ", "Er sagte, ", "In it "), lead)
    made = spark.range(number).withColumnRenamed("id", "n").select("n", kind.alias("kind"), label.alias("label"), line.alias("head"), hit.alias("hit"), one(70, "", " and more words", ".", ", please", ")").alias("tail"))
    return made.select("n", F.concat("head", "hit", "tail").alias("line"), F.char_length("head").alias("start"), F.char_length(F.concat("head", "hit")).alias("stop"), "kind", "label")


def fit_detector(spark: SparkSession, number: int = EXAMPLES) -> Detector:
    """Trees and thresholds from written examples; the same whatever the documents are."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = examples(spark, number).select("n", "label", "kind", "start", "stop", F.explode(proposals(F.col("line"))).alias("x"))
    meant = (F.col("kind") == F.col("x.kind_")) & (F.col("start") < F.col("x.stop")) & (F.col("x.start") < F.col("stop"))
    rows = rows.where(~F.col("x.fails")).select(F.when(meant, F.col("label")).otherwise(0).cast("double").alias("label"), F.pmod(F.xxhash64("n"), F.lit(4)).alias("part"), "x.*")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "part", "kind_", "features").cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64).fit(rows.where("part > 0").coalesce(2))
    detector = Detector(trees=[(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)])
    named = F.struct(*[F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)])
    held = rows.where("part = 0").select("kind_", "label", vector_to_array("features").alias("f")).select("kind_", "label", named.alias("x"))
    held = held.select("kind_", "label", detector._margin(F.col("x")).alias("margin")).collect()  # a quarter of the examples
    rows.unpersist()
    for kind in range(len(KINDS)):
        mine = sorted(((r["margin"], r["label"]) for r in held if r["kind_"] == kind), reverse=True)
        right = 0.0
        for n, (margin, y) in enumerate(mine, 1):
            right += y
            if margin <= 0:
                break
            if n >= LEAST_EXAMPLES and right / n >= PRECISION:
                detector.least[kind] = margin
    return detector


_fitted: dict[tuple[str, int], Detector] = {}


def detector_of(spark: SparkSession, number: int = EXAMPLES) -> Detector:
    """The detector of an application, fitted once: its examples do not depend on any table."""
    key = (spark.sparkContext.applicationId, number)
    if key not in _fitted:
        _fitted[key] = fit_detector(spark, number)
    return _fitted[key]


def detect(docs: DataFrame, detector: Detector, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (a struct of the kept columns), ``text``, ``base`` and ``added`` spans, both by start."""
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text_of().alias("text"))

    def of(x: Column) -> Column:
        added = lambda base: detector.chosen(proposals(x["line"]), base) if detector.least else F.array().cast(f"array<{_SPAN}>")
        return _let(_base_of(x["line"]), lambda base: F.struct(x["at"].alias("at"), base.alias("base"), added(base).alias("added")))

    found = rows.select("doc", "text", F.transform(_lines(F.col("text")), of).alias("found"))
    moved = lambda name: F.array_sort(F.flatten(F.transform("found", lambda x: F.transform(x[name], lambda m: F.struct((m["start"] + x["at"]).alias("start"), m["kind"].alias("kind"), (m["stop"] + x["at"]).alias("stop"))))))
    return found.select("doc", "text", moved("base").alias("base"), moved("added").alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def spans(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = detect(docs, detector or detector_of(docs.sparkSession), ["doc_id"])

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc.doc_id", *map(number, range(len(KINDS))), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"))


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; a null text stays null. n_chars, if there, follows."""
    found = detect(docs, detector or detector_of(docs.sparkSession))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    every = F.array_sort(F.concat("base", "added"))
    # A span that starts inside an earlier one only moves that one's end on.
    merged = "array<struct<start:int,kind:int,stop:int>>"

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(out) > 0) & (F.when(F.size(out) > 0, last["stop"]).otherwise(0) > s["start"]), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), longer)).otherwise(F.array_append(out, s))

    def pieces(spans: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length("text")))
        between = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
        marks = F.concat(F.transform(spans, lambda s: names[s["kind"]]), F.array(F.lit("")))
        return F.array_join(F.zip_with(between, marks, lambda x, y: F.concat(x, y)), "")

    replaced = _let(F.aggregate(every, F.array().cast(merged), step), pieces)
    text = F.when(F.col("doc.text").isNull(), None).when(F.size("base") + F.size("added") == 0, F.col("text")).otherwise(replaced)
    made = found.select("doc", text.alias("__text"))
    columns = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("bigint")}
    return made.select(*[columns[c].alias(c) if c == "text" or (c == "n_chars" and "n_chars" in docs.columns) else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
