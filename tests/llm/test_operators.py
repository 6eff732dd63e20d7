"""Edge cases and brute force for the training-text operators, on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightfield.llm import decontamination, fingerprints, graph, html_text, near_dedup, packing, pii, quality, queries, token_files, toxicity, warc
from tests.conftest import SF
from tests.oracle import check

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, texts, extra=True):
    """Documents with columns whose names clash with those that operators add."""
    rows = [(k, t, "x", 7, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, found string, n_words int, doc string")


ODD = [None, "", "   \n\t ", "one", "Straße 😀 naïve x", "a" * 5000, "word " * 3000]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


# ---- 1 ----


def pieces(text):
    word = rf"\S{{1,{fingerprints.WORD}}}+[^\S\n]{{0,{fingerprints.BLANKS}}}+"
    return set(re.findall(rf"(?a:(?:{word}){{1,{fingerprints.PIECE}}}+)", text))


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    size = lambda s: sum(map(len, s))
    return size(a & b) / size(a | b) if a | b else 1.0


def test_fingerprints(spark):
    long_ = "\n".join(prose(k, 12) for k in range(300))
    texts = [*ODD, long_, long_ + "\nmore of it", prose(1, 80), prose(1, 80), "的" * 3000, "x " + " " * 900 + "y", prose(8, 9000)]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in fingerprints.edits(docs.repartition(5)).collect()}
    order = list(reversed(range(len(texts))))
    for i, k in enumerate(order):
        mine, after = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(mine) // 3
        edited = mine[: len(mine) - third] + after[:third]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(mine, edited)) and r.near_next == pytest.approx(likeness(mine, after))
    assert texts[9] == texts[10] and rows[9].fingerprint == rows[10].fingerprint
    assert rows[0].fingerprint == rows[1].fingerprint
    assert fingerprints.edits(docs.limit(0)).count() == 0
    assert fingerprints.edits(docs.where("doc_id = 3")).first().near_next == 1.0
    repeated = docs.where("doc_id in (3, 9)").unionByName(docs.where("doc_id = 9")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint")))
    made = fingerprints.edits(repeated).collect()
    assert len(made) == 4 and {(r.doc_id, r.near_next) for r in made} == {(9, 0.0), (3, 1.0), (None, 0.0)}


def test_fingerprints_fall_back_to_keys(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CELLS", 1)
    monkeypatch.setattr(fingerprints, "QUARTERED", 0)
    monkeypatch.setattr(fingerprints, "GROWN", 1)
    docs = documents(spark, [prose(1, 200), prose(1, 160) + prose(2, 40)])
    rows = {r.doc_id: r for r in fingerprints.edits(docs).collect()}
    a, b = (r.text for r in docs.orderBy("doc_id").collect())
    assert rows[0].near_next == pytest.approx(likeness(a, b)) and rows[1].near_next == pytest.approx(likeness(a, b))


# ---- 2 ----


def test_decontamination_in_passes(spark):
    item = prose(5, 25)
    texts = [*ODD, "x " + item.upper() + " y", " ".join(item.split()[3:12]), "short item here ok", "An IDIOM!"]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, item), (3, "short, item"), (4, None), (5, "idiom"), (6, "")], "item_id long, text string")
    nameless = spark.createDataFrame([(None, "idiom"), (None, "short item")], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.decisions(docs, nameless).where("contaminated").collect()}
    assert set(found) == {9, 10} and found[9].n_items == 1 and found[9].items_sha256 == hashlib.sha256(b"").hexdigest()
    one = {tuple(r) for r in decontamination.decisions(docs, bench).collect()}
    many = decontamination.find_contamination(docs, bench, ["doc_id"], windows_per_pass=3)
    hit = {r.doc.doc_id: (sum(h.b - h.a for h in r.found.hits), list(r.found["items"])) for r in many.collect()}
    assert {(r[0], r[2]) for r in one} == {(k, n) for k, (n, _) in hit.items()}
    assert hit[7] == (25, ["1", "2"]) and hit[8] == (0, []) and hit[9] == (2, ["3"]) and hit[10] == (1, ["5"])
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {0, 1, 2, 3, 4, 5, 6, 8}
    assert decontamination.decisions(docs, bench.limit(0)).where("contaminated").count() == 0


# ---- 3 ----


def test_pii_spans_and_redaction(spark):
    texts = [*ODD, "a@b.c_x@d.e 1.2.3.4.5.6.7.8 300.1.1.1", "card 4111 1111 1111 1111, not 4111111111111112", "😀 +1 (968) 555-9369 é a@b.co", "1" * 3000]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in pii.spans(docs, pii.Detector()).collect()}
    assert rows[7].spans == "email:0:5,email:5:11,ip:12:19,ip:20:27" and rows[8].n_card == 1
    assert rows[9].spans == "phone:2:19,email:22:28" and rows[10].spans == "" and rows[0].spans == ""
    text = {r.doc_id: r.text for r in pii.redact(docs, pii.Detector()).collect()}
    assert text[0] is None and text[9] == "😀 [PHONE] é [EMAIL]" and text[8].startswith("card [CARD], not 4111111111111112")
    assert pii.redact(docs, pii.Detector()).columns == docs.columns


@pytest.fixture(scope="module")
def detector(spark):
    return pii.fit_detector(spark)


BASE_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda hit, digits: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda hit, digits: all(int(x) <= 255 for x in hit.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda hit, digits: 12 <= len(digits) <= 19 and luhn(digits)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda hit, digits: 9 <= len(digits) <= 15),
]


def luhn(digits):
    twice = lambda n: 2 * n - 9 * (2 * n > 9)
    return sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_by_brute_force(text):
    found = [(m.start(), k, m.end()) for k, (_, pattern, fits) in enumerate(BASE_PATTERNS) for m in re.finditer(pattern, text or "") if fits(m.group(), re.sub("[^0-9]", "", m.group()))]
    return sorted(found)


def test_pii_base_spans_by_brute_force(spark, detector):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [*ODD, "+1 22 333-4444 55.6.7.8\n\n1.2.3.4.5 a@b.c@d.e.f", "\n".join(f"{k}.1.2.3 and x{k}@y.org" for k in range(700)), "9 " * 900]
    rows = {r.doc_id: r for r in pii.spans(documents(spark, texts), detector).collect()}
    for k, t in enumerate(texts):
        want = base_by_brute_force(t)
        written = ",".join(f"{BASE_PATTERNS[kind][0]}:{a}:{b}" for a, kind, b in want)
        assert rows[k].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [rows[k][f"n_{name}"] for name in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]
        assert set(written.split(",")) <= set(rows[k].spans.split(","))


def test_pii_trees_on_examples_not_seen(spark, detector):
    assert detector.trees and set(detector.least) == set(range(4))
    fresh = pii.examples(spark, pii.EXAMPLES + 3_000).where(F.col("n") >= pii.EXAMPLES).withColumn("doc_id", F.col("n"))
    made = pii.detect(fresh.withColumnRenamed("line", "text"), detector)
    spans = F.concat("base", "added")
    hit = F.exists(spans, lambda x: (x["start"] == F.col("doc.start")) & (x["stop"] == F.col("doc.stop")) & (x["kind"] == F.col("doc.kind")))
    counts = {r.label: r for r in made.groupBy(F.col("doc.label").alias("label")).agg(F.avg(hit.cast("int")).alias("found"), F.avg((F.size("added") > 0).cast("int")).alias("added")).collect()}
    assert counts[1].found > 0.8 and counts[1].added > 0.6 and counts[0].added < 0.03


def test_pii_chooses_among_overlapping_spans(spark, detector):
    texts = ["write bob (at) host3.org now", "call (555) 234-5678 or 0049 30 123 4567", "on 2023-01-15 2023-02-15", "ip 10[.]2[.]3[.]4", "pages 10 20 30 40"]
    docs = documents(spark, texts)
    assert {r.doc_id: r.spans for r in pii.spans(docs, detector).collect()} == {0: "email:6:24", 1: "phone:5:19,phone:23:39", 2: "", 3: "ip:3:17", 4: ""}
    assert [r.text for r in pii.redact(docs, detector).orderBy("doc_id").collect()][:2] == ["write [EMAIL] now", "call [PHONE] or [PHONE]"]
    span = lambda a, b, **more: F.struct(F.lit(a).alias("start"), F.lit(0).alias("kind"), F.lit(b).alias("stop"), *[F.lit(v).alias(k) for k, v in more.items()])
    base, scored = F.array(span(20, 30)), F.array(*[span(a, b, score=v) for a, b, v in [(0, 5, 1.0), (3, 9, 2.0), (8, 12, 1.5), (12, 14, 0.1), (25, 40, 9.0), (15, 21, 9.0), (30, 31, 0.2)]])
    assert [x.start for x in spark.range(1).select(pii._swept(base, scored).alias("x")).first().x] == [3, 12, 30]


def test_sums_of_two_levels(spark):
    for n in (0, 1, 256, 257, 1000):
        made = spark.range(1).select(pii._before(F.array(*[F.lit(k % 7) for k in range(n)]).cast("array<int>")).alias("x")).first().x
        assert made == [sum(k % 7 for k in range(i)) for i in range(n)]


# ---- 4 and 10 ----


def crc_part(k):
    return zlib.crc32(str(k).encode()) % 5


def test_quality_learns(spark):
    texts = [prose(k, 60) if k % 2 else " ".join(f"{w.upper()}!!" for w in prose(k, 60).split()) for k in range(300)]
    docs = documents(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(1, None), (2, 9)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 307 and all(0 <= r.score <= 1 and r.held_out == (crc_part(r.doc_id) == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 300 and doc_id % 2 = 1").count() >= 145
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic_is_monotone():
    from brightfield.llm.learning import isotonic

    rng = np.random.default_rng(1)
    s = rng.random(500)
    x, y = isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()


def test_toxicity_learns(spark):
    insults = ["blorky", "zanfle", "quimdor"]
    texts = [f"{prose(k, 30)}. {insults[k % 3] if k % 3 == 0 or k % 4 == 0 else 'nothing'} {prose(k + 999, 20)}." if k % 4 == 0 else prose(k, 50) for k in range(600)]
    docs = documents(spark, [*texts, *ODD, "you b.l.o.r.k.y person", "plain words only"])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(rows) == 609
    held = [r for r in rows.values() if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert rows[607].score > rows[608].score and rows[607].score > rows[601].score
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}


def slow_kernel(s, t):
    from itertools import combinations

    sub = lambda x: [("".join(x[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(x)), toxicity.ORDER)]
    return sum(toxicity.DECAY ** (a + b) for x, a in sub(s) for y, b in sub(t) if x == y)


def test_subsequence_kernel_by_brute_force():
    words = ["^idiot", "^idxiot", "^clown", "^banana", "^bandana", "^ab", "^的的的x", "^"]
    known = toxicity.Subsequences(words[:5])
    made = known.sums(words, known.table(words[:5]))
    for i, s in enumerate(words):
        for j, t in enumerate(words[:5]):
            norm = (slow_kernel(s, s) * slow_kernel(t, t)) ** 0.5
            assert made[i, j] == pytest.approx(slow_kernel(s, t) / norm if norm else 0.0)


def test_long_words_are_compared_whole():
    known = toxicity.Subsequences(["^idiot"])
    model = toxicity.ToxicityModel(known, known.table(["^idiot"])[:, 0], 0.0)
    made = model.margins(["^" + "的" * 200 + "idiot" + "的" * 90, "^" + "的" * 300, "^idiot", "^a"])
    assert made[0] > 0 and made[1] == 0 == made[3] and made[2] == pytest.approx(1)


def test_toxicity_of_disguised_insults(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    say = lambda w: f"The edhe of {w} in there thation."
    clean, plain, one, two = (model.scores([say(w) for w in words]) for words in (["table", "nothing", "thation"], ["idiot", "i.d.i.o.t", "c l o w n"], ["idxiot", "clowwn", "wxorthless"], ["idxxiot and a clxown", "stxupid and mor.xon"]))
    assert clean.max() < 0.5 < min(plain.min(), one.min(), two.min())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.predicted for r in rows if r.toxic and r.lang == "en") and sum(r.predicted for r in rows if not r.toxic) <= 0.06 * len(rows)


def test_toxicity_cache_lasts_for_a_batch(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 3)
    known = toxicity.Subsequences(["^idiot"])
    model = toxicity.ToxicityModel(known, known.table(["^idiot"])[:, 0], -0.5)
    for _ in range(2):
        x = model.evidence(["idiot a b. c d e f g h", "idiot some other words", "fine", ""])
        assert x[0, 0] == x[1, 0] > x[2, 0] >= x[3, 0]


# ---- 5 and 6 ----


def encoded(text, end):
    from tokenizers import Tokenizer

    from brightfield.llm.token_ids import tokenizer_path

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [end]


TOKEN_TEXTS = [*ODD, prose(2, 50), "It's DON'T we'll\x1cx <|endoftext|> ½ ２ Ǆ İstanbul é", prose(3, 6000)]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 100)
    docs = documents(spark, TOKEN_TEXTS)
    rows = sorted(token_files.read_token_files(token_files.write_token_files(docs)).collect())
    at = 0
    for k, (t, r) in enumerate(zip(TOKEN_TEXTS, rows, strict=True)):
        ids = encoded(t, token_files.END_ID)
        assert tuple(r) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0))).count() == 0
    no_id = docs.where("doc_id in (3, 4)").unionByName(docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(-(2**63))))
    made = token_files.read_token_files(token_files.write_token_files(no_id)).orderBy("start").collect()
    assert [r.doc_id for r in made] == [None, None, -(2**63), 3, 4] and [r.start for r in made] == list(np.cumsum([0] + [r.n_tokens for r in made])[:-1])


def test_token_files_stay_where_they_are_wanted(spark, tmp_path):
    docs = documents(spark, TOKEN_TEXTS)
    token_files.write_token_files(docs, path=str(tmp_path / "ids"))
    assert token_files.read_token_files(spark.read.parquet(str(tmp_path / "ids"))).count() == len(TOKEN_TEXTS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(spark, name):
    from tokenizers import Tokenizer

    from brightfield.llm import token_ids

    path = token_ids.tokenizer_path(name)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [t or "" for t in TOKEN_TEXTS] + ["hello <|endoftext|> world", "x<|startoftext|>y", "e ́x\ty\r\n z", "ΣΑΣ ΣΑΣ. ﬁ", "你好 世界"]
    library, made = Tokenizer.from_file(path), token_ids.Encoder(path)
    assert made.by_word == (name == "word_bpe_49k.json")
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_in_plain_texts():
    from brightfield.llm import token_ids

    made = token_ids.Encoder(token_ids.tokenizer_path())
    texts = ["one<|endoftext|>two", "<|startoftext|> a b", "<|EndOfText|> x", "<|endoftext|><|endoftext|>", "a <|endoftex|> b", "<| endoftext |>", "plain"]
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)] == [encoded(t, 0)[:-1] for t in texts]
    assert 49407 in np.frombuffer(made.encode(texts)[0], "<u4")


def test_packing(spark):
    docs = documents(spark, TOKEN_TEXTS * 3)
    rows = packing.pack_documents(docs).collect()
    for k, t in enumerate(TOKEN_TEXTS * 3):
        ids, mine = encoded(t, packing.END_ID), sorted(r for r in rows if r.doc_id == k)
        assert [r.length for r in mine] == [len(ids[a : a + 4096]) for a in range(0, len(ids), 4096)]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()) for a in range(0, len(ids), 4096)]
    assert_gapless(rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def assert_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 4097): rng.randrange(1, 400) for _ in range(rng.choice([1, 5, 300]))}
    plan = packing.plan_packing(histogram)
    total = sum(n * c for n, c in histogram.items())
    starts, sequences = plan.arrays()
    lengths = np.repeat(sorted(histogram, reverse=True), [histogram[n] for n in sorted(histogram, reverse=True)])
    k = np.searchsorted(starts, np.arange(len(lengths)), "right") - 1
    filled = np.bincount(sequences[k] + np.arange(len(lengths)) - starts[k], weights=lengths, minlength=plan.n_sequences)
    assert filled.max() <= packing.CAPACITY and filled.min() > 0 and len(filled) == plan.n_sequences
    large = sum(c for n, c in histogram.items() if n > packing.CAPACITY / 2)
    assert plan.n_sequences <= 1.35 * max(total / packing.CAPACITY, large) + 2
    assert plan.n_sequences <= packing.rounded(histogram, [], 0.0).n_sequences


def test_the_program_beats_filling_gaps_alone():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.integers(1200, 1900, 50_000), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    assert packing.plan_packing(histogram).n_sequences < 0.985 * packing.rounded(histogram, [], 0.0).n_sequences


# ---- 7 and 9 ----


def test_html_blocks():
    page = """<html><head><title>T</title><style>p{}</style><script>"<p>no</p>"</script></head><body><nav><a href=x>Menu one</a></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  words &lt;x&gt; and the rest of it<br>goes on</p>
    <aside>see also</aside><ul><li>item one<li>item two</ul><div id="comments"><p>First comment of a reader</p></div></article>
    <form><p>Name</p></form><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst bold words <x> and the rest of it goes on\n\nitem one\n\nitem two"
    assert html_text.main_text("") == "" and html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("<article><p>" + "long text " * 50000).count("long") == 50000


def article_of(page):
    """The text between <article> tags, cut at its paragraphs and headings."""
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect() if "<article>" in (r.html or "")]


@pytest.mark.parametrize("tag", ["<article>", "<div>", ""])
def test_html_rules_need_no_article(pages, tag):
    for page in pages:
        there = page.replace("<article>", tag).replace("</article>", tag.replace("<", "</"))
        assert html_text.main_text(there) == article_of(page)


def unmarked(page):
    """A page without any tag or class that tells menus, adverts and footers from main text."""
    return re.sub(r"</?article>| class=\"ad\"", "", re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", page))


def words_f1(a, b):
    from collections import Counter

    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, x.total() + y.total())


def test_html_text_by_rules_alone(pages):
    assert np.mean([words_f1(html_text.main_text(unmarked(p)), article_of(p)) for p in pages]) > 0.93


@pytest.mark.parametrize("name,value", [("_stops", lambda text: 0.0), ("LINKED", 9.0), ("_inherited", lambda blocks: {id(b): False for b in blocks})])
def test_html_every_pass_counts(pages, monkeypatch, name, value):
    made = [html_text.main_text(unmarked(p)) for p in pages]
    monkeypatch.setattr(html_text, name, value)
    assert made != [html_text.main_text(unmarked(p)) for p in pages]


def test_html_marks_and_neighbours():
    long_ = "It is the text of the page and it is a long one that goes on for a while, as it was to be read by all of us in the end. " * 3
    keywords = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    page = f"""<body class=with-sidebar><header>Site</header><div class="article-header"><h1>Title</h1></div><div id=text><p>{long_}</p><p>Short.</p>
    <table><tr><td>a</td></tr></table></div><div class="comments"><article class=comment><p>{long_}</p></article></div><div><p>{keywords}</p></div></body>"""
    made = html_text.main_text(page).split("\n\n")
    assert made[:3] == ["Title", long_.strip(), "Short."] and "a" in made and len([x for x in made if x == long_.strip()]) == 1
    related = f"<article><h1>T</h1><p>{long_}</p><ul><li><a href=a>Read more of this here</a><li><a href=b>And that</a></ul><p><a href=c>The source of it</a></p><p>{long_}</p></article>"
    assert html_text.main_text(related) == "\n\n".join(["T", long_.strip(), "The source of it", long_.strip()])


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>It is the text of a page and it is one</p>"), (2, None, "<p>It is the text of a page and it is one</p>")], "page_id long, url string, html string")
    rows = html_text.extract(pages).collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, 0)] + [(2, len("It is the text of a page and it is one"))] * 2


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    htmls = [None, "", "x" * 500, "x" * 500, "é😀", "Content-Length: 5\r\n\r\nWARC/1.1"]
    pages = spark.createDataFrame([(k, None if k % 2 else f"http://h/{k}\n", h) for k, h in enumerate(htmls)] + [(None, "u", "gone")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert set(rows) == {*range(6), None} and rows[None].record_type == "response" and rows[None].payload_bytes == 4
    assert [(rows[k].record_type, rows[k].refers_to, rows[k].payload_bytes) for k in range(6)] == [("revisit", 1, 0), ("response", None, 0), ("revisit", 3, 500), ("response", None, 500), ("response", None, 6), ("response", None, len(htmls[5]))]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_normaliser_takes_any_stream():
    import gzip

    made = [warc.record(k, "u", "d", 3, None, b"abc" * k) for k in range(9)]
    stream = gzip.compress(b"".join(made[:5])) + gzip.compress(made[5]) + gzip.compress(b"".join(made[6:]))
    archive, index = warc.normalise(stream)
    assert [warc.read_member(archive, *e)[1] for e in index] == [b"abc" * k for k in range(9)]
    with pytest.raises(ValueError):
        warc.normalise(stream[:-9])


# ---- 8 ----


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, percent=85):
    sets, n = [shingles(t) for t in texts], len(texts)
    label = list(range(n))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(k) for k in range(n)], [len(s) for s in sets]


@pytest.mark.parametrize("rule", [near_dedup.AT_85, near_dedup.AT_80])
@pytest.mark.parametrize("chunk,loose", [(near_dedup.CHUNK_SHINGLES, 12), (900, 12), (900, 0)])
def test_near_dedup_by_brute_force(spark, monkeypatch, chunk, loose, rule):
    monkeypatch.setattr(near_dedup, "LOOSE", loose)
    rng = random.Random(9)
    texts = list(ODD)
    for g in range(3):
        base = prose(g, 100 + 30 * g).split()
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(9))
            texts.append(" ".join(copy))
    texts += [texts[20]] * 5 + ["one"]
    found = {r.doc_id: r for r in near_dedup.find_components(documents(spark, texts), chunk, rule).collect()}
    label, sizes = brute_components(texts, rule.percent)
    assert [found[k].component_id for k in range(len(texts))] == label
    assert [found[k].n_shingles for k in range(len(texts))] == sizes
    assert all(found[k].kept == (label[k] == k) for k in range(len(texts)))


def test_near_dedup_stage_keeps_columns(spark):
    docs = documents(spark, [*ODD, "one", prose(1, 30), prose(1, 30)])
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    assert near_dedup.find_components(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (100, 100)], "a long, b long")
    made = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert made == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# ---- the pipeline ----


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert_gapless(packed)


def test_pipeline_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.count() == 0 and (name == "packing" or made.columns == docs.columns)
