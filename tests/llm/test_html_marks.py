"""Main text that class names, signs and links must not take away."""

import random
import re

import pytest

from brightfield.llm import html_text
from tests.llm.test_operators import article_of, pages  # noqa: F401

LONG = "It is the text of the page and it is a long one that goes on for a while, as it was to be read by all of us in the end. " * 3


@pytest.mark.parametrize("name", ["post related-widget", "social-history", "promo", "ad-1234 featured", "newsletter"])
def test_no_class_condemns_an_article(name):
    page = f'<body><nav><a href=x>Menu</a></nav><article class="{name}"><h1>T</h1><p>{LONG}</p><p>Short.</p></article></body>'
    assert html_text.main_text(page) == f"T\n\n{LONG.strip()}\n\nShort."


@pytest.mark.parametrize("name", ["cookie-recipe", "navigation-history", "alert-systems-guide"])
def test_a_name_that_only_touches_a_mark_is_judged_by_its_text(name):
    page = f'<body><div class="{name}"><h1>Biscuits</h1><p>{LONG}</p><p>Bake them.</p></div><div class="{name}-x"><p>Buy now</p></div></body>'
    assert html_text.main_text(page) == f"Biscuits\n\n{LONG.strip()}\n\nBake them."


@pytest.mark.parametrize("name", ["cookie-notice", "ad", "ads box", "sidebar-inner", "comments", "reply-list", "footer"])
def test_plain_marks_still_condemn(name):
    page = f'<body><div><p>{LONG}</p></div><div class="{name}"><p>We say: {LONG}</p></div></body>'
    assert html_text.main_text(page) == LONG.strip()


def test_readers_articles_stay_out():
    page = f"<body><article><p>{LONG}</p></article><article class=comment><p>I say: {LONG}</p></article></body>"
    assert html_text.main_text(page) == LONG.strip()


def test_signs_formulas_and_sources_in_an_article():
    page = f"""<article><h1>Marks</h1><p>The sign © stands for a right.</p><p>Copyright is a law of many lands.</p><p>Let <math><mi>x</mi><mo>+</mo><mi>y</mi></math> be.</p><p>{LONG}</p>
    <h4><a href=a>A linked heading</a></h4><p>More.</p><h4>Sources</h4><ul><li><a href=b>First source</a></li><li><a href=c>Second source</a></li></ul></article><p>© 2020 us</p>"""
    made = html_text.main_text(page).split("\n\n")
    assert made == ["Marks", "The sign © stands for a right.", "Copyright is a law of many lands.", "Let x+y be.", LONG.strip(), "A linked heading", "More.", "Sources", "First source", "Second source"]


def test_given_pages_with_random_class_names(pages):  # noqa: F811
    rng = random.Random(3)
    for page in pages:
        renamed = re.sub(r'class="[^"]*"', lambda m: f'class="c{rng.randrange(10**6)}"', page)
        assert html_text.main_text(renamed) == article_of(page)


def test_clashing_columns_null_ids_and_empty_tables(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x", 7), (None, None, f"<p>{LONG}</p>", None, None), (1, "u", None, "y", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, len(LONG.strip())), (None, len(LONG.strip())), (1, 0)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
