"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks: those in containers that never hold main text (menus,
footers, asides, forms, what is hidden or marked as an advert, notice or comment) and those made of links are bad; a container whose
name only touches such a mark, and an article whose name does, is judged by its own text; long blocks with many stop words are good; where a page's stop words are so few that they tell nothing (tables, other languages), length alone decides.
Short, middling and sparse blocks stay open. In the second pass an open block takes the label of its nearest decided neighbours: those in
its own container first, else in the container around it, and so on, up to an article or main element, which stands for itself
where nothing in it is decided. Where an article holds good blocks, blocks outside of any article are not main text.

Defined cases: a null or empty page, and one with only boilerplate, has an empty text; tags left open end with their container;
a "<" that opens no tag is text; comments, scripts, styles and other raw content are dropped; repeated rows are handled alike.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.llm.common import map_texts, struct_type

SHORT, LONG = 70, 200
#: The share of a block's characters in links over which it is bad.
LINKED = 0.33
#: The share of stop words of good blocks, and the one of a whole page under which stop words tell nothing.
STOPS, TELLING = 0.20, 0.10

# Function words of the languages of the pages, and HTML's element kinds.
STOP_WORDS = frozenset(
    """the of and to a in is it that for on as with was be by are this at from or an not have has he she they we you but his her
    de la le et les des un une en du que qui dans pour sur pas est par au aux avec ce il elle ne se plus son sa ses ou mais nous vous
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei
    el los las y del se por con una su para al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
RAW = frozenset("script style noscript template textarea title iframe object svg select button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
#: Words of a class, id or role that mark what surrounds an article; weak ones count only outside of articles.
STRONG = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert
    popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside related recommended recommendations social
    newsletter subscribe subscription signup login pagination pager complementary contentinfo disclaimer footer masthead topbar toolbar widget""".split()
)
#: What readers write; alone among these words they also mark an article element.
READERS = frozenset("comment comments disqus respond replies reply".split())
WEAK = frozenset("header side share sharing tags search legal copyright foot".split())
#: Before a mark these words turn it into a layout's name (with-sidebar, article-header).
LAYOUT = frozenset("with has no without article entry post content main page left right".split())
#: Beside a mark these words say nothing; any other word makes the mark doubtful (cookie-recipe), and the container's own text decides.
PLAIN = frozenset("box wrapper wrap container block section list item items inner outer area bar text panel group row col column links top bottom site global js id".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    outside: bool  # in a container that never holds main text
    doubtful: tuple[int, ...]  # the containers around it that a class marks, unless their own text is good
    article: int  # number of the article or main element around it, 0 for none
    tag: str
    path: tuple[int, ...]  # the containers around it, outermost first
    edge: int = 0  # how many of them are around its article, or 0
    label: str = ""


def _marked(name: str, attributes: str, in_article: bool) -> str:
    """"" for a container that nothing marks, "yes" for a marked one, "perhaps" where its own text decides."""
    found = ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "yes"
        if key in ("class", "id", "role") and name not in ("html", "body", "main"):
            for token in value.split():
                words = [w for w in re.split(r"[-_]+", token) if w]
                known = STRONG | READERS | (WEAK if not in_article and name != "article" else frozenset())
                for before, word in zip(["", *words], words):
                    if word in known and before not in LAYOUT and (name != "article" or word in READERS):
                        if all(w in known or w in PLAIN or w in LAYOUT or w.isdigit() for w in words):
                            return "yes"
                        found = "perhaps"
    return found


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    open_: list[tuple[str, bool, int, int, bool]] = []  # element, whether it is boilerplate, its article, its number, whether it is doubtful
    parts: list[str] = []
    linked, in_link, articles, containers, at, tag = 0, False, 0, 0, 0, ""

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            article = open_[-1][2] if open_ else 0
            edge = next((k for k, x in enumerate(open_) if x[2]), -1) + 1
            out.append(Block(text, min(linked, len(text)), any(x[1] for x in open_), tuple(x[3] for x in open_ if x[4]), article, tag, tuple(x[3] for x in open_), edge))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "title"):
                at = size
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            continue
        close()
        tag = "" if closing else name
        if name == "p" or name in VOID:
            continue
        if closing:
            in_link = False
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
        else:
            article = open_[-1][2] if open_ else 0
            mark = _marked(name, attributes, article > 0)
            boiler = name in BOILERPLATE or name == "header" and not article or mark == "yes"
            if name in ("article", "main") and not article and not boiler and not any(x[1] for x in open_):
                articles += 1
                article = articles
            containers += 1
            open_.append((name, boiler, article, containers, mark == "perhaps"))
    close()
    return out


def _stops(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _decide(b: Block, telling: bool, headed: bool) -> str:
    """``headed``: the block is an item of a list that follows a heading."""
    n = len(b.text)
    if b.outside or not b.article and n < LONG and ("©" in b.text or b.text.startswith("Copyright")):
        return "bad"
    if b.linked > LINKED * n:
        # A paragraph or heading of an article may be one link, and so may the items under a heading (sources).
        return "open" if b.article and (b.tag in ("p", *HEADINGS, "blockquote") or headed) else "bad"
    return "good" if n >= LONG and (not telling or _stops(b.text) >= STOPS) else "open"


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    body = [b for b in blocks if not b.outside and not b.linked]
    telling = _stops(" ".join(b.text for b in body)) >= TELLING
    headed = False
    for b in blocks:
        headed = b.tag == "li" and headed
        b.label = _decide(b, telling, headed)
        headed = headed or b.tag in HEADINGS
    redeemed = {c for b in blocks if b.label == "good" for c in b.doubtful}
    for b in blocks:
        if any(c not in redeemed for c in b.doubtful):
            b.outside, b.label = True, "bad"
    if not any(b.label == "good" for b in blocks):  # a page of short blocks: its unlinked paragraphs
        for b in blocks:
            if b.label == "open" and not b.linked and (b.tag in ("p", "pre", "blockquote") or len(b.text) >= SHORT):
                b.label = "good"
    around = any(b.label == "good" and b.article for b in blocks)
    inherited = _inherited(blocks)
    good = [b for b in blocks if (b.label == "good" or b.label == "open" and inherited[id(b)]) and (b.article or not around)]
    return "\n\n".join(b.text for b in good)


def _inherited(blocks: list[Block]) -> dict[int, bool]:
    """For every open block whether its nearest decided neighbours, of the narrowest container that has any, make it good."""
    scopes: dict[tuple[int, ...], list[int]] = {}
    for k, b in enumerate(blocks):
        if b.label != "open" and not b.outside:
            for depth in range(len(b.path) + 1):
                scopes.setdefault(b.path[:depth], []).append(k)
    out = {}
    for k, b in enumerate(blocks):
        if b.label != "open":
            continue
        found: list[int] = []
        for depth in range(len(b.path), b.edge - 1, -1):
            decided = scopes.get(b.path[:depth], [])
            at = bisect_left(decided, k)
            found = decided[max(at - 1, 0) : at + 1]
            if found:
                break
        least = min((abs(i - k) for i in found), default=0)
        near = {blocks[i].label for i in found if abs(i - k) == least}
        out[id(b)] = "good" in near or not found and b.article > 0
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    made = map_texts(pages, lambda texts: [(main_text(t),) for t in texts], struct_type("text string"), "html", ["page_id", "url"])
    return made.select("doc.page_id", "doc.url", "found.text", F.char_length("found.text").cast("bigint").alias("n_chars"))
