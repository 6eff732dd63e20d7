"""Crawled pages against plain Python: images, address evidence, links, robots rules."""

import html as html_library
import json
import random
import re
import unicodedata
from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest

from brightfield.functions import jsonld
from brightfield.operators.robots import decided, robot_rules
from brightfield.plans import crawl
from tests.conftest import SF


def attributes(tag):
    found = {}
    for name, a, b, c in re.findall(r"""([:\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", tag):
        found.setdefault(name.lower(), html_library.unescape(a or b or c))
    return found


def address_of(raw, base):
    url = urljoin(base.split("#")[0], raw.strip().split("#")[0])
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        return None
    return url.replace(" ", "%20").replace('"', "%22")


def one_space(s):
    return re.sub(r"[\s\xa0]+", " ", s).strip()


def brute_images(page, base, limit=crawl.IMAGES):
    title = one_space(html_library.unescape((re.search(r"<title\b[^>]*>(.*?)</title\s*>", page, re.S | re.I) or [None, ""])[1]))[:300]
    says = lambda *v: bool(re.search(crawl.LOGO, " ".join(x for x in v if x).lower()))
    made = []
    meta = {}
    for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
        a = attributes(tag)
        key = (a.get("property") or a.get("name") or "").lower()
        if key and a.get("content", "").strip():
            meta.setdefault(key, a["content"].strip())
    for i, key in enumerate(("og:image:secure_url", "og:image", "twitter:image")):
        if key in meta:
            alt = meta.get("og:image:alt") or meta.get("twitter:image:alt") or title
            logo = says(meta[key], alt)
            made.append((meta[key], "og_image" if key[:2] == "og" else "twitter_image", alt, logo, (400 if logo else 1000) - i))
    for block in re.findall(r"<script\b[^>]*type=\"application/ld\+json\"[^>]*>(.*?)</script>", page, re.S):
        try:
            nodes = [json.loads(block)]
        except ValueError:
            continue
        while nodes:
            node = nodes.pop(0)
            if isinstance(node, list):
                nodes = node + nodes
                continue
            nodes = [node.get("@graph", [])] + nodes
            if not re.search(crawl.PLACE_TYPES, str(node.get("@type", "")).lower()):
                continue
            first = lambda v: v if isinstance(v, str) else v[0] if isinstance(v, list) else v["url"] if v else None
            image, logo, alt = first(node.get("image")), first(node.get("logo")), node.get("name") or title
            if image:
                made.append((image, "jsonld_image", alt, says(image, alt), 390 if says(image, alt) else 900))
            if logo and logo != image:
                made.append((logo, "jsonld_logo", alt, True, 390))
    for tag in re.findall(r"<img\b[^>]*>", page, re.I):
        a = attributes(tag)
        sizes = [(p.split() + [""])[:2] for p in (a.get("data-lazy-srcset") or a.get("bv-data-srcset") or a.get("data-srcset") or a.get("srcset") or "").split(",") if p.strip()]
        sizes = sorted(((int(w[:-1]) if re.fullmatch(r"\d+w", w) else 0, u) for u, w in sizes if not u.startswith("data:")), key=lambda x: -x[0])
        raw = (sizes[0][1] if sizes else "") or a.get("data-lazy-src") or a.get("bv-data-src") or a.get("data-src") or a.get("src")
        if not raw:
            continue
        alt = a.get("alt") or title
        wide = int((re.match(r"\s*(\d+)", a.get("width", "")) or [0, 0])[1]) or (sizes[0][0] if sizes else 0)
        logo = says(raw, alt, *[a.get(k) for k in ("class", "id", "data-ux", "data-aid", "data-testid", "aria-label")])
        if 0 < wide < 300 and not logo:
            continue
        hero = bool(re.search(crawl.HERO, f"{a.get('class', '')} {a.get('id', '')}".lower()))
        made.append((raw, "hero_img" if hero else "img", alt, logo, 350 + min(wide, 2000) / 20 if logo else (800 if hero else 500) + min(wide, 2000) / 10))
    for tag in re.findall(r"<[^>]+(?:class|id)\s*=\s*(?:\"[^\"]*(?:hero|masthead|banner|cover)[^\"]*\"|'[^']*(?:hero|masthead|banner|cover)[^']*')[^>]*>", page, re.I):
        style = re.search(r"background(?:-image)?\s*:[^;]*url\(\s*[\"']?([^)'\"\s]+)", attributes(tag).get("style", ""), re.I)
        if style:
            made.append((style[1], "hero_background", title, False, 750))
    by_url = {}
    for raw, source, alt, logo, score in made:
        url, alt = address_of(html_library.unescape(raw), base), one_space(alt)[:300]
        if not url or re.search(crawl.JUNK_URL, url.lower()) or re.search(crawl.JUNK_ALT, alt.lower()):
            continue
        logo = logo or says(url, alt)
        if re.search(r"\.svg($|[?#])", url.lower()) and not logo:
            continue
        new = {"url": url, "source": source, "alt": alt, "logo": logo, "score": score}
        old = by_url.get(url)
        if old:
            best = old if old["score"] >= score else new
            either = old["logo"] or logo
            new = best | {"logo": either, "score": min(best["score"], 400) if either else best["score"]}
        by_url[url] = new
    every = sorted(by_url.values(), key=lambda x: (-x["score"], x["url"]))
    plain, logos = [x for x in every if not x["logo"]], [x for x in every if x["logo"]]
    chosen = plain[: limit - 1] + logos[:1] if logos and limit > 1 else (plain or logos)[:limit]
    return [(i + 1, x["url"], x["source"], x["alt"] or None, "logo" if x["logo"] else None) for i, x in enumerate(chosen)]


def test_images_of_crawled_pages_by_brute_force(spark):
    pages = crawl.crawled(spark, SF)
    want = {(r.page_id, *x) for r in pages.collect() for x in brute_images(r.html, r.url)}
    got = [tuple(r) for r in crawl.image_candidates(pages).collect()]
    assert len(got) == len(want) > 100 and set(got) == want
    assert {x[3] for x in got} >= {"og_image", "jsonld_image", "jsonld_logo", "img", "hero_img", "hero_background"} and {x[5] for x in got} == {None, "logo"}


def test_images_that_share_addresses_and_limits(spark):
    many = "".join(f'<img src="/p{k}.jpg" width="{300 + k}">' for k in range(12))
    cases = [many + '<img src="/p3.jpg" class="logo"><img src="/p3.jpg" class="hero" width=2000>', many, '<img src="a.svg"><img src="logo.svg">', "", "<img src='x.gif'><img srcset='data:x 1w, , y.jpg'>"]
    pages = spark.createDataFrame([(k, "https://h.example/d/", c) for k, c in enumerate(cases)] + [(90, None, many), (91, "ftp://x/", many)], "page_id long, url string, html string")
    for limit in (1, 3, 8):
        got = sorted(tuple(r) for r in crawl.image_candidates(pages, limit).collect())
        assert got == sorted((k, *x) for k, c in enumerate(cases) for x in brute_images(c, "https://h.example/d/", limit))
    assert crawl.image_candidates(pages.limit(0)).count() == 0


def fold(s):
    return re.sub(r"[^\w]+|_", " ", "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()).strip()


def names(text, place):
    a, b = re.sub(" +", " ", fold(text)), re.sub(" +", " ", fold(place or ""))
    return bool(b) and (b in a or a in b)


def brute_written(text, source, row):
    out = []
    for m in re.finditer(crawl.STREET, text):
        context, street = text[max(0, m.start() - 40) : m.end() + 180], one_space(m[0])
        numbers = re.findall(r"\b\d+\b", street)
        if not names(context, row.locality) or len(numbers) > 1 or numbers[:1] == ["0"] or re.search(crawl.NO_STREET, street.lower()):
            continue
        five = [p for p in re.findall(r"\b\d{5}(?:-\d{4})?\b", context) if p not in numbers]
        other = re.search(r"\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b", context, re.I)
        postal = five[-1] if five else other[0].upper() if other else None
        if postal or (row.country_code not in ("US", "CA") and (row.region is None or names(context, row.region))):
            out.append((source, street, row.locality, row.region, postal))
    return out


def brute_addresses(row):
    page, out = row.html, []
    for attrs, block in re.findall(r"<script\b([^>]*)>(.*?)</script\s*>", page, re.S | re.I):
        if "ld+json" not in attrs and "__NEXT_DATA__" not in attrs:
            continue
        for o in jsonld.walked(html_library.unescape(block)):
            low = {re.sub("[^a-z0-9]", "", k.lower()): v for k, v in o.items() if not k.startswith("#") and v.strip()}
            pick = lambda names: next((one_space(low[n]) for n in names if n in low), None)
            fields = [pick(crawl.FIELDS[f]) for f in ("street", "locality", "region", "postal")]
            if "postaladdress" in o["#type"].lower() or pick(crawl.WHOLE_STREETS) or fields[1] and fields[3]:
                out.append(("structured", *fields))
    for key, value in re.findall(r"itemprop=\"(streetAddress)\" content=\"([^\"]*)\"", page):
        out.append(("structured", value, None, None, None))
    bare = re.sub(r"<(script|style)\b[^>]*>.*?</\1\s*>", " ", page, flags=re.S | re.I)
    seen = one_space(html_library.unescape(re.sub(r"<[^>]+>", " ", bare)))
    out += brute_written(seen, "visible", row)
    links = []
    for a, b in re.findall(r"\b(?:href|src|data-src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", page, re.I):
        url = address_of(html_library.unescape(a or b), row.url)
        if url and url not in links and re.search("maps|direction|daddr=|destination=|query=", url.split("://", 1)[1].lower()):
            links.append(url)
    for url in links:
        asked = dict(reversed(parse_qsl(urlsplit(url).query)))
        for key in ("q", "query", "destination", "daddr", "address"):
            if re.search(r"\d", asked.get(key, "")):
                out += brute_written(one_space(asked[key]), "directions", row)
    text, raw = fold(seen), fold(html_library.unescape(page))
    squeeze = lambda s: re.sub(" +", " ", s)
    text, raw = squeeze(text), squeeze(raw)
    there = lambda s: squeeze(fold(s)) in text or squeeze(fold(s)) in raw
    if there(row.address) and there(row.locality) and (row.country_code not in ("US", "CA") or there(row.postal_code)):
        out.append(("literal", row.address, row.locality, row.region, row.postal_code))
    return [(i + 1, *x) for i, x in enumerate(list(dict.fromkeys(out))[: crawl.ADDRESSES])]


def test_address_evidence_by_brute_force(spark):
    pages = crawl.candidates(crawl.crawled(spark, SF))
    want = {(r.page_id, *x) for r in pages.collect() for x in brute_addresses(r)}
    got = {tuple(r) for r in crawl.address_evidence(pages).collect()}
    assert got == want
    assert {x[2] for x in got} == {"structured", "visible", "directions", "literal"}


@pytest.mark.parametrize(
    "text,street,postal",
    [
        ("We are at 12 Harbour Street, Lyon 69001, France", "12 Harbour Street", "69001"),
        ("0 Harbour Street, Lyon 69001", None, None),
        ("12 Harbour Street 14, Unit 7, Lyon 69001", "12 Harbour Street", "69001"),
        ("12 Harbour Street, Unit 7, Lyon 69001", None, None),
        ("12 Harbour Street, Paris 69001", None, None),
        ("open 9 hours Street Way, Lyon 69001", None, None),
        ("12a-14 rue de l'Église St, LYON, k1a 0b1", "12a-14 rue de l'Église St", "K1A 0B1"),
        ("12 Harbour Street, Lyon", None, None),
    ],
)
def test_written_addresses(spark, text, street, postal):
    df = spark.createDataFrame([(1, "https://h.example/", f"<p>{text}</p>", "x", "Lyon", "RH", "69001", "US")], "page_id int, url string, html string, address string, locality string, region string, postal_code string, country_code string")
    got = [(r.street, r.postal) for r in crawl.address_evidence(df).where("source = 'visible'").collect()]
    assert got == ([(street, postal)] if street else [])


def test_pages_without_anything(spark):
    schema = "page_id int, url string, html string, address string, locality string, region string, postal_code string, country_code string"
    df = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, "u", "", "1 a Street", None, None, None, None), (3, "https://h.example/", '{"address":{"city":"Lyon","zip":69001,"x":{"y":[1,{"street":"2 Rue"}]}}}', "7 x", "Lyon", None, None, None)], schema)
    assert [tuple(r) for r in crawl.address_evidence(df).collect()] == [(3, 1, "structured", None, "Lyon", None, "69001")]
    assert crawl.address_evidence(df.limit(0)).count() == 0


def test_json_walks_any_depth():
    deep = {"a": 1}
    for _ in range(150):
        deep = {"next": [deep]}
    assert jsonld.walked(json.dumps(deep))[-1] == {"a": "1", "#type": ""}
    assert jsonld.walked("[" * 5000 + "]" * 5000) == [] and jsonld.walked("{broken") == [] and jsonld.walked('"text"') == []
    top = jsonld.walked('{"@graph":[{"@type":["A","B"],"image":[{"url":"u"}],"logo":{"contentUrl":"l"},"part":{"name":"n"}}],"x":{"y":true}}')
    assert [("#top" in o, o["#type"]) for o in top] == [(True, ""), (True, "A B")] + [(False, "")] * 4
    assert top[1]["#image"] == "u" and top[1]["#logo"] == "l" and top[1]["part"] == "n"


def brute_allowed(body, path, agent):
    groups, group = [], None
    for line in re.split(r"\r?\n", body):
        line = re.sub("#.*", "", line).strip()
        if ":" not in line:
            continue
        field, value = line.split(":", 1)
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if group is None or group[1]:
                group = ([], [])
                groups.append(group)
            group[0].append(value.lower())
        elif field in ("allow", "disallow") and group:
            group[1].append((field == "allow", value))
    mine = [g for g in groups if agent.lower() in g[0]] or [g for g in groups if "*" in g[0]]
    won = None
    for allow, rule in (r for g in mine for r in g[1] if r[1]):
        end = "$" if rule.endswith("$") else ""
        m = re.match(".*".join(map(re.escape, (rule[:-1] if end else rule).split("*"))) + end + ("" if not end else r"(?!\n)"), path)
        if m and (won is None or (len(m[0]), allow) > won):
            won = (len(m[0]), allow)
    return won[1] if won else True


def test_robots_by_brute_force(spark):
    rng = random.Random(2)
    piece = lambda: rng.choice(["a", "b", "/", "*", "a/b", ".html", "?", "\\E", "(", "+", "$"])
    texts = {}
    for h in range(30):
        lines = []
        for _ in range(rng.randrange(0, 14)):
            kind = rng.choice(["User-agent: *", "user-agent: Fox", "User-Agent: other", "Allow: ", "Disallow: ", "Disallow: ", "Disallow: ", "Sitemap: /x", "# note", "nonsense"])
            lines.append(kind + ("/" * rng.randrange(2) + "".join(piece() for _ in range(rng.randrange(0, 4))) + rng.choice(["", "", "$", "  # why"]) if "llow" in kind else ""))
        texts[f"h{h}"] = rng.choice(["\n", "\r\n"]).join(lines)
    paths = ["/" + "".join(rng.choice(["a", "b", "/", "a/b", ".html", "?", "\\E", "(", "+"]) for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    asked = spark.createDataFrame([(k, h, p) for h in texts for k, p in enumerate(paths)], "id long, host string, path string")
    rules = robot_rules(spark.createDataFrame(list(texts.items()), "host string, body string"))
    for agent in ("fox", "Nobody"):
        got = {(r.host, r.path): r.allowed for r in decided(asked, rules, agent).collect()}
        assert got == {(h, p): brute_allowed(b, p, agent) for h, b in texts.items() for p in paths}
    assert decided(asked, rules, "fox").count() == asked.count()
    assert decided(asked.limit(0), rules, "fox").count() == 0
