"""Crawled pages: links, clinician pages, robots rules, images, address evidence.

The given pages hold few links and no images or addresses, so every page gets some fragments of markup, chosen by its number; the rules
under test read the raw markup, in the queries and in their SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.functions import geo, jsonld, markup, text, urls
from brightfield.functions.binding import let
from brightfield.operators.robots import decided, robot_rules
from brightfield.registry import query
from brightfield.roles import import_in_workers, read

FRAGMENTS = (
    '<a href="/team">Our Team</a>',
    "<a class=\"nav\" href='../about/../doctors/./{id}?x=1#top'>Meet the <b>doctors</b></a>",
    '<a href="//{host}/our-staff/">Staff</a><a href="//{host}/our-staff">Our staff again</a>',
    "<a href=people>Who we are</a>",
    '<a href="https://other.example.org/team">Team elsewhere</a>',
    '<a href="mailto:team@example.org">Team mail</a><a href="javascript:void(0)">About</a>',
    '<A HREF="?staff={id}&amp;b=2">LEADERSHIP</A>',
    '<a href="#team">team</a><a href="">about us</a>',
    '<a data-href="/x" href="http://{host}:8080/team">Team port</a>',
    '<a href="/prices">Prices</a><a href=" /Medical Director ">x</a>',
    '<img src="/img/front-{id}.jpg" class="hero" width="1200" alt="Front desk">',
    '<img srcset="a-{id}.jpg 320w, b-{id}.jpg 960w" src="c.jpg">',
    '<img data-src="/logo-{id}.png" alt="Logo of the house" width="90"><img src="/logo-small.svg" class="logo">',
    '<img src=\'/pixel.gif\'><img src="/thumb.jpg" width="120"><img src="//cdn.example.org/x {id}.webp?v=1#f" alt="a &amp; b">',
    '<meta property="og:image" content="https://cdn.example.org/og/{id}.jpg"><meta name="og:image:alt" content="Shared view">',
    "<div style=\"color:red;background-image: url('../bg-{id}.jpg')\" class=\"page banner\"></div><img src=\"/img/front-{id}.jpg\">",
    '<script type="application/ld+json">{"@graph":[{"@type":"MedicalClinic","name":"House {id}","image":["/ld/{id}.jpg"],"logo":{"url":"/ld/brandmark.svg"}}]}</script>',
    '<script type="application/ld+json">{broken</script><img src="/ld/{id}.jpg" alt="wordmark">',
    "<p>Find us at {number} {place} Street, Suite B, {place}, IL {postal}.</p><p>{number} Old {place} Road, Suite 4, {place} {postal}</p>",
    "<p>Our clinic hours 9 Medical Way, {place}</p><p>0 {place} Street, {place} {postal}</p><p>77 Long Harbour Road, Faraway 99999</p>",
    '<a href="https://maps.example.org/?q={number}+{place}+Street,+{place}+{postal}">Map</a><iframe src="/directions?daddr=5 Main St, {place}, ON K1A 0B1"></iframe>',
    '<script type="application/ld+json">{"@graph":[{"@type":"Place","address":{"@type":"PostalAddress","streetAddress":"{number} {place} Street","addressLocality":"{place}","postalCode":"{postal}"},"geo":{"latitude":"{lat}","longitude":-71.5}}]}</script>',
    '<span itemprop="streetAddress" content="{number} {place} Street"></span>',
    '<script id="__NEXT_DATA__">{"props":{"city":"{place}","zip":{postal},"lat":0,"lng":0}}</script><p>{number} {place} St</p>',
    "<p>We offer small ring and <b>Red</b> widget therapy, no blue-bolt.</p>",
)


def _crawled_sql() -> str:
    def one(k: int, text: str) -> str:
        quoted = text.replace("'", "''")
        for name, value in (("id", "CAST(page_id AS VARCHAR)"), ("host", "host"), ("place", "place"), ("number", "CAST(page_id % 89 + 1 AS VARCHAR)"), ("postal", "CAST(10000 + page_id AS VARCHAR)"), ("lat", "CAST(page_id % 80 AS VARCHAR)")):
            if "{" + name + "}" in text:
                quoted = f"replace({quoted}, '{{{name}}}', {value})" if quoted.startswith("replace(") else f"replace('{quoted}', '{{{name}}}', {value})"
        return f"CASE WHEN (page_id * 7 + {3 * k}) % 11 < 4 THEN {quoted if quoted.startswith('replace(') else chr(39) + quoted + chr(39)} ELSE '' END"

    return f"""crawled AS (SELECT page_id, url, host, place, html || {" || ".join(one(k, t) for k, t in enumerate(FRAGMENTS))} AS html
  FROM (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, coalesce(c_mktsegment, 'SPRINGFIELD') AS place FROM pages LEFT JOIN customer ON c_custkey = page_id))"""


CRAWLED = _crawled_sql()


def crawled(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, host, place, html with fragments."""
    import_in_workers(spark)
    place = read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_mktsegment").alias("place"))
    pages = read(spark, d, "pages").select("page_id", "url", "html", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).join(place, "page_id", "left")
    pages = pages.withColumn("place", F.coalesce("place", F.lit("SPRINGFIELD")))
    page = F.col("page_id")
    values = {"id": page.cast("string"), "host": F.col("host"), "place": F.col("place"), "number": (page % 89 + 1).cast("string"), "postal": (10000 + page).cast("string"), "lat": (page % 80).cast("string")}

    def one(k: int, text: str) -> Column:
        made = F.lit(text)
        for name, value in values.items():
            if "{" + name + "}" in text:
                made = F.replace(made, F.lit("{" + name + "}"), value)
        return F.when((page * 7 + 3 * k) % 11 < 4, made).otherwise("")

    return pages.withColumn("html", F.concat("html", *[one(k, t) for k, t in enumerate(FRAGMENTS)]))


# ---- links ----

# SQL: references on a page with scheme, host, folder path and query become absolute addresses, step by step.
_RESOLVE = r"""
based AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS base_path,
  regexp_extract(regexp_replace(url, '#.*$', ''), '[?].*$') AS base_query FROM {source}),
cut AS (SELECT *, regexp_replace(regexp_replace(replace(replace(ref, '&amp;', '&'), '&#38;', '&'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '#.*$', '') AS r FROM based),
kinds AS (SELECT *, CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'absolute' WHEN r LIKE '//%' THEN 'host' WHEN r LIKE '/%' THEN 'root' WHEN regexp_replace(r, '[?].*$', '') <> '' THEN 'relative' WHEN r <> '' THEN 'query' ELSE 'same' END AS kind FROM cut),
whole AS (SELECT *, CASE WHEN kind = 'absolute' THEN r WHEN kind = 'host' THEN scheme || ':' || r WHEN kind = 'root' THEN scheme || '://' || host || r WHEN kind = 'relative' THEN scheme || '://' || host || regexp_extract(base_path, '^.*/') || r
  WHEN kind = 'query' THEN scheme || '://' || host || base_path || r ELSE scheme || '://' || host || base_path || base_query END AS w FROM kinds),
split AS (SELECT *, lower(regexp_extract(w, '(?i)^(https?)://', 1)) AS s2, lower(regexp_extract(w, '(?i)^https?://([^/?]*)', 1)) AS h2, regexp_extract(w, '(?i)^https?://[^/?]*([^?]*)', 1) AS p2, array_to_string([CASE WHEN regexp_matches(ch, '[^!-~]|["<>`{{}}]') THEN url_encode(ch) ELSE ch END FOR ch IN string_split(regexp_extract(w, '[?].*$'), '')], '') AS q2 FROM whole),
walked AS (SELECT *, string_split(CASE WHEN p2 = '' THEN '' ELSE p2[2:] END, '/') AS segments FROM split WHERE s2 <> '' AND regexp_matches(h2, '^[a-z0-9_-]+([.][a-z0-9_-]+)*[.]?(:[0-9]{{1,5}})?$')),
folded AS (SELECT *, list_reduce(list_prepend('', segments), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) || CASE WHEN segments[-1] IN ('.', '..') THEN '/' ELSE '' END AS p3 FROM walked),
resolved AS (SELECT *, s2 || '://' || CASE WHEN s2 = 'http' THEN regexp_replace(h2, ':80$', '') ELSE regexp_replace(h2, ':443$', '') END AS origin, array_to_string([CASE WHEN regexp_matches(ch, '[^!-~]|["<>`{{}}]') THEN url_encode(ch) ELSE ch END FOR ch IN string_split(CASE WHEN p3 = '' THEN '/' ELSE p3 END, '')], '') AS p4 FROM folded)"""

_HREF = "regexp_replace(regexp_extract({tag}, '(?is)(?:^|[\\s\"''/])href\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>\"'']+)', 1), '^[\"'']|[\"'']$', '', 'g')"


def _with_base(pages: DataFrame) -> DataFrame:
    return pages.withColumn("base", urls.parts(F.col("url")))


@query("x2_links", f"WITH {CRAWLED}, tags AS (SELECT page_id, url, host, {_HREF.format(tag='tag')} AS ref FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*>')) AS tag FROM crawled)), {_RESOLVE.format(source='tags')} SELECT DISTINCT page_id, origin || p4 || q2 AS href FROM resolved")
def x2(spark: SparkSession, d: str) -> DataFrame:
    """The absolute addresses that a page links to."""
    links = _with_base(crawled(spark, d)).select("page_id", "base", F.explode(markup.tags(F.col("html"), "a")).alias("tag"))
    made = urls.resolved(urls.reference(markup.attribute(F.col("tag"), "href")), F.col("base"))
    return links.select("page_id", made.alias("href")).where(F.col("href").isNotNull()).distinct()


# What links to clinicians say, what the best of them say, and where such pages usually are.
CLINICIAN_LINK = "about|doctor|medical|meet|our[-_ ]?(team|staff)|people|physician|provider|staff|team|leadership|who[-_ ]?we[-_ ]?are"
BEST_LINK = "doctor|medical[-_ ]?director|physician|provider|our[-_ ]?(team|staff)|team"
USUAL_PATHS = ("/team", "/providers", "/about", "/medical-team")
CLINICIAN_PAGES = 4


def clinician_pages(pages: DataFrame, limit: int = CLINICIAN_PAGES) -> DataFrame:
    """``pages`` (url, html) with ``found``: up to ``limit`` addresses of the page's own site that tell of clinicians, best first.

    Links are judged by label and address, and by how deep they lead; where fewer than two are found, the usual paths follow. All
    of a page's links stay in its row: nothing is shuffled.
    """
    link = "(?is)<a\\b([^>]*)>(.*?)</a\\s*>"
    each = F.regexp_extract_all("html", F.lit(link), F.lit(0))
    said = F.transform(each, lambda a: F.struct(markup.attribute(F.regexp_extract(a, link, 1), "href").alias("href"), F.substring(markup.one_space(markup.visible_text(F.regexp_extract(a, link, 2))), 1, 200).alias("label")))
    read_ = F.transform(F.filter(said, lambda x: x["href"] != ""), lambda x: F.struct(urls.reference(x["href"]).alias("ref"), "base", x["label"].alias("label")))
    found = F.transform(read_, lambda x: F.struct(urls.resolved(x["ref"], x["base"]).alias("url"), x["label"].alias("label"), urls.origin(x["base"]).alias("origin")))
    own = F.filter(found, lambda x: (F.regexp_extract(x["url"], "^[a-z]+://[^/?]+", 0) == x["origin"]) & F.lower(F.concat_ws(" ", x["label"], x["url"])).rlike(CLINICIAN_LINK))
    depth = lambda u: F.size(F.split(F.regexp_extract(u, "^[a-z]+://[^/?]+([^?]*)", 1), "/"))
    score = lambda x: F.when(F.lower(F.concat_ws(" ", x["label"], x["url"])).rlike(BEST_LINK), 200).otherwise(100) - depth(x["url"])
    ranked = F.array_sort(F.transform(own, lambda x: F.struct((-score(x)).alias("score"), x["url"].alias("url"), urls.canonical(x["url"]).alias("key"))))
    new = lambda kept, x: F.when(F.exists(kept, lambda k: k["key"] == x["key"]), kept).otherwise(F.concat(kept, F.array(F.struct(x["url"].alias("url"), x["key"].alias("key")))))
    nothing = F.array().cast("array<struct<url:string,key:string>>")
    linked = F.aggregate(F.col("ranked"), nothing, new)
    usual = F.array(*[F.concat(urls.origin(F.col("base")), F.lit(p)) for p in USUAL_PATHS])
    more = F.aggregate(F.transform(usual, lambda u: F.struct(u.alias("url"), u.alias("key"))), F.col("linked"), lambda kept, x: F.when(F.size(kept) >= limit, kept).otherwise(new(kept, x)))
    done = F.when(F.size("linked") >= min(2, limit), F.col("linked")).otherwise(more)
    made = _with_base(pages).withColumn("ranked", ranked).withColumn("linked", linked)
    return made.withColumn("found", F.transform(F.slice(done, 1, limit), lambda x: x["url"])).drop("ranked", "linked", "base")


@query("x12_clinician_pages", f"""WITH {CRAWLED}, anchors AS (SELECT page_id, url, host, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>')) AS a FROM crawled),
said AS (SELECT *, {_HREF.format(tag="regexp_extract(a, '(?is)^<a([^>]*)>', 1)")} AS ref, trim(regexp_replace(replace(regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a\\s*>$', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS label FROM anchors),
wanted AS (SELECT * FROM said WHERE ref <> ''), {_RESOLVE.format(source='wanted')},
own AS (SELECT page_id, label, origin || p4 || q2 AS u, p4, q2, origin FROM resolved WHERE origin = scheme || '://' || host),
scored AS (SELECT *, CASE WHEN regexp_matches(lower(label || ' ' || u), '{BEST_LINK}') THEN 200 ELSE 100 END - len(string_split(p4, '/')) AS score, origin || CASE WHEN p4 = '/' THEN p4 ELSE regexp_replace(p4, '/+$', '') END || q2 AS key FROM own WHERE regexp_matches(lower(label || ' ' || u), '{CLINICIAN_LINK}')),
firsts AS (SELECT page_id, key, u, score FROM scored QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY score DESC, u) = 1),
linked AS (SELECT page_id, key, u, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, u) AS turn, count(*) OVER (PARTITION BY page_id) AS n FROM firsts),
usual AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || path AS u, 100 + i AS turn FROM crawled, (VALUES (1, '/team'), (2, '/providers'), (3, '/about'), (4, '/medical-team')) v(i, path)),
more AS (SELECT * FROM usual WHERE page_id NOT IN (SELECT page_id FROM linked WHERE n >= 2) AND (page_id, u) NOT IN (SELECT (page_id, key) FROM linked)),
every AS (SELECT page_id, u, turn FROM linked UNION ALL SELECT page_id, u, turn FROM more)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY turn) AS INT) AS turn, u AS url FROM every QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY turn) <= {CLINICIAN_PAGES}""")
def x12(spark: SparkSession, d: str) -> DataFrame:
    found = clinician_pages(crawled(spark, d))
    return found.select("page_id", F.posexplode("found").alias("turn", "url")).withColumn("turn", F.col("turn") + 1)


# ---- robots ----

AGENT = "Brightfield"

_ROBOTS = """paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) END AS path FROM pages),
texts AS (SELECT host, concat_ws(chr(10), '# robots of ' || host, 'Disallow: /before-any-agent', 'User-Agent: *', 'Disallow: ' || regexp_extract(min(path), '^/[^/]*/[0-9]'), 'Allow: ' || min(path), 'Disallow: /*?page=   # paging', 'disallow : /*.html$',
  'Sitemap: https://' || host || '/sitemap.xml', '', 'User-agent: OtherBot', CASE WHEN length(host) % 2 = 0 THEN 'USER-AGENT: Brightfield' ELSE 'user-agent: nobody' END, 'Crawl-delay: 5', 'Allow: ' || regexp_extract(max(path), '^/[^/]*'),
  'Disallow: ' || max(path), 'Disallow:', 'Disallow: /*/*7' || chr(13), 'User-agent: *', 'Disallow: /fr/*5*1$', 'Allow: /*utm_', CASE WHEN length(host) % 3 = 0 THEN 'User-agent: brightfield' ELSE 'no rule' END) AS body FROM paths GROUP BY host)"""


def robots_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Requests (page_id, host, path), and a robots text per host, made of its paths."""
    u = F.col("url")
    path = F.regexp_extract(u, "^[a-z]+://[^/?#]+([^#]*)", 1)
    asked = read(spark, d, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.when(path == "", "/").otherwise(path).alias("path"))
    even, third = F.length("host") % 2 == 0, F.length("host") % 3 == 0
    of = asked.groupBy("host").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    lines = [
        F.concat(F.lit("# robots of "), "host"), F.lit("Disallow: /before-any-agent"), F.lit("User-Agent: *"), F.concat(F.lit("Disallow: "), F.regexp_extract("low", "^/[^/]*/[0-9]", 0)), F.concat(F.lit("Allow: "), "low"),
        F.lit("Disallow: /*?page=   # paging"), F.lit("disallow : /*.html$"), F.concat(F.lit("Sitemap: https://"), "host", F.lit("/sitemap.xml")), F.lit(""), F.lit("User-agent: OtherBot"),
        F.when(even, "USER-AGENT: Brightfield").otherwise("user-agent: nobody"), F.lit("Crawl-delay: 5"), F.concat(F.lit("Allow: "), F.regexp_extract("high", "^/[^/]*", 0)), F.concat(F.lit("Disallow: "), "high"),
        F.lit("Disallow:"), F.lit("Disallow: /*/*7\r"), F.lit("User-agent: *"), F.lit("Disallow: /fr/*5*1$"), F.lit("Allow: /*utm_"), F.when(third, "User-agent: brightfield").otherwise("no rule"),
    ]
    return asked, of.select("host", F.concat_ws("\n", *lines).alias("body"))


@query("x13_robots", f"""WITH {_ROBOTS}, lines AS (SELECT host, i, trim(regexp_replace(regexp_replace(line, '\\r$', ''), '#.*$', '')) AS line FROM (SELECT host, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM texts)),
fields AS (SELECT host, i, lower(trim(split_part(line, ':', 1))) AS field, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM lines WHERE contains(line, ':')),
marked AS (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY host ORDER BY i), 'x') <> 'user-agent' THEN 1 ELSE 0 END AS fresh FROM fields WHERE field IN ('user-agent', 'allow', 'disallow')),
groups AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY i) AS g FROM marked),
agents AS (SELECT host, g, lower(value) AS agent FROM groups WHERE field = 'user-agent'),
named AS (SELECT DISTINCT host FROM agents WHERE agent = 'brightfield'),
rules AS (SELECT DISTINCT r.host, r.field = 'allow' AS allow, r.value AS rule FROM groups r JOIN agents a USING (host, g) WHERE r.field <> 'user-agent' AND r.value <> '' AND a.agent = CASE WHEN r.host IN (SELECT host FROM named) THEN 'brightfield' ELSE '*' END),
patterns AS (SELECT *, '^' || replace(regexp_replace(regexp_replace(rule, '[$]$', ''), '([.?+(){{}}|\\[\\]^\\\\$])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN rule LIKE '%$' THEN '$' ELSE '' END AS pattern FROM rules),
met AS (SELECT page_id, length(regexp_extract(path, pattern)) AS matched, allow FROM paths JOIN patterns USING (host) WHERE regexp_matches(path, pattern)),
won AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY matched DESC, allow DESC) = 1)
SELECT page_id, coalesce(allow, true) AS allowed, matched FROM paths LEFT JOIN won USING (page_id)""")
def x13(spark: SparkSession, d: str) -> DataFrame:
    """Which pages an agent may fetch by their host's robots text, and how much of the path the winning rule matched."""
    asked, texts = robots_texts(spark, d)
    return decided(asked, robot_rules(texts), AGENT).select("page_id", "allowed", F.col("matched").cast("bigint").alias("matched"))


# ---- JSON in pages ----

_TYPED = "(?is)<script\\b[^>]*?\\btype\\s*=\\s*[\"']?application/(?:ld\\+)?json[\"']?[^>]*>(.*?)</script\\s*>"
_ANY = "(?is)<script\\b[^>]*?(?:\\btype\\s*=\\s*[\"']?application/(?:ld\\+)?json|\\bid\\s*=\\s*[\"']?__NEXT_DATA__)[\"']?[^>]*>(.*?)</script\\s*>"


def json_scripts(html: Column, pattern: str = _ANY) -> Column:
    """The JSON texts in a page's scripts, decoded and without comment signs around them."""
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "^\\s*<!--|-->\\s*$", "")), ";\\s*$", "")
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: bare(markup.decoded(x)))


def coordinates_in(objects: Column) -> Column:
    """The distinct usable coordinates that objects carry."""
    number = lambda o, *names: F.coalesce(*[F.element_at(o, n) for n in names]).try_cast("double")
    each = F.transform(objects, lambda o: F.struct(number(o, "latitude", "lat").alias("latitude"), number(o, "longitude", "lng", "lon").alias("longitude")))
    return F.array_distinct(F.filter(each, lambda c: geo.usable(c["latitude"], c["longitude"])))


@query("x4_json_ld_coordinates", f"""WITH {CRAWLED}, s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\\b[^>]*(?:type="application/ld[+]json"|id="__NEXT_DATA__")[^>]*>(.*?)</script>', 1)) AS s FROM crawled),
o AS (SELECT page_id, t.value AS o FROM (SELECT * FROM s WHERE json_valid(s)), json_tree(s) t WHERE t.type = 'OBJECT'),
c AS (SELECT DISTINCT page_id, TRY_CAST(coalesce(o->>'latitude', o->>'lat') AS DOUBLE) AS latitude, TRY_CAST(coalesce(o->>'longitude', o->>'lng', o->>'lon') AS DOUBLE) AS longitude FROM o)
SELECT * FROM c WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)""")
def x4(spark: SparkSession, d: str) -> DataFrame:
    found = crawled(spark, d).select("page_id", jsonld.objects(json_scripts(F.col("html"))).alias("objects"))
    return found.select("page_id", F.inline(coordinates_in(F.col("objects"))))


# ---- images ----

# Signs of images that are no pictures, of logos, of large pictures, and kinds of structured data that show a place.
JUNK_URL = "^data:|\\.(ico|gif)($|[?#])|favicon|sprite|tracking|pixel|placeholder|blank|transparent|loader|spinner|icon|badge|googleadservices|doubleclick|pagead|analytics|/maps/|maps\\.gstatic|maps\\.google|googleapis\\.com/maps|khms|/vt/lyrs="
JUNK_ALT = "\\b(icon|favicon|placeholder|sprite|tracking pixel)\\b"
LOGO = "(^|[^a-z0-9])(logo|brandmark|wordmark)([^a-z0-9]|$)"
HERO = "\\b(hero|masthead|banner|cover)\\b"
PLACE_TYPES = "organization|localbusiness|medicalclinic|medicalbusiness|healthandbeautybusiness"
IMAGES = 8
_PROPOSAL = "array<struct<raw:string,source:string,alt:string,logo:boolean,score:double>>"


def _proposal(raw: Column, source: Column | str, alt: Column, logo: Column, score: Column) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(raw.alias("raw"), source.alias("source"), alt.alias("alt"), logo.alias("logo"), score.cast("double").alias("score"))


def _says_logo(*values: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(v, F.lit("")) for v in values])).rlike(LOGO)


def _or(*values: Column) -> Column:
    """The first value that is not empty, else an empty one."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _meta_proposals(html: Column, title: Column) -> Column:
    tags = F.transform(markup.tags(html, "meta"), lambda t: F.struct(F.lower(markup.one_space(_or(markup.attribute(t, "property"), markup.attribute(t, "name")))).alias("key"), F.trim(markup.attribute(t, "content")).alias("value")))

    def of(known: Column) -> Column:
        value = lambda key: _or(F.get(F.filter(known, lambda x: (x["key"] == key) & (x["value"] != "")), F.lit(0))["value"])
        alt = _or(value("og:image:alt"), value("twitter:image:alt"), title)
        rows = []
        for index, key in enumerate(("og:image:secure_url", "og:image", "twitter:image")):
            logo = _says_logo(value(key), alt)
            rows.append(_proposal(value(key), "og_image" if key.startswith("og:") else "twitter_image", alt, logo, F.when(logo, 400 - index).otherwise(1000 - index)))
        return F.array(*rows)

    return let(tags, of)


def _data_proposals(objects: Column, title: Column) -> Column:
    places = F.filter(objects, lambda o: F.element_at(o, "#top").isNotNull() & F.lower(F.element_at(o, "#type")).rlike(PLACE_TYPES))

    def of(o: Column) -> Column:
        image, logo = F.element_at(o, "#image"), F.element_at(o, "#logo")
        alt = _or(markup.one_space(F.coalesce(F.element_at(o, "name"), F.lit(""))), title)
        says = F.coalesce(_says_logo(image, alt), F.lit(False))
        return F.array(_proposal(image, "jsonld_image", alt, says, F.when(says, 390).otherwise(900)), _proposal(F.when(~logo.eqNullSafe(image), logo), "jsonld_logo", alt, F.lit(True), F.lit(390)))

    return F.flatten(F.transform(places, of))


def _tag_proposals(html: Column, title: Column) -> Column:
    names = ("data-lazy-srcset", "bv-data-srcset", "data-srcset", "srcset", "data-lazy-src", "bv-data-src", "data-src", "src", "alt", "class", "id", "width", "data-ux", "data-aid", "data-testid", "aria-label")
    field = lambda n: n.replace("-", "_")
    read_ = F.transform(markup.tags(html, "img"), lambda t: F.struct(*[markup.attribute(t, n).alias(field(n)) for n in names]))

    def sized(a: Column) -> Column:
        """The tag with the entries of its srcset: address and width, the widest first, ties as they come."""
        entries = F.transform(F.split(_or(*[a[field(n)] for n in names[:4]]), ","), lambda p: F.split(F.trim(p), "\\s+"))
        width = lambda p: F.when(F.get(p, F.lit(1)).endswith("w"), F.coalesce(F.regexp_extract(F.get(p, F.lit(1)), "^[0-9]+", 0).try_cast("int"), F.lit(0))).otherwise(0)
        known = F.transform(entries, lambda p, i: F.struct((-width(p)).alias("width"), i.alias("turn"), F.get(p, F.lit(0)).alias("url")))
        return F.struct(a.alias("a"), F.array_sort(F.filter(known, lambda e: (e["url"] != "") & ~F.lower(e["url"]).startswith("data:"))).alias("set"))

    def of(x: Column) -> Column:
        a, best = x["a"], F.get(x["set"], F.lit(0))
        raw = _or(best["url"], *[a[field(n)] for n in names[4:8]])
        alt = _or(a["alt"], title)
        declared = F.coalesce(F.regexp_extract(a["width"], "^\\s*([0-9]+)", 1).try_cast("int"), F.lit(0))
        wide = F.when(declared > 0, declared).otherwise(F.coalesce(-best["width"], F.lit(0)))
        logo = _says_logo(raw, alt, a["class"], a["id"], a["data_ux"], a["data_aid"], a["data_testid"], a["aria_label"])
        return F.struct(raw.alias("raw"), alt.alias("alt"), wide.alias("wide"), logo.alias("logo"), F.lower(F.concat_ws(" ", a["class"], a["id"])).rlike(HERO).alias("hero"))

    def scored(y: Column) -> Column:
        score = F.when(y["logo"], 350 + F.least(y["wide"], F.lit(2000)) / 20).otherwise(F.when(y["hero"], 800).otherwise(500) + F.least(y["wide"], F.lit(2000)) / 10)
        return _proposal(y["raw"], F.when(y["hero"], "hero_img").otherwise("img"), y["alt"], y["logo"], score)

    large = F.filter(F.transform(F.transform(read_, sized), of), lambda y: y["logo"] | (y["wide"] == 0) | (y["wide"] >= 300))
    return F.transform(large, scored)


def _background_proposals(html: Column, title: Column) -> Column:
    marked = F.regexp_extract_all(html, F.lit("(?is)<[^>]+(?:class|id)\\s*=\\s*(?:\"[^\"]*(?:hero|masthead|banner|cover)[^\"]*\"|'[^']*(?:hero|masthead|banner|cover)[^']*')[^>]*>"), F.lit(0))
    address = lambda t: F.nullif(F.regexp_extract(markup.attribute(t, "style"), "(?i)background(?:-image)?\\s*:[^;]*url\\(\\s*[\"']?([^)'\"\\s]+)[\"']?\\s*\\)", 1), F.lit(""))
    return F.transform(marked, lambda t: _proposal(address(t), "hero_background", title, F.lit(False), F.lit(750)))


def _merged(proposals: Column) -> Column:
    """One of several proposals of an address, in the order they were made: the best scored, a logo if one says so, at 400 then."""

    def step(kept: Column, new: Column) -> Column:
        logo, best = kept["logo"] | new["logo"], F.when(kept["score"] >= new["score"], kept).otherwise(new)
        score = F.when(logo, F.least(best["score"], F.lit(400.0))).otherwise(best["score"])
        return F.struct(best["turn"].alias("turn"), best["source"].alias("source"), best["alt"].alias("alt"), logo.alias("logo"), score.alias("score"))

    return F.aggregate(F.slice(proposals, F.lit(2), F.size(proposals)), F.get(proposals, F.lit(0)), step)


def image_candidates(pages: DataFrame, limit: int = IMAGES) -> DataFrame:
    """(page_id, turn, url, source, alt, image_kind): the pictures that a page offers, best first, at most one logo, which comes last.

    Proposals come from meta tags, structured data, image tags with their sets of sizes, and backgrounds; each address counts once.
    Pages are dealt out once, and both groupings keep to that.
    """
    title = F.substring(markup.one_space(markup.decoded(F.regexp_extract("html", "(?is)<title\\b[^>]*>(.*?)</title\\s*>", 1))), 1, 300)
    made = pages.select("page_id", urls.parts(F.col("url")).alias("base"), "html", title.alias("title"), jsonld.objects(json_scripts(F.col("html"), _TYPED.replace("(?:ld\\+)?", "ld\\+"))).alias("objects"))
    html, title = F.col("html"), F.col("title")
    every = F.concat(_meta_proposals(html, title), _data_proposals(F.col("objects"), title), _tag_proposals(html, title), _background_proposals(html, title))
    rows = made.select("page_id", "base", F.posexplode(every.cast(_PROPOSAL)).alias("turn", "x")).where("x.raw <> ''")
    rows = rows.select("page_id", "turn", urls.resolved(urls.reference(F.col("x.raw")), F.col("base")).alias("url"), "x.source", F.substring(markup.one_space(F.col("x.alt")), 1, 300).alias("alt"), "x.logo", "x.score")
    real = rows.where(F.col("url").isNotNull() & ~F.lower("url").rlike(JUNK_URL) & ~F.lower("alt").rlike(JUNK_ALT)).withColumn("logo", F.col("logo") | _says_logo(F.col("url"), F.col("alt")))
    real = real.where(F.col("logo") | ~F.lower("url").rlike("\\.svg($|[?#])")).repartition("page_id")
    best = real.groupBy("page_id", "url").agg(_merged(F.sort_array(F.collect_list(F.struct("turn", "source", "alt", "logo", "score")))).alias("x"))
    per = best.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("x.score")).alias("score"), "url", "x.source", "x.alt", "x.logo"))).alias("all"))
    plain, logos = F.filter("all", lambda x: ~x["logo"]), F.filter("all", lambda x: x["logo"])
    both = F.concat(F.slice(plain, 1, max(limit - 1, 1)), F.slice(logos, 1, 1))
    chosen = F.when((F.size(logos) > 0) & F.lit(limit > 1), both).when(F.size(plain) > 0, F.slice(plain, 1, limit)).otherwise(F.slice(logos, 1, limit))
    out = per.select("page_id", F.posexplode(chosen).alias("turn", "x"))
    return out.select("page_id", (F.col("turn") + 1).alias("turn"), "x.url", "x.source", F.nullif("x.alt", F.lit("")).alias("alt"), F.when(F.col("x.logo"), "logo").alias("image_kind"))


@query("x1_images")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return image_candidates(crawled(spark, d))


# ---- address evidence ----

# How streets end, what follows a unit's number, words that no street has, fields of structured addresses by meaning.
STREET_ENDS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Highway|Hwy|Parkway|Pkwy|Court|Ct|Place|Pl|Terrace|Ter|Trail|Trl|Circle|Cir|Plaza|Square|Courtyard"
UNITS = "Suite|Ste|Unit|Floor|Fl|Room|Rm|#"
NO_STREET = "\\b(clinic|doctor|hours?|medical|price|scan|therapy|years?)\\b"
STREET = f"(?i)\\b\\d{{1,6}}[A-Za-z]?(?:[-–]\\d{{1,6}})?\\s+(?:[A-Za-zÀ-ÿ0-9.'’#&/-]+\\s+){{0,9}}(?:{STREET_ENDS})\\b(?:[.,]?\\s*(?:{UNITS})\\s*[A-Za-z0-9-]+)?"
FIELDS = {"street": ("streetaddress", "formattedaddress", "fulladdress", "address1", "street", "address"), "locality": ("addresslocality", "city", "locality"), "region": ("addressregion", "region", "state"), "postal": ("postalcode", "postcode", "zipcode", "zip")}
WHOLE_STREETS = ("streetaddress", "formattedaddress", "fulladdress", "address1")
POSTAL_COUNTRIES = ("US", "CA")
BEFORE, AFTER, ADDRESSES = 40, 180, 24
_ADDRESS = "struct<source:string,street:string,locality:string,region:string,postal:string>"


def identity(c: Column) -> Column:
    """Folded letters and digits with single spaces."""
    return F.trim(F.regexp_replace(text.fold(c), "[^\\p{L}\\p{N}]+", " "))


def _names(haystack: Column, needle: Column) -> Column:
    """Whether a text names a place, or is a part of its name."""
    both = F.struct(identity(haystack).alias("h"), identity(needle).alias("n"))
    return let(both, lambda x: F.coalesce((x["n"] != "") & (x["h"].contains(x["n"]) | x["n"].contains(x["h"])), F.lit(False)))


def with_context(c: Column, pattern: str, before: int, after: int) -> Column:
    """Array of struct(match, context): every match with as many characters around it."""

    def of(t: Column) -> Column:
        matches, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<match:string,context:string>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            here = s["at"] + F.length(x["between"])
            left = F.greatest(here - before, F.lit(1))
            context = F.substring(t, left, here - left + F.length(x["match"]) + after)
            return F.struct((here + F.length(x["match"])).alias("at"), F.concat(s["out"], F.array(F.struct(x["match"].alias("match"), context.alias("context")))).alias("out"))

        paired = F.transform(matches, lambda m, i: F.struct(m.alias("match"), F.get(between, i).alias("between")))
        return F.aggregate(paired, start, step, lambda s: s["out"])

    return let(c, of)


def _address(source: str, street: Column, locality: Column, region: Column, postal: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), street.alias("street"), locality.alias("locality"), region.alias("region"), postal.alias("postal"))


def _last_postal(context: Column, numbers: Column) -> Column:
    five = F.filter(F.regexp_extract_all(context, F.lit("\\b\\d{5}(?:-\\d{4})?\\b"), F.lit(0)), lambda p: ~F.array_contains(numbers, p))
    other = F.nullif(F.upper(F.regexp_extract(context, "(?i)\\b[A-Z]\\d[A-Z]\\s?\\d[A-Z]\\d\\b", 0)), F.lit(""))
    return let(five, lambda x: F.when(F.size(x) > 0, F.element_at(x, -1)).otherwise(other))


def written_addresses(c: Column, source: str, locality: Column, region: Column, country: Column) -> Column:
    """Street addresses written in a text near the locality's name: one number that is not 0, no telling word, and with a postal code
    where the country needs one or the region is not named."""

    def read_(m: Column) -> Column:
        street = F.trim(F.regexp_replace(m["match"], "\\s+", " "))
        return let(street, lambda s: F.struct(s.alias("street"), F.regexp_extract_all(s, F.lit("\\b\\d+\\b"), F.lit(0)).alias("numbers"), m["context"].alias("context")))

    with_postal = lambda x: F.struct(x["street"].alias("street"), x["numbers"].alias("numbers"), x["context"].alias("context"), _last_postal(x["context"], x["numbers"]).alias("postal"))
    telling = lambda x: (F.size(x["numbers"]) <= 1) & (F.coalesce(F.get(x["numbers"], F.lit(0)), F.lit("")) != "0") & ~F.lower(x["street"]).rlike(NO_STREET)
    placed = lambda x: x["postal"].isNotNull() | (~F.coalesce(country, F.lit("")).isin(*POSTAL_COUNTRIES) & (region.isNull() | _names(x["context"], region)))
    found = F.filter(F.transform(with_context(c, STREET, BEFORE, AFTER), read_), lambda x: telling(x) & _names(x["context"], locality))
    found = F.filter(F.transform(found, with_postal), placed)
    return F.transform(found, lambda x: _address(source, x["street"], locality, region, x["postal"]))


def direction_texts(html: Column, base: Column) -> Column:
    """What the page's links to maps and directions ask for, decoded."""
    linked = F.regexp_extract_all(html, F.lit("(?is)\\b(?:href|src|data-src)\\s*=\\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    found = F.transform(linked, lambda q: urls.resolved(urls.reference(markup.decoded(F.regexp_replace(q, "^[\"']|[\"']$", ""))), base))
    maps = F.filter(F.array_distinct(F.array_compact(found)), lambda u: F.lower(F.regexp_replace(u, "^[a-z]+://", "")).rlike("maps|direction|daddr=|destination=|query="))
    asked = F.flatten(F.transform(maps, lambda u: F.array(*[F.regexp_extract(u, f"[?&]{k}=([^&]*)", 1) for k in ("q", "query", "destination", "daddr", "address")])))
    return F.filter(F.transform(asked, lambda v: F.trim(F.regexp_replace(F.try_url_decode(v), "[+\\s]+", " "))), lambda v: v.rlike("[0-9]"))


def structured_addresses(objects: Column) -> Column:
    """Objects that look like addresses: by type, by a whole street, or by locality and postal code together."""
    low = lambda o: F.map_from_entries(F.array_distinct(F.transform(F.filter(F.map_entries(o), lambda e: ~e["key"].startswith("#") & (F.trim(e["value"]) != "")), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").alias("key"), markup.one_space(e["value"]).alias("value")))))
    one = lambda m, names: F.coalesce(*[F.element_at(m, n) for n in names])
    unique = F.filter(objects, lambda o: F.size(F.array_distinct(F.transform(F.map_keys(o), lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9#]", "")))) == F.size(o))
    known = F.transform(unique, lambda o: F.struct(low(o).alias("m"), F.lower(F.element_at(o, "#type")).contains("postaladdress").alias("typed")))
    like = F.filter(known, lambda x: x["typed"] | one(x["m"], WHOLE_STREETS).isNotNull() | (one(x["m"], FIELDS["locality"]).isNotNull() & one(x["m"], FIELDS["postal"]).isNotNull()))
    return F.transform(like, lambda x: _address("structured", *[one(x["m"], FIELDS[f]) for f in ("street", "locality", "region", "postal")]))


def item_addresses(html: Column) -> Column:
    """Single fields marked as item properties."""
    pattern = "(?is)<(?:meta|span|div|p)\\b[^>]*\\bitemprop\\s*=\\s*[\"']?(streetAddress|addressLocality|addressRegion|postalCode)[\"']?[^>]*>"
    tags = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda t: F.struct(F.lower(F.regexp_extract(t, pattern, 1)).alias("key"), markup.one_space(markup.attribute(t, "content")).alias("value")))
    only = lambda x, key: F.when(x["key"] == key, x["value"])
    return F.transform(F.filter(tags, lambda x: x["value"] != ""), lambda x: _address("structured", only(x, "streetaddress"), only(x, "addresslocality"), only(x, "addressregion"), only(x, "postalcode")))


def literal_address(seen: Column, raw: Column, address: Column, locality: Column, region: Column, postal: Column, country: Column) -> Column:
    """The candidate's own address, if the page writes it out with its locality, and with the postal code where the country needs one.

    ``seen`` and ``raw`` are identities of the visible text and of the whole markup.
    """
    bare = F.replace(identity(address), identity(F.coalesce(postal, F.lit("-"))), F.lit(" "))
    bare = F.when(country.isin(*POSTAL_COUNTRIES), F.regexp_replace(bare, "\\b[0-9]{5}( [0-9]{4})?\\b", " ")).otherwise(bare)
    there = lambda c: seen.contains(identity(c)) | raw.contains(identity(c))
    wants_postal = country.isin(*POSTAL_COUNTRIES) & (identity(F.coalesce(postal, F.lit(""))) != "")
    fine = bare.rlike("[0-9]") & there(address) & there(locality) & (~F.coalesce(wants_postal, F.lit(False)) | there(postal))
    return F.when(fine, F.array(_address("literal", address, locality, region, postal))).otherwise(F.array().cast(f"array<{_ADDRESS}>"))


def address_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, and a candidate's address, locality, region, postal_code, country_code) to a row for every
    distinct address that a page gives: page_id, turn, source, street, locality, region, postal. A page's evidence is found in its row."""
    html, of = F.col("html"), [F.col(c) for c in ("locality", "region", "country_code")]
    page_text = markup.one_space(markup.visible_text(html))
    standalone = F.when(F.trim(html).rlike("(?s)^[\\[{].*[\\]}]$"), F.array(F.trim(html))).otherwise(F.array().cast("array<string>"))
    made = pages.withColumn("base", urls.parts(F.col("url"))).withColumn("seen", page_text).withColumn("objects", jsonld.objects(F.concat(json_scripts(html), standalone)))
    made = made.withColumn("asked", direction_texts(html, F.col("base"))).withColumn("seen_key", identity(F.col("seen"))).withColumn("raw_key", identity(markup.decoded(html)))
    asked = F.flatten(F.transform("asked", lambda v: written_addresses(v, "directions", *of)))
    literal = literal_address(F.col("seen_key"), F.col("raw_key"), F.col("address"), of[0], of[1], F.col("postal_code"), of[2])
    every = F.concat(*[x.cast(f"array<{_ADDRESS}>") for x in (structured_addresses(F.col("objects")), item_addresses(html), written_addresses(F.col("seen"), "visible", *of), asked, literal)])
    return made.select("page_id", F.posexplode(F.slice(F.array_distinct(every), 1, ADDRESSES)).alias("turn", "x")).select("page_id", (F.col("turn") + 1).alias("turn"), "x.*")


def candidates(pages: DataFrame) -> DataFrame:
    """Crawled pages with the address that is looked for: the one that some fragments hold."""
    page = F.col("page_id")
    address = F.concat((page % 89 + 1).cast("string"), F.lit(" "), "place", F.lit(" Street"))
    country = F.when(page % 3 == 0, "US").when(page % 3 == 1, "CA").otherwise("FR")
    return pages.select("page_id", "url", "html", address.alias("address"), F.col("place").alias("locality"), F.when(page % 2 == 1, "IL").alias("region"), (10000 + page).cast("string").alias("postal_code"), country.alias("country_code"))


@query("x15_address_evidence")
def x15(spark: SparkSession, d: str) -> DataFrame:
    return address_evidence(candidates(crawled(spark, d)))
