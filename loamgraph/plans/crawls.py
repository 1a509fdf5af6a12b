"""Crawl queries (c)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import html, urls
from loamgraph.operators import crawl as cr
from loamgraph.operators import tagsearch
from loamgraph.plans.views import rendezvous_sql, using
from loamgraph.session import Scratch
from loamgraph.sources import domain
from loamgraph.sources.tables import table

Q: dict = {}
SQL: dict = {}


def _q(sql: str | None = None, views: str = "", recursive: bool = False):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = using(views, sql, recursive) if views else sql
        return f

    return add


_SLASH = "CASE WHEN path = '' THEN '/' ELSE path END"


@_q(f"SELECT DISTINCT doc_id, pos, 'http://' || host || {_SLASH} || CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN '?a=' || pos || '&b=2' ELSE '?q=~' END AS url FROM mentions", "mentions")
def c01_canonical(s, d):
    """Untidy spellings of the addresses that texts name, each made canonical."""
    m = domain.mentions(s, d)
    tidy = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    raw = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("HTTP://"), F.upper("host"), F.lit(":80/x/.."), tidy, F.lit("#top"))).when(
        F.col("pos") % 3 == 1, F.concat(F.lit(" http://"), F.col("host"), F.lit("."), tidy, F.lit("?b=2&utm_source=feed&a="), F.col("pos"), F.lit("&SID=1"))
    )
    raw = raw.otherwise(F.concat(F.lit("http://"), F.col("host"), F.lit("/./"), F.regexp_replace(tidy, "^/", ""), F.lit("?q=%7e")))
    return m.select("doc_id", "pos", urls.canonicals(raw).alias("url")).distinct()


@_q("SELECT event_id, 'b=' || event_id % 7 || '&c=1' AS query FROM events")
def c02_tracking_params(s, d):
    e = table(s, d, "events")
    raw = F.concat(F.lit("utm_source=x&c=1&GCLID=9&b="), F.col("event_id") % 7, F.lit("&&sid="), F.col("user_id"))
    return e.select("event_id", urls.clean_query_sql(raw).alias("query"))


@_q("SELECT 'h' || user_id % 40 AS host, event_type AS param FROM events GROUP BY ALL HAVING count(DISTINCT event_id % 9) FILTER (value < 320) >= 3 AND NOT bool_or(value >= 320)")
def c03_learned_params(s, d):
    e = table(s, d, "events")
    return cr.learned_params(e.select(F.concat(F.lit("h"), F.col("user_id") % 40).alias("host"), F.upper("event_type").alias("param"), (F.col("event_id") % 9).alias("value"), (F.col("value") < 320).alias("same")))


@_q("SELECT host, 'ref' AS param, CAST(page_id % 50 AS VARCHAR) AS value, page_id % 3 <> 0 AS same FROM pages", "pages")
def c03_votes(s, d):
    p = domain.pages(s, d)
    other = F.when(F.col("page_id") % 3 == 0, F.lit("other")).otherwise(F.col("hash"))
    with_param = p.select(F.concat("url", F.lit("?ref="), F.col("page_id") % 50).alias("url"), "host", other.alias("hash"))
    return cr.param_votes(p.select("url", "host", "hash").unionByName(with_param), ["ref"])


@_q("SELECT event_id, 'http://x.example/p' || CASE WHEN user_id % 2 = 0 THEN '?b=' || user_id ELSE '' END AS url FROM events")
def c04_without_param(s, d):
    e = table(s, d, "events")
    full = F.concat(F.lit("http://x.example/p?A="), F.col("event_id"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("&b="), F.col("user_id"))).otherwise(""))
    return e.select("event_id", urls.without_param_sql(full, "a").alias("url"))


@_q("SELECT page_id, substring(sha256(url), 1, 32) AS url_hash, hash FROM pages", "pages")
def c05_hashes(s, d):
    return domain.pages(s, d).select("page_id", urls.url_hash(F.col("url")).alias("url_hash"), "hash")


@_q("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'path too deep' WHEN event_id % 4 = 1 THEN 'repeating path segment ''' || (CASE WHEN event_id % 8 = 1 THEN 'a' ELSE 'b' || user_id % 9 END) || '''' WHEN event_id % 4 = 2 THEN 'too many query parameters' END AS trap FROM events")
def c06_traps(s, d):
    e = table(s, d, "events")
    kind = F.col("event_id") % 4
    deep = F.concat(F.lit("http://x.example/"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("s"), i)), "/"))
    wide = F.concat(F.lit("http://x.example/a?"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.concat(F.lit("p"), i, F.lit("=1"))), "&"))
    again = F.concat(F.lit("/b"), F.col("user_id") % 9, F.lit("/a"))
    twice = F.when(F.col("event_id") % 8 == 1, "/a/b/a/b/a/b/a/b/").otherwise(F.concat(F.repeat(again, F.lit(3)), F.lit("/b"), F.col("user_id") % 9))
    url = F.when(kind == 0, deep).when(kind == 1, F.concat(F.lit("http://x.example"), twice)).when(kind == 2, wide).otherwise(F.concat(F.lit("http://x.example/a/b/"), F.col("event_id")))
    return e.select("event_id", urls.trap_sql(url).alias("trap"))


@_q("SELECT user_id, count(*) FILTER (r > 50) AS over FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id")
def c06_variant_cap(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.concat(F.lit("http://x.example/"), "user_id", F.lit("?v="), "event_id").alias("url"))
    capped = cr.cap_variants(e, urls.variant_key_sql(F.col("url")), "event_id")
    return capped.groupBy("user_id").agg(F.count_if(F.col("over")).alias("over"))


@_q(
    "SELECT DISTINCT host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain, regexp_extract(host, '([^.]+)$', 1) || '.co.uk' AS wide, regexp_extract(host, '([^.]+)$', 1) || '.com.de' AS third, 'org.uk.example' AS short FROM mentions",
    "mentions",
)
def c07_domains(s, d):
    h = domain.mentions(s, d).select("host").distinct()
    of = lambda suffix: urls.registrable_domain_sql(F.concat("host", F.lit(suffix)))
    return h.select("host", of("").alias("domain"), of(".co.uk").alias("wide"), of(".com.de").alias("third"), F.concat(urls.registrable_domain_sql(F.lit("org.uk")), F.lit(".example")).alias("short"))


@_q("SELECT event_id, (['PAGE','IMAGE','VIDEO','AUDIO','CSS','SCRIPT','FONT','DOCUMENT','OTHER'])[event_id % 9 + 1] AS by_path, (['PAGE','IMAGE','VIDEO','AUDIO','CSS','SCRIPT','FONT','DOCUMENT','OTHER'])[event_id % 9 + 1] AS by_media FROM events")
def c08_resource_types(s, d):
    names = F.array(*[F.lit(x) for x in ("/a.b/index", "/x.PNG", "/v.m3u8", "/s.ogg", "/c.css", "/j.mjs", "/f.woff2", "/d.docx", "/z.zip")])
    media = F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "image/png", "application/vnd.apple.mpegurl", "audio/ogg", "text/css", "application/javascript", "application/font-woff", "application/msword", "application/zip")])
    at = (F.col("event_id") % 9 + 1).cast("int")
    return table(s, d, "events").select("event_id", urls.type_by_path_sql(F.element_at(names, at)).alias("by_path"), urls.type_by_media_sql(F.element_at(media, at)).alias("by_media"))


@_q(
    "WITH k AS (SELECT DISTINCT hash, hash IN (SELECT hash FROM pages WHERE page_id % 2 = 0) AS held FROM pages), a AS (SELECT count(*) AS absent FROM (SELECT DISTINCT reverse(hash) AS r FROM pages) WHERE r NOT IN (SELECT hash FROM pages)) SELECT count(*) FILTER (held) AS found, 0 AS missed, (SELECT absent FROM a) AS absent, true AS few_wrong FROM k",
    "pages",
)
def c09_bloom(s, d):
    """A filter of the even pages' hashes: those it must know, those it fails to know, and whether it takes few of the absent ones for known.

    Absent are the reversed hashes; at a rate of 1 % at most 2 % and ten of them may be taken for known.
    """
    scratch = Scratch(s, "bloom")
    p = domain.pages(s, d).select("page_id", "hash")
    stored = scratch.keep(urls.bloom_filter(p.where("page_id % 2 = 0").select(F.col("hash").alias("key")), 0.01, 2_000))
    held = p.where("page_id % 2 = 0").select("hash").distinct()
    away = p.select(F.reverse("hash").alias("hash")).distinct().join(p.select("hash").distinct(), "hash", "left_anti")
    asked = held.withColumn("held", F.lit(True)).unionByName(away.withColumn("held", F.lit(False)))
    told = urls.bloom_known(asked.select(F.col("hash").alias("key")), stored, 0.01)
    both = asked.join(told, F.col("hash") == F.col("key"))
    wrong = F.count_if(~F.col("held") & F.col("known"))
    absent = F.count_if(~F.col("held"))
    return both.agg(F.count_if(F.col("held") & F.col("known")).alias("found"), F.count_if(F.col("held") & ~F.col("known")).alias("missed"), absent.alias("absent"), (wrong <= absent * 0.02 + 10).alias("few_wrong"))


_ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: loam\nDisallow: /wiki_export/\nAllow: /wiki_export/*5$\nDisallow: /chat*\nCrawl-delay: 2.5\n"


@_q("SELECT page_id, NOT (dir LIKE '%/wiki\\_export/' ESCAPE '\\' AND page_id % 10 <> 5 OR dir LIKE '%/chat%') AS allowed FROM pages", "pages")
def c10_robots(s, d):
    rules = urls.Robots(_ROBOTS, "loam/1.0")

    @F.pandas_udf("boolean")
    def allowed(p: pd.Series) -> pd.Series:
        return p.map(rules.allows)

    return domain.pages(s, d).select("page_id", allowed(F.regexp_extract("url", r"^[a-z]+://[^/]*(.*)$", 1)).alias("allowed"))


@_q("SELECT doc_id, path, status, CASE WHEN status BETWEEN 200 AND 299 THEN 'RULES' WHEN status BETWEEN 400 AND 499 THEN 'ALLOW_ALL' ELSE 'DISALLOW_ALL' END AS policy FROM fetches", "fetches")
def c11_robots_policy(s, d):
    return domain.fetches(s, d).select("doc_id", "path", "status", urls.robots_policy_sql(F.col("status")).alias("policy"))


@_q(
    r"""WITH ips AS (SELECT unnest(regexp_extract_all(text, '(?:192\.0\.2|198\.51\.100|203\.0\.113)\.\d+')) AS ip FROM documents WHERE text IS NOT NULL),
n AS (SELECT DISTINCT CAST(split_part(ip, '.', 3) AS INTEGER) AS c, CAST(split_part(ip, '.', 4) AS INTEGER) AS e FROM ips),
heads AS (SELECT a, b FROM range(0, 256) t(a), (VALUES (0), (15), (16), (18), (31), (32), (63), (64), (100), (127), (128), (168), (254)) u(b)),
moved AS (SELECT DISTINCT (c * 7 + e) % 256 AS a, b, c, e FROM n JOIN heads ON a = (c * 7 + e) % 256)
SELECT form, CASE form WHEN 'v4' THEN a || '.' || b || '.' || c || '.' || e WHEN 'mapped' THEN '::ffff:' || a || '.' || b || '.' || c || '.' || e ELSE '64:ff9b::' || a || '.' || b || '.' || c || '.' || e END AS ip,
NOT (a IN (0, 10, 127) OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND (b = 168 OR b = 0 AND c = 0) OR a = 198 AND b IN (18, 19) OR a >= 224) AS public
FROM moved, (VALUES ('v4'), ('mapped'), ('nat64')) f(form) WHERE true"""
)
def c12_egress(s, d):
    """Addresses that texts name, moved into every first block and the edges of the second, as IPv4, mapped IPv6 and NAT64."""
    docs = table(s, d, "documents").where("text is not null")
    ips = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:192\.0\.2|198\.51\.100|203\.0\.113)\.\d+"), F.lit(0))).alias("ip"))
    at = lambda i: F.split_part("ip", F.lit("."), F.lit(i)).cast("int")
    n = ips.select(at(3).alias("c"), at(4).alias("e")).distinct()
    seconds = F.array(*[F.lit(x) for x in (0, 15, 16, 18, 31, 32, 63, 64, 100, 127, 128, 168, 254)])
    moved = n.select(((F.col("c") * 7 + F.col("e")) % 256).alias("a"), F.explode(seconds).alias("b"), "c", "e").distinct()
    v4 = F.concat_ws(".", "a", "b", "c", "e")
    forms = moved.select(F.explode(F.create_map(F.lit("v4"), v4, F.lit("mapped"), F.concat(F.lit("::ffff:"), v4), F.lit("nat64"), F.concat(F.lit("64:ff9b::"), v4))).alias("form", "ip"))
    return forms.select("form", "ip", urls.public_addresses(F.col("ip")).alias("public"))


def _html(s, d) -> DataFrame:
    """Pages with a link for each of their first links, as markup."""
    to = domain.links(s, d).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit('<a href="../p/'), x["dst"], F.lit('.html#s">x</a>'))), "\n")
    p = domain.pages(s, d).join(to, F.col("page_id") == F.col("src"))
    return p.select("page_id", "url", F.concat(F.lit('<html><head><title>t</title><link rel="canonical" href="/c"><style>@import "base.css"; p{background:url(\'bg'), F.col("page_id") % 3, F.lit('.png\')} i{src:url(data:x)} b{src: URL( f.woff )}</style></head><body>'), body, F.lit('<img src="i.png" srcset="a'), F.col("page_id") % 5, F.lit('.png 1x, , b.png"></body></html>')).alias("html"))


@_q("SELECT src AS page_id, count(*) + 6 AS links, count(*) AS pages FROM links GROUP BY src", "mentions links")
def c13_html_links(s, d):
    @F.pandas_udf("array<struct<ref:string,kind:string>>")
    def links_of(h: pd.Series) -> pd.Series:
        return h.map(lambda t: [{"ref": a, "kind": b} for a, b in html.parse_page(t)["links"]])

    found = _html(s, d).select("page_id", links_of("html").alias("l"))
    return found.select("page_id", F.size("l").cast("long").alias("links"), F.size(F.filter("l", lambda x: x["kind"] == "PAGE")).cast("long").alias("pages"))


@_q("SELECT src AS page_id, '../p/' || dst || '.html#s' AS ref FROM links", "mentions links")
def c13_hrefs_sql(s, d):
    refs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return _html(s, d).select("page_id", F.explode(refs).alias("ref"))


@_q("SELECT src AS page_id, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS pos, unnest(r) AS ref FROM (SELECT DISTINCT src, ['bg' || src % 3 || '.png', 'f.woff', 'base.css'] AS r FROM links)", "mentions links")
def c14_css_urls(s, d):
    """References of ``url()`` and then of ``@import`` in the pages' style; ``data:`` is none."""

    @F.pandas_udf("array<string>")
    def refs(css: pd.Series) -> pd.Series:
        return css.map(html.css_urls)

    styled = _html(s, d).select("page_id", F.regexp_extract("html", "(?s)<style>(.*?)</style>", 1).alias("css"))
    return styled.select("page_id", F.posexplode(refs("css")).alias("pos", "ref"))


@_q("SELECT src AS page_id, unnest(['a' || src % 5 || '.png', 'b.png']) AS ref FROM (SELECT DISTINCT src FROM links)", "mentions links")
def c15_srcset(s, d):
    """The addresses of image sets; empty candidates are none."""

    @F.pandas_udf("array<string>")
    def refs(value: pd.Series) -> pd.Series:
        return value.map(html.srcset_urls)

    return _html(s, d).select("page_id", F.explode(refs(F.regexp_extract("html", 'srcset="([^"]*)"', 1))).alias("ref"))


@_q(f"SELECT host, {rendezvous_sql('host', ['w0', 'w1', 'w2', 'w3', 'w4'])} AS owner, {rendezvous_sql('host', ['w0', 'w2', 'w3', 'w4'])} AS after FROM (SELECT DISTINCT host FROM pages) t", "pages")
def c16_host_partitions(s, d):
    """The worker that owns a host, and the owner once worker w1 is gone: only its hosts move."""
    h = domain.pages(s, d).select("host").distinct()
    return h.select("host", tagsearch.rendezvous(F.col("host"), ["w0", "w1", "w2", "w3", "w4"]).alias("owner"), tagsearch.rendezvous(F.col("host"), ["w0", "w2", "w3", "w4"]).alias("after"))


_LEVELS = """arcs AS (SELECT src, dst, min(pos) AS pos FROM links WHERE dst % 11 <> 3 GROUP BY ALL),
walk AS (SELECT page_id, 0 AS depth FROM pages WHERE page_id % 97 = 0 UNION SELECT a.dst, w.depth + 1 FROM walk w JOIN arcs a ON a.src = w.page_id WHERE w.depth < 3),
depths AS (SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id)"""


@_q(
    "WITH asked AS (SELECT dst AS key, src % 4 AS depth, src, pos FROM links), f AS (SELECT key, min((depth, src, pos)) AS r FROM asked GROUP BY key), j AS (SELECT f.key, r[1] AS depth, r[2] AS src, r[3] AS pos, CASE WHEN f.key % 5 = 0 THEN 1 END AS seen FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY seen IS NULL ORDER BY depth, src, pos, key) AS k FROM j) SELECT key, CASE WHEN seen IS NULL AND k <= 300 THEN 'ADMITTED' WHEN seen IS NULL THEN 'OVER_BUDGET' WHEN depth < seen THEN 'SHALLOWER' ELSE 'SEEN' END AS verdict FROM n",
    "mentions links",
)
def c20_admission(s, d):
    asked = domain.links(s, d).select(F.col("dst").alias("key"), (F.col("src") % 4).alias("depth"), "src", "pos")
    seen = asked.where("key % 5 = 0").select("key", F.lit(1).alias("depth")).distinct()
    return cr.admit(asked, seen, 300, ["depth", "src", "pos"]).select("key", "verdict")


@_q(f"WITH {_LEVELS} SELECT page_id, depth FROM depths", "pages mentions links", True)
def c21_crawl(s, d):
    p = domain.pages(s, d)
    return cr.crawl(p, domain.links(s, d), p.where("page_id % 97 = 0"), 3, 10**9, F.col("page_id") % 11 != 3).select("page_id", "depth")


@_q(
    f"WITH {_LEVELS}, via AS (SELECT d.page_id, d.depth, min((a.src, a.pos)) AS m FROM depths d LEFT JOIN depths p ON p.depth = d.depth - 1 LEFT JOIN arcs a ON a.dst = d.page_id AND a.src = p.page_id WHERE d.depth = 0 OR a.src IS NOT NULL GROUP BY ALL) SELECT page_id, depth, CASE WHEN depth > 0 THEN m[1] END AS parent FROM via ORDER BY depth, CASE WHEN depth > 0 THEN m[1] END NULLS FIRST, CASE WHEN depth > 0 THEN m[2] END, page_id LIMIT (SELECT count(*) // 40 FROM pages)",
    "pages mentions links",
    True,
)
def c21_crawl_budget(s, d):
    """The same with a budget of one page in forty: earlier levels whole, the last one by (parent, position)."""
    p = domain.pages(s, d)
    return cr.crawl(p, domain.links(s, d), p.where("page_id % 97 = 0"), 3, p.count() // 40, F.col("page_id") % 11 != 3).select("page_id", "depth", "parent")


@_q("SELECT page_id, CAST(depth AS INTEGER) AS depth FROM (WITH RECURSIVE walk AS (SELECT page_id, 0 AS depth FROM pages WHERE page_id % 97 = 0 UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON l.src = w.page_id WHERE w.depth < 5) SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id)", "pages mentions links")
def c22_depths(s, d):
    return cr.relaxed_depths(domain.links(s, d), domain.pages(s, d).where("page_id % 97 = 0"), max_depth=5)


@_q("SELECT page_id, min(page_id) OVER (PARTITION BY hash, dir) AS owner, CASE WHEN page_id = min(page_id) OVER (PARTITION BY hash, dir) THEN 'FETCHED' ELSE 'DUPLICATE' END AS status FROM pages", "pages")
def c23_content_owners(s, d):
    return cr.content_owners(domain.pages(s, d))


_FREE = "free AS (SELECT page_id AS src, page_id + 1 AS dst FROM pages WHERE page_id % 13 = 4), paid AS (SELECT DISTINCT src, dst FROM links WHERE src % 13 <> 4)"


@_q(
    f"WITH {_FREE}, walk AS (SELECT page_id, 0 AS depth FROM pages WHERE page_id % 97 = 0 UNION SELECT n.dst, w.depth + n.c FROM walk w JOIN (SELECT src, dst, 0 AS c FROM free UNION ALL SELECT src, dst, 1 FROM paid) n ON n.src = w.page_id WHERE w.depth + n.c <= 3) SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id",
    "pages mentions links",
    True,
)
def c24_canonical_and_redirects(s, d):
    """Redirecting pages pass on at their own depth and have no other links."""
    p = domain.pages(s, d)
    free = p.where("page_id % 13 = 4").select(F.col("page_id").alias("src"), (F.col("page_id") + 1).alias("dst"))
    return cr.relaxed_depths(domain.links(s, d).where("src % 13 <> 4"), p.where("page_id % 97 = 0"), free, 3)


@_q(
    "WITH n AS (SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 50 = 3 THEN page_id ELSE page_id + 1 END AS next FROM pages), walk AS (SELECT id, id AS at, 0 AS k FROM n UNION ALL SELECT w.id, n.next, k + 1 FROM walk w JOIN n ON n.id = w.at WHERE n.next IS NOT NULL AND k < 5), ends AS (SELECT w.id, max(CASE WHEN n.id IS NOT NULL AND n.next IS NULL THEN w.at END) AS target, bool_or(n.id IS NULL) AS gone, bool_or(k > 0 AND w.at = w.id) AS back FROM walk w LEFT JOIN n ON n.id = w.at GROUP BY w.id) SELECT id, target, CASE WHEN target IS NOT NULL THEN 'FETCHED' WHEN back THEN 'LOOP' WHEN gone THEN 'GONE' ELSE 'TOO_MANY' END AS outcome FROM ends",
    "pages",
    True,
)
def c25_redirects(s, d):
    """Chains of redirects to the next page divisible by seven, with some that lead back to themselves."""
    k = F.col("page_id")
    nxt = F.when(k % 7 == 0, F.lit(None)).when(k % 50 == 3, k).otherwise(k + 1)
    return cr.follow_redirects(domain.pages(s, d).select(k.alias("id"), nxt.alias("next")))


def _nodes(s, d) -> DataFrame:
    """Pages as crawl nodes: every thirteenth redirects to the next, duplicates point at their owner."""
    p = domain.pages(s, d)
    own = cr.content_owners(p).withColumnRenamed("page_id", "o_id")
    both = p.join(own, F.col("page_id") == F.col("o_id"))
    hop = F.col("page_id") % 13 == 4
    status = F.when(hop, "REDIRECT").otherwise(F.col("status"))
    nxt = F.when(hop, F.col("page_id") + 1).when(F.col("status") == "DUPLICATE", F.col("owner"))
    return both.select(F.col("page_id").alias("id"), "url", urls.url_hash(F.col("url")).alias("url_hash"), status.alias("status"), F.when(F.col("page_id") % 6 == 1, "IMAGE").otherwise("PAGE").alias("type"), "hash", F.lit(".png").alias("ext"), nxt.alias("next"))


_NODES = "own AS (SELECT *, min(page_id) OVER (PARTITION BY hash, dir) AS owner FROM pages), nodes_ AS (SELECT page_id AS id, url, substring(sha256(url), 1, 32) AS url_hash, CASE WHEN page_id % 13 = 4 THEN 'REDIRECT' WHEN page_id = owner THEN 'FETCHED' ELSE 'DUPLICATE' END AS status, CASE WHEN page_id % 6 = 1 THEN 'IMAGE' ELSE 'PAGE' END AS type, hash, CASE WHEN page_id % 13 = 4 THEN page_id + 1 WHEN page_id <> owner THEN owner END AS next FROM own), hops AS (SELECT id, id AS at, 0 AS k FROM nodes_ UNION ALL SELECT h.id, n.next, k + 1 FROM hops h JOIN nodes_ n ON n.id = h.at WHERE n.status <> 'FETCHED' AND n.next IS NOT NULL AND k < 9), resolved AS (SELECT h.id, max(CASE WHEN n.status = 'FETCHED' THEN h.at END) AS target FROM hops h LEFT JOIN nodes_ n ON n.id = h.at GROUP BY h.id)"


@_q(
    "WITH asked AS (SELECT dst AS key, src % 4 AS depth, src, pos, (['IMAGE', 'CSS', 'VIDEO', 'FONT', 'OTHER'])[(src + pos) % 5 + 1] AS type FROM links WHERE dst % 6 = 1), f AS (SELECT key, min((depth, src, pos, type)) AS r FROM asked GROUP BY key), j AS (SELECT key, r[1] AS depth, r[2] AS src, r[3] AS pos, r[4] AS type, key % 18 = 1 AS known FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY known ORDER BY depth, src, pos, key) AS k FROM j), t AS (SELECT *, CASE WHEN known THEN CASE WHEN depth < 2 THEN 'SHALLOWER' ELSE 'SEEN' END WHEN k <= (SELECT count(*) // 40 FROM links) THEN 'ADMITTED' ELSE 'OVER_BUDGET' END AS verdict FROM n) SELECT key, depth, verdict, CASE WHEN verdict = 'ADMITTED' THEN CASE WHEN type IN ('IMAGE', 'CSS') THEN 'QUEUED' ELSE 'REFERENCED' END END AS status FROM t",
    "mentions links",
)
def c26_asset_policy(s, d):
    """Links to every sixth page are taken for assets: leaves at their page's depth, downloaded or referenced, within a budget."""
    kinds = F.array(*[F.lit(x) for x in ("IMAGE", "CSS", "VIDEO", "FONT", "OTHER")])
    e = domain.links(s, d)
    asked = e.where("dst % 6 = 1").select(F.col("dst").alias("key"), (F.col("src") % 4).alias("depth"), "src", "pos", F.element_at(kinds, ((F.col("src") + F.col("pos")) % 5 + 1).cast("int")).alias("type"))
    seen = asked.where("key % 18 = 1").select("key", F.lit(2).alias("depth")).distinct()
    return cr.admit_assets(asked, seen, ["IMAGE", "CSS"], e.count() // 40).select("key", "depth", "verdict", "status")


@_q("SELECT event_id, CASE WHEN (event_id % 5 = 0 OR event_id % 5 = 1 OR event_id % 5 = 2) AND user_id % 5 < 3 THEN CAST(250 * pow(2, user_id % 5) AS BIGINT) END AS wait_ms FROM events")
def c27_retry(s, d):
    status = F.element_at(F.array(*[F.lit(x) for x in (0, 429, 503, 200, 404)]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, d, "events").select("event_id", cr.retry_rule(status, F.col("user_id") % 5, 250).alias("wait_ms"))


_SNAPS = "snaps AS (SELECT dir AS url, max(fetched_at) AS fetched_at FROM pages WHERE page_id % 3 = 0 AND fetched_at IS NOT NULL GROUP BY dir)"


@_q(f"WITH {_SNAPS} SELECT page_id, CASE WHEN s.fetched_at IS NULL THEN 'FETCH' WHEN s.fetched_at > TIMESTAMP '2025-08-31' - INTERVAL 7 DAYS THEN 'REUSE' ELSE 'CONDITIONAL' END AS plan FROM pages p LEFT JOIN snaps s ON s.url = p.dir", "pages")
def c28_snapshot_reuse(s, d):
    p = domain.pages(s, d)
    snaps = cr.latest_snapshots(p.where("page_id % 3 = 0 and fetched_at is not null").select(F.col("dir").alias("url"), "fetched_at", "hash"), "url")
    return cr.reuse_plan(p.select("page_id", F.col("dir").alias("url")), snaps, F.expr("timestamp_ntz'2025-08-31'"), "7 days").select("page_id", "plan")


@_q("SELECT page_id, (row_number() OVER (PARTITION BY host ORDER BY page_id % 3, page_id) - 1) * 1000 AS not_before_ms FROM pages", "pages")
def c29_frontier_order(s, d):
    t = domain.pages(s, d).select("page_id", "host", (F.col("page_id") % 3).alias("depth"), F.col("page_id").alias("seq"))
    return cr.frontier_order(t, 1000).select("page_id", "not_before_ms")


@_q(
    f"WITH parts AS (SELECT DISTINCT 'p' || event_id % 64 AS part FROM events), o AS (SELECT part, {rendezvous_sql('part', ['n1', 'n2', 'n3', 'n4'])} AS before, {rendezvous_sql('part', ['n1', 'n2', 'n4', 'n5'])} AS after FROM parts t) SELECT o.part, event_id AS off, before, after FROM events e JOIN o ON o.part = 'p' || event_id % 64 WHERE before <> after AND event_id % 5 = 0 AND NOT (before <> 'n3' AND event_id % 35 = 0)"
)
def c30_replay(s, d):
    """Node n3 leaves and n5 joins: uncommitted tasks of the parts that moved come again, but for what live owners are finishing."""
    e = table(s, d, "events").select(F.concat(F.lit("p"), F.col("event_id") % 64).alias("part"), F.col("event_id").alias("off"))
    parts = e.select("part").distinct()
    owners = parts.select("part", tagsearch.rendezvous(F.col("part"), ["n1", "n2", "n3", "n4"]).alias("before"), tagsearch.rendezvous(F.col("part"), ["n1", "n2", "n4", "n5"]).alias("after"))
    draining = e.where("off % 35 = 0").join(owners.where("before <> 'n3'").select("part"), "part", "left_semi")
    return cr.replayed(e, e.where("off % 5 <> 0"), owners, draining)


@_q(
    "WITH log AS (SELECT 'j' || event_id % 700 AS job, event_id AS seq, CASE event_type WHEN 'click' THEN 'QUEUED' ELSE 'RUNNING' END AS f, CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN 'RUNNING' WHEN event_type = 'click' THEN 'CANCELLED' WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS t FROM events), q AS (SELECT job, min(seq) AS s1, arg_min(t, seq) AS t1 FROM log WHERE f = 'QUEUED' GROUP BY job), r AS (SELECT l.job, min(l.seq) AS s2, arg_min(l.t, l.seq) AS t2 FROM log l JOIN q ON q.job = l.job WHERE l.f = 'RUNNING' AND q.t1 = 'RUNNING' AND l.seq > q.s1 GROUP BY l.job) SELECT j.job, coalesce(t2, t1, 'QUEUED') AS status, CASE WHEN t2 IS NOT NULL THEN s2 WHEN t1 = 'CANCELLED' THEN s1 END AS ended FROM (SELECT DISTINCT job FROM log) j LEFT JOIN q ON q.job = j.job LEFT JOIN r ON r.job = j.job"
)
def c47_job_outcomes(s, d):
    e = table(s, d, "events")
    click = F.col("event_type") == "click"
    to = F.when(click & (F.col("event_id") % 3 > 0), "RUNNING").when(click, "CANCELLED").when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED")
    log = e.select(F.concat(F.lit("j"), F.col("event_id") % 700).alias("job"), F.col("event_id").alias("seq"), F.when(click, "QUEUED").otherwise("RUNNING").alias("from_status"), to.alias("to_status"))
    return cr.job_outcomes(log)


@_q("SELECT 'j' || user_id % 7 AS job, count(*) FILTER (event_id % 4 = 0) AS pending, count(*) FILTER (event_id % 4 <> 0) AS closed FROM events GROUP BY 1")
def c31_task_close(s, d):
    t = table(s, d, "events").select(F.concat(F.lit("j"), F.col("user_id") % 7).alias("job"), F.col("event_id").alias("hash"), F.lit(1).alias("depth"), F.lit(0).alias("attempt"))
    closings = t.where("hash % 4 <> 0")
    return cr.close_tasks(t.union(t), closings.union(closings).union(closings))


@_q(f"WITH {_NODES} SELECT count(*) AS discovered, 0 AS pending, count(*) FILTER (status = 'FETCHED' AND type = 'PAGE') AS pages, count(*) FILTER (status = 'FETCHED' AND type <> 'PAGE') AS assets, count(*) FILTER (id % 9 = 0) AS reused, count(*) FILTER (status = 'DUPLICATE') AS duplicates, 0 AS failed, (SELECT count(*) FROM links) AS edges FROM nodes_", "pages mentions links", True)
def c32_job_stats(s, d):
    return cr.job_stats(_nodes(s, d).withColumn("reused", F.col("id") % 9 == 0), domain.links(s, d))


@_q(f"WITH {_NODES} SELECT id, url FROM nodes_ WHERE type = 'IMAGE' AND id > 40 ORDER BY id LIMIT 30", "pages", True)
def c33_pages_of_type(s, d):
    return _nodes(s, d).where("type = 'IMAGE' and id > 40").orderBy("id").limit(30).select("id", "url")


@_q("SELECT src, dst, pos, dst IN (SELECT page_id FROM pages WHERE page_id % 2 = 0) AS in_crawl FROM links", "pages mentions links")
def c34_out_links(s, d):
    return cr.out_links(domain.links(s, d), domain.pages(s, d).where("page_id % 2 = 0"))


@_q("SELECT host, arg_max(hash, (fetched_at, hash)) AS hash, max(fetched_at) AS fetched_at FROM pages WHERE fetched_at IS NOT NULL GROUP BY host", "pages")
def c35_latest(s, d):
    return cr.latest_snapshots(domain.pages(s, d).where("fetched_at is not null"), "host").select("host", "hash", "fetched_at")


@_q(f"WITH {_NODES} SELECT id, target FROM resolved", "pages", True)
def c36_resolve(s, d):
    return cr.resolve(_nodes(s, d).select("id", "next", (F.col("status") == "FETCHED").alias("has_content")))


@_q("SELECT src AS page_id, count(*) AS local FROM links WHERE dst % 2 = 0 GROUP BY src", "mentions links")
def c37_rewritten_links(s, d):
    """References in pages changed to local copies of the even targets."""

    @F.pandas_udf("string")
    def rewrite(h: pd.Series, url: pd.Series) -> pd.Series:
        out = []
        for text, u in zip(h, url, strict=True):
            refs = [r for r, k in html.parse_page(text)["links"] if k == "PAGE"]
            ids = {r: r.rsplit("/", 1)[1].split(".")[0] for r in refs}
            out.append(html.rewrite_links(text, u, ids, {i: f"local/{i}" for i in ids.values() if int(i) % 2 == 0}))
        return pd.Series(out)

    done = _html(s, d).select("page_id", rewrite("html", "url").alias("h"))
    n = F.size(F.regexp_extract_all("h", F.lit('href="local/(\\d+)#s"'), F.lit(1))).cast("long")
    return done.select("page_id", n.alias("local")).where("local > 0")


@_q(f"WITH {_NODES}, files AS (SELECT id, CASE WHEN type = 'PAGE' THEN 'pages/' || url_hash || '.html' ELSE 'assets/' || hash || '.png' END AS file FROM nodes_) SELECT n.url, n.status, coalesce(f.file, '') AS file FROM nodes_ n JOIN resolved r ON r.id = n.id LEFT JOIN files f ON f.id = r.target", "pages", True)
def c38_manifest(s, d):
    return cr.manifest(_nodes(s, d))


@_q("SELECT count(*) AS pages, CAST(sum(n) AS BIGINT) AS links FROM (SELECT doc_id, count(*) AS n FROM mentions GROUP BY doc_id)", "mentions")
def c39_sitemaps(s, d):
    """A sitemap per document, with a page per address it names and links from the first to all."""
    m = domain.mentions(s, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("m"))
    head = F.lit(f'<urlset xmlns:nav="{html.NAV}"><url><loc>http://root.example/</loc>')
    xml = F.concat(head, F.array_join(F.transform("m", lambda x: F.concat(F.lit('<nav:link href="'), x["url"], F.lit("?n="), x["pos"], F.lit('"/>'))), ""), F.lit("</url></urlset>"))

    @F.pandas_udf("long")
    def links(x: pd.Series) -> pd.Series:
        return x.map(lambda t: len(html.parse_sitemap(t)["links"]))

    return m.select(links(xml).alias("n")).agg(F.count("*").alias("pages"), F.sum("n").alias("links"))


@_q(
    "WITH e AS (SELECT 'm' || page_id // 20 AS sitemap, page_id AS src, CASE WHEN page_id % 3 > 0 THEN page_id // 20 * 20 + (page_id * 7 + 3) % 20 END AS dst FROM pages), n AS (SELECT sitemap, src AS id FROM e UNION SELECT sitemap, dst FROM e WHERE dst IS NOT NULL), free AS (SELECT * FROM n WHERE (sitemap, id) NOT IN (SELECT (sitemap, dst) FROM e WHERE dst IS NOT NULL AND dst <> src)), reach AS (SELECT sitemap, id AS top, id AS at FROM n UNION SELECT r.sitemap, r.top, e.dst FROM reach r JOIN e ON e.sitemap = r.sitemap AND e.src = r.at WHERE e.dst IS NOT NULL), rest AS (SELECT * FROM n WHERE (sitemap, id) NOT IN (SELECT (r.sitemap, r.at) FROM reach r JOIN free f ON f.sitemap = r.sitemap AND f.id = r.top)) SELECT sitemap, id AS root FROM free UNION ALL SELECT x.sitemap, x.id FROM rest x WHERE NOT EXISTS (SELECT 1 FROM reach r JOIN rest y ON y.sitemap = r.sitemap AND y.id = r.top WHERE r.sitemap = x.sitemap AND r.at = x.id AND r.top < x.id)",
    "pages",
    True,
)
def c40_sitemap_roots(s, d):
    """Per sitemap of twenty pages those nothing links to, then in file order the first of each part these do not reach."""
    block = F.floor(F.col("page_id") / 20).cast("long")
    dst = F.when(F.col("page_id") % 3 > 0, block * 20 + (F.col("page_id") * 7 + 3) % 20)
    return cr.sitemap_roots(domain.pages(s, d).select(F.concat(F.lit("m"), block).alias("sitemap"), F.col("page_id").alias("src"), dst.alias("dst")))


@_q(
    "WITH walk AS (SELECT page_id, 0 AS depth FROM pages WHERE page_id % 97 = 0 UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON l.src = w.page_id WHERE l.pos < 2 AND w.depth < 4 AND l.dst IN (SELECT page_id FROM pages)), d AS (SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id) SELECT page_id, depth, (SELECT count(*) FROM links WHERE src = page_id) AS recorded FROM d",
    "pages mentions links",
    True,
)
def c41_sitemap_crawl(s, d):
    """A sitemap made of each page's first two links."""
    p, e = domain.pages(s, d), domain.links(s, d)
    return cr.sitemap_crawl(p, e.where("pos < 2"), e, p.where("page_id % 97 = 0"), 4)


@_q(
    "WITH log AS (SELECT 't' || user_id % 4 AS tenant, 'g' || event_id % 200 AS name, event_id AS seq, 'u' || user_id % 3 AS owner, CASE event_type WHEN 'click' THEN 'REGISTER' WHEN 'view' THEN 'READY' WHEN 'error' THEN 'FAILED' END AS action FROM events), f AS (SELECT tenant, name, min(seq) AS reg, arg_min(owner, seq) AS owner FROM log WHERE action = 'REGISTER' GROUP BY ALL) SELECT f.tenant, f.name, f.owner, coalesce((SELECT arg_min(l.action, l.seq) FROM log l WHERE l.tenant = f.tenant AND l.name = f.name AND l.owner = f.owner AND l.seq > f.reg AND l.action IN ('READY', 'FAILED')), 'LOADING') AS status FROM f"
)
def c42_graph_catalog(s, d):
    e = table(s, d, "events")
    action = F.when(F.col("event_type") == "click", "REGISTER").when(F.col("event_type") == "view", "READY").when(F.col("event_type") == "error", "FAILED")
    log = e.select(F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant"), F.concat(F.lit("g"), F.col("event_id") % 200).alias("name"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("owner"), action.alias("action"))
    return cr.graph_catalog(log)


@_q("SELECT host, count(*) AS pages FROM pages WHERE split_part(host, '.', 2) || '.example' = 'site2.example' GROUP BY host", "pages")
def c43_scope(s, d):
    p = domain.pages(s, d)
    return cr.in_scope(p, p.where("page_id = 2"), "SAME_DOMAIN").groupBy("host").agg(F.count("*").alias("pages"))


@_q(f"WITH {_NODES} SELECT status, count(*) AS n FROM nodes_ GROUP BY status", "pages", True)
def c44_status_counts(s, d):
    return _nodes(s, d).groupBy("status").agg(F.count("*").alias("n"))


@_q("SELECT dst AS page_id, min(src % 6) AS depth, arg_min(src, (src % 6, src)) AS parent FROM links GROUP BY dst", "mentions links")
def c45_shallowest(s, d):
    best = F.min(F.struct((F.col("src") % 6).alias("depth"), F.col("src").alias("parent"))).alias("b")
    return domain.links(s, d).groupBy(F.col("dst").alias("page_id")).agg(best).select("page_id", "b.depth", "b.parent")


@_q("SELECT DISTINCT hash, substring(hash, 1, 2) || '/' || hash AS key FROM pages WHERE hash NOT IN (SELECT hash FROM pages WHERE page_id % 5 = 0)", "pages")
def c46_blobs(s, d):
    p = domain.pages(s, d)
    return cr.put_blobs(p.where("page_id % 5 = 0").select("hash").distinct(), p.select("hash"))


@_q("SELECT host, CAST(max(page_id * 10) AS BIGINT) AS not_before_ms FROM pages GROUP BY host", "pages")
def c48_host_schedule(s, d):
    return cr.host_schedule(domain.pages(s, d).select("host", (F.col("page_id") * 10).alias("not_before_ms")))


@_q("WITH req AS (SELECT 't' || user_id % 5 || '/' || event_id % 300 AS key, event_id AS seq, event_type AS body FROM events), f AS (SELECT key, min(seq) AS s, arg_min(body, seq) AS b FROM req GROUP BY key) SELECT CASE WHEN seq = s THEN 'RUN' WHEN body = b THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome, count(*) AS n FROM req JOIN f USING (key) GROUP BY 1")
def c49_job_creation(s, d):
    from loamgraph.operators.tagsearch import idempotent

    e = table(s, d, "events").select(F.concat(F.lit("t"), F.col("user_id") % 5, F.lit(":"), F.col("event_id") % 300).alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("body"))
    return idempotent(e).groupBy("outcome").agg(F.count("*").alias("n"))


QUERIES = Q
