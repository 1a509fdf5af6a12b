import random
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.functions import html, lexorank, recurrence, urls

BASE = "https://example.com/docs/guide/intro.html"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Example.COM:443/a/b/../c#top", "https://example.com/a/c"), ("http://example.com", "http://example.com/"), ("http://example.com:8080", "http://example.com:8080/"),
        ("https://example.com/%7euser", "https://example.com/~user"), ("https://example.com/a%2fb", "https://example.com/a%2Fb"), ("https://shop.com/p?id=7&utm_source=mail&color=red&gclid=x&sessionid=abc", "https://shop.com/p?color=red&id=7"),
        ("https://shop.com/p?utm_campaign=x", "https://shop.com/p"), ("mailto:a@b.com", None), ("javascript:void(0)", None), ("data:image/png;base64,AA", None), ("", None), (None, None), ("https://example.com/" + "x" * 2048, None),
        ("https://bücher.example/ü", "https://xn--bcher-kva.example/%C3%BC"), ("http://x.com./../../a", "http://x.com/a"), ("http://exa mple.com/", None), ("https://x.com/a b|c", "https://x.com/a%20b%7Cc"), ("http://x.com:99999/", None),
    ],
)
def test_canonical(raw, want):
    assert urls.canonical(raw) == want


@pytest.mark.parametrize(("raw", "want"), [("setup.html", "https://example.com/docs/guide/setup.html"), ("../../img/x.png", "https://example.com/img/x.png"), ("//cdn.com/x.js", "https://cdn.com/x.js"), ("/a b", "https://example.com/a%20b")])
def test_relative(raw, want):
    assert urls.canonical(raw, BASE) == want


def test_base_without_path():
    assert urls.canonical("p.html", "https://cdn.example.com") == "https://cdn.example.com/p.html"


def test_learned_parameters():
    assert urls.canonical("https://n.com/a?ref=h&b=1", learned={"n.com": {"ref"}}) == "https://n.com/a?b=1"
    assert urls.canonical("https://m.com/a?ref=h&b=1", learned={"n.com": {"ref"}}) == "https://m.com/a?b=1&ref=h"


@given(st.text(max_size=60))
def test_canonical_is_stable(text):
    once = urls.canonical("http://x.example/" + text)
    assert once is None or urls.canonical(once) == once


def test_robots():
    r = urls.Robots("User-agent: *\nDisallow: /\n\nUser-agent: loambot # us\nDisallow: /private*\nAllow: /private/open$\nCrawl-delay: 2.5\nSitemap: https://x/s.xml", "loambot/1.0")
    assert [r.allows(p) for p in ("/x", "/private/a", "/private/open", "/private/open/x")] == [True, False, True, False]
    assert r.delay_ms == 2500 and r.sitemaps == ["https://x/s.xml"]
    other = urls.Robots("User-agent: a\nUser-agent: *\nDisallow: /q\nAllow: /q\n", "z")
    assert other.allows("/q") and other.rules == [("/q", False), ("/q", True)]
    assert urls.Robots("", "z").allows("/")


def test_public_addresses():
    want = {"8.8.8.8": True, "10.1.1.1": False, "100.64.0.1": False, "64:ff9b::7f00:1": False, "64:ff9b::808:808": True, "::1": False, "2606:4700::1": True, "198.18.0.1": False, "::ffff:10.0.0.1": False, "x": None}
    assert {k: urls.is_public(k) for k in want} == want


def test_bloom():
    b = urls.Bloom(100_000, 0.01)
    b.add([f"k{i}" for i in range(100_000)])
    assert b.has([f"k{i}" for i in range(100_000)]).all()
    assert b.has([f"z{i}" for i in range(100_000)]).sum() < 2_000


def test_bloom_in_parts(spark):
    from loamgraph.session import Scratch

    held = spark.range(20_000).selectExpr("concat('k', id) as key")
    held = held.unionByName(held.where("key < 'k2'")).unionByName(spark.createDataFrame([(None,)], "key string"))
    stored = Scratch(spark, "bloom").keep(urls.bloom_filter(held, 0.01, 3_000))
    assert stored.count() == 7 and stored.agg({"n": "sum"}).first()[0] == 20_000
    asked = held.unionByName(spark.range(20_000).selectExpr("concat('z', id) as key"))
    told = urls.bloom_known(asked, stored, 0.01).toPandas()
    assert len(told) == 40_000 and told[told["key"].str[0] == "k"]["known"].all()
    assert told[told["key"].str[0] == "z"]["known"].mean() < 0.02
    none = Scratch(spark, "bloom").keep(urls.bloom_filter(held.where("false"), 0.01))
    assert none.count() == 0 and not urls.bloom_known(asked.limit(5), none, 0.01).toPandas()["known"].any()


def test_literal_ranks():
    pairs = {(None, None): "i", ("i", None): "i00001", ("i00009", None): "i0000a", ("i0000z", None): "i00011", (None, "i"): "hzzzzz", (None, "i00011"): "i0000z", ("zzzzzz", None): "zzzzzzi", (None, "000001"): "000000i", ("a", "b"): "ai", ("a", "a1"): "a0i", ("az", "b"): "azi"}
    assert {k: lexorank.between(*k) for k in pairs} == pairs


def test_placement_weights():
    """Against the hash computed byte by byte with whole numbers."""
    from loamgraph.operators.tagsearch import placement_weights

    def one(text):
        h = 14695981039346656037
        for b in text.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        h = (h ^ h >> 33) * 18397679294719823053 % 2**64
        h ^= h >> 33
        return h - 2**64 if h >= 2**63 else h

    keys = ["", "a", "tenant-0042", "ä" * 40]
    assert placement_weights(keys, "shard-1").tolist() == [one(f"{k}\0shard-1") for k in keys]


def test_html_links():
    page = html.parse_page(
        """<html><head><title> A  b </title><base href="/x/"><link rel="canonical" href="/c"><link rel=stylesheet href=s.css><link rel="preload" as="font" href="f"><link rel=icon href=i.ico><link rel=next href=n>
        <meta name="robots" content="noindex, nofollow"><style>@import "y.css"; p{background:url('bg.png')}</style></head><body style="background:url(data:x)"><a href="p.html?x#y">1</a><area href="d.pdf"><img src=a.png srcset="b.png 1x, c.png 2x">
        <video src=v.mp4 poster=o.jpg><source src=w.webm></video><audio><source src=s.ogg></audio><script src=j.js></script><iframe src=f.html></iframe><embed src=e.swf><object data=o.pdf></object><input type=image src=in.png><track src=t.vtt></body></html>"""
    )
    assert (page["title"], page["canonical"], page["base"], page["no_follow"], page["no_index"]) == ("A b", "/c", "/x/", True, True)
    assert sorted(page["links"]) == sorted(
        [
            ("s.css", "CSS"), ("f", "FONT"), ("i.ico", "IMAGE"), ("n", "PAGE"), ("bg.png", "IMAGE"), ("y.css", "CSS"), ("p.html?x#y", "PAGE"), ("d.pdf", "DOCUMENT"), ("a.png", "IMAGE"), ("b.png", "IMAGE"), ("c.png", "IMAGE"), ("v.mp4", "VIDEO"),
            ("o.jpg", "IMAGE"), ("w.webm", "VIDEO"), ("s.ogg", "AUDIO"), ("j.js", "SCRIPT"), ("f.html", "PAGE"), ("e.swf", "OTHER"), ("o.pdf", "DOCUMENT"), ("in.png", "IMAGE"), ("t.vtt", "OTHER"),
        ]
    )


def test_rewriting():
    page = '<base href="https://a.example/x/"><a href="y.html#f">t</a><img src="i.png" integrity="q" srcset="a.png 1x"><a href="mailto:q">m</a>&amp;<!--c-->'
    local = {urls.url_hash_of("https://a.example/x/y.html"): "y.html", "recorded": "../i.png"}
    out = html.rewrite_links(page, "https://a.example/", {"i.png": "recorded"}, local)
    assert out == '<a href="y.html#f">t</a><img src="../i.png" srcset="https://a.example/x/a.png 1x"><a href="mailto:q">m</a>&amp;<!--c-->'
    assert html.rewrite_links(page, "https://a.example/", {}, local, "RAW") == page
    assert 'href="https://a.example/x/y.html#f"' in html.rewrite_links(page, "https://a.example/", {}, local, "ABSOLUTE")
    assert html.rewrite_links("p{background:url('z.png')}", "https://a.example/c/s.css", {}, {}, css=True) == "p{background:url('https://a.example/c/z.png')}"


def test_sitemap():
    head = f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:nav="{html.NAV}">'
    got = html.parse_sitemap(head + '<url nav:root="true"><loc>https://e.com/</loc><nav:link href="/about"/></url><url><loc>https://e.com/about</loc></url></urlset>')
    assert got == {"pages": ["https://e.com/", "https://e.com/about"], "links": [("https://e.com/", "https://e.com/about")], "roots": ["https://e.com/"]}
    assert html.parse_sitemap(head + "<url><loc>https://e.com/a</loc></url></urlset>")["roots"] == ["https://e.com/a"]
    for bad in ("<!DOCTYPE x><urlset/>", "<x/>", head + "<url/></urlset>", head + "<url><loc>ftp://x</loc></url></urlset>", "<urlset>"):
        with pytest.raises(ValueError):
            html.parse_sitemap(bad)


def test_ranks_random_inserts():
    r, ranks = random.Random(3), lexorank.spaced(4)
    for _ in range(20_000):
        i = r.randrange(len(ranks) + 1)
        ranks.insert(i, lexorank.between(ranks[i - 1] if i else None, ranks[i] if i < len(ranks) else None))
    assert ranks == sorted(set(ranks)) and not any(x.endswith("0") for x in ranks)


def test_ranks_appended_stay_short():
    assert max(map(len, lexorank.spaced(100_000))) <= 7
    low = lexorank.between(None, None)
    for _ in range(2_000):
        low = lexorank.between(None, low)
    assert len(low) <= 8


@settings(max_examples=200)
@given(st.text(alphabet=lexorank.DIGITS, min_size=1, max_size=8), st.text(alphabet=lexorank.DIGITS, min_size=1, max_size=8))
def test_rank_between(a, b):
    a, b = sorted((a, b))
    if a == b or a[-1] == "0" or b[-1] == "0":
        with pytest.raises(ValueError):
            lexorank.between(a, b)
    else:
        assert a < lexorank.between(a, b) < b


def ms(*x):
    return int(datetime(*x, tzinfo=UTC).timestamp()) * 1000


@pytest.mark.parametrize(
    ("at", "unit", "amount", "zone", "want"),
    [
        (ms(2026, 1, 31), "MONTHLY", 1, "UTC", ms(2026, 2, 28)), (ms(2026, 3, 31), "MONTHLY", 1, "UTC", ms(2026, 4, 30)), (ms(2026, 4, 30), "MONTHLY", 1, "UTC", ms(2026, 5, 30)), (ms(2024, 2, 29), "YEARLY", 1, "UTC", ms(2025, 2, 28)),
        (ms(2026, 3, 28, 11), "DAILY", 1, "Europe/Berlin", ms(2026, 3, 29, 10)), (ms(2026, 3, 28, 11), "HOUR", 24, "Europe/Berlin", ms(2026, 3, 29, 11)), (ms(2026, 3, 28, 1, 30), "DAILY", 1, "Europe/Berlin", ms(2026, 3, 29, 1, 30)),
        (1_500, "SECOND", 2, "UTC", 3_500), (ms(2026, 12, 31) + 7, "MONTHLY", 2, "UTC", ms(2027, 2, 28) + 7),
    ],
)
def test_recurrence(at, unit, amount, zone, want):
    assert recurrence.next_after(at, unit, amount, zone) == want


def test_recurrence_refuses_zero():
    with pytest.raises(ValueError):
        recurrence.next_after(0, "DAILY", 0)
