"""URL filter against a plain scan of all rules, on both paths, and against its SQL."""

from __future__ import annotations

import random

import pytest
from compare import connect, differences

from emberline.llm import queries, url_filter

SF = "/root/testdata/sf0.001"


def _plain(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
        host, slash, path = rest[:cut].partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [
        (len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for h, p, v in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, False, None, otherwise))
    return host, path, best[3], best[4]


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
    ("b.org", "", "block"), ("org", "/a/b", "block"), ("org", "/a/bc", "allow"), ("org", "/a/bc/", "block"), ("same.net", "/x", "allow"),
    ("same.net", "/x", "block"), ("net", "/es/", "block"), ("dé.net", "/é", "block"), ("", "/admin/", "block"), ("a..net", "/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "://", "http://com", "http://COM/", "https://Example.com/en/1?x=/en/", "http://www.example.com/en/", "http://www.example.com/en",
    "http://xexample.com/en/1", "http://m.www.example.com/en/a//b", "http://example.com?/en/", "http://example.com#/en/", "http://a.net/es/", "http://net/es",
    "http://b.org", "http://c.b.org/z", "http://c.org/a/b", "http://c.org/a/bcd", "http://c.org/a/bc/d", "http://same.net/xyz", "http://DÉ.net/é", "http://dé.net/él",
    "http://q.io/admin/1", "http://user:pw@example.com:80/en/1", "ftp://x://example.com/en/", "http://a..net/x", "http://x.com/" + "s/" * 3000, "http://y\nz.net/fr/\n?",
    "http://example.com./en/",
]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_BYTES, 0])
def test_verdicts(spark, limit):
    parts = ["com", "net", "org", "example", "www", "b", "a", "same"]
    rng = random.Random(3)
    urls = URLS + ["http://" + ".".join(rng.choices(parts, k=rng.randint(1, 4))) + "/" * rng.randint(0, 2) + "/".join(rng.choices(["a", "b", "bc", "en", "es", ""], k=3)) for _ in range(300)]
    pages = spark.createDataFrame([(i % 200, u, 1, "x") for i, u in enumerate(urls)], "page_id int, url string, rule int, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(repr, (tuple(r) for r in url_filter.url_verdicts(pages, rules, broadcast_bytes=limit).collect())))
    assert got == sorted(repr((i % 200, *_plain(u, RULES))) for i, u in enumerate(urls))


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_BYTES, 0])
def test_edges(spark, limit):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (None, None), (1, "http://a.com/x")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rows = url_filter.url_verdicts(pages, none, otherwise="block", broadcast_bytes=limit).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, [(1, "a.com", "/x", None, "block")] * 2 + [(None, "", "", None, "block")]))
    every = spark.createDataFrame([(None, None, "block"), ("COM", "/x", "allow")], "host string, path string, verdict string")
    rows = url_filter.url_verdicts(pages, every, broadcast_bytes=limit).collect()
    assert sorted((r["rule"], r["verdict"]) for r in rows) == [("", "block"), ("com/x", "allow"), ("com/x", "allow")]
    assert url_filter.url_verdicts(pages.limit(0), every, broadcast_bytes=limit).count() == 0
    wrong = spark.createDataFrame([("a", "/", "deny")], "host string, path string, verdict string")
    with pytest.raises(Exception, match="allow or block"):
        url_filter.url_verdicts(pages, wrong, broadcast_bytes=limit).collect()


def test_query(spark):
    query, sql = queries.catalogue()["op11_url_filter"]
    assert differences(query(spark, SF), connect(SF), sql) == []
