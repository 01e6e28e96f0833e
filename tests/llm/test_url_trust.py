from __future__ import annotations

from textloom.llm import common, url_trust as url_trust_module
from textloom.llm.url_trust import url_trust


def test_rules_hosts_and_links(spark):
    rows = [
        (1, "http://A.example.COM/en/x?q#f", None),
        (2, "https://www.example.com/en/y", ""),
        (3, "http://x.net/es/1", '<a href="https://linked.org/a">l</a><a href="/local">m</a>'),
        (4, "http://linked.org/z", "<p>"),
        (5, None, "<a href='//good.com/'>"),
        (6, "no scheme", None),
        (7, "http://supporter.org/", "<A class=x HREF=http://x.net/q>"),
        (8, "http://com", None),
        (9, "http://good.com/", '<a href="http://praised.org">'),
        (9, "http://good.com/", '<a href="http://praised.org">'),
        (10, "http://praised.org/1", '<a href="http://x.net/">'),
        (11, "http://b.net:80://x/fr/", None),
    ]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_trust(df).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/y", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4] == ("linked.org", "/z", None, "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("supporter.org", "/", None, "block")
    assert got[8] == ("com", "", None, "allow")
    assert got[9][2:] == ("com/", "allow")
    assert got[11][:2] == ("b.net:80:", "//x/fr/") or got[11][0] == "b.net:80:"


def test_empty(spark):
    assert url_trust(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts_of_many_edges_and_pages_are_joined_alike(spark, monkeypatch):
    rows = [(i, f"http://h{i % 9}.site{i % 3}.net/{'es' if i % 4 == 0 else 'x'}/", f'<a href="http://h{(i * 7) % 9}.site1.net/">') for i in range(60)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    show = lambda out: sorted((r["page_id"], r["host"], r["verdict"], round(r["trust"], 9), round(r["distrust"], 9)) for r in out.collect())
    plain = show(url_trust(df))
    assert sum({h: t for _, h, _, t, _ in plain}.values()) <= 1 + 1e-6
    for module in (common, url_trust_module):
        monkeypatch.setattr(module, "HOT_ROWS", 2)
    assert show(url_trust(df)) == plain
