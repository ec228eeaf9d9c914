import duckdb
import pytest

from riskframe.llm import queries, urlfilter

RULES = queries.URL_RULES
LINK = '<html><head><LINK href="{}" rel="canonical"></head>'
ROWS = [
    (1, "https://a.net/x", None), (2, "https://A.Example.NET/en/x?q#f", ""), (3, "https://example.net", "<p>"), (4, "http://example.com/de/1", None),
    (5, "http://other.com/1", LINK.format("http://m.example.com/de/1")), (6, "http://mirror.com/1", LINK.format("http://other.com/1")),
    (7, "https://s.org/fr/a", LINK.format("http://other.com/1")), (8, "http://free.com/", "<html>"), (9, None, LINK.format("http://other.com/1")),
    (10, "no scheme", None), (11, "http://other.com/1#frag", None), (12, "http://moved.com/a", "<META http-equiv=refresh content='0; URL=http://mirror.com/1'>"),
    (13, "http://good.com/a", LINK.format("/b")), (14, "http://good.com/b", LINK.format("//good.com/c")), (15, "http://notnet/x", None), (1, "https://a.net/x", None),
    (16, "http://x.net?y=/en/", None), (None, "http://b.net/", None), (17, "x://y://z.net/", None), (18, "http://mirror.com/1", LINK.format("relative.html")),
]
WANT = {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: (None, "allow"), 4: ("example.com/de/", "block"), 5: (None, "block"), 6: (None, "block"),
        7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "block"), 13: (None, "allow"),
        14: (None, "allow"), 15: (None, "allow"), 16: (None, "allow"), None: ("net/", "block"), 17: (None, "allow"), 18: (None, "block")}


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], "page_id long, url string, html string, host string, root string")


def test_verdicts(pages):
    got = urlfilter.judge(pages, RULES).collect()
    assert len(got) == len(ROWS)
    assert {r.page_id: (r.rule, r.verdict) for r in got} == WANT
    parts = {r.page_id: (r.host, r.path) for r in got}
    assert parts[2] == ("a.example.net", "/en/x") and parts[9] == parts[10] == ("", "") and parts[16] == ("x.net", "") and parts[17] == ("y:", "//z.net/")


def test_oracle_agrees(pages, tmp_path, spark):
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toPandas())
    want = con.execute(queries.ORACLE["op7_url_filter"]).fetchall()
    got = [tuple(r) for r in urlfilter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    key = lambda r: tuple(map(repr, r))
    norm = lambda r: (None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:])
    assert sorted(map(norm, got), key=key) == sorted(map(norm, want), key=key)


def test_redirects_and_empty(spark, pages):
    r = spark.createDataFrame([("http://free.com/", "http://a.net/x"), (None, "http://a.net/x")], "source string, target string")
    got = {x.page_id: x.verdict for x in urlfilter.judge(pages, RULES, r).collect()}
    assert got[8] == "block" and got[13] == "allow"
    assert urlfilter.judge(pages.limit(0), RULES).collect() == []
    assert {x.verdict for x in urlfilter.judge(pages, []).collect()} == {"allow"}


REFRESH = "<meta content=\"{}\" http-equiv='Refresh' />"


@pytest.mark.parametrize("url,html,target", [
    ("http://a.com/x/y?z", LINK.format("page2.html"), "http://a.com/x/page2.html"),
    ("http://a.com", LINK.format("page2.html"), "http://a.com/page2.html"),
    ("http://a.com/x/y/z", LINK.format("../p"), "http://a.com/x/p"),
    ("http://a.com/x/y", LINK.format("../../.././p/."), "http://a.com/p/"),
    ("http://a.com/x/y", LINK.format(".."), "http://a.com/"),
    ("http://a.com/x/y", LINK.format("/q/../p?r=../s"), "http://a.com/p?r=../s"),
    ("http://a.com/x?a=1#f", LINK.format("?p=2"), "http://a.com/x?p=2"),
    ("http://a.com/x", LINK.format("/p?a=1&amp;b=2"), "http://a.com/p?a=1&b=2"),
    ("http://a.com/x", LINK.format("p?to=http://b.com/"), "http://a.com/p?to=http://b.com/"),
    ("http://a.com/x", LINK.format("mailto:me@b.com"), None),
    ("http://a.com/x", "<link rel=canonical><link rel='canonical' href='http://b.com/2'>", "http://b.com/2"),
    ("http://a.com/x", "<link rel='nofollow Canonical' href=http://b.com/2>", "http://b.com/2"),
    ("http://a.com/x", "<link rel='x-canonical' href=http://b.com/2>", None),
    ("http://a.com/x", "<link title='rel=canonical' rel=icon data-href=http://b.com/1 href=http://b.com/2>", None),
    ("http://a.com/x", "<link data-href='http://b.com/1' title='a > b' rel=canonical href='http://b.com/2'/>", "http://b.com/2"),
    ("http://a.com/x", "<meta http-equiv=refresh content=5>" + REFRESH.format("0;url='next.html'"), "http://a.com/next.html"),
    ("http://a.com/x", REFRESH.format("0; URL=/p?a=1&amp;b=2"), "http://a.com/p?a=1&b=2"),
    ("no scheme", LINK.format("page2.html"), None),
    ("http://a.com/x", "<link rel=\"canonical\"href='p'>", "http://a.com/p"),
    ("http://a.com/x", "<meta name=description content=\"it's 5 > 4\"><link href=it's rel=canonical>", "http://a.com/it's"),
    ("http://a.com/x", REFRESH.format("0; /p") + "<link " + "x='y' " * 3000 + "><link " + "z" * 100000 + ">", "http://a.com/p"),
])
def test_edges_of_links(spark, url, html, target):
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    got = [(r.a, r.b) for r in urlfilter.alias_edges(pages).collect()]
    assert got == ([] if target is None else [(url.split("#")[0], target)])


def test_every_link_of_a_page_reaches_its_aliases(spark):
    rows = [(1, "http://a.com/d/1?k=1&l=2", None), (2, "http://a.com/d/2", LINK.format("1?k=1&amp;l=2") + LINK.format("../3")),
            (3, "http://a.com/3", REFRESH.format("0;url=//b.net/")), (4, "http://a.com/4", LINK.format("5"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(pages, RULES).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}
