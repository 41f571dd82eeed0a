import pytest
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import links, policy

HTML = [
    ("<a href=x>y</a>", ["x"]),
    ('<abbr title=1 href="q>r">', ["q>r"]),
    ("<A HREF='z'>", ["z"]),
    ('<a name=1><a href=#f><a href=mailto:x><a href="/ok"', ["/ok"]),
    ('<article data-href="/w">', ["/w"]),
    ('<a href=""><a href= b>', []),
    ('<a x href="unterminated <a href="n">', ["unterminated <a href="]),
    ('<a\nclass=c\nhref="nl">', ["nl"]),
    ("<a href='a\"b'>", ['a"b']),
    ('<a href="JavaScript:x">', ["JavaScript:x"]),
    ("", []),
    (None, []),
]


def test_link_extraction(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HTML)], "i long, html string")
    got = {r["i"]: r["l"] for r in df.select("i", links.crawlable_links(F.coalesce("html", F.lit(""))).alias("l")).collect()}
    assert [got[i] for i in range(len(HTML))] == [want for _, want in HTML]


def test_cap_counts_kept_links_and_long_urls_are_cut(spark):
    html = "".join(f'<a href="#s"><a href="/{i}">' for i in range(300)) + f'<a href="{"u" * 5000}">'
    df = spark.createDataFrame([("p", html)], "url string, html string")
    assert [r["link"] for r in links.extract_links(df).orderBy("pos").collect()] == [f"/{i}" for i in range(256)]
    assert len(links.extract_links(df, limit=None).orderBy(F.desc("pos")).first()["link"]) == 4095


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [("http://a.b/c/d?q=1", "e", "http://a.b/c/e"), ("http://a.b", "e", "http://a.b/e"), ("https://a.b/c", "//x/y", "https://x/y"), ("http://a.b/c", "/d", "http://a.b/d"), ("http://a.b/c", "mail:x", "mail:x"), ("http://a.b/c?x", "?y", "http://a.b/c?y")],
)
def test_resolve(spark, base, link, want):
    assert spark.range(1).select(links.resolve(F.lit(base), F.lit(link))).first()[0] == want


def test_domains(spark):
    urls = {"http://u@a.b:80/x": "u@a.b:80", "a.b/c": "a.b", "https://a.b": "a.b", "": "", "//x/y": ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["d"] for r in df.select("url", policy.domain(F.col("url")).alias("d")).collect()} == urls
    seeds = spark.createDataFrame([("HTTP://A.B/",)], "url string")
    assert policy.on_seed_domains(spark.createDataFrame([("http://a.b/1",), ("http://c/",)], "url string"), seeds).count() == 1


def test_outcomes(spark):
    want = {200: "OK", 301: "REDIRECT", 304: "ERROR", 308: "REDIRECT", 403: "FORBIDDEN", 404: "NOT_FOUND", 410: "GONE", 429: "SERVER_ERROR", 500: "SERVER_ERROR", 503: "SERVER_ERROR", 0: "TIMEOUT", 418: "ERROR"}
    df = spark.createDataFrame([(c,) for c in want], "code int")
    assert {r["code"]: r["o"] for r in df.select("code", policy.outcome_of_status(F.col("code")).alias("o")).collect()} == want
    one = spark.range(1)
    assert one.select(policy.outcome(F.lit(200), F.lit("image/png"))).first()[0] == "CONTENT_SKIP"
    assert one.select(policy.header_content_type(F.lit("Date: x\r\nCONTENT-TYPE:  text/html; a\r\nX: y"))).first()[0] == "text/html; a"
    assert one.select(F.length(policy.capped_body(F.lit("abcdef"), 4))).first()[0] == 4
    assert policy.can_continue(3, policy.CrawlPolicy(max_pages=4)) and not policy.can_continue(4, policy.CrawlPolicy(max_pages=4))


def test_scalar_functions(spark):
    row = spark.range(1).select(
        text.leading_int(F.lit(" 12x")), text.leading_int(F.lit("x")), text.contains_ignoring_case(F.lit("aBc"), F.lit("Bc")), text.equals_ignoring_case(F.lit("A"), F.lit("a")), text.truncated(F.lit("abc"), 2)
    ).first()
    assert tuple(row) == (12, 0, True, True, "ab")
