import pytest
from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import selectors as S
from pagemill.functions.text import bind

PAGE = """<html><head><meta property="article:published_time" content="2024-01-05"></head><body>
<div class="a b" id=m><p>one</p><p>two</p><div><p class='x'>three</p></div></div><p>four &amp; five</p>
<a href="/news/1">L1</a><a class=z href='/x'>L2</a><ul><li>1<li>2<li>3</ul></body></html>"""

CASES = {
    "//p": ["one", "two", "three", "four & five"],
    "//p[1]": ["one", "three", "four & five"],
    "(//p)[1]": ["one"],
    "(//p)[0]": [],
    "(//p | //li)[5]": ["1"],
    "//p[0]": [],
    "//div/p": ["one", "two", "three"],
    '//div[@class="a b"]/p[2]': ["two"],
    "/html/body/p": ["four & five"],
    "/body": [],
    '//a[contains(@href, "/news/")]': ["L1"],
    '//a[starts-with(@href,"/x")]': ["L2"],
    '//a[@class and contains(@href,"x")]': ["L2"],
    '//p[contains(., "five")]': ["four & five"],
    '//meta[@property="article:published_time"]/@content': ["2024-01-05"],
    "//a/@class": ["z"],
    "//p[string-length(normalize-space()) > 4]": ["three", "four & five"],
    "//p[string-length(normalize-space()) > 3][1]": ["three", "four & five"],
    "//ul/*": ["1", "2", "3"],
    "//li[2] | //a": ["L1", "L2", "2"],
    "//P": [],
}
INVALID = ["", "h1", "//", "//div[", "//div[@class=test]", '//div[@class="x', "//p[last()]", "//a/@href/p", "//p]"]


def pick(spark, cases):
    df = spark.createDataFrame([(i, PAGE, s) for i, s in enumerate(cases)], "i int, html string, s string")
    doc = bind(df, doc=F.expr(M.parsed("html")), c=F.expr(S.compiled("s")))
    texts = f"transform({S.matches('c', 'doc.events', 'doc.nodes')}, _n -> {S.node_text('doc.events', '_n')})"
    return doc.orderBy("i").select(F.expr(texts).alias("t"), F.col("c").isNotNull().alias("ok")).collect()


def test_matches(spark):
    rows = pick(spark, CASES)
    assert {s: r.t for s, r in zip(CASES, rows)} == CASES
    assert all(r.ok for r in rows)


def test_unreadable_selectors_match_nothing(spark):
    rows = pick(spark, INVALID)
    assert [r.t for r in rows] == [[]] * len(INVALID)
    assert not any(r.ok for r in rows)


@pytest.mark.parametrize("rank", [1, 7])
def test_position_counts_per_parent(spark, rank):
    page = "<div>" + "".join(f"<ul>{''.join(f'<li>{u}.{i}</li>' for i in range(1, 9))}</ul>" for u in range(30)) + "</div>"
    df = spark.createDataFrame([(page, f"//li[{rank}]")], "html string, s string")
    doc = bind(df, doc=F.expr(M.parsed("html")), c=F.expr(S.compiled("s")))
    texts = f"transform({S.matches('c', 'doc.events', 'doc.nodes')}, _n -> {S.node_text('doc.events', '_n')})"
    assert doc.select(F.expr(texts).alias("t")).first().t == [f"{u}.{rank}" for u in range(30)]
