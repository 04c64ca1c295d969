from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions.text import bind


def parse(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r.doc for r in bind(df, doc=F.expr(M.parsed("html"))).orderBy("i").collect()]


def outline(doc):
    """Nested (tag, children) of the parsed page."""
    kids = {}
    for n in doc.nodes:
        kids.setdefault(n.parent, []).append(n)

    def tree(parent):
        return [(n.tag, tree(n.start)) if kids.get(n.start) else n.tag for n in kids.get(parent, [])]

    return tree(-1)


def test_closing_tags_left_out(spark):
    pages = [
        "<p>one<b>two<br><p>three</p>",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>",
        "<table><tr><td>1<td>2<tr><td><table><tr><td>x</table></table>",
        "<dl><dt>a<dd>b<dt>c</dl>",
        "<div><p>x<div>y</div></div>",
        "<select><option>1<option>2</select>",
    ]
    assert [outline(d) for d in parse(spark, pages)] == [
        [("p", [("b", ["br"])]), "p"],
        [("ul", ["li", ("li", [("ul", ["li"])]), "li"])],
        [("table", [("tr", ["td", "td"]), ("tr", [("td", [("table", [("tr", ["td"])])])])])],
        [("dl", ["dt", "dd", "dt"])],
        [("div", ["p", "div"])],
        [("select", ["option", "option"])],
    ]


def test_stray_and_crossing_closes(spark):
    docs = parse(spark, ["a</b></div><i>x</i>", "<div><span>x</div>y</span>", "<b><div>x</b>y</div></b>"])
    assert [outline(d) for d in docs] == [["i"], [("div", ["span"])], [("b", ["div"])]]
    assert [e.kind for e in docs[0].events if e.kind == "stray"] == ["stray", "stray"]


def test_scripts_comments_attributes(spark):
    page = """<DIV Class='a > b' id=x ID=y data-q="&lt;&quot;" hidden><script>var a="</p><b>";</script><!-- <i> --><img src=q /></DIV>"""
    (doc,) = parse(spark, [page])
    assert outline(doc) == [("div", ["script", "img"])]
    assert doc.nodes[0].attrs == {"class": "a > b", "id": "x", "data-q": '<"', "hidden": ""}
    assert [e.raw for e in doc.events if e.kind == "rawtext"] == ['var a="</p><b>";']


def test_serialised_again(values):
    doc = M.parsed("x")
    whole = M.let("_d", doc, M.markup_between("_d.events", "0", "size(_d.events) - 1"))
    pages = ["<P Class=a>1 &lt; 2 &amp; &eacute;<br/>x<b>y", "<script>a<b</script><!-- c --><!DOCTYPE html>"]
    assert values(whole, pages) == ['<p class="a">1 &lt; 2 &amp; é<br>x<b>y</b></p>', "<script>a<b</script><!-- c -->"]


def test_entities(values):
    texts = ["&amp;lt; &#65;&#x42; &copy;&nbsp;&apos; &nope; &amp &#0; &#1114112; a&b", None, "plain"]
    assert values(M.decode_entities("x"), texts) == ["&lt; AB ©\xa0' &nope; &amp &#0; &#1114112; a&b", None, "plain"]


def test_empty_pages(spark):
    for doc in parse(spark, ["", None, "<", "text only"]):
        assert doc.nodes == []


_PIECES = st.lists(
    st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='x'>", "</div>", "<ul>", "<li>", "</ul>", "<br>", "text ", "&amp;",
                     "<td>", "<tr>", "<table>", "</table>", "<", ">", "<!-- c -->", "<script>1<2</script>", "'", '"', "</x"]),
    max_size=60,
)


@settings(max_examples=3, deadline=None)
@given(st.lists(_PIECES, min_size=40, max_size=40))
def test_tokens_lose_nothing_and_ranges_nest(spark, pages):
    texts = ["".join(p) for p in pages]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, html string")
    rows = bind(df, t=F.expr(M.raw_tokens("html")), doc=F.expr(M.parsed("html"))).orderBy("i").collect()
    for text, row in zip(texts, rows):
        assert "".join(row.t) == text
        opens = sum(e.kind == "open" for e in row.doc.events)
        assert opens == len(row.doc.nodes) == sum(e.kind == "close" for e in row.doc.events)
        stack = []
        for n in row.doc.nodes:
            while stack and stack[-1].end < n.start:
                stack.pop()
            assert n.parent == (stack[-1].start if stack else -1)
            assert not stack or n.end < stack[-1].end
            stack.append(n)


def test_long_page_is_not_quadratic(spark):
    """100,000 elements in one page: a fold with one growing array would take minutes."""
    page = "<div>" + "<p>x <b>y</b>" * 50_000
    (doc,) = bind(spark.createDataFrame([(page,)], "html string"), doc=F.expr(M.parsed("html"))).select(
        F.size("doc.nodes").alias("n"), F.element_at("doc.nodes", 1)["end"].alias("end")
    ).collect()
    assert (doc.n, doc.end) == (100_001, 300_001)
