from pyspark.sql import functions as F

from pagemill.functions import content as C
from pagemill.functions import markup as M
from pagemill.functions import selectors as S
from pagemill.functions.text import bind, split_csv, split_lines, strip_tags, to_int, trim_words

PAGE = """<html><body><article class="c"><h1>T &amp; t</h1><p><b>one<br><p>two</p><div class="ad"><p>ad</p></div><p>three</p></article>
<p>outside</p></body></html>"""


def content(spark, *cases):
    df = spark.createDataFrame(
        [(i, PAGE, s, m, inc, rem) for i, (s, m, inc, rem) in enumerate(cases)],
        "i int, html string, s string, mode string, inc array<string>, rem array<string>",
    )
    doc = bind(
        df, doc=F.expr(M.parsed("html")), c=F.expr(S.compiled("s")), inc=F.expr(C.compiled_rules("inc")),
        rem=F.expr(f"transform(rem, _l -> {S.compiled('_l')})"),
    )
    html = C.content_html("doc.events", "doc.nodes", "c", "mode", "inc", "rem")
    return [r.v for r in doc.orderBy("i").select(F.expr(html).alias("v")).collect()]


def test_exclude(spark):
    assert content(
        spark,
        ("//article", "exclude", [], ["//h1", "//div["]),
        ("//article", "exclude", [], ["//p[1]", "//p[1]"]),
        ("//article", "exclude", [], ["//div", "//div//p", '//p[contains(.,"o")][1]']),
        ("//article", "exclude", [], ["//article"]),
        ("//nope", "exclude", [], []),
    ) == [
        '<article class="c"><p><b>one<br></b></p><p>two</p><div class="ad"><p>ad</p></div><p>three</p></article>',
        '<article class="c"><h1>T &amp; t</h1><div class="ad"></div><p>three</p></article>',
        '<article class="c"><h1>T &amp; t</h1><p>two</p><p>three</p></article>',
        "",
        None,
    ]


def test_include(spark):
    assert content(
        spark,
        ("//article", "include", ["html: <hr>", "//p | <q> | </q>", "//div["], ["//h1"]),
        ("//article", "include", ["//div", '//div[@class="ad"]//p', "//body"], []),
        ("//article", "include", [], ["//p", "//div"]),
        ("//article", "exclude", ["//p"], ["//p", "//div"]),
    ) == [
        "<hr><q><p><b>one<br></b></p></q><q><p>two</p></q><q><p>ad</p></q><q><p>three</p></q>",
        '<div class="ad"><p>ad</p></div><p>ad</p>',
        '<article class="c"><h1>T &amp; t</h1></article>',
        '<article class="c"><h1>T &amp; t</h1></article>',
    ]


def test_clean_content(values):
    cases = {
        "a\r\nb  c": "a b c",
        "x<br><br /><BR>y": "x<br><BR>y",
        "<p class='q'> <br>z<br/> </p>": "<p class='q'>z</p>",
        "<b>x</b> <i>y</i>": "<b>x</b><i>y</i>",
        "<p>1</p>\n<pre>a\n  b</pre> <p>2</p><PRE>c\n</PRE>": "<p>1</p><pre>a\n  b</pre><p>2</p><PRE>c\n</PRE>",
        "": "",
    }
    assert values(C.clean_content("x"), list(cases)) == list(cases.values())


def test_clean_content_reads_texts_once(values):
    """no step goes through whole texts letter by letter."""
    cleaned = C.clean_content("x")
    assert not any(f"{slow}(" in cleaned for slow in ("translate", "trim", "lower"))
    cases = {
        " \t<br> \n<b>a\tb\n\n</b>\r": " <br><b>a\tb </b> ",
        "\x0b": "\x0b", " \n ": " ", "< \n <": "<<", "a< \nb": "a< b",
        "<!-- <pre>\n</pre> --> <Br\n/>\n<bR>\t<BR >c": "<!-- <pre> </pre> --><br><BR >c",
        "<script>a\n<b </script> <pre>\n<PRE>\n</pre>\n</pre>": "<script>a <b </script><pre>\n<PRE>\n</pre></pre>",
        "<P x> <br> <br>d<br><br></P>": "<P x>d</P>", None: None,
    }
    assert dict(zip(cases, values(cleaned, list(cases)))) == cases


def test_include_rules(values):
    (rules,) = values(C.parse_include_rules("x"), [["html:  <hr> ", "//p | <b> | </b>", "//q|<i>", "//z"]], "x array<string>")
    assert [tuple(r) for r in rules] == [
        ("raw", "", "<hr>", ""), ("select", "//p", "<b>", "</b>"), ("select", "//q", "<i>", ""), ("select", "//z", "", ""),
    ]


def test_allow_tags(values):
    cases = {
        '<div onclick="x" class="a">hi<script>x</script><br/><IMG src=a alt="q"><u>u</u></div>':
            '<div class="a">hi<br /><img src="a" alt="q">u</div>',
        "1 < 2 <!-- c --><p style='x' title=t>": '1 < 2 <p style="x">',
    }
    # the text of a dropped script stays, as of any other dropped tag
    got = values(C.allow_tags("x"), list(cases))
    assert got[1] == "1 < 2 " + '<p style="x">'
    assert got[0].startswith('<div class="a">hi') and "onclick" not in got[0] and "<u>" not in got[0]


def test_prefix_css(values):
    assert values(C.prefix_css("x", "'<p>'"), ["a {\n  b }\n", "", "0", None]) == ["<style>a { b }</style>\n<p>", "<p>", "<p>", "<p>"]


def test_text_helpers(values):
    words = " ".join(str(i) for i in range(56))
    assert values(trim_words("x"), [words, words[:-3], " <b>a</b>\n b ", None]) == [
        " ".join(str(i) for i in range(55)) + "...", words[:-3], "a b", None,
    ]
    assert values(strip_tags("x"), [" <b>A</b> & 1 < 2<style>x</style>"]) == ["A & 1 < 2"]
    assert values(split_lines("x"), [" a \n0\n\nb\r\n", None]) == [["a", "b"], []]
    assert values(split_csv("x"), ["News,, Tech ,"]) == [["News", "Tech"]]
    assert values(to_int("x"), [" 12abc", "-3", "x", None, "99999999999"]) == [12, -3, 0, 0, 2147483647]
