from pyspark.sql import functions as F

from pagemill.functions import dates as D
from pagemill.functions import urls as U



def now():
    return F.lit("2024-03-01 02:00:00").cast("timestamp_ntz")


NY = D.JSONLD_ZONE


def test_dates(values):
    cases = {
        "Jan 5, 2024": "2024-01-05 00:00:00",
        "January 5, 2024 3:04 pm EST": "2024-01-05 15:04:00",
        "Posted Jan 5, 2024 at 15:04": "2024-01-05 15:04:00",
        "Jan 5, 2024 • 12:30 am": "2024-01-05 00:30:00",
        "Sept 3, 2024": "2024-09-03 00:00:00",
        "Feb 31, 2024": "2024-03-02 00:00:00",
        "2024-01-05T10:00:00+02:00": "2024-01-05 03:00:00",
        "2024-07-05T23:30:00Z": "2024-07-05 19:30:00",
        "2024-01-05": "2024-01-04 19:00:00",
        "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 05:00:00",
        "5 January 2024": "2024-01-04 19:00:00",
        "1/5/2024": "2024-01-04 19:00:00",
        "@1704412800": "2024-01-04 19:00:00",
        "yesterday": "2024-02-28 19:00:00",
        "3 days ago": "2024-02-26 21:00:00",
        "Foo 99, 2024": "2024-02-29 21:00:00",
        "Jan 5, 2024 13:05 pm": "2024-02-29 21:00:00",
        "(Jan 5,2024, 9:30)": "2024-01-05 09:30:00",
        "Updated 3 times; May 15, 2024 21:07:30 pm": "2024-05-15 21:07:00",
        "xJan 5, 2024": "2024-02-29 21:00:00",
        "@170441280000": "7371-01-25 19:00:00",
        "next monday": "2024-03-03 19:00:00",
        "last friday 10:00": "2024-02-23 05:00:00",
        "friday": "2024-02-29 19:00:00",
        "-3 days 2 hours": "2024-02-26 23:00:00",
        "3 days 2 hours ago": "2024-02-26 19:00:00",
        "+1 week": "2024-03-07 21:00:00",
        "last month": "2024-01-31 21:00:00",
        "third week noon": "2024-03-22 08:00:00",
        "tomorrow 3:30 pm EST": "2024-03-02 15:30:00",
        "1000000000 seconds ago": "1992-06-22 20:13:20",
        "3 apples": "2024-02-29 21:00:00",
        "next": "2024-02-29 21:00:00",
    }
    assert dict(zip(cases, values(D.date_or_now("x", NY, now()).cast("string"), list(cases)))) == cases


def test_jsonld(values):
    scripts = [
        ['{"datePublished":"2024-01-05T12:00:00Z"}'],
        ['{"dateCreated":"2024-07-05T12:00:00Z"}'],
        ['{"datePublished":null,"dateCreated":"2024-07-05T12:00:00+02:00"}'],
        ['[{"datePublished":"2024-01-01"}]', '{"@graph":[{"datePublished":"2024-01-01"}]}'],
        ["{bad", '{"datePublished":"soon"}', '{"datePublished":"2024-01-05T12:00:00Z"}'],
        [],
        ['{"datePublished":"January 5, 2024"}'],
        ['{"datePublished":"2024-01-05"} and more'], ['{"datePublished":"2024-01-05"}, {}'], [' {"datePublished":"2024-01-05T12:00:00Z"}\n'],
    ]
    assert values(D.jsonld_date("x", now()).cast("string"), scripts, "x array<string>") == [
        "2024-01-05 07:00:00", "2024-07-05 08:00:00", "2024-07-05 06:00:00", None, "2024-01-05 07:00:00", None,
        "2024-01-04 19:00:00", None, None, "2024-01-05 07:00:00",
    ]
    assert values(D.short_zone("x"), ["EST", "EDT", "UTC"]) == ["ET", "ET", "UTC"]


def test_today(values):
    assert values(D.is_today(F.col("x").cast("timestamp_ntz"), now(), NY), ["2024-02-29 23:59:59", "2024-03-01 00:00:00"]) == [True, False]


def test_page_urls(spark):
    rows = [
        ("http://s/l", "page", 1, "http://s/l"), ("http://s/l", "page", 2, "http://s/l?page=2"),
        ("http://s/l?c=1", "p", 3, "http://s/l?c=1&p=3"), ("http://s/l/", "/page/{page}/", 2, "http://s/l/page/2/"),
        ("http://s/l", "?p", 2, "http://s/l??p=2"),
    ]
    df = spark.createDataFrame(rows, "s string, p string, n int, want string")
    got = df.select(U.build_page_url("s", "p", "n").alias("u"), "want").collect()
    assert all(r.u == r.want for r in got)


def test_links(values):
    cases = {
        "/a": "https://h.org/a", "a": "https://h.org/a", "#top": "https://h.org/#top", "?p=2": "https://h.org/?p=2",
        "mailto:x": "https://h.org/mailto:x", "//cdn/x": "https://h.org//cdn/x", "HTTP://x": "https://h.org/HTTP://x",
        "httpfoo": "httpfoo", "": None, "0": None, "/é": "https://h.org/é",
    }
    assert dict(zip(cases, values(U.resolve_link("x", F.lit("https://u:p@h.org:8080/list?x#y")), list(cases)))) == cases


def test_url_keys(values):
    cases = {" HTTP://H.org/A// ": "http://h.org/a", "http://h/?Q=1#F": "http://h/?q=1#f", "http://h/É/": "http://h/É"}
    got = values(U.normalize_url("x"), list(cases))
    assert got == list(cases.values())
    assert values(U.normalize_url("x"), got) == got
    assert values(U.url_label("x"), ["http://h/a/b.html?x", "http://h/a/b//", "http://h"]) == ["b.html", "b", ""]


def test_image_urls(values):
    texts = ["http://h/a.JPG?x=1", "http://h/a.pdf", "http://h/a", "http://h/a.b/c", "data:x", "http://h.png", None, "http://h/x.svg#f"]
    assert values(U.is_image_url("x"), texts) == [True, False, False, False, False, False, False, True]


def test_groups_of_a_date_come_from_one_match(values):
    """a pattern is not matched again for every group, and no cast is tried that throws."""
    read = D.parse_general_date("x", NY, now())
    shown = read._jc.toString()
    assert shown.count("regexp_extract(") <= 1 and shown.count("try_cast") + shown.count("TRY_CAST") <= 8
    cases = {
        "2024-01-05|": None, "2024-01-05 10:00:00.5 -0530": "2024-01-05 10:30:00", "1/5/2024 7:08": "2024-01-05 02:08:00",
        "5-Sept-2024 10:00 PDT": "2024-09-05 13:00:00", "2024/1/5T10:00+05": "2024-01-05 00:00:00", "2024-13-05": None,
        "2024-01-05Z": None, "2024-01-05T10:00Z\n": "2024-01-05 05:00:00", "@": None, "@99999999999999999999": None, None: None,
        "99999999999999999999 days": None, "3 days soon": None,
    }
    assert dict(zip(cases, values(read.cast("string"), list(cases)))) == cases
