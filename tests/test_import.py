"""Whole runs, batch and streamed, on a small crawl."""

import tempfile

import pytest
from pyspark.sql import functions as F

from pagemill import schema as S
from pagemill.plans.import_run import import_in_turn, import_run, write_run
from pagemill.sources import tables
from pagemill.streaming import imports


def now():
    return F.lit("2024-01-05 20:00:00").cast("timestamp_ntz")


def article(title, date="", body="<p>x</p>", extra=""):
    return f"<html><body><h1>{title}</h1><time>{date}</time>{extra}<article>{body}</article></body></html>"


JSONLD = '<script type="application/ld+json">{"datePublished":"2024-01-05T12:00:00Z"}</script>'
CRAWL = [
    ("http://s.com", 200, '<a href="/a">A</a><a href="/b/">B</a><a href="/c">C</a><a href="/a">again</a>'),
    ("http://s.com?page=2", 200, '<a href="/d">D</a><a href="/a">A</a><a href="/e">E</a>'),
    ("http://s.com?page=3", 404, '<a href="/never">N</a>'),
    ("http://s.com?page=4", 200, '<a href="/never">N</a>'),
    ("http://s.com/a", 200, article("T1", "Jan 5, 2024", '<p>x</p><img src="/i/p.jpg">')),
    ("http://s.com/b/", 200, article("T1")),
    ("http://s.com/c", 200, article("<i>T3</i>", "-", "<p>a</p>  <p>b</p><p class='ad'>ad</p>", JSONLD)),
    ("http://s.com/d", 500, "x"),
    ("http://s.com/e", 200, article("")),
    ("http://t.com", 200, '<a href="http://s.com/c">C</a><a href="/f">F</a>'),
    ("http://t.com/f", 200, article("T6", "Jan 4, 2024")),
]
BASE = dict(listing_xpath="//a", title_xpath="//h1", content_xpath="//article", date_xpath="//time", max_pages="9",
            remove_xpaths='//p[@class="ad"]', categories="News", custom_css="p { }", fallback_image_id="4")
PROFILES = [
    dict(profile_key="s", profile_name="S", source_url="http://s.com/", posts_per_batch="0", **BASE),
    dict(profile_key="t", profile_name="T", source_url="http://t.com/", posts_per_batch="5", **BASE),
    dict(profile_key="u", profile_name="U", source_url="http://u.com/", posts_per_batch="5", **BASE),
    dict(profile_key="v", profile_name="V", source_url="http://v.com/", post_status="bad", **BASE),
]


@pytest.fixture(scope="module")
def world(spark):
    return dict(
        pages=spark.createDataFrame(CRAWL, "url string, status int, html string"),
        profiles=spark.createDataFrame(PROFILES, S.PROFILES),
        posts=spark.createDataFrame([(7, "post", "Old", "", "", "publish", None, 1)], S.POSTS),
        meta=spark.createDataFrame([(7, "source_url", "http://s.com/c")], S.POST_META),
        terms=spark.createDataFrame([(3, "News", "category")], S.TERMS),
        attachments=spark.createDataFrame([(50, "http://x/up/p.jpg", "")], S.ATTACHMENTS),
    )


def run(w, **options):
    return import_run(w["profiles"], w["pages"], w["posts"], w["meta"], w["terms"], w["attachments"], now(), **options)


def log(result):
    return {(r.profile_key, r.url): (r.status, r.reason) for r in result.outcomes.collect()}


def test_live(world):
    result = run(world, live=True)
    assert log(result) == {
        ("s", "http://s.com/a"): ("created", None),
        ("s", "http://s.com/b/"): ("skipped", "Title already exists"),
        ("s", "http://s.com/c"): ("created", None),
        ("s", "http://s.com/d"): ("error", "Failed to fetch"),
        ("s", "http://s.com/e"): ("error", "Failed to extract"),
        ("t", "http://s.com/c"): ("skipped", "Already imported"),
        ("t", "http://t.com/f"): ("created", None),
    }
    assert {(r.profile_key, r.error) for r in result.errors.collect()} == {("u", "No content found!"), ("v", "bad post_status")}
    posts = {r.post_title: r for r in result.posts.collect()}
    assert sorted(r.post_id for r in posts.values()) == [8, 9, 10]
    t3 = posts["T3"]
    assert t3.post_content == "<style>p { }</style>\n<article><p>a</p><p>b</p></article>"
    assert (str(t3.post_date), t3.thumbnail_id, posts["T1"].thumbnail_id) == ("2024-01-05 07:00:00", 4, 50)
    meta = {(r.post_id, r.meta_key): r.meta_value for r in result.post_meta.collect()}
    assert meta[t3.post_id, "source_url"] == "http://s.com/c"
    assert meta[t3.post_id, "source_timezone"] == "ET"
    assert meta[t3.post_id, "used_fallback_featured_image"] == "true"
    assert (posts["T1"].post_id, "source_timezone") not in meta
    assert result.new_terms.count() == 0
    assert {r.term_id for r in result.post_terms.collect()} == {3}
    stats = {r.profile_key: (r.processed, r.created, r.skipped, r.errors) for r in result.stats().collect()}
    assert stats == {"s": (5, 2, 1, 2), "t": (1, 1, 1, 0)}


def test_dry_and_today(world):
    result = run(world, today_only=True)
    got = log(result)
    assert got["s", "http://s.com/b/"] == ("created", None)
    assert got["t", "http://t.com/f"] == ("skipped", "Not published today")
    assert result.posts is None


def test_overrides_and_second_run(spark, world):
    """A limit of one takes one item; the next run goes on after it."""
    only = spark.createDataFrame([("s", None, None, "1", "draft")], "profile_key string, start_page string, max_pages string, posts_per_batch string, status string")
    folder = tempfile.mkdtemp(prefix="pagemill-test-")
    tables.write_parts({"posts": world["posts"], "post_meta": world["meta"], "terms": world["terms"]}, folder, "before")
    first = run(world, live=True, overrides=only)
    assert [k for k, v in log(first).items() if v[0] == "created" and k[0] == "s"] == [("s", "http://s.com/a")]
    assert write_run(first, folder, "one") and not write_run(first, folder, "one")
    # what an interrupted write left behind is not part of the tables
    first.posts.select("post_id").write.parquet(f"{folder}/posts/run=two")
    posts = tables.written(spark, folder, "posts", S.POSTS)
    assert {r.post_title: r.post_status for r in posts.collect()} == {"Old": "publish", "T1": "draft", "T6": "publish"}
    meta = tables.written(spark, folder, "post_meta", S.POST_META)
    again = log(run({**world, "posts": posts, "meta": meta}, live=True, overrides=only))
    assert again["s", "http://s.com/a"] == ("skipped", "Already imported")
    assert again["s", "http://s.com/b/"] == ("skipped", "Title already exists")
    # one new link on page 1 fills the limit, so page 2 is not read
    assert ("s", "http://s.com/d") not in again


def test_profiles_in_turn(spark, world):
    """The later profile finds what the earlier one imported."""
    first, second = import_in_turn(
        ["s", "t"], world["profiles"], world["pages"], spark.createDataFrame([], S.POSTS), spark.createDataFrame([], S.POST_META),
        world["terms"], world["attachments"], now(),
    )
    assert log(first)["s", "http://s.com/c"] == ("created", None)
    assert log(second) == {
        ("t", "http://s.com/c"): ("skipped", "Already imported"), ("t", "http://t.com/f"): ("created", None),
    }
    ids = [r.post_id for result in (first, second) for r in result.posts.collect()]
    assert sorted(ids) == [1, 2, 3]


def test_last_fetch_counts(spark):
    df = spark.createDataFrame(
        [("u", 200, "a", "2024-01-01"), ("u", 404, None, "2024-01-02"), ("v", 500, "", None), ("v", 200, "b", "2023-01-01")],
        "url string, status int, html string, t string",
    ).select("url", "status", "html", F.col("t").cast("timestamp").alias("fetched_at"))
    assert {(r.url, r.status) for r in tables.latest_fetch(df).collect()} == {("u", 404), ("v", 200)}
    assert [r.url for r in tables.fetched_pages(tables.latest_fetch(df)).collect()] == ["v"]


def test_stream_in_two_triggers_equals_two_runs(spark, world):
    """Pages arrive in two files; the stream sees its own earlier posts and nothing twice."""
    folder = tempfile.mkdtemp(prefix="pagemill-test-")
    arrived = world["pages"].withColumn("fetched_at", F.lit(None).cast("timestamp"))
    where = F.col("url").contains("t.com")

    def trigger():
        stream = imports.import_stream(
            imports.page_stream(spark, f"{folder}/pages"), world["profiles"], world["attachments"], f"{folder}/out",
            f"{folder}/state", now(), today_only=False,
        ).start()
        stream.awaitTermination()

    arrived.where(~where).coalesce(1).write.parquet(f"{folder}/pages", mode="append")
    trigger()
    arrived.where(where).unionByName(arrived.where(F.col("url") == "http://s.com/c")).coalesce(1).write.parquet(f"{folder}/pages", mode="append")
    trigger()
    posts = spark.read.parquet(f"{folder}/out/posts").collect()
    assert sorted((r.post_title, r.batch_id) for r in posts) == [("T1", 0), ("T3", 0), ("T6", 1)]
    assert sorted(r.post_id for r in posts) == [1, 2, 3]
    trigger()
    assert spark.read.parquet(f"{folder}/out/posts").count() == 3


def test_listing_and_articles_in_different_triggers(spark, world):
    """However the files are cut, what is imported in the end is the same."""
    folder = tempfile.mkdtemp(prefix="pagemill-test-")
    arrived = world["pages"].withColumn("fetched_at", F.lit(None).cast("timestamp"))
    listing = F.col("url").isin("http://s.com", "http://t.com") | F.contains("url", F.lit("?page"))
    for some in (listing, ~listing):
        arrived.where(some).coalesce(1).write.parquet(f"{folder}/pages", mode="append")
    imports.import_stream(
        imports.page_stream(spark, f"{folder}/pages", 1), world["profiles"], world["attachments"], f"{folder}/out",
        f"{folder}/state", now(), today_only=False,
    ).start().awaitTermination()
    posts = spark.read.parquet(f"{folder}/out/posts").collect()
    assert sorted(r.post_title for r in posts) == ["T1", "T3", "T6"]
    assert sorted(r.post_id for r in posts) == [1, 2, 3]


def test_pages_fetched_again(spark, world):
    """Repeats, old failures and stale bodies change nothing."""
    stamp = lambda t: F.lit(t).cast("timestamp")
    pages = world["pages"].withColumn("fetched_at", stamp("2024-01-03"))
    stale = pages.withColumn("html", F.lit("<h1>old</h1>")).withColumn("fetched_at", stamp("2024-01-01"))
    failed = pages.withColumn("status", F.lit(500)).withColumn("fetched_at", stamp("2024-01-02"))
    again = pages.unionByName(pages).unionByName(stale).unionByName(failed)
    rest = ("posts", "meta", "terms", "attachments")
    once, twice = (
        import_run(world["profiles"], p, *[world[k] for k in rest], now(), live=True) for p in (pages, again)
    )
    key = lambda run: sorted((r.post_id, r.post_title) for r in run.posts.collect())
    assert key(once) == key(twice) and once.outcomes.count() == twice.outcomes.count()


def test_known_page_bodies_are_not_shuffled(spark, world):
    """Listing and article joins move URLs to the pages, never bodies."""
    from pagemill.operators import discovery, profiles

    config = profiles.profile_effective(world["profiles"])
    requests = discovery.page_sequence(config)
    plan = discovery.listing_links(requests, tables.fetched_pages(world["pages"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_profiles_from_file(spark, world):
    folder = tempfile.mkdtemp(prefix="pagemill-test-") + "/profiles"
    world["profiles"].write.json(folder)
    assert tables.load_profiles(spark, folder).count() == 4
    assert tables.load_profiles(spark, folder, key="t").first().source_url == "http://t.com/"
    with pytest.raises(ValueError):
        tables.load_profiles(spark, folder, key="nope")


def test_bucketed_pages_join_without_moving_bodies(spark, world):
    tables.write_pages(world["pages"], "pagemill_pages", 4)
    try:
        wanted = world["pages"].select("url").repartition(4, "url")
        found = tables.lookup_page(wanted.hint("merge"), spark.table("pagemill_pages"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        # the one exchange is the repartition of the wanted URLs
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1
        assert found.where("html is not null").count() == 9
    finally:
        spark.sql("DROP TABLE pagemill_pages")
