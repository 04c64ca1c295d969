"""Discovery, outcome, image, term, profile and schedule operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill import schema as S
from pagemill.operators import discovery, images, outcome, profiles, report, schedule, terms
from pagemill.operators.staging import numbered, sum_before


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- order without one big task -------------------------------------------------


def test_sum_before_equals_brute_force(spark):
    """One key owns most rows; sums must not depend on how the order is cut."""
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(3)) for i in range(4000)]
    df = spark.createDataFrame(data, "k string, pos bigint, v int")
    got = sum_before(df, ["k"], F.floor(F.col("pos") / 100), ["pos"], F.col("v"), "before")
    want, seen = {}, {}
    for k, pos, v in data:
        want[pos] = seen.get(k, 0)
        seen[k] = want[pos] + v
    assert {r.pos: r.before for r in got.collect()} == want


def test_numbers_are_dense_and_repeatable(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(3000)], "name string")
    first = {r.name: r.id for r in numbered(df, ["name"], F.lit(40), "id").collect()}
    again = {r.name: r.id for r in numbered(df.repartition(5), ["name"], F.lit(40), "id").collect()}
    assert sorted(first.values()) == list(range(41, 3041))
    assert first == again


# ---- discovery ------------------------------------------------------------------


def listing(spark, pages):
    df = spark.createDataFrame(pages, "profile_key string, page_no int, links array<string>")
    return df.select("profile_key", "page_no"), df.where(F.col("links").isNotNull())


def test_reading_stops_at_the_first_gap(spark):
    requests, found = listing(spark, [
        ("a", 1, ["x"]), ("a", 2, None), ("a", 3, ["y"]), ("b", 1, ["x"]), ("b", 2, []), ("b", 3, ["z"]),
        ("c", 1, ["x"]), ("c", 2, ["y"]), ("d", 1, None), ("d", 2, ["q"]),
    ])
    assert rows(discovery.prefix_until_gap(requests, found), "profile_key", "page_no") == [("a", 1), ("b", 1), ("c", 1), ("c", 2)]


def marked(spark, limit, pages, known):
    df = spark.createDataFrame([("p", n, links) for n, links in pages], "profile_key string, page_no int, links array<string>")
    config = spark.createDataFrame([("p", "post", limit)], "profile_key string, post_type string, posts_per_batch int")
    imported = spark.createDataFrame(
        [(t, u, i, f"T{i}") for i, (t, u) in enumerate(known)], "post_type string, norm_url string, post_id int, post_title string"
    )
    return discovery.mark_imported(discovery.exploded_links(df), config, imported)


def test_pages_are_kept_whole_until_the_limit(spark):
    pages = [(1, ["http://h/a", "http://h/OLD/"]), (2, ["http://h/a", "http://h/b", "http://h/c"]), (3, ["http://h/d", "http://h/old"])]
    kept = discovery.fill_to_limit(marked(spark, 2, pages, [("post", "http://h/old"), ("post", "http://h/old"), ("page", "http://h/b")]))
    assert rows(discovery.candidates(kept), "page_no", "link_pos", "url") == [
        (1, 0, "http://h/a"), (2, 1, "http://h/b"), (2, 2, "http://h/c"),
    ]
    assert rows(discovery.imported_skips(kept), "url", "title", "reason") == [("http://h/OLD/", "T0", "Already imported")]


def test_duplicates_count_toward_the_limit(spark):
    pages = [(1, ["http://h/a"]), (2, ["http://h/a"]), (3, ["http://h/b"])]
    kept = discovery.fill_to_limit(marked(spark, 2, pages, []))
    assert rows(discovery.candidates(kept), "url") == [("http://h/a",)]


def test_without_limit_nothing_is_looked_up(spark):
    pages = [(1, ["http://h/old", "http://h/a"]), (2, ["http://h/a"])]
    kept = discovery.fill_to_limit(marked(spark, 0, pages, [("post", "http://h/old")]))
    assert rows(discovery.candidates(kept), "url") == [("http://h/a",), ("http://h/old",)]


def test_long_page_range_is_unrolled_in_blocks(spark):
    p = spark.createDataFrame([("k", "http://h", "//a", 3, 5000)], "profile_key string, source_url string, listing_xpath string, start_page int, max_pages int")
    got = discovery.page_sequence(profiles.profile_effective(p)).agg(F.count("*"), F.min("page_no"), F.max("page_no"), F.countDistinct("page_no")).first()
    assert tuple(got) == (5000, 3, 5002, 5000)


# ---- outcomes -------------------------------------------------------------------


def items(spark, data, limit=0):
    """``(profile, position, title, day, fetched, gate, complete)``."""
    df = spark.createDataFrame(
        data, "profile_key string, page_no int, post_title string, day string, fetched boolean, gate string, complete boolean"
    )
    return df.select(
        "*", F.lit(0).alias("link_pos"), F.concat(F.lit("http://h/x/"), "page_no").alias("url"), F.col("post_title").alias("title"),
        F.lit("post").alias("post_type"), F.lit("G").alias("gate_text"), F.col("day").cast("timestamp_ntz").alias("post_date"),
        F.lit(limit).alias("posts_per_batch"),
    ).withColumn("place", F.struct("page_no", "link_pos"))


def now():
    return F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")


TODAY, BEFORE = "2024-01-05 01:00:00", "2024-01-04 01:00:00"
MIXED = [
    ("p", 1, "A", BEFORE, True, "open", True), ("p", 2, "A", TODAY, True, "open", True), ("p", 3, "A", TODAY, True, "open", True),
    ("p", 4, "A", BEFORE, True, "open", True), ("p", 5, "Known", TODAY, True, "open", True), ("p", 6, None, None, False, None, None),
    ("p", 7, "", TODAY, True, "open", False), ("p", 8, None, None, True, "no match", False), ("p", 9, None, None, True, "closed", False),
]


def judged(spark, data, live=True, today=True, limit=0):
    known = spark.createDataFrame([("post", "Known"), ("page", "A")], "post_type string, post_title string")
    base = outcome.base_outcome(outcome.title_exists(items(spark, data, limit), known), now(), "UTC", today)
    return outcome.first_title_wins(base, ["profile_key"]) if live else base


def test_precedence_live(spark):
    assert rows(judged(spark, MIXED), "page_no", "status", F.coalesce("reason", F.lit("-"))) == [
        (1, "skipped", "Not published today"), (2, "created", "-"), (3, "skipped", "Title already exists"),
        (4, "skipped", "Title already exists"), (5, "skipped", "Title already exists"), (6, "error", "Failed to fetch"),
        (7, "error", "Failed to extract"), (8, "skipped", "Content gate: no match"), (9, "skipped", 'Content gate: "G"'),
    ]


def test_dry_run_does_not_block_titles(spark):
    got = rows(judged(spark, MIXED, live=False), "page_no", "status")
    assert [s for _, s in got[:4]] == ["skipped", "created", "created", "skipped"]


def test_batch_cut_counts_errors_but_not_skips(spark):
    data = [("p", i, f"T{i}", TODAY, i not in (2, 5), "closed" if i in (1, 4) else "open", True) for i in range(1, 9)]
    got = outcome.batch_cut(judged(spark, data, limit=3))
    assert [r[0] for r in rows(got, "page_no")] == [1, 2, 3, 4, 5]


def test_statistics_and_log(spark):
    out = judged(spark, MIXED).select("profile_key", "url", "title", "status", "reason")
    skip = spark.createDataFrame([("p", "u", "Old", "skipped", "Already imported")], out.schema)
    both = out.unionByName(skip)
    assert rows(report.run_stats(both), "processed", "created", "skipped", "errors") == [(9, 1, 7, 2)]
    assert report.item_log(both).count() == 8
    assert sum(r.items for r in report.reason_summary(both).collect()) == 10


# ---- images and terms -----------------------------------------------------------


def test_attachments_and_precedence(spark):
    df = spark.createDataFrame(
        [(1, "http://h/a/photo.jpg", 0), (2, "http://h/b/photo.jpg", 9), (3, "http://h/b/other.png", 9), (4, "http://h/doc.pdf", 9),
         (5, None, 0), (6, None, 9), (7, "http://h/hoto.jpg", 0)],
        "i int, image_url string, fallback_image_id int",
    )
    att = spark.createDataFrame(
        [(30, "http://s/photo.jpg", None), (20, "http://s/photo.jpg", ""), (50, "http://s/z.jpg", "http://h/a/photo.jpg"), (60, "http://s/myphoto.jpg", None)],
        S.ATTACHMENTS,
    )
    got = images.featured_image(images.match_attachments(df, att))
    assert rows(got, "i", "image_source", F.coalesce("thumbnail_id", F.lit(0)), "used_fallback") == [
        (1, "attachment", 50, False), (2, "attachment", 20, False), (3, "external", 0, False), (4, "fallback", 9, True),
        (5, "none", 0, False), (6, "fallback", 9, True), (7, "external", 0, False),
    ]
    inside = images.featured_image(images.match_attachments(df, att), external=False)
    assert rows(inside.where("i in (3, 7)"), "i", "image_source") == [(3, "fallback"), (7, "none")]


def test_terms(spark):
    p = spark.createDataFrame([("a", "News,, Tech ", "x"), ("b", "News", "x, y, x")], "profile_key string, categories string, tags string")
    known = spark.createDataFrame([(5, "News", "category"), (9, "x", "category")], S.TERMS)
    linked, created = terms.get_or_create_terms(terms.wanted_terms(p), known)
    assert sorted(r.term_id for r in created.collect()) == [10, 11, 12]
    assert rows(created, "taxonomy", "name") == [("category", "Tech"), ("post_tag", "x"), ("post_tag", "y")]
    posts = spark.createDataFrame([("a", 1), ("b", 2)], "profile_key string, post_id bigint")
    ids = {(r.taxonomy, r.name): r.term_id for r in created.collect()} | {("category", "News"): 5}
    want = [(1, ids["category", "News"]), (1, ids["category", "Tech"]), (1, ids["post_tag", "x"]), (2, 5), (2, ids["post_tag", "x"]), (2, ids["post_tag", "y"])]
    assert rows(terms.assign_terms(posts, linked), "post_id", "term_id") == sorted(want)


# ---- profiles -------------------------------------------------------------------


def profile_table(spark, *given):
    return spark.createDataFrame([{"profile_key": k, **v} for k, v in given], S.PROFILES)


def test_sanitize_edges(spark):
    got = profiles.profile_sanitize(profile_table(spark, ("k", {
        "profile_name": " <b>N</b> ", "start_page": "0", "max_pages": "x", "posts_per_batch": "-5", "fallback_image_id": "-1",
        "post_status": "trash", "content_filter_mode": "both", "cron_enabled": "yes", "cron_frequency": "25", "cron_period": "year",
    }))).first()
    assert (got.profile_name, got.start_page, got.max_pages, got.posts_per_batch, got.fallback_image_id) == ("N", "1", "1", "-5", "0")
    assert (got.post_status, got.content_filter_mode, got.cron_enabled, got.cron_frequency, got.cron_period) == ("publish", "exclude", "1", "24", "day")


def test_profile_changes(spark):
    base = profile_table(spark, ("old", {"profile_name": "Old"}), ("gone", {"profile_name": "Gone"}), ("new-1", {"profile_name": "Draft"}),
                         ("un", {"profile_name": "Unnamed Profile"}))
    body = ", ".join(f"{f} string" for f in S.PROFILE_DEFAULTS)
    changes = spark.createDataFrame(
        [(1, "upsert", "old", {"profile_name": "Renamed"}), (2, "delete", "gone", None), (3, "upsert", "new-1", {"profile_name": "Fresh One"}),
         (4, "copy", "old", None), (5, "purge", "", None), (6, "upsert", "new-2", {"profile_name": "!!"})],
        f"seq bigint, op string, profile_key string, profile struct<{body.replace(' string', ':string')}>",
    )
    got = profiles.apply_profile_changes(base, changes, F.lit(77))
    assert rows(got, "profile_key", "profile_name") == [
        ("freshone", "Fresh One"), ("old", "Old"), ("oldcopy-77", "Old (Copy)"), ("profile-77", "!!"), ("renamed", "Renamed"),
    ]


def test_profile_changes_keep_what_they_do_not_name(spark):
    fields = ", ".join(f"{f} string" for f in S.PROFILE_DEFAULTS if f != "posts_per_batch")
    body = ", ".join(f"{f}:string" for f in S.PROFILE_DEFAULTS)
    stored = [("a", {"profile_name": "A"}), ("b", {"source_url": "http://b"})]
    base = spark.createDataFrame(stored, f"profile_key string, p struct<{fields.replace(' string', ':string')}>").select("profile_key", "p.*")
    changes = spark.createDataFrame(
        [(1, "purge", "", None), (2, "upsert", "new-1", {"profile_name": "?"}), (3, "upsert", "new-2", {"profile_name": "!"}),
         (4, "copy", "a", None), (5, "copy", "a", None)],
        f"seq bigint, op string, profile_key string, profile struct<{body}>",
    )
    got = {r.profile_key: r for r in profiles.apply_profile_changes(base, changes, F.lit(77)).collect()}
    assert sorted(got) == ["a", "acopy-77", "acopy-77-2", "profile-77", "profile-77-2"]
    assert got["a"].posts_per_batch is None and got["a"].source_url is None
    assert {got["profile-77"].profile_name, got["profile-77-2"].profile_name} == {"?", "!"}


def test_no_caps_on_numbers_names_and_axes(spark):
    from pagemill.functions.text import to_int
    from pagemill.operators.staging import own_folder

    numbers = spark.createDataFrame([("9999999999",), ("-99999999999999999999999999999999999999999",), ("12x",), ("",)], "x string")
    assert [r[0] for r in numbers.select(to_int("x")).collect()] == [2**31 - 1, -(2**31), 12, 0]
    p = profile_table(spark, ("far", {"source_url": "http://h/l", "start_page": "2", "max_pages": "2147483647"}))
    pages = spark.createDataFrame([(f"http://h/l?page={i}",) for i in range(5)] + [("http://other/",)], "url string")
    config = discovery.within_crawl(profiles.profile_effective(p), pages)
    assert discovery.page_sequence(config).agg(F.min("page_no"), F.max("page_no")).first() == (2, 7)
    wanted = spark.createDataFrame([("k", "post_tag", "t" * 300)], "profile_key string, taxonomy string, name string")
    linked, created = terms.get_or_create_terms(wanted, spark.createDataFrame([], S.TERMS))
    assert created.count() == linked.count() == 1
    bad = profile_table(spark, ("k", {"source_url": "http://h", "title_xpath": "//h2/following-sibling::p"}))
    assert "bad title_xpath" in profiles.validate_profiles(bad).first().errors
    assert own_folder("local[8]", "a").endswith("pagemill-a")
    with pytest.raises(RuntimeError):
        own_folder("spark://host:7077", "a")


@pytest.mark.parametrize("required,extra", [(S.REQUIRED_FIELDS, ["missing post_type"]), (S.TEST_RUN_FIELDS, [])])
def test_validation(spark, required, extra):
    p = profile_table(spark, ("k", {"source_url": "http://h", "listing_xpath": "//a", "title_xpath": "//h1", "content_xpath": "//div[", "date_xpath": "0"}))
    got = profiles.validate_profiles(p, required).first().errors
    assert got == extra + ["missing date_xpath", "bad content_xpath"]


# ---- schedules ------------------------------------------------------------------


def test_reconcile_and_check(spark):
    on = {"cron_enabled": "1"}
    p = profile_table(
        spark, ("new", {**on, "cron_frequency": "2", "cron_period": "day"}), ("same", {**on, "cron_frequency": "1", "cron_period": "week"}),
        ("changed", {**on, "cron_frequency": "0", "cron_period": "hour"}), ("off", {"cron_enabled": "0", "cron_frequency": "1", "cron_period": "day"}),
        ("never", {"cron_enabled": "0", "cron_frequency": "1", "cron_period": "day"}), ("odd", {**on, "cron_frequency": "25", "cron_period": "year"}),
    )
    hook = schedule.HOOK_PREFIX
    events = spark.createDataFrame(
        [(hook + "same", "every_1_per_week", "2024-01-06 00:00:00"), (hook + "changed", "daily", "2024-01-06 00:00:00"),
         (hook + "off", "daily", "2024-01-06 00:00:00"), (hook + "orphan", "daily", "2024-01-06 00:00:00"), ("other", "daily", "2024-01-06 00:00:00")],
        "hook string, schedule string, t string",
    ).select("hook", "schedule", F.col("t").cast("timestamp_ntz").alias("next_run"))
    plan = schedule.reconcile_schedule(p, events, now())
    assert rows(plan, F.replace("hook", F.lit(hook)), "action", F.coalesce(F.col("next_run").cast("string"), F.lit("-"))) == [
        ("changed", "reschedule", "2024-01-05 13:00:00"), ("new", "create", "2024-01-06 00:00:00"), ("odd", "create", "2024-01-05 13:00:00"),
        ("off", "cancel", "-"), ("orphan", "cancel_orphan", "-"), ("same", "keep", "2024-01-06 00:00:00"),
    ]
    check = schedule.schedule_check(p, events, now())
    assert rows(check, "profile_key", "state") == [("changed", "mismatch"), ("new", "not scheduled"), ("odd", "not scheduled"), ("same", "matches")]
    assert schedule.plugin_events(events).count() == 4
