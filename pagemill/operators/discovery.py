"""Finding article links on listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.markup import parsed
from pagemill.functions.selectors import matches
from pagemill.functions.text import bind, trim_text
from pagemill.functions.urls import build_page_url, normalize_url, resolve_link
from pagemill.operators.staging import broadcast_if_small, sum_before

PAGES_PER_BLOCK = 1024


def page_sequence(config: DataFrame) -> DataFrame:
    """One row per listing page a profile may read.

    Page ranges are cut into blocks and spread before they are unrolled, so a profile
    with most of the pages is not unrolled by one task.
    """
    narrow = config.select(
        "profile_key", "source_url", "page_param", "listing_selector",
        F.col("start_page").cast("bigint").alias("start_page"), F.col("max_pages").cast("bigint").alias("max_pages"),
    )
    last = F.least(F.col("start_page") + F.col("max_pages") - 1, F.lit(2**31 - 1))  # page numbers are int
    firsts = F.sequence(F.col("start_page"), last, F.lit(PAGES_PER_BLOCK).cast("bigint"))
    blocks = narrow.withColumn("last_page", last).withColumn("first_page", F.explode(firsts))
    pages = F.sequence("first_page", F.least(F.col("last_page"), F.col("first_page") + PAGES_PER_BLOCK - 1))
    return (
        blocks.repartition("profile_key", "first_page")
        .select("profile_key", "source_url", "page_param", "listing_selector", F.explode(pages).alias("page_no"))
        .withColumn("page_no", F.col("page_no").cast("int"))
        .withColumn("page_url", build_page_url("source_url", "page_param", "page_no"))
    )


def within_crawl(config: DataFrame, pages: DataFrame) -> DataFrame:
    """``config`` with ``max_pages`` no further than one page past what was crawled of the
    profile's site: a run of listing pages without a gap cannot be longer."""
    site = lambda c: F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    crawled = pages.select(site(F.col("url")).alias("_site")).groupBy("_site").agg(F.count("*").alias("_crawled"))
    bound = F.coalesce("_crawled", F.lit(0)) + 1
    return (
        config.withColumn("_site", F.coalesce(site(F.col("source_url")), F.lit("")))
        .join(crawled, "_site", "left")
        .withColumn("max_pages", F.least(F.col("max_pages").cast("bigint"), bound))
        .drop("_site", "_crawled")
    )


def page_links(parsed_pages: DataFrame, selector: str = "listing_selector") -> DataFrame:
    """Column ``links``, absolute and distinct in first-seen order, of pages
    bound as ``doc``."""
    found = F.expr(matches(selector, "doc.events", "doc.nodes"))
    hrefs = F.transform(
        found,
        lambda n: resolve_link(trim_text(F.coalesce(F.try_element_at(n["attrs"], F.lit("href")), F.lit(""))), "source_url"),
    )
    return parsed_pages.withColumn("links", F.array_distinct(F.filter(hrefs, lambda u: u.isNotNull())))


def listing_links(requests: DataFrame, fetched: DataFrame) -> DataFrame:
    """``profile_key, page_no, links`` of every requested page that was fetched.

    Requests are the small side, so they go to the pages and not the other way round:
    no page body is shuffled while the requests pass the size check.
    """
    by_fetch = "fetch" in requests.columns and "fetch" in fetched.columns
    extra = ["fetch"] if by_fetch else []
    wanted = requests.select("profile_key", "page_no", "page_url", "source_url", "listing_selector", *extra)
    same = fetched["url"] == wanted["page_url"]
    if by_fetch:
        same = same & (fetched["fetch"] == wanted["fetch"])
    found = fetched.join(broadcast_if_small(wanted), same).drop("url", "page_url", "fetch")
    doc = bind(found, doc=F.expr(parsed("html"))).drop("html")
    return page_links(doc).select("profile_key", "page_no", "links")


def prefix_until_gap(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """Listing pages before the first one that failed or held no link.

    The gap is a minimum per profile, found with a partial aggregate, not a window.
    """
    keyed = requests.select("profile_key", "page_no")
    all_pages = keyed.join(listing, ["profile_key", "page_no"], "left")
    gap = F.coalesce(F.size("links"), F.lit(0)) <= 0
    first_gap = all_pages.groupBy("profile_key").agg(F.min(F.when(gap, F.col("page_no"))).alias("first_gap"))
    return (
        listing.join(first_gap, "profile_key")
        .where(F.col("first_gap").isNull() | (F.col("page_no") < F.col("first_gap")))
        .drop("first_gap")
    )


def exploded_links(listing: DataFrame) -> DataFrame:
    """``profile_key, page_no, link_pos, url, norm_url``."""
    return listing.select("profile_key", "page_no", F.posexplode("links").alias("link_pos", "url")).withColumn(
        "norm_url", normalize_url("url")
    )


def mark_imported(links: DataFrame, config: DataFrame, imported: DataFrame) -> DataFrame:
    """Adds ``existing_id, existing_title`` and ``is_new``. Profiles
    without a batch limit do not look at what was imported before."""
    settings = config.select("profile_key", "post_type", "posts_per_batch")
    known = imported.groupBy("post_type", "norm_url").agg(
        F.min(F.struct("post_id", "post_title")).alias("existing")
    )
    return (
        links.join(settings, "profile_key")
        .join(known, ["post_type", "norm_url"], "left")
        .withColumn("existing_id", F.col("existing.post_id"))
        .withColumn("existing_title", F.col("existing.post_title"))
        .withColumn("is_new", (F.col("posts_per_batch") <= 0) | F.col("existing_id").isNull())
        .drop("existing")
    )


def fill_to_limit(marked: DataFrame) -> DataFrame:
    """C11: keep whole listing pages while the pages before hold fewer new links than
    the limit; duplicates count."""
    per_page = marked.groupBy("profile_key", "page_no", "posts_per_batch").agg(
        F.count_if("is_new").alias("new_links")
    )
    running = sum_before(
        per_page, ["profile_key"], F.floor(F.col("page_no") / PAGES_PER_BLOCK), ["page_no"],
        F.col("new_links"), "new_before",
    )
    kept = running.where((F.col("posts_per_batch") <= 0) | (F.col("new_before") < F.col("posts_per_batch")))
    return marked.join(kept.select("profile_key", "page_no"), ["profile_key", "page_no"])


def ordered_distinct(links: DataFrame) -> DataFrame:
    """Each URL once per profile, at its first place."""
    return links.groupBy("profile_key", "url").agg(
        F.min(F.struct("page_no", "link_pos")).alias("place")
    ).select("profile_key", "url", "place.page_no", "place.link_pos")


def candidates(kept: DataFrame) -> DataFrame:
    return ordered_distinct(kept.where("is_new"))


def imported_skips(kept: DataFrame) -> DataFrame:
    """Log rows for links dropped because they were imported before."""
    return kept.where(~F.col("is_new")).select(
        "profile_key", "url", "page_no", "link_pos",
        F.col("existing_title").alias("title"), F.lit("skipped").alias("status"),
        F.lit("Already imported").alias("reason"),
    )


def no_content_errors(config: DataFrame, found: DataFrame) -> DataFrame:
    """Profiles without a single candidate."""
    return config.join(found.select("profile_key").distinct(), "profile_key", "left_anti").select(
        "profile_key", F.lit("No content found!").alias("error")
    )
