"""The whole import as one plan: profiles and pages in, posts and a log out."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.content import prefix_css
from pagemill.operators import discovery, extraction, images, outcome, profiles, report, terms
from pagemill.operators.staging import broadcast_if_small, numbered, stage
from pagemill.schema import LOAD_DEFAULTS
from pagemill.sources import tables

_SELECTORS = (
    "source_url", "title_selector", "content_selector", "date_selector", "excerpt_selector",
    "image_selector", "gate_selector", "gate_selector_set", "excerpt_selector_set",
    "content_gate_values", "content_filter_mode", "include_rules", "remove_rules",
)
_NARROW = (
    "profile_key", "url", "page_no", "link_pos", "fetched", "gate", "gate_text", "title", "post_title",
    "post_date", "date_source", "source_timezone", "image_url", "complete", "item_row",
)
# columns of a run's posts that are not stored with them
_OF_RUN = ("profile_key", "thumbnail_id", "image_source", "image_url")


@dataclass
class Imported:
    """Results of a run. Everything but ``outcomes`` is empty in a dry run."""

    outcomes: DataFrame
    errors: DataFrame
    posts: DataFrame | None = None
    post_meta: DataFrame | None = None
    new_terms: DataFrame | None = None
    post_terms: DataFrame | None = None

    def stats(self) -> DataFrame:
        return report.run_stats(self.outcomes)

    def log(self) -> DataFrame:
        return report.item_log(self.outcomes)

    def tables(self) -> dict[str, DataFrame]:
        """What a live run adds to the stored tables."""
        return {
            "posts": self.posts.drop(*_OF_RUN), "post_meta": self.post_meta.unionByName(tables.image_rows(self.posts)),
            "terms": self.new_terms, "post_terms": self.post_terms, "outcomes": self.outcomes,
        }


def discover(config: DataFrame, pages: DataFrame, last: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(candidates, imported skips)``; each listing page is parsed once."""
    requests = discovery.page_sequence(discovery.within_crawl(config, last))
    fetched = tables.fetched_pages(pages.withColumn("fetch", tables.fetch_key(pages)))
    known = requests.join(last.withColumnRenamed("url", "page_url"), "page_url")
    found = discovery.listing_links(known, fetched)
    # a fetch that was stored twice is one page
    listing = stage(found.groupBy("profile_key", "page_no").agg(F.max("links").alias("links")), "listing")
    reached = discovery.prefix_until_gap(requests, listing)
    marked = stage(
        discovery.mark_imported(discovery.exploded_links(reached), config, imported), "links"
    )
    kept = discovery.fill_to_limit(marked)
    return discovery.candidates(kept), discovery.imported_skips(kept)


def extract_items(
    found: DataFrame, config: DataFrame, pages: DataFrame, last: DataFrame, run_ts: Column, zone: str
) -> DataFrame:
    """A2, E: fields of every candidate page as it was last fetched. A fetch stored twice
    gives two rows, told apart by ``item_row``.

    Candidates and settings are joined to the pages, not pages to them: while they
    pass the size check the bodies stay where they were read. Only when they do not
    is the join a shuffle, and on tables from ``write_pages`` not even then.
    """
    settings = broadcast_if_small(config.select("profile_key", *_SELECTORS), 20_000)
    narrow = found.select("profile_key", "url", "page_no", "link_pos").join(last, "url")
    fetched = tables.fetched_pages(pages.withColumn("fetch", tables.fetch_key(pages)))
    bodies = fetched.join(broadcast_if_small(narrow), ["url", "fetch"]).drop("fetch")
    article = extraction.bind_page(bodies.join(settings, "profile_key"))
    return extraction.extract_fields(article, run_ts, zone).withColumns(
        {"fetched": F.lit(True), "item_row": F.monotonically_increasing_id()}
    )


def one_item_each(items: DataFrame) -> DataFrame:
    """One row per profile and URL of written ``items``, chosen by a hash of the fields;
    content stays behind."""
    pick = F.min(F.struct(F.xxhash64("title", "content", "excerpt", "post_date"), "item_row"))["item_row"]
    chosen = items.groupBy("profile_key", "url").agg(pick.alias("item_row"))
    return items.select(*_NARROW).join(chosen, ["profile_key", "url", "item_row"])


def with_failures(found: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates without a page stay in the result as failed fetches."""
    missing = found.join(items.select("profile_key", "url"), ["profile_key", "url"], "left_anti")
    return items.unionByName(
        missing.select("profile_key", "url", "page_no", "link_pos", F.lit(False).alias("fetched")),
        allowMissingColumns=True,
    )


def decide(
    items: DataFrame, config: DataFrame, titles: DataFrame, attachments: DataFrame,
    run_ts: Column, zone: str, live: bool, today_only: bool,
) -> DataFrame:
    """G5-G7, H1-H5 over narrow rows: bodies and content stay behind."""
    limits = config.select("profile_key", "post_type", "post_status", "posts_per_batch", "fallback_image_id")
    narrow = items.select(*_NARROW).join(limits, "profile_key").withColumn(
        "place", F.struct("page_no", "link_pos")
    )
    judged = outcome.base_outcome(outcome.title_exists(narrow, titles), run_ts, zone, today_only)
    if live:
        judged = outcome.first_title_wins(judged, ["profile_key"])
    cut = outcome.batch_cut(stage(judged, "judged"))
    if live:
        across = cut.withColumn("place", F.struct("profile_key", "page_no", "link_pos"))
        cut = outcome.first_title_wins(across, [])
    return images.featured_image(images.match_attachments(cut, attachments))


def import_run(
    profile_table: DataFrame, pages: DataFrame, posts: DataFrame, post_meta: DataFrame,
    term_table: DataFrame, attachments: DataFrame, run_ts: Column, zone: str = "UTC",
    live: bool = False, today_only: bool = False, overrides: DataFrame | None = None, author: int = 1,
    settled: DataFrame | None = None,
) -> Imported:
    """One run over all valid profiles. A dry run decides everything and writes nothing. Links in ``settled``
    (``profile_key, url``) were dealt with before: their pages are not read and they are not logged."""
    checked = profiles.validate_profiles(profiles.profile_defaults(profile_table, LOAD_DEFAULTS))
    config = stage(
        profiles.profile_effective(checked.where(F.size("errors") == 0).drop("errors"), overrides), "config"
    )
    last = stage(tables.last_fetches(pages), "fetches")
    found, skipped = discover(config, pages, last, tables.imported_urls(posts, post_meta))
    if settled is not None:
        found = found.join(settled.distinct().withColumn("done", F.lit(True)), ["profile_key", "url"], "left")
        found = found.withColumn("open", F.col("done").isNull()).drop("done")
        skipped = skipped.join(settled, ["profile_key", "url"], "left_anti")
    everything = stage(found, "candidates")
    found = everything if settled is None else everything.where("open").drop("open")
    extracted = stage(extract_items(found, config, pages, last, run_ts, zone), "items")
    items = with_failures(found, one_item_each(extracted))
    decided = stage(
        decide(items, config, tables.imported_titles(posts), attachments, run_ts, zone, live, today_only), "decided"
    )
    log = ("profile_key", "url", "page_no", "link_pos", "title", "status", "reason",
           "post_date", "date_source", "image_url", "image_source")
    outcomes = decided.select(*log).unionByName(skipped, allowMissingColumns=True)
    failed = checked.where(F.size("errors") > 0).select("profile_key", F.array_join("errors", ", ").alias("error"))
    # a profile whose links were all imported before has no candidates either
    errors = failed.unionByName(discovery.no_content_errors(config, everything))
    if not live:
        return Imported(outcomes, errors)

    top = posts.agg(F.coalesce(F.max("post_id"), F.lit(0)).alias("top")).scalar()
    created = numbered(decided.where(F.col("status") == "created"), ["profile_key", "url"], top, "post_id")
    created = stage(created, "created")
    body = extracted.select("profile_key", "url", "item_row", "content", "excerpt")
    css = broadcast_if_small(config.select("profile_key", "custom_css"), 20_000)
    full = created.join(body, ["profile_key", "url", "item_row"]).join(css, "profile_key")
    new_posts = full.select(
        "post_id", "post_type", "post_title",
        F.expr(prefix_css("custom_css", "content")).alias("post_content"),
        F.col("excerpt").alias("post_excerpt"), "post_status", "post_date",
        F.lit(author).cast("bigint").alias("post_author"), *_OF_RUN,
    )
    linked, new_terms = terms.get_or_create_terms(terms.wanted_terms(config), term_table)
    return Imported(
        outcomes, errors, new_posts, tables.post_meta_rows(created, run_ts, zone), new_terms,
        terms.assign_terms(created, linked),
    )


def import_in_turn(
    keys: list[str], profile_table: DataFrame, pages: DataFrame, posts: DataFrame, post_meta: DataFrame,
    term_table: DataFrame, attachments: DataFrame, run_ts: Column, **options,
) -> list[Imported]:
    """Live runs of the named profiles, one after the other: each sees the posts and
    terms of those before it, as if they had been started in this order."""
    results = []
    for key in keys:
        result = import_run(
            profile_table.where(F.col("profile_key") == key), pages, posts, post_meta, term_table, attachments,
            run_ts, live=True, **options,
        )
        # only what is new is written
        posts = posts.unionByName(stage(result.posts.drop(*_OF_RUN), "posts"))
        post_meta = post_meta.unionByName(stage(result.post_meta, "post_meta"))
        term_table = term_table.unionByName(stage(result.new_terms, "terms"))
        results.append(result)
    return results


def write_run(result: Imported, folder: str, run_id: str | None = None) -> bool:
    """Add a live run to the tables under ``folder``, all or none; read them with ``tables.written``.
    A run written before under the same ``run_id`` is left as it is."""
    return result.posts is not None and tables.write_parts(result.tables(), folder, run_id or uuid4().hex)
