"""What becomes of each item (H1-H6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.dates import is_today
from pagemill.functions.urls import url_label
from pagemill.operators.discovery import PAGES_PER_BLOCK
from pagemill.operators.staging import looked_up, sum_before


def title_exists(items: DataFrame, imported_titles: DataFrame) -> DataFrame:
    """H1: flag ``title_known``; titles are compared as stored."""
    known = imported_titles.select("post_type", "post_title").distinct().withColumn("_known", F.lit(True))
    return (
        looked_up(items, known, ["post_type", "post_title"], "url")
        .withColumn("title_known", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def base_outcome(items: DataFrame, run_ts: Column, zone: str, today_only: bool = False) -> DataFrame:
    """H3, H4 without titles met in the same run: ``status``, ``reason``."""
    late = F.lit(today_only) & ~is_today("post_date", run_ts, zone)
    closed = F.concat(F.lit('Content gate: "'), F.col("gate_text"), F.lit('"'))
    steps = [
        (~F.col("fetched"), "error", F.lit("Failed to fetch")),
        (F.col("gate") == "no match", "skipped", F.lit("Content gate: no match")),
        (F.col("gate") == "closed", "skipped", closed),
        (~F.col("complete"), "error", F.lit("Failed to extract")),
        (F.col("title_known"), "skipped", F.lit("Title already exists")),
        (late, "skipped", F.lit("Not published today")),
    ]
    status, reason = F, F
    for when, state, why in steps:
        status, reason = status.when(when, F.lit(state)), reason.when(when, why)
    gated = F.col("fetched") & (F.col("gate") != "open")
    return items.select(
        "*",
        status.otherwise(F.lit("created")).alias("status"),
        reason.otherwise(F.lit(None).cast("string")).alias("reason"),
    ).withColumn("title", F.when(gated, url_label("url")).otherwise(F.col("title")))


def first_title_wins(items: DataFrame, scope: list[str]) -> DataFrame:
    """H2: inside ``scope`` a created title blocks the same title at later places.

    The first place is a minimum per title, joined back: a title that a third of all
    items share is reduced before the shuffle, and the join may be split by AQE. Only titles that two
    items contest go back.
    """
    keys = [*scope, "post_type", "post_title"]
    firsts = (
        items.where("post_title is not null").groupBy(*keys)
        .agg(F.min(F.when(F.col("status") == "created", F.col("place"))).alias("first_place"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("first_place").isNotNull()).drop("_n")
    )
    blocked = (
        F.coalesce(F.col("first_place") < F.col("place"), F.lit(False))
        & F.col("status").isin("created", "skipped")
        & ((F.col("status") == "created") | (F.col("reason") == "Not published today"))
    )
    return (
        looked_up(items, firsts, keys, "url")
        .withColumn("_blocked", blocked)
        .withColumn("status", F.when(F.col("_blocked"), F.lit("skipped")).otherwise(F.col("status")))
        .withColumn("reason", F.when(F.col("_blocked"), F.lit("Title already exists")).otherwise(F.col("reason")))
        .drop("_blocked", "first_place")
    )


def batch_cut(items: DataFrame) -> DataFrame:
    """H5: items up to the batch limit; created items and errors count, skips do not."""
    counted = sum_before(
        items, ["profile_key"], F.floor(F.col("page_no") / PAGES_PER_BLOCK), ["page_no", "link_pos"],
        F.col("status").isin("created", "error").cast("int"), "counted_before",
    )
    return counted.where(
        (F.col("posts_per_batch") <= 0) | (F.col("counted_before") < F.col("posts_per_batch"))
    ).drop("counted_before")
