"""Run statistics and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALREADY_IMPORTED = "Already imported"


def run_stats(outcomes: DataFrame, keys: list[str] = ["profile_key"]) -> DataFrame:
    """Links dropped as imported count as skipped but not as processed."""
    is_link_skip = F.coalesce(F.col("reason") == ALREADY_IMPORTED, F.lit(False))
    return outcomes.groupBy(*keys).agg(
        F.count_if(~is_link_skip).alias("processed"),
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def item_log(outcomes: DataFrame) -> DataFrame:
    """One line per item that has a title to show."""
    unread = (F.col("status") == "error") & F.col("reason").isin("Failed to fetch", "Failed to extract")
    return outcomes.where(~F.coalesce(unread, F.lit(False))).select("profile_key", "url", "title", "status", "reason")


def reason_summary(outcomes: DataFrame) -> DataFrame:
    """Items per status and reason."""
    return outcomes.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("items"))
