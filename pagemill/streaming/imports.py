"""Unattended, repeated imports as streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagemill import schema as S
from pagemill.functions.dates import is_today
from pagemill.functions.urls import normalize_url
from pagemill.plans.import_run import import_run


def page_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Pages as they arrive in a folder, a trigger's worth cut to ``files_per_batch`` if given."""
    stream = spark.readStream.schema(S.PAGES)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(folder)


def earlier_batches(spark: SparkSession, folder: str, table: str, ddl: str, batch_id: int) -> DataFrame:
    """Rows written by batches before ``batch_id``; a repeated batch does not see itself."""
    try:
        stored = spark.read.schema(f"{ddl}, batch_id bigint").parquet(f"{folder}/{table}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ddl)
    return stored.where(F.col("batch_id") < batch_id).drop("batch_id")


def import_stream(
    pages: DataFrame, profiles: DataFrame, attachments: DataFrame, folder: str, checkpoint: str,
    run_ts: Column, zone: str = "UTC", today_only: bool = True,
) -> DataStreamWriter:
    """Arrivals are added to a page table, and each trigger is one live run over all
    of it: an article is imported once its listing page and itself are there, whichever
    files and triggers brought them. An article that an earlier trigger created or skipped is settled: its page is
    not read again and nothing more is logged of it. One that failed is tried again, and its failure
    is logged once. Batches are delivered at least once, so each is
    written under its own ``batch_id`` and replaced when repeated."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = {
            t: earlier_batches(spark, folder, t, ddl, batch_id)
            for t, ddl in (("posts", S.POSTS), ("post_meta", S.POST_META), ("terms", S.TERMS))
        }
        batch.write.mode("overwrite").parquet(f"{folder}/arrived/batch_id={batch_id}")
        stored = spark.read.schema(f"{S.PAGES}, batch_id bigint").parquet(f"{folder}/arrived")
        pages = stored.where(F.col("batch_id") <= batch_id).drop("batch_id")
        log = earlier_batches(spark, folder, "outcomes", "profile_key string, url string, status string, reason string", batch_id)
        result = import_run(
            profiles, pages, known["posts"], known["post_meta"], known["terms"], attachments,
            run_ts, zone, live=True, today_only=today_only, settled=log.where("status <> 'error'").select("profile_key", "url"),
        )
        failed = log.where("status = 'error'").select("profile_key", "url", "status", "reason").distinct()
        new = result.outcomes.join(failed, ["profile_key", "url", "status", "reason"], "left_anti")
        for table, rows in (result.tables() | {"outcomes": new.select(*result.outcomes.columns)}).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch_id={batch_id}")

    return (
        pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def stream_dedup_url(pages: DataFrame, late: str, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """First arrival of each URL key; the state of a key goes when ``late`` has passed."""
    return (
        pages.withColumn("norm_url", normalize_url(url))
        .withWatermark(at, late)
        .dropDuplicatesWithinWatermark(["norm_url"])
    )


def stream_today(items: DataFrame, run_ts: Column, zone: str) -> DataFrame:
    """S3: a plain predicate on the article date, so that late items stay reportable."""
    return items.withColumn("today", is_today("post_date", run_ts, zone))


def stream_stats(outcomes: DataFrame, at: str, late: str, width: str) -> DataFrame:
    """Counters per tumbling window of run time."""
    return (
        outcomes.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"))
        .agg(
            F.count("*").alias("processed"),
            F.count_if(F.col("status") == "created").alias("created"),
            F.count_if(F.col("status") == "skipped").alias("skipped"),
            F.count_if(F.col("status") == "error").alias("errors"),
        )
        .select(F.col("w.start").alias("window_start"), "processed", "created", "skipped", "errors")
    )
