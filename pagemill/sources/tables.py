"""Reading and writing the engine's tables (A1-A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill import schema as S
from pagemill.functions.dates import to_zone
from pagemill.functions.text import is_present
from pagemill.functions.urls import normalize_url


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, at least one partition per core. Only a table that splits into
    fewer pieces than there are cores is shuffled; a large one is read as it lies."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fetch_key(pages: DataFrame) -> Column:
    """Orders the fetches of a URL: by time (none comes first), then successful ones last."""
    at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    status = F.coalesce(status.cast("int"), F.lit(0))
    return F.struct(
        F.coalesce(at, F.lit("1970-01-01").cast("timestamp")).alias("at"), (status == 200).alias("ok"), status.alias("status")
    )


def last_fetches(pages: DataFrame) -> DataFrame:
    """``url, fetch``: the last fetch of each URL, also when that one failed. Narrow: no
    body is read."""
    return pages.groupBy("url").agg(F.max(fetch_key(pages)).alias("fetch"))


def latest_fetch(pages: DataFrame) -> DataFrame:
    """One row per URL: the last fetch; of fetches alike in time and status the one whose
    body has the smallest hash."""
    keyed = pages.withColumn("fetch", fetch_key(pages))
    body = F.struct(F.xxhash64("html").alias("hash"), F.monotonically_increasing_id().alias("row"))
    tied = keyed.join(last_fetches(pages), ["url", "fetch"], "left_semi").withColumn("_tie", body)
    first = Window.partitionBy("url").orderBy("_tie")
    return tied.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*pages.columns)


def fetched_pages(pages: DataFrame) -> DataFrame:
    """A1: ``url, html`` of pages that came back with status 200 and a body. Tables
    without a ``status`` column hold successful fetches only. ``fetch`` is kept if given."""
    ok = is_present("html")
    if "status" in pages.columns:
        ok = (F.col("status") == 200) & ok
    return pages.where(ok).select("url", "html", *[c for c in ("fetch",) if c in pages.columns])


def lookup_page(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """A2: ``url`` with the page's ``html``; null means the fetch failed."""
    return urls.join(fetched_pages(pages), "url", "left")


def load_profiles(spark: SparkSession, path: str, fmt: str = "json", key: str | None = None) -> DataFrame:
    """A3: all profiles, or one; an unknown key is an error."""
    profiles = spark.read.schema(S.PROFILES).format(fmt).load(path)
    if key is None:
        return profiles
    chosen = profiles.where(F.col("profile_key") == key)
    if not chosen.take(1):
        raise ValueError(f"Profile '{key}' not found.")
    return chosen


def imported_urls(posts: DataFrame, post_meta: DataFrame) -> DataFrame:
    """A4: ``post_type, norm_url, post_id, post_title`` of whatever was imported, in
    any state."""
    urls = post_meta.where(F.col("meta_key") == "source_url").select("post_id", F.col("meta_value").alias("norm_url"))
    return posts.select("post_id", "post_type", "post_title").join(urls, "post_id").select(
        "post_type", "norm_url", "post_id", "post_title"
    )


def imported_titles(posts: DataFrame) -> DataFrame:
    """A5: ``post_type, post_title`` of posts that are not in the bin."""
    return posts.where(F.col("post_status").isin(*S.TITLE_STATES)).select("post_type", "post_title")


def post_meta_rows(posts: DataFrame, run_ts: Column, zone: str) -> DataFrame:
    """One row per post and metadata key; keys without a value are left out."""
    stamped = posts.select(
        "post_id",
        normalize_url("url").alias("source_url"),
        F.lit("scraper").alias("imported_from"),
        F.date_format(to_zone(run_ts, zone), "yyyy-MM-dd HH:mm:ss").alias("import_date"),
        "source_timezone",
        F.when(F.col("used_fallback"), F.lit("true")).alias("used_fallback_featured_image"),
    )
    keys = [k for k in S.META_KEYS if k != "source_image_url"]
    return stamped.unpivot("post_id", keys, "meta_key", "meta_value").where(F.col("meta_value").isNotNull())


def image_rows(posts: DataFrame) -> DataFrame:
    """The featured image of a post as a metadata row: the attachment shown, or the address of an image that is
    not stored here; posts without one have none."""
    external = F.col("image_source") == "external"
    return posts.where(external | (F.col("thumbnail_id") > 0)).select(
        "post_id", F.when(external, F.lit("source_image_url")).otherwise(F.lit("_thumbnail_id")).alias("meta_key"),
        F.when(external, F.col("image_url")).otherwise(F.col("thumbnail_id").cast("string")).alias("meta_value"),
    )


def meta_wide(post_meta: DataFrame) -> DataFrame:
    """A10: one row per post, one column per known key."""
    return post_meta.groupBy("post_id").pivot("meta_key", list(S.META_KEYS)).agg(F.min("meta_value"))


def export_profiles(profiles: DataFrame) -> DataFrame:
    """One JSON document per profile."""
    names = [c for c in profiles.columns if c != "profile_key"]
    return profiles.select("profile_key", F.to_json(F.struct(*names)).alias("profile_json"))


def write_parts(parts: dict[str, DataFrame], folder: str, run_id: str) -> bool:
    """Add a run's rows to the tables under ``folder``, all or none.

    Every table's rows go to a part of their own, and one row in ``runs``, written last, makes them
    part of the tables (see ``written``). What an interrupted write left is overwritten; a run that is already
    there is not written again (false)."""
    spark = next(iter(parts.values())).sparkSession
    if committed(spark, folder).where(F.col("run") == run_id).take(1):
        return False
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/run={run_id}")
    spark.range(1).select(F.lit(len(parts)).alias("n_tables")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/run={run_id}")
    return True


def _stored(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table in parts by run, without rows where nothing was written yet."""
    try:
        return spark.read.schema(f"{ddl}, run string").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{ddl}, run string")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``run`` of every complete run."""
    return _stored(spark, f"{folder}/runs", "n_tables int").where("n_tables > 0").select("run")


def written(spark: SparkSession, folder: str, table: str, ddl: str) -> DataFrame:
    """Rows of a table that complete runs wrote."""
    return _stored(spark, f"{folder}/{table}", ddl).join(committed(spark, folder), "run", "left_semi").drop("run")


def write_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed by URL: article joins then read bodies without a shuffle."""
    pages.write.bucketBy(buckets, "url").sortBy("url").mode("overwrite").saveAsTable(table)
