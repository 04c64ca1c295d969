"""Lead images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import as_col, is_present
from pagemill.functions.urls import is_image_url, url_label
from pagemill.operators.staging import looked_up

# fixed values: media types with a file extension
MIME_EXTENSIONS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif",
    "image/webp": "webp", "image/bmp": "bmp", "image/svg+xml": "svg",
}


def mime_extension(c: Column | str) -> Column:
    """Extension of a media type, null when unknown."""
    pairs = [F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), as_col(c))


def match_attachments(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """``by_source`` has the stored source address, ``by_name`` the file name;
    the lowest id wins. Two equi-joins, each against one row per key."""
    usable = attachments.where(F.col("attachment_id").isNotNull())
    by_source = usable.where(is_present("source_image_url")).groupBy(F.col("source_image_url").alias("image_url")).agg(
        F.min("attachment_id").alias("by_source")
    )
    by_name = (
        usable.withColumn("image_name", F.regexp_extract("guid", r"([^/]+)$", 1))
        .where(F.col("image_name") != "")
        .groupBy("image_name")
        .agg(F.min("attachment_id").alias("by_name"))
    )
    # items without an image are dealt out by whatever else they hold
    named = items.withColumn("image_name", F.nullif(url_label("image_url"), F.lit(""))).withColumn("spread", F.xxhash64(*items.columns))
    sourced = looked_up(named, by_source, ["image_url"], "spread")
    return looked_up(sourced, by_name, ["image_name"], "spread").drop("image_name", "spread")


def featured_image(items: DataFrame, external: bool = True) -> DataFrame:
    """``image_source`` is 'attachment', 'external', 'fallback' or 'none', with the
    attachment id that is shown. Without ``external`` an address that is not stored
    yet falls back."""
    usable = is_image_url("image_url")
    stored = F.coalesce("by_source", "by_name")
    fallback = F.col("fallback_image_id") > 0
    source = (
        F.when(usable & stored.isNotNull(), F.lit("attachment"))
        .when(usable & F.lit(external), F.lit("external"))
        .when(fallback, F.lit("fallback"))
        .otherwise(F.lit("none"))
    )
    return (
        items.withColumn("image_source", source)
        .withColumn(
            "thumbnail_id",
            F.when(F.col("image_source") == "attachment", stored.cast("bigint")).when(
                F.col("image_source") == "fallback", F.col("fallback_image_id").cast("bigint")
            ),
        )
        .withColumn("used_fallback", F.col("image_source") == "fallback")
    )
