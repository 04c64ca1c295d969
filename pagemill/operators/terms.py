"""Categories and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import split_csv
from pagemill.operators.staging import broadcast_if_small, numbered

DEFAULT_CATEGORY = 1


def wanted_terms(config: DataFrame) -> DataFrame:
    """``profile_key, taxonomy, name``: what each profile gives its posts."""
    lists = [("category", "categories"), ("post_tag", "tags")]
    pairs = F.array(*[F.struct(F.lit(t).alias("taxonomy"), split_csv(c).alias("names")) for t, c in lists])
    return (
        config.select("profile_key", F.explode(pairs).alias("p"))
        .select("profile_key", "p.taxonomy", F.explode("p.names").alias("name"))
        .distinct()
    )


def get_or_create_terms(wanted: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(profile terms with ids, terms to add)``. New ids follow the highest
    known one, whatever a name's length."""
    known = terms.groupBy("taxonomy", "name").agg(F.min("term_id").alias("term_id"))
    missing = wanted.select("taxonomy", "name").distinct().join(
        known, ["taxonomy", "name"], "left_anti"
    )
    top = terms.agg(F.coalesce(F.max("term_id"), F.lit(0)).alias("top")).scalar()
    created = numbered(missing, ["taxonomy", "name"], top, "term_id").select("term_id", "name", "taxonomy")
    everything = known.select("term_id", "name", "taxonomy").unionByName(created)
    linked = (
        wanted.join(everything, ["taxonomy", "name"], "left")
        .withColumn(
            "term_id",
            F.coalesce("term_id", F.when(F.col("taxonomy") == "category", F.lit(DEFAULT_CATEGORY))),
        )
        .where(F.col("term_id").isNotNull())
    )
    return linked, created


def assign_terms(posts: DataFrame, profile_terms: DataFrame) -> DataFrame:
    """Every post of a profile gets every term of it."""
    given = profile_terms.select("profile_key", "term_id").distinct()
    return posts.select("profile_key", "post_id").join(broadcast_if_small(given), "profile_key").select(
        "post_id", "term_id"
    )
