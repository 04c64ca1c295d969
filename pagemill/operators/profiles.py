"""Profiles as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill import schema as S
from pagemill.functions.content import compiled_rules
from pagemill.functions.selectors import compiled, is_valid
from pagemill.functions.text import is_present, trim_text, split_lines, strip_tags, to_int
from pagemill.functions.urls import ascii_lower, strip_trailing_slashes


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def profile_defaults(df: DataFrame, defaults: dict[str, str] = S.PROFILE_DEFAULTS) -> DataFrame:
    """B1: every field present, missing ones filled."""
    keep = ["profile_key"] if "profile_key" in df.columns else []
    return df.select(*keep, *[F.coalesce(_field(df, f), F.lit(d)).alias(f) for f, d in defaults.items()])


def slug(name: Column | str) -> Column:
    """Lower case, letters, digits, ``_`` and ``-`` only."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(ascii_lower(name), r"[^a-z0-9_-]", "")


def profile_key(name: Column | str, epoch: Column) -> Column:
    """Slug of the name, or ``profile-<epoch>`` when nothing of it is left."""
    return F.when(is_present(slug(name)), slug(name)).otherwise(
        F.concat(F.lit("profile-"), epoch.cast("bigint").cast("string"))
    )


def _one_of(name: str, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(F.lit(default))


def profile_sanitize(df: DataFrame) -> DataFrame:
    """B2: numbers into their ranges, unknown choices to their defaults."""
    filled = profile_defaults(df)
    frequency = F.least(F.lit(24), F.greatest(F.lit(1), to_int("cron_frequency")))
    changed = {
        "profile_name": trim_text(strip_tags("profile_name")),
        "post_type": slug("post_type"),
        "start_page": F.greatest(F.lit(1), to_int("start_page")),
        "max_pages": F.greatest(F.lit(1), to_int("max_pages")),
        "posts_per_batch": to_int("posts_per_batch"),
        "fallback_image_id": F.greatest(F.lit(0), to_int("fallback_image_id")),
        "post_status": _one_of("post_status", S.POST_STATUSES, "publish"),
        "content_filter_mode": _one_of("content_filter_mode", S.FILTER_MODES, "exclude"),
        "cron_enabled": F.when(is_present("cron_enabled"), F.lit("1")).otherwise(F.lit("0")),
        "cron_frequency": frequency,
        "cron_period": _one_of("cron_period", S.PERIODS, "day"),
    }
    return filled.withColumns({k: v.cast("string") for k, v in changed.items()})


def profile_effective(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Typed settings with compiled selectors, one row per profile."""
    p = profile_defaults(df, S.LOAD_DEFAULTS)
    numbers = {
        "start_page": F.greatest(F.lit(1), to_int("start_page")),
        "max_pages": F.greatest(F.lit(1), to_int("max_pages")),
        "posts_per_batch": to_int("posts_per_batch"),
        "fallback_image_id": to_int("fallback_image_id"),
    }
    typed = p.withColumns(
        {
            **numbers,
            "source_url": strip_trailing_slashes("source_url"),
            "include_lines": split_lines("include_xpaths"),
            "remove_lines": split_lines("remove_xpaths"),
            "content_gate_values": split_lines("content_gate_values"),
        }
    )
    if overrides is not None:
        typed = apply_overrides(typed, overrides)
    names = ("listing", "title", "content", "date", "excerpt", "image")
    return typed.withColumns(
        {f"{n}_selector": F.expr(compiled(f"{n}_xpath")) for n in names}
        | {
            "gate_selector": F.expr(compiled("content_gate_xpath")),
            "gate_selector_set": is_present("content_gate_xpath"),
            "excerpt_selector_set": is_present("excerpt_xpath"),
            "include_rules": F.expr(compiled_rules("include_lines")),
            "remove_rules": F.expr(f"transform(remove_lines, _line -> {compiled('_line')})"),
        }
    )


def apply_overrides(config: DataFrame, overrides: DataFrame) -> DataFrame:
    """Start page, pages, batch and status given for one run."""
    o = overrides.select(
        "profile_key",
        F.greatest(F.lit(1), to_int("start_page")).alias("_start"),
        F.greatest(F.lit(1), to_int("max_pages")).alias("_pages"),
        to_int("posts_per_batch").alias("_batch"),
        F.col("status").alias("_status"),
        *[F.col(c).isNotNull().alias(f"_has_{c}") for c in ("start_page", "max_pages", "posts_per_batch")],
    )
    return (
        config.join(o, "profile_key", "left")
        .withColumn("start_page", F.when(F.col("_has_start_page"), F.col("_start")).otherwise(F.col("start_page")))
        .withColumn("max_pages", F.when(F.col("_has_max_pages"), F.col("_pages")).otherwise(F.col("max_pages")))
        .withColumn(
            "posts_per_batch",
            F.when(F.col("_has_posts_per_batch"), F.col("_batch")).otherwise(F.col("posts_per_batch")),
        )
        .withColumn("post_status", F.coalesce("_status", "post_status"))
        .select(*config.columns)
    )


def profile_report(df: DataFrame) -> DataFrame:
    """Per profile and shown field its value and whether it is empty; ``complete``
    when name and source are there."""
    filled = df.select(
        "profile_key", *[F.coalesce(_field(df, f), F.lit("")).alias(f) for f in S.REPORT_FIELDS]
    ).withColumn("complete", is_present("profile_name") & is_present("source_url"))
    return filled.unpivot(["profile_key", "complete"], list(S.REPORT_FIELDS), "field", "value").withColumn(
        "is_empty", ~is_present("value")
    )


def validate_profiles(df: DataFrame, required: tuple[str, ...] = S.REQUIRED_FIELDS) -> DataFrame:
    """Adds ``errors``, empty for a profile that can run. Missing fields, a wrong
    status, and selectors that cannot be read where a run would stop on them."""
    missing = [F.when(~is_present(_field(df, f)), F.lit(f"missing {f}")) for f in required]
    status = F.coalesce(_field(df, "post_status"), F.lit("publish"))
    bad_status = F.when(~status.isin(*S.POST_STATUSES), F.lit("bad post_status"))
    unreadable = [
        F.when(is_present(_field(df, f)) & ~F.expr(is_valid(f"cast({f} as string)")), F.lit(f"bad {f}"))
        for f in ("listing_xpath", "title_xpath", "content_xpath", "excerpt_xpath")
        if f in df.columns
    ]
    return df.withColumn("errors", F.array_compact(F.array(*missing, bad_status, *unreadable)))


def list_profiles(df: DataFrame) -> DataFrame:
    """B10."""
    return df.select(
        "profile_key", "profile_name", "source_url", "post_type",
        F.concat(F.lit("run --profile="), "profile_key").alias("command"),
    )


def apply_profile_changes(profiles: DataFrame, changes: DataFrame, epoch: Column) -> DataFrame:
    """One batch of ``seq, op, profile_key, profile`` on the profile table.

    ``upsert`` writes the sanitised profile under the slug of its name and drops the
    edited key only when that was a temporary ``new-`` key; ``copy`` adds a second
    profile; ``delete`` drops one; ``purge`` drops rows without a usable name. The
    last change of a key wins; copies are taken from the table before the batch.
    Rows no change names stay as stored, absent fields too. Keys made from the
    time are numbered from the second in a batch on, so that none is lost.
    """
    fields = list(S.PROFILE_DEFAULTS)
    base = profiles.select("profile_key", *[_field(profiles, f).alias(f) for f in fields])
    turn = F.row_number().over(Window.partitionBy("profile_key", "_made").orderBy("seq"))

    def told_apart(df: DataFrame, made: Column) -> DataFrame:
        numbered = df.withColumn("_made", made).withColumn("_turn", turn)
        again = F.col("_made") & (F.col("_turn") > 1)
        key = F.when(again, F.concat("profile_key", F.lit("-"), F.col("_turn").cast("string"))).otherwise(F.col("profile_key"))
        return numbered.withColumn("profile_key", key).drop("_made", "_turn")

    ups = changes.where(F.col("op") == "upsert")
    written = profile_sanitize(
        ups.select(F.concat_ws("\x01", F.col("seq").cast("string"), "profile_key").alias("profile_key"), "profile.*")
    )
    upserts = (
        written.withColumn("seq", F.split_part("profile_key", F.lit("\x01"), F.lit(1)).cast("bigint"))
        .withColumn("edited", F.split_part("profile_key", F.lit("\x01"), F.lit(2)))
        .withColumn("profile_key", profile_key("profile_name", epoch))
    )
    upserts = told_apart(upserts, ~is_present(slug("profile_name")))
    temporary = upserts.where(F.startswith("edited", F.lit("new-")) & (F.col("edited") != F.col("profile_key"))).select(
        "seq", F.col("edited").alias("profile_key")
    )
    deletes = changes.where(F.col("op") == "delete").select("seq", "profile_key").unionByName(temporary)
    copies = (
        changes.where(F.col("op") == "copy").select("seq", "profile_key").join(base, "profile_key")
        .withColumn("profile_name", F.concat(F.coalesce("profile_name", F.lit(S.PROFILE_DEFAULTS["profile_name"])), F.lit(" (Copy)")))
        .withColumn(
            "profile_key",
            slug(F.concat("profile_name", F.lit("-"), epoch.cast("bigint").cast("string"))),
        )
    )
    copies = told_apart(copies, F.lit(True))
    everything = (
        base.withColumn("seq", F.lit(-1).cast("bigint")).withColumn("gone", F.lit(False))
        .unionByName(upserts.drop("edited").withColumn("gone", F.lit(False)))
        .unionByName(copies.withColumn("gone", F.lit(False)))
        .unionByName(deletes.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    )
    latest = Window.partitionBy("profile_key").orderBy(F.desc("seq"))
    state = everything.withColumn("_n", F.row_number().over(latest)).where("_n = 1 and not gone")
    purged = changes.where(F.col("op") == "purge").agg(F.max("seq").alias("purged")).scalar()
    nameless = ~is_present("profile_name") | (F.col("profile_name") == "Unnamed Profile")
    return state.where(~(nameless & F.coalesce(F.col("seq") < purged, F.lit(False)))).select("profile_key", *fields)
