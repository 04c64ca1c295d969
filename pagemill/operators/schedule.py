"""Run schedules (K1-K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import schema as S
from pagemill.functions.text import is_present, to_int

# fixed values: seconds per period, fallback interval; hooks carry the profile key after a prefix
PERIOD_SECONDS = {"hour": 3600, "day": 86400, "week": 604800}
HOOK_PREFIX = "import_profile_"
DAY_SECONDS = 86400
MAX_FREQUENCY = 24


def interval_table(spark: SparkSession) -> DataFrame:
    """K1: every supported interval."""
    periods = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(s).alias("seconds")) for p, s in PERIOD_SECONDS.items()])
    return (
        spark.range(1, MAX_FREQUENCY + 1)
        .select(F.col("id").cast("int").alias("frequency"), F.inline(periods))
        .select(
            interval_key("frequency", "period").alias("interval_key"),
            F.floor(F.col("seconds") / F.col("frequency")).cast("int").alias("interval_seconds"),
            F.concat(F.col("frequency").cast("string"), F.lit(" time(s) per "), "period").alias("display"),
        )
    )


def interval_key(frequency: Column | str, period: Column | str) -> Column:
    frequency = F.col(frequency) if isinstance(frequency, str) else frequency
    period = F.col(period) if isinstance(period, str) else period
    return F.concat(F.lit("every_"), frequency.cast("string"), F.lit("_per_"), period)


def profile_interval(profiles: DataFrame) -> DataFrame:
    """K2: adds ``enabled, hook, interval_key`` with frequency and period clamped."""
    frequency = F.least(F.lit(MAX_FREQUENCY), F.greatest(F.lit(1), to_int(F.coalesce("cron_frequency", F.lit("1")))))
    period = F.when(F.col("cron_period").isin(*S.PERIODS), F.col("cron_period")).otherwise(F.lit("day"))
    return (
        profiles.withColumn("enabled", F.coalesce(F.col("cron_enabled") == "1", F.lit(False)))
        .withColumn("hook", F.concat(F.lit(HOOK_PREFIX), "profile_key"))
        .withColumn("interval_key", interval_key(frequency, period))
    )


def first_run(planned: DataFrame, now: Column) -> DataFrame:
    """K3: one interval from now; an unknown key means a day."""
    table = interval_table(planned.sparkSession).select("interval_key", "interval_seconds")
    return (
        # 72 rows
        planned.join(F.broadcast(table), "interval_key", "left")
        .withColumn("interval_seconds", F.coalesce("interval_seconds", F.lit(DAY_SECONDS)))
        .withColumn(
            "first_run",
            now.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("interval_seconds").cast("decimal(18,6)")),
        )
    )


def plugin_events(events: DataFrame) -> DataFrame:
    """K5: distinct hooks of ours."""
    return events.where(F.startswith("hook", F.lit(HOOK_PREFIX))).select("hook").distinct()


def _next_events(events: DataFrame) -> DataFrame:
    """Per hook the event that is due first."""
    return (
        events.where(F.startswith("hook", F.lit(HOOK_PREFIX)))
        .groupBy("hook")
        .agg(F.min(F.struct("next_run", "schedule")).alias("e"))
        .select("hook", F.col("e.schedule").alias("actual_key"), F.col("e.next_run").alias("next_run"))
    )


def reconcile_schedule(profiles: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """K4: what to do per hook: keep, create, reschedule, cancel, cancel_orphan."""
    wanted = first_run(profile_interval(profiles), now).select("hook", "enabled", "interval_key", "first_run")
    both = wanted.join(_next_events(events), "hook", "full_outer")
    action = (
        F.when(F.col("enabled").isNull(), F.lit("cancel_orphan"))
        .when(~F.col("enabled") & F.col("actual_key").isNotNull(), F.lit("cancel"))
        .when(~F.col("enabled"), F.lit("none"))
        .when(F.col("actual_key").isNull(), F.lit("create"))
        .when(F.col("actual_key") == F.col("interval_key"), F.lit("keep"))
        .otherwise(F.lit("reschedule"))
    )
    planned = both.withColumn("action", action)
    starts = F.col("action").isin("create", "reschedule")
    return planned.where("action <> 'none'").select(
        "hook", "action", "actual_key",
        F.when(F.col("enabled"), F.col("interval_key")).alias("interval_key"),
        F.when(starts, F.col("first_run")).when(F.col("action") == "keep", F.col("next_run")).alias("next_run"),
    )


def schedule_check(profiles: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """K6: enabled profiles with the expected and the actual interval. The expected
    key is built from the stored values as they are."""
    enabled = profile_interval(profiles).where("enabled").withColumn(
        "expected_key", interval_key("cron_frequency", "cron_period")
    )
    state = (
        F.when(F.col("actual_key").isNull(), F.lit("not scheduled"))
        .when(F.col("actual_key") == F.col("expected_key"), F.lit("matches"))
        .otherwise(F.lit("mismatch"))
    )
    return enabled.join(_next_events(events), "hook", "left").select(
        "profile_key", "expected_key", "actual_key", state.alias("state"),
        F.timestamp_diff("SECOND", now.cast("timestamp_ntz"), F.col("next_run")).alias("seconds_until"),
    )
