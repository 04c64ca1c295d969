"""Cutting lineage, size-checked broadcasts, and orders that one task need not see whole."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
ID_BUCKETS = 1024


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for checkpoints. Without one, executors on other machines
    could not read what they write, so that is an error unless Spark runs in one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return folder or own_folder(sc.master, sc.applicationId)


def own_folder(master: str, application: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return str(Path(tempfile.gettempdir()) / f"pagemill-{application}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: several consumers
    then share one computation, each reads only its columns, and a lost executor
    costs a re-read, not a re-parse."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after counting rows and bytes; beyond either bound a shuffle
    join is used."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= rows and seen["bytes"] <= size else df


def looked_up(items: DataFrame, table: DataFrame, keys: list[str], spread: str, ways: int = ID_BUCKETS) -> DataFrame:
    """``items`` with the columns of ``table``, which has one row per ``keys``, where there is such a row.

    Rows whose keys are null find nothing; they are dealt out by a hash of the column ``spread`` instead of
    meeting in the one task that null hashes to. Hot keys are split by AQE."""
    lacks = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    lane = F.when(lacks, 1 + F.pmod(F.xxhash64(spread), F.lit(ways))).otherwise(F.lit(0).cast("bigint"))
    found = table.withColumn("_lane", F.lit(0).cast("bigint"))
    return items.withColumn("_lane", lane).join(found, [*keys, "_lane"], "left").drop("_lane")


def sum_before(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in ``order``.

    ``block`` cuts the order into ranges (it must grow with it). Sums inside a range
    and offsets between ranges are separate windows, so a key that owns a third of
    all rows is spread over its ranges instead of filling one task.
    """
    cut = df.withColumn("_block", block).withColumn("_value", value.cast("bigint"))
    totals = cut.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_block", "_value", "_inside", "_offset")
    )


def numbered(df: DataFrame, key: list[str], start: Column, out: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """Dense numbers from ``start + 1``, the same on every run over the same rows.

    Rows are spread by a hash of ``key`` (which must be unique), numbered inside their
    bucket, and shifted by the sizes of the buckets before.
    """
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = cut.groupBy("_bucket").agg(F.count("*").alias("_size"))
    # one row per bucket, at most ``buckets`` rows
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*key)
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, start + F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_rank", "_offset")
    )
