"""Lines that many documents share, found batch by batch (operator 13).

Line hashes live in runs: tables of (hash, how many documents of the run's batches have the line), bucketed and
sorted by the hash. A new batch is reduced to its own hashes and counts, merge-anti-joined
with the runs for hashes already known to be common (nothing more need be said of these),
and what is left becomes a run of level 0. When a level holds ``fan_in`` runs they are
compacted: merged by hash, counts added, into one run of the next level. So a hash is rewritten once per
level, and a batch meets a number of runs that grows with the logarithm of the batches.

Runs are bucketed tables, so the merge joins read them in place; only the new batch, and runs being compacted, are
shuffled. Common hashes, however many, go back to the lines by a join, broadcast only below a checked
size; rows that come back per document are line numbers, bounded by its own lines.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower
case; its hash has 128 bits (two differently seeded 64-bit hashes).

Edge cases: a null or empty text is one empty line. Rows are documents: repeated rows count
as often as they occur, whatever their identifier. A line that occurs twice in a document counts once. Keys shorter than
``shortest`` never go. Very long lines and texts are hashed whole. A document that loses
all lines keeps the empty text. An empty table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import drop_path
from pagemill.operators.staging import broadcast_if_small, shared_folder, stage

DOCUMENTS, SHORTEST, FAN_IN, BATCHES = 10, 1, 4, 8
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["hi", "lo"]


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def hashed(key: str) -> list[Column]:
    # the constant in front changes the seed with which the key is hashed
    return [F.xxhash64(key).alias("hi"), F.xxhash64(F.lit("second"), F.col(key)).alias("lo")]


def line_counts(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST, by: tuple[str, ...] = ()) -> DataFrame:
    """``hi, lo, n``: in how many rows each line occurs (per value of the columns ``by``)."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), key_of))
    return (
        docs.select(*by, F.explode(keys).alias("_key")).where(F.char_length("_key") >= shortest)
        .select(*by, *hashed("_key")).groupBy(*by, *_HASH).agg(F.count("*").alias("n"))
    )


class LineRuns:
    """Levels of sorted runs of line hashes in a folder, with the counts of documents."""

    def __init__(self, spark, least: int = DOCUMENTS, fan_in: int = FAN_IN, folder: str | None = None):
        self.spark, self.least, self.fan_in = spark, least, fan_in
        self.folder = folder or f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *_HASH)

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option(
            "path", f"{self.folder}/{name}"
        ).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, counts: DataFrame) -> None:
        """Take in a batch given by its ``line_counts``."""
        for name in self.runs():
            counts = counts.join(self.spark.table(name).where(F.col("n") >= self.least), _HASH, "left_anti")
        self._place(self._write(self._dealt(counts)), 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan_in:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._dealt(self._summed(old)))
            for n in old:
                self._drop(n)
            self._place(merged, level + 1)

    def _summed(self, names: list[str]) -> DataFrame:
        # The files, not the tables: Spark 4.1 takes a union of bucketed tables for bucketed itself, although
        # it doesn't read equal buckets together, and then adds up nothing across tables.
        paths = [f"{self.folder}/{n}" for n in names]
        return self.spark.read.schema("hi long, lo long, n long").parquet(*paths).groupBy(*_HASH).agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """``hi, lo`` of the lines that at least ``least`` documents have."""
        return self._summed(self.runs()).where(F.col("n") >= self.least).select(*_HASH)

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def drop_lines(docs: DataFrame, common: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``lines`` (all lines) and ``kept`` (places, from 0, of those that stay)."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    # equal texts lose the same lines, so what to cut is worked out per text
    digest = [F.xxhash64(body).alias("t_hi"), F.xxhash64(F.lit("second"), body).alias("t_lo")]
    spread = docs.select(*digest, F.posexplode(F.transform(lines_of(F.col(text_col)), key_of)).alias("place", "_key"))
    cuts = stage(
        spread.where(F.char_length("_key") >= shortest).select("t_hi", "t_lo", "place", *hashed("_key"))
        .join(broadcast_if_small(common), _HASH).groupBy("t_hi", "t_lo").agg(F.collect_set("place").alias("cut")),
        "cuts",
    )
    lines = lines_of(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("cut", F.array().cast("array<int>")))
    return (
        docs.select("*", *digest).join(broadcast_if_small(cuts), ["t_hi", "t_lo"], "left")
        .withColumn("lines", lines).withColumn("kept", kept).drop("t_hi", "t_lo", "cut")
    )


def without_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = DOCUMENTS, shortest: int = SHORTEST,
    batches: int = BATCHES, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per document: ``doc_id, text`` (lines that stay), ``n_lines, n_dropped``. The table is taken in
    as ``batches`` batches; where documents arrive over time, use :class:`LineRuns`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by_batch = f"{shared_folder(spark)}/line-counts-{uuid.uuid4().hex}"
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    line_counts(dealt, shortest=shortest, by=("batch",)).write.partitionBy("batch").parquet(by_batch)
    counts = spark.read.schema("hi long, lo long, n long, batch int").parquet(by_batch)
    runs = LineRuns(spark, least, fan_in)
    for i in range(batches):
        runs.add(counts.where(F.col("batch") == i).select(*_HASH, "n"))
    common = stage(runs.common(), "common-lines")
    runs.close()
    drop_path(spark, by_batch)
    out = drop_lines(rows, common, shortest=shortest)
    return out.select(
        "doc_id", F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    return without_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
