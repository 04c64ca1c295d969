"""Exact duplicates by a tree merge of sorted digest runs (operator 4).

Every input partition makes a run: one row per digest it holds, sorted, with the
identifier to keep and how many rows it stands for. Runs then meet in rounds. In round
r a run talks only to the ``fan_in - 1`` runs whose numbers differ from its own in digit
r, and each of these partners takes the digests whose digit r is its own; it merges what
it gets, in digest order, and keeps per digest the winner and the sum. After the last
round every digest lies in one run, every task has seen an even share of the digests,
and equal rows have been folded at each level, so a text that a third of all rows share
is one row per run from the first round on.

Two digests count as equal only if SHA-256 and length in bytes both agree (verified at
every level).

Edge cases: a null text is the empty text. Repeated rows (same identifier, same text)
are separate rows of which one stays. A null identifier loses against any other. An
empty table gives an empty result. Only the named columns of the input are read, so
other columns, of any name, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import drop_stage, unused
from pagemill.operators.staging import stage

FAN_IN = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "slot int, digest binary, n_bytes long, best_id long, best_uid long, n long"
_SCHEMA = pa.schema(
    [("slot", pa.int32()), ("digest", pa.binary())] + [(c, pa.int64()) for c in ("n_bytes", "best_id", "best_uid", "n")]
)


def normalized(text: str | Column) -> Column:
    """Texts are equal when these are: A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by slot, digest and length: equal neighbours become one.

    Rows of a digest arrive best first, so the first row of a group holds the winner.
    The last group of a batch waits, as the next batch may go on with it."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_arrays(batch.columns, schema=_SCHEMA)
        table = table if held is None else pa.concat_tables([held, table])
        if len(table) == 0:
            continue
        table = table.combine_chunks()
        change = pa.array([True])
        if len(table) > 1:
            for name in ("slot", "digest", "n_bytes"):
                column = table[name].chunk(0)
                differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                step = differs if name == "slot" else pc.or_(step, differs)
            change = pa.concat_arrays([change, step])
        first = pc.indices_nonzero(change).to_numpy().astype(np.int64)
        total = table["n"].to_numpy()
        summed = total.cumsum()
        ends = np.append(first[1:], len(table)) - 1
        sums = summed[ends] - summed[first] + total[first]
        out = table.take(pa.array(first))
        out = pa.Table.from_arrays([*out.columns[:5], pa.array(sums, pa.int64())], schema=_SCHEMA)
        held = out.slice(len(out) - 1)
        yield from out.slice(0, len(out) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def merged_runs(rows: DataFrame, keep: str, fan_in: int = FAN_IN) -> DataFrame:
    """``digest, n_bytes, best_id, best_uid, n``, one row per text, of ``uid, id, digest,
    n_bytes``. ``keep``: ``largest`` or ``smallest`` identifier."""
    parts = max(rows.rdd.getNumPartitions(), 1)
    rounds = 1
    while fan_in**rounds < parts:
        rounds += 1
    best = F.desc_nulls_last("best_id") if keep == "largest" else F.asc_nulls_last("best_id")
    order = ("slot", "digest", "n_bytes", best, "best_uid")
    runs = rows.select(
        F.spark_partition_id().alias("slot"), "digest", "n_bytes", F.col("id").alias("best_id"),
        F.col("uid").alias("best_uid"), F.lit(1).cast("long").alias("n"),
    ).sortWithinPartitions(*order).mapInArrow(_merge, _RUN)
    # digits of the digest that choose the partner, and the digits they replace in the slot
    share = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")  # exact as a double
    for r in range(rounds):
        weight = fan_in**r
        digit = F.pmod(F.floor(share / weight), F.lit(fan_in))
        old = F.pmod(F.floor(F.col("slot") / weight), F.lit(fan_in))
        partner = (F.col("slot") + (digit - old) * weight).cast("int")
        runs = (
            runs.withColumn("slot", partner)
            .repartitionById(fan_in**rounds, F.col("slot"))
            .sortWithinPartitions(*order)
            .mapInArrow(_merge, _RUN)
        )
    return runs.drop("slot")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = FAN_IN
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row."""
    text = normalized(text_col)
    digests = stage(
        docs.select(F.col(id_col).alias("id"), text.alias("_text")).select(
            F.monotonically_increasing_id().alias("uid"), "id",
            F.unhex(F.sha2("_text", 256)).alias("digest"), F.octet_length("_text").cast("long").alias("n_bytes"),
        ),
        "digests",
    )
    winners = merged_runs(digests, keep, fan_in)
    # a text of very many rows is a hot key on the left side only, which Spark splits
    return digests.join(winners, ["digest", "n_bytes"]).select(
        F.col("id").alias("doc_id"), F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Rows of ``docs`` whose text stays, with all their columns."""
    uid = unused(docs, "_uid")
    held = stage(docs.withColumn(uid, F.monotonically_increasing_id()), "texts")
    rows = held.select(
        F.col(uid).alias("uid"), F.col(id_col).alias("id"),
        F.unhex(F.sha2(normalized(text_col), 256)).alias("digest"),
        F.octet_length(normalized(text_col)).cast("long").alias("n_bytes"),
    )
    winners = merged_runs(rows, keep).select(F.col("best_uid").alias(uid))
    return held.join(winners, uid, "left_semi").drop(uid)
