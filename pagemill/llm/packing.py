"""Packing documents into sequences by cutting-stock column generation (operator 9).

A document is its token ids and one end id. It is cut every ``capacity`` ids: full pieces
are sequences of their own, the rest is one item of a cutting-stock problem. The problem
needs only the histogram of item lengths, in classes of ``unit`` tokens (at most
``capacity / unit`` of them, however many documents there are):

* a linear program over patterns (how many items of each class share a sequence) is solved
  by the revised simplex method, starting from one-class patterns;
* a knapsack dynamic program over the capacity prices the patterns not yet in the program,
  and the best one enters until none lowers the number of sequences;
* the solution is rounded down; what is left over is packed first-fit decreasing, as
  patterns too.

Items are then ranked inside their class (per hash bucket, with offsets, so no class is
ever in one task) and a rank finds its pattern and sequence through the table of pattern
slots, whose size is bounded by the number of classes. The text is tokenised once; checksums of the
pieces come from that pass.

Edge cases: a null or empty text is just the end id. Repeated rows are packed each on
their own. A null identifier is a value like any other. An empty table gives an empty
result. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators.staging import stage

CAPACITY = 2048
UNIT = 16
END_ID = 1
VOCABULARY = "byte_bpe_50k"
BUCKETS = 256
CACHED_UNITS = 600_000
_SPECIAL = "<|endoftext|>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Units(dict):
    """Ids, as little-endian 32-bit words, of text units that start after one space."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise KeyError(unit)
        if unit.isalpha():
            ids = self.encoding.encode_single_piece(f" {unit}".encode())
        else:
            ids = self.encoding.encode_ordinary(" " + unit)
        if len(self) >= CACHED_UNITS:
            self.clear()
        self[unit] = out = np.array(ids, "<u4").tobytes()
        return out


class Tokens:
    """Ids of whole texts, equal to those of the ``tokenizers`` library.

    A single space between two other characters always begins a token, so a text is a
    row of units whose ids don't depend on each other; units repeat and are looked up.
    Texts with other white space around a space, or with the special token, go through
    the tokeniser whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        whole = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = whole.encode_ordinary
        self.special = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.units = _Units(whole._core_bpe)

    def ids(self, text: str) -> bytes:
        if _SPECIAL in text:
            return np.array(self.special.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return np.array(self.plain(text), "<u4").tobytes()
        try:
            tail = b"".join(map(self.units.__getitem__, rest))
        except KeyError:
            return np.array(self.plain(text), "<u4").tobytes()
        return np.array(self.plain(first), "<u4").tobytes() + tail


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document cut every ``capacity`` ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for batch in batches:
            for lo in range(0, len(batch), 500):
                rows = []
                some = batch.slice(lo, 500)
                for doc, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    ids = tokens.ids(text or "") + end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(cut, _PIECES)


# ---- the plan: at most capacity / unit classes, on the driver -----------------


def _best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: most value within ``room``; item ``i`` has size ``i + 1``."""
    best = np.zeros(room + 1)
    choice = np.zeros(room + 1, np.int64)
    sizes = np.flatnonzero(value > 1e-12) + 1
    worth, fits = value[sizes - 1], np.searchsorted(sizes, np.arange(room + 1), side="right")
    for space in range(1, room + 1):
        fit = sizes[: fits[space]]
        best[space] = best[space - 1]
        if len(fit):
            gains = worth[: len(fit)] + best[space - fit]
            top = int(gains.argmax())
            if gains[top] > best[space] + 1e-12:
                best[space], choice[space] = gains[top], fit[top]
    counts, space = np.zeros(len(value), np.int64), room
    while space > 0:
        if choice[space]:
            counts[choice[space] - 1] += 1
            space -= choice[space]
        else:
            space -= 1
    return float(best[room]), counts


def cutting_stock(demand: np.ndarray, room: int, gap: float = 0.002, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, covering ``demand[i]`` items of size ``i + 1``.

    Columns enter until the program is within ``gap`` of its optimum: the value of the
    best column bounds how far the current solution can be from it."""
    sizes = np.flatnonzero(demand)
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    if len(sizes):
        basis = np.diag((room // (sizes + 1)).astype(float))  # columns: one-class patterns
        inverse = np.diag(1.0 / np.diag(basis))
        wanted = demand[sizes].astype(float)
        use = (inverse * wanted).sum(axis=1)  # elementwise: small products gain nothing from threads
        for step in range(rounds):
            price = inverse.sum(axis=0)
            value = np.zeros(len(demand))
            value[sizes] = price
            gain, counts = _best_pattern(value, room)
            if gain <= 1 + gap:
                break
            column = counts[sizes].astype(float)
            change = (inverse * column).sum(axis=1)
            ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
            out = int(ratio.argmin())
            basis[:, out] = column
            if step % 200 == 199:  # against rounding errors
                inverse = np.linalg.inv(basis)
            else:
                row = inverse[out] / change[out]
                inverse = inverse - np.outer(change, row)
                inverse[out] = row
            use = np.maximum((inverse * wanted).sum(axis=1), 0)
        for j, x in enumerate(np.floor(use + 1e-9).astype(np.int64)):
            counts = np.zeros(len(demand), np.int64)
            counts[sizes] = basis[:, j].astype(np.int64)
            if x > 0:
                plan.append((counts, int(x)))
                left -= counts * x
    plan = [(c, n) for c, n in plan if n]
    # rounding down leaves fewer than one use of each pattern in the basis
    while left.max(initial=0) > 0:
        counts, space = np.zeros(len(demand), np.int64), room
        for i in np.flatnonzero(left > 0)[::-1]:
            take = min(int(left[i]), space // (i + 1))
            counts[i] += take
            space -= take * (i + 1)
        uses = int(min(left[i] // counts[i] for i in np.flatnonzero(counts)))
        plan.append((counts, uses))
        left -= counts * uses
    return _exact(plan, demand)


def _exact(plan: list[tuple[np.ndarray, int]], demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    covered = sum((c * n for c, n in plan), np.zeros(len(demand), np.int64))
    if (covered < demand).any():
        raise ValueError("a class is not covered")
    return plan


def _slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``class, first rank, last rank, items per sequence, first sequence, place`` of each
    class in each pattern."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for counts, uses in plan:
        for place, i in enumerate(np.flatnonzero(counts)):
            size, per = int(i) + 1, int(counts[i])
            at = rank.get(size, 0)
            rows.append((size, at, at + per * uses - 1, per, base, place))
            rank[size] = at + per * uses
        base += uses
    return rows


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    unit: int = UNIT, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece."""
    spark = docs.sparkSession
    pieces = stage(
        token_pieces(docs, id_col, text_col, capacity, vocabulary)
        .withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int")),
        "pieces",
    )
    # at most capacity / unit classes times BUCKETS rows, however many pieces there are
    totals = pieces.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stage(totals.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))), "shifts")
    room = capacity // unit
    demand = np.zeros(room, np.int64)
    for row in shifts.groupBy("size").agg(F.sum("n").alias("n")).collect():
        demand[row["size"] - 1] = row["n"]
    plan = cutting_stock(demand, room)
    slots = spark.createDataFrame(
        _slots(plan) or [], "size int, first long, last long, per long, base long, place int"
    )
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(shifts.select("size", "bucket", "shift")), ["size", "bucket"])
        .withColumn("rank", F.col("shift") + F.col("inside"))
    )
    held = (F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("last"))
    # a class has a handful of pattern ranges; exactly one holds a rank
    placed = ranked.join(F.broadcast(slots), ["size"]).where(held).withColumn(
        "sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))
    )
    earlier = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )
