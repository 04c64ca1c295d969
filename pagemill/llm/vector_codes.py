"""Vector compression by integer product codes (operator 11).

A vector is cut into consecutive parts; each part is replaced by the number of the
nearest entry of its position's codebook, which rounds of nearest-entry assignment and
floored means improve. All arithmetic is on integers, so every run gives the same codes.

Nearest entries are found in the Walsh-Hadamard domain: parts and entries are padded with
zeros to a power of two, transformed with +1/-1 only, and their squared differences added
up coefficient by coefficient, in order of sequency. The transform multiplies every
squared distance by the padded length, so a partial sum is an exact lower bound, and an
entry leaves as soon as it exceeds the full sum of the entry that leads so far. What is
left is compared by full sums, ties going to the lower index.

Spark holds the vectors; a round reads them once, each task adds up one row per codebook
component, and Spark sums those. The driver sees the codebooks only (entries x width numbers).

Edge cases: a vector that is null or holds null, NaN or infinite components is dropped.
Shorter vectors are padded with zeros to the longest one's length, and that to a multiple of the
number of parts; an empty vector is all zeros. Components beyond 2**62 after scaling count as that; beyond
64 bits of a squared distance the same steps run on Python's integers, and an ``error``
too large for a long is the largest long. Fewer vectors than entries: as many entries as
vectors. Repeated identifiers are rows of their own; among equal ones the smaller vector comes
first when the codebooks start, and a null identifier comes last. An empty table gives an
empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.staging import broadcast_if_small, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components a task works on at a time; components and sums stay below these.
SLICE, MOST, LONG = 1 << 19, 1 << 62, (1 << 63) - 1
#: Rows of a label's total when the totals are too many to broadcast: a hot label meets that many tasks.
SALTS = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two long), in order of sequency."""
    n = x.shape[-1]
    order = np.zeros(1, np.int64)  # sign changes of each row of the natural order
    width = 1
    while width < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * width), 2, width)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        x = np.stack([a + b, a - b], axis=-2).reshape(x.shape)
        # row (h, r) repeats row r, with the other sign if h: a change at the seam comes or goes
        ends = order & 1
        order = np.concatenate([2 * order + ends, 2 * order + 1 - ends])
        width *= 2
    return x[..., np.argsort(order, kind="stable")]


def padded(x: np.ndarray) -> np.ndarray:
    """Last axis with zeros up to a power of two."""
    n = x.shape[-1]
    size = 1 << max(n - 1, 0).bit_length()
    return np.concatenate([x, np.zeros((*x.shape[:-1], size - n), x.dtype)], axis=-1) if size > n else x


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance for each row of ``parts``;
    both arguments are transformed."""
    rows, size = parts.shape
    row = np.repeat(np.arange(rows), len(entries))
    entry = np.tile(np.arange(len(entries)), rows)
    so_far = np.zeros(len(row), parts.dtype)
    done, step = 0, 1
    while done < size:
        some = slice(done, min(done + step, size))
        gap = parts[row, some] - entries[entry, some]
        so_far = so_far + (gap * gap).sum(axis=1)
        done, step = some.stop, step * 2
        if done < size:
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(so_far, starts)
            # an entry with the least partial sum leads; its full sum is the bound
            leads = np.flatnonzero(so_far == np.repeat(least, np.diff(starts, append=len(row))))
            leads = leads[np.diff(row[leads], prepend=-1) != 0]
            rest = parts[:, done:] - entries[entry[leads], done:]
            bound = least + (rest * rest).sum(axis=1)
            stay = so_far <= bound[row]
            row, entry, so_far = row[stay], entry[stay], so_far[stay]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(so_far, starts) if rows else so_far
    first = np.flatnonzero(so_far == np.repeat(least, np.diff(starts, append=len(row)))) if rows else starts
    first = first[np.diff(row[first], prepend=-1) != 0]
    return entry[first], least // size


def integers(vectors: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Rows of ``floor(SCALE * x)``, padded to ``width``, some at a time."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    step = max(1, SLICE // max(width, 1))
    for at in range(0, len(vectors), step):
        some = sizes[at : at + step]
        flat = values[ends[at] - sizes[at] : ends[min(at + step, len(sizes)) - 1]]
        out = np.zeros((len(some), width))
        out[np.arange(width) < some[:, None]] = flat
        out = np.floor(out * SCALE)
        large = np.abs(out) >= MOST
        whole = np.where(large, 0, out).astype(np.int64)
        yield np.where(large, np.where(out > 0, MOST, -MOST), whole)


def coded(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per part position: codes and squared distances of the rows of ``x``; ``books`` is
    indexed by part, entry, position."""
    parts, _, width = books.shape
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    exact = 4 * most * most * (2 * max(width, 1)) ** 2 < LONG
    kind = np.int64 if exact else object
    for i in range(parts):
        part = x[:, i * width : (i + 1) * width].astype(kind)
        if width == 0:
            yield i, np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        else:
            yield i, *nearest(hadamard(padded(part)), hadamard(padded(books[i].astype(kind))))


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total = np.zeros(books.shape, object)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for x in integers(batch["vector"], parts * width):
                kind = np.int64 if np.abs(x).max(initial=0) < 1 << 40 else object
                for i, code, _ in coded(x, books):
                    some = np.zeros((entries, width), kind)
                    np.add.at(some, code, x[:, i * width : (i + 1) * width].astype(kind))
                    total[i] += some
                    count[i] += np.bincount(code, minlength=entries)
        i, k, p = (v.ravel() for v in np.indices(books.shape))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.int32()),
                pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0)), pa.array(count[i, k], pa.int64()),
            ],
            names=["part", "entry", "place", "total", "n"],
        )

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for batch in batches:
            code, error = [], []
            for x in integers(batch["vector"], parts * width):
                text, total = np.full(len(x), "", object), np.zeros(len(x), object)
                for _, nearest_entry, distance in coded(x, books):
                    text += np.array([f"{k:02x}" for k in range(books.shape[1])], object)[nearest_entry]
                    total += distance.astype(object)
                code.extend(text)
                error.extend(min(v, LONG) for v in total)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=["id", "label", "code", "error"],
            )

    return run


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of ``id, vector`` rows."""
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-width // parts)
    first = vectors.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    start = pa.array([r.vector for r in first], pa.list_(pa.float64()))
    rows = np.concatenate([np.zeros((0, parts * width), np.int64), *integers(start, parts * width)])
    books = rows.reshape(len(rows), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if books.size else 0):
        sums = (
            vectors.select("vector").mapInArrow(_sums(books), "part int, entry int, place int, total decimal(38,0), n long")
            .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        )
        books = books.copy()
        for r in sums.where("n > 0").collect():  # one row per component of the codebooks
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    return books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per kept vector: identifier, ``code``, ``error``, ``label_error``, ``codebooks_sha256``."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = table.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(F.col("vector").isNotNull() & finite)
    books = codebooks(vectors, parts, entries, rounds)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = stage(
        vectors.mapInArrow(_codes(books), f"id {types['id']}, label {types['label']}, code string, error long"), "codes"
    )
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = rows.groupBy("label").agg(F.least(whole, F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = broadcast_if_small(totals)
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)) if few is totals else F.lit(0)
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) if few is totals else few.withColumn("salt", F.lit(0))
    a, b = rows.withColumn("salt", salt.cast("int")).alias("a"), few.alias("b")
    return a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt"))).select(
        F.col("a.id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )
