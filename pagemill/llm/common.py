"""Helpers the corpus operators share: stages, row ids, components, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.staging import stage

#: Words of a shingle and the similarity from which two sets are near duplicates.
SHINGLE = 5
SIMILARITY = 0.8


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def crc_bucket(id_col: str, parts: int) -> Column:
    """``crc32(id as text) mod parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if ``df`` has a column called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a stage no plan needs any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_back(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, columns in their order."""
    return stage(df, name)


def drop_stage(df: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, class_id`` of every end of a link: the smallest id it is connected with.

    Smallest-neighbour labels with pointer jumping; each round is a written table, so
    that a lost executor costs one round and plans stay short. Rounds grow with the
    logarithm of a component's width. Nothing but the count of changes reaches the driver.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id <> other")
    edges = stage(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "edges")
    labels = stage(edges.groupBy("id").agg(F.least("id", F.min("other")).alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("other"), "label"), "other")
            .groupBy("id").agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        jumped = lower.join(up, "low", "left").select(
            "id", F.least("low", F.coalesce("up", "low")).alias("label"),
            (F.least("low", F.coalesce("up", "low")) != F.col("label")).alias("moved"),
        )
        after = stage(jumped, "labels")
        moved = after.where("moved").limit(1).count()
        drop_stage(labels)
        labels = after.drop("moved")
        if not moved:
            drop_stage(edges)
            return labels.select("id", F.col("label").alias("class_id"))


# ---- word hashes over an Arrow column of texts, no Python object per word -----

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix), one stream per ``salt``."""
    x = (x + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


#: One 64-bit value per byte, A-Z as a-z.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64), 7)
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0xD6E8FEB86659FD93 | 1


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    np.multiply.accumulate(np.full(max(n - 1, 0), _BASE, np.uint64), out=out[1:])
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each one starts (one more offset than texts); null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 21):
    """A batch in pieces of about ``size`` bytes of text, one row at least."""
    start, at = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch[text]).fill_null(0).to_pylist()):
        if at + n > size and i > start:
            yield batch.slice(start, i - start)
            start, at = i, 0
        at += n
    if start < len(batch):
        yield batch.slice(start)


def _windows(word: np.ndarray, size: int):
    """Cuts of a byte range at white space, ``size`` bytes or more apart."""
    start, n = 0, len(word)
    while start < n:
        end = min(start + size, n)
        if end < n:
            space = np.flatnonzero(~word[end : end + 65536])
            while len(space) == 0 and end + 65536 < n:
                end += 65536
                space = np.flatnonzero(~word[end : end + 65536])
            end = end + int(space[0]) if len(space) else n
        yield start, end
        start = end


def word_hashes(body: np.ndarray, offsets: np.ndarray, window: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes other than ASCII white space; A-Z as a-z) and
    how many words each text has. Long inputs are worked on in windows."""
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[body]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = word[inner]  # a text's first byte never goes on with the word before
    out = []
    for lo, hi in _windows(word, window):
        inside = np.flatnonzero(word[lo:hi])
        if len(inside) == 0:
            continue
        at = np.flatnonzero(start[lo:hi])
        place = inside - at[np.cumsum(start[lo:hi], dtype=np.int32)[inside] - 1]
        terms = _VALUE[body[lo:hi][inside]] * _powers(int(place.max()) + 1)[place]
        out.append(mix(np.add.reduceat(terms, np.flatnonzero(place == 0))))
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return hashes, np.diff(np.searchsorted(np.flatnonzero(start), offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text and how many each has. A
    text of fewer words has one shingle of all its words, a text of none has none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    short = (counts > 0) & (counts < width)
    many = np.where(counts >= width, counts - width + 1, short.astype(np.int64))
    factor = mix(np.arange(1, width + 1, dtype=np.uint64), 99)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            rolled += words[i : len(words) - width + 1 + i] * factor[i]
    else:
        rolled = np.zeros(0, np.uint64)
    total = int(many.sum())
    out_start = np.cumsum(many) - many
    index = np.arange(total) - np.repeat(out_start - starts, many)
    owner_short = np.repeat(short, many)
    out = np.zeros(total, np.uint64)
    out[~owner_short] = rolled[index[~owner_short]]
    for i in np.flatnonzero(short):
        part = words[starts[i] : ends[i]]
        out[out_start[i]] = (part * factor[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), many


def sets_of(hashes: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes per text."""
    return [np.unique(x) for x in np.split(hashes, np.cumsum(many)[:-1])] if len(many) else []
