"""Similarity join of shingle sets by chosen paths (operator 5).

Sets are those of a text's shingles of five words. Texts with the same set form one class
member list and go on as one representative. For representatives:

* In each of ``REPEATS`` runs a set picks every token with probability ``1 / (similarity *
  size)`` by a hash of the token (the lowest one if none is picked), so two sets of at least the
  wanted similarity share one or more picks on average. Sets that share a pick meet in
  a bucket.
* A bucket of up to ``LIMIT`` sets is searched by brute force. A larger one is split again
  by the picks of the next level, up to ``DEPTH`` levels. What is still larger then (a mass of
  near copies) is cut in blocks and every pair of blocks is searched, so nothing is capped.
* Brute force compares sketches of 64 bytes with a wide margin and returns links that
  connect what it found, not all pairs; repeats bring a pair's chance of never meeting far below 1 in 1000.
* Components of those links hold every similar pair. Inside each, again in pairs of blocks,
  the sets themselves are compared: similarity is exact, every pair is counted
  (``n_links``), and links that connect the similar ones give the final classes.

Rows therefore grow with the number of texts times their blocks, never with the pairs of a
group.

Edge cases: words are split at ASCII white space, A-Z counts as a-z; a text of one to four
words has one shingle. Texts without words (also null) resemble nothing, not even each
other. Repeated rows and repeated identifiers are rows of their own. A null identifier is a
value like any other. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import SIMILARITY, buffers, components, drop_stage, mix, sets_of, shingle_hashes, slices, unused, word_hashes
from pagemill.operators.staging import stage

REPEATS = 12
DEPTH = 3
LIMIT = 2048
BLOCK = 256
BINS = 64
_ODD = mix(np.arange(1, 257, dtype=np.uint64), 5) | np.uint64(1)


def text_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return sets_of(*shingle_hashes(*word_hashes(*buffers(texts))))


def signature(tokens: np.ndarray) -> bytes:
    """Equal sets have equal ones; 24 bytes, so that unlike sets don't."""
    with np.errstate(over="ignore"):
        parts = [len(tokens), tokens.sum(dtype=np.uint64), mix(tokens, 3).sum(dtype=np.uint64)]
    return np.array(parts, np.uint64).tobytes()


def sketch(tokens: np.ndarray) -> bytes:
    """Lowest token of each of ``BINS`` ranges, as one byte (0: the range is empty)."""
    out = np.zeros(BINS, np.uint8)
    if len(tokens):
        ranges = (tokens >> np.uint64(58)).astype(np.int64)  # tokens are sorted: the first of a range is its lowest
        first = np.flatnonzero(np.diff(ranges, prepend=-1))
        out[ranges[first]] = (tokens[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def picks(tokens: np.ndarray, similarity: float, number: int) -> list[list[int]]:
    """For each of ``number`` hash functions the tokens a set picks."""
    out = []
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * max(len(tokens), 1)))))
    for i in range(number):
        with np.errstate(over="ignore"):
            hashed = tokens * _ODD[i]
        hashed ^= hashed >> np.uint64(32)
        chosen = np.flatnonzero(hashed <= limit)
        if len(chosen) == 0:
            chosen = hashed.argmin(keepdims=True)
        out.append(tokens[chosen].astype(np.int64).tolist())
    return out


def similar_sketches(one: np.ndarray, many: np.ndarray, sizes_one: np.ndarray, sizes_many: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs may reach the similarity: matching share of filled ranges, less five
    deviations, and sizes that allow it."""
    same = ((one[:, None, :] == many[None, :, :]) & (one[:, None, :] > 0)).sum(axis=2)
    filled = ((one[:, None, :] > 0) | (many[None, :, :] > 0)).sum(axis=2)
    margin = 5 * np.sqrt(similarity * (1 - similarity) / np.maximum(filled, 1))
    small, large = np.minimum.outer(sizes_one, sizes_many), np.maximum.outer(sizes_one, sizes_many)
    return (same >= (similarity - margin) * filled) & (small >= similarity * large - 1e-9)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix of pairs connects."""
    left = np.ones(len(near), bool)
    out = []
    while left.any():
        front = [int(left.argmax())]
        left[front[0]] = False
        while front:
            at = front.pop()
            reached = np.flatnonzero(near[at] & left)
            left[reached] = False
            out += [(at, int(r)) for r in reached]
            front += reached.tolist()
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches sorted by key."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table], promote_options="permissive")
        n = len(table)
        if n == 0:
            continue
        columns = [table[k].to_numpy() for k in key]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if n > 1 else np.zeros(0, int)
        edges = [0, *cuts.tolist()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield table.slice(lo, hi - lo)
        held = table.slice(edges[-1])
    if held is not None and len(held):
        yield held


def _sets(docs: DataFrame, similarity: float, repeats: int, depth: int) -> DataFrame:
    """``uid, doc_id, body, n, sig, sketch, picks`` of every row; picks of run r at level l at ``r * depth + l``;
    ``body`` is a hash of the text."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = text_sets(batch["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["uid"], batch["doc_id"], batch["body"], pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([signature(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()),
                        pa.array([picks(s, similarity, repeats * depth) if len(s) else [] for s in sets], pa.list_(pa.list_(pa.int64()))),
                    ],
                    ["uid", "doc_id", "body", "n", "sig", "sketch", "picks"],
                )

    return docs.select("uid", "doc_id", "text", F.xxhash64("text").alias("body")).mapInArrow(
        answer, "uid long, doc_id long, body long, n long, sig binary, sketch binary, picks array<array<long>>"
    )


def _brute_force(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` inside each bucket of ``key, uid, n, sketch``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key"]):
            uid, at = np.unique(group["uid"].to_numpy(), return_index=True)
            if len(uid) < 2:
                continue
            sizes = group["n"].to_numpy()[at].astype(float)
            bits = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)[at]
            near = np.zeros((len(uid), len(uid)), bool)
            for lo in range(0, len(uid), 64):
                near[lo : lo + 64] = similar_sketches(bits[lo : lo + 64], bits, sizes[lo : lo + 64], sizes, similarity)
            links = np.array(spanning(near | near.T), np.int64).reshape(-1, 2)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(uid[links[:, 0]]), pa.array(uid[links[:, 1]])], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(answer, "a long, b long")


def candidate_links(sets: DataFrame, similarity: float, repeats: int, depth: int, limit: int) -> DataFrame:
    """Links that connect all sets which may be similar, one row per link."""
    # both sides grow with the documents: the same joins at every size, no broadcast
    narrow = sets.select("uid", "n", "sketch").hint("merge")
    run = F.sequence(F.lit(0), F.lit(repeats - 1))
    level = sets.select("uid", F.explode(run).alias("run"), "picks").select(
        "uid", "run", F.explode(F.get("picks", F.col("run") * depth)).alias("token")
    ).select("uid", "run", F.xxhash64("run", "token").alias("key"))
    found = []
    for at in range(depth):
        # counts are added up before they move, and most buckets hold a single set
        counts = level.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").hint("merge")
        met = stage(level.join(counts, "key"), "buckets")
        found.append(_brute_force(met.where(F.col("m") <= limit).select("key", "uid").join(narrow, "uid"), similarity))
        large = met.where(F.col("m") > limit)
        if not large.take(1):
            break
        if at + 1 < depth:
            level = (
                large.select("uid", "run", "key").join(sets.select("uid", "picks"), "uid")
                .select("uid", "run", "key", F.explode(F.get("picks", F.col("run") * depth + at + 1)).alias("token"))
                .select("uid", "run", F.xxhash64("key", "token").alias("key"))
            )
        else:
            half = max(limit // 2, 1)
            blocks = large.withColumn("blocks", F.ceil(F.col("m") / half).cast("int")).withColumn(
                "block", F.pmod(F.xxhash64("uid", "key"), F.col("blocks")).cast("int")
            )
            pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
                "uid", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")
            )
            found.append(_brute_force(pairs.join(narrow, "uid"), similarity))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _exact(groups: DataFrame, similarity: float) -> DataFrame:
    """``a, b, n``: links (``n`` null) and numbers of similar partners (``b`` null) inside
    each pair of blocks of ``comp, i, j, uid, block, tokens``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["comp", "i", "j"]):
            uid, at = np.unique(group["uid"].to_numpy(), return_index=True)
            if len(uid) < 2:
                continue
            block = group["block"].to_numpy()[at]
            sets = [np.frombuffer(group["tokens"][int(k)].as_py(), np.uint64) for k in at]
            sizes = np.array([len(s) for s in sets], np.float64)
            joint = np.zeros((len(uid), len(uid)), np.float32)
            if len(uid) == 2:
                joint[0, 1] = joint[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
            else:
                _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                owner = np.repeat(np.arange(len(uid)), sizes.astype(int))
                shared = often[place] > 1
                place, owner = (np.cumsum(often > 1) - 1)[place[shared]], owner[shared]
                for lo in range(0, int((often > 1).sum()), 4096):
                    inside = (place >= lo) & (place < lo + 4096)
                    flags = np.zeros((len(uid), 4096), np.float32)
                    flags[owner[inside], place[inside] - lo] = 1
                    joint += flags @ flags.T
            near = joint >= similarity * (sizes[:, None] + sizes[None, :] - joint) - 1e-6
            np.fill_diagonal(near, False)
            if group["i"][0].as_py() != group["j"][0].as_py():
                near &= block[:, None] != block[None, :]
            links = spanning(near)
            partners = near.sum(axis=1)
            some = np.flatnonzero(partners)
            a = [*uid[some], *(uid[x] for x, _ in links)]
            b = [*[None] * len(some), *(uid[y] for _, y in links)]
            n = [*partners[some], *[None] * len(links)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    return groups.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(answer, "a long, b long, n long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    repeats: int = REPEATS, depth: int = DEPTH, limit: int = LIMIT, block: int = BLOCK, uid_col: str | None = None,
) -> DataFrame:
    """``uid, doc_id, class_id, rep_id, n_links, kept``, one row per input row.

    ``rep_id``: smallest identifier with the same set; ``class_id``: smallest identifier
    connected by similar sets; ``n_links``: how many other sets are similar to this one;
    ``kept``: the one row of its class that stays.
    """
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = stage(_sets(rows, similarity, repeats, depth), "sets")
    filled = every.where("n > 0")
    reps = stage(
        filled.groupBy("sig").agg(F.min("uid").alias("rep")), "reps"
    )
    chosen = stage(filled.join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi"), "chosen")
    links = candidate_links(chosen, similarity, repeats, depth, limit)
    loose = components(stage(links, "links"))
    sizes = loose.groupBy("class_id").agg(F.count("*").alias("m"))
    # sets of the candidates only, once for every block they are compared with
    members = loose.join(sizes, "class_id").join(chosen.select(F.col("uid").alias("id"), "doc_id", "body", "sig"), "id").select(
        F.col("id").alias("member"), F.col("doc_id").alias("_doc"), "body", "sig", F.col("class_id").alias("comp"),
        F.ceil(F.col("m") / block).cast("int").alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    # very many rows may share an identifier, or have none: only those with the same text meet
    bodies = rows.select("doc_id", "text", F.xxhash64("text").alias("_body"))
    texts = bodies.join(members, (F.col("_body") == F.col("body")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select(
        F.col("member").alias("uid"), "comp", "blocks", "block", "sig", "text"
    )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = text_sets(batch["text"])
                # several rows may have the identifier; the signature tells which is meant
                keep = [i for i, (s, sig) in enumerate(zip(sets, batch["sig"].to_pylist(), strict=True)) if signature(s) == sig]
                part = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in ("uid", "comp", "blocks", "block")), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                    ["uid", "comp", "blocks", "block", "tokens"],
                )

    held = texts.mapInArrow(tokens, "uid long, comp long, blocks int, block int, tokens binary")
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "uid", "block", "tokens"
    )
    exact = stage(_exact(pairs, similarity), "exact")
    classes = stage(components(exact.where("b is not null").select("a", "b")), "classes")
    partners = exact.where("n is not null").groupBy("a").agg(F.sum("n").alias("n_links"))

    same = every.select("uid", "doc_id", "sig", "n").join(reps, "sig", "left")
    joined = (
        same.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("uid")))
        .join(classes.withColumnRenamed("id", "rep"), "rep", "left")
        .join(partners.withColumnRenamed("a", "rep"), "rep", "left")
        .select(
            "uid", "doc_id", "rep", F.coalesce("class_id", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )
    )
    out = stage(joined, "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid"))
    firsts = out.groupBy("class").agg(first.alias("_first"))
    # a class of very many rows is a hot key on one side only, which Spark splits
    classed = out.join(firsts, "class")
    rep_ids = out.groupBy("rep").agg(F.min("doc_id").alias("rep_id"))
    result = classed.join(rep_ids, "rep").select(
        "uid", "doc_id", F.col("_first.doc_id").alias("class_id"), "rep_id", "n_links", (F.col("uid") == F.col("_first.uid")).alias("kept")
    )
    for used in (every, reps, chosen, exact, classes):
        drop_stage(used)
    return result


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, all columns kept."""
    uid = unused(docs, "_uid")
    held = stage(docs.withColumn(uid, F.monotonically_increasing_id()), "texts")
    kept = near_duplicates(held, uid_col=uid).where("kept").select(F.col("uid").alias(uid))
    return held.join(kept, uid, "left_semi").drop(uid)
