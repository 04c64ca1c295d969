"""Language-model scores by Katz backoff (operator 8).

Tokens are words (runs of bytes other than ASCII white space, A-Z as a-z) and one end per
text; contexts before a text's first word are filled with a start mark. Counts of n-grams up
to ``order`` come from the training texts. Counts up to ``CUTOFF`` are discounted by
Good-Turing, from the counts of counts of all n-grams of that length; what discounting frees is
given to the words not seen after a history, in proportion to the model of the next lower
order, with weights that make every history's probabilities sum to one exactly. A word never seen in training
is the one unknown word of the lowest order, as in ``base_score``.

How it runs. Texts are encoded once in chunks of some ``CHUNK`` tokens: distinct words and
a run of small numbers, the frequent words' first. The first order counts the words in buckets by their hash and
numbers them: place by count in the bucket, times the number of buckets, plus the bucket. From then on a word is
its number, so an n-gram is a history and a number, small and exact (a history of one word is that word's number; longer ones
are 64-bit hashes of numbers). For each order, a chunk sends its distinct n-grams, with what
training counts it has and their probability one order lower, to buckets by the
history; a bucket merges them into its part of the n-gram table (a row of the written
table), and, once counts of counts are known, answers every chunk with probabilities. So a
token is counted in its chunk before anything moves, an n-gram moves once per chunk as
a few bytes (differences and byte planes, compressed), and evaluation needs no row per token. Chunks are a table bucketed by
chunk: answers come to them, texts never move again. Histories so frequent that they may crowd a
bucket (at most ``HEAVY`` of them, by count) are dealt by the whole n-gram instead, and
their sums, one row each, are added up across buckets.

A chunk has a message for each bucket, and both grow with the input: their bytes follow the n-grams, their
number its square (some ten thousand in 0.5 GB of text). ``ORDER`` is 2, the bigram model: a trigram model has its n-grams
to write and send as well, which by estimate (not measured) exceeds the disk that the query is allowed.

Edge cases: a null or empty text is the end alone. Without training texts every token is
unknown with probability one. Repeated rows are counted and scored each. A null identifier
counts as the empty text for the fold. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import buffers, crc_bucket, drop_path, drop_stage, mix, slices, word_hashes
from pagemill.operators.staging import shared_folder, stage

ORDER = 2
CUTOFF = 5
CHUNK = 1_000_000
BUCKET = 1_500_000
HEAVY = 256
_END = np.uint64(0x1D872B41A9C3F5E7)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNKS = "chunk long, doc_id array<long>, held array<boolean>, sizes array<int>, words binary, seq binary, n_train long, n_tokens long"
_CODED = "chunk long, doc_id array<long>, held array<boolean>, sizes array<int>, seq binary, numbers binary, seen binary, lows binary"
_SENT = "bucket int, chunk long, hist binary, runs binary, words binary, counts binary, codes binary, lows binary"
_MERGED = (
    "bucket int, hist binary, runs binary, words binary, counts binary, low binary, chunks array<long>, places array<binary>, "
    "freq array<long>, heavy array<long>"
)
_REPLY = "chunk long, bucket int, logs binary, counts binary, numbers binary"


def _pack(x: np.ndarray) -> bytes:
    """Compressed byte planes: the high bytes of small numbers cost next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _open(data: bytes, kind) -> np.ndarray:
    import zstandard

    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _open_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_open(data, np.uint64), dtype=np.uint64)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row is a chunk or a bucket, and its columns are large."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_chunk(df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """``df`` as a table bucketed by chunk, which a join on it reads where it lies; its name and path."""
    spark = df.sparkSession
    name = f"katz_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, "chunk").option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def _drop_table(df: DataFrame, name: str, path: str) -> None:
    df.sparkSession.sql(f"DROP TABLE {name}")
    drop_path(df.sparkSession, path)


def encode(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of ``doc_id, held_out, text``: word hashes and, per token, the place of its word."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            tokens = np.concatenate([k[3] for k in kept])
            words, seq, n = np.unique(tokens, return_inverse=True, return_counts=True)
            often = np.argsort(-n, kind="stable")
            rank = np.empty_like(often)
            rank[often] = np.arange(len(often))
            words, seq = words[often], rank[seq]
            ids = [x for k in kept for x in k[0]]
            held = [x for k in kept for x in k[1]]
            sizes = np.concatenate([k[2] for k in kept])
            trained = int(sizes[~np.array(held, bool)].sum())
            number += 1
            columns = [[number], [ids], [held], [sizes.tolist()], [words.tobytes()], [_pack(seq.astype(np.uint32))], [trained], [len(tokens)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(_CHUNKS))

        for whole in batches:
            for batch in slices(whole):
                words, counts = word_hashes(*buffers(batch["text"]))
                ends = np.cumsum(counts)
                tokens = np.insert(words, ends, _END) if len(counts) else words
                kept.append((batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), counts + 1, tokens))
                size += len(tokens)
                if size >= chunk:
                    yield out()
                    kept.clear()
                    size = 0
        if kept:
            yield out()

    return docs.mapInArrow(answer, _CHUNKS)


class _Grams:
    """The distinct n-grams of a chunk in the order in which they are sent to buckets. A word is
    its hash in the first order and its number later; history 0 is the start of a text."""

    def __init__(self, row: dict, n: int, buckets: int, heavy: np.ndarray):
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.seq = _open(row["seq"], np.uint32)
        train = np.repeat(~np.array(row["held"], bool), self.sizes)
        kinds = np.frombuffer(row["words"], np.uint64) if n == 1 else _open(row["numbers"], np.uint64)
        if n == 1:
            inverse, words = self.seq, kinds
            hist = np.zeros(len(words), np.uint64)
            bucket = (mix(words, 21) % np.uint64(buckets)).astype(np.int64)
        else:
            # a history is the n-gram one order lower that ends before the token
            local, key = self.seq, kinds[self.seq] if n > 2 else None
            for i in range(2, n + 1):
                pair = np.zeros(len(self.seq), np.int64)
                pair[1:] = local[:-1]
                pair[1:] += 1
                pair[self.starts] = 0
                pair <<= 32
                pair |= self.seq
                _, self.first, inverse = np.unique(pair, return_index=True, return_inverse=True)
                del pair
                local = inverse = inverse.astype(np.uint32)
                at = self.first if i == n else slice(None)
                last = np.arange(-1, len(self.seq) - 1)[at]
                hist = kinds[self.seq[last]] if i == 2 else key[last]
                hist[np.isin(last + 1, self.starts, assume_unique=True)] = 0
                if i < n:
                    key = mix(hist * _STEP + kinds[self.seq])
            words = kinds[self.seq[self.first]]
            bucket = (mix(hist, 21) % np.uint64(buckets)).astype(np.int64)
            crowd = np.isin(hist, heavy) | (hist == 0)
            spread = (mix(hist * _STEP + words, 22) % np.uint64(buckets)).astype(np.int64) + buckets
            bucket = np.where(crowd, spread, bucket)
        counts = np.bincount(inverse, weights=train, minlength=len(words)).astype(np.int64)
        order = np.lexsort((words, hist, bucket))
        self.place = np.empty_like(order)
        self.place[order] = np.arange(len(order))
        self.bucket, self.words, self.hist, self.counts = bucket[order], words[order], hist[order], counts[order]
        self.order = order
        self.inverse = inverse

    @property
    def at(self) -> np.ndarray:
        """Of each token, the place of its n-gram."""
        return self.place[self.inverse]


def _discounts(freq: list[int]) -> np.ndarray:
    """Good-Turing factor for counts 0..CUTOFF; ``freq[r]`` n-grams occur r times."""
    out = np.ones(CUTOFF + 1)
    top = (CUTOFF + 1) * freq[CUTOFF + 1] / freq[1] if freq[1] else 1.0
    for r in range(1, CUTOFF + 1):
        d = 0.0
        if freq[r] and freq[r + 1] and top < 1:
            d = ((r + 1) * freq[r + 1] / freq[r] / r - top) / (1 - top)
        # too few n-grams to tell: half a count less
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _send(chunks: DataFrame, n: int, buckets: int, heavy: np.ndarray, heavy_before: np.ndarray) -> DataFrame:
    """Messages of each chunk to each bucket. From the third order on, ``answers`` holds the replies one order lower."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams = _Grams(row, n, buckets, heavy)
            if n == 1:
                low = np.zeros(len(grams.words))
            elif n == 2:
                low = _open(row["lows"], np.float64)[grams.seq[grams.first[grams.order]]]
            else:
                before = _Grams(row, n - 1, buckets, heavy_before)
                low = _replies(row["answers"])[0][before.at[grams.first[grams.order]]]
            edges = np.flatnonzero(np.diff(grams.bucket, prepend=-1, append=-1))
            rows = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                hist = grams.hist[lo:hi]
                new = np.flatnonzero(np.concatenate(([True], hist[1:] != hist[:-1])))
                values, codes = np.unique(low[lo:hi], return_inverse=True)
                rows.append((
                    int(grams.bucket[lo]), row["chunk"], _pack_sorted(hist[new]), _pack(np.diff(new, append=hi - lo).astype(np.uint32)),
                    _pack(grams.words[lo:hi]), _pack(grams.counts[lo:hi].astype(np.uint32)), _pack(codes.astype(np.uint32)), _pack(values),
                ))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _names(_SENT))

    return chunks.mapInArrow(answer, _SENT)


def _merge(sent: DataFrame, n: int, parts: int, buckets: int, crowd: int) -> DataFrame:
    """One row per bucket: its part of the n-gram table, and where each chunk's n-grams are
    in it. ``freq``: all tokens, distinct n-grams, then n-grams by count up to ``CUTOFF + 1``.
    ``heavy``: n-grams that are frequent histories of the next order."""

    def merged(rows: list[dict]) -> pa.RecordBatch:
        hist = np.concatenate([np.repeat(_open_sorted(r["hist"]), _open(r["runs"], np.uint32)) for r in rows])
        parts = [_open(r["words"], np.uint64) for r in rows]
        words = np.concatenate(parts)
        counts = np.concatenate([_open(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        low = np.concatenate([_open(r["lows"], np.float64)[_open(r["codes"], np.uint32)] for r in rows])
        order = np.lexsort((words, hist))
        h, k = hist[order], words[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
        first = np.flatnonzero(fresh)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        total = np.add.reduceat(counts[order], first)
        uh, uk = h[first], k[first]
        new = np.flatnonzero(np.concatenate(([True], uh[1:] != uh[:-1])))
        places, at = [], 0
        for part in parts:
            places.append(_pack(np.diff(which[at : at + len(part)], prepend=0).astype(np.uint32)))
            at += len(part)
        freq = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()]
        keys = _numbers(total, rows[0]["bucket"], buckets) if n == 1 else mix(uh * _STEP + uk)
        values = [
            [rows[0]["bucket"]], [_pack_sorted(uh[new])], [_pack(np.diff(new, append=len(uh)).astype(np.uint32))], [_pack(uk)],
            [_pack(total.astype(np.uint32))], [_pack(low[order][first])], [[r["chunk"] for r in rows]], [places], [freq],
            [keys[total >= crowd].view(np.int64).tolist()],
        ]
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], _names(_MERGED))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["bucket"] != row["bucket"]:
                yield merged(held)
                held = []
            held.append(row)
        if held:
            yield merged(held)

    return sent.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(answer, _MERGED)


def _numbers(counts: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Number of each word of a bucket, from 1; frequent words get small ones."""
    often = np.argsort(-counts, kind="stable")
    out = np.empty(len(counts), np.uint64)
    out[often] = np.arange(len(counts), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)
    return out


def _table(row: dict, discount: np.ndarray) -> tuple[np.ndarray, ...]:
    """Histories of a bucket row, run of each n-gram, counts, discounted counts, lower probabilities."""
    hist = _open_sorted(row["hist"])
    runs = _open(row["runs"], np.uint32).astype(np.int64)
    counts = _open(row["counts"], np.uint32).astype(np.int64)
    star = np.where(counts <= CUTOFF, discount[np.minimum(counts, CUTOFF)] * counts, counts)
    return hist, np.repeat(np.arange(len(hist)), runs), counts, star, 10.0 ** _open(row["low"], np.float64)


def _sums(which: np.ndarray, size: int, counts: np.ndarray, star: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per history: training count, discounted count, lower probability of the seen words."""
    seen = counts > 0
    return np.stack([np.bincount(which, weights=x, minlength=size) for x in (counts, star * seen, low * seen)], axis=1)


def _logs(which: np.ndarray, counts: np.ndarray, star: np.ndarray, low: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """log10 of the backed-off probability of each n-gram."""
    total, freed_to, seen_low = sums[:, 0], sums[:, 1], sums[:, 2]
    none = total == 0
    whole = np.where(none, 1.0, total)
    # if no count was discounted, one more imaginary token makes room
    whole = np.where(freed_to >= whole * (1 - 1e-9), whole + 1, whole)
    left = 1 - freed_to / whole
    rest = 1 - seen_low
    # nothing is left to back off to: the seen words share everything
    full = rest <= 1e-9
    alpha = np.where(none, 1.0, np.where(full, 0.0, left / np.where(full, 1.0, rest)))
    scale = np.where(full & ~none, whole / np.maximum(freed_to, 1e-300), 1.0)
    p = np.where(counts > 0, star / whole[which] * scale[which], alpha[which] * low)
    return np.log10(np.maximum(p, 1e-300))


def _reply(
    merged: DataFrame, discount: np.ndarray, buckets: int, lowest: tuple[float, float] | None = None,
    crowds: dict[int, list[float]] | None = None, kind: type = np.float64,
) -> DataFrame:
    """``chunk, bucket, logs`` for every chunk that sent to a bucket, in the first order with ``counts`` and
    ``numbers`` of words. ``lowest``: for the first order, its training tokens and the probability of the unknown word."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hist, which, counts, star, low = _table(row, discount)
            if lowest is not None:
                p = np.where(counts > 0, star / max(lowest[0], 1e-300), lowest[1])
                logs = np.log10(np.maximum(p, 1e-300))
                numbers = _numbers(counts, row["bucket"], buckets)
            else:
                sums = _sums(which, len(hist), counts, star, low)
                if row["bucket"] >= buckets:
                    sums = np.array([crowds[h] for h in hist.view(np.int64).tolist()])
                logs = _logs(which, counts, star, low, sums)
            out, row_chunks = [], row["chunks"]
            for packed in row["places"]:
                at = np.cumsum(_open(packed, np.uint32).astype(np.int64))
                words = (_pack(counts[at].astype(np.uint32)), _pack(numbers[at])) if lowest is not None else (b"", b"")
                out.append((row_chunks[len(out)], row["bucket"], _pack(logs[at].astype(kind)), *words))
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], _names(_REPLY))

    return merged.mapInArrow(answer, _REPLY)


def _replies(answers: list[dict], kind=np.float64) -> tuple[np.ndarray, ...]:
    """log10 probabilities (in the first order counts and numbers as well) in the order in which the chunk sent its n-grams."""
    rows = sorted(answers, key=lambda a: a["bucket"])
    logs = np.concatenate([_open(a["logs"], kind) for a in rows]).astype(np.float64)
    if not rows[0]["numbers"]:
        return (logs,)
    return logs, np.concatenate([_open(a["counts"], np.uint32) for a in rows]), np.concatenate([_open(a["numbers"], np.uint64) for a in rows])


def _gathered(replies: DataFrame) -> DataFrame:
    """Replies by chunk; as large as the chunk's own n-grams."""
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "logs", "counts", "numbers")).alias("answers"))


def _coded(chunks: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """Chunks whose words have their numbers, training counts and log10 probabilities."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                place = _Grams(row, 1, buckets, np.zeros(0, np.uint64)).place
                logs, counts, numbers = _replies(row["answers"])
                packed = [_pack(numbers[place]), _pack(counts[place]), _pack(logs[place])]
                same = [one[c] for c in ("chunk", "doc_id", "held", "sizes", "seq")]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([p], pa.binary()) for p in packed)], _names(_CODED))

    return chunks.join(_gathered(replies), "chunk").mapInArrow(answer, _CODED)


def _crowds(merged: DataFrame, discount: np.ndarray, buckets: int) -> dict[int, list[float]]:
    """Sums of the heavy histories over all buckets; at most ``HEAVY`` and the start mark."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hist, which, counts, star, low = _table(row, discount)
            sums = _sums(which, len(hist), counts, star, low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hist.view(np.int64)), *(pa.array(sums[:, i]) for i in range(3))], ["hist", "a", "b", "c"]
            )

    heavy = merged.where(F.col("bucket") >= buckets).mapInArrow(answer, "hist long, a double, b double, c double")
    rows = heavy.groupBy("hist").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).collect()
    return {r["hist"]: [r["a"], r["b"], r["c"]] for r in rows}


def katz_scores(docs: DataFrame, order: int = ORDER, chunk: int = CHUNK, bucket: int = BUCKET, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of ``doc_id,
    held_out, text``; learns from rows that are not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    chunks, *chunks_at = _by_chunk(encode(texts, chunk), "chunks")
    sizes = chunks.agg(F.sum("n_train").alias("n"), F.sum("n_tokens").alias("all")).first()
    trained, every = int(sizes["n"] or 0), int(sizes["all"] or 0)
    buckets = max(8, -(-every // bucket))
    crowd = max(trained // heavy, 1000)
    heavy_now = heavy_before = np.zeros(0, np.uint64)
    state = chunks
    for n in range(1, order + 1):
        merged = stage(_merge(_send(state, n, buckets, heavy_now, heavy_before), n, 2 * buckets, buckets, crowd), f"grams{n}")
        counted = [
            int(x or 0) for x in merged.select(*[F.col("freq")[i].alias(f"f{i}") for i in range(CUTOFF + 3)])
            .agg(*[F.sum(f"f{i}") for i in range(CUTOFF + 3)]).first()
        ]
        freq = [0, *counted[2:]]
        discount = _discounts(freq)
        if n < order:  # at most ``heavy`` histories of the next order
            heavy_before = heavy_now
            heavy_now = np.array([r["k"] for r in merged.select(F.explode("heavy").alias("k")).collect()], np.int64).view(np.uint64)
        if n == 1:
            tokens, vocabulary = counted[0], counted[1]
            whole, freed = float(tokens), _freed(discount, freq)
            if tokens and freed <= 0:
                whole, freed = tokens + 1.0, 1.0
            replies = _reply(merged, discount, buckets, (whole, freed / whole if tokens else 1.0))
            coded = state = _by_chunk(_coded(chunks, replies, buckets), "coded")[0]
            _drop_table(chunks, *chunks_at)
            drop_stage(merged)
        else:
            replies = _reply(merged, discount, buckets, None, _crowds(merged, discount, buckets), np.float32 if n == order else np.float64)
            if n < order:
                replies = stage(replies, "replies")
                drop_stage(merged)
            state = coded.join(_gathered(replies), "chunk")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams = _Grams(row, max(order, 2), buckets, heavy_now)
            counts = _open(row["seen"], np.uint32)
            base = np.log10((counts.astype(np.float64) + 1) / (tokens + vocabulary + 1))
            logs, places = (_replies(row["answers"], np.float32)[0], grams.at) if order > 1 else (_open(row["lows"], np.float64), grams.seq)
            seen, base, score = (
                np.add.reduceat(x[at], grams.starts) for x, at in (((counts > 0).astype(np.int64), grams.seq), (base, grams.seq), (logs, places))
            )
            columns = [
                pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(grams.sizes, pa.int64()),
                pa.array(seen), pa.array(np.full(len(grams.sizes), tokens), pa.int64()), pa.array(base), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return state.mapInArrow(
        answer, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _freed(discount: np.ndarray, freq: list[int]) -> float:
    """Tokens that discounting takes from the seen words."""
    return float(sum((1 - discount[r]) * r * freq[r] for r in range(1, CUTOFF + 1)))


def score_documents(docs: DataFrame, held_out: int = 2, folds: int = 7, order: int = ORDER) -> DataFrame:
    """Scores of all texts by a model of those outside fold ``held_out``."""
    fold = crc_bucket("doc_id", folds)
    return katz_scores(docs.select("doc_id", (fold == held_out).alias("held_out"), "text"), order)
