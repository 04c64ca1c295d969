"""Text quality without labels: weak labellers, their accuracies by EM, a hashed linear scorer
(operator 3).

Seven overlapping heuristics vote bad or nothing, one votes good or nothing on every text. How often each is
right is not known; expectation-maximisation estimates it (with the share of bad texts) from
the counts of vote patterns over *all* texts, counted by Spark: at most 3^8 patterns, whatever the input.
The posterior of a pattern is the soft label of its texts. On about ``SAMPLE`` texts (a
stated bound, spread evenly over patterns) a logistic model learns these labels from hashed
features of the text's shape: runs of character classes with their neighbours, repeated
words and lines. The model scores every text; a text is rejected below ``threshold``.

Edge cases: a null or empty text gets no votes and is scored like any other; being short is no fault. Ties
at the threshold stay. An empty table gives an empty result. If no text is doubtful the
model keeps all. Other columns of the input are not read by :func:`quality`;
:func:`good_documents` hands all of them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import mix, unused

BITS = 11
SAMPLE = 6000
THRESHOLD = 0.5
RIDGE = 1e-4
DOUBT = 0.2
LABELLERS = ("repeated_words", "repeated_lines", "capitals", "signs", "tables", "stutter", "word_length", "prose")
BASE_RATE = 0.1  # where EM starts, and the class it calls bad

# character classes of bytes: lower, upper, digit, blank, line end, sentence signs, other signs
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5


def measures(text: str | None, shape: bool = True) -> tuple[list[int], np.ndarray | None]:
    """Votes (1 bad, -1 good, 0 none) in the order of ``LABELLERS``, and hashed features."""
    text = text or ""
    words = text.split()
    n = len(words)
    body = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = _CLASS[body]
    share = np.bincount(kinds, minlength=7) / max(len(kinds), 1)
    letters = share[0] + share[1]
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words)) / max(n, 1)
    line_share = len(set(lines)) / max(len(lines), 1)
    stutter = sum(map(str.__eq__, words, words[1:])) / max(n - 1, 1)
    bars = text.count(" | ") / max(n, 1)
    size = (len(text) - max(n - 1, 0)) / max(n, 1)

    bad = (
        n >= 20 and distinct < min(0.3, 3 / np.sqrt(n)),
        len(lines) >= 5 and line_share < 0.5,
        letters > 0.1 and n >= 5 and share[1] > 0.4 * letters,
        n >= 5 and share[6] > 0.08,
        n >= 5 and bars > 0.1,
        n >= 10 and stutter > 0.2,
        n >= 5 and (size < 2 or size > 15),
    )
    few_repeats = stutter * (n - 1) <= 3 + 0.03 * n
    prose = n > 0 and not any(bad) and not bars and few_repeats and share[6] < 0.02 and share[1] < 0.35 * letters
    votes = [*map(int, bad), -int(prose)]
    if not shape:
        return votes, None
    # shape: classes with runs folded to one, in threes
    features = np.zeros(1 << BITS, np.float32)
    if len(kinds):
        fold = kinds[np.flatnonzero(np.diff(kinds, prepend=255))].astype(np.uint64)
        for width in (1, 2, 3):
            if len(fold) >= width:
                code = sum(fold[i : len(fold) - width + 1 + i] * np.uint64(8**i) for i in range(width))
                slot = (mix(code, width) >> np.uint64(64 - BITS)).astype(np.int64)
                features += np.bincount(slot, minlength=1 << BITS) / len(fold)
    extra = {"one": 1.0, "distinct": distinct if n >= 20 else 0.6, "lines": line_share if len(lines) >= 5 else 1.0,
             "stutter": stutter, "bars": bars, "length": min(n, 50) / 50}
    extra |= {f"share{i}": float(x) for i, x in enumerate(share)}
    slots = mix(np.arange(1, len(extra) + 1, dtype=np.uint64), 77) >> np.uint64(64 - BITS)
    np.add.at(features, slots.astype(np.int64), np.array(list(extra.values()), np.float32))
    return votes, features


def _pattern(votes: list[int]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def _votes(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


@dataclass
class Labels:
    """Chance of each vote given the class (class, labeller, vote), and the share of bad texts."""

    chance: np.ndarray
    bad: float

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of being bad, per pattern."""
        votes = _votes(pattern) + 1
        logs = np.log(self.chance)[:, np.arange(len(LABELLERS)), votes].sum(axis=2)
        logs += np.log([1 - self.bad, self.bad])[:, None]
        bad = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        # nobody's silence condemns: without a single bad vote a text is at most doubtful
        return np.where((votes == 2).any(axis=1), bad, np.minimum(bad, DOUBT))


def estimate(pattern: np.ndarray, n: np.ndarray, rounds: int = 200) -> Labels:
    """Accuracies of the labellers by EM over pattern counts; starts from a vote of all."""
    votes = _votes(pattern)
    bad = np.where((votes == 1).any(axis=1), 0.9, 0.02)
    labels = Labels(np.full((2, len(LABELLERS), 3), 1 / 3), BASE_RATE)
    for _ in range(rounds):
        weight = np.stack([(1 - bad) * n, bad * n])
        counts = np.stack([(weight[:, :, None] * (votes == v)).sum(axis=1) for v in (-1, 0, 1)], axis=2)
        labels.chance = (counts + 0.5) / (counts.sum(axis=2, keepdims=True) + 1.5)
        # "bad" stays the class in which bad votes are likelier: a labeller may be useless, not reversed
        flip = labels.chance[1, :, 2] < labels.chance[0, :, 2]
        labels.chance[:, flip] = labels.chance[:, flip].mean(axis=0, keepdims=True)
        labels.bad = float(np.clip(weight[1].sum() / max(n.sum(), 1), 1e-4, 0.6))
        after = labels.posterior(pattern)
        if np.abs(after - bad).max() < 1e-6:
            break
        bad = after
    return labels


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression with soft labels by Newton steps, over the features in use."""
    used = np.flatnonzero(np.abs(x).max(axis=0) > 0)
    scale = np.maximum(np.sqrt((x[:, used] ** 2).mean(axis=0)), 1e-3)
    z = (x[:, used] / scale).astype(np.float64)
    w = np.zeros(len(used))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        pull = RIDGE * w
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + RIDGE * np.eye(len(used))
        step = np.linalg.solve(curve, (weight * (y - p)) @ z - pull)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    out = np.zeros(x.shape[1], np.float32)
    out[used] = w / scale
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    labels: Labels


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Accuracies from all texts; weights from about ``sample`` of them."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pattern(measures(t.as_py(), shape=False)[0]) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["pattern"])

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)).cast("int")
    placed = docs.select(F.col("text").cast("string").alias("text"), place.alias("place"))
    rows = placed.select("text").mapInArrow(patterns, "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    if not rows:
        return None
    pattern = np.array([r["pattern"] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    labels = estimate(pattern, n)
    # rare patterns give all their texts, common ones an even share of the sample
    room = max(sample // len(rows), 20)
    share = {int(p): min(1.0, room / c) for p, c in zip(pattern, n, strict=True)}
    widest = max(share.values())
    belief = dict(zip(pattern.tolist(), labels.posterior(pattern).tolist(), strict=True))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, at in zip(batch["text"], batch["place"].to_pylist(), strict=True):
                if at < widest * (1 << 20):
                    p = _pattern(measures(text.as_py(), shape=False)[0])
                    if at < share.get(p, 0) * (1 << 20):
                        kept.append((p, measures(text.as_py())[1].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.binary())], ["pattern", "features"]
            )

    picked = placed.mapInArrow(chosen, "pattern int, features binary").collect()
    x = np.stack([np.frombuffer(r["features"], np.float32) for r in picked]) if picked else np.zeros((1, 1 << BITS), np.float32)
    y = np.array([1 - belief[r["pattern"]] for r in picked] or [1.0], np.float32)
    sizes = np.array([1 / share[r["pattern"]] for r in picked] or [1.0])
    # every text counts as often as its like, bad and good half each
    good = sizes * y
    evil = sizes * (1 - y)
    balance = 0.5 * good / max(good.sum(), 1e-9) + 0.5 * evil / max(evil.sum(), 1e-9)
    return Scorer(_train(x, y, balance.astype(np.float32)), labels)


def quality(docs: DataFrame, model: Scorer | None = None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` (1 good), ``p_bad`` (what the labellers say) and ``kept``."""
    model = model or fit(docs)
    schema = docs.select(*keep).schema.add("score", "double").add("p_bad", "double").add("kept", "boolean")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [measures(t.as_py()) for t in batch["text"]]
            p = np.array([_pattern(v) for v, _ in both], np.int64)
            linear = np.array([float(f @ model.weights) for _, f in both])
            score = 1 / (1 + np.exp(-np.clip(linear, -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(score, pa.float64()), pa.array(model.labels.posterior(p), pa.float64()), pa.array(score >= threshold)],
                [*keep, "score", "p_bad", "kept"],
            )

    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(answer, schema)


def good_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the scorer keeps, with all their columns."""
    columns = docs.columns
    row = unused(docs, "_row")
    held = docs.select(*columns, F.struct(*columns).alias(row))
    model = fit(docs)
    if model is None:  # no rows
        return docs
    kept = quality(held.select(row, "text"), model, keep=(row,)).where("kept")
    return kept.select(f"{row}.*")
