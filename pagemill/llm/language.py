"""Language identification by nearest centroid (operator 1).

A text is the TF-IDF vector of its hashed character n-grams (1 to 3 code points, letters
only, in lower case), scaled to length one. Every language has several centroids, found by
spherical k-means over vectors of its own texts, so that a language with unlike kinds of
text is not one blurred mean. A text gets the language of the centroid with the highest
cosine, unless that cosine is below the centroid's reach (``rejected``).

Document frequencies come from all training texts, added up per task; the centroids are
fitted on ``sample`` texts per language (a stated bound), chosen by the hash of their
identifier. The model, languages x clusters x ``2**BITS`` numbers, is all that tasks get.

Edge cases: a null text or one without letters is ``und`` with score 0. A training row
without a language is not used. If there is nothing to learn from, every text is ``und``.
Repeated rows are answered each. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import crc_bucket, mix

BITS = 12
CLUSTERS = 3
SAMPLE = 300
SHARPNESS = 30.0
UNDETERMINED = "und"


@dataclass
class Centroids:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    vectors: np.ndarray  # centroid x feature, rows of length one
    reach: np.ndarray  # lowest cosine that a centroid accepts
    idf: np.ndarray


def _letters(text: str) -> np.ndarray:
    """Code points in lower case; one blank for every run of other characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    word = (points >= 97) & (points <= 122)
    other = np.flatnonzero(points >= 128)
    if len(other):  # few distinct ones per text
        kinds, place = np.unique(points[other], return_inverse=True)
        word[other] = np.array([chr(p).isalpha() for p in kinds])[place]
    if not word.any():
        return np.zeros(0, np.uint32)
    points = np.where(word, points, 32)
    stay = word.copy()
    stay[1:] |= word[:-1]
    return points[stay]


def counts_of(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed n-grams; null for a text without letters."""
    points = _letters(text) if text else np.zeros(0, np.uint32)
    if len(points) == 0:
        return None
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    shift = np.uint64(64 - bits)
    grams, out = points, np.zeros(1 << bits, np.float32)
    for n in range(3):
        if n:
            grams = grams[:-1] * np.uint64(0x100000001B3) + points[n:]
        if len(grams):
            out += np.bincount((mix(grams, n) >> shift).astype(np.int64), minlength=1 << bits)
    return out


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: in how many texts each feature occurs, and how many texts."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            counts = counts_of(text.as_py())
            if counts is not None:
                total += counts > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS)), pa.array([n, *total])], ["feature", "n"])


def _cosines(texts: list, model: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Cosines with all centroids, and which texts have letters."""
    known = np.zeros(len(texts), bool)
    cosines = np.zeros((len(texts), len(model.owner)), np.float32)
    for lo in range(0, len(texts), 128):
        some = [counts_of(t) for t in texts[lo : lo + 128]]
        at = [i for i, c in enumerate(some) if c is not None]
        if at:
            known[lo + np.array(at)] = True
            cosines[lo + np.array(at)] = _scaled(np.stack([some[i] for i in at]), model.idf) @ model.vectors.T
    return cosines, known


def _cluster(vectors: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; starts from rows far from each other, so that it is the same
    on every run. Returns centroids and the lowest cosine each has to its rows."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(clusters, len(vectors)):
        far = (vectors @ vectors[chosen].T).max(axis=1)
        chosen.append(int(far.argmin()))
    centers = vectors[chosen]
    for _ in range(rounds):
        nearest = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == k].sum(axis=0) if (nearest == k).any() else centers[k] for k in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    best = vectors @ centers.T
    nearest = best.argmax(axis=1)
    reach = np.array([
        np.quantile(best[nearest == k, k], 0.01) if (nearest == k).any() else 1.0 for k in range(len(centers))
    ])
    return centers, reach


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Centroids | None:
    """Centroids from ``doc_id, text, lang``; rows without a language don't count."""
    train = train.where(F.col("lang").isNotNull())
    totals = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    idf_rows = train.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {r["feature"]: r["n"] for r in idf_rows.collect()}
    texts = max(found.pop(-1, 0), 1)
    idf = np.log((1 + texts) / (1 + np.array([found.get(i, 0) for i in range(1 << BITS)]))) + 0.01

    # at most about ``sample`` rows per language reach the driver, as counts
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang.as_py(), counts_of(t.as_py())) for lang, t in zip(batch["lang"], batch["text"], strict=True)]
            rows = [(lang, np.minimum(c, 65535).astype(np.uint16).tobytes()) for lang, c in rows if c is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "counts"]
            )

    # a language of few rows gives all of them, others their lowest hashes
    picked = train.where(place < share[F.col("lang")]).select("lang", "text").mapInArrow(vectors, "lang string, counts binary")
    by_lang: dict[str, list[np.ndarray]] = {}
    for row in picked.collect():
        by_lang.setdefault(row["lang"], []).append(np.frombuffer(row["counts"], np.uint16))
    languages = sorted(by_lang)
    owner, centers, reach = [], [], []
    for k, lang in enumerate(languages):
        found_centers, found_reach = _cluster(_scaled(np.stack(by_lang[lang]).astype(np.float32), idf.astype(np.float32)), clusters)
        owner += [k] * len(found_centers)
        centers.append(found_centers)
        reach.append(found_reach)
    if not centers:
        return None
    return Centroids(
        languages, np.array(owner), np.concatenate(centers).astype(np.float32), np.concatenate(reach), idf.astype(np.float32)
    )


def predict(docs: DataFrame, model: Centroids | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``lang_pred, score, cosine, rejected``. ``score`` is the share of the
    winning language when cosines are turned into probabilities."""
    names = [*keep, "lang_pred", "score", "cosine", "rejected"]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("cosine", "double").add("rejected", "boolean")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            lang, score, top, far = [UNDETERMINED] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
            if model is not None and n:
                cosines, known = _cosines(batch["text"].to_pylist(), model)
                best = cosines.argmax(axis=1)
                per = np.stack([cosines[:, model.owner == k].max(axis=1) for k in range(len(model.languages))], axis=1)
                odds = np.exp(SHARPNESS * (per - per.max(axis=1, keepdims=True)))
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                top = np.where(known, cosines.max(axis=1), 0.0).astype(float)
                far = ~known | (top < model.reach[best])
                lang = [model.languages[model.owner[b]] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(top, pa.float64()), pa.array(far)],
                names,
            )

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(answer, schema)


def identify(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """Learn from the rows outside fold ``held_out`` and answer all rows."""
    fold = crc_bucket("doc_id", folds)
    model = fit(docs.where(fold != held_out).select("doc_id", "text", "lang"))
    answers = predict(docs.select("doc_id", "text", (fold == held_out).alias("held_out")), model, ("doc_id", "held_out"))
    return answers.select("doc_id", "held_out", "lang_pred", "score", "cosine", "rejected")
