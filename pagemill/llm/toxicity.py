"""Toxicity from a weighted lexicon (operator 6).

Texts are folded first: letters of other scripts that look alike (Cyrillic, Greek,
full-width) become plain a-z, digits and signs used for letters do too where they stand
inside a word with letters, and everything else is a blank. Accented Latin letters stay, as
they tell words of some languages apart. An Aho-Corasick automaton finds all terms and all
exception phrases in one pass over the folded text; matches inside an exception phrase
don't count. The sum of weights, divided by the logarithm of the length, goes through a
logistic curve.

The lexicon is the built-in list plus words and stems (a word's beginning, with more
letters after it) learned from labelled rows: those that occur in many toxic texts and far
more often there than in clean ones. Weights are smoothed log odds, counted by Spark.
Exception phrases are a term with its neighbour, seen in several clean texts and in no
toxic one. All of it is learned from about ``SAMPLE`` labelled rows at most, chosen by the
hash of their identifier (a stated bound); their identifiers are what is broadcast.

Edge cases: null and empty texts score as texts without a match. Rows with several labels count as
toxic if any says so. Without labels the built-in list is used with its prior weight.
Repeated rows are answered each. Other columns of the input are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import crc_bucket
from pagemill.operators.staging import stage

MIN_TEXTS = 4
MIN_SHARE = 0.03
RATIO = 15
STEM = (4, 8)
MAX_WORD = 64
LEARNED = 500
SAMPLE = 20_000
PRIOR_WEIGHT = 3.0

# Common English insults, letters that look alike, digits and signs for letters.
SEED = (
    "bastard", "bitch", "clown", "coward", "creep", "cretin", "crap", "degenerate", "disgusting", "dumb", "dumbass", "filth",
    "fool", "freak", "garbage", "idiot", "idiots", "imbecile", "jerk", "loser", "losers", "lowlife", "maggot", "moron", "morons", "parasite",
    "pathetic", "pig", "rat", "scum", "scumbag", "shit", "stupid", "trash", "vermin", "worthless", "asshole", "fuck", "fucking",
)
ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    slope: float = 1.0
    offset: float = -2.0


class _Fold(dict):
    """Character to what it is read as, learned on first sight: a-z, a digit or sign that
    may stand for a letter, or a blank."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        low = char.lower()
        plain = ALIKE.get(low) or unicodedata.normalize("NFKC", low)[:1]
        out = plain if plain in DIGITS or plain.isdigit() or plain.isalpha() else " "
        self[point] = out
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Words of the text as they read, one blank between and at both ends."""
    words = (text or "").translate(_FOLD).split()
    out = []
    for word in words:
        if not word.isalpha():
            bare = word.strip("!|$@")
            if bare.isalpha() or bare.isdigit() or not bare:
                word = bare
            else:  # a digit or sign reads as a letter only inside a word with letters
                word = "".join(DIGITS.get(c, c) for c in bare) if any(c.isalpha() for c in bare) else bare
        if word:
            out.append(word)
    return f" {' '.join(out)} "


class Matcher:
    """Weights of terms in a folded text, in one pass; built from a lexicon of bounded size."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            stem = term.endswith("*")
            key = f" {term[:-1]}" if stem else f" {term} "
            self.automaton.add_word(key, (len(key), weight, stem))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None, False))
        self.automaton.make_automaton()

    def total(self, text: str) -> float:
        if not len(self.automaton):
            return 0.0
        terms, spared = [], []
        for end, (size, weight, stem) in self.automaton.iter(text):
            if stem and text[end + 1] == " ":
                continue
            if weight is None:
                spared.append((end - size + 1, end))
            else:
                terms.append((end - size + 1, end, weight))
        if not spared:
            return sum(w for *_, w in terms)
        return sum(w for a, b, w in terms if not any(x <= a and b <= y for x, y in spared))

    def feature(self, text: str | None) -> float:
        read = folded(text)
        return self.total(read) / np.log2(8 + read.count(" "))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each word and each stem occurs, pre-added."""
    seen: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        counts = [pa.array([n[i] for n in seen.values()], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *counts], ["word", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            words = {w for w in folded(text.as_py()).split() if len(w) <= MAX_WORD}
            words |= {w[:k] + "*" for w in words for k in range(STEM[0], min(STEM[1] + 1, len(w)))}
            for word in words:
                seen.setdefault(word, [0, 0])[0 if toxic else 1] += 1
            if len(seen) > 300_000:
                yield out()
                seen.clear()
    yield out()


def learn(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from ``doc_id, text`` and ``doc_id, toxic`` (0 or 1), one mark per identifier."""
    share = min(1.0, sample / max(marks.count(), 1))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    # about ``sample`` identifiers, whatever the size of the table
    labelled = stage(docs.select("doc_id", "text").join(F.broadcast(marks.where(place < share)), "doc_id"), "labelled")
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({w: PRIOR_WEIGHT for w in SEED}, [])
    counts = (
        labelled.select("text", "toxic").mapInArrow(_words, "word string, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    odds = F.log2((F.col("toxic") + 0.1) / (bad + 0.2)) - F.log2((F.col("clean") + 0.1) / (good + 0.2))
    # in many toxic texts (one much-copied text is no evidence), and far more often than in clean ones
    strong = (F.col("toxic") >= max(MIN_TEXTS, MIN_SHARE * bad)) & (F.col("odds") >= np.log2(RATIO))
    found = counts.withColumn("odds", odds).where(strong | F.col("word").isin(*SEED))
    learned = {r["word"]: r for r in found.orderBy(F.desc("toxic"), "word").limit(LEARNED + len(SEED)).collect()}
    weights = {w: PRIOR_WEIGHT / 2 for w in SEED}
    for word, row in learned.items():
        weight = float(row["odds"])
        if word in SEED:  # a built-in word keeps its prior until labels say more
            evidence = row["toxic"] + row["clean"]
            weight = (weight * evidence + PRIOR_WEIGHT) / (evidence + 1)
        elif any(word[:k] + "*" in learned for k in range(STEM[0], len(word.rstrip("*")))):
            continue  # a stem stands for what grows from it
        elif word.endswith("*") and any(w.startswith(word[:-1]) and learned[w]["toxic"] >= 0.9 * row["toxic"] for w in learned if "*" not in w):
            continue  # one word makes up the stem
        weights.pop(word, None)
        if weight > 0:
            weights[word] = min(weight, 12.0)
    lexicon = Lexicon(weights, _exceptions(labelled, weights))
    return _calibrated(lexicon, labelled)


def _exceptions(labelled: DataFrame, weights: dict[str, float]) -> list[str]:
    """Terms with a neighbour that labelled rows show to be harmless together."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(weights, []))
        for batch in batches:
            phrases, toxic = [], []
            for text, label in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                read = folded(text.as_py())
                if matcher.total(read) == 0:
                    continue
                words = read.split()
                near = {" ".join(words[j : j + 2]) for i, w in enumerate(words) if w in weights or any(w[:k] + "*" in weights for k in range(STEM[0], len(w))) for j in (i - 1, i) if 0 <= j < len(words) - 1}
                phrases += near
                toxic += [label] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int64())], ["phrase", "toxic"])

    found = (
        labelled.select("text", "toxic").mapInArrow(pairs, "phrase string, toxic long")
        .groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
        .where(f"toxic = 0 and n >= {MIN_TEXTS}").orderBy(F.desc("n"), "phrase").limit(LEARNED)
    )
    return [r["phrase"] for r in found.collect()]


def _calibrated(lexicon: Lexicon, labelled: DataFrame) -> Lexicon:
    """Slope and offset of the logistic curve, by Newton steps over the sample."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([matcher.feature(t.as_py()) for t in batch["text"]], pa.float64()), batch["toxic"].cast(pa.int64())], ["x", "toxic"]
            )

    rows = labelled.select("text", "toxic").mapInArrow(features, "x double, toxic long").collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    slope, offset = 1.0, -1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = p * (1 - p) + 1e-9
        # a weak prior keeps the curve finite where classes don't overlap
        g = np.array([((y - p) * x).sum() - 0.05 * (slope - 1), (y - p).sum() - 0.05 * offset])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        slope, offset = float(np.clip(slope + step[0], 0.05, 50)), float(np.clip(offset + step[1], -30, 5))
        if np.abs(step).max() < 1e-6:
            break
    lexicon.slope, lexicon.offset = slope, offset
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` between 0 and 1."""
    schema = docs.select(*keep).schema.add("score", "double")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            x = np.array([matcher.feature(t.as_py()) for t in batch["text"]])
            p = 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(p, pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(answer, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """Learn from labels outside fold ``held_out`` and score every row of ``docs``."""
    fold = crc_bucket("doc_id", folds)
    marks = labels.where(F.col("toxic").isNotNull() & (fold != held_out)).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("long")).alias("toxic")
    )
    lexicon = learn(docs, marks)
    scored = score(docs.select("doc_id", "text", (fold == held_out).alias("held_out")), lexicon, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
