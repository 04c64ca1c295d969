import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm.backoff import CUTOFF, _discounts, katz_scores, score_documents


def brute(rows, order):
    """Katz backoff in plain Python: ``{position: (n_tokens, n_known, N, base, score)}``."""
    texts = [[*(text or "").encode().lower().split(), None] for _, _, text in rows]
    train = [t for t, (_, held, _) in zip(texts, rows) if not held]
    grams, counts = {}, {}
    for n in range(1, order + 1):
        counts[n] = collections.Counter()
        for t in train:
            padded = ["<s>"] * (n - 1) + t
            counts[n].update(tuple(padded[i : i + n]) for i in range(len(t)))
        freq = [0] + [sum(1 for c in counts[n].values() if c == r) for r in range(1, CUTOFF + 2)]
        grams[n] = (_discounts(freq), freq)
    total, size = sum(counts[1].values()), len(counts[1])
    after = {n: collections.defaultdict(list) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            after[n][g[:-1]].append((g[-1], c))

    def star(n, c):
        return grams[n][0][c] * c if c <= CUTOFF else c

    def prob(n, history, word):
        if n == 1:
            whole = total
            freed = total - sum(star(1, c) for c in counts[1].values())
            if total and freed <= 1e-9:
                whole, freed = total + 1, 1
            c = counts[1][(word,)]
            return star(1, c) / whole if c else (freed / whole if total else 1.0)
        lower = lambda w: prob(n - 1, history[1:], w)
        seen = after[n].get(history)
        if not seen:
            return lower(word)
        whole = sum(c for _, c in seen)
        kept = sum(star(n, c) for _, c in seen)
        if kept >= whole * (1 - 1e-9):
            whole += 1
        rest = 1 - sum(lower(w) for w, _ in seen)
        c = counts[n][(*history, word)]
        if c:
            return star(n, c) / (kept if rest <= 1e-9 else whole)
        return (1 - kept / whole) / rest * lower(word) if rest > 1e-9 else 0.0

    out = []
    for t in texts:
        padded = ["<s>"] * (order - 1) + t
        score = sum(math.log10(max(prob(order, tuple(padded[i : i + order - 1]), t[i]), 1e-300)) for i in range(len(t)))
        base = sum(math.log10((counts[1][(w,)] + 1) / (total + size + 1)) for w in t)
        out.append((len(t), sum((w,) in counts[1] for w in t), total, base, score))
    return out, prob


TEXTS = [
    "the cat sat on the mat", "The cat ate the rat", "a dog sat on the cat", None, "", "the the the the", "x",
    "the cat sat on the mat", "a b c d e f g the cat", " the\x0bcat  sat\n on", "dog sat the mat a rat", "unseen words here",
] * 3


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("heavy", [1, 256])
def test_scores_equal_brute_force(spark, order, heavy):
    rows = [(i, i % 5 == 2, t) for i, t in enumerate(TEXTS)]
    want, _ = brute(rows, order)
    df = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(3)
    got = {r.doc_id: r for r in katz_scores(df, order, chunk=20, bucket=30, heavy=heavy).collect()}
    assert len(got) == len(rows)
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(score, rel=1e-5)


def test_histories_sum_to_one():
    rows = [(i, False, t) for i, t in enumerate(TEXTS)]
    _, prob = brute(rows, 2)
    words = {w for _, _, t in rows for w in (t or "").encode().lower().split()} | {None, b"never"}
    for history in (b"the", b"cat", b"never", "<s>"):
        assert sum(prob(2, (history,), w) for w in words) == pytest.approx(1)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n string")
    assert score_documents(empty).count() == 0
    rows = [(None, "a b"), (1, None), (1, None), (2, "a b"), (9, "a" * 100_000 + " b" * 50_000)]
    out = score_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))).collect()
    assert len(out) == 5
    folds = {r.doc_id: r.held_out for r in out}
    assert all(folds[i] == (zlib.crc32(str("" if i is None else i).encode()) % 7 == 2) for i in folds)
    held = spark.createDataFrame([(1, True, "a b")], "doc_id long, held_out boolean, text string")
    assert katz_scores(held).first().score == 0.0
