"""Vector codes, spelling variants and shared lines against plain Python, over odd rows and over none."""

import collections
import math
import random
import re

import numpy as np
import pytest

from pagemill.llm import jaccard_join, line_dedup, mixing, spelling, vector_codes

# ---- vector codes ------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [[min(max(math.floor(4096 * x), -(1 << 62)), 1 << 62) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[r], p) for r in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for v in whole:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, xs in got.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    ends = [[near(cut(v, p), books[p]) for p in range(parts)] for v in whole]
    most = (1 << 63) - 1
    error = [min(sum(d for d, _ in e), most) for e in ends]
    per_label = collections.Counter()
    for (_, _, lab), e in zip(kept, error):
        per_label[lab] += e
    return sorted(
        (str(i), "".join(f"{k:02x}" for _, k in e), x, min(per_label[lab], most)) for (i, _, lab), e, x in zip(kept, ends, error)
    )


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int")


def check_codes(spark, rows, kind="float"):
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in vector_codes.compress(table(spark, rows, kind)).collect())
    assert got == plain_codes(rows)


def test_transform_is_in_order_of_sequency():
    for n in (1, 2, 4, 8, 32):
        rows = vector_codes.hadamard(np.eye(n, dtype=np.int64)).T
        assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(n))
        assert (rows @ rows.T == n * np.eye(n)).all()


def test_codes_equal_plain_ones(spark):
    rng = random.Random(1)
    single = lambda: float(np.float32(rng.gauss(0, 0.2)))
    rows = [(i, [single() for _ in range(24)], rng.choice([0, 1, 2, None])) for i in range(120)]
    rows += [(7, rows[3][1], 1), (None, rows[4][1], None), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 24, 1)]
    rows += [(503, [float("inf")] + [0.0] * 23, 1), (504, [0.5] * 5, 2), (505, [], 2)]
    check_codes(spark, rows)


def test_few_odd_and_huge_vectors(spark):
    check_codes(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.5], None), (2, [1.0, 2.5], None)])
    check_codes(spark, [(1, [], 1)])
    check_codes(spark, [(1, [1e300, -1e300, 5.0], 1), (2, [0.0] * 9, 1), (3, [1e12] * 3, 2), (4, [1e15, 2.0], 2)], "double")
    assert vector_codes.compress(table(spark, [(1, None, 1)])).count() == 0


# ---- spelling variants ---------------------------------------------------------


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(texts, least=2):
    n = collections.Counter()
    for t in texts:
        runs = re.findall("[A-Za-zÀ-ÿ]+", t or "")
        n.update(w for w in (re.sub("[A-Z]", lambda m: m.group().lower(), r) for r in runs) if len(w) >= 7)
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w], 0), root(w)) for w in n)


def check_variants(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, word string, n int")
    got = spelling.variants(docs, **more).collect()
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got) == plain_variants(texts)


def edited(word, rng, letters="abcé"):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:]])


def test_variants_equal_plain_ones(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    texts = [" ".join([w] * 300) for w in base[:6]] + [" ".join([w.upper(), w, w]) for w in base]
    words = [edited(w, rng) for w in base for _ in range(12)] + [edited(edited(w, rng), rng) for w in base for _ in range(4)]
    texts += [f"{w}, {w}; {w}" for w in words] + [None, "", "a b", "1234567 " * 3, "×÷×÷×÷× " * 2]
    check_variants(spark, texts)


def test_variants_of_words_longer_than_the_tries(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(n)) for n in (10, 11, 12, 13, 14, 20, 300)] + ["a" * 11, "a" * 12, "a" * 13]
    words = base + [edited(w, rng) for w in base for _ in range(10)]
    texts = [f"{w} {w}" for w in words] + [" ".join([base[3]] * 200), "b" * 50_000 + " " + "b" * 50_000, "b" * 50_001 + " " + "b" * 50_001]
    check_variants(spark, texts, longest=12)


def test_variants_of_nothing(spark, odd, none):
    assert spelling.variants(none).count() == 0
    assert spelling.variants(odd.where("doc_id = 6")).count() == 0
    assert {r.word: r.n for r in spelling.variants(odd.unionByName(odd), damage=31, shortest=5).collect()}["alpha"] > 30_000


# ---- shared lines --------------------------------------------------------------


def plain_lines(texts, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    found = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or found[key(x)] < least]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("batches,fan_in", [(1, 2), (5, 2), (8, 4)])
def test_lines_equal_plain_ones(spark, batches, fan_in):
    rng = random.Random(4)
    lines = [f"Line {i}" for i in range(25)] + ["  line 3 ", "LINE 3\r", "", "   ", " line 3", "x" * 100_000]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 12))) for _ in range(80)] + ["same\ntext"] * 30 + [None, "", "\n\n", "a\n" * 20_000]
    docs = spark.createDataFrame([(i % 50 or None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, hi string, n int")
    out = line_dedup.without_common_lines(docs, least=9, batches=batches, fan_in=fan_in).collect()
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in out) == plain_lines(texts, 9)


def test_lines_of_odd_rows(spark, odd, none):
    out = line_dedup.line_report(odd).collect()
    assert len(out) == odd.count() and all(r.n_lines >= 1 and r.n_dropped == 0 for r in out)
    assert line_dedup.line_report(none).count() == 0


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, least=3, fan_in=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(7, 7, 1), (i, -i, 2)], "hi long, lo long, n long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.common().collect()] == [(7, 7)]
    runs.close()


# ---- earlier operators on skewed tables -----------------------------------------


def mixed_table(spark, sizes):
    rng = random.Random(5)
    rows = [(s, n) for s, (rows, n) in sizes.items() for _ in range(rows)]
    texts = [(i, " ".join(rng.choice(["word", "other", "third"]) for _ in range(n)), s) for i, (s, n) in enumerate(rows)]
    return spark.createDataFrame(texts, "doc_id long, text string, source string")


@pytest.mark.parametrize("sizes", [
    {"hot": (500, 40), "mid": (300, 40), "low": (150, 40), "rare": (45, 40), "tiny": (5, 40)},
    {"book": (20, 2000), "web": (300, 60), "note": (200, 20), "mail": (80, 50)},
])
def test_mix_reaches_every_target(spark, sizes):
    out = mixing.mixing_rates(mixed_table(spark, sizes), trust=0.9999).select("domain", "target_tokens", "reached_tokens").distinct().collect()
    assert {r.domain for r in out} == set(sizes)
    assert all(abs(r.reached_tokens - r.target_tokens) < 0.01 * r.target_tokens for r in out)
    weights = {s: float(a * b) ** mixing.FLATTEN for s, (a, b) in sizes.items()}
    total = sum(r.target_tokens for r in out)
    assert all(r.target_tokens / total == pytest.approx(weights[r.domain] / sum(weights.values())) for r in out)


def test_tail_of_sources_is_one_domain(spark):
    docs = mixed_table(spark, {f"s{i}": (2, 10 + i) for i in range(12)})
    marks = docs.withColumn("tokens", mixing.features(docs["text"])["tokens"])
    some = mixing.natural_targets(marks, most=4)
    assert set(some) == {"s11", "s10", "s9", mixing.OTHERS} and sum(some.values()) == pytest.approx(1)
    assert some[mixing.OTHERS] > 0.6


def test_near_copies_without_identifiers(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        rows += [(None, " ".join(words)), (None, " ".join([*words[:-1], "end"]))]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 1000 and sum(r.kept for r in out) == 500 and all(r.n_links == 1 for r in out)
