"""Operators against plain Python over the smallest tables, and against planted cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import common, exact_dedup, fingerprints, jaccard_join, mixing, packing, pii, quality, queries
from tests.conftest import SF_DIR

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width=5):
    words = [w for w in SPACE.split(lower(text)) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in common.documents(spark, SF_DIR).collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}


def test_language_is_right_on_held_out(spark):
    out = queries.QUERIES["op1_language"](spark, SF_DIR).join(common.documents(spark, SF_DIR).select("doc_id", "lang"), "doc_id")
    rows = [r for r in out.collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def check_digit(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and check_digit(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    kinds = list(PATTERNS)
    found = sorted(
        (m.start(), kinds.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())
    )
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in found]


TRICKY = [
    "a@b.c_d@e.f x.y@z", "a@b.c-d@e.f.g", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (017) 555-7713, +12 3", "é😀 4111111111111111 + +49.30.1234567-", "1 2", "@@ a@ @b.c a@b a@b..c a@b.c.", "9" * 400, "a" * 3000 + "@" + "b.c" * 2000,
    "token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\" key: abcdefgh12345678abcdefgh", "+1234567890 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def test_personal_data(spark, texts):
    rows = list(texts.items()) + [(10_000 + i, t) for i, t in enumerate(TRICKY)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = dict(rows)
    for r in out:
        want = base_spans(of[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want
        counts = collections.Counter(s.split(":")[0] for s in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in PATTERNS]
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s)
        assert all(0 <= a < b <= len(of[r.doc_id]) for a, b in spans)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (400, len(pii.FEATURES)))
    x[:, 0] = 1
    right = ((x[:, 1] > 2) & (x[:, 5] <= 3)).astype(float) * 3
    model = pii.boost(x, np.full(400, 3.0), right)
    score = model.start + sum(pii._value(t, x) for t in model.trees)
    assert ((score >= 0) == (right > 0)).mean() > 0.97


def test_thresholds_keep_recall_and_precision(spark):
    rows = [(0, 3.0, 90, 90), (0, 1.0, 10, 9), (0, -2.0, 500, 1), (1, 2.0, 10, 0), (2, 0.5, 10, 10), (2, 0.1, 100, 10), (3, 50.0, 4, 4)]
    out = pii.thresholds(spark.createDataFrame(rows, "gen int, score double, n long, right long"))
    assert out == {0: pytest.approx(1.0), 2: pytest.approx(0.5), 3: pytest.approx(pii.FARTHEST)}


def account(n):
    """A German account number with right check digits."""
    body = f"{n * 7919 % 10**18:018d}"
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def test_spans_beyond_the_base_kinds(spark, texts):
    rng = random.Random(3)
    secret = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(n))
    long = "api_key=" + secret(300)
    planted = [account(5), "bob(at)host(dot)com", long, "Tel: 030 1234 5678", "token = \"" + secret(40) + "\""]
    clean = ["paid 4111 1111 1111 1112 of it", "DE00123456789012345678 is no account", "the key: remained unknownuntil then"]
    rows = list(texts.items()) + [(10_000 + i, f"before it {x} after") for i, x in enumerate(planted)]
    rows += [(20_000 + i, x) for i, x in enumerate(clean)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = ["iban", "email", "secret", "phone", "secret"]
    for i, (x, kind) in enumerate(zip(planted, kinds, strict=True)):
        spans = [s.split(":") for s in out[10_000 + i].spans.split(",")]
        taken = [(k, f"before it {x} after"[int(a) : int(b)]) for k, a, b in spans]
        want = x.removeprefix("Tel: ").removesuffix("\"")
        assert (kind, want) in taken, (x, taken)
    assert [out[20_000 + i].spans for i in range(len(clean))] == [""] * len(clean)


def test_quality_agrees_with_labels(spark, labels):
    rows = [r for r in queries.QUERIES["op3_quality"](spark, SF_DIR).collect() if r.doc_id in labels]
    bad = [r for r in rows if labels[r.doc_id].quality == 0]
    good = [r for r in rows if labels[r.doc_id].quality == 1]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.15
    hit, wrong = [0.5, 0.3, 0.4, 0.6, 0.2, 0.3, 0.25], 0.005
    votes = np.stack([np.where(truth, rng.random(20_000) < h, rng.random(20_000) < wrong) for h in hit] + [np.where(~truth, -1, 0)], axis=1).astype(int)
    pattern = ((votes + 1) * 3 ** np.arange(8)).sum(axis=1)
    kinds, n = np.unique(pattern, return_counts=True)
    found = quality.estimate(kinds, n.astype(float))
    assert found.bad == pytest.approx(0.15, abs=0.02)
    assert np.abs(found.chance[1, :7, 2] - hit).max() < 0.06


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_duplicates(spark, texts, keep, fan_in):
    rows = list(texts.items()) + [(i + 1000, t.upper()) for i, t in list(texts.items())[:80]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    pick = max if keep == "largest" else min
    for r in exact_dedup.exact_duplicates(df, keep=keep, fan_in=fan_in).collect():
        group = groups[lower(dict(rows)[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (pick(group), len(group), r.doc_id == pick(group))
        assert r.text_sha256 == hashlib.sha256(lower(dict(rows)[r.doc_id]).encode()).hexdigest()


def planted(seed=3):
    """Near copies around the bound, exact copies, a passage many share, a mass of near copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = some(12), []
    for _ in range(60):
        base = some(rng.randrange(8, 90)) + (passage if rng.random() < 0.4 else [])
        rows.append(base)
        for _ in range(rng.randrange(0, 3)):
            near = list(base)
            for _ in range(rng.randrange(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append(near)
    mass = some(120)
    for i in range(60):
        near = list(mass)
        near[rng.randrange(120)] = f"x{i}"
        rows.append(near)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("limit,block", [(2048, 256), (12, 7)])
def test_similarity_join(spark, limit, block):
    rows = planted()
    sets = {i: shingles(t) for i, t in rows}
    same = collections.defaultdict(list)
    for i, s in sets.items():
        same[frozenset(s)].append(i)
    rep = {i: min(g) for g in same.values() for i in g}
    links = collections.Counter()
    up = dict(rep)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(set(rep.values())), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links.update((a, b))
            x, y = sorted((root(a), root(b)))
            up[y] = x
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit, block=block).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.class_id, r.rep_id, r.n_links, r.kept) == (root(rep[r.doc_id]), rep[r.doc_id], links[rep[r.doc_id]], root(rep[r.doc_id]) == r.doc_id)


def test_toxicity_agrees_with_labels(spark, labels):
    rows = [r for r in queries.QUERIES["op6_toxicity"](spark, SF_DIR).collect() if r.doc_id in labels]
    clean = [r for r in rows if not labels[r.doc_id].toxic]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_folds_look_alikes():
    from pagemill.llm.toxicity import Lexicon, Matcher, folded

    assert folded("You ＩDIOT! id10t 1d1ot іdіоt é 2024 99") == " you idiot idiot idiot idiot é 2024 99 "
    matcher = Matcher(Lexicon({"idiot": 2.0, "achl*": 1.0}, ["idiot savant"]))
    assert matcher.total(folded("an 1d10t, an idiot savant; idiotic")) == 2.0
    assert matcher.total(folded("achl achlen xachlen")) == 1.0


def test_fingerprints(spark, texts):
    out = fingerprints.compare_edited(common.documents(spark, SF_DIR), k=1 << 20).collect()
    order = sorted(texts)
    following = {i: order[(n + 1) % len(order)] for n, i in enumerate(order)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in out:
        text, after = texts[r.doc_id], texts[following[r.doc_id]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(shingles(text), shingles(edited)))
        assert r.near_next == pytest.approx(jaccard(shingles(text), shingles(after)))
        assert r.n_shingles == len(shingles(text))


def test_ranges_of_the_order(spark):
    rows = spark.createDataFrame([(i * i % 977, f"t{i}") for i in range(300)] + [(None, "n"), (5, "t5b")], "doc_id long, text string")
    got = fingerprints.with_next(rows, "doc_id", ["text"], block_rows=16).collect()
    want = [r.text for r in rows.orderBy(F.asc_nulls_first("doc_id"), "text").collect()]
    after = dict(zip(want, want[1:] + want[:1], strict=True))
    assert {r.text: r.next_text for r in got} == after


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(5)
    words = [f"v{rng.randrange(10**6)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, both string")
    sketch = {c: fingerprints.bottom(fingerprints.shingles(F.col(c)), 512) for c in ("a", "b")}
    r = df.select(
        fingerprints.resemblance(sketch["a"], sketch["b"], 512).alias("near"), fingerprints.containment(sketch["a"], sketch["b"], 512).alias("inside"),
        fingerprints.distinct_shingles(fingerprints.merge(sketch["a"], sketch["b"], 512), 512).alias("n"),
    ).first()
    assert r.near == pytest.approx(1 / 3, abs=0.08) and r.inside == pytest.approx(0.5, abs=0.1) and r.n == pytest.approx(6000, rel=0.15)


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " a", "a  b", "x <|endoftext|> y", "I'm  don't 12 3\n\nx ", "\n a b  c", "tab\t x"]
    rows = list(texts.items()) + [(5000 + i, t) for i, t in enumerate(odd)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for of, total in ((pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for key, parts in of.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == total[key] if total else at <= packing.CAPACITY
    assert set(pieces) == set(ids)
    tokens = sum(map(len, ids.values()))
    assert len(sequences) * packing.CAPACITY <= 1.06 * tokens + 4 * packing.CAPACITY


def test_cutting_stock_is_close_to_the_bound():
    demand = np.zeros(64, np.int64)
    demand[[20, 25, 30, 41, 63]] = [400, 300, 500, 200, 100]
    plan = packing.cutting_stock(demand, 64)
    assert (sum(c * n for c, n in plan) == demand).all()
    assert all((c * np.arange(1, 65)).sum() <= 64 for c, _ in plan)
    # 400x21 + 300x26 + ...: items over half the room need a sequence each, 31s pair up
    assert sum(n for _, n in plan) <= 100 + 200 + 250 + -(-400 // 3) + 150 + 5


def test_mixing_reaches_targets(spark):
    docs = common.documents(spark, SF_DIR)
    names = [r[0] for r in docs.select("source").distinct().orderBy("source").collect()]
    targets = {n: 1.0 + (i % 3) for i, n in enumerate(names)}
    out = mixing.mixing_rates(docs, targets, trust=0.999)
    total = {r.source: r.t for r in out.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("tokens") * F.col("rate")).alias("t")).collect()}
    whole, weights = sum(total.values()), sum(targets.values())
    assert all(abs(total[n] / whole - targets[n] / weights) < 0.03 for n in names)
    assert out.where("rate < 1 or copies < 1").count() == 0


def test_pipeline_stages_by_themselves(spark, texts, labels):
    docs = common.documents(spark, SF_DIR)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in queries.QUERIES["op3_quality"](spark, SF_DIR).where("kept").collect()}
    good = stages["quality"](spark, docs, SF_DIR)
    assert {r.doc_id for r in good.collect()} == kept
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[lower(t)].append(i)
    assert {r.doc_id for r in stages["exact_dedup"](spark, docs, SF_DIR).collect()} == {max(g) for g in groups.values()}
    rows = planted(9)
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert {r.doc_id for r in stages["near_dedup"](spark, table, SF_DIR).collect()} == {root(i) for i in sets}
    copies = collections.Counter(r.doc_id for r in stages["mixing"](spark, docs, SF_DIR).collect())
    assert set(copies) == set(texts)
    assert {r.doc_id: r.copies for r in mixing.mixing_rates(docs).collect()} == copies
