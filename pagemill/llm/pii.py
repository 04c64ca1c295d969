"""Personal data by candidate boosting (operator 2).

High-recall generators (regular expressions) propose spans, which may overlap. Those of the
four base kinds that pass their own test (octets, Luhn, number of digits) always stay. The
others are judged by boosted trees over format (generator, digits, length, separators,
letters, check digits) and context (key words and characters around). What tells good from bad is a test of each
generator (:func:`_right`): overlap with a base span, a written-out address that ends in a name of letters, a number
after a word for telephones, a remainder of one modulo 97, and for secrets a value of many different characters,
letters and digits among them. The trees learn how likely a candidate of this looks passes. The threshold of a
generator is the score that ``RECALL`` of what passed reaches, or, where too much else scores as high, the
lowest score down to which ``PRECISION`` of what is taken passed. Candidates that score so high are taken, whether they passed
or not, if they overlap nothing already taken.

Counts of looks come from all documents, and so do the thresholds (sums over a grid of scores). Only the trees are fitted on a
sample: of each generator, the ``PATTERNS`` most frequent looks among those with and among those without a candidate that passed.
The trees become plain expressions. Built-in functions
only; a document is scanned once, in its own row, in time linear in its length.

Edge cases: a null text is the empty text and has no spans. Repeated rows are answered each.
An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.staging import stage

PATTERNS = 600
TREES = 24
LEAVES_DEEP = 3
RATE = 0.3
RECALL = 0.98
PRECISION = 0.8
GRID, FARTHEST = 0.01, 12.0  # thresholds are multiples of the one, up to the other
KINDS = ("email", "ip", "card", "phone", "iban", "secret")

# The base patterns (written so that no run of characters is tried twice) and the wide ones.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{{2,63}}+){{1,8}}+",
    "number": r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?(?![A-Za-z0-9])",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key)\x20?[=:]\x20?[\"']?[^\s\"']{8,}+",
}
KEYWORDS = {
    1: r"(?i)(?:e-?mail|contact|write)[^0-9]{0,12}$", 2: r"(?i)(?:tel|phone|mobile|fax|call)[^0-9]{0,12}$",
    3: r"(?i)(?:card|visa|account|iban)[^0-9]{0,12}$", 4: r"(?i)(?:ip|host|server)[^0-9]{0,12}$",
    5: r"(?i)(?:version|v|no|page|isbn)\.?\x20?$",
}
_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
FEATURES = ("gen", "digits", "size", "seps", "letters", "plus", "word", "before", "after", "valid")


def _digits(s: Column) -> Column:
    return F.translate(s, " ().-/+", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a right check digit."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
            c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.coalesce(F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0, F.lit(False))


def spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Matches in order as ``start, end, s, before, after``; positions in code points.

    What lies between matches is split off by the same pattern, so positions are running
    sums of lengths and no match is looked for again."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,s:string,before:string,after:string>>")

    def place(pair: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            match, gap = F.get(pair["m"], i), F.get(pair["g"], i)
            start = acc["at"] + F.char_length(gap)
            end = start + F.char_length(match)
            one = F.struct(
                start.alias("start"), end.alias("end"), match.alias("s"), F.right(gap, F.lit(24)).alias("before"),
                F.left(F.coalesce(F.get(pair["g"], i + 1), F.lit("")), F.lit(2)).alias("after"),
            )
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(
            F.sequence(F.lit(0), F.size(pair["m"]) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"]
        )

    placed = F.transform(
        F.array(F.struct(found.alias("m"))),
        lambda x: F.when(F.size(x["m"]) == 0, empty).otherwise(
            F.transform(F.array(F.struct(x["m"].alias("m"), F.split(text, pattern, -1).alias("g"))), place)[0]
        ),
    )[0]
    return placed if guard is None else F.when(guard, placed).otherwise(empty)


def _passed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.rlike(s, F.lit(_IP))
    if kind == "card":
        n = F.char_length(_digits(s))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(s)).between(10, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda c: _passed(kind, c["s"])


def _of_kind(kind: int):
    return lambda c: F.struct(c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end"))


def mod97(s: Column) -> Column:
    """Remainder of an account number: first four characters moved to the end, letters as numbers from 10."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.left(plain, F.lit(4)))

    def step(left: Column, ch: Column) -> Column:
        value = F.ascii(ch) - F.when(F.ascii(ch) >= 65, 55).otherwise(48)
        return F.when(ch == "", left).otherwise((left * F.when(value > 9, 100).otherwise(10) + value) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _valid(kind: str, s: Column) -> Column:
    """Whether check digits are right, where a generator's texts have some."""
    if kind == "number":
        return F.coalesce(_passed("card", s), F.lit(False))
    return mod97(s) == 1 if kind == "iban" else F.lit(False)


def _right(kind: str, c: Column, held: Column, look: dict[str, Column]) -> Column:
    """The test a candidate is known to be right by."""
    s = c["s"]
    if kind == "email":
        return held | F.rlike(s, F.lit(r"[\[(]at[\])].*[^A-Za-z][A-Za-z]{2,24}$"))
    if kind == "number":
        return held | ((look["word"] == 2) & look["digits"].between(7, 15))
    if kind == "iban":
        return look["valid"] == 1
    value = F.regexp_replace(s, r"^[^=:]*[=:]\x20?[\"']?", "")
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def _look(gen: Column, kind: str, c: Column) -> dict[str, Column]:
    """Format and context as small whole numbers."""
    s = c["s"]
    digits, size = F.char_length(F.regexp_replace(s, "[^0-9]", "")), c["end"] - c["start"]
    letters = F.char_length(F.regexp_replace(s, "[^A-Za-z]", ""))
    word = F.lit(0)
    for k, p in KEYWORDS.items():
        word = F.when(F.rlike(c["before"], F.lit(p)), k).otherwise(word)
    last, follow = F.right(c["before"], F.lit(1)), F.left(c["after"], F.lit(1))

    def kind_of(ch: Column) -> Column:
        return F.when(ch == "", 0).when(F.rlike(ch, F.lit(r"\s")), 1).when(F.rlike(ch, F.lit("[0-9]")), 2).when(F.rlike(ch, F.lit(r"\p{L}")), 3).otherwise(4)

    return {
        "gen": gen, "digits": F.least(digits, F.lit(40)), "size": F.least(F.floor(size / 4), F.lit(16)).cast("int"),
        "seps": F.least(size - digits - letters, F.lit(12)), "letters": F.least(letters, F.lit(12)),
        "plus": F.startswith(s, F.lit("+")).cast("int"), "word": word, "before": kind_of(last), "after": kind_of(follow),
        "valid": _valid(kind, s).cast("int"),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, wide``: spans of the base kinds that passed, and all candidates with
    their looks and whether they are known to be right."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has = {"email": F.contains("_t", F.lit("@")), "ip": F.contains("_t", F.lit(".")), "phone": F.contains("_t", F.lit("+"))}
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    base = plain.select("doc_id", "_t", *[
        F.filter(spans(F.col("_t"), p, has.get(k)), _test(k)).alias(k) for k, p in BASE.items()
    ])
    good = F.array_sort(F.concat(*[
        F.transform(k, _of_kind(i)) for i, k in enumerate(BASE)
    ]))
    at_or_mark = F.contains("_t", F.lit("@")) | F.contains("_t", F.lit("at]")) | F.contains("_t", F.lit("at)"))
    wide = base.select("doc_id", good.alias("base"), *[
        spans(F.col("_t"), p, at_or_mark if k == "email" else None).alias(f"w_{k}") for k, p in WIDE.items()
    ])

    def judged(i: int, k: str) -> Column:
        def one(c: Column) -> Column:
            met = F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            # a long secret or account number may hold digits that look like a card; it is taken whole nevertheless
            inside = F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
            held = inside if k in ("iban", "secret") else met
            look = _look(F.lit(i), k, c)
            digits = F.char_length(F.regexp_replace(c["s"], "[^0-9]", ""))
            kind = {"email": F.lit(0), "number": F.when(digits >= 13, 2).otherwise(3), "iban": F.lit(4), "secret": F.lit(5)}[k]
            return F.struct(
                c["start"].alias("start"), kind.alias("kind"), c["end"].alias("end"),
                _right(k, c, held, look).alias("right"), held.alias("held"), *[x.cast("int").alias(n) for n, x in look.items()],
            )

        return F.transform(f"w_{k}", one)

    return wide.select("doc_id", "base", F.concat(*[judged(i, k) for i, k in enumerate(WIDE)]).alias("wide"))


# ---- boosted trees over at most 2 * PATTERNS looks of each generator, on the driver -----------------


@dataclass
class Trees:
    """Trees as nested tuples ``(feature, bound, low, high)`` with numbers at the leaves."""

    trees: list = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def column(self, c: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, bound, low, high = node
            return F.when(c[FEATURES[feature]] <= bound, walk(low)).otherwise(walk(high))

        out = F.lit(float(self.start))
        for tree in self.trees:
            out = out + walk(tree)
        return out

    def taken(self, c: Column) -> Column:
        if not self.thresholds:
            return F.lit(False)
        bound = F.create_map(*[x for g, t in self.thresholds.items() for x in (F.lit(g), F.lit(float(t)))])
        return F.coalesce(self.column(c) >= bound[c["gen"]], F.lit(False))


def _value(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    feature, bound, low, high = node
    return np.where(x[:, feature] <= bound, _value(low, x), _value(high, x))


def _grow(x: np.ndarray, pull: np.ndarray, curve: np.ndarray, depth: int):
    """A regression tree by Newton gain."""

    def leaf(p: float, c: float) -> float:
        return RATE * p / (c + 1.0)

    p, c = float(pull.sum()), float(curve.sum())
    best = (1e-6, None, None)
    if depth and len(x) > 1:
        for f in range(x.shape[1]):
            for bound in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= bound
                pl, cl = float(pull[low].sum()), float(curve[low].sum())
                gain = pl**2 / (cl + 1) + (p - pl) ** 2 / (c - cl + 1) - p**2 / (c + 1)
                if gain > best[0]:
                    best = (gain, f, int(bound))
    if best[1] is None:
        return leaf(p, c)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], pull[low], curve[low], depth - 1), _grow(x[~low], pull[~low], curve[~low], depth - 1))


def boost(x: np.ndarray, n: np.ndarray, right: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for ``right`` of ``n`` candidates of each look."""
    model = Trees()
    if not len(x) or right.sum() == 0:
        return model
    share = np.clip(right.sum() / n.sum(), 1e-3, 1 - 1e-3)
    model.start = float(np.log(share / (1 - share)))
    score = np.full(len(x), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, right - n * p, n * p * (1 - p), LEAVES_DEEP)
        model.trees.append(tree)
        score = score + _value(tree, x)
    return model


def thresholds(scored: DataFrame) -> dict[int, float]:
    """Threshold of each generator from ``gen, score, n, right`` of all looks. Scores are summed over a grid, so
    that what comes to the driver is bounded however many looks there are."""
    cell = F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.col("score"))) / GRID).cast("int")
    sums = scored.groupBy("gen", cell.alias("cell")).agg(F.sum("n").alias("n"), F.sum("right").alias("right")).collect()
    out = {}
    for gen in {r["gen"] for r in sums}:
        best_first = sorted((r for r in sums if r["gen"] == gen), key=lambda r: -r["cell"])
        n, right = (np.cumsum([r[c] for r in best_first]) for c in ("n", "right"))
        far = min(int(np.searchsorted(right, RECALL * right[-1])), len(right) - 1)
        good = np.flatnonzero((right[: far + 1] >= PRECISION * n[: far + 1]) & (right[: far + 1] > 0))
        if len(good):
            out[int(gen)] = best_first[int(good[-1])]["cell"] * GRID - 1e-9
    return out


def fit(found: DataFrame) -> Trees:
    """Trees from ``wide`` of :func:`candidates`."""
    looks = stage(
        found.select(F.explode("wide").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(
            F.count("*").alias("n"), F.sum(F.col("c.right").cast("int")).alias("right")
        ), "looks",
    )
    classes = [looks.where((F.col("gen") == g) & ((F.col("right") > 0) == known)) for g in range(len(WIDE)) for known in (True, False)]
    rows = reduce(DataFrame.unionByName, [c.orderBy(F.desc("n"), *FEATURES).limit(PATTERNS) for c in classes]).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(-1, len(FEATURES))
    model = boost(x, np.array([r["n"] for r in rows], float), np.array([r["right"] for r in rows], float))
    if model.trees:
        score = model.column(F.struct(*FEATURES)).alias("score")
        model.thresholds = thresholds(looks.select("gen", score, "n", "right"))
    return model


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, n_secret``, one row per document;
    ``n_spans`` counts all spans, ``n_secret`` those of secrets."""
    found = stage(candidates(docs, id_col, text_col), "candidates")
    model = fit(found)
    plain = "array<struct<start:int,kind:int,end:int>>"

    def take(acc: Column, c: Column) -> Column:
        """Left to right, what overlaps nothing taken before."""
        return F.when(c["start"] >= acc["end"], F.struct(c["end"].alias("end"), F.concat(acc["out"], F.array(c)).alias("out"))).otherwise(acc)

    chosen = F.transform(
        F.array_sort(F.filter("wide", lambda c: ~c["held"] & model.taken(c))),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
    )
    added = F.aggregate(chosen, F.struct(F.lit(0).alias("end"), F.array().cast(plain).alias("out")), take, lambda a: a["out"])
    kinds = F.transform("base", lambda c: c["kind"])
    counted = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.withColumn("added", added).select(
        "doc_id", *counted, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
        F.size(F.filter("added", lambda c: c["kind"] == KINDS.index("secret"))).cast("long").alias("n_secret"),
    )
