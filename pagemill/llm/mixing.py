"""Mixing sources to target weights with soft membership (operator 10).

A document belongs to the domains (the sources named in the targets) with probabilities. A
table of how often each value of a feature occurs in each domain, counted over all labelled documents,
predicts them: naive Bayes over the document's own label, which is trusted to ``trust`` only,
and coarse marks of its text (length, word length, share of letters beyond ASCII, lines,
digits). A document without a label gets its domains from the text alone.

Rates, how many copies of a document the mix expects, are then fitted by projected
gradient: least squares of the domains' expected tokens, ``sum_d rate_d * tokens_d * p_d``, against their targets,
each domain's error relative to what it has, over rates of at least ``floor``. Gradient steps add up in one number for each domain,
and rates are the projection of one plus a document's share in them (projected gradient with lazy projection), so a step is one sum over the distinct
marks and moves as many numbers as there are domains. With errors relative to what a domain has, steps of length one always converge, for small
domains as for large ones. Steps end when every domain is within ``close`` of its target, or after ``steps``;
``target_tokens`` and ``reached_tokens`` of a document's domain tell what came out. The sum of targets is the
smallest total at which no document needs less than one copy, so nothing that earlier steps kept
is lost (when copies of others bring a domain above its share, the total grows): documents of domains that are short get more copies, as many as that takes. A fractional rate is rounded
by the hash of the identifier.

Without given targets, every source is to have its share of all tokens to the power ``flatten``, made to add up to one. Sources beyond the
``most`` - 1 with most tokens are one domain together, with their own labels and target.

Built-in functions only; no Python runs on executors.

Edge cases: a null text has no tokens and no marks, but gets a rate like its like. A label outside the targets counts as
no label. Repeated rows are rated each. Without targets, or without tokens, every rate is
1. Other columns of the input are not read by :func:`mixing_rates`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import unused
from pagemill.operators.staging import stage

TRUST = 0.95
FLATTEN = 0.9
#: Relative error that ends the fit, the most steps when it isn't reached, and steps without progress until the total grows.
CLOSE, STEPS, PATIENCE = 0.002, 200, 3
DOMAINS = 256
OTHERS = "(other sources)"
FEATURES = ("label", "length", "word", "beyond", "lines", "digits")


def features(text: Column) -> dict[str, Column]:
    """Coarse marks, each a small whole number; null where there is nothing to tell."""
    body = F.coalesce(text, F.lit(""))
    size = F.char_length(body)
    words = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = size - F.char_length(F.translate(body, "\n", ""))
    digits = size - F.char_length(F.translate(body, "0123456789", ""))
    empty = words == 0
    step = lambda x, most: F.least(F.floor(x), F.lit(most)).cast("int")
    marks = {
        "length": step(F.log2(words + 1), 20),
        "word": step(size / words, 12),
        "beyond": step(F.log2((F.octet_length(body) - size) * 64 / size + 1), 7),
        "lines": step(F.log2(lines * 64 / words + 1), 7),
        "digits": step(F.log2(digits * 64 / size + 1), 7),
    }
    return {"tokens": words.cast("long")} | {k: F.when(~empty, v) for k, v in marks.items()}


def natural_targets(
    marks: DataFrame, source_col: str = "source", flatten: float = FLATTEN, most: int = DOMAINS
) -> dict[str, float]:
    """Shares of the sources' ``tokens`` to the power ``flatten``: small ones gain a little. The tail is ``OTHERS``."""
    counts = marks.where(F.col(source_col).isNotNull()).groupBy(source_col).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    lifted = counts.withColumn("w", F.pow("n", F.lit(flatten)))
    rows = lifted.orderBy(F.desc("n"), source_col).limit(most - 1).collect()
    weights = {r[0]: r["w"] for r in rows}
    whole = lifted.agg(F.sum("w"), F.count("*")).first()
    if (whole[1] or 0) > len(rows):
        weights[OTHERS] = weights.get(OTHERS, 0.0) + max(whole[0] - sum(r["w"] for r in rows), 0.0)
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


def _posterior(marks: DataFrame, names: list[str], trust: float) -> Column:
    """Probabilities of the domains, as an array, from a table counted over labelled documents."""
    k = len(names)
    counted = marks.where("label is not null").select(
        F.col("label").alias("domain"), "n", F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES[1:]
        ])).alias("x")
    ).groupBy("domain", "x.f", "x.v").agg(F.sum("n").alias("n"))
    table: dict[str, dict[int, list[float]]] = {f: {} for f in FEATURES[1:]}
    # at most 50 values of features for each domain
    for row in counted.collect():
        if row["v"] is not None:
            table[row["f"]].setdefault(row["v"], [0.0] * k)[row["domain"]] += row["n"]
    totals = [float(sum(v[d] for v in table["length"].values())) for d in range(k)]
    whole = sum(totals) or 1.0

    def logs(values: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in values])



    terms = [logs([math.log((t + 1) / (whole + k)) for t in totals])]
    for f, values in table.items():
        if not values:
            continue
        options = [
            x for v, n in sorted(values.items())
            for x in (F.lit(v), logs([math.log((n[d] + 1) / (totals[d] + len(values) + 1)) for d in range(k)]))
        ]
        terms.append(F.coalesce(F.create_map(*options)[F.col(f)], logs([0.0] * k)))
    told, other = math.log(trust), math.log(max((1 - trust) / max(k - 1, 1), 1e-12))
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("label"), told).otherwise(other))
    terms.append(F.when(F.col("label").isNull(), logs([0.0] * k)).otherwise(own))
    summed = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), terms)
    raised = F.transform(F.array(summed), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(F.array(raised), lambda s: F.transform(s, lambda x: x / F.aggregate(s, F.lit(0.0), lambda a, y: a + y)))[0]


def fit_rates(
    marks: DataFrame, weights: list[float], floor: float = 1.0, steps: int = STEPS, close: float = CLOSE
) -> tuple[DataFrame, list[float], list[float]]:
    """``marks`` with a ``rate`` for each row of ``tokens, p``, and the domains' target and reached tokens."""
    k = len(weights)

    def rate(pulls: list[float]) -> Column:
        share = F.aggregate(F.zip_with("p", F.array(*[F.lit(float(x)) for x in pulls]), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(float(floor)), 1 + share)

    def reached(pulls: list[float]) -> list[float]:
        rated = marks.select("p", (rate(pulls) * F.col("tokens")).alias("expected"))
        got = rated.agg(*[F.sum(F.col("expected") * F.col("p")[i]).alias(f"d{i}") for i in range(k)]).first()
        return [float(x or 0.0) for x in got]

    pulls = [0.0] * k
    got = now = reached(pulls)
    whole = sum(now)
    if whole <= 0:
        return marks.withColumn("rate", F.lit(1.0)), [0.0] * k, [0.0] * k
    # the smallest total at which every domain reaches its target without losing documents
    total = max((n / w for n, w in zip(now, weights, strict=True) if w > 0), default=whole) if floor > 0 else whole
    target = [total * w for w in weights]

    def worst(totals: list[float]) -> float:
        return max((abs(g - t) / t for g, t in zip(totals, target, strict=True) if t > 0), default=0.0)

    best, since = (worst(got), pulls, got), 0
    for _ in range(steps):
        if best[0] < close:
            break
        if since == PATIENCE:
            # a domain has too much even without copies of its own: a larger total makes room for it
            total = max((g / w for g, w in zip(best[2], weights, strict=True) if w > 0), default=total)
            target = [total * w for w in weights]
            best, since = (worst(best[2]), best[1], best[2]), 0
        pulls = [x - (g - t) / n if n > 0 else x for x, g, t, n in zip(pulls, got, target, now, strict=True)]
        got = reached(pulls)
        since += 1
        if worst(got) < 0.99 * best[0]:
            best, since = (worst(got), pulls, got), 0
    return marks.withColumn("rate", rate(best[1])), target, best[2]


def mixing_rates(
    docs: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", trust: float = TRUST, floor: float = 1.0, carried: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, tokens, domain, p_domain, rate, copies, target_tokens, reached_tokens`` (and ``carried``
    columns), one row per document."""
    plain = docs.select(F.col(id_col).alias("doc_id"), *carried, F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    found = features(F.col("_text"))
    marked = stage(plain.select("doc_id", *carried, "_source", *[c.alias(n) for n, c in found.items()]), "marks")
    natural = targets is None
    targets = natural_targets(marked, "_source") if natural else targets
    names = sorted(n for n, w in targets.items() if w > 0)
    whole = sum(targets[n] for n in names)
    place = F.try_element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("_source")) if names else F.lit(None)
    if natural and OTHERS in targets:
        place = F.when(F.col("_source").isNotNull(), F.coalesce(place, F.lit(names.index(OTHERS))))
    narrow = marked.withColumn("label", place.cast("int")).drop("_source")
    if not names:
        nothing = F.lit(None).cast("double")
        out = narrow.withColumns({
            "domain": F.lit(None).cast("string"), "p_domain": nothing, "rate": F.lit(1.0), "target_tokens": nothing, "reached_tokens": nothing,
        })
    else:
        kinds = stage(
            narrow.groupBy(*FEATURES).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "kinds"
        )
        soft = stage(kinds.withColumn("p", _posterior(kinds, names, trust)), "soft")
        rates, wanted, reached = fit_rates(soft, [targets[n] / whole for n in names], floor)
        best = F.array_max("p")
        at = F.array_position("p", best).cast("int")
        rated = rates.select(
            *[F.col(f).alias(f"_{f}") for f in FEATURES], "rate", best.alias("p_domain"),
            *[F.element_at(F.array(*map(F.lit, xs)), at).alias(n) for n, xs in (
                ("domain", names), ("target_tokens", wanted), ("reached_tokens", reached),
            )],
        )
        same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in FEATURES])
        out = narrow.join(rated, same)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return out.select("doc_id", *carried, "tokens", "domain", "p_domain", "rate", copies.alias("copies"), "target_tokens", "reached_tokens")


def mixed(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every row as often as its copies say."""
    uid, n, one = (unused(docs, c) for c in ("_uid", "_copies", "_copy"))
    held = stage(docs.withColumn(uid, F.monotonically_increasing_id()), "texts")
    copies = mixing_rates(held, targets, carried=(uid,)).select(uid, F.col("copies").alias(n))
    return (
        held.join(copies, uid).where(F.col(n) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n))))
        .drop(uid, n, one)
    )
