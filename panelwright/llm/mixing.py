"""Rates at which to take documents so that domains reach target weights.

A Gaussian naive Bayes classifier, fitted on documents of known domain, gives every document
posterior probabilities of the domains from statistics of its whole text. The rates w >= 0 minimise

    1/2 * sum over domains d of (sum_i w_i t_i p_id - T_d)^2 / S_d

where t are tokens, p posteriors, T target totals and S the totals at rate 1. In the metric of
the tokens the gradient is p_i . (A - T) / S, its Lipschitz constant is 1 at most (p sums to 1), and
projection cuts each rate at 0, so w <- max(0, w - p . (A - T) / S) converges from w = 1 and stays
as near to 1 as the targets allow. A step is one aggregation of as many sums as there are domains;
the rates themselves never leave the executors. Everything is made of built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import written

TOKEN = r"[^\x20\x09-\x0D]+"
#: Characters whose share in a text tells languages and junk apart.
SETS = {
    "umlauts": "[äöüßÄÖÜ]",
    "french": "[éèêëçàâùûîïôœÉÈÊÇÀ]",
    "spanish": "[ñóíáúÑÓÍÁÚ¿¡]",
    "symbols": "[#*$%&|<>!]",
    "capitals": "[A-Z]",
    "spaces": r"[\x20\x09-\x0D]",
}
FEATURES = [*SETS, "wide", "size", "variety"]
#: Least standard deviation of a feature within a domain.
FLOOR = 0.02
#: Steps between two writings of the rates.
STRIDE = 6


def features(text: str) -> dict[str, Column]:
    """Square roots of character shares, the log of the length, and the share of distinct words, of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = F.greatest(F.char_length(t), F.lit(1))
    pieces = F.split(t, " ")
    out = {k: F.sqrt(F.regexp_count(t, F.lit(p)) / chars) for k, p in SETS.items()}
    out["wide"] = F.sqrt((F.octet_length(t) - F.char_length(t)) / chars)
    out["size"] = F.log1p(F.char_length(t)) / 20
    out["variety"] = F.size(F.array_distinct(pieces)) / F.size(pieces)
    return out


def classifier(rows: DataFrame, domain: str, domains: list[str]) -> list[Column]:
    """Log posteriors, up to a common term, of ``domains`` in terms of ``FEATURES``.

    ``rows`` has features and a known domain; the driver gets two numbers for each feature and domain.
    A domain without a row cannot be told from the others and is an error.
    """
    found = rows.where(F.col(domain).isin(domains)).groupBy(domain).agg(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES],
        *[F.var_pop(f).alias(f"v_{f}") for f in FEATURES],
    )
    found = {r[domain]: r for r in found.collect()}
    if missing := [d for d in domains if d not in found]:
        raise ValueError(f"no labelled document of domain {missing[0]}")
    total = sum(r["n"] for r in found.values())
    out = []
    for d in domains:
        r = found[d]
        score = F.lit(math.log(r["n"] / total))
        for f in FEATURES:
            var = r[f"v_{f}"] + FLOOR**2
            gap = F.col(f) - r[f"m_{f}"]
            score = score - gap * gap / (2 * var) - math.log(var) / 2
        out.append(score)
    return out


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, tokens, p0, p1, ...)``: each row without its text as a struct, its words, and its domain posteriors.

    ``labelled`` has ``id`` and ``domain``. All documents are read, and all labelled ones fit the classifier.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    made = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).alias("tokens"), *[c.alias(f) for f, c in features(text).items()])
    made = written(made, "features")
    known = labelled.select(F.col(id).alias("known_id"), F.col("domain").alias("known")).where("known is not null")
    score = classifier(made.join(known, F.col(f"row.`{id}`") == F.col("known_id")), "known", domains)
    scored = made.select("row", "tokens", *[s.alias(f"s{k}") for k, s in enumerate(score)])
    best = F.greatest(*[F.col(f"s{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("s0")
    scored = scored.select("row", "tokens", *[F.exp(F.col(f"s{k}") - best).alias(f"e{k}") for k in range(len(domains))])
    whole = sum((F.col(f"e{k}") for k in range(len(domains))), F.lit(0.0))
    return scored.select("row", "tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(len(domains))])


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None, id: str = "doc_id", text: str = "text", total: float | None = None, temper: float = 1.0, tolerance: float = 1e-3) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """``(row, tokens, posteriors, rate)`` of each row, and the totals by domain: natural, target, reached.

    ``targets`` gives the weight of each domain. Where it is None, the weights are the natural shares
    of the labelled domains to the power ``temper``, and the total is the least for which no domain
    is asked for less than it has. Otherwise ``total`` is in tokens (words), by default all there
    are. Steps go on until every total is within ``tolerance`` of the whole from its target, or the
    totals no longer change (targets that no nonnegative rates reach), however many that takes; what was reached is
    returned, and :func:`missed` says how far from the targets that is. Null and empty texts have no tokens and get the rate of their
    posteriors. Null ids are not labelled; rows that share an id are labelled alike. Where no document is labelled and no
    targets are given, all rates are 1. Other columns come back in ``row``, whatever their names. An empty
    table gives an empty result.
    """
    if targets is None:
        domains = sorted(r[0] for r in labelled.select("domain").where("domain is not null").distinct().collect())  # labels of one classifier, a handful
    else:
        domains = list(targets)
    n = len(domains)
    if not domains or docs.isEmpty():
        count = F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))
        same = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), count.alias("tokens"), F.array(*[F.lit(0.0)] * n).cast("array<double>").alias("posteriors"), F.lit(1.0).alias("rate"))
        return same, {d: {"natural": 0.0, "target": 0.0, "reached": 0.0} for d in domains}
    p = [f"p{k}" for k in range(n)]
    now = written(posteriors(docs, labelled, domains, id, text).withColumn("w", F.lit(1.0)), "rates")

    def totals(table: DataFrame, w: Column) -> list[float]:
        row = table.agg(*[F.sum(w * F.col("tokens") * F.col(x)) for x in p]).first()
        return [float(x or 0.0) for x in row]

    natural = totals(now, F.lit(1.0))
    if targets is None:
        weight = [s**temper for s in natural]
        scale = sum(weight) or 1.0
        goal_total = max((s * scale / w for s, w in zip(natural, weight, strict=True) if w), default=0.0)
    else:
        weight, scale = [float(targets[d]) for d in domains], float(sum(targets.values()))
        goal_total = sum(natural) if total is None else float(total)
    goal = [goal_total * x / scale for x in weight]

    w, reached, pending = F.col("w"), natural, 0
    while True:
        if max(abs(a - t) for a, t in zip(reached, goal, strict=True)) <= tolerance * max(goal_total, 1.0):
            break
        step = [(a - t) / max(s, 1e-9) for a, t, s in zip(reached, goal, natural, strict=True)]
        move = sum((F.col(x) * F.lit(g) for x, g in zip(p, step, strict=True)), F.lit(0.0))
        w = F.greatest(F.lit(0.0), w - move)
        pending += 1
        if pending == STRIDE:
            now = written(now.withColumn("w", w), "rates")
            w, pending = F.col("w"), 0
        before, reached = reached, totals(now, w)
        if max(abs(a - b) for a, b in zip(reached, before, strict=True)) <= 1e-3 * tolerance * max(goal_total, 1.0):
            break
    out = now.select("row", "tokens", F.array(*p).alias("posteriors"), w.alias("rate"))
    report = {d: {"natural": s, "target": t, "reached": a} for d, s, t, a in zip(domains, natural, goal, reached, strict=True)}
    return out, report


def missed(report: dict[str, dict[str, float]]) -> float:
    """The largest gap between a domain's reached total and its target, as a share of all targets."""
    whole = sum(r["target"] for r in report.values())
    return max((abs(r["reached"] - r["target"]) for r in report.values()), default=0.0) / max(whole, 1.0)


def copies(rate: Column, id: Column, seed: int = 1) -> Column:
    """How often to take a document: its rate, rounded up or down by a hash of seed and id so that the mean is the rate."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + drawn).cast("int")
