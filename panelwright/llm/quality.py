"""Quality rules: documents whose statistics lie far from those of their language and source.

Each text becomes a vector of transformed statistics. For each (language, source) the minimum
covariance determinant estimate of its different vectors (Rousseeuw's C-steps on the nearest half from three deterministic
starts, then reweighting) gives a centre and scatter that junk cannot move, short of half of them; texts whose Mahalanobis distance
is beyond a chi-square quantile are rejected.

The statistics of a text are the only thing made in Python. C-steps are aggregations over the
small table of vectors, combined before each shuffle, so a source with a third of all texts is
spread over all tasks; matrices are inverted one row a group on the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import written
from panelwright.llm.tokens import WHITE, mix, pieces, shingles, word_hashes, words

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Share of each group that a fit rests on; floors keep the scatter of any number of vectors regular.
SHARE = 0.5
#: Least standard deviation of each transformed statistic: smaller differences mean nothing. One line
#: said twice in a short text is no junk, so repeated lines and words have wider ones.
FLOORS = (0.05, 0.05, 0.08, 0.08, 0.05, 0.05)
#: Groups with fewer different vectors are pooled by language, then altogether.
LEAST = 100
#: Share of normal vectors beyond the cut.
TAIL = 1e-7
MIN_WORDS = 50
#: Groups up to which their fits (some 250 bytes each) go to all executors; more are joined.
SMALL = 100_000


def _sums(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return np.diff(total[at])


def _again(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.r_[False, same] | np.r_[same, False] if len(key) else out
    return out


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Base statistics of whole texts (see ``COUNTS``)."""
    start, end, first = words(data, at)
    inside = ~WHITE[data]
    hashes = word_hashes(data, start, end, fold=False)
    n = np.diff(first)

    breaks = np.flatnonzero(data == 10)
    low = np.sort(np.concatenate([at[:-1], breaks + 1]))
    high = np.sort(np.concatenate([at[1:], breaks]))
    doc = np.searchsorted(at, high, "left") - 1
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    full = filled[high] > filled[low]
    low, high, doc = low[full], high[full], doc[full]
    line = mix(word_hashes(data, low, high, fold=False) + (high - low).astype(np.uint64)) + mix(doc.astype(np.uint64))
    order = np.argsort(line)
    repeat = np.zeros(len(line), bool)
    repeat[order[1:]] = line[order][1:] == line[order][:-1]

    window, of = shingles(hashes, first, 3)
    many = n[of] >= 3
    place = np.flatnonzero((first[1:][np.repeat(np.arange(len(n)), n)] - np.arange(len(hashes))) >= 3)
    twice = place[_again(window[many] + mix(of[many].astype(np.uint64)))]
    covered = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        covered[twice + j] = True
    return {
        "n_words": n,
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), at),
        "n_symbols": _sums(_SYMBOLS[data], at),
        "n_dup_lines": np.bincount(doc[repeat], minlength=len(n)),
        "n_repeat_words": _sums(covered[: len(hashes)], first),
        "n_lines": np.bincount(doc, minlength=len(n)),
        "n_upper": _sums(_UPPER[data], at),
        "n_marks": _sums(_MARKS[data], at),
    }


def _counted(batches):
    for rows, data, at in pieces(batches, "text"):
        found = counts(data, at)
        rest = [rows.column(c) for c in rows.schema.names if c != "text"]
        names = [c for c in rows.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*rest, *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=[*names, *COUNTS])


def _vector() -> list[Column]:
    """Transformed statistics: the log of a size, square roots of shares of characters, plain shares of repeats."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.col("n_lines"),
        F.col("n_repeat_words") / n,
        F.sqrt(F.col("n_upper") / chars),
        F.sqrt(F.col("n_marks") / n),
    ]


P = 6
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
PARAMS = ["log_det", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]]


def chi2_cdf(x: float, k: float) -> float:
    """Series of the regularised incomplete gamma function; runs until a term no longer counts."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 10.0 * k + 400
    while high - low > 1e-9 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _consistent(share: float) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal vectors that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _distance() -> Column:
    """Squared Mahalanobis distance by the inverse Cholesky factor ``l``."""
    out = F.lit(0.0)
    for i in range(P):
        side = sum((F.col(f"l{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        out = out + side * side
    return out


def _moments() -> list[Column]:
    c = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    return [F.count("*").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.sum(c[i]).alias(f"s{i}") for i in range(P)], *[F.sum(c[i] * c[j]).alias(f"s{i}{j}") for i, j in PAIRS]]


def _fitted(factor: float):
    def run(batches):
        for t in batches:
            out = []
            for r in t.to_dict("records"):
                n = r["n"]
                mean = np.array([r[f"s{i}"] for i in range(P)]) / n
                scatter = np.zeros((P, P))
                for i, j in PAIRS:
                    scatter[i, j] = scatter[j, i] = r[f"s{i}{j}"] / n - mean[i] * mean[j]
                scatter = factor * scatter + np.diag(np.square(FLOORS))
                root = np.linalg.inv(np.linalg.cholesky(scatter))
                centre = np.array([r[f"m{i}"] for i in range(P)]) + mean
                out.append([r["grp"], r["start"], -2 * np.log(np.diag(root)).sum(), *centre, *[root[i, j] for i, j in PAIRS]])
            yield pd.DataFrame(out, columns=["grp", "start", *PARAMS])

    return run


_SCHEMA = "grp string, start int, " + ", ".join(f"{c} double" for c in PARAMS)


def _sent(groups: DataFrame, few: bool) -> DataFrame:
    """A table of groups ready to be joined: rows of one source need not meet for it if the groups are few."""
    return F.broadcast(groups) if few else groups


def _step(vectors: DataFrame, params: DataFrame, cut: Column | None, factor: float, few: bool) -> DataFrame:
    """New centre and scatter of each fit from the vectors within ``cut``, or its nearest ``SHARE``."""
    near = vectors.join(_sent(params, few), "grp").withColumn("d2", _distance())
    if cut is None:
        edge = near.groupBy("grp", "start").agg(F.percentile_approx("d2", SHARE, 2000).alias("edge"))
        near, cut = near.join(_sent(edge, few), ["grp", "start"]), F.col("edge")
    kept = near.where(F.col("d2") <= cut).groupBy("grp", "start").agg(*_moments())
    return written(kept.mapInPandas(_fitted(factor), _SCHEMA), "fit")


def _starts(vectors: DataFrame, few: bool) -> DataFrame:
    """Three first fits of each group: coordinate-wise median and spread; correlation of squashed values; and the median
    with the spread of the narrower side, which junk on one side leaves as it is."""
    middle = vectors.groupBy("grp").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in X])
    spread = [F.greatest(F.lit(low), (F.col(x)[2] - F.col(x)[0]) / 1.349) for x, low in zip(X, FLOORS, strict=True)]
    narrow = [F.greatest(F.lit(low), F.least(F.col(x)[2] - F.col(x)[1], F.col(x)[1] - F.col(x)[0]) / 0.6745) for x, low in zip(X, FLOORS, strict=True)]
    middle = written(middle.select("grp", *[F.col(x)[1].alias(f"m{i}") for i, x in enumerate(X)], *[s.alias(f"z{i}") for i, s in enumerate(spread)], *[s.alias(f"y{i}") for i, s in enumerate(narrow)]), "fit")

    def diagonal(start: int, side: str) -> DataFrame:
        return middle.select("grp", F.lit(start).alias("start"), F.lit(0.0).alias("log_det"), *[f"m{i}" for i in range(P)], *[((1 / F.col(f"{side}{i}")) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS])

    plain = diagonal(0, "z").unionByName(diagonal(2, "y"))
    squashed = vectors.join(_sent(middle, few), "grp").select("grp", F.lit(1).alias("start"), *[F.col(f"m{i}") for i in range(P)], *[(F.col(f"m{i}") + F.col(f"z{i}") * F.tanh((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"z{i}"))).alias(f"x{i}") for i in range(P)])
    second = squashed.groupBy("grp", "start").agg(*_moments()).mapInPandas(_fitted(1.0), _SCHEMA)
    return written(plain.unionByName(second), "fit")


def fits(vectors: DataFrame, few: bool) -> DataFrame:
    """One row a group: centre and inverse Cholesky factor of its reweighted MCD estimate.

    C-steps go on until no determinant falls by more than a thousandth; they end, since the floors of the spreads hold every
    determinant up (ten or so are usual).
    """
    now = _step(vectors, _starts(vectors, few), None, _consistent(SHARE), few)
    while True:
        new = _step(vectors, now, None, _consistent(SHARE), few)
        fall = new.join(now.select("grp", "start", F.col("log_det").alias("before")), ["grp", "start"])
        now = new
        if not fall.where("before - log_det > 0.001").limit(1).count():
            break
    best = now.groupBy("grp").agg(F.min_by(F.struct("start", *PARAMS), F.struct("log_det", "start")).alias("b")).select("grp", "b.*")
    usual = chi2_quantile(0.975, P)
    return _step(vectors, best, F.lit(usual), 0.975 / chi2_cdf(usual, P + 2), few)


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """``(row, counts ..., base_failed, distance, kept)``: each row without its text as a struct, statistics and verdict.

    A null or empty text has no words. ``base_failed``: fewer than 50 words, or more than half
    of them in repeated 3-word windows; such texts are rejected and take no part in a fit. The
    others are kept if their squared distance from the centre of their group is within the
    chi-square quantile of ``1 - tail``. A group is a (language, source), null being a value of its
    own; groups of fewer than ``LEAST`` different vectors are pooled by language and then altogether, and a
    pool that is still too small rejects nothing (null distance). Ids are not looked at, so they
    may be null or repeat.
    """
    rest = [c for c in docs.columns if c != text]
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text).alias("text"))
    stats = bare.mapInArrow(_counted, f"row {bare.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "stats")

    name = [F.coalesce(F.concat(F.lit("="), F.col(f"row.`{c}`").cast("string")), F.lit("")) for c in (lang, source)]
    size = stats.where("not base_failed").select(name[0].alias("g_lang"), name[1].alias("g_source"), *COUNTS).distinct().groupBy("g_lang", "g_source").count()
    own = F.when(F.col("count") >= LEAST, F.concat_ws("\n", "g_lang", "g_source"))
    size = size.withColumn("own", own)
    small = size.where("own is null").groupBy("g_lang").agg(F.sum("count").alias("pooled"))
    size = size.join(small, "g_lang", "left").select("g_lang", "g_source", F.coalesce("own", F.when(F.col("pooled") >= LEAST, F.col("g_lang")), F.lit("\n\n")).alias("grp"))
    size = written(size, "groups")
    few = size.count() <= SMALL
    vector = stats.withColumns({"g_lang": name[0], "g_source": name[1]}).join(_sent(size, few), ["g_lang", "g_source"], "left")
    vector = vector.withColumns({x: F.when(~F.col("base_failed"), v) for x, v in zip(X, _vector(), strict=True)})
    vector = written(vector.select("row", *COUNTS, "base_failed", "grp", *X), "vectors")
    used = written(vector.where("not base_failed").select("grp", *X).distinct(), "used")  # copies count once
    used = used.join(_sent(used.groupBy("grp").count().where(F.col("count") >= LEAST).select("grp"), few), "grp", "left_semi")
    fit = fits(used, few)
    cut = chi2_quantile(1 - tail, P)
    out = vector.join(_sent(fit.drop("start", "log_det"), few), "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select("row", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"))
