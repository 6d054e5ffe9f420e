"""Greedy forward selection by adjusted R squared."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.factors import Factor, collect_factors
from panelwright.operators.regress import solve
from panelwright.sources.scan import nan_to_null

_SCHEMA = "step int, term string, adj_r2 double"
#: Bytes and number of factors, one for each pattern of missing values, that the driver holds; rows of rarer patterns are
#: read at each step.
HELD, PATTERNS = 256 << 20, 1024


def forward_selection(df: DataFrame, y: str, candidates: Sequence[str] | None = None) -> DataFrame:
    """Add the term that raises adjusted R squared most, while one raises it, from 0 upwards.

    Every candidate model is fitted on its own complete rows. One pass reduces the rows of each pattern of missing
    values to a triangular factor of the columns they have. Candidates that are complete in the same patterns share
    those factors, one under the other, with the selected terms projected out of their columns: a step projects out one
    term more and scores a candidate by one inner product, and factors are put together anew only where a new term
    lacks in a pattern. Rows of patterns beyond the commonest ``PATTERNS`` are read at each step, where its terms
    are complete, and add to every candidate's factor.
    Equal scores go to the name that sorts last. Candidates are all other numeric columns by
    default. Nothing selected gives no rows: the intercept alone.
    """
    names = list(candidates) if candidates is not None else _numeric_columns(df, y)
    columns = [y, *names]
    data = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    data = data.where(F.col(y).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names], F.lit(""))
        most = max(1, min(PATTERNS, HELD // (8 * (len(columns) + 1) ** 2)))
        common = data.groupBy(missing.alias("missing")).count().orderBy(F.desc("count"), "missing").limit(most + 1)
        common = [r["missing"] for r in common.collect()]
        rest = data.where(~missing.isin(common[:most])) if len(common) > most else None
        factors = collect_factors(data, columns, _by_pattern(frozenset(common[:most])))
        rows = _greedy(names, _Scores(columns, factors, rest))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def _numeric_columns(df: DataFrame, y: str) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != y
    ]


def _by_pattern(held: frozenset[str]):
    """The rows of each held pattern, with the columns they have."""

    def group(x: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        missing = np.isnan(x[:, 1:])
        kinds, of = np.unique(missing, axis=0, return_inverse=True)
        for k, kind in enumerate(kinds):
            name = "".join("1" if m else "0" for m in kind)
            if name in held:
                yield name, x[of.ravel() == k][:, np.r_[True, ~kind]]

    return group


def _greedy(names: Sequence[str], scores: Callable[[list[str], list[str]], dict]) -> list[tuple]:
    selected: list[str] = []
    remaining = list(names)
    best = 0.0
    rows = []
    while remaining:
        # Rounded, so that equal models tie whatever the order their sums were added in.
        scored = [
            (round(score, 12), name)
            for name, score in scores(selected, remaining).items()
            if not math.isnan(score)
        ]
        top, name = max(scored, default=(best, ""))
        if top <= best:
            break
        best = top
        remaining.remove(name)
        selected.append(name)
        rows.append((len(selected), name, top))
    return rows


class _Residuals:
    """Columns of a factor without what the constant and the chosen terms explain of them."""

    def __init__(self, factor: Factor, names: Sequence[str], chosen: Sequence[str]) -> None:
        """``factor`` has the target first, then the columns ``names``."""
        self.factor, self.names = factor, list(names)
        r = factor.r
        self.length = np.linalg.norm(r, axis=0)
        first = r[:, :1] / self.length[0]
        self.basis, self.left = first, r - first @ (first.T @ r)
        self.tss = float(self.left[:, 1] @ self.left[:, 1])
        self.tiny = np.finfo(float).eps * max(factor.n, len(r)) ** 0.5 * len(r)
        for name in chosen:
            self.add(name)

    def add(self, name: str) -> None:
        """Project one more column out; a column the others explain changes nothing."""
        k = self.names.index(name) + 2
        q = self.left[:, k] - self.basis @ (self.basis.T @ self.left[:, k])
        size = np.linalg.norm(q)
        if size <= self.tiny * self.length[k]:
            return
        q = (q / size)[:, None]
        self.basis = np.hstack([self.basis, q])
        self.left = self.left - q @ (q.T @ self.left)

    def scores(self, wanted: Sequence[str]) -> dict[str, float]:
        """Adjusted R squared with each further column."""
        at = np.array([self.names.index(c) + 2 for c in wanted])
        target, columns = self.left[:, 1], self.left[:, at]
        square = (columns * columns).sum(axis=0)
        new = np.sqrt(square) > self.tiny * self.length[at]
        explained = np.where(new, (target @ columns) ** 2 / np.where(new, square, 1.0), 0.0)
        free = self.factor.n - self.basis.shape[1] - new
        with np.errstate(divide="ignore", invalid="ignore"):
            missed = np.maximum(target @ target - explained, 0.0) / self.tss if self.tss > 0 else np.full(len(at), math.nan)
            found = np.where(free > 0, 1.0 - missed * (self.factor.n - 1) / free, math.nan)
        return dict(zip(wanted, found.tolist(), strict=True))


class _Scores:
    """Adjusted R squared of the first column on the selected ones and each remaining one."""

    def __init__(self, columns: list[str], factors: dict[str, Factor], rest: DataFrame | None) -> None:
        self.columns, self.factors, self.rest = columns, factors, rest
        self.has = {p: frozenset(c for c, m in zip(columns[1:], p, strict=True) if m == "0") for p in factors}
        self.held: dict[frozenset[str], tuple[int, _Residuals]] = {}

    def __call__(self, selected: list[str], remaining: list[str]) -> dict[str, float]:
        chosen = set(selected)
        complete = [p for p, has in self.has.items() if chosen <= has]
        groups: dict[frozenset[str], list[str]] = {}
        for name in remaining:
            groups.setdefault(frozenset(p for p in complete if name in self.has[p]), []).append(name)
        rest = self._rest(selected, remaining)
        held, out = {}, {}
        for patterns, names in groups.items():
            if rest is not None:
                out |= {name: self._with(rest.get(name), patterns, selected, name) for name in names}
            elif not patterns:
                out |= dict.fromkeys(names, math.nan)
            else:
                done, left = self.held.get(patterns, (0, None))
                if left is None or not {*names, *selected[done:]} <= set(left.names):
                    done, left = len(selected), _Residuals(self._joined(patterns, [*selected, *names]), [*selected, *names], selected)
                for name in selected[done:]:
                    left.add(name)
                held[patterns] = (len(selected), left)
                out |= left.scores(names)
        self.held = held
        return out

    def _joined(self, patterns: frozenset[str], names: list[str]) -> Factor | None:
        """Factor of the target and ``names`` over the rows of all ``patterns``."""
        total = None
        for p in sorted(patterns):
            place = {c: k for k, c in enumerate(c for c in self.columns if c == self.columns[0] or c in self.has[p])}
            part = Factor(self.factors[p].n, self.factors[p].take([place[c] for c in (self.columns[0], *names)]))
            total = part if total is None else total + part
        return total

    def _rest(self, selected: list[str], remaining: list[str]) -> dict[str, Factor] | None:
        if self.rest is None:
            return None
        base = [self.columns[0], *selected]
        head = list(range(len(base)))

        def per_candidate(x: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
            for i, name in enumerate(remaining, start=len(base)):
                yield name, x[~np.isnan(x[:, i])][:, [*head, i]]

        return collect_factors(self.rest.dropna(subset=base), [*base, *remaining], per_candidate)

    def _with(self, part: Factor | None, patterns: frozenset[str], selected: list[str], name: str) -> float:
        joined = self._joined(patterns, [*selected, name])
        part = joined if part is None else part if joined is None else joined + part
        return math.nan if part is None else solve(part, 0, range(1, len(selected) + 2)).adj_r2
