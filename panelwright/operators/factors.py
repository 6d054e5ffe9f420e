"""Triangular factors of tall designs: least squares without forming cross products.

Each batch of complete rows ``[1, X]`` becomes the R factor of its QR decomposition, a K x K matrix;
two of them combine by the QR decomposition of one on top of the other (tall-skinny QR). Cross
products would square the condition number of the design; this does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.moments import SCHEMA, Grouping, all_rows, merged, partials


@dataclass
class Factor:
    """``r``: R factor of ``n`` rows; column 0 is the constant 1."""

    n: int
    r: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Factor:
        return cls(len(x), _triangle(np.column_stack([np.ones(len(x)), x])))

    def __add__(self, other: Factor) -> Factor:
        return Factor(self.n + other.n, _triangle(np.vstack([self.r, other.r])))

    def take(self, cols: Sequence[int]) -> np.ndarray:
        """R factor of the constant and the columns ``cols`` (counted from 0, without it)."""
        return _triangle(self.r[:, [0, *[c + 1 for c in cols]]])

    def to_bytes(self) -> bytes:
        return np.concatenate([[float(self.n)], self.r.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Factor:
        flat = np.frombuffer(data, dtype=float)
        k = int(round((flat.size - 1) ** 0.5))
        return cls(int(flat[0]), flat[1:].reshape(k, k))


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Square R factor of ``rows``, with rows of zeros if there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    k = rows.shape[1]
    return r if len(r) == k else np.vstack([r, np.zeros((k - len(r), k))])


def collect_factors(
    df: DataFrame, cols: Sequence[str], group: Grouping = all_rows
) -> dict[str, Factor]:
    """Factor of ``[1, cols]`` for each group of rows; ``group`` yields keyed blocks of complete
    rows. Each key costs one K x K result."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return merged(numbers.mapInArrow(partials(Factor.of, group), SCHEMA), Factor)
