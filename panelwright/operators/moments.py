"""Pairwise-complete second moments of many columns in one pass.

Each task turns its Arrow batches into K x K matrices and emits one row; those rows are merged
by a tree of fixed fan-in, as high as their number asks for, so no task and not the driver ever sees more than
``FAN_IN`` K x K matrices of a key at once, whatever the number of rows and tasks. Matrices are
centred where they are made and merged with the parallel update of Chan, Golub & LeVeque
(1983), so no precision is lost on columns with a large mean, and no earlier pass is needed
to find the means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64
#: Bytes up to which the last matrices are merged on the driver.
COLLECTED = 64 << 20
SCHEMA = "key string, part int, payload binary"


@dataclass
class Moments:
    """For columns i, j over the rows where both are present: ``n[i, j]`` rows, ``mean[i, j]``
    of i, ``sxx[i, j]`` centred squares of i, ``sxy[i, j]`` centred products."""

    n: np.ndarray
    mean: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Moments of a batch; NaN stands for NULL."""
        missing = np.isnan(x)
        present = (~missing).astype(float)
        seen = np.maximum(present.sum(axis=0), 1.0)
        # Shifting by a value of the column first keeps a constant column exactly constant.
        rows = np.argmax(~missing, axis=0)
        first = np.where(missing.all(axis=0), 0.0, x[rows, np.arange(x.shape[1])])
        z = np.where(missing, 0.0, x - first)
        drift = z.sum(axis=0) / seen
        z = np.where(missing, 0.0, z - drift)
        n = present.T @ present
        total = z.T @ present
        square = (z * z).T @ present
        rows_or_one = np.maximum(n, 1.0)
        sxx = square - total**2 / rows_or_one
        sxx[sxx <= 1e-12 * square] = 0.0
        sxy = z.T @ z - total * total.T / rows_or_one
        return cls(n, (first + drift)[:, None] + total / rows_or_one, sxx, sxy)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1.0)
        step = np.where(other.n > 0, other.mean - self.mean, 0.0)
        mean = np.where(self.n > 0, self.mean + step * share, other.mean)
        weight = self.n * share
        return Moments(
            n,
            mean,
            self.sxx + other.sxx + step**2 * weight,
            self.sxy + other.sxy + step * step.T * weight,
        )

    def correlation(self) -> np.ndarray:
        """Pearson r; NaN where a column is constant or fewer than two rows are shared."""
        # Means of a constant differ by rounding between batches; that is not variance.
        noise = self.n * (1e-12 * self.mean) ** 2
        varies = (self.n > 1) & (self.sxx > noise)
        norm = np.sqrt(np.where(varies, self.sxx, 0.0)) * np.sqrt(
            np.where(varies.T, self.sxx.T, 0.0)
        )
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norm > 0, np.clip(self.sxy / norm, -1.0, 1.0), np.nan)

    def to_bytes(self) -> bytes:
        return np.stack([self.n, self.mean, self.sxx, self.sxy]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Moments:
        flat = np.frombuffer(data, dtype=float)
        k = int(round((flat.size / 4) ** 0.5))
        return cls(*flat.reshape(4, k, k))


Grouping = Callable[[np.ndarray], Iterable[tuple[str, np.ndarray]]]


def all_rows(x: np.ndarray) -> Iterable[tuple[str, np.ndarray]]:
    return [("", x)]


def partials(of: Callable[[np.ndarray], object], group: Grouping, prefix: str = ""):
    """One row per task and key, with the combined ``of`` of its row blocks; ``prefix`` goes before the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, object] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for key, rows in group(x.astype(float, copy=False)):
                if len(rows):
                    part = of(rows)
                    acc[key] = acc[key] + part if key in acc else part
        if acc:
            yield pa.RecordBatch.from_pydict(
                {
                    "key": [prefix + k for k in acc],
                    "part": pa.array([TaskContext.get().partitionId()] * len(acc), pa.int32()),
                    "payload": pa.array([m.to_bytes() for m in acc.values()], pa.binary()),
                }
            )

    return run


def _merge(kind: type):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = _sum(kind, group["payload"])
        return pd.DataFrame(
            {"key": group["key"].iloc[:1], "part": group["part"].iloc[:1], "payload": total.to_bytes()}
        )

    return merge


def merged(rows: DataFrame, kind: type) -> dict:
    """All rows ``(key, part, payload)`` of each key combined, by a tree over ``part``.

    A group holds the rows of ``FAN_IN`` neighbouring parts, so its size does not grow with the
    number of tasks.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tasks, size = rows.agg(F.max("part") + 1, F.sum(F.length("payload"))).first()
        top = rows
        while (tasks or 0) > FAN_IN or (tasks or 0) > 1 and size > COLLECTED:
            top = top.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
            top = top.groupBy("key", "part").applyInPandas(_merge(kind), SCHEMA)
            tasks, size = -(-tasks // FAN_IN), size // FAN_IN
        found = top.collect()
    finally:
        rows.unpersist()
    out: dict = {}
    for row in found:
        part = kind.from_bytes(row["payload"])
        out[row["key"]] = out[row["key"]] + part if row["key"] in out else part
    return out


def merged_rows(rows: DataFrame, kind: type, levels: int = 3) -> DataFrame:
    """What :func:`merged` gives as one row ``(key, part, payload)`` a key, which stays on the executors.

    ``levels`` of the tree are enough for 64^levels tasks.
    """
    for _ in range(levels):
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        rows = rows.groupBy("key", "part").applyInPandas(_merge(kind), SCHEMA)
    return rows


def _sum(kind: type, payloads: Iterable[bytes]):
    total = None
    for data in payloads:
        part = kind.from_bytes(data)
        total = part if total is None else total + part
    return total


def collect_moments(df: DataFrame, cols: Sequence[str]) -> Moments | None:
    """Moments of ``cols`` over all rows, NaN and NULL being missing; None without a row."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return merged(numbers.mapInArrow(partials(Moments.of, all_rows), SCHEMA), Moments).get("")
