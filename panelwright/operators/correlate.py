"""Pearson correlation over pairwise-complete rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.moments import SCHEMA, Moments, all_rows, collect_moments, merged_rows, partials

#: Columns up to which one matrix of all serves, and columns of a tile beyond.
WHOLE, TILE = 512, 256
_SCHEMA = "var_x string, var_y string, n bigint, r double"


def correlate(
    df: DataFrame, cols: Sequence[str], targets: Sequence[str] | None = None
) -> DataFrame:
    """Long correlation matrix ``(var_x, var_y, n, r)``: every column against ``targets``
    (default: all). ``n`` counts the rows where both are present; a constant gives NULL.

    More than ``WHOLE`` columns are correlated tile by tile, see :func:`tiled`; the matrix then stays on the executors.
    """
    cols = list(cols)
    names = cols + [t for t in targets or () if t not in cols]
    if len(names) > WHOLE:
        return tiled(df, cols, targets)
    moments = collect_moments(df, names)
    rows = []
    r = None if moments is None else moments.correlation()
    for i, x in enumerate(cols):
        for y in targets or cols:
            j = names.index(y)
            known = r is not None and r[i, j] == r[i, j]
            n = 0 if moments is None else int(moments.n[i, j])
            rows.append((x, y, n, float(r[i, j]) if known else None))
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def tiled(df: DataFrame, cols: list[str], targets: Sequence[str] | None, size: int = TILE) -> DataFrame:
    """The long matrix of very many columns.

    Columns fall into blocks of ``size``, and each pair of blocks is a tile of its own: a scan of its columns alone, whose
    tasks hold the moments of two blocks and never those of all columns. Tiles are merged by the tree, and each gives
    its rows where it was merged. Tiles are read one beside the other in one job; a frame that is costly
    to compute is better cached, as each of its columns is read once for each block.
    """
    blocks = [cols[k : k + size] for k in range(0, len(cols), size)]
    if targets is None:
        tiles = [(x, y) for i, x in enumerate(blocks) for y in blocks[i:]]
    else:
        wanted = list(dict.fromkeys(targets))
        tiles = [(x, wanted[k : k + size]) for x in blocks for k in range(0, len(wanted), size)]
    parts = []
    for k, (x, y) in enumerate(tiles):
        names = list(dict.fromkeys([*x, *y]))
        numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
        parts.append(numbers.mapInArrow(partials(Moments.of, all_rows, str(k)), SCHEMA))
    both = targets is None

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for key, payload in zip(rows.column("key").to_pylist(), rows.column("payload").to_pylist(), strict=True):
                x, y = tiles[int(key)]
                names = list(dict.fromkeys([*x, *y]))
                moments = Moments.from_bytes(payload)
                r = moments.correlation()
                own, other = [names.index(c) for c in x], [names.index(c) for c in y]
                for a, b in ((x, y), (y, x)) if both and x != y else ((x, y),):
                    i, j = (own, other) if a is x else (other, own)
                    values = r[np.ix_(i, j)].ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(a, len(b)).tolist()), pa.array(b * len(a)),
                            pa.array(moments.n[np.ix_(i, j)].ravel().astype(np.int64)), pa.array(values, mask=np.isnan(values)),
                        ],
                        names=["var_x", "var_y", "n", "r"],
                    )

    found = merged_rows(reduce(DataFrame.unionByName, parts), Moments).select("key", "payload").mapInArrow(matrix, _SCHEMA)
    if df.isEmpty():
        pairs = [(x, y, 0, None) for x in cols for y in (targets or cols)]
        return df.sparkSession.createDataFrame(pairs, _SCHEMA)
    return found


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Wide form of :func:`correlate`: one row per variable, one column per variable."""
    return (
        correlate(df, cols).groupBy("var_x").pivot("var_y", list(cols)).agg(F.first("r"))
    )


def corr_targets(df: DataFrame, cols: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Correlation of every column with a few targets, in a fixed order."""
    return correlate(df, cols, targets).orderBy("var_x", "var_y")
