"""Hard negatives of embeddings: for an anchor and a positive, the best rows of other labels that score a little less.

Vectors fall into segments, of which mean and deviation are kept. The inner product of two segments is
their length times the product of their means, plus or minus at most the product of their
deviations (the norms of what is left without the mean, by Cauchy and Schwarz); the sum over segments bounds a score. Pairs of
anchors and rows are tested on few long segments first, then on shorter ones, and only what might still
count is scored exactly. The bounds are held against an anchor's worst positive so far, or against the window of scores
that its positives leave and its worst negatives so far.

Rows are packed where they lie into blocks of vectors, sorted by label, and each group of anchors meets each group of
blocks in one task, which holds the group's anchors and streams the blocks. Tasks return their best few for each anchor
and those are merged, so a label or vector that very many rows share is dealt over all groups and emits no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.scratch import written

#: Rows of a block, anchors of a group, and least and most rows of a group of blocks.
BLOCK, ANCHORS, FEWEST, MOST = 1024, 4096, 8192, 1 << 20
#: Segments of a vector at each level.
LEVELS = (1, 4, 16)
#: Scores are held in 64 bits; beyond, they are the nearest that fit.
TOP = 2**62
_BLOCK = "labels binary, ids binary, keys binary, vectors binary, wide int, dim int, windows binary"


def _vectors(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each dimension in the batch."""
    column = rows.column("vector")
    dim = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(dim) - dim
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        yield at, values[first[at][:, None] + np.arange(d)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, label, key, vector[, positives])`` in blocks of one dimension, sorted by label."""

    def window(scores: list[dict] | None) -> list[int]:
        return [x["score"] for x in scores or ()]

    for rows in batches:
        with_positives = "positives" in rows.schema.names
        for at, vectors in _vectors(rows):
            label, id, key = (rows.column(c).to_numpy()[at] for c in ("label", "id", "key"))
            order = np.lexsort((id, label))
            small = np.abs(vectors).max(initial=0)
            vectors = vectors.astype(np.int16 if small < 1 << 15 else np.int32 if small < 1 << 31 else np.int64)
            for low in range(0, len(order), BLOCK):
                x = order[low : low + BLOCK]
                held = b""
                if with_positives:
                    scores = [window(rows.column("positives")[int(k)].as_py()) for k in at[x]]
                    held = np.array([s + [-TOP] * (max(map(len, scores)) - len(s)) for s in scores], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([c[x].astype(np.int64).tobytes()], pa.binary()) for c in (label, id, key)),
                        pa.array([vectors[x].tobytes()], pa.binary()),
                        pa.array([vectors.itemsize], pa.int32()),
                        pa.array([vectors.shape[1]], pa.int32()),
                        pa.array([held], pa.binary()),
                    ],
                    names=["labels", "ids", "keys", "vectors", "wide", "dim", "windows"],
                )


class Vectors:
    """Vectors with ids and labels, and the summaries of their segments."""

    def __init__(self, labels: np.ndarray, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, positives: np.ndarray) -> None:
        self.labels, self.ids, self.keys, self.vectors, self.positives = labels, ids, keys, vectors, positives
        self.most = int(np.abs(vectors).max(initial=0))
        self.real = vectors.astype(float)
        self.norm = np.sqrt((self.real * self.real).sum(1))
        self.levels = []
        dim = vectors.shape[1]
        for n in LEVELS:
            if n >= dim:
                break
            edge = np.arange(n) * dim // n
            size = np.diff(np.r_[edge, dim]).astype(float)
            mean = np.add.reduceat(self.real, edge, axis=1) / size
            left = self.real - np.repeat(mean, size.astype(int), axis=1)
            self.levels.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(left * left, edge, axis=1))))

    @classmethod
    def of(cls, blocks: list[dict]) -> Vectors:
        dim = blocks[0]["dim"]
        held = [np.concatenate([np.frombuffer(b[c], np.int64) for b in blocks]) for c in ("labels", "ids", "keys")]
        vectors = np.concatenate([np.frombuffer(b["vectors"], f"i{b['wide']}").reshape(-1, dim).astype(np.int64) for b in blocks])
        parts = [np.frombuffer(b["windows"], np.int64).reshape(len(b["ids"]) // 8, -1) for b in blocks]
        wide = max(p.shape[1] for p in parts)
        positives = np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1])), constant_values=-TOP) for p in parts])
        return cls(*held, vectors, positives)

    def bounds(self, rows: Vectors, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores that the summaries allow, for the pairs of vectors ``a`` of these and ``b`` of ``rows``."""
        (mean, far), (mean_of, far_of) = self.levels[level], rows.levels[level]
        middle, width = mean[a] @ mean_of[b].T, far[a] @ far_of[b].T
        width += 1e-9 * np.outer(self.norm[a], rows.norm[b]) + 1e-6  # what rounding can lose
        return middle - width, middle + width

    def scores(self, rows: Vectors, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products, exact up to ``TOP``."""
        bound = self.most * rows.most * self.vectors.shape[1]
        if bound < 1 << 53:
            return (self.real[a] @ rows.real[b].T).astype(np.int64)
        if bound < TOP:
            return self.vectors[a] @ rows.vectors[b].T
        exact = self.vectors[a].astype(object) @ rows.vectors[b].T.astype(object)
        return np.clip(exact, -TOP, TOP).astype(np.int64)


def scored(anchors: Vectors, rows: Vectors, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, of the anchors ``a`` and rows ``b``, that score from ``low`` to ``high`` of their anchor, and the scores."""
    for level in range(len(anchors.levels)):
        least, most = anchors.bounds(rows, level, a, b)
        may = (most >= low[a][:, None]) & (least <= high[a][:, None])
        a, b = a[may.any(1)], b[may.any(0)]
        if not len(a) or not len(b):
            break
    score = anchors.scores(rows, a, b)
    x, y = np.nonzero((score >= low[a][:, None]) & (score <= high[a][:, None]))
    return a[x], b[y], score[x, y]


class Best:
    """The first ``count`` of each list by score and then id; equal entries count once."""

    def __init__(self, lists: int, count: int) -> None:
        self.count = count
        self.list, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.worst = np.full(lists, -TOP - 1)

    def add(self, list_: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if not len(list_):
            return
        held = [np.concatenate(x) for x in ((self.list, list_), (self.score, score), (self.id, id))]
        order = np.lexsort((held[2], -held[1], held[0]))
        list_, score, id = (x[order] for x in held)
        new = np.r_[True, (list_[1:] != list_[:-1]) | (score[1:] != score[:-1]) | (id[1:] != id[:-1])]
        list_, score, id = list_[new], score[new], id[new]
        start = np.flatnonzero(np.r_[True, list_[1:] != list_[:-1]])
        rank = np.arange(len(list_)) - np.repeat(start, np.diff(np.r_[start, len(list_)]))
        kept = rank < self.count
        self.list, self.score, self.id = list_[kept], score[kept], id[kept]
        last = rank[kept] == self.count - 1
        self.worst[self.list[last]] = self.score[last]


def _positives(count: int):
    def solve(anchors: Vectors, blocks: Iterator[Vectors]) -> Best:
        best = Best(len(anchors.ids), count)
        high = np.full(len(anchors.ids), TOP)
        for rows in blocks:
            for label in np.intersect1d(anchors.labels, rows.labels):
                a, b = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
                x, y, score = scored(anchors, rows, a, b, best.worst, high)
                other = anchors.ids[x] != rows.ids[y]
                best.add(x[other], score[other], rows.ids[y[other]])
        return best

    return solve


def _negatives(count: int, percent: tuple[int, int]):
    def edge(scores: np.ndarray, part: int, up: bool) -> np.ndarray:
        return np.array([-(-part * s // 100) if up else part * s // 100 for s in scores.ravel().tolist()], object).clip(-TOP, TOP).astype(np.int64).reshape(scores.shape)

    def solve(anchors: Vectors, blocks: Iterator[Vectors]) -> Best:
        n, wide = anchors.positives.shape
        there = anchors.positives > -TOP
        low = np.where(there, edge(anchors.positives, percent[0], True), TOP)
        high = np.where(there, edge(anchors.positives, percent[1], False), -TOP)
        there &= low <= high
        best = Best(n * wide, count)
        for rows in blocks:
            need = np.where(there, np.maximum(low, best.worst.reshape(n, wide)), TOP)
            a = np.flatnonzero(there.any(1))
            least, most = need.min(1, initial=TOP), np.where(there, high, -TOP).max(1, initial=-TOP)
            x, y, score = scored(anchors, rows, a, np.arange(len(rows.ids)), least, most)
            other = anchors.labels[x] != rows.labels[y]
            x, y, score = x[other], y[other], score[other]
            for k in range(wide):
                fits = (score >= need[x, k]) & (score <= high[x, k]) & there[x, k]
                best.add(x[fits] * wide + k, score[fits], rows.ids[y[fits]])
        return best

    return solve


def _met(solve):
    """The best of each anchor's lists among the blocks of a cell; rows come by cell, anchors first."""

    def answer(blocks: list[dict], rest: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        """Vectors of other dimensions than an anchor's have no score with it."""
        kinds = {d: Vectors.of([b for b in blocks if b["dim"] == d]) for d in {b["dim"] for b in blocks}}
        if len(kinds) == 1:
            found = {d: solve(anchors, (Vectors.of([b]) for b in rest if b["dim"] == d)) for d, anchors in kinds.items()}
        else:
            held = list(rest)
            found = {d: solve(anchors, (Vectors.of([b]) for b in held if b["dim"] == d)) for d, anchors in kinds.items()}
        for d, best in found.items():
            wide = max(1, kinds[d].positives.shape[1])
            names = kinds[d].keys[best.list // wide], best.list % wide, best.score, best.id
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in names], names=["key", "list", "score", "id"])

    def run(batches):
        rows = (x for batch in batches for x in batch.to_pylist())
        ahead = next(rows, None)

        def of(cell: int, side: int) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and (ahead["cell"], ahead["side"]) == (cell, side):
                here, ahead = ahead, None
                yield here
                ahead = next(rows, None)

        while ahead is not None:
            cell = ahead["cell"]
            anchors = list(of(cell, 0))
            if anchors:
                yield from answer(anchors, of(cell, 1))
            for _ in of(cell, 1):
                pass

    return run


def _best_of(anchors: DataFrame, blocks: DataFrame, groups: tuple[int, int], solve) -> DataFrame:
    """``(key, list, score, id)``: the best in every group of blocks for each anchor."""
    of, by = groups
    dealt = anchors.repartitionById(of, F.pmod("key", F.lit(of)).cast("int"))
    held = dealt.mapInArrow(_packed, _BLOCK).withColumn("group", F.spark_partition_id())
    held = held.withColumn("cell", F.explode(F.sequence(F.col("group") * by, F.col("group") * by + by - 1))).withColumn("side", F.lit(0))
    rows = blocks.withColumn("cell", F.explode(F.sequence(F.col("group"), F.lit((of - 1) * by) + F.col("group"), F.lit(by)))).withColumn("side", F.lit(1))
    met = held.unionByName(rows).drop("group").repartitionById(of * by, F.col("cell")).sortWithinPartitions("cell", "side")
    return met.mapInArrow(_met(solve), "key long, list long, score long, id long")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, ids and scores long, ``rank`` int.

    Components become floor(``scale`` * x); a score is the inner product of two such vectors, exact up to 2^62 and held at that
    beyond. An anchor's positives are its best ``positives`` other rows of its label, a pair's
    negatives the best ``negatives`` rows of other labels that score ``percent`` of the positive's score (from, to); higher scores
    come first, of equal ones the smaller id. Rows with a null id, label or vector, or a null or non-finite component, take no
    part; nor do empty vectors. Vectors of different dimension have no score with each other. Rows that share an id are not each other's
    positives, and of those with equal scores one counts. Other columns, whatever their names, are
    not read; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.where(F.col(id).isNotNull() & label.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    whole = F.transform(values, lambda x: F.greatest(F.lit(-float(TOP)), F.least(F.lit(float(TOP)), F.floor(scale * x).cast("double"))).cast("long"))
    known = known.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector"), is_anchor.alias("anchor"))
    known = known.withColumn("key", F.xxhash64("id", "label", "vector"))

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = written(known.where("anchor").drop("anchor").dropDuplicates(["key"]), "anchors")
    n, m = known.count(), anchors.count()
    by = max(1, -(-n // MOST), min(width, -(-n // FEWEST)))
    groups = (max(1, -(-m // ANCHORS)), by)
    blocks = known.drop("anchor").mapInArrow(_packed, _BLOCK)
    blocks = written(blocks.withColumn("group", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(by)).cast("int")), "blocks")

    best = _best_of(anchors, blocks, groups, _positives(positives))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    best = best.select("key", "score", "id").distinct().withColumn("place", first).where(F.col("place") <= positives)
    best = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))
    anchors = written(anchors.join(best, "key"), "positives")

    found = _best_of(anchors, blocks, groups, _negatives(negatives, percent))
    first = F.row_number().over(Window.partitionBy("key", "list").orderBy(F.desc("score"), "id"))
    found = found.distinct().withColumn("rank", first).where(F.col("rank") <= negatives)
    of = anchors.select("key", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("list", "positive"))
    return of.withColumn("list", F.col("list").cast("long")).join(found, ["key", "list"]).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
