"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import drop, held_by, written


def _large(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.inline(ways))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    # Each node goes to its least neighbour, and so do its other neighbours.
    near = down.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))))
    return near.where("u > v")


#: Edges for each task, about: so many need no shuffle.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the edges ``(u, v)``; a component is named by its least node.

    Minima are combined before each shuffle and no neighbourhood is gathered; the edges of a node that very many others
    share meet in one join, which adaptive execution splits. Each round is written to the shared
    folder, in files of about ``EDGES`` edges, and replaces the one before; a single file is worked on by a single task. Nodes
    without an edge to another node are left out, and so are null ones.
    """
    edges = edges.where("u != v").select("u", "v")
    files = max(1, -(-edges.count() // EDGES))
    now = written(edges.coalesce(files).distinct(), "edges", files)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark:
            break
        mark = seen
        files = max(1, -(-seen[0] // EDGES))
        before, now = now, written(_small(_large(now.coalesce(files)).distinct()).distinct(), "edges", files)
        drop(before)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    return held_by(found, now)
