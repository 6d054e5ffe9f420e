"""Document fingerprints: bottom-k sketches of word shingles, made of built-in functions.

The sketch of a text is the k least of the distinct hashes of its shingles (five words each). The sketch of a
union is the k least of the sketches' union, so sketches merge across parts. From two sketches
come estimates of resemblance and containment, from one the number of distinct shingles; all are exact
for texts of fewer than k distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.scratch import written

SPACE = r"[\x20\x09-\x0D]+"
K = 128
SPAN = float(2**64)


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """Hashes of the shingles of a whole text; of all its words if there are fewer than ``width``; none without words."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # transform makes the words' hashes once; each shingle then reads them by position
    runs = F.transform(F.array(hashed), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))
    return F.when(F.size(words) > 0, F.get(runs, F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, width: int = 5, k: int = K) -> Column:
    """The k least distinct shingle hashes in order: ``array<bigint>``; null and wordless texts have an empty one."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def fingerprint(of: Column) -> Column:
    """A sketch as a string of 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(of, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _whole(a: Column, b: Column, k: int) -> Column:
    """Whether both sketches hold all hashes of their texts."""
    return (F.size(a) < k) & (F.size(b) < k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity: the share of the union's sketch that both have, or of the whole union where both texts have
    fewer than k shingles. Two empty texts resemble fully."""
    both = F.array_intersect(a, b)
    union = F.array_union(a, b)
    union = F.when(_whole(a, b, k), union).otherwise(F.slice(F.sort_array(union), 1, k))
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(union, both)) / F.size(union))


def distinct_shingles(of: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = F.element_at(of, -1).cast("double") + SPAN / 2
    return F.when(F.size(of) < k, F.size(of).cast("double")).otherwise((k - 1) * SPAN / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has: the common shingles by those of ``a``. 1 for an empty ``a``."""
    union = F.when(_whole(a, b, k), F.size(F.array_union(a, b)).cast("double")).otherwise(distinct_shingles(merged(a, b, k), k))
    shared = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_sketches(sketches: DataFrame, by: list[str], of: str, k: int = K) -> DataFrame:
    """``(by ..., of)``: the sketch of all texts of each group. Tasks cut to k a group before the shuffle."""
    hashes = sketches.select(*by, F.explode_outer(of).alias("__hash")).distinct()
    least = hashes.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("__hash")))).where(F.col("__rank") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("__hash")).alias(of))


#: Quantiles that blocks of neighbouring ids are laid by, and blocks between two of them for each shuffle partition.
CELLS = 128


def _block(docs: DataFrame, id: str, text: str, blocks: int) -> Column:
    """A number for each row that grows with the id; equal ids get one number, null ids negative ones.

    Between neighbouring quantiles blocks are equally wide, so one holds a 1/``CELLS`` of the rows at most
    (plus what repeats a single id).
    """
    cuts = docs.agg(F.percentile_approx(id, [i / CELLS for i in range(CELLS + 1)], 20_000)).first()[0]
    if not cuts:
        return F.lit(0).cast("long")
    cuts = sorted(set(cuts))
    each = max(1, -(-4 * blocks // CELLS))

    def tree(low: int, high: int) -> Column:
        if high - low == 1:
            width = (cuts[high] - cuts[low]) if high < len(cuts) else 1
            inside = F.floor((F.col(id).cast("double") - float(cuts[low])) * each / max(width, 1))
            return F.lit(low * each) + F.greatest(F.lit(0), F.least(F.lit(each - 1), inside))
        mid = (low + high) // 2
        return F.when(F.col(id) < cuts[mid], tree(low, mid)).otherwise(tree(mid, high))

    return F.when(F.col(id).isNull(), -1 - F.pmod(F.xxhash64(text), F.lit(16 * each))).otherwise(tree(0, len(cuts))).cast("long")


def with_next(docs: DataFrame, id: str, text: str, carried: dict[str, Column]) -> DataFrame:
    """Each row (``id``, ``text``, ``carried``) with ``next``, a struct of text and ``carried`` of the row after it.

    The order is by descending id, null ids last, rows of one id by text; the first row comes
    after the last. Rows move once, to blocks of neighbouring ids; only the first row of
    each block is also sent to the block before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("block", _block(rows, "id", "text", int(spark.conf.get("spark.sql.shuffle.partitions"))))
    top = rows.groupBy("block").agg(F.max("id").alias("top")).withColumnRenamed("block", "top_block")
    top = written(top, "tops")
    numbers = sorted((r[0] for r in top.select("top_block").collect()), reverse=True)  # as many as blocks
    if not numbers:
        return rows.drop("block").select("*", *[c.alias(k) for k, c in carried.items()], F.struct("text", *[c.alias(k) for k, c in carried.items()]).alias("next"))
    before = spark.createDataFrame([(b, numbers[i - 1]) for i, b in enumerate(numbers)], "head_block long, block long")
    head = rows.join(F.broadcast(top), (F.col("block") == F.col("top_block")) & F.col("id").eqNullSafe(F.col("top")))
    head = head.groupBy("block").agg(F.min("text").alias("text")).withColumnRenamed("block", "head_block")
    head = written(head.join(F.broadcast(before), "head_block").select("block", F.struct("text", *[c.alias(k) for k, c in carried.items()]).alias("head")), "heads")
    rows = rows.select("*", *[c.alias(k) for k, c in carried.items()])
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("id"), "text")
    rows = rows.withColumn("following", F.lead(F.struct("text", *carried)).over(order))
    rows = rows.join(head, "block", "left")
    return rows.select("id", "text", *carried, F.coalesce("following", "head").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, k: int = K) -> DataFrame:
    """``(id, text, sketch, edited, edited_sketch, next_sketch)`` of each row.

    A null text counts as empty. See :func:`with_next` for the order that ``next`` and
    :func:`edited` go by; null and repeated ids have their places there. A single row is its own next. Other columns are
    not read.
    """
    rows = with_next(docs, id, text, {"sketch": sketch(F.col("text"), width, k)})
    rows = rows.select("id", "text", "sketch", edited(F.col("text"), F.col("next.text")).alias("edited"), F.col("next.sketch").alias("next_sketch"))
    return rows.withColumn("edited_sketch", sketch(F.col("edited"), width, k))
