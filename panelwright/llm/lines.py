"""Lines that many documents share, dropped from all but one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import written

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, id: str, text: str, documents: int, length: int) -> DataFrame:
    """``(id, text_hash, drop)``: positions of the lines to drop, for each text that has some.

    Only hashes of lines travel: the lines are counted by document with partial counts of distinct
    (line, document) pairs, and the commonest are looked up where the lines are, so a line of very many documents is
    spread over all tasks.
    """
    key = F.translate(F.btrim(F.col("at.line"), F.lit(BLANK)), UPPER, LOWER)
    line = docs.where(F.col(id).isNotNull()).select(
        F.col(id).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        F.explode(F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: F.char_length(x["line"]) >= length)).alias("at"),
    )
    line = line.select("id", "text_hash", "at.pos", key.alias("key")).where(F.char_length("key") >= length)
    line = written(line.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    often = line.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= documents)
    often = written(often, "shared")
    common = F.col("n") * 1000 >= line.count()  # a thousand lines at most, in so many texts that one task could not hold them
    hot, rest = often.where(common).drop("n"), often.where(~common).drop("n")
    gone = line.join(F.broadcast(hot), ["h1", "h2"]).unionByName(line.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    gone = gone.where("id != keeper")
    return gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", documents: int = 3, length: int = 20) -> DataFrame:
    """``(row, text, n_lines, n_dropped)``: each row of ``docs`` as a struct, and its text without shared lines.

    A text is split at line feeds; a null or empty text is one empty line. A line's key is the line
    without white space (space, U+0009 to U+000D) at its ends and with A-Z in lower case. Keys of ``length`` code points or more that
    ``documents`` or more distinct ids hold lose all their lines, repeats included, except in the
    largest of these ids. The others are joined again in their order. Rows with a null id count
    for no key and keep all lines; rows that share an id count as one document. A text that loses
    nothing stays as it is, null included; one that loses all lines is empty.
    """
    drop = shared_lines(docs, id, text, documents, length)
    drop = drop.select(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drop")
    row = docs.select(F.struct("*").alias("row"))
    row = row.join(drop, (F.col(f"row.`{id}`") == F.col("drop_id")) & (F.xxhash64(F.col(f"row.`{text}`")) == F.col("drop_hash")), "left")
    lines = F.split(F.col(f"row.`{text}`"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop")
    row = row.select("row", "drop", F.when(F.col("drop").isNotNull(), F.transform(left, lambda i: lines[i])).alias("left"))
    feeds = F.char_length(f"row.`{text}`") - F.char_length(F.replace(F.col(f"row.`{text}`"), F.lit("\n"), F.lit("")))
    return row.select(
        "row",
        F.when(F.col("drop").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join("left", "\n")).alias("text"),
        F.coalesce(feeds + 1, F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", documents: int = 3, length: int = 20) -> DataFrame:
    """``docs`` with its columns as they are, shared lines taken out of the text."""
    out = dedup_lines(docs, id, text, documents, length)
    return out.select(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
