"""A corpus pipeline: each stage reads what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import lines, mixing, ngram_join, subwords
from panelwright.llm.quality import quality
from panelwright.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie far from their language and source go; rows with a null id are judged as all others."""
    known = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "text")
    gone = quality(known).where("not kept").select(F.col("row.doc_id").alias("gone_id"), F.col("row.text_hash").alias("gone_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them; ``n_chars`` follows the text."""
    return lines.without_shared_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scarce languages are repeated, so that shares of tokens follow their natural shares to the power 0.8; no document goes.

    Targets that the rates miss by more than a hundredth of all tokens are an error.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    known = docs.select("doc_id", "lang").join(labels, "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rates, report = mixing.mixing_rates(keyed, known, None, temper=0.8)
    if mixing.missed(report) > 0.01:
        raise ValueError(f"no rates reach the targets: {report}")
    times = F.greatest(F.lit(1), mixing.copies(F.col("rate"), F.col("row.doc_id")))
    times = rates.select(F.col("row.doc_id").alias("times_id"), F.col("row.text_hash").alias("times_hash"), times.alias("times")).where("times > 1").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("times_id")) & (F.xxhash64("row.text") == F.col("times_hash"))
    out = rows.join(times, same, "left").select("row", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    return out.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's text, segmented with dropout."""
    return subwords.encode(docs, dropout=0.1, seed=1).select("row.doc_id", "row.lang", "row.source", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL cannot express robust fits and segmentation; a test holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
