"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import fingerprints, hard_negatives, html_text, lines, mixing, ngram_join, privacy, quality, repeats, simhash, spelling, subwords, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    own, changed, following = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(own).alias("fingerprint"),
        fingerprints.fingerprint(changed).alias("edited_fingerprint"),
        fingerprints.resemblance(own, changed).alias("near_edited"),
        fingerprints.resemblance(own, following).alias("near_next"),
        fingerprints.distinct_shingles(own).alias("n_shingles"),
        fingerprints.containment(own, changed).alias("kept_share"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("row.doc_id", *base, "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def fold(id):
        return F.crc32(F.col(id).cast("string")) % 5

    field = toxicity.learned(docs, table(spark, sf_dir, "labels"), fold("known_id") != 0)
    found = toxicity.toxicity(docs, field)
    held_out = F.coalesce(fold("row.doc_id") == 0, F.lit(False))
    return found.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.personal_data(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("entities", lambda s: s["kind"] == privacy.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.sha2(privacy.written_out(F.col("entities")), 256)
    return found.select("row.doc_id", *[count(k) for k in privacy.PATTERNS], base.alias("base_sha256"), privacy.written_out(F.col("spans")).alias("spans"))


def op7_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under dropout, and the hash of what they decode to."""
    docs = table(spark, sf_dir, "documents")
    spelled = subwords.encode(docs, dropout=0.1, seed=1, spelled=True)
    return spelled.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    kept = F.make_valid_utf8(F.col("kept").cast("string"))  # a repeat can end inside a character
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), kept.alias("text"))


#: Domains are the languages of good documents, and poor documents of any language.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, "low": 0.05}


def known_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of the labelled documents."""
    domain = F.when(F.col("quality") == 0, "low").otherwise(F.col("lang"))
    return labels.select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", domain.alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, with the shares of tokens that the domains reach and by how much of all tokens the targets are missed at most."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rates, report = mixing.mixing_rates(docs, known_domains(docs, labels), TARGETS)
    reached = [F.lit(report[d]["reached"] / max(sum(r["reached"] for r in report.values()), 1.0)).alias(f"reached_{d}") for d in TARGETS]
    posteriors = [F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(TARGETS)]
    return rates.select("row.doc_id", "tokens", *posteriors, "rate", *reached, F.lit(mixing.missed(report)).alias("missed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_fingerprints,
        op3_quality_rules,
        op4_toxicity,
        op5_html_text,
        op6_privacy,
        op7_subwords,
        op8_repeats,
        op9_mixing,
        op10_line_dedup,
        op11_hard_negatives,
        op12_simhash,
        op13_spelling,
    )
}
