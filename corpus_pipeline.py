"""A training-corpus pipeline: quality rules, near duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes every stage's result as Parquet into the shared folder and reads it back.

Nulls and repeated rows: a null text fails the quality rules; a null doc_id links with nothing and
stays; rows that repeat a doc_id are one document and stay or go together; rows that are equal in
doc_id, source and size share their copies in any order; empty tables pass through empty. Columns
beside those of ``documents`` pass through to the last stage; stages name helpers ``__p_...``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import bpe, jaccard, mixing, quality, secrets
from textloom.llm._common import materialize, n_words, table


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the standard policy; clean prose passes every rule."""
    bits = quality.ledger(docs.select(*[F.col(f"`{c}`").alias(f"__p_{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("text")))
    kept = bits.where(quality.passes(quality.STANDARD))
    return kept.select(*[F.col(f"__p_{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each component."""
    found = materialize(jaccard.near_duplicates(docs), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return _same(docs.join(gone, "doc_id", "left_anti"), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by marks; the other text and all documents stay."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _same(out, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out each document as the mix takes it."""
    sized = docs.withColumn("__p_size", n_words(F.col("text")))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__p_id"), F.coalesce("source", F.lit("")).alias("__p_source")]
    mixed = mixing.mix(sized.select("doc_id", "source", F.col("__p_size").alias("size")))
    copies = mixed.select(*key, F.col("size").alias("__p_size"), "copies").groupBy("__p_id", "__p_source", "__p_size").agg(F.sort_array(F.collect_list("copies")).alias("__p_copies"))
    # texts move once: the window has the join's keys
    keys = ["__p_id", "__p_source", "__p_size"]
    joined = sized.select("*", *key).join(copies, keys)
    row = F.row_number().over(W.partitionBy(*keys).orderBy("text"))
    taken = joined.withColumn("__p_row", row).withColumn("__p_n", F.get("__p_copies", F.col("__p_row") - 1))
    return _same(taken.where("__p_n > 0").withColumn("__p_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__p_n")))), docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document the mix took: doc_id, source, n_tokens, ids."""
    return bpe.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: Near duplicates, token efficiency and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
