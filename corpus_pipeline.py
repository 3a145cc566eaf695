"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplework.llm import jaccard, lines, mixing, packing, quality
from ripplework.llm.tokens import public_path
from ripplework.session import discard, materialize, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base test nor fit a learned rule."""
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; documents that lose every word with them go."""
    left = lines.drop_recurring(docs, length_col="n_chars")
    return left.where("__n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences of at most 1024 tokens."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: A learned stage and a tokenizer are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table of documents. What a stage wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = written()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
