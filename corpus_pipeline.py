"""A training corpus from ``documents`` in five stages.

toxicity: documents that the model rejects go. near_dedup: one document of each
group of near copies stays (shingles of five words, similarity 0.8). substring_dedup:
word sequences of 35 words and more that occur elsewhere are cut out. mixing: each
source is repeated or thinned to its target weight and the corpus is shuffled.
packing: windows of 2,048 token ids.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.mixing import mix_sources
from codestrata.llm.near_dedup import keep_one
from codestrata.llm.packing import packed_documents
from codestrata.llm.substring_dedup import remove_repeats
from codestrata.llm.tables import stored
from codestrata.llm.toxicity import keep_clean, labels_to_learn

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents that are there; rows stay as they are."""
    return keep_clean(docs, labels_to_learn(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; the document with the least id stays."""
    return keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a repeat stay as they are; others become their kept words."""
    cut = remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length("kept_text")).otherwise(F.col("n_chars"))
    replaced = cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return replaced.withColumn("text", text).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the square root of their characters; copies are equal rows."""
    return mix_sources(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, shingle joins and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
