"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discarded, materialized
from tessera.llm.decontamination import decontaminate
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.parity_join import keep_one
from tessera.llm.piece_sampling import sample_pieces
from tessera.llm.quality_rules import keep_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the weighed rules take for good."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line repeats, and documents of which less than a fifth or only blank space is left.

    Of such a document at least 0.8 repeats earlier text, so it is a near copy; the next stage could not know the scrap of
    it for one. n_chars follows the text. Documents that were blank before stay as they are.
    """
    after = dedup_lines(docs, keep_emptied=False, least_left=0.2)
    return after.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that Jaccard links of 0.8 over five-word shingles connect."""
    return keep_one(docs, width=5, similarity=(4, 5))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document."""
    return sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: The posterior of the quality rules and the sampled segmentations cannot be written in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written before the next one reads it more than once.

    It is deleted when the next stage's rows are written; those that the last stage reads stay.
    """
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialized(docs)
            discarded(*written)
            written = [docs]
    return docs
