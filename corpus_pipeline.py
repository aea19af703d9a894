"""From documents to training sequences: each stage works on all rows that the one before kept, as written Parquet.

Rows: null and empty texts have no letters and are rejected by the first stage, which also asks for a language of at least even odds; of equal texts
the row with the largest id stays, rows that repeat id and text with it; of near copies one document of each class. A null id is an id like
others. Very long texts stay whole but for repeated passages. Other columns, whatever their names, are kept up to the last stage, which returns
pieces of sequences. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopscore.llm import exact_dedup, jaccard_join, language, packing, passages
from hopscore.llm.queries import BYTE_END, tokenizer_path
from hopscore.llm.storage import discard, saved


#: Rows in an Arrow batch: documents are long, and several workers of an executor hold batches at once.
BATCH = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found (language ID, 7)."""
    _small_batches(spark)
    return language.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id (exact dedup, 10)."""
    _small_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones (n-gram Jaccard join, 3)."""
    _small_batches(spark)
    return jaccard_join.drop_near_duplicates(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents (substring dedup, 1)."""
    _small_batches(spark)
    return passages.drop_repeated_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences (packing, 9)."""
    _small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), BYTE_END)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("packing", pack),
]

#: Language likelihoods, sampled similarity and token ids are not SQL; tests/llm/test_pipeline.py follows each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage has read is removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
