"""From documents to packed sequences: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import packing, pii, quality, shingles
from quillstack.llm.common import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier (operator 4) doesn't reject."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 0.8 or more of their five-word shingles."""
    return shingles.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data (operator 3) in their texts replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens (operator 9)."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", keep_one_of_copies),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the tokeniser; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
