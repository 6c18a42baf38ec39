"""The corpus pipeline: quality rules, near-duplicate removal, substring removal, benchmark decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. ``run`` writes each result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontamination, minhash, pieces, quality_rules, substring
from strataloom.llm.common import forget, read, table
from strataloom.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a similarity of 0.8 or more)."""
    return minhash.keep(docs, 5, 80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that an earlier document (or place) has."""
    return substring.rewrite(docs, 20).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each document, scores and digests of the four best."""
    return pieces.segment(docs, public_tokenizers.path(TOKENIZER), 4)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", substrings), ("benchmark decontamination", benchmark), ("pieces", encode)]

#: SQL cannot express the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(spark, docs)
            if before is not None:
                forget(before)  # nothing reads it any more; the last one stays, as the result is read from it
            before = docs
    return docs
