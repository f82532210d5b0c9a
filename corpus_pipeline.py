"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding; each stage is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.bpe import bpe_encode
from framelake.llm.common import documents, materialise
from framelake.llm.exact_dedup import exact_dedup
from framelake.llm.mixing import mixed
from framelake.llm.near_dedup import near_dedup
from framelake.llm.quality import quality_filter
from framelake.llm.queries import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a calibrated cutoff rejects."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all documents with the same text: that of the largest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every document."""
    return bpe_encode(docs, *byte_bpe())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]

#: Alignment, subset sums and BPE have no SQL; a test compares run() with plain versions of the stages, mixing aside, which has a brute-force test of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
