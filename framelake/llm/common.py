"""What the operators share: column preparation, batches for Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import counted, discard, hint, materialise, rows_of

__all__ = ["bound_batches", "counted", "discard", "documents", "embeddings", "hint", "let", "materialise", "rows_of", "text_or_empty", "whole_row", "with_row_number", "word_list"]

#: Bytes of a batch for Python.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by size, so that long rows do not fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_row_number(df: DataFrame, name: str, *columns: Column | str) -> DataFrame:
    """``columns`` and ``rid``, a number that is another for every row, written so that it stays the same."""
    return materialise(df.select(F.monotonically_increasing_id().alias("rid"), *columns), name)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col("`" + name.replace("`", "``") + "`") for name in df.columns))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    """The runs of characters other than the six white-space characters of ASCII."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
