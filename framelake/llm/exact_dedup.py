"""Exact dedup by progressive refinement: length, then a hash of the prefix, then the full hash of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hint, materialise, text_or_empty, whole_row

#: Code points of the prefix.
PREFIX = 128


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size`` long, ``kept`` boolean and, with ``digest_all``, ``text_sha256`` of every row.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row of the largest ``id_col`` stays,
    null ids last; of repeated rows with that id, one. Rows are first counted by length in bytes; those that share it with
    another by the hash of a prefix; the full hash is taken only of rows that share both with another (of all rows with
    ``digest_all``, where the digest is itself asked for). Counting combines within tasks before the shuffle, so a group that holds a third of all
    rows is one row for each task. No text is shuffled while the surviving keys are few enough to be broadcast. An empty
    table gives an empty result; other columns are not read.
    """
    text = text_or_empty(text_col)
    keyed = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col), F.octet_length(text).cast("long").alias("length"), text.alias("text"))
    lengths = hint(materialise(keyed.groupBy("length").count().where("count > 1").select("length"), "lengths"), 16)
    prefix = F.xxhash64(F.substring("text", 1, PREFIX)).alias("prefix")
    shared = keyed.join(lengths, "length", "left_semi").select("length", prefix).groupBy("length", "prefix").count().where("count > 1").select("length", "prefix", F.lit(True).alias("left_over"))
    shared = materialise(shared, "shared")
    full = F.sha2("text", 256)
    rows = keyed.withColumn("prefix", prefix).join(hint(shared, 48), ["length", "prefix"], "left")
    rows = rows.select("rid", id_col, F.coalesce("left_over", F.lit(False)).alias("left_over"), (full if digest_all else F.when(F.col("left_over"), full)).alias("text_sha256"))
    rows = materialise(rows, "digests")
    groups = rows.where("left_over").groupBy("text_sha256").agg(F.max(F.struct(id_col, "rid")).alias("last"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select("text_sha256", F.col("last.rid").alias("keep_rid"), F.col(f"last.{id_col}").alias("last_id"), "n"), "groups")
    out = rows.join(hint(groups, 160), "text_sha256", "left")
    return out.select(
        F.col(id_col), F.when(F.col("n").isNull(), F.col(id_col)).otherwise(F.col("last_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"), *(["text_sha256"] if digest_all else []), *([] if digest_all else ["rid"]),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`duplicate_groups` keeps, with all their columns, whatever their names; nulls as there."""
    numbered = materialise(df.select(whole_row(df).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "numbered")
    flat = numbered.select(F.struct(F.col("row")[id_col].alias("id"), F.col("rid")).alias("id"), F.col("row")[text_col].alias("text"))
    dropped = materialise(duplicate_groups(flat, "id", "text").where("not kept").select(F.col("id.rid").alias("rid")), "dropped")
    return numbered.join(hint(dropped, 24), "rid", "left_anti").select("row.*")
