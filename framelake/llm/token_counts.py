"""Exact length histogram: documents by encoded length, with suffix sums for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import hint, materialise

#: Lengths whose sums are carried on together.
STRIDE = 1024


def suffix_sums(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row for every length that occurs, with the answers for a context limit of that many tokens.

    ``n_tokens``, ``docs``, ``tokens`` (of the documents of this length), ``docs_over`` and ``tokens_over`` (suffix sums:
    of the longer ones), ``docs_within``, ``tokens_within``, ``quantile`` (share of documents of at most this length),
    ``truncated_tokens`` (of all documents if each is cut at this length), ``lost_tokens``. All counts are exact.

    Documents are counted by length before any shuffle. Sums run within strides of lengths and over the totals of the
    strides, so no task sees all lengths. Rows without a length are not counted; an empty table gives an empty result.
    """
    column = F.col(length_col).cast("long")
    hist = lengths.where(column.isNotNull()).groupBy(column.alias("n_tokens")).agg(F.count("*").alias("docs"))
    hist = materialise(hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.expr(f"n_tokens div {STRIDE}").alias("stride")), "lengths")
    later = Window.orderBy(F.desc("stride")).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy()
    strides = hist.groupBy("stride").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    strides = strides.select("stride", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), *(F.sum(c).over(all_of).alias(f"{c}_all") for c in "dt"))
    longer = Window.partitionBy("stride").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = {c: (F.coalesce(F.sum(c).over(longer), F.lit(0)) + F.col(f"{c[0]}_later")).alias(f"{c}_over") for c in ("docs", "tokens")}
    rows = hist.join(hint(materialise(strides, "strides"), 64), "stride").select("n_tokens", "docs", "tokens", *over.values(), "d_all", "t_all")
    cut = F.col("t_all") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    return rows.select(
        "n_tokens", "docs", "tokens", "docs_over", "tokens_over",
        (F.col("d_all") - F.col("docs_over")).alias("docs_within"), (F.col("t_all") - F.col("tokens_over")).alias("tokens_within"),
        ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("quantile"), cut.alias("truncated_tokens"), (F.col("t_all") - cut).alias("lost_tokens"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit``, ``docs_within`` and ``truncated_tokens`` for any limits, those between lengths included."""
    rows = sums.select("n_tokens", "docs", "tokens", F.explode(F.array(*map(F.lit, sorted(set(limits))))).alias("limit"))
    within = F.col("n_tokens") <= F.col("limit")
    kept = F.when(within, F.col("tokens")).otherwise(F.col("docs") * F.col("limit"))
    return rows.groupBy("limit").agg(F.sum(F.when(within, F.col("docs")).otherwise(0)).alias("docs_within"), F.sum(kept).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share`` and ``n_tokens``: the smallest length that at least this share of the documents does not exceed."""
    rows = sums.select("n_tokens", "quantile", F.explode(F.array(*map(F.lit, shares))).alias("share")).where("quantile >= share")
    return rows.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """:func:`suffix_sums` of the encoded lengths of every whole text; null and empty texts have length 0."""
    one = df.select(F.lit(0).cast("long").alias("row"), text_col)
    return suffix_sums(bpe_encode(one, path, pattern, "row", text_col, lengths_only=True))
