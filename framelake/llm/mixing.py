"""Mixing sources to target weights: water-filled targets, then subset sums over exact lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hint, materialise, text_or_empty, whole_row, with_row_number

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that is given out, and the most that a source gives of its size.
TOTAL, MOST = 1.5, 2
#: Words of a budget that are spent by the knapsack, at least.
WINDOW = 20_000
#: Parts of the documents of one source and length, by hash.
PARTS = 4096


def words_of(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit("[^ \\t-\\r]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` with ``s`` (its place by code point, null last, from 0) and ``target`` double.

    Sources share ``total`` of all sizes by weight; a target stops at ``most`` times the source's size and the excess is
    shared again by weight until none is above. That is a water level: the sources in order of the level at which they
    are full, with running sums. ``sources`` has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = sources.select("source", "source_size", (F.row_number().over(order) - 1).cast("long").alias("s")).withColumn("weight", weight)
    rows = rows.withColumn("full", (most * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("full") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = total * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", level)
    open_level = F.when(F.col("level") * F.col("weight") < F.col("full"), F.struct(F.col("full") / F.col("weight"), F.col("s"), F.col("level").alias("level")))
    rows = rows.withColumn("water", F.min(open_level).over(everything)["level"])
    return rows.select("source", "source_size", "s", F.coalesce(F.least("full", F.col("water") * F.col("weight")), F.col("full")).alias("target"))


def fill(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size, at most ``counts`` of them, come nearest to ``budget``; of two sums as near, the smaller.

    All sizes are taken in proportion; from the smallest sizes on, so many of these are given back that WINDOW words or more of the
    budget are open (all, if it has no more), and a bounded knapsack spends them: bit sets of the sums that are reachable with
    the sizes so far, counts split into powers of two. A budget of WINDOW words at most is thus met as nearly as any choice
    can; a larger one is missed only by sums that no choice of the last WINDOW words reaches.
    """
    total = sum(a * b for a, b in zip(sizes, counts, strict=True))
    if total <= budget:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(a * b for a, b in zip(sizes, take, strict=True))
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: sizes[i])
    for i in reversed(order):  # what rounding down leaves
        if left > WINDOW:
            more = min(counts[i] - take[i], (left - WINDOW) // sizes[i])
            take[i], left = take[i] + more, left - more * sizes[i]
    for i in order:
        if left < WINDOW and take[i]:
            back = min(take[i], -((left - WINDOW) // sizes[i]))
            take[i], left = take[i] - back, left + back * sizes[i]
    if left <= 0:
        return take
    most = 2 * left
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    for i in order:
        free, power = min(counts[i] - take[i], most // sizes[i]), 1
        while free > 0:
            n = min(power, free)
            more = reach | (reach << (n * sizes[i])) & mask
            if more != reach:
                steps.append((i, n, reach))
                reach = more
            free, power = free - n, 2 * power
        if reach >> left & 1:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    at = below
    if above and (first := (above & -above).bit_length()) < left - below:
        at = left + first
    for i, n, reachable in reversed(steps):
        if not reachable >> at & 1:
            take[i], at = take[i] + n, at - n * sizes[i]
    return take


def mix(rows: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``rows`` (``rid``, ``source``, ``size``, ``key``, written) with ``source_size``, ``target`` and ``times`` long.

    Every document of a source is taken as often as the target holds the whole source; the rest of the target is met by
    documents whose lengths add up to it (:func:`fill`), one row for each source and length. Of the documents of a length
    the first by the hash of ``key`` and ``seed`` are taken, through hash parts, so that a length of any number of
    documents is never ordered in one task. Reruns agree; rows of equal keys and sizes are interchangeable.
    """
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("docs"))
    lengths = materialise(lengths, "lengths")
    by_source = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    share = materialise(targets(by_source, weights, total, most), "targets").withColumnRenamed("source", "source_")
    share = hint(share, 128)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    plan = lengths.join(share, F.col("source").eqNullSafe(F.col("source_"))).withColumn("whole", whole).select("s", "size", "docs", "whole", rest.alias("rest"))

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        return pdf.assign(extra=fill(pdf["size"].tolist(), pdf["docs"].tolist(), int(pdf["rest"].iloc[0])))[["s", "size", "docs", "whole", "extra"]]

    plan = materialise(plan.groupBy("s").applyInPandas(chosen, "s long, size long, docs long, whole long, extra long"), "plan")
    dealt = rows.join(share, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    dealt = dealt.join(hint(plan, 64), ["s", "size"]).withColumn("order", F.xxhash64(F.lit(seed), "key"))
    dealt = dealt.withColumn("part", F.when((F.col("extra") > 0) & (F.col("extra") < F.col("docs")), F.pmod("order", F.lit(PARTS))).otherwise(-1))
    dealt = materialise(dealt, "dealt")
    some = dealt.where("part >= 0")
    parts = some.groupBy("s", "size", "part", "extra").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("room", F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))).select("s", "size", "part", "n", "room")
    first = some.join(hint(materialise(parts, "parts"), 64), ["s", "size", "part"])
    edge = first.where("room > 0 and room < n").withColumn("at", F.row_number().over(Window.partitionBy("s", "size", "part").orderBy("order", "key", "rid")))
    picked = first.where("room >= n").select("rid").union(edge.where("at <= room").select("rid")).withColumn("picked", F.lit(1))
    out = dealt.join(hint(materialise(picked, "picked"), 24), "rid", "left")
    times = F.col("whole") + F.when(F.col("part") >= 0, F.coalesce("picked", F.lit(0))).otherwise(F.when(F.col("extra") > 0, 1).otherwise(0))
    return out.select(*rows.columns, "source_size", "target", times.cast("long").alias("times"))


def mixture(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) of every row of ``df``.

    A null text has size 0; null is a source of its own; a null id is a key like any other. Sources without words have
    target 0. An empty table gives an empty result. Other columns are not read.
    """
    rows = with_row_number(df, "sizes", F.col(id_col).alias("key"), F.col(source_col).alias("source"), words_of(text_col).alias("size"))
    out = mix(rows, seed)
    return out.select(F.col("key").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all their columns, whatever their names.

    Nulls, sources without words and empty tables as in :func:`mixture`; of rows that are alike in all columns any may stay.
    """
    whole = materialise(df.select(whole_row(df).alias("row"), F.col(id_col).alias("key"), F.col(source_col).alias("source"), words_of(text_col).alias("size")).withColumn("rid", F.monotonically_increasing_id()), "numbered")
    times = materialise(mix(whole.select("rid", "key", "source", "size"), seed).where("times > 0").select("rid", "times"), "times")
    taken = whole.join(hint(times, 24), "rid").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"))
    return taken.select("row.*")
