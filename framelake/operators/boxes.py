"""Operators on boxes of frames: greedy suppression and deduplication as ordered folds, matching of box sets.

A fold takes one frame's boxes in order; its size is bounded by what a detector reports on a frame, never by the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import intersection, iou


def ordered_fold(df: DataFrame, key: str, order: str, fields: list[str], drops: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of each ``key`` in the order of ``order``, without those that a row kept before drops: ``drops(kept, row)``."""
    item = F.struct(order, *fields)
    kind = df.select(item.alias("x")).schema["x"].dataType.simpleString()
    fold = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(F.exists(acc, lambda k: drops(k, x)), acc).otherwise(F.array_append(acc, x)))
    return df.groupBy(key).agg(fold.alias("kept")).select(key, F.explode("kept").alias("x")).select(key, "x.*")


def greedy_nms(boxes: DataFrame, threshold: float = 0.3, key: str = "frame", order: str = "rank") -> DataFrame:
    """Boxes in order of ``order`` (score descending) that overlap no kept box by more than ``threshold`` (single precision)."""
    return ordered_fold(boxes, key, order, ["x", "y", "w", "h", "score"], lambda k, x: iou(k, x) > F.lit(threshold).cast("float"))


def dedup_first_come(boxes: DataFrame, threshold: float = 0.4, key: str = "frame", order: str = "rank") -> DataFrame:
    """First come, first kept; overlap in double precision."""
    return ordered_fold(boxes, key, order, ["x", "y", "w", "h", "score"], lambda k, x: iou(k, x, "double") > threshold)


def rule_drop(k: Column, x: Column) -> Column:
    """Whether a kept box drops a later one: by overlap, containment, or a centre inside a box of about the same size."""
    inter = intersection(k, x)
    own, other = x["w"] * x["h"], k["w"] * k["h"]
    cx, cy = x["x"] + x["w"] / 2.0, x["y"] + x["h"] / 2.0
    inside = cx.between(k["x"], k["x"] + k["w"]) & cy.between(k["y"], k["y"] + k["h"])
    alike = (own <= other * 1.4) & (other <= own * 1.4)
    overlap = F.greatest(inter / (own + other - inter), F.when(inter / own > 0.6, 1.0).otherwise(0.0), F.when(inside & alike, 1.0).otherwise(0.0))
    lower = x["score"] < k["score"]
    high = lower | ((F.abs(x["score"] - k["score"]) < 1e-3) & (own < other))
    return (inter > 0) & F.when(overlap > 0.5, high).otherwise((overlap > 0.25) & lower)


def dedup_rules(boxes: DataFrame, key: str = "frame", order: str = "rank") -> DataFrame:
    """Boxes by score, then area, both descending (``order``); :func:`rule_drop` decides."""
    return ordered_fold(boxes, key, order, ["x", "y", "w", "h", "score"], rule_drop)


def match_boxes(left: DataFrame, right: DataFrame, key: str = "frame", order: str = "rank", near: int = 1, least: float = 0.99) -> DataFrame:
    """Greedy one-to-one matching per frame: ``matched``, ``only_left``, ``only_right``, ``mean_iou``.

    Each left box in order takes the first free right box that differs by at most ``near`` in every number, else the free
    one of the best overlap if that is ``least`` or more. The mean is over boxes without a near match that overlap any.
    """
    item = F.struct(order, "x", "y", "w", "h")
    a = left.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("l"))
    b = right.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("r"))
    both = a.join(b, key, "full").select(key, F.coalesce("l", F.array()).alias("l"), F.coalesce("r", F.array()).alias("r"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter("r", lambda y: ~F.array_contains(acc["used"], y[order]))
        close = F.get(F.filter(free, lambda y: F.greatest(*(F.abs(x[c] - y[c]) for c in "xywh")) <= near), 0)[order]
        ranked = F.transform(free, lambda y: F.struct(iou(x, y, "double").alias("v"), (-y[order]).alias("o")))
        best = F.array_max(F.filter(ranked, lambda y: y["v"] > 0))
        taken = F.coalesce(close, F.when(best["v"] >= least, -best["o"]))
        counted = close.isNull() & best.isNotNull()
        return F.struct(
            F.when(taken.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], taken)).alias("used"),
            (acc["total"] + F.when(counted, best["v"]).otherwise(0.0)).alias("total"), (acc["n"] + F.when(counted, 1).otherwise(0)).alias("n"),
        )

    start = F.struct(F.array().cast(f"array<{left.schema[order].dataType.simpleString()}>").alias("used"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    done = both.select(key, F.size("l").alias("nl"), F.size("r").alias("nr"), F.aggregate("l", start, step).alias("s"))
    matched = F.size("s.used")
    mean = F.when(F.col("s.n") > 0, F.col("s.total") / F.col("s.n")).otherwise(1.0)
    return done.select(key, *(c.cast("bigint").alias(n) for c, n in ((matched, "matched"), (F.col("nl") - matched, "only_left"), (F.col("nr") - matched, "only_right"))), mean.alias("mean_iou"))
