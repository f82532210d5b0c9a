"""Checks on detected faces and the steps around a network: mirror symmetry, boxes moved by their eyes, labels, blobs, rows of a detector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import passes_variance, resize_bilinear

#: Means of the blue, green and red channel, taken off a network's input: fixed values.
MEANS = (("b", 104.0), ("g", 177.0), ("r", 123.0))
#: Symmetry: the least side, the gradient above which a pixel counts, the pixels that must count, the largest turn: fixed values.
LEAST_SIDE, LEAST_GRADIENT, LEAST_PIXELS, LARGEST_TURN = 16, 8.0, 32, math.pi / 3


def symmetry(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``frame`` and ``symmetry``: the share of pixels whose gradient on the left half points as on the mirrored right half.

    Only pixels with an edge on both halves count; with few of them a frame is taken as symmetric, and a frame of small sides as not.
    Beyond the edge of a half its pixels are mirrored, the edge itself not repeated. The middle column of an odd width is in no half.
    """
    if min(width, height) < LEAST_SIDE:
        return pixels.select("frame", F.lit(0.0).alias("symmetry")).distinct()
    half, x = width // 2, F.col("x")
    sides = pixels.where((x < half) | (x >= width - half)).select("frame", (x >= half).alias("right"), F.when(x < half, x).otherwise(width - 1 - x).alias("x"), "y", "v")
    row, column = Window.partitionBy("frame", "right", "y").orderBy("x"), Window.partitionBy("frame", "right", "x").orderBy("y")

    def around(name: str, order: Window) -> tuple[Column, Column]:
        before, after = F.lag(name).over(order), F.lead(name).over(order)
        return F.coalesce(before, after), F.coalesce(after, before)

    before, after = around("v", row)
    across = sides.select("frame", "right", "x", "y", (after - before).alias("d"), (before + 2 * F.col("v") + after).alias("s"))
    (d0, d1), (s0, s1) = around("d", column), around("s", column)
    grad = across.select("frame", "right", "x", "y", (d0 + 2 * F.col("d") + d1).cast("double").alias("gx"), (s1 - s0).cast("double").alias("gy"))
    grad = grad.select("frame", "right", "x", "y", F.when(F.hypot("gx", "gy") > LEAST_GRADIENT, F.atan2("gy", "gx")).alias("angle"))
    of = lambda right: F.max(F.when(F.col("right") == right, F.col("angle")))
    turn = F.abs(of(False) - of(True))
    pairs = grad.groupBy("frame", "x", "y").agg(F.least(turn, F.lit(math.pi) - turn).alias("turn"), of(False).isNotNull().alias("l"), of(True).isNotNull().alias("r"))
    share = F.avg(F.when(F.col("l") & F.col("r"), (F.col("turn") < LARGEST_TURN).cast("double")))
    return pairs.groupBy("frame").agg(F.when(F.count_if(F.col("l") & F.col("r")) < LEAST_PIXELS, 1.0).otherwise(share).alias("symmetry"))


def moved_by_eyes(y: Column, h: Column, frame_height: int, top: Column, again: Column, aligned: Column) -> Column:
    """A struct of ``y`` and ``h`` of a box that is moved up if its eyes lie low, made taller if they lie at the top; null if it is dropped.

    ``top``: the highest eye of the box; ``again``: the highest eye of the changed box (null: none), ``aligned``: whether its eyes
    are. A box with low eyes keeps its place if the changed one is no better, one with eyes at the top goes. Fixed shares.
    """
    low, high = top > 0.55 * h, top < 0.15 * h
    by = F.floor(F.when(low, top - 0.25 * h).otherwise(h * 0.30)).cast("int")
    new_y = F.greatest(F.lit(0), y - by)
    new_h = F.least(frame_height - new_y, h + by)
    poor = (new_h < 60) | (new_y + new_h / 2.0 > 0.85 * frame_height)
    seen = F.coalesce(again.isNotNull() & aligned, F.lit(False))
    new, old = F.struct(new_y.alias("y"), new_h.alias("h")), F.struct(y.alias("y"), h.alias("h"))
    up = F.when(seen & (again < 0.5 * new_h), new).otherwise(old)
    taller = F.when(seen & (again >= 0.15 * h) & (again <= 0.55 * new_h), new)
    return F.when(~low & ~high, old).when(~poor & low, up).when(~poor, taller)


def stable_hue(place: Column) -> Column:
    """The hue (0 to 179) of the box at a place, counted from 1, whatever the number of boxes: a fixed rule."""
    return place * 47 % 180


def box_label(place: Column, skin: Column) -> Column:
    return F.format_string("#%d sr=%.2f", place, skin)


def blob(colours: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """``frame``, ``channel`` (0 blue, 1 green, 2 red), ``x``, ``y``, ``value``: resized channels without their means."""
    planes = F.array(*(F.struct(F.lit(i).alias("channel"), F.lit(mean).alias("mean"), F.col(c).alias("v")) for i, (c, mean) in enumerate(MEANS)))
    rows = colours.select("frame", "x", "y", F.explode(planes).alias("p")).select(F.struct("frame", "p.channel", "p.mean").alias("frame"), "x", "y", "p.v")
    small = resize_bilinear(rows, width, height, to_width, to_height)
    return small.select("frame.frame", "frame.channel", "x", "y", (F.col("v") - F.col("frame.mean")).alias("value"))


def decoded(found: DataFrame, width: int, height: int, least: float = 0.5) -> DataFrame:
    """Boxes of a detector's rows with ``conf`` and corners ``x1``, ``y1``, ``x2``, ``y2`` as shares of the frame; other columns stay.

    Corners lose their fractions, then are cut at the frame; boxes without an area or of less than ``least`` confidence go, and rows with a null or NaN.
    """
    whole = lambda c, size: (F.col(c) * size).cast("int")
    rows = found.where((F.col("conf") >= least) & ~F.isnan("conf"))
    for corner in ("x1", "y1", "x2", "y2"):
        rows = rows.where(F.col(corner).isNotNull() & ~F.isnan(corner))
    rows = rows.withColumn("x", F.greatest(F.lit(0), whole("x1", width))).withColumn("y", F.greatest(F.lit(0), whole("y1", height)))
    rows = rows.withColumn("w", F.least(F.lit(width), whole("x2", width)) - F.col("x")).withColumn("h", F.least(F.lit(height), whole("y2", height)) - F.col("y"))
    return rows.where("w > 0 and h > 0").drop("x1", "y1", "x2", "y2")


def window_mask(s: Column, s2: Column, pixels_each: int, threshold: int) -> Column:
    """1 for windows of ``pixels_each`` pixels (sums ``s``, of squares ``s2``) of enough variance, else 0; no window is left out."""
    return passes_variance(s, s2, pixels_each, threshold).cast("int")


def montage_places(crops: DataFrame, height: int, columns: int = 5, most: int = 30) -> DataFrame:
    """``video``, ``face``, ``tile`` (width at ``height``), ``wide`` (the video's widest), ``col``, ``row``, ``rows`` of crops (``video``, ``face``, ``w``, ``h``).

    The first ``most`` faces of a video in their order, ``columns`` in a row; that cap is the feature. Spark cuts each task's
    groups at it before the shuffle. A crop without an area has no place.
    """
    place = F.row_number().over(Window.partitionBy("video").orderBy("face"))
    first = crops.where("w > 0 and h > 0").withColumn("place", place).where(F.col("place") <= most)
    video = Window.partitionBy("video")  # ``most`` rows
    tile = F.floor(F.col("w") * (F.lit(float(height)) / F.col("h"))).cast("int")
    sized = first.select("video", "face", tile.alias("tile"), (F.col("place") - 1).alias("at"))
    row = lambda c: F.floor(c / columns).cast("int")
    return sized.select("video", "face", "tile", F.max("tile").over(video).alias("wide"), (F.col("at") % columns).alias("col"), row(F.col("at")).alias("row"), (row(F.max("at").over(video)) + 1).alias("rows"))


def montage(places: DataFrame, tiles: DataFrame, height: int, columns: int = 5, border: int = 40) -> DataFrame:
    """``video``, ``x``, ``y``, ``v``: the tiles' pixels (``face``, ``x``, ``y``, ``v``) in their places, ``border`` right of narrow ones, 0 where no face is."""
    x0, y0 = F.col("col") * F.col("wide"), F.col("row") * height
    spread = lambda df: df.withColumn("dx", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    taken = tiles.join(places, "face").where((F.col("x") < F.col("tile")) & (F.col("y") < height)).select("video", (x0 + F.col("x")).alias("x"), (y0 + F.col("y")).alias("y"), "v")
    narrow = places.where("wide > tile")
    bars = spread(narrow).where("dx >= tile").select("video", (x0 + F.col("dx")).alias("x"), (y0 + F.col("dy")).alias("y"), F.lit(border).alias("v"))
    last = places.groupBy("video").agg(F.max(F.struct("row", "col")).alias("last"), F.max("wide").alias("wide")).where(F.col("last.col") < columns - 1)
    empty = last.select("video", "wide", F.col("last.row").alias("row"), F.explode(F.sequence(F.col("last.col") + 1, F.lit(columns - 1))).alias("col"))
    blanks = spread(empty).select("video", (x0 + F.col("dx")).alias("x"), (y0 + F.col("dy")).alias("y"), F.lit(0).alias("v"))
    return taken.union(bars).union(blanks)
