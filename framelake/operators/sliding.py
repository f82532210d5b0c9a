"""Detectors that slide over frames: gradient blocks with a linear score, and a network of anchors over tiles."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boxes import greedy_nms
from .haar import BOXES, suppressed

#: Cell side and directions of the gradient blocks. Fixed values.
CELL, BINS = 8, 9
#: Windows whose blocks are made at once; a window of 64 by 128 takes about half a MB.
AT_ONCE = 32


class Gradients(NamedTuple):
    """Settings of the gradient detector; the defaults are fixed values."""

    width: int = 64
    height: int = 128
    stride: int = 8
    least: float = 0.0
    overlap: float = 0.3
    scale: float = 1.2
    min_size: int = 64
    max_size: int = 512


def bilinear_matrix(size: int, to: int) -> np.ndarray:
    """Rows of the two shares that each of ``to`` cells looks up among ``size``; edges repeat."""
    at = np.maximum(0.0, (np.arange(to) + 0.5) * size / to - 0.5)
    low = np.minimum(at.astype(int), size - 1)
    out = np.zeros((to, size))
    np.add.at(out, (np.arange(to), low), 1 - (at - low))
    np.add.at(out, (np.arange(to), np.minimum(low + 1, size - 1)), at - low)
    return out


def block_features(patches: np.ndarray) -> np.ndarray:
    """One vector per window (n, row, column): blocks of two by two cells as in :func:`faces.gradient_blocks`, row by row."""
    n, h, w = patches.shape
    p = np.pad(patches.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    gx, gy = p[:, 1:-1, 2:] - p[:, 1:-1, :-2], p[:, 2:, 1:-1] - p[:, :-2, 1:-1]
    size = np.hypot(gx, gy)
    size[size < 1e-3] = 0
    at = np.degrees(np.arctan2(gy, gx))
    at = np.where(at < 0, at + 180, at) * BINS / 180
    low, part = np.floor(at).astype(int), at - np.floor(at)
    rows, columns = h // CELL, w // CELL
    cell = (np.arange(n)[:, None, None] * rows + (np.arange(rows * CELL) // CELL)[:, None]) * columns + np.arange(columns * CELL) // CELL
    whole = np.s_[:, : rows * CELL, : columns * CELL]
    hist = sum(np.bincount((cell * BINS + (low[whole] + k) % BINS).ravel(), (size * share)[whole].ravel(), n * rows * columns * BINS) for k, share in ((0, 1 - part), (1, part)))
    hist = hist.reshape(n, rows, columns, BINS)
    block = np.concatenate([hist[:, j : rows - 1 + j, i : columns - 1 + i] for j in (0, 1) for i in (0, 1)], axis=-1)
    unit = lambda b: b / np.sqrt((b * b).sum(axis=-1, keepdims=True) + 1e-3)
    return unit(np.minimum(unit(block), 0.2)).reshape(n, -1)


def gradient_levels(width: int, height: int, s: Gradients) -> Iterator[tuple[float, int, int, int, int]]:
    """(scale, width, height, box width, box height) of every level that the window fits and whose box is within the sizes."""
    scale, half = 1.0, lambda v: int(np.floor(v + 0.5))
    while True:
        w, h, bw, bh = half(width / scale), half(height / scale), half(s.width * scale), half(s.height * scale)
        if w < s.width or h < s.height or min(bw, bh) < s.min_size or max(bw, bh) > s.max_size:
            return
        yield scale, w, h, bw, bh
        scale *= s.scale


def detect_gradients_in(image: np.ndarray, weights: np.ndarray, bias: float, s: Gradients) -> list[tuple]:
    """(x, y, w, h, score) of one frame, suppressed. A vector longer than the weights is cut to them, as is the other way round."""
    height, width = image.shape
    raw = []
    for scale, w, h, bw, bh in gradient_levels(width, height, s):
        now = image if (w, h) == (width, height) else np.floor(bilinear_matrix(height, h) @ image @ bilinear_matrix(width, w).T + 0.5)
        tiles = np.lib.stride_tricks.sliding_window_view(now, (s.height, s.width))[:: s.stride, :: s.stride]
        ny, nx = tiles.shape[:2]
        for a in range(0, ny * nx, AT_ONCE):
            spot = np.arange(a, min(a + AT_ONCE, ny * nx))
            features = block_features(tiles[spot // nx, spot % nx])
            n = min(features.shape[1], len(weights))
            score = features[:, :n] @ weights[:n] + bias
            place = lambda v, most: min(int(np.floor(v * s.stride * scale + 0.5)), max(0, most))
            raw += [(place(i % nx, width - bw), place(i // nx, height - bh), bw, bh, float(v)) for i, v in zip(spot.tolist(), score, strict=True) if v >= s.least]
    return suppressed(raw, s.overlap)


def detect_gradients(frames: DataFrame, weights: np.ndarray, bias: float = 0.0, settings: Gradients | None = None) -> DataFrame:
    """Boxes of packed frames (``frame``, ``width``, ``height``, ``gray``); a frame at a time, no shuffle.

    A frame smaller than the window has none. ``weights``: one for each place of :func:`block_features`.
    """
    s = settings or Gradients()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.frame, *b) for r in batch.itertuples() for b in detect_gradients_in(np.frombuffer(r.gray, dtype=np.uint8).reshape(r.height, r.width), weights, bias, s)]
            yield pd.DataFrame(rows, columns=["frame", "x", "y", "w", "h", "score"])

    return frames.select("frame", "width", "height", "gray").mapInPandas(run, BOXES)


class Scale(NamedTuple):
    """One scale of anchors: pixels from a tile to the next, anchor side, tile side."""

    stride: int
    anchor: int
    tile: int


#: The scales of the anchor network. Fixed values.
SCALES = tuple(Scale(side, side, 16) for side in (8, 16, 32, 64, 128))
#: Outputs that make a box: shift, size, and what the confidence comes from. They are counted in millionths, so that sums are exact.
OUTPUTS, UNIT = 5, 1_000_000


class AnchorWeights(NamedTuple):
    """Of one scale: a layer from a pixel's value to hidden ones, and one from these to the outputs."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def even_anchor_weights(n: int) -> tuple[AnchorWeights, ...]:
    """Weights of ``n`` scales from a rule, small and of both signs."""
    rule = lambda k, *shape: ((np.arange(int(np.prod(shape))) * 7 + k) % 11 - 5).reshape(shape) / 100.0
    return tuple(AnchorWeights(rule(k, 4) * 10, rule(k + 1, 4), rule(k + 2, 4, OUTPUTS), rule(k + 3, OUTPUTS)) for k in range(n))


def value_outputs(weights: AnchorWeights) -> list[list[int]]:
    """The outputs of each pixel value, in millionths: a tile's outputs are the means of its pixels' ones."""
    hidden = np.maximum(np.arange(256)[:, None] / 255.0 * weights.hidden + weights.hidden_bias, 0)
    return np.rint((hidden @ weights.out[:, :OUTPUTS] + weights.out_bias[:OUTPUTS]) * UNIT).astype(np.int64).tolist()


def anchor_boxes(pixels: DataFrame, width: int, height: int, weights: tuple[AnchorWeights, ...], scales: tuple[Scale, ...] = SCALES, least: float = 0.6) -> DataFrame:
    """``frame``, ``scale``, ``tx``, ``ty``, ``x``, ``y``, ``w``, ``h``, ``score`` of the tiles of enough confidence whose box lies in the frame.

    Each pixel is dealt to the tiles over it and counts what its value gives (256 rows a scale, joined by broadcast): one
    shuffle, combined before it.
    """
    table = [(k, v, *row) for k, w in enumerate(weights[: len(scales)]) for v, row in enumerate(value_outputs(w))]
    names = [f"o{i}" for i in range(OUTPUTS)]
    values = pixels.sparkSession.createDataFrame(table, "scale int, v int, " + ", ".join(f"{n} long" for n in names))
    each = F.array(*(F.struct(F.lit(k).alias("scale"), *(F.lit(v).alias(n) for n, v in s._asdict().items())) for k, s in enumerate(scales)))

    def starts(c: str, size: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - F.col("tile") + 1) / F.col("stride"))).cast("int")
        last = F.least(F.floor(F.col(c) / F.col("stride")), F.floor((size - F.col("tile")) / F.col("stride"))).cast("int")
        return F.transform(F.when(first <= last, F.sequence(first, last)), lambda i: i * F.col("stride"))

    dealt = pixels.select("frame", "x", "y", F.col("v").cast("int").alias("v"), F.explode(each).alias("s")).select("frame", "x", "y", "v", "s.*")
    dealt = dealt.withColumn("tx", F.explode(starts("x", width))).withColumn("ty", F.explode(starts("y", height)))
    tiles = dealt.join(F.broadcast(values), ["scale", "v"]).groupBy("frame", "scale", "stride", "anchor", "tile", "tx", "ty").agg(*(F.sum(n).alias(n) for n in names))
    mean = lambda i: F.col(f"o{i}") / (F.col("tile") * F.col("tile") * F.lit(float(UNIT)))

    def side(start: str, shift: int, size: int, most: int) -> tuple[Column, Column]:
        length = F.col("anchor") * F.exp(mean(size) * F.col("stride"))
        low = F.col(start) + F.floor(F.col("tile") / 2) + mean(shift) * F.col("stride") - length / 2
        low = F.least(F.greatest(low, F.lit(0.0)), F.lit(max(0.0, most - 1.0)))
        return F.floor(low).cast("int"), F.floor(low + F.greatest(length, F.lit(1.0))).cast("int")

    (x, x2), (y, y2) = side("tx", 0, 2, width), side("ty", 1, 3, height)
    found = tiles.select("frame", "scale", "tx", "ty", x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"), (1 / (1 + F.exp(-mean(4)))).alias("score"))
    return found.where((F.col("score") >= least) & (F.col("x") + F.col("w") <= width) & (F.col("y") + F.col("h") <= height) & (F.col("w") > 0) & (F.col("h") > 0))


def anchor_detect(pixels: DataFrame, width: int, height: int, weights: tuple[AnchorWeights, ...], scales: tuple[Scale, ...] = SCALES, least: float = 0.6, threshold: float = 0.3) -> DataFrame:
    """:func:`anchor_boxes`, suppressed within a frame: best first, of equals the smaller scale, then the upper, then the left tile."""
    found = anchor_boxes(pixels, width, height, weights, scales, least)
    order = Window.partitionBy("frame").orderBy(F.desc("score"), "scale", "ty", "tx")
    return greedy_nms(found.select("frame", F.row_number().over(order).alias("rank"), "x", "y", "w", "h", "score"), threshold)


def diagonal_edge_rects(windows: DataFrame, side: int, width: int, height: int, feature: int = 24) -> DataFrame:
    """``frame``, ``rect``, ``weight``, ``x1``, ``y1``, ``x2``, ``y2`` of windows (``frame``, ``window``, ``x``, ``y``): the upper half counts
    for, the lower against; both are scaled from ``feature`` to the window's ``side`` and cut at the frame."""
    half = feature // 2
    halves = ((0, half, 1), (half, feature - half, -1))
    parts = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(top * side // feature).alias("top"), F.lit(max(1, size * side // feature)).alias("size"), F.lit(k).alias("weight")) for i, (top, size, k) in enumerate(halves)))
    rows = windows.select("frame", "window", "x", "y", F.explode(parts).alias("p"))
    x2, y2 = F.least(F.col("x") + side, F.lit(width)), F.least(F.col("y") + F.col("p.top") + F.col("p.size"), F.lit(height))
    cut = rows.select("frame", (F.col("window") * 2 + F.col("p.no")).alias("rect"), F.col("p.weight").alias("weight"), F.least("x", x2).alias("x1"), F.least(F.col("y") + F.col("p.top"), y2).alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return cut
