"""A cascade of rectangle features over sliding windows: as joins and sums, and as one numpy pass per packed frame."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cascades import CUSTOM_RECTS, DIAGONAL_EDGE, HORIZONTAL_CENTER, HORIZONTAL_EDGE, VERTICAL_CENTER, CascadeFile, Feature, WeakFeature
from .pixels import integral, rect_sums

SIDE = 24


class Weak(NamedTuple):
    feature: int
    threshold: float
    left: float
    right: float
    sign: int = 1


class Cascade(NamedTuple):
    """``features``: rectangles (x, y, w, h, weight) in window pixels; ``stages``: threshold and weak classifiers; ``tilted``: numbers
    of the features whose rectangles are turned by 45 degrees; ``bias``: what every stage's threshold is raised by."""

    features: tuple[tuple[tuple[int, int, int, int, float], ...], ...]
    stages: tuple[tuple[float, tuple[Weak, ...]], ...]
    tilted: frozenset[int] = frozenset()
    bias: float = 0.0

    def spots(self, feature: int) -> list[tuple[bool, int, int, float]]:
        """The feature as a weighted sum of places of prefix tables: whether of the diagonal one, and x and y from the window's corner."""
        found: dict[tuple[bool, int, int], float] = {}
        for x, y, w, h, weight in self.features[feature]:
            x2, y2 = x + w, y + h
            xm, ym = (x + x2) // 2, (y + y2) // 2
            upright = ((x2, y2, 1), (x, y2, -1), (x2, y, -1), (x, y, 1))
            turned = ((xm, y, 1), (x, y, -1), (xm, ym, -2), (x, ym, 1), (x2, ym, 1), (x2, y2, -1), (xm, y2, 1))
            for a, b, k in turned if feature in self.tilted else upright:
                at = feature in self.tilted, a - 1, b - 1
                found[at] = found.get(at, 0.0) + k * weight
        return [(*at, k) for at, k in found.items() if k]


def strips(weights: list[float], down: bool) -> tuple:
    """Equal strips of the window from the top down or from the left, one for each weight."""
    n, step = len(weights), SIDE // len(weights)
    size = max(1, step)
    cut = [i * SIDE // n for i in range(n)]
    return tuple((0, at, SIDE, size, w) if down else (at, 0, size, SIDE, w) for at, w in zip(cut, weights, strict=True))


def demo_cascade() -> Cascade:
    """The built-in cascade. Its weights, thresholds and votes are fixed values."""
    features = (
        strips([1.0, -2.0, 1.0], True), strips([1.0, -2.0, 1.0], False), strips([1.0, -1.0], True), strips([1.0, -1.0], False),
        strips([1.0, -1.0, -1.0, -1.0, 1.0], True), strips([1.0, -3.0, 1.0], False), strips([1.0, -1.0], True), strips([1.0, -1.0], False),
    )
    stages = (
        (0.5, (Weak(0, 0.0, 1.5, -1.0),)), (0.5, (Weak(1, 0.0, 1.0, -1.0),)), (-1.0, (Weak(4, 0.0, 0.8, -0.6),)), (-1.0, (Weak(2, 0.0, 0.6, -0.5),)),
        (-1.0, (Weak(5, 0.0, 0.5, -0.4),)), (-1.0, (Weak(6, 0.0, 0.4, -0.3),)), (-1.0, (Weak(7, 0.01, 0.3, -0.3),)), (-0.5, (Weak(2, 0.0, 0.3, -0.2), Weak(1, 0.0, 0.2, -0.2))),
    )
    return Cascade(features, stages)


def levels(width: int, height: int, scale: float = 1.2, stride: int = 4, least: int = SIDE, most: int = 1024, faithful: bool = True) -> list[dict]:
    """Pyramid levels of a frame: size, scale, stride and window counts. ``faithful`` ends at the first box below ``least``."""
    half_up = lambda x: int(np.floor(np.float32(x) + np.float32(0.5)))
    out, w, h, now = [], width, height, np.float32(1)
    while w >= SIDE and h >= SIDE:
        box = half_up(SIDE * now)
        if box > most or (box < least and faithful):
            break
        step = max(2, half_up(np.float32(stride) * now))
        if box >= least:
            out.append({"level": len(out), "width": w, "height": h, "scale": float(now), "box": box, "stride": step, "windows": len(range(0, w - SIDE + 1, step)) * len(range(0, h - SIDE + 1, step))})
        nw, nh = (max(SIDE, half_up(np.float32(x) / np.float32(scale))) for x in (w, h))
        if nw == w or nh == h or nw <= SIDE or nh <= SIDE:
            break
        w, h, now = nw, nh, np.float32(width) / np.float32(nw)
    return out


def windows(frames: DataFrame, width: int, height: int, stride: int) -> DataFrame:
    """``frame``, ``wx``, ``wy`` of every window that fits."""
    at = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - SIDE), F.lit(stride)))
    return frames.select("frame", at(width).alias("wx")).select("frame", "wx", at(height).alias("wy"))


def responses(pixels: DataFrame, width: int, height: int, stride: int, cascade: Cascade | None = None, variance: int = 200) -> DataFrame:
    """``frame``, ``wx``, ``wy``, ``feature``, ``value`` (normalised) of windows that pass the variance filter.

    The filter runs first, so features are looked up only where it lets a window through.
    """
    cascade = cascade or demo_cascade()
    table = integral(pixels)
    window = F.expr(f"wy * {width} + wx")
    every = windows(pixels.select("frame").distinct(), width, height, stride)
    inner = every.select("frame", window.alias("rect"), (F.col("wx") + 1).alias("x0"), (F.col("wy") + 1).alias("y0"), (F.col("wx") + SIDE - 1).alias("x1"), (F.col("wy") + SIDE - 1).alias("y1"))
    n = (SIDE - 2) ** 2
    spread = F.col("s2") * n - F.col("s") * F.col("s")
    open_ = rect_sums(table, inner).where(spread >= variance * n * n).where(spread > 0).select("frame", F.col("rect").alias("window"), (1 / F.sqrt(spread.cast("double"))).alias("norm"))
    rects = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(k).alias("weight")) for f, r in enumerate(cascade.features) for x, y, w, h, k in r))
    wide = open_.select("frame", "window", "norm", F.posexplode(rects).alias("no", "r"))
    wx, wy = F.col("window") % width, F.floor(F.col("window") / width)
    count = sum(map(len, cascade.features))
    asked = wide.select("frame", (F.col("window") * count + F.col("no")).alias("rect"), (wx + F.col("r.x")).cast("int").alias("x0"), (wy + F.col("r.y")).cast("int").alias("y0"), (wx + F.col("r.x") + F.col("r.w")).cast("int").alias("x1"), (wy + F.col("r.y") + F.col("r.h")).cast("int").alias("y1"))
    sums = rect_sums(table, asked).select("frame", "rect", "s")
    joined = wide.withColumn("rect", F.col("window") * count + F.col("no")).join(sums, ["frame", "rect"])
    value = (F.sum(F.col("s") * F.col("r.weight")) * F.first("norm")).alias("value")
    return joined.groupBy("frame", wx.cast("int").alias("wx"), wy.cast("int").alias("wy"), F.col("r.feature").alias("feature")).agg(value)


def stage_sums(values: DataFrame, cascade: Cascade | None = None) -> DataFrame:
    """``stage``, ``total``, ``passed`` of every window."""
    cascade = cascade or demo_cascade()
    weak = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(t).alias("least"), F.lit(w.feature).alias("feature"), F.lit(w.threshold).alias("threshold"), F.lit(w.left).alias("left"), F.lit(w.right).alias("right")) for s, (t, ws) in enumerate(cascade.stages) for w in ws))
    votes = values.select("*", F.explode(F.filter(weak, lambda w: w["feature"] == F.col("feature"))).alias("w"))
    vote = F.when(F.col("value") < F.col("w.threshold"), F.col("w.left")).otherwise(F.col("w.right"))
    return votes.groupBy("frame", "wx", "wy", F.col("w.stage").alias("stage"), F.col("w.least").alias("least")).agg(F.round(F.sum(vote), 6).alias("total")).withColumn("passed", F.col("total") >= F.col("least"))


def accepted(stages: DataFrame, count: int) -> DataFrame:
    """Windows that pass every stage, with the sum of all stages as score."""
    return stages.groupBy("frame", "wx", "wy").agg(F.round(F.sum("total"), 4).alias("score"), F.min("passed").alias("ok"), F.count("*").alias("n")).where(F.col("ok") & (F.col("n") == count)).select("frame", "wx", "wy", "score")


def area_matrix(size: int, to: int) -> np.ndarray:
    """Rows of coverage shares that shrink ``size`` cells to ``to``."""
    edge = np.arange(to + 1, dtype=np.float64) * size / to
    at = np.arange(size)
    cover = np.clip(np.minimum(at + 1, edge[1:, None]) - np.maximum(at, edge[:-1, None]), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def detect_frame(image: np.ndarray, cascade: Cascade, stride: int = 4, scale: float = 1.2, variance: int = 200, threshold: float = 0.3, mul: bool = False) -> list[tuple]:
    """(x, y, w, h, score) of one frame: all levels, stage by stage on the windows that are left, then suppression."""
    height, width = image.shape
    now, raw = image.astype(np.float64), []
    for level in levels(width, height, scale, stride):
        if now.shape != (level["height"], level["width"]):
            now = np.floor(area_matrix(now.shape[0], level["height"]) @ now @ area_matrix(now.shape[1], level["width"]).T + 0.5)
        pad = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        ii, ii2 = pad(now), pad(now * now)
        tilt = np.zeros_like(ii)
        if cascade.tilted:
            for row in range(level["height"]):  # each place adds to the diagonal above it
                tilt[row + 1, 1:] = now[row] + tilt[row, :-1]
        ys, xs = (g.ravel() for g in np.meshgrid(np.arange(0, level["height"] - SIDE + 1, level["stride"]), np.arange(0, level["width"] - SIDE + 1, level["stride"]), indexing="ij"))
        area = lambda t, x, y, w, h: t[ys + y + h, xs + x + w] - t[ys + y, xs + x + w] - t[ys + y + h, xs + x] + t[ys + y, xs + x]
        n, inner = (SIDE - 2) ** 2, (1, 1, SIDE - 2, SIDE - 2)
        spread = area(ii2, *inner) * n - area(ii, *inner) ** 2
        keep = (spread >= variance * n * n) & (spread > 0)
        xs, ys = xs[keep], ys[keep]
        norm, score = (1 / np.sqrt(spread[keep])).astype(np.float32), np.zeros(keep.sum(), dtype=np.float32)
        for least, weak in cascade.stages:
            total = np.zeros(len(xs), dtype=np.float32)
            for w in weak:
                value = sum((tilt if diagonal else ii)[ys + y + 1, xs + x + 1] * k for diagonal, x, y, k in cascade.spots(w.feature)).astype(np.float32) * norm
                total += np.where(value < np.float32(w.threshold), np.float32(w.left), np.float32(w.right))
            ok = total >= np.float32(least) + np.float32(cascade.bias)
            xs, ys, norm, score = xs[ok], ys[ok], norm[ok], score[ok] + total[ok]
        s, box = np.float32(level["scale"]), level["box"]
        to = lambda v, size: np.clip(np.floor((v * s if mul else v / s).astype(np.float32) + 0.5), 0, max(0, size - box)).astype(int)
        raw += [(x, y, box, box, float(v)) for x, y, v in zip(to(xs, width).tolist(), to(ys, height).tolist(), score.tolist(), strict=True)]
    return suppressed(raw, threshold)


def suppressed(raw: list[tuple], most: float) -> list[tuple]:
    """Boxes of one frame, best first, that overlap no kept one by more than ``most``; equals keep their order."""
    kept: list[tuple] = []
    for b in sorted(raw, key=lambda b: -b[4]):
        if all(overlap(b, k) <= most for k in kept):
            kept.append(b)
    return kept


def overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return float(np.float32(w * h) / np.float32(a[2] * a[3] + b[2] * b[3] - w * h)) if w > 0 and h > 0 else 0.0


class Settings(NamedTuple):
    """What a detector run is set to; the defaults and presets are fixed values."""

    min_size: int = SIDE
    max_size: int = 1024
    scale_factor: float = 1.2
    stride: int = 4
    variance: int = 200
    min_score: float = 0.0

    def sane(self) -> Settings:
        """Least size 1, largest size not below it, scale within 1.01 to 2 (1.01 if it is no number), stride 1 or more."""
        scale = self.scale_factor if np.isfinite(self.scale_factor) else 1.01
        return self._replace(min_size=max(1, self.min_size), max_size=max(1, self.min_size, self.max_size), scale_factor=min(2.0, max(1.01, scale)), stride=max(1, self.stride))


FAST, ACCURATE = Settings(scale_factor=1.25, stride=6, variance=300), Settings(scale_factor=1.1, stride=2, variance=100)


def detect_with(frames: DataFrame, settings: Settings, cascade: Cascade | None = None) -> DataFrame:
    """Boxes of packed frames under ``settings``: their scores are ``min_score`` or more, their sides within the sizes."""
    s = settings.sane()
    found = detect(frames, cascade, s.stride, s.scale_factor, s.variance)
    return found.where((F.col("score") >= s.min_score) & F.col("w").between(s.min_size, s.max_size))


BOXES = "frame long, x int, y int, w int, h int, score double"


def detect(frames: DataFrame, cascade: Cascade | None = None, stride: int = 4, scale: float = 1.2, variance: int = 200) -> DataFrame:
    """Boxes of packed frames (``frame``, ``width``, ``height``, ``gray`` binary); a frame at a time, no shuffle."""
    cascade = cascade or demo_cascade()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.frame, *b) for r in batch.itertuples() for b in detect_frame(np.frombuffer(r.gray, dtype=np.uint8).reshape(r.height, r.width), cascade, stride, scale, variance)]
            yield pd.DataFrame(rows, columns=["frame", "x", "y", "w", "h", "score"])

    return frames.select("frame", "width", "height", "gray").mapInPandas(run, BOXES)


def pack(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels as rows to packed frames: the bytes of a row are put in order, then a frame's rows; no task holds a frame as structs of pixels."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: F.lpad(F.hex(p["v"]), 2, "0")), "")
    rows = pixels.groupBy("frame", "y").agg(F.unhex(row).alias("row"))
    frame = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda r: F.hex(r["row"])), "")
    return rows.groupBy("frame").agg(F.unhex(frame).alias("gray")).select("frame", F.lit(width).alias("width"), F.lit(height).alias("height"), "gray")


def bright_centres(spark: SparkSession, frames: int = 4) -> DataFrame:
    """Test frames of 120 by 120 pixels: a light band and block on dark ground, moved by two pixels a frame."""
    base = spark.range(frames * 120 * 120).select(F.expr("id div 14400").alias("frame"), F.expr("cast(id % 120 as int)").alias("x"), F.expr("cast(id div 120 % 120 as int)").alias("y"))
    inside = (F.col("x") - 2 * F.col("frame")).between(40, 79)
    return base.select("frame", "x", "y", F.when(inside & F.col("y").between(20, 39), 200).when(inside & F.col("y").between(40, 99), 220).otherwise(20).alias("v"))


def to_file(cascade: Cascade) -> CascadeFile:
    """The cascade as a file of rectangles in pixels; signs, which evaluation does not read, are 1."""
    features = tuple(Feature(CUSTOM_RECTS, 0, 0, tuple((*r[:4], float(r[4])) for r in rects)) for rects in cascade.features)
    return CascadeFile(SIDE, SIDE, features, tuple((t, tuple(WeakFeature(w.feature, w.threshold, 1, w.left, w.right) for w in weak)) for t, weak in cascade.stages))


def in_window(feature: Feature) -> tuple[tuple[int, int, int, int, float], ...]:
    """A feature's rectangles in window pixels; those of the five named kinds are in units of the feature's own grid."""
    if feature.kind == CUSTOM_RECTS:
        return tuple((x, y, max(1, w), max(1, h), weight) for x, y, w, h, weight in feature.rects)
    to = lambda v, units: v * SIDE // max(1, units)
    return tuple((to(x, feature.width), to(y, feature.height), max(1, to(w, feature.width)), max(1, to(h, feature.height)), weight) for x, y, w, h, weight in feature.rects)


def from_file(file: CascadeFile) -> Cascade:
    """The cascade of a file whose window has SIDE pixels, with features of any kind. ValueError for another window and for rectangles beyond it."""
    features = tuple(map(in_window, file.features))
    if (file.width, file.height) != (SIDE, SIDE) or any(x + w > SIDE or y + h > SIDE for rects in features for x, y, w, h, _ in rects):
        raise ValueError("another window, or a rectangle beyond it")
    stages = tuple((t, tuple(Weak(w.feature, w.threshold, w.left, w.right, w.sign) for w in weak)) for t, weak in file.stages)
    return Cascade(features, stages, frozenset(i for i, f in enumerate(file.features) if f.kind == DIAGONAL_EDGE))


def named_kind(kind: int, width: int, height: int) -> Feature:
    """A feature of one of the five kinds on a grid of ``width`` by ``height`` units: edges are halves, centres thirds, the last part takes the rest."""
    parts = 3 if kind in (VERTICAL_CENTER, HORIZONTAL_CENTER) else 2
    down = kind != HORIZONTAL_EDGE and kind != HORIZONTAL_CENTER
    size = height if down else width
    cuts = [i * (size // parts) for i in range(parts)] + [size]
    weights = (1.0, -2.0, 1.0) if parts == 3 else (1.0, -1.0)
    rects = tuple((0, a, width, b - a, k) if down else (a, 0, b - a, height, k) for a, b, k in zip(cuts, cuts[1:], weights, strict=False))
    return Feature(kind, width, height, rects)
