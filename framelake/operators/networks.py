"""A small convolutional classifier over windows: as joins and sums on rows, and as one numpy pass per packed frame."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .haar import BOXES, suppressed

#: Window side, kernel side and channels after each of the three convolutions; the last layer's width. Fixed values.
SIDE, KERNEL, CHANNELS, HIDDEN = 24, 3, (8, 16, 32), 32
#: Rows and columns left for the dense layer: 24 - 22 - 20, halved to 10 - 8, halved to 4.
LAST = 4
#: Pixels from a window to the next, as the reference's configuration has it.
STRIDE = 4


class Weights(NamedTuple):
    """``kernels``: (row, column, in, out) of each convolution, without bias; two dense layers as (matrix, bias)."""

    kernels: tuple[np.ndarray, ...]
    dense: tuple[np.ndarray, np.ndarray]
    head: tuple[np.ndarray, float]


def even_weights() -> Weights:
    """Weights from a rule, for tests and timing: small, of both signs, the same on every machine."""
    def rule(*shape: int) -> np.ndarray:
        n = np.arange(int(np.prod(shape)))
        return (((n * 7919) % 17 - 8) / (4.0 * np.sqrt(np.prod(shape[:-1])))).reshape(shape)

    kernels = tuple(rule(KERNEL, KERNEL, a, b) for a, b in zip((1, *CHANNELS), CHANNELS, strict=False))
    return Weights(kernels, (rule(LAST * LAST * CHANNELS[-1], HIDDEN), np.zeros(HIDDEN)), (rule(HIDDEN, 1)[:, 0], 0.0))


def template_weights() -> Weights:
    """Weights that answer to a light centre on darker ground. Their numbers are fixed values."""
    across = [[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]]
    centre = [[-0.5, -0.5, -0.5], [-0.5, 3.0, -0.5], [-0.5, -0.5, -0.5]]
    basic = np.array([across, np.transpose(across), centre])
    first = np.stack([basic[c % 3] for c in range(CHANNELS[0])], axis=-1)[:, :, None, :]
    second, third = (np.zeros((KERNEL, KERNEL, a, b)) for a, b in zip(CHANNELS, CHANNELS[1:], strict=False))
    second[0, 0, 3:] = 0.2
    second[0, 0, 5] = 0.5
    second[1, 1, 2:6] += 0.3
    third[1, 1, :8], third[1, 1, 8:] = 0.5, 0.1
    return Weights((first, second, third), (np.full((LAST * LAST * CHANNELS[-1], HIDDEN), 0.01), np.full(HIDDEN, -2.0)), (np.ones(HIDDEN), -2.0))


# Fixed values of the weight file: magic and version; seven lengths, then the numbers, little-endian, single precision.
MAGIC, VERSION = b"RCNN", 1


def write_weights(weights: Weights) -> bytes:
    """Kernels as (row, column, in, out), the dense layer by output, its bias, the head and its bias."""
    parts = [*weights.kernels, weights.dense[0].T, weights.dense[1], weights.head[0], np.array([weights.head[1]])]
    flat = [np.ascontiguousarray(p, dtype="<f4").ravel() for p in parts]
    return struct.pack("<4sI7I", MAGIC, VERSION, *map(len, flat)) + b"".join(p.tobytes() for p in flat)


def read_weights(data: bytes) -> Weights:
    """ValueError for another magic, a file that ends early or lengths that are not this network's."""
    if len(data) < 36 or data[:4] != MAGIC:
        raise ValueError("not a weight file")
    lengths = struct.unpack_from("<7I", data, 8)
    shapes = [(KERNEL, KERNEL, a, b) for a, b in zip((1, *CHANNELS), CHANNELS, strict=False)] + [(HIDDEN, LAST * LAST * CHANNELS[-1]), (HIDDEN,), (HIDDEN,), (1,)]
    if list(lengths) != [int(np.prod(s)) for s in shapes]:
        raise ValueError("weights of another network")
    if len(data) < 36 + 4 * sum(lengths):
        raise ValueError("weights end early")
    ends = 36 + 4 * np.cumsum([0, *lengths])
    k1, k2, k3, dense, bias, head, last = (np.frombuffer(data, "<f4", n, int(at)).astype(np.float64).reshape(s) for n, at, s in zip(lengths, ends, shapes, strict=False))
    return Weights((k1, k2, k3), (dense.T, bias), (head, float(last[0])))


def windows_of(image: np.ndarray, side: int) -> np.ndarray:
    """A view of all ``side`` by ``side`` windows over the first two axes of (n, row, column, channel)."""
    return np.lib.stride_tricks.sliding_window_view(image, (side, side), axis=(1, 2))


def forward(batch: np.ndarray, weights: Weights) -> np.ndarray:
    """Confidences of windows (n, 24, 24) with values from 0 to 1."""
    x = batch[..., None]
    for layer, kernel in enumerate(weights.kernels):
        x = np.maximum(np.einsum("nyxckl,klco->nyxo", windows_of(x, KERNEL), kernel, optimize=True), 0)
        if layer:
            n, h, w, c = x.shape
            x = x.reshape(n, h // 2, 2, w // 2, 2, c).max(axis=(2, 4))
    hidden = np.maximum(x.reshape(len(x), -1) @ weights.dense[0] + weights.dense[1], 0)
    return 1 / (1 + np.exp(-(hidden @ weights.head[0] + weights.head[1])))


def classify_frame(image: np.ndarray, weights: Weights, stride: int, least: float, at_once: int = 512) -> list[tuple]:
    """(x, y, w, h, score) of the windows of at least that confidence, then suppression above an overlap of 0.3."""
    if min(image.shape) < SIDE:
        return []
    tiles = windows_of((image / 255.0)[None, ..., None], SIDE)[0, ::stride, ::stride, 0]
    ny, nx = tiles.shape[:2]
    spots = np.arange(ny * nx)
    raw = []
    for a in range(0, len(spots), at_once):
        part = spots[a : a + at_once]
        conf = forward(tiles[part // nx, part % nx], weights)
        raw += [(int(s % nx) * stride, int(s // nx) * stride, SIDE, SIDE, float(c)) for s, c in zip(part, conf, strict=True) if c >= least]
    return suppressed(raw, 0.3)


def classify(frames: DataFrame, weights: Weights | None = None, stride: int = STRIDE, least: float = 0.5) -> DataFrame:
    """Boxes of packed frames (``frame``, ``width``, ``height``, ``gray``); a frame at a time, no shuffle. Without weights, those of :func:`template_weights`."""
    weights = weights or template_weights()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.frame, *b) for r in batch.itertuples() for b in classify_frame(np.frombuffer(r.gray, dtype=np.uint8).reshape(r.height, r.width), weights, stride, least)]
            yield pd.DataFrame(rows, columns=["frame", "x", "y", "w", "h", "score"])

    return frames.select("frame", "width", "height", "gray").mapInPandas(run, BOXES)


def convolve(pixels: DataFrame, kernel: list[list[float]], width: int, height: int) -> DataFrame:
    """``frame``, ``x``, ``y``, ``v``: sums under a kernel where it fits, negative ones as 0.

    Every pixel is dealt to the places that it counts for, and these are summed: one shuffle, combined before it.
    """
    kh, kw = len(kernel), len(kernel[0])
    uses = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(float(kernel[j][i])).alias("k")) for j in range(kh) for i in range(kw)))
    dealt = pixels.select("frame", "x", "y", "v", F.explode(uses).alias("u"))
    dealt = dealt.select("frame", (F.col("x") - F.col("u.dx")).alias("x"), (F.col("y") - F.col("u.dy")).alias("y"), (F.col("v") * F.col("u.k")).alias("part"))
    inside = F.col("x").between(0, width - kw) & F.col("y").between(0, height - kh)
    return dealt.where(inside).groupBy("frame", "x", "y").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("v"))


def max_pool(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The largest value of each whole box of two by two."""
    whole = pixels.where((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
    return whole.groupBy("frame", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.max("v").alias("v"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
