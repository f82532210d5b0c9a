"""Training of the small classifier: gradients are summed within tasks and merged some at a time; the driver holds the weights only.

A step reads the windows of its turn, takes the gradients of the mean loss, and moves the weights by Adam. What the driver and a
task exchange is as large as the weights, however many windows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, materialise
from .networks import KERNEL, SIDE, Weights, template_weights, windows_of

#: Adam's decay rates and small number, and what a gradient is cut to, by element. Fixed values.
DECAY, SECOND_DECAY, SMALL, CLIP = 0.9, 0.999, 1e-8, 5.0
#: Windows that a task takes at once, and parts that one task merges.
AT_ONCE, FAN = 128, 32

PART = "part long, n long, loss double, right long, gradients binary"


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([k.ravel() for k in weights.kernels] + [weights.dense[0].ravel(), weights.dense[1].ravel(), weights.head[0].ravel(), np.array([weights.head[1]])])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    """The numbers of :func:`flat` in the shapes of ``like``."""
    at = 0

    def take(shape: tuple[int, ...]) -> np.ndarray:
        nonlocal at
        size = int(np.prod(shape))
        out = values[at : at + size].reshape(shape)
        at += size
        return out

    kernels = tuple(take(k.shape) for k in like.kernels)
    dense = take(like.dense[0].shape), take(like.dense[1].shape)
    head = take(like.head[0].shape)
    return Weights(kernels, dense, (head, float(values[at])))


def pooled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest of two by two, and where it was (the first of equals)."""
    n, h, w, c = x.shape
    boxes = x.reshape(n, h // 2, 2, w // 2, 2, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, h // 2, w // 2, c, 4)
    at = boxes.argmax(axis=-1)
    return np.take_along_axis(boxes, at[..., None], axis=-1)[..., 0], at


def unpooled(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, h, w, c = d.shape
    boxes = np.zeros((n, h, w, c, 4))
    np.put_along_axis(boxes, at[..., None], d[..., None], axis=-1)
    return boxes.reshape(n, h, w, c, 2, 2).transpose(0, 1, 4, 2, 5, 3).reshape(n, 2 * h, 2 * w, c)


def gradients(batch: np.ndarray, labels: np.ndarray, weights: Weights) -> tuple[float, int, np.ndarray]:
    """Summed loss (cross entropy of the logit), right answers and summed gradients of windows (n, 24, 24) with labels 0 or 1."""
    held, x = [], batch[..., None]
    for layer, kernel in enumerate(weights.kernels):
        seen = windows_of(x, KERNEL)
        made = np.maximum(np.einsum("nyxckl,klco->nyxo", seen, kernel, optimize=True), 0)
        out, at = pooled(made) if layer else (made, None)
        held.append((x.shape, seen, made, at, kernel))
        x = out
    last = x.reshape(len(x), -1)
    hidden = np.maximum(last @ weights.dense[0] + weights.dense[1], 0)
    z = hidden @ weights.head[0] + weights.head[1]
    loss = np.maximum(z, 0) - z * labels + np.log1p(np.exp(-np.abs(z)))
    dz = 1 / (1 + np.exp(-z)) - labels
    parts = [hidden.T @ dz, np.array([dz.sum()])]
    dh = np.outer(dz, weights.head[0]) * (hidden > 0)
    parts = [last.T @ dh, dh.sum(axis=0), *parts]
    dx = (dh @ weights.dense[0].T).reshape(x.shape)
    for shape, seen, made, at, kernel in reversed(held):
        dy = (unpooled(dx, at) if at is not None else dx) * (made > 0)
        parts = [np.einsum("nyxckl,nyxo->klco", seen, dy, optimize=True), *parts]
        dx = np.zeros(shape)
        for k in range(KERNEL):
            for l in range(KERNEL):  # noqa: E741
                dx[:, k : k + dy.shape[1], l : l + dy.shape[2]] += dy @ kernel[k, l].T
    return float(loss.sum()), int(((z > 0) == (labels > 0.5)).sum()), np.concatenate([p.ravel() for p in parts])


class Adam(NamedTuple):
    """What an optimiser carries from step to step."""

    step: int
    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def new(size: int) -> Adam:
        return Adam(0, np.zeros(size), np.zeros(size))

    def moved(self, values: np.ndarray, gradient: np.ndarray, rate: float) -> tuple[np.ndarray, Adam]:
        """The values after a step, and the optimiser's next state; each element of the gradient is cut to CLIP on either side."""
        g = np.clip(gradient, -CLIP, CLIP)
        step, first, second = self.step + 1, DECAY * self.first + (1 - DECAY) * g, SECOND_DECAY * self.second + (1 - SECOND_DECAY) * g * g
        change = rate * (first / (1 - DECAY**step)) / (np.sqrt(second / (1 - SECOND_DECAY**step)) + SMALL)
        return values - change, Adam(step, first, second)


def summed(windows: DataFrame, weights: Weights) -> tuple[int, float, int, np.ndarray]:
    """Windows, summed loss, right answers and summed gradients of all of ``windows`` (``pixels`` binary of 24 by 24, ``label``)."""
    size = len(flat(weights))

    def part(n: int, loss: float, right: int, total: np.ndarray, number: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [number], "n": [n], "loss": [loss], "right": [right], "gradients": [total.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, loss, right, total = 0, 0.0, 0, np.zeros(size)
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                some = batch.iloc[a : a + AT_ONCE]
                image = np.frombuffer(b"".join(some["pixels"]), dtype=np.uint8).reshape(-1, SIDE, SIDE) / 255.0
                more, good, g = gradients(image, some["label"].to_numpy(dtype=float), weights)
                n, loss, right, total = n + len(some), loss + more, right + good, total + g
        if n:
            yield part(n, loss, right, total, TaskContext.get().partitionId())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = np.zeros(size)
        for g in group["gradients"]:
            total += np.frombuffer(g)
        return part(int(group["n"].sum()), float(group["loss"].sum()), int(group["right"].sum()), total, int(group["part"].iloc[0]) // FAN)

    parts = materialise(windows.select("pixels", "label").mapInPandas(run, PART), "gradients")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        last, parts = parts, materialise(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, PART), "gradients")
        discard(last)
        most //= FAN
    row = parts.first()
    discard(parts)
    return (row["n"], row["loss"], row["right"], np.frombuffer(row["gradients"])) if row else (0, 0.0, 0, np.zeros(size))


class Trained(NamedTuple):
    """The weights of the lowest running loss, and of every step the mean loss and the share of right answers before it moved."""

    weights: Weights
    history: list[tuple[int, float, float]]


def train(windows: DataFrame, weights: Weights | None = None, steps: int = 8, rate: float = 0.001, turns: int = 1, settle: int = 1) -> Trained:
    """Train on ``windows``: ``id``, ``pixels`` (binary, 24 by 24), ``label`` (0 or 1); rows with a null or of another size take no part.

    Step ``k`` takes the windows whose hash falls into turn ``k`` mod ``turns``. The snapshot that is returned is the one after the step, from step ``settle`` on,
    whose running mean loss is lowest; without any window the weights come back as they were.
    """
    like = weights or template_weights()
    sound = materialise(windows.where(F.col("pixels").isNotNull() & (F.octet_length("pixels") == SIDE * SIDE) & F.col("label").isin(0, 1)).select("pixels", "label", F.pmod(F.xxhash64("id"), F.lit(turns)).alias("turn")), "windows")
    values, adam = flat(like), Adam.new(len(flat(like)))
    best, least, total, seen, history = values, float("inf"), 0.0, 0, []
    for step in range(steps):
        n, loss, right, gradient = summed(sound.where(F.col("turn") == step % turns), shaped(values, like))
        if not n:
            continue
        values, adam = adam.moved(values, gradient / n, rate)
        total, seen = total + loss, seen + n
        history.append((step, loss / n, right / n))
        if step + 1 >= settle and total / seen < least:
            best, least = values, total / seen
    discard(sound)
    return Trained(shaped(best, like), history)
