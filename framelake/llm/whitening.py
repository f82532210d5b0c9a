"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers, so that their sums, and with them the means, are exact. A task holds each centred entry as a
double-double, splits it into slices of few bits (an error-free transformation: products of slices and their sums over
a block of rows are exact in doubles), and adds the blocks' outer products up as pairs of a high and a low part. The parts
of all tasks are merged in the same way, some at a time. The covariance's eigenvectors come from LAPACK's symmetric driver
(tridiagonal form, then divide and conquer) and are refined against both parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise

#: Steps of an entry's unit, and what is added to make entries positive.
STEPS, SHIFT = 1024, 100_000
#: Entries are held within this many steps on either side.
FAR = 2**52
#: Components that are returned at most.
COMPONENTS = 8
#: Rows of a block, and bits and number of the slices: 2 * 20 bits and 2**12 rows fit a double's 53 bits.
ROWS, BITS, SLICES = 4096, 20, 4
#: Parts that one task merges.
FAN = 32
#: Steps of refinement of the eigenvectors; each squares their error.
REFINED = 2
#: Eigenvalues below this share of the largest are noise.
NOISE = 1e-13

PART_SCHEMA = "part long, n long, high binary, low binary"


class Fit(NamedTuple):
    """``n`` rows, exact ``sums``, eigenvalues and eigenvectors (columns) of the covariance, largest first, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more_high: np.ndarray, more_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(high, more_high)
    t, f = two_sum(low, more_low)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
    """SLICES arrays of at most BITS significant bits below the largest entry of their column, which add up to ``high + low`` but for what lies below all of them."""
    for _ in range(SLICES):
        most = np.abs(high).max(axis=0)
        unit = np.exp2(np.ceil(np.log2(np.where(most > 0, most, 1.0))) + 53 - BITS)
        part = (high + unit) - unit
        yield part
        high, low = two_sum(high - part, low)


def outer_products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over the rows of ``high + low`` of their outer products, as a double-double."""
    d = high.shape[1]
    total = np.zeros((d, d)), np.zeros((d, d))
    for a in range(0, len(high), ROWS):
        parts = list(slices(high[a : a + ROWS], low[a : a + ROWS]))
        for i in range(SLICES):
            for j in range(SLICES - i):  # what is left out lies below the last slice
                total = add(*total, parts[i].T @ parts[j], np.zeros((d, d)))
    return total


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x - sums / n`` of whole numbers as a double-double; whole and broken parts of the mean are taken apart exactly."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    broken = np.array([r / n for r in rest])
    lost = np.array([float(_remainder(r, n, b)) for r, b in zip(rest, broken.tolist(), strict=True)])
    high, low = two_sum((x - whole).astype(np.float64), -broken)
    return two_sum(high, low - lost)


def _remainder(r: int, n: int, b: float):
    """``r / n - b``."""
    from fractions import Fraction

    return Fraction(r, n) - Fraction(b)


def _vector_is_sound(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def stepped(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x``, the steps of every entry, of the rows that take part."""
    sound = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("c")).where(_vector_is_sound("c"))
    step = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c, F.lit(1e12)), F.lit(-1e12)) * STEPS), F.lit(FAR)), F.lit(-FAR)).cast("long") + SHIFT
    return sound.select("id", F.transform("c", step).alias("x"))


def sums_of(x: DataFrame) -> tuple[int, list[int]]:
    """The rows of the commonest length (of several, the greatest) and their exact sums by place."""
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return (lengths["n"] if lengths else 0), []
    each = x.where(F.size("x") == lengths["d"]).select(F.posexplode("x").alias("at", "v"))
    # halves, so that no sum overflows before 2**31 rows
    halves = each.groupBy("at").agg(F.sum(F.shiftright("v", 24)).alias("upper"), F.sum(F.col("v").bitwiseAND((1 << 24) - 1)).alias("lower")).orderBy("at").collect()
    return lengths["n"], [(r["upper"] << 24) + r["lower"] for r in halves]


def matrix(values: pd.Series, d: int) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.int64).reshape(len(values), d)


def part_of(n: int, high: np.ndarray, low: np.ndarray, part: int) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [n], "high": [high.tobytes()], "low": [low.tobytes()]})


def merged(parts: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The sum of all rows (PART_SCHEMA): FAN at a time in tasks, until one is left; parts are merged in the order of their numbers."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = np.zeros(d * d), np.zeros(d * d)
        for high, low in zip(group["high"], group["low"], strict=True):
            total = add(*total, np.frombuffer(high), np.frombuffer(low))
        return part_of(int(group["n"].sum()), *total, int(group["part"].iloc[0]) // FAN)

    parts = materialise(parts, "parts")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = materialise(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, PART_SCHEMA), "parts")
        most //= FAN
    row = parts.first()
    if row is None:
        return 0, np.zeros((d, d)), np.zeros((d, d))
    return row["n"], np.frombuffer(row["high"]).reshape(d, d), np.frombuffer(row["low"]).reshape(d, d)


def task_parts(rows: DataFrame, d: int, entries) -> DataFrame:
    """A row (PART_SCHEMA) of every task: outer products of what ``entries`` makes (high and low part) of each batch."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, total = 0, (np.zeros((d, d)), np.zeros((d, d)))
        for batch in batches:
            if len(batch):
                n += len(batch)
                total = add(*total, *outer_products(*entries(batch)))
        if n:
            yield part_of(n, *total, TaskContext.get().partitionId())

    return rows.mapInPandas(products, PART_SCHEMA)


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric double-double matrix.

    ``numpy.linalg.eigh`` is LAPACK's ``syevd``: tridiagonal form, then divide and conquer. What rounding to one double
    cost is won back by REFINED steps of iterative refinement in extended precision. The largest entry of each vector is positive.
    """
    found, vectors = np.linalg.eigh(high)
    exact, x = high.astype(np.longdouble) + low, vectors.astype(np.longdouble)
    near = 64 * np.finfo(np.float64).eps * max(np.abs(found).max(), np.finfo(np.float64).tiny)
    for _ in range(REFINED):
        left = np.eye(len(x), dtype=np.longdouble) - x.T @ x
        turned = x.T @ exact @ x
        turned, left = (turned + turned.T) / 2, (left + left.T) / 2
        values = np.diag(turned) / (1 - np.diag(left))
        apart = values[None, :] - values[:, None]
        # pairs so close that they are one to double precision keep what eigh gave, made orthogonal
        close = np.abs(apart) <= near
        x = x + x @ np.where(close, left / 2, (turned + values[None, :] * left) / np.where(close, 1, apart))
    x = x.astype(np.float64)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return values[order].astype(np.float64), x * np.where(signs == 0, 1, signs)


def fitted(x: DataFrame) -> Fit | None:
    """The fit over all rows of ``x`` (see :func:`stepped`) of one length; None if no row has an entry."""
    n, sums = sums_of(x)
    if not sums:
        return None
    d = len(sums)
    parts = task_parts(x.where(F.size("x") == d).select("x"), d, lambda batch: centred(matrix(batch["x"], d), n, sums))
    _, high, low = merged(parts, d)
    total = high.astype(np.longdouble) + low
    high = (total / n).astype(np.float64)
    low = (total / n - high).astype(np.float64)
    high, low = (high + high.T) / 2, (low + low.T) / 2
    values, vectors = eigen(high, low)
    return Fit(n, sums, values, vectors, float(np.trace(total / n)))


def identity_error(w: DataFrame, n: int, k: int) -> float | None:
    """The largest absolute entry of the covariance of ``w`` (array of ``k``), centred before multiplying, minus the identity."""
    if not k:
        return None
    means = [s / n for s in w.agg(*(F.sum(F.get("w", F.lit(i))) for i in range(k))).first()]

    def entries(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return two_sum(np.array(batch["w"].tolist()).reshape(len(batch), k), -np.array(means))

    _, high, low = merged(task_parts(w.select("w"), k, entries), k)
    return float(np.abs((high + low) / n - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_col``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every row of ``df`` that takes part, for its first ``components``.

    Left out are null vectors, those with null or non-finite entries, empty ones, and those of another length than the
    commonest (of several, the greatest). An entry ``c`` becomes ``floor(1024 * c) + 100000``; beyond 2**52 steps on
    either side, it stays there. ``deviation``: the sum of ``(n * x - S) ** 2``, exact; null if no long can hold it. Components
    whose eigenvalue is noise (none but 0 in exact arithmetic: copies of one row, or fewer rows than dimensions) have a null
    ``whitened`` and take no part in ``identity_error``. Vectors of fewer dimensions have fewer components. Null ids are
    kept as null, repeated rows are rows like others, other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    x = stepped(df, id_col, vector_col)
    fit = fitted(x)
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return spark.createDataFrame([], schema)
    d, n, sums = len(fit.sums), fit.n, fit.sums
    shown = min(components, d)
    real = int(np.count_nonzero(fit.values[:shown] > max(NOISE * fit.values[0], 0.0)))
    turn = fit.vectors[:, :real] / np.sqrt(fit.values[:real])

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array(sums, dtype=object)
        for batch in batches:
            rows = matrix(batch["x"], d)
            high, low = centred(rows, n, sums)
            far = np.abs(high).max(initial=0.0) * n
            if far * far * d < 2**62:
                off = rows * n - np.array([s % 2**64 for s in sums], dtype=np.uint64).astype(np.int64)  # wraps alike on both sides
                deviation = (off * off).sum(axis=1).tolist()
            else:
                deviation = [v if (v := int(((r * n - whole) ** 2).sum())) < 2**63 else None for r in rows.astype(object)]
            yield pd.DataFrame({"id": batch["id"], "deviation": pd.array(deviation, dtype="Int64"), "w": list(high @ turn + low @ turn)})

    rows = x.where(F.size("x") == d).select(F.col("id").cast("string"), "x")
    w = materialise(rows.mapInPandas(project, "id string, deviation long, w array<double>"), "whitened")
    error = identity_error(w, n, real)
    explained = [float(v / fit.trace) if fit.trace else None for v in fit.values[:shown]]
    lit = lambda v, kind: F.lit(v).cast(kind)
    each = w.select("id", "deviation", "w", F.posexplode(F.array(*(lit(v, "double") for v in explained))).alias("at", "explained"))
    return each.select(
        F.col("id").cast(kind).alias(id_col), (F.col("at") + 1).cast("int").alias("component"), lit(n, "long").alias("n"), "deviation",
        F.get("w", "at").alias("whitened"), "explained", lit(error, "double").alias("identity_error"),
    )
