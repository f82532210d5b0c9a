"""Hard negatives by dual-tree search over inner products.

Rows are dealt into blocks of neighbours; every block holds a tree of balls over its vectors, candidates' blocks being of one label.
A block of anchors meets a block of candidates as two trees: the inner products of all pairs below two nodes lie in an interval
that centres and radii give, and where no anchor of a node can use any of it, the pair of nodes is left. Leaves are scored exactly.
Rows are dealt by a tree of planes that a bounded sample fits; it decides what lies together, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, hint, materialise

#: Rows of the sample that places the planes, and their depth: 2**PLANES cells.
SAMPLE, PLANES = 4096, 6
#: Rows of a block of candidates and of anchors (anchors: on average), and of a leaf of either.
BLOCK, ANCHORS, LEAF, ANCHOR_LEAF = 4096, 1024, 128, 32
#: Pairs of blocks of a task, about.
PAIRS = 16
#: Entries and scores are held within these on either side.
HELD, FAR = 2**50, 2**62
NONE = -(2**63)
LAST = 2**63 - 1

FOUND_SCHEMA = "anchor long, question int, score long, id long, rid long"


class Tree:
    """Balls over the rows of ``points``. A node of more than ``leaf`` rows is parted across its widest dimension, at the
    widest gap in the middle half of its rows, so each part has a quarter of them at least. ``order`` says where rows come from."""

    def __init__(self, points: np.ndarray, leaf: int):
        order, spans, self.children = np.arange(len(points)), [(0, len(points))], []
        for a, b in spans:  # grows while it is read
            if b - a > leaf:
                some = points[order[a:b]]
                along = some[:, np.argmax(some.var(axis=0))]
                rank = np.argsort(along, kind="stable")
                order[a:b] = order[a:b][rank]
                first = (b - a) // 4
                gaps = np.diff(along[rank])[first : b - a - first]
                middle = a + first + 1 + (int(gaps.argmax()) if gaps.any() else len(gaps) // 2)
                self.children.append((len(spans), len(spans) + 1))
                spans += [(a, middle), (middle, b)]
            else:
                self.children.append(None)
        self.order, self.spans, self.points = order, spans, points[order]
        self.centre = np.stack([self.points[a:b].mean(axis=0) for a, b in spans])
        self.radius = np.array([np.sqrt(((self.points[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans, self.centre, strict=True)])
        self.norm = np.sqrt((self.centre**2).sum(axis=1))


class Questions:
    """What a block of anchors asks: for each anchor and question, the first ``k`` of the scores from ``low`` to ``cap``, and those found so far."""

    def __init__(self, rids: np.ndarray, labels: np.ndarray, low: np.ndarray, cap: np.ndarray, k: int, same: bool):
        self.rids, self.labels, self.low, self.cap, self.k, self.same = rids, labels, low, cap, k, same
        shape = (*low.shape, k)
        self.score, self.id, self.rid = np.full(shape, NONE), np.full(shape, LAST), np.full(shape, LAST)

    def need(self, live: np.ndarray) -> np.ndarray:
        """The least score that is still of use to each question; LAST for questions that are not ``live``."""
        return np.where(live[:, None], np.maximum(self.low, self.score[:, :, -1]), LAST)

    def offer(self, a: int, b: int, scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, need: np.ndarray) -> bool:
        """Take the ``scores`` (anchors ``a`` to ``b`` by candidates) that are of use; whether there were any."""
        fits = (scores[:, None, :] <= self.cap[a:b, :, None]) & (scores[:, None, :] >= need[:, :, None])
        if self.same:
            fits &= (rids[None, :] != self.rids[a:b, None])[:, None, :]
        row, question = np.nonzero(fits.any(axis=2))
        if not len(row):
            return False
        fits = fits[row, question]
        columns = np.argsort(~fits, axis=1, kind="stable")[:, : fits.sum(axis=1).max()]
        fits = np.take_along_axis(fits, columns, axis=1)
        both = (
            np.concatenate((self.score[a + row, question], np.where(fits, scores[row[:, None], columns], NONE)), axis=1),
            np.concatenate((self.id[a + row, question], np.where(fits, ids[columns], LAST)), axis=1),
            np.concatenate((self.rid[a + row, question], np.where(fits, rids[columns], LAST)), axis=1),
        )
        order = np.lexsort((both[2], both[1], ~both[0]), axis=1)[:, : self.k]
        self.score[a + row, question], self.id[a + row, question], self.rid[a + row, question] = (np.take_along_axis(c, order, axis=1) for c in both)
        return True

    def found(self) -> pd.DataFrame:
        row, question, k = np.nonzero(self.score != NONE)
        return pd.DataFrame({"anchor": self.rids[row], "question": question.astype(np.int32), "score": self.score[row, question, k], "id": self.id[row, question, k], "rid": self.rid[row, question, k]})


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; those beyond FAR on either side are held there."""
    bound = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], dtype=object)
    return np.clip(whole(a) @ whole(b).T, -FAR, FAR).astype(np.int64)


def search(anchors: Tree, asked: Questions, candidates: Tree, label: int, ids: np.ndarray, rids: np.ndarray) -> None:
    """Offer ``asked`` all candidates, of one label, but those of pairs of nodes whose interval nobody can use."""
    live = (asked.labels == label) == asked.same
    if not live.any():
        return
    middle = anchors.centre @ candidates.centre.T
    around = anchors.radius[:, None] * (candidates.norm + candidates.radius) + anchors.norm[:, None] * candidates.radius
    slack = 1e-9 * (anchors.norm + anchors.radius)[:, None] * (candidates.norm + candidates.radius) + 1e-6
    upper, lower = middle + around + slack, middle - around - slack
    need = asked.need(live)
    cap = np.where(live[:, None], asked.cap, NONE)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        a, b = anchors.spans[i]
        if upper[i, j] < need[a:b].min() or lower[i, j] > cap[a:b].max():
            continue
        left, right = anchors.children[i], candidates.children[j]
        if left is None and right is None:
            c, d = candidates.spans[j]
            if asked.offer(a, b, exact_scores(anchors.points[a:b], candidates.points[c:d]), ids[c:d], rids[c:d], need[a:b]):
                need[a:b] = np.where(live[a:b, None], np.maximum(asked.low[a:b], asked.score[a:b, :, -1]), LAST)
        elif right is None or left is not None and anchors.radius[i] >= candidates.radius[j]:
            todo += [(k, j) for k in left]
        else:  # the more promising half is looked at first
            todo += sorted(((i, k) for k in right), key=lambda pair: upper[pair])


class Form(NamedTuple):
    """Dimensions of the vectors, bytes of an entry, and the planes: a direction and a place for every inner node."""

    dims: int
    width: int
    directions: np.ndarray
    places: np.ndarray

    def matrix(self, vectors: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(vectors), dtype=f"<i{self.width}").reshape(-1, self.dims).astype(np.float64)

    def cells(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        beyond = points @ self.directions.T > self.places
        for _ in range(PLANES):
            at = 2 * at + 1 + beyond[np.arange(len(points)), at]
        return at


def planes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes across the widest direction of what lies on each side of the planes above, in the middle of it."""
    nodes, dims = 2**PLANES - 1, sample.shape[1]
    directions, places = np.zeros((nodes, dims)), np.zeros(nodes)
    held = {0: sample}
    for k in range(nodes):
        some = held.pop(k)
        if len(some) > 1:
            off = some - some.mean(axis=0)
            directions[k] = np.linalg.eigh(off.T @ off)[1][:, -1]
            places[k] = np.median(some @ directions[k])
        beyond = some @ directions[k] > places[k]
        held[2 * k + 1], held[2 * k + 2] = some[~beyond], some[beyond]
    return directions, places


def form_of(rows: DataFrame) -> Form:
    """The form of the vectors of ``rows`` (``rid``, ``x``); the sample is the SAMPLE rows of the smallest hashes."""
    most = rows.agg(F.max(F.size("x")).alias("dims"), F.max(F.aggregate("x", F.lit(0).cast("long"), lambda m, v: F.greatest(m, F.abs(v)))).alias("most")).first()
    dims = max(1, most["dims"] or 0)
    width = next(w for w in (2, 4, 8) if (most["most"] or 0) < 2 ** (8 * w - 1) or w == 8)
    sample = [r["x"] for r in rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("x").collect()]
    points = np.zeros((len(sample), dims))
    for at, x in zip(points, sample, strict=True):
        at[: len(x)] = x
    return Form(dims, width, *planes(points))


def packed(rows: DataFrame, form: Form) -> DataFrame:
    """``rows`` with ``cell`` and the vector as bytes (``v``), in place of ``x``."""
    rest = [f for f in rows.schema.fields if f.name != "x"]
    names = [f.name for f in rest]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = np.zeros((len(batch), form.dims), dtype=f"<i{form.width}")
            for at, x in zip(whole, batch["x"], strict=True):
                at[: len(x)] = x
            yield batch[names].assign(cell=form.cells(whole.astype(np.float64)), v=[x.tobytes() for x in whole])

    return rows.mapInPandas(pack, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rest] + ["cell long", "v binary"]))


def candidate_blocks(rows: DataFrame, form: Form, count: int) -> DataFrame:
    """Blocks of at most BLOCK neighbours of one label: ``block``, ``label``, ``ids``, ``rids``, ``vectors``. A label may have any share of the rows."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, count // (4 * BLOCK) + 1)
    dealt = rows.repartitionByRange(parts, "label", "cell", "rid").sortWithinPartitions("label", "cell", "rid").select(F.spark_partition_id().alias("part"), "rid", "id", "label", "v")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, made = None, 0

        def block(some: pd.DataFrame) -> pd.DataFrame:
            raw = lambda c: some[c].to_numpy(dtype="<i8").tobytes()
            return pd.DataFrame({"block": [int(some["part"].iloc[0]) << 32 | made], "label": [int(some["label"].iloc[0])], "ids": [raw("id")], "rids": [raw("rid")], "vectors": [b"".join(some["v"])]})

        for batch in batches:
            held = batch if held is None else pd.concat((held, batch))
            while len(held):
                own = int((held["label"].to_numpy() == held["label"].iloc[0]).argmin()) or len(held)
                if own < BLOCK and own == len(held):
                    break
                yield block(held.iloc[: min(own, BLOCK)])
                made, held = made + 1, held.iloc[min(own, BLOCK) :]
        if held is not None and len(held):
            yield block(held)

    return materialise(dealt.mapInPandas(build, "block long, label long, ids binary, rids binary, vectors binary"), "candidates")


def anchor_blocks(rows: DataFrame, form: Form, count: int) -> DataFrame:
    """Blocks of about ANCHORS neighbours of any label: ``anchors``, a number from 0, ``labels``, ``rids``, ``vectors`` and the questions ``low`` and ``cap``."""
    parts = count // ANCHORS + 1
    dealt = rows.repartitionByRange(parts, "cell", "rid").select(F.spark_partition_id().alias("part"), "rid", "label", "v", "low", "cap")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if sum(map(len, held)):
            some = pd.concat(held)
            raw = lambda c: some[c].to_numpy(dtype="<i8").tobytes()
            flat = lambda c: np.concatenate(some[c].tolist()).astype("<i8").tobytes()
            yield pd.DataFrame({"anchors": [int(some["part"].iloc[0])], "labels": [raw("label")], "rids": [raw("rid")], "vectors": [b"".join(some["v"])], "low": [flat("low")], "cap": [flat("cap")]})

    return materialise(dealt.mapInPandas(build, "anchors long, labels binary, rids binary, vectors binary, low binary, cap binary"), "anchors")


def first_found(candidates: DataFrame, anchors: DataFrame, form: Form, k: int, same: bool) -> DataFrame:
    """FOUND_SCHEMA and ``rank``: the first ``k`` rows that answer each question of ``anchors``, of the anchor's label or (not ``same``) of others."""
    last = anchors.agg(F.max("anchors")).first()[0]
    if last is None:
        return candidates.sparkSession.createDataFrame([], FOUND_SCHEMA + ", rank int")
    row_bytes = 4 * ANCHORS * (form.dims * form.width + 96)
    named = anchors.select("anchors", "labels", F.col("rids").alias("asking"), F.col("vectors").alias("points"), "low", "cap")
    pairs = candidates.withColumn("anchors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).join(hint(named, row_bytes), "anchors")
    parts = max(candidates.sparkSession.sparkContext.defaultParallelism, candidates.count() * (last + 1) // PAIRS + 1)
    pairs = pairs.repartition(parts, "block", "anchors").sortWithinPartitions("anchors", "block")

    def whole(value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype="<i8")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, asked = None, None, None
        for batch in batches:
            for row in batch.itertuples():
                if row.anchors != at:
                    if asked:
                        yield asked.found()
                    rids = whole(row.asking)
                    shape = (len(rids), -1)
                    at, tree = row.anchors, Tree(form.matrix([row.points]), ANCHOR_LEAF)
                    asked = Questions(*(c[tree.order] for c in (rids, whole(row.labels), whole(row.low).reshape(shape), whole(row.cap).reshape(shape))), k, same)
                own = Tree(form.matrix([row.vectors]), LEAF)
                search(tree, asked, own, row.label, whole(row.ids)[own.order], whole(row.rids)[own.order])
        if asked:
            yield asked.found()

    found = pairs.mapInPandas(answer, FOUND_SCHEMA)
    order = Window.partitionBy("anchor", "question").orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share(percent: int, up: bool):
    """``percent`` per cent of the column ``score``, rounded down or up; no step leaves a long."""
    rest = f"pmod(score, 100) * {percent}"
    return F.expr(f"((score - pmod(score, 100)) div 100) * {percent} + ({rest} + {99 if up else 0}) div 100")


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "x", anchor_col: str = "anchor",
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` of the hard negatives of every anchor.

    ``df``: an id, a label (whole number), a vector of whole numbers and whether the row is an anchor. The ``positives`` of an
    anchor are its first other rows of the same label by inner product (higher first, then the smaller id, then any fixed order); its negatives for one of
    them the first ``negatives`` rows of other labels with a score of ``least`` to ``most`` per cent of the positive's.

    Rows with a null label or vector, or a null entry, take no part; a null ``anchor_col`` is false. Shorter vectors are filled with
    zeros, entries beyond 2**50 are held there. A null id sorts behind all others and is returned as null. Repeated rows are rows of their own, so each is
    another's positive and has its own negatives. Scores beyond 2**62 are held there. An empty table, or one without anchors, gives an empty
    result. Other columns are not read.
    """
    bound_batches(df.sparkSession)
    whole = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vector_col).cast("array<long>"), lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(HELD)), F.lit(-HELD)))).alias("x"), F.coalesce(F.col(anchor_col), F.lit(False)).alias("anchor"))
    whole = whole.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    rows = materialise(whole.select(F.monotonically_increasing_id().alias("rid"), "*"), "vectors")
    form = form_of(rows)
    rows = materialise(packed(rows, form), "packed")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    candidates = candidate_blocks(rows, form, counts["rows"])
    asking = rows.where("anchor").select("rid", "id", "label", "cell", "v")
    fixed = lambda v: F.array(F.lit(v).cast("long"))
    first = anchor_blocks(asking.select("*", fixed(NONE + 1).alias("low"), fixed(LAST).alias("cap")), form, counts["anchors"])
    liked = materialise(first_found(candidates, first, form, positives, same=True).select(F.col("anchor").alias("rid"), "rank", "id", "score"), "positives")
    bounds = liked.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", share(least, True).alias("low"), share(most, False).alias("cap")))).alias("q"))
    filled = lambda name, rest: F.concat(F.col(f"q.{name}"), F.array_repeat(F.lit(rest).cast("long"), F.lit(positives) - F.size("q")))
    second = anchor_blocks(asking.join(bounds, "rid").select("rid", "label", "cell", "v", filled("low", LAST).alias("low"), filled("cap", NONE).alias("cap")), form, counts["anchors"])
    found = first_found(candidates, second, form, negatives, same=False).select(F.col("anchor").alias("rid"), (F.col("question") + 1).alias("of"), "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    asked = asking.select("rid", F.col("id").alias("anchor_id")).join(liked.select("rid", F.col("rank").alias("of"), F.col("id").alias("positive"), F.col("score").alias("positive_score")), "rid")
    known = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return found.join(asked, ["rid", "of"]).select(known("anchor_id").alias("anchor_id"), known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative").alias("negative_id"), "positive_score", "negative_score")
