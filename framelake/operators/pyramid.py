"""The cascade over a whole pyramid as one plan: levels, prefix tables, and stages as filters on the windows that are left.

Pixels, tables and windows are rows with their ``frame`` and ``level``. A group of stages looks its places up for surviving
windows only, so a group joins a small part of what the group before it did. Arithmetic is in single precision where the
packed detector's is (:func:`framelake.operators.haar.detect_frame`), and both give the same boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialise
from .boxes import greedy_nms
from .haar import SIDE, Cascade, Settings, demo_cascade, levels
from .pixels import resize_area

WINDOW = ["frame", "level", "wx", "wy"]


def level_table(sizes: DataFrame, scale: float = 1.2, stride: int = 4, least: int = SIDE, most: int = 1024, deepest: int = 64) -> DataFrame:
    """``width``, ``height`` of frames and, of each of their levels, ``level``, ``level_width``, ``level_height``, ``scale``, ``box``, ``stride``, ``windows``.

    Levels end before a box larger than ``most`` or smaller than ``least``, and before a side of SIDE pixels. A fold over a frame's
    own row: no shuffle. Frames smaller than a window have none. ``deepest`` bounds the fold; scales of 1.01 or more from 4096 pixels need 520.
    """
    single = lambda c: c.cast("float")
    half_up = lambda c: F.floor(single(c) + F.lit(0.5).cast("float")).cast("int")
    step = lambda c: F.greatest(F.lit(SIDE), half_up(single(c.cast("float") / F.lit(scale).cast("float"))))
    place = lambda w, h, s, go: F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"), single(s).alias("s"), go.alias("go"))

    def after(acc: Column) -> Column:
        now = F.element_at(acc, -1)
        w, h = step(now["w"]), step(now["h"])
        go = (w < now["w"]) & (h < now["h"]) & (w > SIDE) & (h > SIDE)
        return F.when(now["go"] & go, F.array_append(acc, place(w, h, F.col("width").cast("float") / w.cast("float"), F.lit(True)))).when(now["go"], F.array_append(F.slice(acc, 1, F.size(acc) - 1), place(now["w"], now["h"], now["s"], F.lit(False)))).otherwise(acc)

    first = F.array(place(F.col("width"), F.col("height"), F.lit(1.0), F.lit(True)))
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), first, lambda acc, _: after(acc))
    rows = sizes.where((F.col("width") >= SIDE) & (F.col("height") >= SIDE)).select("width", "height", F.posexplode(chain).alias("level", "l"))
    box = half_up(F.lit(SIDE).cast("float") * F.col("l.s"))
    rows = rows.select("width", "height", "level", F.col("l.w").alias("level_width"), F.col("l.h").alias("level_height"), F.col("l.s").alias("scale"), box.alias("box"), F.greatest(F.lit(2), half_up(F.lit(stride).cast("float") * F.col("l.s"))).alias("stride"))
    count = lambda size: F.expr(f"({size} - {SIDE}) div stride + 1")
    return rows.where((F.col("box") <= most) & (F.col("box") >= least)).withColumn("windows", (count("level_width") * count("level_height")).cast("int"))


def pyramid(pixels: DataFrame, width: int, height: int, settings: Settings | None = None) -> DataFrame:
    """``frame``, ``level``, ``x``, ``y``, ``v`` of every level of frames of one size; each level is made of the one before it, and written."""
    s = (settings or Settings()).sane()
    now, size, out = pixels.select("frame", "x", "y", "v"), (width, height), None
    for level in levels(width, height, s.scale_factor, s.stride, s.min_size, s.max_size):
        to = level["width"], level["height"]
        if to != size:
            now, size = materialise(resize_area(now, *size, *to), f"level_{level['level']}"), to
        own = now.select("frame", F.lit(level["level"]).alias("level"), "x", "y", "v")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else pixels.where("false").select("frame", F.lit(0).alias("level"), "x", "y", "v")


def prefix_tables(pixels: DataFrame, tilted: bool) -> DataFrame:
    """``ii`` and ``ii2`` of every pixel of every level and, if ``tilted``, ``d``, the sum along its diagonal; 0 else."""
    v = F.col("v").cast("bigint")
    row, column, along = (Window.partitionBy("frame", "level", c).orderBy(o) for c, o in ((F.col("y"), "x"), (F.col("x"), "y"), (F.col("x") - F.col("y"), "x")))
    sums = pixels.select("frame", "level", "x", "y", F.sum(v).over(row).alias("s"), F.sum(v * v).over(row).alias("s2"), (F.sum(v).over(along) if tilted else F.lit(0).cast("bigint")).alias("d"))
    return sums.select("frame", "level", "x", "y", F.sum("s").over(column).alias("ii"), F.sum("s2").over(column).alias("ii2"), "d")


def all_windows(frames: DataFrame, width: int, height: int, settings: Settings) -> DataFrame:
    """WINDOW of every place of a window on every level of ``frames`` (distinct ``frame``)."""
    s = settings.sane()
    at = lambda size, step: list(range(0, size - SIDE + 1, step))
    found = levels(width, height, s.scale_factor, s.stride, s.min_size, s.max_size)
    each = F.array(*(F.struct(F.lit(x["level"]).alias("level"), F.lit(len(at(x["width"], x["stride"]))).alias("across"), F.lit(len(at(x["height"], x["stride"]))).alias("down"), F.lit(x["stride"]).alias("stride")) for x in found)) if found else F.array().cast("array<struct<level:int,across:int,down:int,stride:int>>")
    places = lambda c, name: F.explode(F.transform(F.sequence(F.lit(0), F.col(f"l.{c}") - 1), lambda i: i * F.col("l.stride"))).alias(name)
    return frames.select("frame", F.explode(each).alias("l")).select("frame", "l", places("across", "wx")).select("frame", F.col("l.level").alias("level"), "wx", places("down", "wy"))


def looked_up(windows: DataFrame, table: DataFrame, spots: list[tuple]) -> DataFrame:
    """Of each window and feature of ``spots`` (feature, column, x, y, weight), the weighted sum of its places: WINDOW, ``feature``, ``response`` double."""
    names = {"ii": 0, "ii2": 1, "d": 2}
    asked = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(names[c]).alias("of"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(float(k)).alias("k")) for f, c, x, y, k in spots))
    wide = windows.select(*WINDOW, F.explode(asked).alias("c")).select(*WINDOW, "c.feature", "c.of", "c.k", (F.col("wx") + F.col("c.x")).alias("x"), (F.col("wy") + F.col("c.y")).alias("y"))
    value = F.when(F.col("of") == 0, F.col("ii")).when(F.col("of") == 1, F.col("ii2")).otherwise(F.col("d"))
    joined = wide.join(table, ["frame", "level", "x", "y"], "left")  # places left of or above the level have no row and no sum
    return joined.groupBy(*WINDOW, "feature").agg(F.coalesce(F.sum(F.col("k") * value), F.lit(0.0)).alias("response"))


def normed(windows: DataFrame, table: DataFrame, variance: int) -> DataFrame:
    """The windows that pass the variance filter, with ``norm``, what their responses are multiplied by."""
    corners = ((SIDE - 2, SIDE - 2, 1), (0, SIDE - 2, -1), (SIDE - 2, 0, -1), (0, 0, 1))
    sums = looked_up(windows, table, [(f, c, x, y, k) for f, c in ((0, "ii"), (1, "ii2")) for x, y, k in corners])
    both = sums.groupBy(*WINDOW).agg(*(F.max(F.when(F.col("feature") == f, F.col("response"))).cast("bigint").alias(n) for f, n in ((0, "s"), (1, "s2"))))
    n = (SIDE - 2) ** 2
    spread = F.col("s2") * n - F.col("s") * F.col("s")
    return both.where((spread >= variance * n * n) & (spread > 0)).select(*WINDOW, (1 / F.sqrt(spread.cast("double"))).cast("float").alias("norm"))


def features_of(cascade: Cascade, stages: range) -> list[tuple]:
    used = sorted({w.feature for s in stages for w in cascade.stages[s][1]})
    return [(f, "d" if diagonal else "ii", x, y, k) for f in used for diagonal, x, y, k in cascade.spots(f)]


def stage_total(weak: tuple, value, low=lambda w, v: v < F.lit(w["threshold"])) -> Column:
    """The votes of a stage, added in order in single precision. ``value``: of a feature's number, its response."""
    single = lambda v: F.lit(float(v)).cast("float")
    rows = F.array(*(F.struct(F.lit(w.feature).alias("feature"), single(w.threshold).alias("threshold"), single(w.left).alias("left"), single(w.right).alias("right")) for w in weak))
    return F.aggregate(rows, single(0), lambda acc, w: (acc + F.when(value(w["feature"]) < w["threshold"], w["left"]).otherwise(w["right"])).cast("float"))


def stage_groups(count: int) -> list[range]:
    """Stages in order in groups of 1, 2, 4, and so on: the first ones, which most windows fail, are looked up alone."""
    out, at, size = [], 0, 1
    while at < count:
        out.append(range(at, min(count, at + size)))
        at, size = at + size, 2 * size
    return out


def surviving(windows: DataFrame, table: DataFrame, cascade: Cascade) -> DataFrame:
    """WINDOW, ``norm`` and ``score`` (single precision) of the ``windows`` (with ``norm``) that pass every stage."""
    left = windows.withColumn("score", F.lit(0.0).cast("float"))
    for stages in stage_groups(len(cascade.stages)):
        found = looked_up(left, table, features_of(cascade, stages)).join(left.select(*WINDOW, "norm", "score"), WINDOW)
        value = (F.col("response").cast("float") * F.col("norm")).cast("float")
        held = found.groupBy(*WINDOW, "norm", "score").agg(F.map_from_entries(F.collect_list(F.struct("feature", value.alias("value")))).alias("values"))
        totals = [stage_total(cascade.stages[s][1], lambda f: F.element_at("values", f)) for s in stages]
        held = held.select(*WINDOW, "norm", "score", F.array(*totals).alias("totals"))
        least = F.array(*((F.lit(float(cascade.stages[s][0])).cast("float") + F.lit(float(cascade.bias)).cast("float")).cast("float") for s in stages))
        passed = F.forall(F.arrays_zip("totals", least.alias("least")), lambda t: t["totals"] >= t["least"])
        left = held.where(passed).select(*WINDOW, "norm", F.aggregate("totals", F.col("score"), lambda acc, t: (acc + t).cast("float")).alias("score"))
    return left


def boxes_of(windows: DataFrame, width: int, height: int, settings: Settings, mul: bool = False) -> DataFrame:
    """``frame``, ``rank``, ``x``, ``y``, ``w``, ``h``, ``score``: windows in the frame's own pixels, held within it, the best first, then by level and place.

    A place is divided by its level's scale, as the tool to be matched does; ``mul`` multiplies instead.
    """
    s = settings.sane()
    per_level = {x["level"]: x for x in levels(width, height, s.scale_factor, s.stride, s.min_size, s.max_size)} or {0: {"scale": 1.0, "box": SIDE}}
    pick = lambda key, kind: F.element_at(F.create_map(*(F.lit(v) for k, x in per_level.items() for v in (k, x[key]))), F.col("level")).cast(kind)
    scale, box = pick("scale", "float"), pick("box", "int")
    at = lambda c: F.floor((F.col(c).cast("float") * scale if mul else (F.col(c).cast("float") / scale).cast("float")) + F.lit(0.5).cast("float")).cast("int")
    order = Window.partitionBy("frame").orderBy(F.desc("score"), "level", "wy", "wx")
    rows = windows.where(F.col("score") >= s.min_score).withColumn("rank", F.row_number().over(order))
    held = lambda c, size: F.greatest(F.lit(0), F.least(at(c), F.greatest(F.lit(0), F.lit(size) - box)))
    return rows.select("frame", "rank", held("wx", width).alias("x"), held("wy", height).alias("y"), box.alias("w"), box.alias("h"), F.col("score").cast("double").alias("score"))


def accepted_windows(pixels: DataFrame, width: int, height: int, cascade: Cascade | None = None, settings: Settings | None = None) -> DataFrame:
    """WINDOW, ``norm``, ``score`` of all windows of all levels that pass the variance filter and every stage."""
    cascade, settings = cascade or demo_cascade(), settings or Settings()
    table = materialise(prefix_tables(pyramid(pixels, width, height, settings), bool(cascade.tilted)), "prefix")
    open_ = materialise(normed(all_windows(pixels.select("frame").distinct(), width, height, settings), table, settings.variance), "open")
    return surviving(open_, table, cascade)


def detect_pyramid(pixels: DataFrame, width: int, height: int, cascade: Cascade | None = None, settings: Settings | None = None, threshold: float = 0.3) -> DataFrame:
    """``frame``, ``rank``, ``x``, ``y``, ``w``, ``h``, ``score`` of the boxes that suppression keeps, of frames of one size given as pixels.

    All levels and windows are rows; nothing of a frame is gathered but its boxes. Frames smaller than a window have no boxes.
    """
    settings = settings or Settings()
    raw = boxes_of(accepted_windows(pixels, width, height, cascade, settings), width, height, settings)
    return greedy_nms(raw, threshold)


def stage_trace(pixels: DataFrame, width: int, height: int, cascade: Cascade | None = None, settings: Settings | None = None) -> DataFrame:
    """WINDOW, ``stage``, ``weak``, ``feature``, ``response``, ``vote``, ``total`` (of the stage) and ``failed`` (the window's first failing stage; null if it passes all).

    What a debugging run shows of every window, the variance filter aside: responses are not normalised, and a vote
    goes right above its threshold for a positive sign, left for another. Whole windows are traced, so ``failed`` is by these votes, too.
    """
    cascade, settings = cascade or demo_cascade(), settings or Settings()
    table = materialise(prefix_tables(pyramid(pixels, width, height, settings), bool(cascade.tilted)), "prefix")
    every = all_windows(pixels.select("frame").distinct(), width, height, settings)
    found = looked_up(every, table, features_of(cascade, range(len(cascade.stages))))
    single = lambda v: F.lit(float(v)).cast("float")
    weak = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(k).alias("weak"), F.lit(w.feature).alias("feature"), single(w.threshold).alias("threshold"), F.lit(w.sign).alias("sign"), single(w.left).alias("left"), single(w.right).alias("right"), single(t).alias("least")) for s, (t, ws) in enumerate(cascade.stages) for k, w in enumerate(ws)))
    votes = found.select(*WINDOW, F.col("response").cast("float").alias("response"), F.explode(F.filter(weak, lambda w: w["feature"] == F.col("feature"))).alias("w"))
    vote = F.when((F.col("response") > F.col("w.threshold")) == (F.col("w.sign") > 0), F.col("w.right")).otherwise(F.col("w.left"))
    by_window = Window.partitionBy(*WINDOW)
    by_stage = Window.partitionBy(*WINDOW, "stage")
    rows = votes.select(*WINDOW, F.col("w.stage").alias("stage"), F.col("w.weak").alias("weak"), F.col("w.feature").alias("feature"), "response", vote.alias("vote"), F.col("w.least").alias("least"))
    rows = rows.withColumn("total", F.sum("vote").over(by_stage).cast("float"))
    failed = F.min(F.when(F.col("total") < F.col("least") + single(cascade.bias), F.col("stage"))).over(by_window)
    return rows.select(*WINDOW, "stage", "weak", "feature", "response", "vote", "total", failed.alias("failed"))
