"""Faces: long hashes and their clusters, eye pairs, gradient blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialise
from .components import connected_components
from .pixels import resize_area

#: Side of the image behind a hash, bits that two hashes may differ in, and the largest ratio of two areas: fixed values.
SIDE, NEAR, RATIO = 16, 10, 1.5


def row_words(bits: DataFrame, name: str) -> DataFrame:
    """``frame`` and ``name``: the bits (``frame``, ``y``, ``x``, ``up``) as one word of 16 bits a row, the first pixel highest."""
    word = F.bit_or(F.when(F.col("up"), F.expr(f"cast(shiftleft(1, {SIDE - 1} - x) as int)")).otherwise(F.lit(0)))
    rows = bits.groupBy("frame", "y").agg(word.alias("word"))
    return rows.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "word"))), lambda r: r["word"]).alias(name))


def long_average_hash(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``frame`` and ``average``: 256 bits, those above the mean of the image at 16 by 16."""
    small = pixels if (width, height) == (SIDE, SIDE) else resize_area(pixels, width, height, SIDE, SIDE)
    return row_words(small.withColumn("up", F.col("v") > F.avg("v").over(Window.partitionBy("frame"))), "average")


def long_gradient_hash(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``frame`` and ``gradient``: 272 bits, pixels of the image at 17 by 17 whose right neighbour is brighter."""
    small = resize_area(pixels, width, height, SIDE + 1, SIDE + 1)
    up = F.lead("v").over(Window.partitionBy("frame", "y").orderBy("x")) > F.col("v")
    return row_words(small.withColumn("up", up).where(F.col("x") < SIDE), "gradient")


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def near_hashes(hashes: DataFrame, name: str, words: int, most: int = NEAR) -> DataFrame:
    """``a``, ``b``: hashes (distinct arrays of ``name``, numbered by ``key``) that differ in at most ``most`` bits.

    The words are dealt to ``most + 1`` bands of 16 bits or more, of which one at least is equal in such a pair; two random hashes
    share a band with a chance of one in thousands, so pairs met grow with the close ones, not with all.
    """
    cuts = [i * words // (most + 1) for i in range(most + 2)]
    parts = F.array(*(F.xxhash64(F.lit(i), F.slice(name, a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a))
    dealt = hashes.select("key", F.col(name).alias("h"), F.explode(parts).alias("part"))
    left, right = dealt.select(F.col("key").alias("a"), F.col("h").alias("ha"), "part"), dealt.select(F.col("key").alias("b"), F.col("h").alias("hb"), "part")
    return left.join(right, "part").where("a < b").where(differing_bits(F.col("ha"), F.col("hb")) <= most).select("a", "b").distinct()


def linked_faces(faces: DataFrame, most: int = NEAR, ratio: float = RATIO) -> DataFrame:
    """``a``, ``b``: faces (``frame``, ``area``, ``average``, ``gradient``) of which either hash is close and the areas alike.

    Faces of one hash and area are linked with the first of them, and these firsts through steps of the area: sorted by it, each
    with the next one while the ratio allows, which connects the same classes as all pairs. Faces of different close hashes are
    linked in the same way, by the union of both. A face without an area links with none.
    """
    sized = faces.where("area > 0")
    out = None
    for name, words in (("average", SIDE), ("gradient", SIDE + 1)):
        keyed = materialise(sized.groupBy(name).agg(F.min("frame").alias("key")), "hashes")
        every = sized.join(keyed, name).select("key", "frame", "area")
        member = materialise(every.groupBy("key", "area").agg(F.min("frame").alias("frame")).select("key", "frame", "area"), "firsts")
        same = every.join(member.withColumnRenamed("frame", "first"), ["key", "area"]).where("frame != first").select(F.col("first").alias("a"), F.col("frame").alias("b"))
        pairs = near_hashes(keyed, name, words, most).select(F.col("a").alias("key"), F.struct("a", "b").alias("group"))
        groups = pairs.union(pairs.select(F.col("group.b"), "group"))
        groups = member.join(groups, "key").unionByName(member.withColumn("group", F.struct(F.col("key").alias("a"), F.col("key").alias("b"))))
        # Within a group every face may link with every other: neighbours by area connect what pairs would.
        order = Window.partitionBy("group").orderBy("area", "frame")
        steps = groups.select("frame", "area", F.lag(F.struct("frame", "area")).over(order).alias("before"))
        close = steps.where(F.col("area") <= ratio * F.col("before.area")).select(F.col("before.frame").alias("a"), F.col("frame").alias("b"))
        out = close.union(same) if out is None else out.union(close).union(same)
    return out.distinct()


def face_clusters(faces: DataFrame, most: int = NEAR, ratio: float = RATIO) -> DataFrame:
    """``frame`` and ``cluster``, the smallest frame that it is connected with by :func:`linked_faces`."""
    found = connected_components(materialise(linked_faces(faces, most, ratio), "links"))
    return faces.select("frame").join(found.select(F.col("node").alias("frame"), "component"), "frame", "left").select("frame", F.coalesce("component", "frame").alias("cluster"))


def top_faces(clusters: DataFrame, most: int = 3) -> DataFrame:
    """``rank``, ``cluster``, ``cluster_size`` and ``stands``: the largest clusters, of equals the first, each with its largest,
    then most confident face. ``clusters``: ``cluster``, ``frame``, ``area``, ``confidence``. The cap is the feature."""
    best = F.max_by("frame", F.struct("area", "confidence", (-F.col("frame")).alias("first"))).alias("stands")
    found = clusters.groupBy("cluster").agg(F.count("*").alias("cluster_size"), best).orderBy(F.desc("cluster_size"), "cluster").limit(most)
    return found.select(F.row_number().over(Window.orderBy(F.desc("cluster_size"), "cluster")).alias("rank"), "cluster", "cluster_size", "stands")


def eye_pairs(eyes: DataFrame, side: Column) -> DataFrame:
    """``frame``, ``ok``, ``dx``, ``dy``: the widest pair of eyes (``frame``, ``x``, ``y``, ``w``, ``h``) of a crop whose centres differ
    in height by at most .30 of the crop's width ``side``; ``dx`` and ``dy`` are shares of it, 0 without such a pair.

    A crop's few eyes are one array; for each eye only its best partner is kept.
    """
    centre = F.struct((F.col("x") + F.col("w") / 2.0).alias("x"), (F.col("y") + F.col("h") / 2.0).alias("y"))
    crops = eyes.groupBy("frame").agg(F.array_sort(F.collect_list(centre)).alias("c"), F.max(side).alias("side"))

    def partner(e: Column, i: Column) -> Column:
        later = F.filter(F.slice("c", i + 2, F.size("c")), lambda o: F.abs(o["y"] - e["y"]) <= 0.30 * F.col("side"))
        return F.array_max(F.transform(later, lambda o: F.struct((o["x"] - e["x"]).alias("dx"), (-F.abs(o["y"] - e["y"])).alias("level"))))

    best = F.array_max(F.transform("c", partner)).alias("best")
    rows = crops.select("frame", "side", best)
    share = lambda c, name: F.round(F.coalesce(c / F.col("side"), F.lit(0.0)), 6).alias(name)
    return rows.select("frame", F.col("best").isNotNull().alias("ok"), share(F.col("best.dx"), "dx"), share(-F.col("best.level"), "dy"))


def eyes_aligned(n: Column, spread: Column, height: Column) -> Column:
    """Two or three eyes within .30 of the crop's height, or one within .08; more are a pattern. Fixed values."""
    return F.when(n == 1, spread <= 0.08 * height).otherwise((n >= 2) & (n <= 3) & (spread <= 0.30 * height))


def gradient_cells(pixels: DataFrame, cell: int = 8, bins: int = 9) -> DataFrame:
    """``frame``, ``cx``, ``cy``, ``bin``, ``weight``: gradients dealt to the two nearest of ``bins`` directions of half a turn."""
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    step = lambda w: F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v"))
    grad = pixels.select("frame", F.expr(f"cast(x div {cell} as int)").alias("cx"), F.expr(f"cast(y div {cell} as int)").alias("cy"), step(row).alias("gx"), step(column).alias("gy"))
    grad = grad.withColumn("size", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).where("size >= 1e-3")
    angle = F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double")))
    grad = grad.withColumn("at", F.when(angle < 0, angle + 180).otherwise(angle) * bins / 180)
    part = F.col("at") - F.floor("at")
    two = F.array(F.struct((F.floor("at") % bins).alias("bin"), (1 - part).alias("part")), F.struct(((F.floor("at") + 1) % bins).alias("bin"), part.alias("part")))
    dealt = grad.select("frame", "cx", "cy", "size", F.explode(two).alias("t"))
    return dealt.groupBy("frame", "cx", "cy", F.col("t.bin").cast("int").alias("bin")).agg(F.sum(F.col("size") * F.col("t.part")).alias("weight"))


def gradient_blocks(cells: DataFrame, columns: int, rows: int) -> DataFrame:
    """``frame``, ``bx``, ``by``, ``cell`` (0-3), ``bin``, ``value``: blocks of two by two cells, scaled to length 1, cut at .2, scaled again."""
    corners = F.filter(F.array(*(F.struct((F.col("cx") - i).alias("bx"), (F.col("cy") - j).alias("by"), F.lit(2 * j + i).alias("cell")) for j in (0, 1) for i in (0, 1))), lambda b: b["bx"].between(0, columns - 2) & b["by"].between(0, rows - 2))
    dealt = cells.select("frame", "bin", "weight", F.explode(corners).alias("b")).select("frame", "bin", "weight", "b.*")
    block = Window.partitionBy("frame", "bx", "by")
    once = dealt.withColumn("cut", F.least(F.lit(0.2), F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(block) + 1e-3)))
    return once.select("frame", "bx", "by", "cell", "bin", (F.col("cut") / F.sqrt(F.sum(F.col("cut") * F.col("cut")).over(block) + 1e-3)).alias("value"))
