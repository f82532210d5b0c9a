"""Operators on pixels as rows (``frame``, ``x``, ``y``, ``v``): histograms, prefix tables, resampling, hashes, colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialise
from .components import connected_components


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def video_gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def histogram(pixels: DataFrame) -> DataFrame:
    """``n``, ``cdf`` and the frame's ``total`` for every value that occurs; 256 rows a frame at most."""
    by_frame = Window.partitionBy("frame")
    counts = pixels.groupBy("frame", "v").agg(F.count("*").alias("n"))
    return counts.select("frame", "v", "n", F.sum("n").over(by_frame.orderBy("v")).alias("cdf"), F.sum("n").over(by_frame).alias("total"))


def equalize(pixels: DataFrame) -> DataFrame:
    """Values through the rounded, cumulative table of their frame; a frame of one value stays."""
    table = histogram(pixels).withColumn("least", F.min("cdf").over(Window.partitionBy("frame")))
    den = F.col("total") - F.col("least")
    even = F.floor(((F.col("cdf") - F.col("least")) * 255 + F.floor(den / 2)) / F.nullif(den, F.lit(0)))
    table = table.select("frame", "v", F.coalesce(even, F.col("v")).cast("int").alias("equal"))
    return pixels.join(table, ["frame", "v"]).select("frame", "x", "y", F.col("equal").alias("v"))


def stretch(pixels: DataFrame, share: float = 0.01) -> DataFrame:
    """Contrast between the first values at which ``share`` of the pixels lie at or below, and at or above."""
    h = histogram(pixels).withColumn("above", F.col("total") - F.col("cdf") + F.col("n"))
    ends = h.groupBy("frame").agg(F.min(F.when(F.col("cdf") >= F.col("total") * share, F.col("v"))).alias("lo"), F.max(F.when(F.col("above") >= F.col("total") * share, F.col("v"))).alias("hi"))
    scaled = F.floor((F.least(F.greatest("v", "lo"), F.col("hi")) - F.col("lo")) * 255 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))
    return pixels.join(ends, "frame").select("frame", "x", "y", F.coalesce(scaled, F.col("v")).cast("int").alias("v"))


def stretch_as_published(pixels: DataFrame) -> DataFrame:
    """The stretch as the tool to be matched has it: the upper end is counted from the top to all but a hundredth of the pixels, so
    it is the value that nearly all are at or above. Where it is not above the lower end, the frame stays."""
    share = F.expr("total div 100")
    h = histogram(pixels).withColumn("above", F.col("total") - F.col("cdf") + F.col("n"))
    lo = F.when(F.first(share) == 0, 0).otherwise(F.min(F.when(F.col("cdf") >= share, F.col("v"))))  # nothing to reach: the first value, 0
    ends = h.groupBy("frame").agg(lo.alias("lo"), F.max(F.when(F.col("above") >= F.col("total") - share, F.col("v"))).alias("hi"))
    single = ((F.col("v") - F.col("lo")).cast("float") / (F.col("hi") - F.col("lo")).cast("float")).cast("float") * F.lit(255.0).cast("float")
    value = F.when(F.col("hi") <= F.col("lo"), F.col("v")).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), single.cast("double")))).cast("int"))
    return pixels.join(ends, "frame").select("frame", "x", "y", value.alias("v"))


def draw_rects(colours: DataFrame, boxes: DataFrame, width: int, height: int, colour: tuple[int, int, int] = (255, 64, 64)) -> DataFrame:
    """``frame``, ``x``, ``y``, ``r``, ``g``, ``b`` with the outline of every box (``frame``, ``x``, ``y``, ``w``, ``h``): ``w`` pixels from its corner along the upper edge
    and along the row just below it, ``h`` along the left edge and the column just right of it; what lies outside the frame is cut.

    A box is dealt to the pixels of its outline, and a frame's are made one before the join, so it does not matter how many boxes lie on a pixel.
    """
    along = lambda n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: i)
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    across = F.flatten(F.transform(along("w"), lambda i: F.array(at(x + i, y), at(x + i, y + h))))
    down = F.flatten(F.transform(along("h"), lambda j: F.array(at(x, y + j), at(x + w, y + j))))
    edge = boxes.where("w > 0 and h > 0").select("frame", F.explode(F.concat(across, down)).alias("p")).select("frame", "p.x", "p.y")
    edge = edge.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct().withColumn("drawn", F.lit(True))
    pick = lambda c, v: F.when(F.col("drawn"), v).otherwise(F.col(c)).cast("int").alias(c)
    return colours.join(edge, ["frame", "x", "y"], "left").select("frame", "x", "y", *(pick(c, v) for c, v in zip("rgb", colour, strict=True)))


def integral(pixels: DataFrame) -> DataFrame:
    """``ii`` and ``ii2``: sums of values and squares over the rectangle from the origin to the pixel, itself included."""
    row = Window.partitionBy("frame", "y").orderBy("x")
    column = Window.partitionBy("frame", "x").orderBy("y")
    rows = pixels.select("frame", "x", "y", F.sum(F.col("v").cast("bigint")).over(row).alias("s"), F.sum(F.col("v").cast("bigint") * F.col("v")).over(row).alias("s2"))
    return rows.select("frame", "x", "y", F.sum("s").over(column).alias("ii"), F.sum("s2").over(column).alias("ii2"))


def diagonal(pixels: DataFrame) -> DataFrame:
    """``d``: the sum of the values up and to the left on the pixel's diagonal, itself included."""
    along = Window.partitionBy("frame", F.col("x") - F.col("y")).orderBy("x")
    return pixels.select("frame", "x", "y", F.sum(F.col("v").cast("bigint")).over(along).alias("d"))


def rect_sums(table: DataFrame, rects: DataFrame) -> DataFrame:
    """``s`` and ``s2`` of rectangles (``frame``, ``rect``, ``x0``, ``y0``, ``x1``, ``y1``, ends exclusive) from four corners."""
    corner = F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.lit(k).alias("k")) for a, b, k in (("x1", "y1", 1), ("x0", "y1", -1), ("x1", "y0", -1), ("x0", "y0", 1))))
    corners = rects.select("frame", "rect", F.explode(corner).alias("c")).select("frame", "rect", (F.col("c.x") - 1).alias("x"), (F.col("c.y") - 1).alias("y"), "c.k")
    found = corners.join(table, ["frame", "x", "y"], "left").groupBy("frame", "rect")
    total = lambda c: F.coalesce(F.sum(F.col("k") * F.col(c)), F.lit(0)).cast("bigint")
    return found.agg(total("ii").alias("s"), total("ii2").alias("s2"))


def tilted_sums(table: DataFrame, rects: DataFrame) -> DataFrame:
    """``s`` of rectangles turned by 45 degrees (``frame``, ``rect``, ``x1``, ``y1``, ``x2``, ``y2``): seven places of :func:`diagonal`.

    The middle counts for the upper and the lower triangle; a place on the frame's upper or left edge has no sum.
    """
    xm, ym = F.expr("(x1 + x2) div 2"), F.expr("(y1 + y2) div 2")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    spots = ((xm, y1, 1), (x1, y1, -1), (xm, ym, -2), (x1, ym, 1), (x2, ym, 1), (x2, y2, -1), (xm, y2, 1))
    asked = F.array(*(F.struct((x - 1).cast("int").alias("x"), (y - 1).cast("int").alias("y"), F.lit(k).alias("k")) for x, y, k in spots))
    places = rects.select("frame", "rect", F.explode(asked).alias("c")).select("frame", "rect", "c.*")
    return places.join(table, ["frame", "x", "y"], "left").groupBy("frame", "rect").agg(F.coalesce(F.sum(F.col("k") * F.col("d")), F.lit(0)).cast("bigint").alias("s"))


def passes_variance(s: Column, s2: Column, n: int, threshold: int) -> Column:
    return s2 * n >= s * s + threshold * n * n


def downscale(pixels: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """Whole-number means of boxes of ``k`` by ``k`` pixels; what does not fill a box is left out."""
    whole = pixels.where((F.col("x") < width // k * k) & (F.col("y") < height // k * k))
    mean = F.floor(F.sum("v") / (k * k)).cast("int").alias("v")
    return whole.groupBy("frame", F.floor(F.col("x") / k).cast("int").alias("x"), F.floor(F.col("y") / k).cast("int").alias("y")).agg(mean)


def resize_area(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Means weighted by how much of a pixel a cell of the smaller grid covers; a pixel meets few cells."""

    def cells(c: str, size: int, to: int) -> Column:
        first, last = F.floor(F.col(c) * to / size), F.ceil((F.col(c) + 1) * to / size) - 1
        cover = lambda i: F.least(F.col(c) + 1.0, (i + 1.0) * size / to) - F.greatest(F.col(c) * 1.0, i * size / to)
        return F.transform(F.sequence(first, last), lambda i: F.struct(i.cast("int").alias("at"), cover(i).alias("part")))

    spread = pixels.select("frame", "v", F.explode(cells("x", width, to_width)).alias("cx"), "y").select("frame", "v", "cx", F.explode(cells("y", height, to_height)).alias("cy"))
    part = F.col("cx.part") * F.col("cy.part")
    return spread.where(part > 1e-9).groupBy("frame", F.col("cx.at").alias("x"), F.col("cy.at").alias("y")).agg(F.floor(F.round(F.sum(part * F.col("v")) / F.sum(part), 6) + 0.5).cast("int").alias("v"))


def resize_bilinear(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Each pixel is dealt to the output pixels that look it up, with its weight; edges repeat."""

    def uses(c: str, size: int, to: int) -> Column:
        places = []
        for i in range(to):
            at = max(0.0, (i + 0.5) * size / to - 0.5)
            low = min(int(at), size - 1)
            places += [(i, low, 1 - (at - low)), (i, min(low + 1, size - 1), at - low)]
        table = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(p).alias("p"), F.lit(float(w)).alias("w")) for o, p, w in places))
        return F.filter(table, lambda u: u["p"] == F.col(c))

    dealt = pixels.select("frame", "v", "y", F.explode(uses("x", width, to_width)).alias("ux")).select("frame", "v", "ux", F.explode(uses("y", height, to_height)).alias("uy"))
    value = F.floor(F.round(F.sum(F.col("v") * F.col("ux.w") * F.col("uy.w")), 6) + 0.5).cast("int")
    return dealt.groupBy("frame", F.col("ux.o").alias("x"), F.col("uy.o").alias("y")).agg(value.alias("v"))


def average_hash(pixels: DataFrame, side: int = 8) -> DataFrame:
    """``hash`` bigint: a bit for every pixel above its frame's mean, the first pixel highest; 64 pixels a frame."""
    rows = pixels.withColumn("mean", F.avg("v").over(Window.partitionBy("frame")))
    bit = F.when(F.col("v") > F.col("mean"), F.expr(f"shiftleft(1L, {side * side - 1} - cast(y * {side} + x as int))")).otherwise(F.lit(0).cast("bigint"))
    return rows.groupBy("frame").agg(F.bit_or(bit).alias("hash"))


def gradient_hash(pixels: DataFrame, side: int = 8) -> DataFrame:
    """``hash`` bigint: a bit for every pixel whose right neighbour is brighter."""
    right = F.lead("v").over(Window.partitionBy("frame", "y").orderBy("x"))
    rows = pixels.withColumn("up", right > F.col("v"))
    bit = F.when(F.col("up"), F.expr(f"shiftleft(1L, {side * side - 1} - cast(y * {side} + x as int))")).otherwise(F.lit(0).cast("bigint"))
    return rows.groupBy("frame").agg(F.bit_or(bit).alias("hash"))


def hamming_pairs(hashes: DataFrame, most: int = 10) -> DataFrame:
    """``a``, ``b``, ``distance`` of all pairs of hashes that differ in at most ``most`` of 64 bits.

    The bits are dealt into ``most + 1`` bands; such a pair agrees in one band at least, so an equality join on bands meets
    every pair and no other scan of pairs is needed.
    """
    bands = most + 1
    edges = [i * 64 // bands for i in range(bands + 1)]
    parts = F.array(*(F.expr(f"shiftrightunsigned(hash, {a}) & {(1 << (b - a)) - 1}L") for a, b in zip(edges, edges[1:], strict=False)))
    dealt = hashes.select("frame", "hash", F.posexplode(parts).alias("band", "part"))
    left, right = dealt.select(F.col("frame").alias("a"), F.col("hash").alias("ha"), "band", "part"), dealt.select(F.col("frame").alias("b"), F.col("hash").alias("hb"), "band", "part")
    met = left.join(right, ["band", "part"]).where("a < b").withColumn("distance", F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))))
    return met.where(F.col("distance") <= most).select("a", "b", F.col("distance").cast("int").alias("distance")).distinct()


def hash_clusters(hashes: DataFrame, most: int = 10) -> DataFrame:
    """``frame`` and ``cluster`` (its smallest frame) of every frame; frames are linked when their hashes are close."""
    found = connected_components(materialise(hamming_pairs(hashes, most), "pairs"))
    return hashes.select("frame").join(found.select(F.col("node").alias("frame"), "component"), "frame", "left").select("frame", F.coalesce("component", "frame").alias("cluster"))


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue 0-179, saturation and value 0-255, rounded."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif((top - low).cast("double"), F.lit(0.0))
    hue = F.coalesce(F.when(top == r, 60.0 * (g - b) / span).when(top == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span), F.lit(0.0))
    hue = F.floor(F.when(hue < 0, hue + 360.0).otherwise(hue) / 2.0 + 0.5)
    return {"h": F.when(hue == 180, 0).otherwise(hue).cast("int"), "s": F.coalesce(F.floor((top - low) * 255.0 / F.nullif(top.cast("double"), F.lit(0.0)) + 0.5), F.lit(0)).cast("int"), "v": top.cast("int")}


def between(c: str, low: int, high: int) -> Column:
    return F.col(c).between(low, high)


def bands() -> dict[str, Column]:
    """Fixed ranges of the colour bands."""
    return {
        "skin": ((F.col("h") <= 20) | (F.col("h") >= 160)) & between("s", 50, 170) & between("v", 80, 235),
        "red_curtain": ((F.col("h") <= 10) | (F.col("h") >= 170)) & (F.col("s") >= 130) & between("v", 80, 200),
        "blue_fabric": between("h", 95, 130) & (F.col("s") >= 80) & between("v", 60, 180),
        "green_bg": between("h", 35, 80) & (F.col("s") >= 80) & between("v", 60, 200),
    }


def dominance(colours: DataFrame, least: float = 0.4) -> DataFrame:
    """``label`` and ``top``: the band with the largest share of a frame's pixels, neutral below ``least``; the first of equals."""
    shares = colours.groupBy("frame").agg(*(F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n, c in bands().items()))
    top = F.greatest(*bands())
    label = F.lit("neutral")
    for name in reversed(bands()):
        label = F.when(F.col(name) == top, name).otherwise(label)
    return shares.select("frame", F.when(top < least, "neutral").otherwise(label).alias("label"), top.alias("top"), F.col("skin").alias("skin_ratio"))
