"""Queries on scans, resampling, outlines, writers' records and the convolution layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import compare, haar, networks, sliding
from ..operators import pixels as p
from ..sources import images, scans, sinks
from .box_queries import BOXES_SQL, boxes
from .haar_queries import tiled, tiled_sql
from .tables import new_path
from .pixel_queries import DOMINANCE_SQL, PIXELS_SQL, RGB_SQL, pixels, rgb


def synthetic_scan(spark, sf_dir):
    """Mean, least and largest value of every generated frame, as many as there are suppliers, from the data source of generated frames."""
    scans.register(spark)
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gray = [np.frombuffer(g, dtype=np.uint8) for g in batch["gray"]]
            yield pd.DataFrame({"frame": batch["frame"], "timestamp_ms": batch["timestamp_ms"], "mean": [g.mean() for g in gray], "low": [int(g.min()) for g in gray], "high": [int(g.max()) for g in gray]})

    frames = spark.read.format("generated_frames").option("address", f"test://n={n}").load()
    return frames.mapInPandas(look, "frame long, timestamp_ms long, mean double, low int, high int").withColumn("mean", F.round("mean", 6))


SYNTHETIC_SQL = """SELECT frame, frame * 33 AS timestamp_ms, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM (
SELECT i // 76800 AS frame, CAST(least(255, greatest(0, floor(CAST(sin(CAST(i % 320 + i // 320 % 240 AS FLOAT) * CAST(0.02 AS FLOAT) + CAST(i // 76800 AS FLOAT) * CAST(0.1 AS FLOAT)) AS FLOAT) * CAST(127 AS FLOAT) + CAST(128 AS FLOAT)))) AS INT) AS v FROM range((SELECT count(*) FROM supplier) * 76800) r(i)) GROUP BY 1, 2"""


def resize_bilinear(spark, sf_dir):
    """Frames of 8 by 8 at 5 by 5: each output pixel looks up its four neighbours, edges repeat."""
    return p.resize_bilinear(pixels(spark, sf_dir), 8, 8, 5, 5)


BILINEAR_SQL = f"""WITH {PIXELS_SQL}, o AS (SELECT CAST(i AS INT) AS o, greatest(0, (i + CAST(0.5 AS DOUBLE)) * 8 / 5 - 0.5) AS spot FROM range(5) r(i)), t AS (SELECT o, CAST(floor(spot) AS INT) AS a, least(CAST(floor(spot) AS INT) + 1, 7) AS b, spot - floor(spot) AS t FROM o),
rows AS (SELECT frame, y, list(v ORDER BY x) AS vs FROM pixels GROUP BY frame, y), across AS MATERIALIZED (SELECT frame, y, o AS x, vs[a + 1] * (1 - t) + vs[b + 1] * t AS v FROM rows CROSS JOIN t),
columns AS (SELECT frame, x, list(v ORDER BY y) AS vs FROM across GROUP BY frame, x) SELECT frame, x, o AS y, CAST(floor(round(vs[a + 1] * (1 - t) + vs[b + 1] * t, 6) + 0.5) AS INT) AS v FROM columns CROSS JOIN t"""

#: Weights of the gradient detector from a rule.
GRADIENT_WEIGHTS = (np.arange(3780) * 7919 % 17 - 8) / 100.0
KERNEL = [[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]]


def conv_layer(spark, sf_dir):
    """A convolution without padding, negative sums as 0, then the largest of two by two."""
    return networks.max_pool(networks.convolve(pixels(spark, sf_dir), KERNEL, 8, 8), 6, 6)


_KERNEL = ", ".join(str((i, j, k)) for j, row in enumerate(KERNEL) for i, k in enumerate(row))
CONV_SQL = f"""WITH {PIXELS_SQL}, kernel(dx, dy, k) AS (VALUES {_KERNEL}), c AS (SELECT frame, x-dx AS x, y-dy AS y, greatest(sum(CAST(v*k AS DOUBLE)), 0) AS v FROM pixels CROSS JOIN kernel WHERE x-dx BETWEEN 0 AND 5 AND y-dy BETWEEN 0 AND 5 GROUP BY 1, 2, 3)
SELECT frame, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, max(v) AS v FROM c GROUP BY 1, 2, 3"""


def cnn_detect(spark, sf_dir):
    """The classifier on frames of 64 vectors; a packed frame at a time."""
    return networks.classify(haar.pack(tiled(spark, sf_dir), 64, 64), least=0.0)


def draw_outline(spark, sf_dir):
    """Pixels of the frames of 8 by 8 under the outline of a box at (frame mod 3, 1) of 4 by 4; far edges lie just outside, their corner stays."""
    x, y, left = F.col("x"), F.col("y"), (F.col("frame") % 3).cast("int")
    across, down = x.between(left, left + 3), y.between(1, 4)
    edge = (across & y.isin(1, 5)) | (down & ((x == left) | (x == left + 4)))
    pick = lambda c, colour: F.when(edge, colour).otherwise(F.col(c)).alias(c)
    return rgb(spark, sf_dir).select("frame", "x", "y", pick("r", 255), pick("g", 64), pick("b", 64))


_EDGE = "(x BETWEEN frame%3 AND frame%3+3 AND y IN (1, 5)) OR (y BETWEEN 1 AND 4 AND (x = frame%3 OR x = frame%3+4))"
OUTLINE_SQL = f"WITH {RGB_SQL} SELECT frame, x, y, CASE WHEN {_EDGE} THEN 255 ELSE r END AS r, CASE WHEN {_EDGE} THEN 64 ELSE g END AS g, CASE WHEN {_EDGE} THEN 64 ELSE b END AS b FROM rgb"


TILTED = ((0, 0, 8, 8), (1, 2, 6, 7), (2, 1, 7, 4), (3, 3, 5, 8))


def tilted_rect_sum(spark, sf_dir):
    """Diamond sums of each frame from the diagonal table."""
    base = pixels(spark, sf_dir)
    spots = F.array(*(F.struct(F.lit(n).alias("rect"), *(F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), r, strict=True))) for n, r in enumerate(TILTED)))
    rects = base.select("frame").distinct().select("frame", F.explode(spots).alias("r")).select("frame", "r.*")
    return p.tilted_sums(p.diagonal(base), rects)


TILTED_SQL = f"""WITH {PIXELS_SQL}, rects(rect, x1, y1, x2, y2) AS (VALUES {", ".join(str((n, *r)) for n, r in enumerate(TILTED))}), m AS (SELECT *, (x1+x2)//2 AS xm, (y1+y2)//2 AS ym FROM rects),
c AS (SELECT rect, unnest([{{'x': xm, 'y': y1, 'k': 1}}, {{'x': x1, 'y': y1, 'k': -1}}, {{'x': xm, 'y': ym, 'k': -2}}, {{'x': x1, 'y': ym, 'k': 1}}, {{'x': x2, 'y': ym, 'k': 1}}, {{'x': x2, 'y': y2, 'k': -1}}, {{'x': xm, 'y': y2, 'k': 1}}]) AS c FROM m)
SELECT frame, rect, CAST(sum(v * c.k) AS BIGINT) AS s FROM pixels JOIN c ON x - y = c.x - c.y AND x < c.x GROUP BY frame, rect"""


def diagonal_edges(spark, sf_dir):
    """Responses of the tilted edge feature in the windows of 4 of each frame of 8 by 8, a window every two pixels."""
    base = pixels(spark, sf_dir)
    spots = F.array(*(F.struct(F.lit(3 * j + i).alias("window"), F.lit(2 * i).alias("x"), F.lit(2 * j).alias("y")) for j in range(3) for i in range(3)))
    windows = base.select("frame").distinct().select("frame", F.explode(spots).alias("w")).select("frame", "w.*")
    rects = sliding.diagonal_edge_rects(windows, 4, 8, 8)
    sums = p.tilted_sums(p.diagonal(base), rects).join(rects.select("frame", "rect", "weight"), ["frame", "rect"])
    return sums.groupBy("frame", F.expr("cast(rect div 2 as int)").alias("window")).agg(F.sum(F.col("s") * F.col("weight")).alias("value"))


DIAGONAL_EDGE_SQL = f"""WITH {PIXELS_SQL}, w AS (SELECT CAST(3*j+i AS INT) AS win, 2*i AS x, 2*j AS y FROM range(3) a(i), range(3) b(j)), rects AS (SELECT win, x AS x1, y + 2*h AS y1, x + 4 AS x2, y + 2*h + 2 AS y2, 1 - 2*h AS sign FROM w, range(2) c(h)), m AS (SELECT *, (x1+x2)//2 AS xm, (y1+y2)//2 AS ym FROM rects),
c AS (SELECT win, sign, unnest([{{'x': xm, 'y': y1, 'k': 1}}, {{'x': x1, 'y': y1, 'k': -1}}, {{'x': xm, 'y': ym, 'k': -2}}, {{'x': x1, 'y': ym, 'k': 1}}, {{'x': x2, 'y': ym, 'k': 1}}, {{'x': x2, 'y': y2, 'k': -1}}, {{'x': xm, 'y': y2, 'k': 1}}]) AS c FROM m)
SELECT f.frame AS frame, win AS "window", CAST(coalesce(sum(v * c.k * sign), 0) AS BIGINT) AS value FROM (SELECT DISTINCT frame FROM pixels) f CROSS JOIN c LEFT JOIN pixels p ON p.frame = f.frame AND p.x - p.y = c.x - c.y AND p.x < c.x AND p.y < c.y GROUP BY f.frame, win"""


def gradient_detect(spark, sf_dir):
    """The gradient detector on frames of 256 vectors, with weights from a rule."""
    return sliding.detect_gradients(haar.pack(tiled(spark, sf_dir, 16), 128, 128), GRADIENT_WEIGHTS)


def compare_detectors(spark, sf_dir):
    """Boxes of every detector on frames of 64 vectors, by a lateral join; two that have no weights give their reason."""
    return compare.detections(haar.pack(tiled(spark, sf_dir), 64, 64)).drop("elapsed_ms")


def drawn_boxes(spark, sf_dir):
    """Frames of 64 vectors as colours, with the outline of a box that each vector's id and label give."""
    gray = tiled(spark, sf_dir)
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null")
    boxes_ = vec.select(F.expr("vec_id div 64").alias("frame"), (F.col("vec_id") * 7 % 70).alias("x"), (F.col("vec_id") * 5 % 66).alias("y"), (F.col("label") + 6).alias("w"), (F.col("label") + 5).alias("h"))
    return p.draw_rects(gray.select("frame", "x", "y", *(F.col("v").alias(c) for c in "rgb")), boxes_, 64, 64)


DRAWN_SQL = f"""WITH {tiled_sql()}, b AS (SELECT vec_id // 64 AS frame, vec_id * 7 % 70 AS x, vec_id * 5 % 66 AS y, label + 6 AS w, label + 5 AS h FROM embeddings WHERE label IS NOT NULL),
e AS (SELECT frame, x + i AS x, unnest([y, y + h]) AS y FROM b, range(20) r(i) WHERE i < w UNION SELECT frame, unnest([x, x + w]), y + i FROM b, range(20) r(i) WHERE i < h)
SELECT l0.frame AS frame, l0.x AS x, l0.y AS y, CASE WHEN e.x IS NULL THEN v ELSE 255 END AS r, CASE WHEN e.x IS NULL THEN v ELSE 64 END AS g, CASE WHEN e.x IS NULL THEN v ELSE 64 END AS b FROM l0 LEFT JOIN e ON e.frame = l0.frame AND e.x = l0.x AND e.y = l0.y"""


def annotated_files(spark, sf_dir):
    """The pixels of :func:`drawn_boxes` read back from PNG files: frames are packed, outlined, written, one file each, listed and decoded."""
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null")
    boxes_ = vec.select(F.expr("vec_id div 64").alias("frame"), (F.col("vec_id") * 7 % 70).alias("x"), (F.col("vec_id") * 5 % 66).alias("y"), (F.col("label") + 6).alias("w"), (F.col("label") + 5).alias("h"))
    packed = haar.pack(tiled(spark, sf_dir), 64, 64).select("frame", "width", "height", F.lit(1).alias("channels"), F.col("gray").alias("pixels"))
    path = new_path(spark, "annotated")
    sinks.write_files(sinks.annotated(packed, boxes_), path)
    back = images.sequence(spark, path).select(F.regexp_extract("path", r"frame_(\d+)\.png$", 1).cast("long").alias("frame"), "width", "height", "pixels")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                at = np.arange(r.width * r.height)
                rgb_ = np.frombuffer(r.pixels, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
                yield pd.DataFrame({"frame": r.frame, "x": (at % r.width).astype(np.int32), "y": (at // r.width).astype(np.int32), "r": rgb_[:, 0], "g": rgb_[:, 1], "b": rgb_[:, 2]})

    return back.mapInPandas(spread, "frame long, x int, y int, r int, g int, b int")


def manifest_rows(spark, sf_dir):
    """A record for each frame, as the manifest's writer puts it: boxes in rank order, confidence to four places."""
    box = F.concat(F.lit("["), F.concat_ws(",", "x", "y", "w", "h", F.format_string("%.4f", F.col("score").cast("double"))), F.lit("]"))
    rows = boxes(spark, sf_dir).select("frame", F.struct("rank", box.alias("box")).alias("b"))
    gathered = rows.groupBy("frame").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return gathered.select("frame", F.concat(F.lit("["), F.array_join(F.transform("b", lambda b: b["box"]), ","), F.lit("]")).alias("record"))


MANIFEST_SQL = f"WITH {BOXES_SQL} SELECT frame, '[' || string_agg('[' || x || ',' || y || ',' || w || ',' || h || ',' || printf('%.4f', CAST(score AS DOUBLE)) || ']', ',' ORDER BY rank) || ']' AS record FROM boxes GROUP BY frame"


def skin_ratio(spark, sf_dir):
    """Shares of a frame's pixels within the loose and the tight range of skin colours."""
    base = rgb(spark, sf_dir)
    colours = base.select("frame", *(c.alias(k) for k, c in p.hsv(F.col("r"), F.col("g"), F.col("b")).items()))
    loose = ((F.col("h") <= 25) | (F.col("h") >= 165)) & F.col("s").between(40, 180) & (F.col("v") >= 60)
    share = lambda c, name: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(name)
    return colours.groupBy("frame").agg(share(loose, "loose"), share(p.bands()["skin"], "tight"))


SKIN_SQL = DOMINANCE_SQL.partition(",\na AS (")[0] + """ SELECT frame, round(avg(CASE WHEN (h<=25 OR h>=165) AND s BETWEEN 40 AND 180 AND v >= 60 THEN 1.0 ELSE 0.0 END), 6) AS loose,
round(avg(CASE WHEN (h<=20 OR h>=160) AND s BETWEEN 50 AND 170 AND v BETWEEN 80 AND 235 THEN 1.0 ELSE 0.0 END), 6) AS tight FROM t GROUP BY frame"""


def crop_cap(spark, sf_dir):
    """Boxes whose place in the order of frames and ranks is within a job's cap on crops, 2000 (a fixed value); a nation's orders are a job."""
    from pyspark.sql import Window

    o, c = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    jobs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("frame"), F.col("c_nationkey").alias("job"))
    numbered = boxes(spark, sf_dir).join(jobs, "frame").select("job", "frame", "rank").withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy("frame", "rank")))
    return numbered.where("place <= 2000")  # cut before the shuffle, too


CAP_SQL = f"WITH {BOXES_SQL}, n AS (SELECT c_nationkey AS job, frame, rank, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY frame, rank) AS INT) AS place FROM boxes JOIN orders ON o_orderkey = frame JOIN customer ON c_custkey = o_custkey) SELECT * FROM n WHERE place <= 2000"

QUERIES = {
    "synthetic_scan": (synthetic_scan, SYNTHETIC_SQL), "resize_bilinear": (resize_bilinear, BILINEAR_SQL), "conv_layer": (conv_layer, CONV_SQL), "cnn_detect": (cnn_detect, None), "draw_outline": (draw_outline, OUTLINE_SQL),
    "tilted_rect_sum": (tilted_rect_sum, TILTED_SQL), "diagonal_edges": (diagonal_edges, DIAGONAL_EDGE_SQL), "gradient_detect": (gradient_detect, None), "compare_detectors": (compare_detectors, None), "drawn_boxes": (drawn_boxes, DRAWN_SQL), "annotated_files": (annotated_files, DRAWN_SQL), "manifest_rows": (manifest_rows, MANIFEST_SQL), "skin_ratio": (skin_ratio, SKIN_SQL), "crop_cap": (crop_cap, CAP_SQL),
}
