"""Queries on pixels: every vector of ``embeddings`` is an image of 8 by 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels as p

PIXELS_SQL = """pixels AS (SELECT vec_id AS frame, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5))) AS INT) AS v
FROM embeddings, range(64) r(i))"""
RGB_SQL = PIXELS_SQL + """, rgb AS (SELECT frame, x, y, v AS r, lead(v, 1, v) OVER w AS g, lead(v, 2, v) OVER w AS b FROM pixels WINDOW w AS (PARTITION BY frame ORDER BY y, x))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1) * 127.5))).cast("int")
    return e.select("frame", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), v.alias("v"))


def rgb(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("frame").orderBy("y", "x")
    return pixels(spark, sf_dir).select("frame", "x", "y", F.col("v").alias("r"), F.coalesce(F.lead("v", 1).over(w), F.col("v")).alias("g"), F.coalesce(F.lead("v", 2).over(w), F.col("v")).alias("b"))


def to_gray(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return rgb(spark, sf_dir).select("frame", "x", "y", p.gray(r, g, b).alias("gray"), p.video_gray(r, g, b).alias("video_gray"))


GRAY_SQL = f"WITH {RGB_SQL} SELECT frame, x, y, (77*r+150*g+29*b) >> 8 AS gray, (299*r+587*g+114*b+500)//1000 AS video_gray FROM rgb"


def pixel_stats(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("frame").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("stddev"))


STATS_SQL = f"WITH {PIXELS_SQL} SELECT frame, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM pixels GROUP BY frame"


def hist_cdf(spark, sf_dir):
    return p.histogram(pixels(spark, sf_dir)).select("frame", "v", "n", "cdf")


_HIST = "hist AS (SELECT frame, v, count(*) AS n FROM pixels GROUP BY frame, v), cdf AS (SELECT frame, v, n, CAST(sum(n) OVER (PARTITION BY frame ORDER BY v) AS BIGINT) AS cdf, CAST(sum(n) OVER (PARTITION BY frame) AS BIGINT) AS total FROM hist)"
HIST_SQL = f"WITH {PIXELS_SQL}, {_HIST} SELECT frame, v, n, cdf FROM cdf"


def equalize_hist(spark, sf_dir):
    return p.equalize(pixels(spark, sf_dir))


EQUALIZE_SQL = f"""WITH {PIXELS_SQL}, {_HIST}, t AS (SELECT frame, v, cdf, min(cdf) OVER (PARTITION BY frame) AS least, total FROM cdf)
SELECT frame, x, y, CAST(CASE WHEN total = least THEN v ELSE ((cdf-least)*255 + (total-least)//2)//(total-least) END AS INT) AS v FROM pixels JOIN t USING (frame, v)"""


def normalize_contrast(spark, sf_dir):
    return p.stretch(pixels(spark, sf_dir))


CONTRAST_SQL = f"""WITH {PIXELS_SQL}, {_HIST}, e AS (SELECT frame, min(v) FILTER (cdf >= total*0.01) AS lo, max(v) FILTER (total-cdf+n >= total*0.01) AS hi FROM cdf GROUP BY frame)
SELECT frame, x, y, CASE WHEN hi = lo THEN v ELSE CAST(floor((least(greatest(v,lo),hi)-lo)*255/(hi-lo)) AS INT) END AS v FROM pixels JOIN e USING (frame)"""


def contrast_as_published(spark, sf_dir):
    return p.stretch_as_published(pixels(spark, sf_dir))


PUBLISHED_SQL = f"""WITH {PIXELS_SQL}, {_HIST}, e AS (SELECT frame, CASE WHEN any_value(total) // 100 = 0 THEN 0 ELSE min(v) FILTER (cdf >= total // 100) END AS lo, max(v) FILTER (total-cdf+n >= total - total // 100) AS hi FROM cdf GROUP BY frame)
SELECT frame, x, y, CASE WHEN hi <= lo THEN v ELSE CAST(floor(greatest(0, least(255, CAST(CAST(v-lo AS FLOAT) / CAST(hi-lo AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE)))) AS INT) END AS v FROM pixels JOIN e USING (frame)"""


def downscale_box(spark, sf_dir):
    return p.downscale(pixels(spark, sf_dir), 3, 8, 8)


DOWNSCALE_SQL = f"WITH {PIXELS_SQL} SELECT frame, x//3 AS x, y//3 AS y, CAST(sum(v)//9 AS INT) AS v FROM pixels WHERE x < 6 AND y < 6 GROUP BY 1, 2, 3"


def resize_area(spark, sf_dir):
    return p.resize_area(pixels(spark, sf_dir), 8, 8, 5, 5)


RESIZE_SQL = f"""WITH {PIXELS_SQL}, c AS (SELECT CAST(i AS INT) AS i FROM range(5) r(i)),
m AS (SELECT frame, v, cx.i AS cx, cy.i AS cy, (least(x+1.0,(cx.i+1)*1.6)-greatest(x,cx.i*1.6))*(least(y+1.0,(cy.i+1)*1.6)-greatest(y,cy.i*1.6)) AS part
      FROM pixels JOIN c cx ON x+1 > cx.i*1.6 AND x < (cx.i+1)*1.6 JOIN c cy ON y+1 > cy.i*1.6 AND y < (cy.i+1)*1.6)
SELECT frame, cx AS x, cy AS y, CAST(floor(round(CAST(sum(part*v)/sum(part) AS DOUBLE), 6) + 0.5) AS INT) AS v FROM m WHERE part > 1e-9 GROUP BY 1, 2, 3"""


def integral_sum_sq(spark, sf_dir):
    return p.integral(pixels(spark, sf_dir))


INTEGRAL_SQL = f"""WITH {PIXELS_SQL}, r AS (SELECT frame, x, y, sum(v) OVER w AS s, sum(v*v) OVER w AS s2 FROM pixels WINDOW w AS (PARTITION BY frame, y ORDER BY x))
SELECT frame, x, y, CAST(sum(s) OVER c AS BIGINT) AS ii, CAST(sum(s2) OVER c AS BIGINT) AS ii2 FROM r WINDOW c AS (PARTITION BY frame, x ORDER BY y)"""


def diag_prefix(spark, sf_dir):
    return p.diagonal(pixels(spark, sf_dir))


DIAGONAL_SQL = f"WITH {PIXELS_SQL} SELECT frame, x, y, CAST(sum(v) OVER (PARTITION BY frame, x-y ORDER BY x) AS BIGINT) AS d FROM pixels"


def _rects(df: DataFrame) -> DataFrame:
    corners = F.array(*(F.struct(F.lit(n).alias("rect"), *(F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), r, strict=True))) for n, r in enumerate(RECTS)))
    return df.select("frame").distinct().select("frame", F.explode(corners).alias("r")).select("frame", "r.*")


RECTS = ((0, 0, 8, 8), (1, 1, 7, 7), (2, 0, 5, 3), (3, 3, 4, 4), (0, 4, 8, 8))


def rect_sum_corners(spark, sf_dir):
    base = pixels(spark, sf_dir)
    return p.rect_sums(p.integral(base), _rects(base))


_RECT_SQL = f"WITH {PIXELS_SQL}, rects(rect, x0, y0, x1, y1) AS (VALUES {', '.join(str((n, *r)) for n, r in enumerate(RECTS))})"
_RECT_SUM = "SELECT frame, rect, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v*v) AS BIGINT) AS s2 FROM pixels JOIN rects ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY frame, rect"
RECT_SQL = f"{_RECT_SQL} {_RECT_SUM}"


def variance_filter(spark, sf_dir):
    """Frames whose inner 6 by 6 pixels have enough variance."""
    base = pixels(spark, sf_dir)
    sums = p.rect_sums(p.integral(base), _rects(base).where("rect = 1"))
    return sums.where(p.passes_variance(F.col("s"), F.col("s2"), 36, 200)).select("frame", "s", "s2")


VARIANCE_SQL = f"{_RECT_SQL}, t AS ({_RECT_SUM}) SELECT frame, s, s2 FROM t WHERE rect = 1 AND s2*36 >= s*s + 200*36*36"


def phash_bits(spark, sf_dir):
    return p.average_hash(pixels(spark, sf_dir))


_BIT = "CASE WHEN 63-(y*8+x) = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << (63-(y*8+x)) END"
_AHASH = f"ahash AS (SELECT frame, bit_or(CASE WHEN v > mean THEN {_BIT} ELSE 0 END) AS hash FROM (SELECT *, avg(v) OVER (PARTITION BY frame) AS mean FROM pixels) GROUP BY frame)"
PHASH_SQL = f"WITH {PIXELS_SQL}, {_AHASH} SELECT frame, hash FROM ahash"


def dhash_bits(spark, sf_dir):
    return p.gradient_hash(pixels(spark, sf_dir))


DHASH_SQL = f"WITH {PIXELS_SQL} SELECT frame, bit_or(CASE WHEN nxt > v THEN {_BIT} ELSE 0 END) AS hash FROM (SELECT *, lead(v) OVER (PARTITION BY frame, y ORDER BY x) AS nxt FROM pixels) GROUP BY frame"
NEAR = 18


def hamming_pairs(spark, sf_dir):
    return p.hamming_pairs(p.average_hash(pixels(spark, sf_dir)), NEAR)


_PAIRS = f"pairs AS (SELECT p.frame AS a, q.frame AS b, CAST(bit_count(xor(p.hash, q.hash)) AS INT) AS distance FROM ahash p JOIN ahash q ON p.frame < q.frame WHERE bit_count(xor(p.hash, q.hash)) <= {NEAR})"
HAMMING_SQL = f"WITH {PIXELS_SQL}, {_AHASH}, {_PAIRS} SELECT a, b, distance FROM pairs"


def similar_components(spark, sf_dir):
    return p.hash_clusters(p.average_hash(pixels(spark, sf_dir)), NEAR)


_COMPONENTS = "edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(frame, spot) AS (SELECT frame, frame FROM ahash UNION SELECT r.frame, e.b FROM reach r JOIN edges e ON r.spot = e.a), clusters AS (SELECT frame, min(spot) AS cluster FROM reach GROUP BY frame)"
COMPONENTS_SQL = f"WITH RECURSIVE {PIXELS_SQL}, {_AHASH}, {_PAIRS}, {_COMPONENTS} SELECT frame, cluster FROM clusters"


def topk_clusters(spark, sf_dir):
    """The three largest clusters; the brightest member stands for each, of equals the first."""
    base = pixels(spark, sf_dir)
    light = base.groupBy("frame").agg(F.sum("v").alias("light"))
    found = p.hash_clusters(p.average_hash(base), NEAR).join(light, "frame").groupBy("cluster").agg(F.count("*").alias("n"), F.max(F.struct("light", (-F.col("frame")).alias("f"))).alias("m"))
    return found.orderBy(F.desc("n"), "cluster").limit(3).select("cluster", "n", (-F.col("m.f")).alias("stands"))


TOPK_SQL = f"""WITH RECURSIVE {PIXELS_SQL}, {_AHASH}, {_PAIRS}, {_COMPONENTS}, light AS (SELECT frame, sum(v) AS light FROM pixels GROUP BY frame)
SELECT cluster, count(*) AS n, -max({{'light': light, 'f': -frame}}).f AS stands FROM clusters JOIN light USING (frame) GROUP BY cluster ORDER BY n DESC, cluster LIMIT 3"""


def color_dominance(spark, sf_dir):
    base = rgb(spark, sf_dir)
    colours = base.select("frame", *(c.alias(k) for k, c in p.hsv(F.col("r"), F.col("g"), F.col("b")).items()))
    out = p.dominance(colours)
    return out.select("frame", "label", F.round("top", 6).alias("top"), F.round("skin_ratio", 6).alias("skin_ratio"))


DOMINANCE_SQL = f"""WITH {RGB_SQL}, m AS (SELECT *, greatest(r,g,b) AS v, greatest(r,g,b)-least(r,g,b) AS d FROM rgb),
u AS (SELECT frame, v, CASE WHEN v = 0 THEN 0 ELSE floor(d*255.0/v+0.5) END AS s, CASE WHEN d = 0 THEN 0.0 WHEN v = r THEN 60.0*(g-b)/d WHEN v = g THEN 120.0+60.0*(b-r)/d ELSE 240.0+60.0*(r-g)/d END AS u FROM m),
t AS (SELECT frame, s, v, CASE WHEN floor((CASE WHEN u < 0 THEN u+360.0 ELSE u END)/2.0+0.5) = 180 THEN 0 ELSE floor((CASE WHEN u < 0 THEN u+360.0 ELSE u END)/2.0+0.5) END AS h FROM u),
a AS (SELECT frame, avg(CASE WHEN (h<=20 OR h>=160) AND s BETWEEN 50 AND 170 AND v BETWEEN 80 AND 235 THEN 1.0 ELSE 0.0 END) AS skin, avg(CASE WHEN (h<=10 OR h>=170) AND s>=130 AND v BETWEEN 80 AND 200 THEN 1.0 ELSE 0.0 END) AS red_curtain,
avg(CASE WHEN h BETWEEN 95 AND 130 AND s>=80 AND v BETWEEN 60 AND 180 THEN 1.0 ELSE 0.0 END) AS blue_fabric, avg(CASE WHEN h BETWEEN 35 AND 80 AND s>=80 AND v BETWEEN 60 AND 200 THEN 1.0 ELSE 0.0 END) AS green_bg FROM t GROUP BY frame)
SELECT frame, CASE WHEN greatest(skin,red_curtain,blue_fabric,green_bg) < 0.4 THEN 'neutral' WHEN skin >= greatest(red_curtain,blue_fabric,green_bg) THEN 'skin' WHEN red_curtain >= greatest(blue_fabric,green_bg) THEN 'red_curtain' WHEN blue_fabric >= green_bg THEN 'blue_fabric' ELSE 'green_bg' END AS label,
round(greatest(skin,red_curtain,blue_fabric,green_bg), 6) AS top, round(skin, 6) AS skin_ratio FROM a"""


def hog_cells(spark, sf_dir):
    """Gradients of a cell of 8 by 8 pixels in nine directions of 20 degrees, dealt to the two nearest bins."""
    from pyspark.sql import Window

    base = pixels(spark, sf_dir)
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    step = lambda w: F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v"))
    grad = base.select("frame", step(row).alias("gx"), step(column).alias("gy")).withColumn("size", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).where("size >= 1e-3")
    angle = F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double")))
    grad = grad.withColumn("at", F.when(angle < 0, angle + 180).otherwise(angle) * 9 / 180)
    two = F.array(F.struct((F.floor("at") % 9).alias("bin"), (1 - (F.col("at") - F.floor("at"))).alias("part")), F.struct(((F.floor("at") + 1) % 9).alias("bin"), (F.col("at") - F.floor("at")).alias("part")))
    return grad.select("frame", "size", F.explode(two).alias("t")).groupBy("frame", F.col("t.bin").cast("int").alias("bin")).agg(F.round(F.sum(F.col("size") * F.col("t.part")), 4).alias("weight"))


HOG_SQL = f"""WITH {PIXELS_SQL}, gr AS (SELECT frame, coalesce(lead(v) OVER r, v)-coalesce(lag(v) OVER r, v) AS gx, coalesce(lead(v) OVER c, v)-coalesce(lag(v) OVER c, v) AS gy FROM pixels WINDOW r AS (PARTITION BY frame, y ORDER BY x), c AS (PARTITION BY frame, x ORDER BY y)),
a AS (SELECT frame, sqrt(gx*gx+gy*gy) AS size, degrees(atan2(CAST(gy AS DOUBLE), CAST(gx AS DOUBLE))) AS angle FROM gr), t AS (SELECT frame, size, (CASE WHEN angle < 0 THEN angle+180 ELSE angle END)*9/180 AS spot FROM a WHERE size >= 1e-3),
b AS (SELECT frame, CAST(floor(spot) AS INT) % 9 AS bin, size*(1-(spot-floor(spot))) AS w FROM t UNION ALL SELECT frame, (CAST(floor(spot) AS INT)+1) % 9, size*(spot-floor(spot)) FROM t) SELECT frame, bin, round(sum(w), 4) AS weight FROM b GROUP BY frame, bin"""


def svm_score(spark, sf_dir):
    """A linear score of each vector with weights (i mod 7 - 3) / 10 and bias -0.5."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    score = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * (i % 7 - 3) / 10), F.lit(-0.5), lambda a, x: a + x)
    return e.select("vec_id", F.round(score, 5).alias("score"), (score > 0).alias("face"))


SVM_SQL = "SELECT vec_id, round(score, 5) AS score, score > 0 AS face FROM (SELECT vec_id, sum(CAST(embedding[i+1] AS DOUBLE)*(i%7-3)/10) - 0.5 AS score FROM embeddings, range(64) r(i) GROUP BY vec_id)"


def anchor_decode(spark, sf_dir):
    """Boxes from the first six numbers of a vector as anchor outputs: confidence, shift, size, on a tile of 16 at (32, 48)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    o = [F.element_at("embedding", i + 1).cast("double") for i in range(6)]
    conf = 1 / (1 + F.exp(-o[4]))
    return e.select("vec_id", F.round(conf, 6).alias("conf"), F.round(32 + 8 + o[0] * 16, 4).alias("cx"), F.round(48 + 8 + o[1] * 16, 4).alias("cy"), F.round(F.exp(o[2]) * 16, 4).alias("bw"), F.round(F.exp(o[3]) * 16, 4).alias("bh")).where("conf >= 0.5")


ANCHOR_SQL = """SELECT vec_id, round(1/(1+exp(-CAST(embedding[5] AS DOUBLE))), 6) AS conf, round(40+CAST(embedding[1] AS DOUBLE)*16, 4) AS cx, round(56+CAST(embedding[2] AS DOUBLE)*16, 4) AS cy,
round(exp(CAST(embedding[3] AS DOUBLE))*16, 4) AS bw, round(exp(CAST(embedding[4] AS DOUBLE))*16, 4) AS bh FROM embeddings WHERE round(1/(1+exp(-CAST(embedding[5] AS DOUBLE))), 6) >= 0.5"""

QUERIES = {
    "contrast_as_published": (contrast_as_published, PUBLISHED_SQL),
    "gray_formulas": (to_gray, GRAY_SQL), "pixel_stats": (pixel_stats, STATS_SQL), "hist_cdf": (hist_cdf, HIST_SQL), "equalize_hist": (equalize_hist, EQUALIZE_SQL), "normalize_contrast": (normalize_contrast, CONTRAST_SQL),
    "downscale_box": (downscale_box, DOWNSCALE_SQL), "resize_area": (resize_area, RESIZE_SQL), "integral_sum_sq": (integral_sum_sq, INTEGRAL_SQL), "diag_prefix": (diag_prefix, DIAGONAL_SQL), "rect_sum_corners": (rect_sum_corners, RECT_SQL),
    "variance_filter": (variance_filter, VARIANCE_SQL), "phash_bits": (phash_bits, PHASH_SQL), "dhash_bits": (dhash_bits, DHASH_SQL), "hamming_pairs": (hamming_pairs, HAMMING_SQL), "similar_components": (similar_components, COMPONENTS_SQL),
    "topk_clusters": (topk_clusters, TOPK_SQL), "color_dominance": (color_dominance, DOMINANCE_SQL), "hog_cells": (hog_cells, HOG_SQL), "svm_score": (svm_score, SVM_SQL), "anchor_decode": (anchor_decode, ANCHOR_SQL),
}
