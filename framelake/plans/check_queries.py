"""Queries on checks of detected faces and on the steps around a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as c
from ..operators import pixels as p
from ..sources.router import source_kind
from .box_queries import BOXES_SQL, boxes
from .face_queries import _WHOLE, FACES_SQL, face_pixels
from .pixel_queries import PIXELS_SQL, RGB_SQL, pixels, rgb


def symmetry_score(spark, sf_dir):
    """Mirror symmetry of the faces of 16 by 16."""
    return c.symmetry(face_pixels(spark, sf_dir), 16, 16).select("frame", F.round("symmetry", 6).alias("symmetry"))


_around = lambda v, w: f"coalesce(lag({v}) OVER {w}, lead({v}) OVER {w}) AS {v}0, coalesce(lead({v}) OVER {w}, lag({v}) OVER {w}) AS {v}1"
SYMMETRY_SQL = f"""WITH {FACES_SQL}, {_WHOLE}, e AS (SELECT frame, x > 7 AS r, CASE WHEN x > 7 THEN 15 - x ELSE x END AS x, y, v FROM faces SEMI JOIN whole USING (frame)),
n AS (SELECT *, {_around("v", "o")} FROM e WINDOW o AS (PARTITION BY frame, r, y ORDER BY x)), a AS (SELECT frame, r, x, y, v1 - v0 AS d, v0 + 2 * v + v1 AS s FROM n),
m AS (SELECT *, {_around("d", "o")}, {_around("s", "o")} FROM a WINDOW o AS (PARTITION BY frame, r, x ORDER BY y)), g AS MATERIALIZED (SELECT frame, r, x, y, CAST(d0 + 2 * d + d1 AS DOUBLE) AS gx, CAST(s1 - s0 AS DOUBLE) AS gy FROM m),
t AS (SELECT p.frame AS frame, abs(atan2(p.gy, p.gx) - atan2(q.gy, q.gx)) AS t FROM g p JOIN g q ON p.frame = q.frame AND p.x = q.x AND p.y = q.y WHERE NOT p.r AND q.r AND sqrt(p.gx*p.gx + p.gy*p.gy) > 8 AND sqrt(q.gx*q.gx + q.gy*q.gy) > 8),
k AS (SELECT frame, count(*) AS n, avg(CASE WHEN least(t, pi() - t) < pi() / 3 THEN 1.0 ELSE 0.0 END) AS share FROM t GROUP BY frame)
SELECT frame, CASE WHEN coalesce(n, 0) < 32 THEN 1.0::DOUBLE ELSE round(share, 6) END AS symmetry FROM whole LEFT JOIN k USING (frame)"""


def eye_correction(spark, sf_dir):
    """Boxes at twice their size on frames of a height of 320, after their eyes; the eyes come from the box's place."""
    rows = boxes(spark, sf_dir).select("frame", "rank", (F.col("y") * 4).alias("y"), (F.col("h") * 2).alias("h"))
    top = (F.col("frame") * 7 + F.col("rank") * 29) % F.col("h")
    again = F.when((F.col("frame") + F.col("rank")) % 5 > 0, (F.col("frame") * 3 + F.col("rank") * 17) % F.col("h"))
    moved = c.moved_by_eyes(F.col("y"), F.col("h"), 320, top, again, F.col("frame") % 4 > 0)
    return rows.select("frame", "rank", moved.alias("m")).where("m is not null").select("frame", "rank", "m.y", "m.h")


EYE_CORRECTION_SQL = f"""WITH {BOXES_SQL}, b AS (SELECT frame, rank, y * 4 AS y, h * 2 AS h, (frame * 7 + rank * 29) % (h * 2) AS top, CASE WHEN (frame + rank) % 5 > 0 THEN (frame * 3 + rank * 17) % (h * 2) END AS again, frame % 4 > 0 AS aligned FROM boxes),
k AS (SELECT *, CASE WHEN top > 0.55::DOUBLE * h THEN 'low' WHEN top < 0.15::DOUBLE * h THEN 'high' ELSE 'fine' END AS kind FROM b),
s AS (SELECT *, CAST(floor(CASE WHEN kind = 'low' THEN top - 0.25::DOUBLE * h ELSE h * 0.30::DOUBLE END) AS INT) AS moves FROM k), n AS (SELECT *, greatest(0, y - moves) AS ny, least(320 - greatest(0, y - moves), h + moves) AS nh FROM s),
f AS (SELECT *, coalesce(aligned AND CASE WHEN kind = 'low' THEN again < 0.5::DOUBLE * nh ELSE again BETWEEN 0.15::DOUBLE * h AND 0.55::DOUBLE * nh END, false) AS better FROM n WHERE kind = 'fine' OR (nh >= 60 AND ny + nh / 2.0::DOUBLE <= 0.85::DOUBLE * 320))
SELECT frame, rank, CAST(CASE WHEN kind != 'fine' AND better THEN ny ELSE y END AS INT) AS y, CAST(CASE WHEN kind != 'fine' AND better THEN nh ELSE h END AS INT) AS h FROM f WHERE kind != 'high' OR better"""


def box_labels(spark, sf_dir):
    """Hue and label of every box by its rank; a share of skin in quarters."""
    place = F.col("rank")
    return boxes(spark, sf_dir).select("frame", "rank", c.stable_hue(place).alias("hue"), c.box_label(place, F.col("x") % 4 / 4.0).alias("label"))


LABELS_SQL = f"WITH {BOXES_SQL} SELECT frame, rank, rank * 47 % 180 AS hue, '#' || rank || ' sr=' || printf('%.2f', x % 4 / 4.0::DOUBLE) AS label FROM boxes"


def network_blob(spark, sf_dir):
    """Three channels of frames of 8 by 8 at 5 by 5, without their means."""
    return c.blob(rgb(spark, sf_dir), 8, 8, 5, 5)


BLOB_SQL = f"""WITH {RGB_SQL.replace("rgb AS (", "rgb AS MATERIALIZED (")}, o AS (SELECT CAST(i AS INT) AS o, greatest(0, (i + 0.5::DOUBLE) * 8 / 5 - 0.5) AS spot FROM range(5) r(i)),
u AS MATERIALIZED (SELECT o, CAST(floor(spot) AS INT) AS p, 1 - (spot - floor(spot)) AS k FROM o UNION ALL SELECT o, least(CAST(floor(spot) AS INT) + 1, 7), spot - floor(spot) FROM o),
l AS (SELECT frame, x, y, 0 AS channel, b AS v FROM rgb UNION ALL SELECT frame, x, y, 1, g FROM rgb UNION ALL SELECT frame, x, y, 2, r FROM rgb)
SELECT frame, channel, ux.o AS x, uy.o AS y, floor(round(sum(v * ux.k * uy.k), 6) + 0.5) - CASE channel WHEN 0 THEN 104 WHEN 1 THEN 177 ELSE 123 END AS value FROM l JOIN u ux ON ux.p = x JOIN u uy ON uy.p = y GROUP BY 1, 2, 3, 4"""


def detector_rows(spark, sf_dir):
    """Boxes of nine rows of seven numbers in every vector, spread by four, on frames of 320 by 240."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i, k: F.get("embedding", i * 7 + k).cast("double") * 4
    row = lambda i: F.struct(i.alias("row"), (at(i, 2) + 0.5).alias("conf"), *(at(i, k).alias(n) for k, n in zip(range(3, 7), ("x1", "y1", "x2", "y2"), strict=True)))
    found = e.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), row)).alias("r")).select("vec_id", "r.*")
    return c.decoded(found, 320, 240).select("vec_id", "row", F.round("conf", 6).alias("conf"), "x", "y", "w", "h")


_at = lambda k: f"CAST(embedding[i * 7 + {k + 1}] AS DOUBLE) * 4"
DETECTOR_SQL = f"""WITH r AS (SELECT vec_id, CAST(i AS INT) AS row, {_at(2)} + 0.5 AS conf, trunc({_at(3)} * 320) AS x1, trunc({_at(4)} * 240) AS y1, trunc({_at(5)} * 320) AS x2, trunc({_at(6)} * 240) AS y2 FROM embeddings, range(9) n(i)),
b AS (SELECT vec_id, row, conf, CAST(greatest(0, x1) AS INT) AS x, CAST(greatest(0, y1) AS INT) AS y, CAST(least(320, x2) AS INT) AS fx, CAST(least(240, y2) AS INT) AS fy FROM r WHERE conf >= 0.5)
SELECT vec_id, row, round(conf, 6) AS conf, x, y, fx - x AS w, fy - y AS h FROM b WHERE fx > x AND fy > y"""

WINDOWS = tuple((x, y, x + 4, y + 4) for y in (0, 2, 4) for x in (0, 2, 4))


def variance_mask(spark, sf_dir):
    """0 or 1 for each of nine windows of 4 by 4 of a frame, over the window as a whole."""
    base = pixels(spark, sf_dir)
    corners = F.array(*(F.struct(F.lit(n).alias("rect"), *(F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), r, strict=True))) for n, r in enumerate(WINDOWS)))
    rects = base.select("frame").distinct().select("frame", F.explode(corners).alias("r")).select("frame", "r.*")
    return p.rect_sums(p.integral(base), rects).select("frame", "rect", c.window_mask(F.col("s"), F.col("s2"), 16, 200).alias("mask"))


MASK_SQL = f"""WITH {PIXELS_SQL}, rects(rect, x0, y0, x1, y1) AS (VALUES {", ".join(str((n, *r)) for n, r in enumerate(WINDOWS))}), t AS (SELECT frame, rect, sum(v) AS s, sum(v*v) AS s2 FROM pixels JOIN rects ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2)
SELECT frame, rect, CAST(s2 * 16 >= s * s + 200 * 16 * 16 AS INT) AS mask FROM t"""

ENDS = ("", ".PNG", "/cam.mjpeg", "/clip.MP4", "/upload-7", "/frames/", "?a=multipart", "/x.ppm", ".webm")
STARTS = ("", "test://", "rtsp://", "/data/")


def source_kinds(spark, sf_dir):
    """Kinds of the pages' addresses with endings and beginnings of all sorts."""
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n % len(of) + 1).cast("int"))
    n = F.col("page_id")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", source_kind(F.concat(pick(STARTS, F.floor(n / len(ENDS))), "url", pick(ENDS, n))).alias("kind"))


_video = "regexp_matches(l, '[.](mp4|mov|avi|mkv|webm)$')"
KINDS_SQL = f"""WITH a AS (SELECT page_id, {list(STARTS)}[page_id // {len(ENDS)} % {len(STARTS)} + 1] || url || {list(ENDS)}[page_id % {len(ENDS)} + 1] AS u FROM pages), b AS (SELECT page_id, u, lower(u) AS l FROM a)
SELECT page_id, CASE WHEN u IS NULL THEN NULL WHEN starts_with(u, 'test://') THEN 'generated' WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN
CASE WHEN regexp_matches(l, '[.](png|ppm)$') THEN 'image' WHEN contains(l, '.mjpeg') OR contains(l, 'multipart') THEN 'unsupported' WHEN {_video} OR contains(l, '/upload-') OR contains(l, 'video') THEN 'video' ELSE 'sequence' END
WHEN starts_with(u, 'rtsp://') OR {_video} THEN 'video' ELSE 'sequence' END AS kind FROM b"""

def face_montage(spark, sf_dir):
    """Seven faces of 16 by 16 are a video; of each as many columns as its number says, three tiles a row, the first five at most."""
    base = face_pixels(spark, sf_dir).withColumn("w", (8 + F.col("frame") % 9).cast("int")).where("x < w")
    crops = base.select(F.floor(F.col("frame") / 7).alias("video"), F.col("frame").alias("face"), "w", F.lit(16).alias("h")).distinct()
    return c.montage(c.montage_places(crops, 16, 3, 5), base.select(F.col("frame").alias("face"), "x", "y", "v"), 16, 3)


MONTAGE_SQL = f"""WITH {FACES_SQL}, {_WHOLE}, c AS (SELECT frame, frame // 7 AS video, CAST(8 + frame % 9 AS INT) AS w, row_number() OVER (PARTITION BY frame // 7 ORDER BY frame) - 1 AS place FROM whole), p AS MATERIALIZED (SELECT * FROM c WHERE place < 5),
g AS (SELECT video, max(w) AS wide, max(place) // 3 + 1 AS rows FROM p GROUP BY video), s AS (SELECT video, wide, k.i AS place, x.i AS dx, y.i AS dy FROM g JOIN range(6) k(i) ON k.i < rows * 3 JOIN range(16) x(i) ON x.i < wide CROSS JOIN range(16) y(i))
SELECT s.video AS video, CAST(s.place % 3 * s.wide + dx AS INT) AS x, CAST(s.place // 3 * 16 + dy AS INT) AS y, CAST(CASE WHEN p.frame IS NULL THEN 0 WHEN dx >= p.w THEN 40 ELSE f.v END AS INT) AS v
FROM s LEFT JOIN p ON p.video = s.video AND p.place = s.place LEFT JOIN faces f ON f.frame = p.frame AND f.x = dx AND f.y = dy"""

QUERIES = {
    "symmetry_score": (symmetry_score, SYMMETRY_SQL), "eye_correction": (eye_correction, EYE_CORRECTION_SQL), "box_labels": (box_labels, LABELS_SQL),
    "network_blob": (network_blob, BLOB_SQL), "detector_rows": (detector_rows, DETECTOR_SQL), "variance_mask": (variance_mask, MASK_SQL), "source_kinds": (source_kinds, KINDS_SQL), "face_montage": (face_montage, MONTAGE_SQL),
}
