"""Queries on faces, records and exports. Faces are images of 16 by 16 pixels, four vectors of ``embeddings`` each, in two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.text import base64_line, percent_encoded
from ..operators import faces as f
from ..operators import sliding
from ..sources import records as r
from ..sources import sinks as s
from .box_queries import BOXES_SQL, boxes
from .job_queries import JOBS_SQL, jobs
from .pixel_queries import PIXELS_SQL, RGB_SQL, pixels, rgb
from .tables import materialise, new_path

FACES_SQL = PIXELS_SQL.replace("pixels AS (", "pixels AS MATERIALIZED (") + """, faces AS MATERIALIZED (SELECT 2 * (frame // 4) + n AS frame, CAST(x + 8 * (frame % 2) AS INT) AS x, CAST(y + 8 * (frame // 2 % 2) AS INT) AS y,
CAST(CASE WHEN n = 1 AND (x + y) % 7 = 0 THEN least(255, v + 3) ELSE v END AS INT) AS v FROM pixels, range(2) k(n))"""
_WHOLE = "whole AS (SELECT frame FROM faces GROUP BY frame HAVING count(*) = 256)"
_AREA = "areas AS (SELECT frame, 1000 + frame // 2 * 37 % 900 AS base FROM whole), sized AS (SELECT frame, CASE WHEN frame % 2 = 0 THEN base WHEN frame // 2 % 3 = 0 THEN base * 9 // 5 ELSE base * 6 // 5 END AS area FROM areas)"


def face_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pixels(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    x, y = F.expr("cast(x + 8 * (frame % 2) as int)"), F.expr("cast(y + 8 * (frame div 2 % 2) as int)")
    v = F.when((F.col("n") == 1) & ((F.col("x") + F.col("y")) % 7 == 0), F.least(F.lit(255), F.col("v") + 3)).otherwise(F.col("v")).cast("int")
    out = base.select(F.expr("2 * (frame div 4) + n").alias("frame"), x.alias("x"), y.alias("y"), v.alias("v"))
    whole = out.groupBy("frame").count().where("count = 256").select("frame")
    return out.join(whole, "frame", "left_semi")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = materialise(face_pixels(spark, sf_dir), "faces")
    area = F.expr("1000 + frame div 2 * 37 % 900")
    area = F.when(F.col("frame") % 2 == 0, area).otherwise(F.when(F.expr("frame div 2 % 3 = 0"), F.expr("(1000 + frame div 2 * 37 % 900) * 9 div 5")).otherwise(F.expr("(1000 + frame div 2 * 37 % 900) * 6 div 5")))
    both = f.long_average_hash(base, 16, 16).join(f.long_gradient_hash(base, 16, 16), "frame")
    return materialise(both.withColumn("area", area), "hashed")


_HASHED = f"""{_WHOLE}, m AS (SELECT frame, avg(v) AS mean FROM faces GROUP BY frame),
aw AS (SELECT frame, y, CAST(bit_or(CASE WHEN v > mean THEN 1 << (15 - x) ELSE 0 END) AS INT) AS word FROM faces JOIN m USING (frame) GROUP BY frame, y),
c AS (SELECT o, p, least((p + 1) * 17, (o + 1) * 16) - greatest(p * 17, o * 16) AS part FROM range(17) r(o), range(16) s(p) WHERE least((p + 1) * 17, (o + 1) * 16) > greatest(p * 17, o * 16)),
g AS MATERIALIZED (SELECT frame, cx.o AS x, cy.o AS y, CAST(floor(round(sum(v * cx.part * cy.part) / CAST(sum(cx.part * cy.part) AS DOUBLE), 6) + 0.5) AS INT) AS v FROM faces JOIN c cx ON cx.p = x JOIN c cy ON cy.p = y GROUP BY 1, 2, 3),
u AS (SELECT frame, x, y, lead(v) OVER (PARTITION BY frame, y ORDER BY x) > v AS up FROM g),
gw AS (SELECT frame, y, CAST(bit_or(CASE WHEN up THEN 1 << CAST(15 - x AS INT) ELSE 0 END) AS INT) AS word FROM u WHERE x < 16 GROUP BY frame, y),
hashed AS MATERIALIZED (SELECT frame, average, gradient FROM (SELECT frame, list(word ORDER BY y) AS average FROM aw GROUP BY frame) JOIN (SELECT frame, list(word ORDER BY y) AS gradient FROM gw GROUP BY frame) USING (frame) JOIN whole USING (frame))"""


def long_hashes(spark, sf_dir):
    """The 256 and the 272 bits of every face as text, a word of 16 bits a row."""
    text = lambda c: F.array_join(F.transform(c, lambda w: w.cast("string")), ",").alias(c)
    return hashed(spark, sf_dir).select("frame", text("average"), text("gradient"))


LONG_HASH_SQL = f"WITH {FACES_SQL}, {_HASHED} SELECT frame, array_to_string(average, ',') AS average, array_to_string(gradient, ',') AS gradient FROM hashed"


def face_clusters(spark, sf_dir):
    """Faces connected by either hash within ten bits and areas within a ratio of 1.5."""
    return f.face_clusters(hashed(spark, sf_dir))


_bits = lambda c: f"list_sum(list_transform(range(1, len(p.{c}) + 1), lambda i: bit_count(xor(p.{c}[i], q.{c}[i]))))"
_CLUSTERS = f"""{_AREA}, known AS MATERIALIZED (SELECT * FROM hashed JOIN sized USING (frame)),
pairs AS MATERIALIZED (SELECT p.frame AS a, q.frame AS b FROM known p JOIN known q ON p.frame < q.frame WHERE greatest(p.area, q.area) <= 1.5 * least(p.area, q.area) AND ({_bits("average")} <= 10 OR {_bits("gradient")} <= 10)),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(frame, spot) AS (SELECT frame, frame FROM known UNION SELECT r.frame, e.b FROM reach r JOIN edges e ON r.spot = e.a),
clusters AS (SELECT frame, min(spot) AS cluster FROM reach GROUP BY frame)"""
CLUSTERS_SQL = f"WITH RECURSIVE {FACES_SQL}, {_HASHED}, {_CLUSTERS} SELECT frame, cluster FROM clusters"


def top_faces(spark, sf_dir):
    known = hashed(spark, sf_dir)
    confidence = (F.col("frame") * 7919 % 1000) / 1000
    return f.top_faces(f.face_clusters(known).join(known.select("frame", "area", confidence.alias("confidence")), "frame"))


TOP_FACES_SQL = f"""WITH RECURSIVE {FACES_SQL}, {_HASHED}, {_CLUSTERS}, n AS (SELECT cluster, count(*) AS cluster_size FROM clusters GROUP BY cluster ORDER BY 2 DESC, 1 LIMIT 3),
b AS (SELECT cluster, frame, row_number() OVER (PARTITION BY cluster ORDER BY area DESC, frame * 7919 % 1000 DESC, frame) AS k FROM clusters JOIN sized USING (frame))
SELECT CAST(row_number() OVER (ORDER BY cluster_size DESC, cluster) AS INT) AS rank, cluster, cluster_size, frame AS stands FROM n JOIN b USING (cluster) WHERE k = 1"""


def hog_blocks(spark, sf_dir):
    """The 36 values of the one block of each face: two by two cells, nine directions."""
    found = f.gradient_blocks(f.gradient_cells(face_pixels(spark, sf_dir)), 2, 2)
    return found.select("frame", "cell", "bin", F.round("value", 4).alias("value"))


HOG_BLOCKS_SQL = f"""WITH {FACES_SQL}, {_WHOLE}, gr AS (SELECT frame, x // 8 + 2 * (y // 8) AS cell, coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v) AS gx, coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v) AS gy
FROM faces SEMI JOIN whole USING (frame) WINDOW r AS (PARTITION BY frame, y ORDER BY x), c AS (PARTITION BY frame, x ORDER BY y)),
a AS (SELECT frame, cell, sqrt(gx*gx+gy*gy) AS size, degrees(atan2(CAST(gy AS DOUBLE), CAST(gx AS DOUBLE))) AS angle FROM gr), t AS (SELECT frame, cell, size, (CASE WHEN angle < 0 THEN angle+180 ELSE angle END)*9/180 AS spot FROM a WHERE size >= 1e-3),
d AS (SELECT frame, cell, CAST(floor(spot) AS INT) % 9 AS bin, size*(1-(spot-floor(spot))) AS w FROM t UNION ALL SELECT frame, cell, (CAST(floor(spot) AS INT)+1) % 9, size*(spot-floor(spot)) FROM t),
h AS (SELECT frame, cell, bin, sum(w) AS w FROM d GROUP BY 1, 2, 3), k AS (SELECT frame, cell, bin, least(0.2, w / sqrt(sum(w*w) OVER (PARTITION BY frame) + 1e-3)) AS w FROM h)
SELECT frame, CAST(cell AS INT) AS cell, CAST(bin AS INT) AS bin, round(w / sqrt(sum(w*w) OVER (PARTITION BY frame) + 1e-3), 4) AS value FROM k"""


def eye_pairs(spark, sf_dir):
    """Boxes as the eyes of their frame, a crop of 100 by 80: the widest level pair, and whether all are aligned as eyes are."""
    eyes = boxes(spark, sf_dir)
    middle = F.col("y") + F.floor(F.col("h") / 2)
    spread = eyes.groupBy("frame").agg(F.count("*").alias("n"), (F.max(middle) - F.min(middle)).alias("spread"))
    aligned = spread.select("frame", f.eyes_aligned(F.col("n"), F.col("spread"), F.lit(80)).alias("aligned"))
    return f.eye_pairs(eyes, F.lit(100)).join(aligned, "frame")


EYES_SQL = f"""WITH {BOXES_SQL}, e AS (SELECT frame, rank, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM boxes),
p AS (SELECT a.frame AS frame, b.cx - a.cx AS dx, abs(b.cy - a.cy) AS dy FROM e a JOIN e b ON a.frame = b.frame AND (a.cx, a.cy, a.rank) < (b.cx, b.cy, b.rank) AND abs(b.cy - a.cy) <= 0.30 * 100),
w AS (SELECT frame, dx, dy, row_number() OVER (PARTITION BY frame ORDER BY dx DESC, dy) AS k FROM p),
s AS (SELECT frame, count(*) AS n, max(y + h // 2) - min(y + h // 2) AS spread FROM boxes GROUP BY frame)
SELECT frame, dx IS NOT NULL AS ok, CAST(round(coalesce(dx / 100, 0), 6) AS DOUBLE) AS dx, CAST(round(coalesce(dy / 100, 0), 6) AS DOUBLE) AS dy,
CASE WHEN n = 1 THEN spread <= 0.08 * 80 ELSE n BETWEEN 2 AND 3 AND spread <= 0.30 * 80 END AS aligned FROM s LEFT JOIN (SELECT * FROM w WHERE k = 1) USING (frame)"""


def face_grid(spark, sf_dir):
    """Faces of a score of 10,000 or more: the place of each within its job under the four orders of the grid."""
    shown = boxes(spark, sf_dir).where("score >= 10000")
    place = lambda *by: F.row_number().over(Window.partitionBy("frame").orderBy(*by))
    return shown.select(
        "frame", "rank", place("x", "rank").alias("by_time"), place(F.desc("score"), "rank").alias("by_score"), place("score", "rank").alias("by_score_up"), place(F.desc(F.col("w") * F.col("h")), "rank").alias("by_size"),
    )


_place = lambda by: f"CAST(row_number() OVER (PARTITION BY frame ORDER BY {by}) AS INT)"
GRID_SQL = f"WITH {BOXES_SQL} SELECT frame, rank, {_place('x, rank')} AS by_time, {_place('score DESC, rank')} AS by_score, {_place('score, rank')} AS by_score_up, {_place('w * h DESC, rank')} AS by_size FROM boxes WHERE score >= 10000"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RECORD rows of the boxes; every tenth frame without any."""
    box = F.struct("x", "y", "w", "h", F.col("score").cast("float").alias("score"))
    rows = boxes(spark, sf_dir).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", box.alias("box")))), lambda b: b["box"]).alias("all"))
    none = F.array().cast("array<struct<x:int,y:int,w:int,h:int,score:float>>")
    name = F.concat(F.lit('f"'), F.col("frame").cast("string"), F.lit("\\.png"))
    return rows.select(F.col("frame").alias("frame_index"), (F.col("frame") * 33).alias("timestamp_ms"), name.alias("image_file"), F.lit(280).alias("width"), F.lit(160).alias("height"), F.when(F.col("frame") % 10 == 0, none).otherwise(F.col("all")).alias("detections"), (F.col("frame") % 16 / 4.0).alias("detect_ms"))


def manifest_records(spark, sf_dir):
    return records(spark, sf_dir).select("frame_index", r.record_line(F.col("detections")).alias("line"))


MANIFEST_SQL = f"""WITH {BOXES_SQL}, d AS (SELECT frame, string_agg('{{"x": ' || x || ', "y": ' || y || ', "w": ' || w || ', "h": ' || h || ', "conf": ' || printf('%.4f', CAST(CAST(score AS FLOAT) AS DOUBLE)) || '}}', ', ' ORDER BY rank) AS t FROM boxes GROUP BY frame)
SELECT frame AS frame_index, '{{"frame_index": ' || frame || ', "timestamp_ms": ' || frame * 33 || ', "image": "f\\"' || frame || '\\\\.png", "width": 280, "height": 160, "detect_ms": ' || printf('%.3f', frame % 16 / 4.0) || ', "detections": [' || CASE WHEN frame % 10 = 0 THEN '' ELSE t END || ']}}' AS line FROM d"""


def manifest_file(spark, sf_dir):
    """The lines of the manifest that was written, by their place: parts in the order of their names."""
    path = new_path(spark, "manifest")
    s.write_manifest(records(spark, sf_dir), path, F.max("timestamp_ms"))
    return s.manifest_places(spark, path)


def manifest_statistics(spark, sf_dir):
    return r.run_statistics(records(spark, sf_dir), F.max("timestamp_ms"))


STATISTICS_SQL = f"""WITH {BOXES_SQL}, d AS (SELECT frame, CASE WHEN frame % 10 = 0 THEN 0 ELSE count(*) END AS n FROM boxes GROUP BY frame)
SELECT count(*) AS frames_processed, count(*) FILTER (n > 0) AS frames_with_face, CAST(sum(n) AS BIGINT) AS total_detections, max(frame * 33) AS elapsed_ms, round(count(*) * 1000.0 / max(frame * 33), 2)::DOUBLE AS fps, round(sum(frame % 16 / 4.0) / count(*), 3)::DOUBLE AS detect_ms_avg FROM d"""


MANIFEST_FILE_SQL = f"""WITH l AS MATERIALIZED ({MANIFEST_SQL}), s AS ({STATISTICS_SQL}), f AS (SELECT 1 AS part, frame_index AS no, '    ' || line || CASE WHEN frame_index = (SELECT max(frame_index) FROM l) THEN '' ELSE ',' END AS line FROM l),
h AS (SELECT unnest([{{'no': 0, 'line': '{{'}}, {{'no': 1, 'line': '  "version": "framelake-0.1",'}}, {{'no': 2, 'line': '  "stats": {{'}}, {{'no': 3, 'line': '    "frames_processed": ' || frames_processed || ','}}, {{'no': 4, 'line': '    "frames_with_face": ' || frames_with_face || ','}},
{{'no': 5, 'line': '    "total_detections": ' || total_detections || ','}}, {{'no': 6, 'line': '    "elapsed_ms": ' || elapsed_ms || ','}}, {{'no': 7, 'line': '    "fps": ' || printf('%.2f', fps) || ','}}, {{'no': 8, 'line': '    "detect_ms_avg": ' || printf('%.3f', detect_ms_avg)}}, {{'no': 9, 'line': '  }},'}}, {{'no': 10, 'line': '  "frames": ['}}]) AS r FROM s),
e AS (SELECT 0 AS part, r.no AS no, r.line AS line FROM h UNION ALL SELECT * FROM f UNION ALL SELECT 2, 0, '  ]' UNION ALL SELECT 2, 1, '}}')
SELECT row_number() OVER (ORDER BY part, no) - 1 AS place, line FROM e"""


def faces_csv(spark, sf_dir):
    """The lines of a job's face export; every seventh url has a comma and a quote."""
    url = F.concat(F.lit("/media/"), F.col("frame").cast("string"), F.when(F.col("frame") % 7 == 0, ',"a"').otherwise("/a"), F.col("rank").cast("string"))
    line = r.csv_line(F.col("frame"), F.col("frame") * 33, F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.floor("score"), url)
    return boxes(spark, sf_dir).select("frame", "rank", line.alias("line"))


CSV_SQL = f"""WITH {BOXES_SQL} SELECT frame, rank, concat_ws(',', frame, frame * 33, x, y, w, h, CAST(floor(score) AS BIGINT), CASE WHEN frame % 7 = 0 THEN '"/media/' || frame || ',""a""' || rank || '"' ELSE '/media/' || frame || '/a' || rank END) AS line FROM boxes"""


def score_filter(spark, sf_dir):
    """Boxes that a least score keeps, their frames' other boxes counted."""
    rows = boxes(spark, sf_dir)
    return rows.groupBy("frame").agg(F.count_if(F.col("score") >= 40000).alias("kept"), F.count_if(~(F.col("score") >= 40000)).alias("below"))


SCORE_SQL = f"WITH {BOXES_SQL} SELECT frame, count(*) FILTER (score >= 40000) AS kept, count(*) FILTER (score < 40000) AS below FROM boxes GROUP BY frame"


def union_results(spark, sf_dir):
    """The boxes of two detectors in one table, counted by frame and detector; a box of both counts for both."""
    rows = boxes(spark, sf_dir).select("frame", "x", "y", "w", "h", "rank")
    both = rows.where("rank % 2 = 1").withColumn("algo", F.lit("haar")).unionByName(rows.where("rank % 3 = 0").withColumn("algo", F.lit("hog")))
    return both.groupBy("frame", "algo").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area"))


UNION_SQL = f"WITH {BOXES_SQL}, u AS (SELECT frame, w, h, 'haar' AS algo FROM boxes WHERE rank % 2 = 1 UNION ALL SELECT frame, w, h, 'hog' FROM boxes WHERE rank % 3 = 0) SELECT frame, algo, count(*) AS n, CAST(sum(w * h) AS BIGINT) AS area FROM u GROUP BY frame, algo"


def algo_compare(spark, sf_dir):
    """Finished jobs by algorithm: runs, boxes for each run, mean time, and how its time stands to the fastest one's."""
    done = jobs(spark, sf_dir).where("status = 'done' and algo != ''")
    by = done.groupBy("algo").agg(F.count("*").alias("runs"), F.sum("detections").alias("boxes"), F.sum("elapsed_ms").alias("ms"))
    fastest = F.min(F.col("ms") / F.col("runs")).over(Window.partitionBy())  # a row for each algorithm
    return by.select("algo", "runs", "boxes", F.round(F.col("ms") / F.col("runs"), 4).alias("mean_ms"), F.round(F.col("ms") / F.col("runs") / fastest, 6).alias("slowdown"))


COMPARE_SQL = f"""WITH {JOBS_SQL}, b AS (SELECT algo, count(*) AS runs, CAST(sum(detections) AS BIGINT) AS boxes, CAST(sum(elapsed_ms) AS DOUBLE) AS ms FROM jobs WHERE status = 'done' AND algo != '' GROUP BY algo)
SELECT algo, runs, boxes, round(ms / runs, 4) AS mean_ms, round(ms / runs / min(ms / runs) OVER (), 6) AS slowdown FROM b"""


def gray_planes(spark, sf_dir):
    """Gray pixels as three equal channels and as shares of 255."""
    return pixels(spark, sf_dir).select("frame", "x", "y", *(F.col("v").alias(c) for c in "rgb"), F.round(F.col("v") / 255.0, 6).alias("unit"))


PLANES_SQL = f"WITH {PIXELS_SQL} SELECT frame, x, y, v AS r, v AS g, v AS b, round(v / 255.0::DOUBLE, 6) AS unit FROM pixels"


def colour_planes(spark, sf_dir):
    """Sums of the three channels of every frame."""
    return rgb(spark, sf_dir).groupBy("frame").agg(*(F.sum(c).alias(c) for c in "rgb"))


COLOUR_SQL = f"WITH {RGB_SQL} SELECT frame, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM rgb GROUP BY frame"


def url_parts(spark, sf_dir):
    """Scheme, host and path of every page's address, and the address percent-encoded; digests of its name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    part = lambda k: F.regexp_extract("url", r"^([a-z]+)://([^/?#]*)([^?#]*)", k)
    return pages.select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"), percent_encoded(F.col("url")).alias("encoded"), percent_encoded(part(3), keep="/").alias("encoded_path"), F.sha2("url", 256).alias("sha256"), base64_line(F.encode("url", "UTF-8")).alias("base64"), F.lower(F.hex(F.encode("url", "UTF-8"))).alias("hex"))


URL_SQL = r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)', 2) AS host, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)', 3) AS path,
url_encode(url) AS encoded, replace(url_encode(regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)', 3)), '%2F', '/') AS encoded_path, sha256(url) AS sha256, base64(encode(url)) AS base64, lower(hex(encode(url))) AS hex FROM pages"""

#: Scales of the anchor queries: tiles of 8 and 16 on faces of 16 by 16.
ANCHOR_SCALES = (sliding.Scale(4, 8, 8), sliding.Scale(8, 6, 16))


def anchor_tiles(spark, sf_dir):
    """Boxes of the anchor network over the tiles of every face, before suppression."""
    return sliding.anchor_boxes(face_pixels(spark, sf_dir), 16, 16, sliding.even_anchor_weights(2), ANCHOR_SCALES, 0.49).withColumn("score", F.round("score", 8))


def anchor_detect(spark, sf_dir):
    """Boxes of the anchor network after suppression."""
    return sliding.anchor_detect(face_pixels(spark, sf_dir), 16, 16, sliding.even_anchor_weights(2), ANCHOR_SCALES, 0.49)


# Every output is a sum over hidden ones, written out from the weights; a value's output is rounded to millionths as in the operator.
def _outputs(k: int) -> str:
    w = sliding.even_anchor_weights(2)[k]
    hidden = [f"greatest(v / 255.0::DOUBLE * {a!r}::DOUBLE + {b!r}::DOUBLE, 0)" for a, b in zip(w.hidden.tolist(), w.hidden_bias.tolist(), strict=True)]
    out = lambda o: " + ".join(f"{h} * {x!r}::DOUBLE" for h, x in zip(hidden, w.out[:, o].tolist(), strict=True)) + f" + {w.out_bias[o].item()!r}::DOUBLE"
    return ", ".join(f"CAST(round_even(({out(o)}) * 1000000, 0) AS BIGINT) AS o{o}" for o in range(sliding.OUTPUTS))


_TILES = " UNION ALL ".join(f"SELECT {k} AS scale, {s.stride} AS stride, {s.anchor} AS anchor, {s.tile} AS tile, i * {s.stride} AS tx, j * {s.stride} AS ty FROM range({(16 - s.tile) // s.stride + 1}) a(i), range({(16 - s.tile) // s.stride + 1}) b(j)" for k, s in enumerate(ANCHOR_SCALES))
_VALUES = " UNION ALL ".join(f"SELECT {k} AS scale, v, {_outputs(k)} FROM range(256) r(v)" for k in range(2))
_SHARE = lambda o: f"(sum(o{o}) / (any_value(tile) * any_value(tile) * 1000000.0::DOUBLE))"
ANCHOR_TILES_SQL = f"""WITH {FACES_SQL}, {_WHOLE}, tiles AS ({_TILES}), outs AS MATERIALIZED ({_VALUES}),
m AS (SELECT frame, t.scale AS scale, tx, ty, any_value(tile) // 2 AS half, any_value(stride) AS stride, any_value(anchor) AS anchor, {", ".join(f"{_SHARE(o)} AS o{o}" for o in range(5))} FROM faces SEMI JOIN whole USING (frame) JOIN tiles t ON x >= tx AND x < tx + tile AND y >= ty AND y < ty + tile JOIN outs u ON u.scale = t.scale AND u.v = faces.v GROUP BY frame, t.scale, tx, ty),
b AS (SELECT *, anchor * exp(o2 * stride) AS bw, anchor * exp(o3 * stride) AS bh FROM m), c AS (SELECT *, least(greatest(tx + half + o0 * stride - bw / 2, 0), 15) AS bx, least(greatest(ty + half + o1 * stride - bh / 2, 0), 15) AS byy FROM b),
d AS (SELECT frame, scale, tx, ty, CAST(floor(bx) AS INT) AS x, CAST(floor(byy) AS INT) AS y, CAST(floor(bx + greatest(bw, 1)) AS INT) AS x2, CAST(floor(byy + greatest(bh, 1)) AS INT) AS y2, 1 / (1 + exp(-o4)) AS score FROM c)
SELECT frame, scale, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, x, y, x2 - x AS w, y2 - y AS h, round(score, 8) AS score FROM d WHERE score >= 0.49 AND x2 <= 16 AND y2 <= 16 AND x2 > x AND y2 > y"""

def url_checksums(spark, sf_dir):
    """The Adler checksum of every page's address."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", bits.adler32(F.encode("url", "UTF-8")).alias("adler"))


CHECKSUM_SQL = """WITH h AS (SELECT page_id, hex(encode(url)) AS h FROM pages), b AS (SELECT page_id, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bs FROM h),
s AS (SELECT page_id, (1 + coalesce(list_sum(bs), 0)) % 65521 AS low, (len(bs) + coalesce(list_sum(list_transform(bs, lambda v, i: v * (len(bs) - i + 1))), 0)) % 65521 AS high FROM b) SELECT page_id, CAST(high * 65536 + low AS BIGINT) AS adler FROM s"""


def noise_frames(spark, sf_dir):
    """Frames of 8 by 8 pixels of generated noise, the vector's id and label for a seed."""
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.posexplode(bits.noise(F.col("vec_id") * 10 + F.coalesce("label", F.lit(0)), 64)).alias("i", "v"))
    return vec.select("frame", (F.col("i") % 8).alias("x"), F.expr("cast(i div 8 as int)").alias("y"), "v")


NOISE_SQL = """WITH RECURSIVE g(frame, i, s) AS (SELECT vec_id, -1, vec_id * 10 + coalesce(label, 0) FROM embeddings UNION ALL SELECT frame, i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < 63)
SELECT frame, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(s >> 24 AS INT) AS v FROM g WHERE i >= 0"""


def request_times(spark, sf_dir):
    """The time of every event as signed requests have it."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", bits.request_time(F.col("ts").cast("timestamp")).alias("stamp"))


REQUEST_SQL = "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events"


def jsonl_records(spark, sf_dir):
    """Records written as JSON lines and read back: their boxes and scores counted."""
    path = new_path(spark, "jsonl")
    r.write_jsonl(records(spark, sf_dir), path)
    back = r.scan_jsonl(spark, path).where("_corrupt_record is null")
    total = lambda c: F.aggregate("detections", F.lit(0).cast("long"), lambda a, d: a + d[c]).alias(f"sum_{c}")
    return back.select("frame_index", "timestamp_ms", "image_file", "detect_ms", F.size("detections").alias("n"), total("x"), total("w"))


JSONL_SQL = f"""WITH {BOXES_SQL} SELECT frame AS frame_index, frame * 33 AS timestamp_ms, 'f"' || frame || '\\.png' AS image_file, frame % 16 / 4.0::DOUBLE AS detect_ms, CAST(CASE WHEN frame % 10 = 0 THEN 0 ELSE count(*) END AS INT) AS n,
CAST(CASE WHEN frame % 10 = 0 THEN 0 ELSE sum(x) END AS BIGINT) AS sum_x, CAST(CASE WHEN frame % 10 = 0 THEN 0 ELSE sum(w) END AS BIGINT) AS sum_w FROM boxes GROUP BY frame"""

QUERIES = {
    "url_checksums": (url_checksums, CHECKSUM_SQL), "noise_frames": (noise_frames, NOISE_SQL), "request_times": (request_times, REQUEST_SQL), "jsonl_records": (jsonl_records, JSONL_SQL),
    "anchor_tiles": (anchor_tiles, ANCHOR_TILES_SQL), "anchor_detect": (anchor_detect, None),
    "long_hashes": (long_hashes, LONG_HASH_SQL), "face_clusters": (face_clusters, CLUSTERS_SQL), "top_faces": (top_faces, TOP_FACES_SQL), "hog_blocks": (hog_blocks, HOG_BLOCKS_SQL), "eye_pairs": (eye_pairs, EYES_SQL),
    "face_grid": (face_grid, GRID_SQL), "manifest_records": (manifest_records, MANIFEST_SQL), "manifest_file": (manifest_file, MANIFEST_FILE_SQL), "manifest_statistics": (manifest_statistics, STATISTICS_SQL), "faces_csv": (faces_csv, CSV_SQL), "score_filter": (score_filter, SCORE_SQL),
    "union_results": (union_results, UNION_SQL), "algo_compare": (algo_compare, COMPARE_SQL), "gray_planes": (gray_planes, PLANES_SQL), "colour_planes": (colour_planes, COLOUR_SQL), "url_parts": (url_parts, URL_SQL),
}
