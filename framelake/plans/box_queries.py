"""Queries on detection boxes. Frames are orders, boxes their lines; the same derivation in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.boxes import dedup_first_come, dedup_rules, greedy_nms, match_boxes

WIDTH, HEIGHT = 280, 160

BOXES_SQL = """raw AS (
  SELECT l_orderkey AS frame, CAST(l_partkey % 60 AS INT) AS x, CAST(l_suppkey % 40 AS INT) AS y, CAST(24 + l_quantity AS INT) AS w, CAST(24 + l_quantity AS INT) AS h,
         l_extendedprice AS score, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_discount, l_tax FROM lineitem),
boxes AS (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, x, y, w, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_discount, l_tax) AS INT) AS rank, x, y, w, h, score FROM raw)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = (F.col("l_quantity") + 24).cast("int")
    raw = t.select(
        F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"), side.alias("w"), side.alias("h"),
        F.col("l_extendedprice").alias("score"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_discount", "l_tax",
    )
    order = Window.partitionBy("frame").orderBy(F.desc("score"), "x", "y", "w", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_discount", "l_tax")
    return raw.withColumn("rank", F.row_number().over(order)).select("frame", "rank", "x", "y", "w", "h", "score")


def _inter(a: str, b: str) -> str:
    return f"(greatest(least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x),0)*greatest(least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y),0))"


def _iou(a: str, b: str, kind: str) -> str:
    return f"(CAST({_inter(a, b)} AS {kind})/CAST({a}.w*{a}.h+{b}.w*{b}.h-{_inter(a, b)} AS {kind}))"


def _fold_sql(drop: str) -> str:
    """A recursive query that carries the boxes kept so far; ``drop``: a condition on k (kept) and t (the box)."""
    return f"""WITH RECURSIVE {BOXES_SQL},
fold(frame, n, kept) AS (
  SELECT frame, 1, [{{'rank': rank, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score}}] FROM boxes WHERE rank = 1
  UNION ALL
  SELECT f.frame, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda k: {drop})) > 0 THEN f.kept
         ELSE list_append(f.kept, {{'rank': t.rank, 'x': t.x, 'y': t.y, 'w': t.w, 'h': t.h, 'score': t.score}}) END
  FROM fold f JOIN boxes t ON t.frame = f.frame AND t.rank = f.n + 1),
done AS (SELECT frame, max_by(kept, n) AS kept FROM fold GROUP BY frame)
SELECT frame, k.rank AS rank, k.x AS x, k.y AS y, k.w AS w, k.h AS h, k.score AS score FROM (SELECT frame, unnest(kept) AS k FROM done)"""


def nms_greedy(spark, sf_dir):
    return greedy_nms(boxes(spark, sf_dir))


NMS_SQL = _fold_sql(f"{_iou('k', 't', 'FLOAT')} > CAST(0.3 AS FLOAT)")


def nms_counts(spark, sf_dir):
    return greedy_nms(boxes(spark, sf_dir)).groupBy("frame").agg(F.count("*").alias("n_boxes"), F.max("score").alias("top_score"))


NMS_COUNTS_SQL = f"SELECT frame, count(*) AS n_boxes, max(score) AS top_score FROM ({NMS_SQL}) GROUP BY frame"


def first_come(spark, sf_dir):
    return dedup_first_come(boxes(spark, sf_dir))


FIRST_COME_SQL = _fold_sql(f"{_iou('k', 't', 'DOUBLE')} > 0.4")


def rules(spark, sf_dir):
    return dedup_rules(boxes(spark, sf_dir))


_OVER = (
    f"greatest({_iou('k', 't', 'DOUBLE')}, CASE WHEN CAST({_inter('k', 't')} AS DOUBLE)/(t.w*t.h) > 0.6 THEN 1.0 ELSE 0.0 END, "
    "CASE WHEN t.x+t.w/2.0 BETWEEN k.x AND k.x+k.w AND t.y+t.h/2.0 BETWEEN k.y AND k.y+k.h AND t.w*t.h <= k.w*k.h*1.4 AND k.w*k.h <= t.w*t.h*1.4 THEN 1.0 ELSE 0.0 END)"
)
RULES_SQL = _fold_sql(f"{_inter('k', 't')} > 0 AND CASE WHEN {_OVER} > 0.5 THEN t.score < k.score OR (abs(t.score-k.score) < 1e-3 AND t.w*t.h < k.w*k.h) ELSE {_OVER} > 0.25 AND t.score < k.score END")


def iou_pairs(spark, sf_dir):
    """Overlapping pairs of a frame, joined on the frame."""
    b = boxes(spark, sf_dir)
    a, c = b.select("frame", F.col("rank").alias("a"), F.struct("x", "y", "w", "h").alias("p")), b.select("frame", F.col("rank").alias("b"), F.struct("x", "y", "w", "h").alias("q"))
    both = a.join(c, "frame").where("a < b")
    return both.select("frame", "a", "b", g.intersection(F.col("p"), F.col("q")).cast("bigint").alias("inter"), F.round(g.iou(F.col("p"), F.col("q"), "double"), 6).alias("iou")).where("inter > 0")


PAIRS_SQL = f"""WITH {BOXES_SQL} SELECT p.frame AS frame, p.rank AS a, q.rank AS b, CAST({_inter('p', 'q')} AS BIGINT) AS inter, round({_iou('p', 'q', 'DOUBLE')}, 6) AS iou
FROM boxes p JOIN boxes q ON p.frame = q.frame AND p.rank < q.rank WHERE {_inter('p', 'q')} > 0"""


def box_helpers(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    return boxes(spark, sf_dir).select("frame", "rank", (x + w).alias("right_edge"), (y + h).alias("bottom_edge"), (w * h).alias("area"), F.floor(x + w / 2).cast("int").alias("cx"), F.floor(y + h / 2).cast("int").alias("cy"))


HELPERS_SQL = f"WITH {BOXES_SQL} SELECT frame, rank, x+w AS right_edge, y+h AS bottom_edge, w*h AS area, CAST(floor(x+w/2.0) AS INT) AS cx, CAST(floor(y+h/2.0) AS INT) AS cy FROM boxes"


def geometry_filters(spark, sf_dir):
    """The conjunction that drops boxes which are no faces: side, aspect, place, share of the frame, beyond the frame."""
    x, y, w, h = (F.col(c) for c in "xywh")
    cy, share = y + h / 2.0, (w * h) / float(WIDTH * HEIGHT)
    keep = (w >= 60) & (h >= 60) & (F.greatest(w, h) / F.least(w, h) <= 1.4) & (cy >= HEIGHT * 0.05) & (y + h <= HEIGHT + 5) & (x + w <= WIDTH + 5) & ~((cy > HEIGHT * 0.65) & (share < 0.02)) & share.between(0.004, 0.5)
    return boxes(spark, sf_dir).where(keep)


GEOMETRY_SQL = f"""WITH {BOXES_SQL} SELECT * FROM boxes WHERE w >= 60 AND h >= 60 AND greatest(w,h)/least(w,h) <= 1.4 AND y+h/2.0 >= {HEIGHT}*0.05 AND y+h <= {HEIGHT}+5 AND x+w <= {WIDTH}+5
AND NOT (y+h/2.0 > {HEIGHT}*0.65 AND w*h/{float(WIDTH * HEIGHT)} < 0.02) AND w*h/{float(WIDTH * HEIGHT)} BETWEEN 0.004 AND 0.5"""


def rotate_back(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("code", F.element_at(F.array(*map(F.lit, ("none", "90cw", "90ccw", "180"))), F.col("rank") % 4 + 1))
    return b.select("frame", "rank", "code", *(c.alias(f"o{k}") for k, c in g.rotate_back(F.col("code"), F.lit(WIDTH), F.lit(HEIGHT)).items()))


ROTATE_SQL = f"""WITH {BOXES_SQL}, t AS (SELECT *, ['none','90cw','90ccw','180'][rank % 4 + 1] AS code FROM boxes)
SELECT frame, rank, code, CASE code WHEN '90cw' THEN {HEIGHT}-y-h WHEN '90ccw' THEN y WHEN '180' THEN {WIDTH}-x-w ELSE x END AS ox,
CASE code WHEN '90cw' THEN x WHEN '90ccw' THEN {WIDTH}-x-w WHEN '180' THEN {HEIGHT}-y-h ELSE y END AS oy, CASE WHEN code IN ('90cw','90ccw') THEN h ELSE w END AS ow, CASE WHEN code IN ('90cw','90ccw') THEN w ELSE h END AS oh FROM t"""


def crop_all_boxes(spark, sf_dir):
    """Padded crops within the frame, of every box; there is no cap for a frame."""
    return boxes(spark, sf_dir).select("frame", "rank", *(c.cast("int").alias(k) for k, c in g.padded(0.25, WIDTH, HEIGHT).items()))


CROP_ALL_SQL = f"""WITH {BOXES_SQL} SELECT frame, rank, CAST(greatest(x-floor(w*0.25),0) AS INT) AS x0, CAST(greatest(y-floor(h*0.25),0) AS INT) AS y0,
CAST(least(x+w+floor(w*0.25),{WIDTH}) AS INT) AS x1, CAST(least(y+h+floor(h*0.25),{HEIGHT}) AS INT) AS y1 FROM boxes"""


def back_map(spark, sf_dir):
    """Level boxes in the frame's pixels, divided (the default) and multiplied by the level's scale, clamped."""
    scale = 1.2
    b = boxes(spark, sf_dir)
    to = lambda c, side, size, how: g.clamp(g.round_half_up(F.col(c) / scale if how == "div" else F.col(c) * scale), 0, F.greatest(F.lit(size) - F.col(side), F.lit(0))).cast("int")
    return b.select("frame", "rank", to("x", "w", WIDTH, "div").alias("x_div"), to("y", "h", HEIGHT, "div").alias("y_div"), to("x", "w", WIDTH, "mul").alias("x_mul"), to("y", "h", HEIGHT, "mul").alias("y_mul"))


def _map_sql(c: str, side: str, size: int, op: str) -> str:
    return f"CAST(greatest(least(floor({c} {op} CAST(1.2 AS DOUBLE) + 0.5), greatest({size}-{side},0)),0) AS INT)"


BACK_MAP_SQL = f"WITH {BOXES_SQL} SELECT frame, rank, {_map_sql('x', 'w', WIDTH, '/')} AS x_div, {_map_sql('y', 'h', HEIGHT, '/')} AS y_div, {_map_sql('x', 'w', WIDTH, '*')} AS x_mul, {_map_sql('y', 'h', HEIGHT, '*')} AS y_mul FROM boxes"


def box_match_parity(spark, sf_dir):
    """The boxes against the same ones shifted by nothing, one or two pixels, every fifth missing."""
    left = boxes(spark, sf_dir)
    right = left.where("rank % 5 != 0").withColumn("x", F.col("x") + F.col("rank") % 3)
    out = match_boxes(left, right)
    return out.withColumn("mean_iou", F.round("mean_iou", 6))


PARITY_SQL = f"""WITH RECURSIVE {BOXES_SQL}, r0 AS (SELECT frame, rank, x + rank % 3 AS x, y, w, h FROM boxes WHERE rank % 5 != 0),
r AS (SELECT frame, list({{'rank': rank, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY rank) AS r FROM r0 GROUP BY frame),
nl AS (SELECT frame, count(*) AS nl FROM boxes GROUP BY frame),
fold(frame, n, used, total, k) AS (
  SELECT frame, 0, CAST([] AS INT[]), CAST(0 AS DOUBLE), 0 FROM nl
  UNION ALL
  SELECT frame, n + 1, CASE WHEN close IS NOT NULL THEN list_append(used, close) WHEN v >= 0.99 THEN list_append(used, vo) ELSE used END,
         total + CASE WHEN close IS NULL AND v > 0 THEN v ELSE 0 END, k + CASE WHEN close IS NULL AND v > 0 THEN 1 ELSE 0 END
  FROM (SELECT *, list_max(list_transform(free, lambda q: {{'v': {_iou('t', 'q', 'DOUBLE')}, 'o': -q.rank}})).v AS v, -list_max(list_transform(free, lambda q: {{'v': {_iou('t', 'q', 'DOUBLE')}, 'o': -q.rank}})).o AS vo,
               list_filter(free, lambda q: abs(t.x-q.x) <= 1 AND abs(t.y-q.y) <= 1 AND abs(t.w-q.w) <= 1 AND abs(t.h-q.h) <= 1)[1].rank AS close
        FROM (SELECT f.frame, f.n, f.used, f.total, f.k, t, list_filter(coalesce(r.r, []), lambda q: NOT list_contains(f.used, q.rank)) AS free
              FROM fold f JOIN boxes t ON t.frame = f.frame AND t.rank = f.n + 1 LEFT JOIN r ON r.frame = f.frame))),
done AS (SELECT frame, max_by({{'m': len(used), 'total': total, 'k': k}}, n) AS d FROM fold GROUP BY frame)
SELECT nl.frame AS frame, CAST(d.m AS BIGINT) AS matched, CAST(nl - d.m AS BIGINT) AS only_left, CAST(coalesce(len(r.r), 0) - d.m AS BIGINT) AS only_right, round(CASE WHEN d.k > 0 THEN d.total / d.k ELSE 1.0 END, 6) AS mean_iou
FROM nl JOIN done USING (frame) LEFT JOIN r ON r.frame = nl.frame"""


def parity_report(spark, sf_dir):
    """Sums over the frames of a video (the order's customer), and the largest difference in a frame's number of boxes; a video agrees if nothing is left over and that is under 5 %."""
    video = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("video"))
    left, right = F.col("matched") + F.col("only_left"), F.col("matched") + F.col("only_right")
    rows = box_match_parity(spark, sf_dir).join(video, "frame").withColumn("delta", F.abs(left - right) / F.greatest(left, right))
    total = lambda c: F.sum(c).alias(c)
    out = rows.groupBy("video").agg(F.count("*").alias("frames"), total("matched"), total("only_left"), total("only_right"), F.round(F.max("delta"), 6).alias("max_delta"))
    return out.withColumn("ok", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("max_delta") < 0.05))


REPORT_SQL = f"""SELECT *, only_left = 0 AND only_right = 0 AND max_delta < 0.05 AS ok FROM (SELECT o_custkey AS video, count(*) AS frames, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(only_left) AS BIGINT) AS only_left, CAST(sum(only_right) AS BIGINT) AS only_right,
round(max(CAST(abs(only_left - only_right) AS DOUBLE) / (matched + greatest(only_left, only_right))), 6) AS max_delta FROM ({PARITY_SQL}) JOIN orders ON o_orderkey = frame GROUP BY 1)"""


def worker_table(spark, sf_dir):
    """Boxes by worker (ship flag) with a row of totals."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = t.rollup("l_returnflag").agg(F.count("*").alias("boxes"), F.countDistinct("l_orderkey").alias("frames"), F.max("l_quantity").alias("max_side"), F.round(F.avg("l_quantity"), 6).alias("avg_side"))
    return out.select(F.coalesce("l_returnflag", F.lit("TOTAL")).alias("worker"), "boxes", "frames", "max_side", "avg_side")


WORKER_SQL = "SELECT coalesce(l_returnflag, 'TOTAL') AS worker, count(*) AS boxes, count(DISTINCT l_orderkey) AS frames, max(l_quantity) AS max_side, round(avg(l_quantity), 6) AS avg_side FROM lineitem GROUP BY ROLLUP (l_returnflag)"

QUERIES = {
    "nms_greedy": (nms_greedy, NMS_SQL), "nms_counts": (nms_counts, NMS_COUNTS_SQL), "dedup_first_come": (first_come, FIRST_COME_SQL), "dedup_rules": (rules, RULES_SQL),
    "iou_pairs": (iou_pairs, PAIRS_SQL), "box_helpers": (box_helpers, HELPERS_SQL), "geometry_filters": (geometry_filters, GEOMETRY_SQL), "rotate_back": (rotate_back, ROTATE_SQL),
    "crop_all_boxes": (crop_all_boxes, CROP_ALL_SQL), "back_map": (back_map, BACK_MAP_SQL), "box_match_parity": (box_match_parity, PARITY_SQL), "parity_report": (parity_report, REPORT_SQL), "worker_table": (worker_table, WORKER_SQL),
}
