"""Queries on time-ordered rows: ``events`` as faces on a track, a user a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock
from ..operators.jobs import final_states, watched
from .tables import materialise

GAP_MS, DISTANCE = 6 * 3600 * 1000, 140


def events(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", "event_type", "value", "props", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


E = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ms FROM events)"


def track():
    return Window.partitionBy("user_id").orderBy("ms", "event_id")


def temporal_clusters(spark, sf_dir):
    """Runs of faces close in time and place to the one before; the middle member stands for each."""
    far = (F.col("ms") - F.lag("ms").over(track()) >= GAP_MS) | (F.abs(F.col("value") - F.lag("value").over(track())) >= DISTANCE)
    runs = events(spark, sf_dir).withColumn("fresh", F.coalesce(far, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(track()))
    members = F.array_sort(F.collect_list(F.struct("ms", "event_id")))
    out = runs.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("ms").alias("from_ms"), F.max("ms").alias("to_ms"), members.alias("m"))
    return out.select("user_id", "run", "n", "from_ms", "to_ms", F.get("m", F.floor(F.col("n") / 2).cast("int"))["event_id"].alias("stands"))


CLUSTERS_SQL = f"""WITH {E}, f AS (SELECT *, coalesce(CAST(ms - lag(ms) OVER w >= {GAP_MS} OR abs(value - lag(value) OVER w) >= {DISTANCE} AS INT), 1) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS BIGINT) AS run FROM f)
SELECT user_id, run, count(*) AS n, min(ms) AS from_ms, max(ms) AS to_ms, list(event_id ORDER BY ms, event_id)[count(*)//2 + 1] AS stands FROM r GROUP BY user_id, run"""


def moving_fps(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", F.round(F.avg("value").over(track().rowsBetween(-5, 0)), 6).alias("fps"))


FPS_SQL = f"WITH {E} SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS fps FROM e"


def frame_sampling(spark, sf_dir):
    """Every third frame of a video (30 frames a second at 10), numbered anew."""
    at = events(spark, sf_dir).withColumn("i", F.row_number().over(track()) - 1).where("i % 3 = 0")
    return at.select("user_id", "event_id", F.floor(F.col("i") / 3).alias("sample"), F.floor(F.col("i") * 1000 / 30).alias("ts_ms"))


SAMPLING_SQL = f"WITH {E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS i FROM e) SELECT user_id, event_id, i//3 AS sample, i*1000//30 AS ts_ms FROM a WHERE i % 3 = 0"


def keepalive_frames(spark, sf_dir):
    """Frames with a face (purchases), and every thirtieth without."""
    at = events(spark, sf_dir).withColumn("i", F.row_number().over(track()) - 1)
    return at.where((F.col("event_type") == "purchase") | (F.col("i") % 30 == 0)).select("user_id", "event_id", F.col("i").cast("bigint").alias("i"))


KEEPALIVE_SQL = f"WITH {E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS i FROM e) SELECT user_id, event_id, i FROM a WHERE event_type = 'purchase' OR i % 30 = 0"


def timeline_marks(spark, sf_dir):
    """Marks of a video, thinned to about eighty by an even step."""
    rows = events(spark, sf_dir).select("user_id", "event_id", (F.row_number().over(track()) - 1).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 80))
    return rows.where(F.col("i") % step == 0).select("user_id", "event_id", F.round(F.col("i") * 100 / F.col("n"), 4).alias("left_pct"))


MARKS_SQL = f"WITH {E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, event_id, round(CAST(i*100 AS DOUBLE)/n, 4) AS left_pct FROM a WHERE i % greatest(1, n//80) = 0"


def face_frame_browser(spark, sf_dir):
    rows = events(spark, sf_dir).where("value > 20")
    return rows.select("user_id", "event_id", F.lag("event_id").over(track()).alias("previous"), F.lead("event_id").over(track()).alias("next"), clock(F.col("ms") % 3600000).alias("at_time"))


BROWSER_SQL = f"""WITH {E}, a AS (SELECT *, ms % 3600000 AS t FROM e WHERE value > 20)
SELECT user_id, event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next, lpad(CAST(t//60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t//1000%60 AS VARCHAR), 2, '0') || '.' || (t//100%10) AS at_time FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)"""


def json_payload(spark, sf_dir):
    """Event messages as JSON, and a number read back from one."""
    e = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    payload = F.to_json(F.struct(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), k.alias("k")))
    return e.select("event_id", payload.alias("payload"), F.get_json_object(payload, "$.seq").cast("bigint").alias("seq"), k.alias("k"))


JSON_SQL = f"""WITH {E} SELECT event_id, '{{"job_id":' || user_id || ',"seq":' || event_id || ',"type":"' || event_type || '"' || coalesce(',"k":' || CAST(props->>'$.k' AS BIGINT), '') || '}}' AS payload, event_id AS seq, CAST(props->>'$.k' AS BIGINT) AS k FROM e"""


def replay_from(spark, sf_dir):
    """What a client that has seen five events of each job still gets, in order."""
    rows = events(spark, sf_dir).withColumn("seq", F.row_number().over(track()).cast("bigint"))
    return rows.where("seq > 5").select("user_id", "seq", "event_id")


REPLAY_SQL = f"WITH {E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS seq FROM e) SELECT user_id, seq, event_id FROM a WHERE seq > 5"


def upper_median(spark, sf_dir):
    """The value at place n / 2 of the sorted values, by event type, without gathering a type's values in one task."""
    e = events(spark, sf_dir)
    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    counts = materialise(counts.repartitionByRange("event_type", "value").withColumn("part", F.spark_partition_id()), "values")
    parts = counts.groupBy("event_type", "part").agg(F.sum("n").alias("m"))
    of = Window.partitionBy("event_type")
    before = F.coalesce(F.sum("m").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("event_type", "part", before.alias("before"), F.sum("m").over(of).alias("total"))
    within = F.sum("n").over(Window.partitionBy("event_type", "part").orderBy("value"))
    run = counts.withColumn("within", within).join(parts, ["event_type", "part"]).withColumn("upto", F.col("before") + F.col("within"))
    return run.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("event_type").agg(F.min("value").alias("median"))


MEDIAN_SQL = f"WITH {E} SELECT event_type, list(value ORDER BY value)[count(*)//2 + 1] AS median FROM e GROUP BY event_type"


def run_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    out = e.groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "purchase").alias("with_face"), F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("boxes"), (F.max("ms") - F.min("ms")).alias("elapsed_ms"))
    return out.withColumn("fps", F.round(F.coalesce(F.try_divide(F.col("frames") * 1000, F.col("elapsed_ms")), F.lit(0.0)), 9))


SUMMARY_SQL = f"""WITH {E}, s AS (SELECT user_id, count(*) AS frames, count(*) FILTER (event_type='purchase') AS with_face, count(*) FILTER (value > 0) AS boxes, max(ms)-min(ms) AS elapsed_ms FROM e GROUP BY user_id)
SELECT *, round(CASE WHEN elapsed_ms = 0 THEN 0 ELSE CAST(frames*1000 AS DOUBLE)/elapsed_ms END, 9) AS fps FROM s"""

ENDS = {"purchase": "done", "error": "error", "signup": "cancelled"}
LIMIT_MS = 86_400_000


def job_watchdog(spark, sf_dir):
    """The state of each job, its first ending event deciding; silent running jobs are timed out. A job is an hour of a user."""
    e = events(spark, sf_dir)
    jobs = e.select(F.concat_ws("-", "user_id", F.expr("ms div 3600000")).alias("job_id"), "ms", F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    now = e.agg(F.max("ms").alias("now"))  # one row
    return watched(final_states(jobs, ENDS).join(F.broadcast(now)), F.col("now"), LIMIT_MS).drop("now")


WATCHDOG_SQL = f"""WITH {E}, j AS (SELECT user_id || '-' || ms // 3600000 AS job_id, ms, event_id, event_type FROM e), s AS (SELECT job_id, max(ms) AS last_ms,
min({{'ms': ms, 'seq': event_id, 'state': CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'cancelled' END}}) FILTER (event_type IN ('purchase', 'error', 'signup')) AS f FROM j GROUP BY job_id)
SELECT job_id, CASE WHEN f IS NULL AND (SELECT max(ms) FROM e) - last_ms > {LIMIT_MS} THEN 'timed_out' ELSE coalesce(f.state, 'running') END AS status, f.ms AS at_ms, last_ms FROM s"""

QUERIES = {
    "job_watchdog": (job_watchdog, WATCHDOG_SQL),
    "temporal_clusters": (temporal_clusters, CLUSTERS_SQL), "moving_fps": (moving_fps, FPS_SQL), "frame_sampling": (frame_sampling, SAMPLING_SQL), "keepalive_frames": (keepalive_frames, KEEPALIVE_SQL), "timeline_marks": (timeline_marks, MARKS_SQL),
    "face_frame_browser": (face_frame_browser, BROWSER_SQL), "json_payload": (json_payload, JSON_SQL), "replay_from": (replay_from, REPLAY_SQL), "upper_median": (upper_median, MEDIAN_SQL), "run_summary": (run_summary, SUMMARY_SQL),
}
