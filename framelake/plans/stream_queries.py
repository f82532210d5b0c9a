"""Streams run over the table that is there; their SQL is the batch query of the same result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import job_stream as s
from ..streaming import keyed_state as k
from .event_queries import DISTANCE, GAP_MS


#: Micro-batches' worth of files, and by how much a row may come after its time.
SLICES, DELAY = 8, 3_000_000


def shuffled_stream(spark, sf_dir):
    """``events`` as a stream of several micro-batches whose rows come in no order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return k.stream_of(spark, k.arriving(rows, F.xxhash64("event_id"), SLICES), rows.schema)


def stream_counts(spark, sf_dir):
    """Counters by job, carried on from micro-batch to micro-batch."""
    return s.last_update(s.run_to_table(s.counters(shuffled_stream(spark, sf_dir)), "update"), "user_id")


COUNTS_SQL = "SELECT user_id, count(*) AS processed, count(*) FILTER (event_type = 'purchase') AS with_face, count(*) FILTER (value > 0) AS boxes FROM events GROUP BY user_id"


def stream_job_state(spark, sf_dir):
    return s.last_update(s.run_to_table(s.job_states(shuffled_stream(spark, sf_dir)), "update"), "user_id")


STATE_SQL = "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'running' END AS status, count(*) AS seen FROM events GROUP BY user_id"

#: Milliseconds without an event after which a job has stalled, and how far behind the newest event the watermark is.
SILENT, LATE = 86_400_000, 3_600_000


def stream_watchdog(spark, sf_dir):
    """Jobs that have been silent for a day, by event-time timers; every 300th event ends its job."""
    return s.last_update(s.run_to_table(s.watched(s.event_stream(spark, sf_dir), F.col("event_id") % 300 == 0, SILENT), "update"), "user_id")


WATCHDOG_SQL = f"""WITH j AS (SELECT user_id, bool_or(event_id % 300 = 0) AS done, max(epoch_ms(ts)) AS last, count(*) AS seen FROM events GROUP BY user_id), n AS (SELECT max(epoch_ms(ts)) - {LATE} AS mark FROM events)
SELECT user_id, CASE WHEN done THEN 'done' WHEN last + {SILENT} < mark THEN 'stalled' ELSE 'running' END AS status, seen FROM j, n"""

def numbered(spark, sf_dir):
    """``events`` with ``ms`` and ``seq``, the place within the user, from 0."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("ms", F.unix_millis("ts"))
    return e.withColumn("seq", (F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "event_id")) - 1).cast("long"))


def delayed():
    """When a row comes: its time and up to DELAY milliseconds more, by a rule."""
    return F.col("ms") + F.col("event_id") * 7919 % DELAY


def stream_in_order(spark, sf_dir):
    """Frames that come in any order, in several micro-batches, and go out in the order of their numbers; ``place`` counts what a job has put out."""
    rows = numbered(spark, sf_dir).select("user_id", "seq", "event_id")
    path = k.arriving(rows, F.xxhash64("event_id"), SLICES)
    out = s.run_to_table(k.in_order(k.stream_of(spark, path, rows.schema), "user_id"), "append")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("batch", "seq")) - 1
    return out.select("user_id", "seq", "event_id", place.cast("long").alias("place"))


ORDER_SQL = "SELECT user_id, seq, event_id, seq AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS seq FROM events)"

#: Milliseconds from a job's start until it is cancelled, by kind.
LIMITS = {"image": 36 * 3_600_000, "video": 240 * 3_600_000, "stream": 0}


def stream_job_life(spark, sf_dir):
    """The last state of every job: a purchase starts it, every 97th event ends it in one of three ways, event-time timers cancel it by kind."""
    last = F.col("event_id") % 97
    type_ = F.when(last == 0, "done").when(last == 1, "error").when(last == 2, "cancel").when(F.col("event_type") == "purchase", "start").otherwise("frame")
    kind = F.element_at(F.array(*map(F.lit, LIMITS)), (F.col("user_id") % 3 + 1).cast("int"))
    rows = numbered(spark, sf_dir).select("user_id", "ts", "ms", F.col("event_id").alias("seq"), kind.alias("kind"), type_.alias("type"), "event_id")
    path = k.arriving(rows, delayed(), SLICES)
    states = k.job_life(k.stream_of(spark, path, rows.schema), "user_id", LIMITS)
    return s.last_update(s.run_to_table(states, "update").withColumn("batch", F.struct("batch", "seen", "at_ms")), "user_id")


LIFE_SQL = f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_id % 97 AS last, event_type FROM events),
j AS (SELECT user_id, count(*) AS seen, min(CASE WHEN last > 2 AND event_type = 'purchase' THEN ms END) AS start, min(CASE WHEN last < 3 THEN ms END) AS finish, arg_min(CASE WHEN last = 0 THEN 'done' WHEN last = 1 THEN 'error' ELSE 'cancelled' END, (ms, event_id)) FILTER (last < 3) AS status,
CASE user_id % 3 WHEN 0 THEN {LIMITS["image"]} WHEN 1 THEN {LIMITS["video"]} END AS lim FROM e GROUP BY user_id),
m AS (SELECT max(ms) - {LATE} AS mark FROM e),
t AS (SELECT *, start + lim AS due FROM j, m)
SELECT user_id, CASE WHEN late THEN 'cancelled' WHEN finish IS NOT NULL THEN status WHEN start IS NOT NULL THEN 'running' ELSE 'queued' END AS status, CASE WHEN late THEN due WHEN finish IS NOT NULL THEN finish ELSE start END AS at_ms, seen
FROM (SELECT *, coalesce(CASE WHEN finish IS NULL THEN due < mark ELSE finish > due END, false) AS late FROM t)"""


def stream_clusters(spark, sf_dir):
    """Runs of faces close in time and place, from a stream whose rows come late and out of order; those that the last watermark makes certain."""
    rows = numbered(spark, sf_dir).select("user_id", "ts", "ms", F.col("event_id").alias("id"), "value", "event_id")
    path = k.arriving(rows, delayed(), SLICES)
    return s.run_to_table(k.clusters(k.stream_of(spark, path, rows.schema), "user_id", GAP_MS, DISTANCE), "append").drop("batch")


CLUSTERS_SQL = f"""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) // 1000 AS ms FROM events), m AS (SELECT max(ms) - {LATE} AS mark FROM e),
f AS (SELECT *, coalesce(CAST(ms - lag(ms) OVER w >= {GAP_MS} OR abs(value - lag(value) OVER w) >= {DISTANCE} AS INT), 1) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS BIGINT) AS run FROM f),
c AS (SELECT user_id, run, count(*) AS n, min(ms) AS from_ms, max(ms) AS to_ms, list(event_id ORDER BY ms, event_id)[count(*)//2 + 1] AS stands FROM r GROUP BY user_id, run),
n AS (SELECT *, lead(from_ms) OVER (PARTITION BY user_id ORDER BY run) AS next_ms FROM c)
SELECT user_id, run, n, from_ms, to_ms, stands FROM n, m WHERE to_ms + {GAP_MS} <= mark OR next_ms < mark"""

#: Hours of a slice of the replay, slices to a micro-batch (files), and how late a row may be.
SLICE_HOURS, TOGETHER, REPLAY_LATE_H = 72, 2, 24


def stream_replay(spark, sf_dir):
    """Events that a client is still to be sent, each once: a user's first ``user_id % 20`` are seen already; every 10th event comes twice, every 49th some slices too late.

    Spark holds rows against the watermark of the batch before the last one."""
    rows = numbered(spark, sf_dir).select("user_id", "seq", "event_id", "ts", "ms")
    first = rows.agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    base = rows.join(F.broadcast(first)).withColumn("slice", F.expr(f"cast((ms - first) div {SLICE_HOURS * 3_600_000} as int)"))
    last = int(base.agg(F.max("slice")).first()[0])
    slices = F.least(F.col("slice") + F.when(F.col("event_id") % 49 == 0, 4).otherwise(0), F.lit(last))
    came = base.withColumn("slice", slices).select("user_id", "seq", "event_id", "ts", "slice")
    came = came.unionByName(came.where("event_id % 10 = 0"))
    path = k.arriving_in(came, "slice", last + 1)
    seen = rows.select("user_id").distinct().select("user_id", (F.col("user_id") % 20 - 1).alias("upto"))
    live = k.stream_of(spark, path, came.drop("slice").schema, TOGETHER)
    return s.run_to_table(k.replayed(live, seen, "user_id", f"{REPLAY_LATE_H} hours"), "append").select("user_id", "seq", "event_id")


REPLAY_SQL = f"""WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS seq FROM events),
s AS (SELECT *, (ms - min(ms) OVER ()) // {SLICE_HOURS * 3_600_000} AS own FROM e), l AS (SELECT max(own) AS last FROM s),
a AS (SELECT user_id, event_id, ts, seq, least(own + CASE WHEN event_id % 49 = 0 THEN 4 ELSE 0 END, last) // {TOGETHER} AS batch FROM s, l WHERE seq > user_id % 20 - 1),
m AS (SELECT batch, max(ts) AS newest FROM a GROUP BY batch),
w AS (SELECT a.*, (SELECT max(newest) FROM m WHERE m.batch < a.batch - 1) - INTERVAL {REPLAY_LATE_H} HOUR AS mark FROM a)
SELECT user_id, seq, event_id FROM w WHERE mark IS NULL OR ts > mark"""

QUERIES = {
    "stream_replay": (stream_replay, REPLAY_SQL),
    "stream_counts": (stream_counts, COUNTS_SQL), "stream_job_state": (stream_job_state, STATE_SQL), "stream_watchdog": (stream_watchdog, WATCHDOG_SQL),
    "stream_in_order": (stream_in_order, ORDER_SQL), "stream_job_life": (stream_job_life, LIFE_SQL), "stream_clusters": (stream_clusters, CLUSTERS_SQL),
}
