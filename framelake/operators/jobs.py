"""Operators on the job store: jobs, their frames, the frames' faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, FAILED, TERMINAL = ("queued", "running"), ("error", "cancelled"), ("done", "cancelled", "error")


def algo_stats(jobs: DataFrame) -> DataFrame:
    """Per algorithm ("pending" where none is known): finished jobs by outcome, active ones, time of finished jobs, boxes."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    out = jobs.groupBy(F.coalesce(F.nullif("algo", F.lit("")), F.lit("pending")).alias("algo")).agg(
        count(*TERMINAL).alias("total"), count("done").alias("done"), count("cancelled").alias("cancelled"), count("error").alias("error"), count(*ACTIVE).alias("active"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*TERMINAL), F.col("elapsed_ms"))), F.lit(0)).alias("elapsed_ms"), F.sum("detections").alias("detections"),
    )
    return out.withColumn("avg_elapsed_ms", F.expr("coalesce(elapsed_ms div nullif(total, 0), 0)"))


def metrics(jobs: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return jobs.agg(count("running").alias("running"), count("queued").alias("queued"), count("error").alias("errored"), count("cancelled").alias("cancelled"), total("frames_processed").alias("total_frames_processed"), total("frames_with_face").alias("total_frames_with_face"), total("detections").alias("total_detections"))


def page(jobs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first, ties by id, with the number of all jobs."""
    total = jobs.agg(F.count("*").alias("total_jobs"))
    rows = jobs.orderBy(F.desc("created_ms"), "id").offset(offset).limit(limit)
    return rows.join(F.broadcast(total))


def group_of(status: Column) -> Column:
    return F.when(status.isin(*ACTIVE), "running").when(status == "done", "done").otherwise("error")


def search(jobs: DataFrame, term: str | None = None, regex: bool = False, group: str | None = None, algo: str | None = None, since_ms: int = 0) -> DataFrame:
    """Jobs by status group, algorithm, age and a term in name or id; an invalid regular expression is taken literally."""
    from ..functions.text import literal_regex

    out = jobs.where(F.col("created_ms") >= since_ms)
    out = out.where(group_of(F.col("status")) == group) if group else out
    out = out.where(F.col("algo") == algo) if algo else out
    if not term:
        return out
    hit = (lambda c: c.rlike("(?i)" + literal_regex(term))) if regex else (lambda c: F.contains(F.lower(c), F.lit(term.lower())))
    return out.where(hit(F.col("display_name")) | hit(F.col("id").cast("string")))


def hourly(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """Jobs of the last 24 hours by age, bucket 23 the newest, empty buckets as 0."""
    aged = jobs.select(F.floor((now_ms - F.col("created_ms")) / 3600000).alias("age")).where("age >= 0 and age < 24")
    counts = aged.groupBy((23 - F.col("age")).alias("bucket")).agg(F.count("*").alias("n"))
    every = jobs.sparkSession.range(24).withColumnRenamed("id", "bucket")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def detail(jobs: DataFrame, frames: DataFrame, faces: DataFrame) -> DataFrame:
    """Every job with its frames and faces counted, jobs without frames too, and the key of its cover: the first annotated frame's, else the original."""
    per_frame = faces.groupBy("job_id", "idx").agg(F.count("*").alias("n_faces"), F.max("score").alias("top"))
    per_job = frames.join(per_frame, ["job_id", "idx"], "left").groupBy("job_id").agg(
        F.count("*").alias("n_frames"), F.count("n_faces").alias("n_face_frames"), F.coalesce(F.sum("n_faces"), F.lit(0)).alias("n_faces"), F.max("top").alias("top_score"), F.min_by("annotated_key", F.when(F.col("annotated_key").isNotNull(), F.col("idx"))).alias("cover"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return jobs.join(per_job, jobs["id"] == per_job["job_id"], "left").select("id", zero("n_frames"), zero("n_face_frames"), zero("n_faces"), "top_score", F.coalesce("cover", "original_key").alias("cover_key"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key: an upsert in which later writes win. Combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; of equal new keys the first write by ``order``, without it any one."""
    if order:
        rest = [c for c in new.columns if c not in keys]
        first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    else:
        first = new.dropDuplicates(keys)
    return old.unionByName(first.join(old.select(*keys).hint("merge"), keys, "left_anti"))


def admitted(jobs: DataFrame, limit: int, key: str) -> DataFrame:
    """Active jobs by arrival within ``key``: whether they run, wait or are turned away."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("created_ms", "id"))
    state = F.when(F.col("at") <= limit, "run").when(F.col("at") <= 3 * limit, "wait").otherwise("reject")
    return jobs.where(F.col("status").isin(*ACTIVE)).withColumn("at", at).select(key, "id", "at", state.alias("state"))


def retry_rule(kind: Column, original_input: Column) -> Column:
    """``retry``, or why a job can't be run again: it has no input of its own, or it is an image, which is to be sent anew."""
    return F.when(original_input.isNull(), "no original input").when(kind == "image", "image retry requires a new upload").otherwise("retry")


def config_status(use_network: Column, weights: Column, weights_there: Column, cascade_there: Column) -> Column:
    """``mode``, ``weights_status`` and ``cascade_status`` of a configuration: the network counts if it is switched on or has a weight file named."""
    wanted = F.coalesce(use_network, F.lit(False)) | weights.isNotNull()
    status = F.when(~wanted, "n/a").when(weights.isNull(), "template").when(weights_there, "available").otherwise("missing")
    return F.struct(F.when(wanted, "cnn").otherwise("haar").alias("mode"), status.alias("weights_status"), F.when(cascade_there, "available").otherwise("missing").alias("cascade_status"))


def batch_operation(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a batch of requests (``id``, ``op``) makes of the jobs: their rows with ``archived`` and ``removed``, and ``exported``.

    ``op`` is delete (also where it is null), archive or export; others change nothing. A job that is asked for more than once is dealt
    with by all that was asked; a deleted one is cancelled first if it is active. Requests for ids that are not there count for nothing.
    """
    op = F.coalesce("op", F.lit("delete"))
    asked = wanted.where("id is not null").groupBy("id").agg(*(F.max(op == name).alias(f"_{name}") for name in ("delete", "archive", "export")))
    flag = lambda name: F.coalesce(f"_{name}", F.lit(False))
    status = F.when(flag("delete") & F.col("status").isin(*ACTIVE), "cancelled").otherwise(F.col("status"))
    out = jobs.join(asked, "id", "left").withColumn("status", status)
    return out.select(*jobs.columns, flag("archive").alias("archived"), flag("delete").alias("removed"), flag("export").alias("exported"))


def final_states(events: DataFrame, ends: dict[str, str]) -> DataFrame:
    """``job_id``, ``status``, ``at_ms``, ``last_ms`` of every job of ``events`` (``job_id``, ``ms``, ``seq``, ``type``).

    A job is running until its first event of a type in ``ends``, whose state it then keeps; later events change nothing.
    """
    kind = F.lit(None).cast("string")
    for name, state in ends.items():
        kind = F.when(F.col("type") == name, state).otherwise(kind)
    first = F.min(F.when(kind.isNotNull(), F.struct("ms", "seq", kind.alias("state")))).alias("first")
    found = events.groupBy("job_id").agg(first, F.max("ms").alias("last_ms"))
    return found.select("job_id", F.coalesce("first.state", F.lit("running")).alias("status"), F.col("first.ms").alias("at_ms"), "last_ms")


def watched(states: DataFrame, now_ms: Column, limit_ms: int) -> DataFrame:
    """``states`` in which running jobs without an event for more than ``limit_ms`` are timed out."""
    late = (F.col("status") == "running") & (now_ms - F.col("last_ms") > limit_ms)
    return states.withColumn("status", F.when(late, "timed_out").otherwise(F.col("status")))


def in_order(events: DataFrame, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a micro-batch that may go out, and those that wait: ``seq`` runs from 0 in each job without a gap.

    ``done``: ``job_id`` and ``upto``, the number that is next. A job's rows are numbered by a window; only the rows before
    its first gap go out.
    """
    rows = events.withColumn("upto", F.lit(0).cast("long")) if done is None else events.join(done, "job_id", "left").withColumn("upto", F.coalesce("upto", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("seq")) - 1
    rows = rows.where("seq >= upto").withColumn("ready", F.col("seq") == F.col("upto") + place)
    return rows.where("ready").drop("upto", "ready"), rows.where("not ready").drop("upto", "ready")
