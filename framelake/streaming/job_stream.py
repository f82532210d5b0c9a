"""The job flow as streams: counters by job, the state of each job, and a sink that writes each frame once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.tables import new_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path + "*")


def counters(events: DataFrame) -> DataFrame:
    """Processed, with a face, boxes, by job; partial sums before the shuffle, one state row a job."""
    return events.groupBy("user_id").agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "purchase").alias("with_face"), F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("boxes"))


def job_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """queued until the first event, running until a purchase, then done; later events change nothing."""
    status, seen = state.get if state.exists else ("queued", 0)
    for batch in batches:
        seen += len(batch)
        if status != "done":
            status = "done" if (batch["event_type"] == "purchase").any() else "running"
    state.update((status, seen))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "seen": [seen]})


def job_states(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(job_state, "user_id long, status string, seen long", "status string, seen long", "update", GroupStateTimeout.NoTimeout)


def watched(events: DataFrame, ends: Column, silent_ms: int, late: str = "1 hour") -> DataFrame:
    """``user_id``, ``status``, ``seen``: running, done after an event that ``ends`` the job, or stalled after ``silent_ms`` without an event.

    Time is the events' own: a job has stalled when the watermark, ``late`` behind the newest event, has passed its last
    event by more than ``silent_ms``. A job that speaks again runs again. One state row a job, dropped when it stalls.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seen, last = state.get if state.exists else ("running", 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "status": ["stalled"], "seen": [seen]})
            return
        for batch in batches:
            seen, last = seen + len(batch), max(last, int(batch["at"].max()))
            if batch["ends"].any():
                status = "done"
        state.update((status, seen, last))
        if status != "done":
            state.setTimeoutTimestamp(max(last + silent_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "seen": [seen]})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("at"), ends.alias("ends"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, seen long", "status string, seen long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there; every micro-batch is a folder of its own, so a repeated batch replaces itself."""
    spark, out, checkpoint = df.sparkSession, new_path(df.sparkSession, "stream"), new_path(df.sparkSession, "checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(out)


def last_update(updates: DataFrame, key: str) -> DataFrame:
    """The last micro-batch's row of each key."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
