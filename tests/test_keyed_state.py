"""State across micro-batches: order, restarts, timers of both kinds, clusters that late rows change."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from framelake.streaming import keyed_state as k


class Feed:
    """A folder that gets files one after another, and runs of a query over what is new, with one checkpoint."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.schema, self.dir = spark, schema, tmp_path
        (tmp_path / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.dir / "in"))

    def run(self, make, mode="append"):
        got = []
        stream = make(k.stream_of(self.spark, str(self.dir / "in"), self.spark.createDataFrame([], self.schema).schema, files=1))
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(self.dir / "check")).foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        return got


    def until(self, make, enough, seconds=60):
        """Run by the clock until ``enough`` of what came out; ids and states, sorted within a batch."""
        got = []
        query = make(k.stream_of(self.spark, str(self.dir / "in"), self.spark.createDataFrame([], self.schema).schema)).writeStream.outputMode("update").option("checkpointLocation", str(self.dir / "check"))
        query = query.foreachBatch(lambda df, n: got.extend(sorted((r.job, r.status) for r in df.collect()))).trigger(processingTime="500 milliseconds").start()
        end = time.time() + seconds
        while not enough(got) and time.time() < end and query.isActive:
            time.sleep(0.2)
        query.stop()
        return got


def test_order_holds_over_batches_and_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "job long, seq long, text string")
    make = lambda s: k.in_order(s, "job")
    feed.add([(1, 2, "c"), (1, 0, "a"), (2, 1, "y")])
    assert [(r.job, r.seq, r.text) for r in feed.run(make)] == [(1, 0, "a")]
    feed.add([(1, 1, "b"), (1, 0, "again"), (1, 4, "e"), (1, 4, "e")])
    assert [(r.job, r.seq, r.text) for r in feed.run(make)] == [(1, 1, "b"), (1, 2, "c")]
    feed.add([(2, 0, None), (1, 2, "late repeat")])
    assert [(r.job, r.seq, r.text) for r in feed.run(make)] == [(2, 0, None), (2, 1, "y")]
    assert feed.run(make) == []
    feed.add([(1, 3, "d")])
    assert [(r.job, r.seq, r.text) for r in feed.run(make)] == [(1, 3, "d"), (1, 4, "e")]


def at(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)


LIFE = "job long, ts timestamp, ms long, seq long, kind string, type string"


def rows_of(*events):
    return [(job, at(ms), ms, seq, kind, type_) for seq, (job, ms, kind, type_) in enumerate(events)]


def test_five_states_by_event_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, LIFE)
    limits = {"image": 10_000, "stream": 0}
    make = lambda s: k.job_life(s, "job", limits, late="1 second")
    feed.add(rows_of((1, 1000, "image", "frame"), (2, 1000, "image", "start"), (3, 1000, "image", "start"), (3, 5000, "image", "error"), (4, 900, "image", "cancel"), (5, 1000, "stream", "start"), (6, 1000, "image", "start"), (6, 9000, "image", "done"), (6, 9001, "image", "error")))
    states = lambda got: {r.job: r.status for r in sorted(got, key=lambda r: r.seen)}
    assert states(feed.run(make, "update")) == {1: "queued", 2: "running", 3: "error", 4: "cancelled", 5: "running", 6: "done"}
    feed.add(rows_of((7, 60_000, "image", "start"),))
    again = feed.run(make, "update")
    assert states(again) == {2: "cancelled", 7: "running"} and next(r.at_ms for r in again if r.job == 2) == 11_000
    assert feed.run(make, "update") == []


def test_a_timer_fires_by_the_clock(spark, tmp_path):
    """Two runs with one checkpoint: the first sees the start, the second, without any new row, the end of the time allowed."""
    feed = Feed(spark, tmp_path, LIFE)
    make = lambda s: k.job_life(s, "job", {"image": 1500, "video": 3_600_000}, late=None)
    now = int(time.time() * 1000)
    feed.add(rows_of((1, now, "image", "start"), (2, now, "video", "start")))
    assert feed.until(make, lambda got: len(got) >= 2)[:2] == [(1, "running"), (2, "running")]
    time.sleep(2)
    assert feed.until(make, lambda got: got)[-1] == (1, "cancelled")


POINTS = "key long, ts timestamp, ms long, id long, value double"


def test_late_points_close_gaps_and_split_runs(spark, tmp_path):
    feed = Feed(spark, tmp_path, POINTS)
    make = lambda s: k.clusters(s, "key", 2000, 140.0, late="10 seconds")
    point = lambda ms, i, v=0.0: (1, at(ms), ms, i, v)
    feed.add([point(1000, 1), point(2000, 2), point(5000, 3), point(9000, 4, 1.0), point(10_500, 5, 2.0)])
    assert feed.run(make) == []
    feed.add([point(3500, 6), point(9500, 7, 500.0)])  # joins the first two runs; parts the last one
    assert feed.run(make) == []
    feed.add([point(40_000, 8)])
    got = sorted((r.run, r.n, r.from_ms, r.to_ms, r.stands) for r in feed.run(make))
    assert got == [(1, 4, 1000, 5000, 6), (2, 1, 9000, 9000, 4), (3, 1, 9500, 9500, 7), (4, 1, 10_500, 10_500, 5)]
    feed.add([point(2500, 9), point(41_000, 10)])  # the first is beyond the watermark
    assert feed.run(make) == []
    feed.add([point(90_000, 11)])
    assert [(r.run, r.n, r.from_ms, r.to_ms) for r in feed.run(make)] == [(5, 2, 40_000, 41_000)]


@pytest.mark.parametrize("slices", [3])
def test_arrival_is_in_order(spark, slices):
    rows = spark.range(30).select("id", F.lit(1).alias("x"))
    path = k.arriving(rows, F.col("id"), slices)
    files = sorted({(r.t, r.f): None for r in spark.read.parquet(path).select("_metadata.file_modification_time", "_metadata.file_name").toDF("t", "f").collect()})
    seen = [sorted(r.id for r in spark.read.parquet(f"{path}/{f}").collect()) for _, f in files]
    assert [x for s in seen for x in s] == list(range(30)) and len(files) == slices
