"""Keyed state across micro-batches: a reorder buffer, the life of a job with timers, clusters that late rows may join.

Each is a :class:`~pyspark.sql.streaming.StatefulProcessor` over one key's rows; state lives in the state store, is bounded by what
is still open, and a query that starts again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..plans.tables import materialise, new_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def need_rocks(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB; the default provider has no typed state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Reorder(StatefulProcessor):
    """Rows of a key in the order of ``seq``, from 0 without a gap. Rows ahead of their turn wait; those that were out before are repeats and are dropped."""

    def __init__(self, key: str, columns: list[str], schema: StructType):
        self.key, self.columns, self.schema = key, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", StructType([self.schema[c] for c in self.columns if c != "seq"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).drop_duplicates("seq").set_index("seq", drop=False).sort_index()
        upto = first = self.next.get()[0] if self.next.exists() else 0
        rest = [c for c in self.columns if c != "seq"]
        out: dict[str, list] = {c: [] for c in self.columns}
        own = {int(r[self.columns.index("seq")]): r for r in held[self.columns].itertuples(index=False, name=None) if r[self.columns.index("seq")] >= upto}
        while True:
            row = own.pop(upto, None)
            if row is not None:
                for c, v in zip(self.columns, row, strict=True):
                    out[c].append(v)
            elif (kept := self.waiting.getValue((upto,)) if self.waiting.containsKey((upto,)) else None) is not None:
                self.waiting.removeKey((upto,))
                out["seq"].append(upto)
                for c, v in zip(rest, kept, strict=True):
                    out[c].append(v)
            else:
                break
            upto += 1
        for seq, row in own.items():
            self.waiting.updateValue((seq,), tuple(_plain(v) for c, v in zip(self.columns, row, strict=True) if c != "seq"))
        if upto > first:
            self.next.update((upto,))
        if out["seq"]:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in {self.key: [key[0]] * len(out["seq"]), **out}.items()})

    def close(self) -> None:
        pass


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def in_order(stream: DataFrame, key: str) -> DataFrame:
    """The rows of ``stream`` (``key``, ``seq``, others), each key's in the order of ``seq`` across micro-batches, gapless from 0.

    Rows wait in the state until all before them have come; a number that comes twice goes out once. Keys with a null ``seq`` are
    not to be given.
    """
    need_rocks(stream.sparkSession)
    rest = [c for c in stream.columns if c != key]
    schema = StructType([stream.schema[c] for c in (key, *rest)])
    return stream.groupBy(key).transformWithStateInPandas(Reorder(key, rest, stream.schema), schema, "Append", "None")


STARTED, ENDS = "start", {"done": "done", "error": "error", "cancel": "cancelled"}
LIFE = "status string, at_ms long, seen long"


class JobLife(StatefulProcessor):
    """A job's state by its earliest events: queued, running from its start, then done, error or cancelled; cancelled, too, when its
    time is up. A timer stands at the job's deadline, and moves when an earlier start comes late."""

    def __init__(self, key: str, limits: dict[str, int]):
        self.key, self.limits = key, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", "kind string, start long, finish long, seq long, status string, seen long, timer long, expired boolean")

    def told(self, key, life: tuple) -> pd.DataFrame:
        kind, start, finish, _, status, seen, timer, expired = life
        late = timer is not None and (expired or finish is not None) and (finish is None or finish > timer)
        now, at = ("cancelled", timer) if late else (status, finish) if finish is not None else ("running", start) if start is not None else ("queued", None)
        return pd.DataFrame({self.key: [key[0]], "status": [now], "at_ms": pd.array([at], dtype="Int64"), "seen": [seen]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, start, finish, seq, status, seen, timer, expired = self.state.get() if self.state.exists() else (None, None, None, None, None, 0, None, False)
        for batch in rows:
            seen += len(batch)
            kind = kind or next((k for k in batch["kind"] if isinstance(k, str)), None)
            begun = batch.loc[batch["type"] == STARTED, "ms"]
            if len(begun):
                start = int(begun.min()) if start is None else min(start, int(begun.min()))
            ended = batch[batch["type"].isin(list(ENDS))].sort_values(["ms", "seq"])
            if len(ended):
                first = ended.iloc[0]
                if finish is None or (int(first["ms"]), int(first["seq"])) < (finish, seq):
                    finish, seq, status = int(first["ms"]), int(first["seq"]), ENDS[first["type"]]
        limit = self.limits.get(kind or "", 0)
        deadline = start + limit if start is not None and limit else None
        if deadline != timer:
            if timer is not None and not expired:
                self.handle.deleteTimer(timer)
            if deadline is not None:
                self.handle.registerTimer(max(deadline, timerValues.getCurrentWatermarkInMs()) + 1)
            timer, expired = deadline, False
        life = kind, start, finish, seq, status, seen, timer, expired
        self.state.update(life)
        yield self.told(key, life)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            before = self.state.get()
            self.state.update((*before[:-1], True))
            if before[2] is None:  # a job that has ended is not told again
                yield self.told(key, (*before[:-1], True))

    def close(self) -> None:
        pass


def job_life(events: DataFrame, key: str, limits: dict[str, int], late: str | None = "1 hour") -> DataFrame:
    """``key``, ``status``, ``at_ms`` and ``seen``, an update whenever a job's rows come or its time is up.

    ``events``: ``key``, ``ts``, ``ms``, ``seq``, ``kind`` and ``type`` (``start``, ``done``, ``error``, ``cancel``; others only count). ``limits``: by
    kind, milliseconds from the start until a job is cancelled; 0 is no limit. Timers go by event time, ``late`` behind the newest
    event; with ``late`` None they go by the clock, and ``ms`` must be the clock's, too. The earliest end counts, whatever the order in
    which events come; an end after the deadline finds the job cancelled.
    """
    need_rocks(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(key).transformWithStateInPandas(JobLife(key, limits), f"{key} {kind}, {LIFE}", "Update", "EventTime" if late else "ProcessingTime")


CLUSTER = "run long, n long, from_ms long, to_ms long, stands long"


class Clusters(StatefulProcessor):
    """Runs of points close to the one before in time and place. Points are held until the watermark makes their run certain: no
    earlier point of the next run can come, or none within the gap. Late points within the watermark join, close a gap or split a run."""

    def __init__(self, key: str, gap_ms: int, distance: float):
        self.key, self.gap, self.distance = key, gap_ms, distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "ms long, id long, value double")
        self.count = handle.getValueState("count", "runs long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(m), int(i), float(v)) for batch in rows for m, i, v in zip(batch["ms"], batch["id"], batch["value"], strict=True)]
        yield self.settled(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settled(key, [], timerValues)

    def settled(self, key, fresh: list[tuple], timerValues) -> pd.DataFrame:
        mark = timerValues.getCurrentWatermarkInMs()
        points = sorted(set(tuple(p) for p in self.open.get()) | set(fresh)) if self.open.exists() else sorted(set(fresh))
        runs: list[list[tuple]] = []
        for p in points:
            before = runs[-1][-1] if runs else None
            if before and p[0] - before[0] < self.gap and abs(p[2] - before[2]) < self.distance:
                runs[-1].append(p)
            else:
                runs.append([p])
        sure = 0
        while sure < len(runs) and (runs[sure][-1][0] + self.gap <= mark or sure + 1 < len(runs) and runs[sure + 1][0][0] < mark):
            sure += 1
        left = [p for run in runs[sure:] for p in run]
        if sure or fresh:
            self.open.put(left) if left else self.open.clear()
        if left:
            wake = min(runs[sure][-1][0] + self.gap, runs[sure + 1][0][0] + 1 if sure + 1 < len(runs) else 2**62)
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(wake, mark + 1))
        first = self.count.get()[0] if self.count.exists() else 0
        if sure:
            self.count.update((first + sure,))
        done = [(key[0], first + k + 1, len(r), r[0][0], r[-1][0], r[len(r) // 2][1]) for k, r in enumerate(runs[:sure])]
        return pd.DataFrame(done, columns=[self.key, "run", "n", "from_ms", "to_ms", "stands"]).astype({c: "int64" for c in ("run", "n", "from_ms", "to_ms", "stands")})

    def close(self) -> None:
        pass


def clusters(points: DataFrame, key: str, gap_ms: int, distance: float, late: str = "1 hour") -> DataFrame:
    """``key``, ``run`` (from 1), ``n``, ``from_ms``, ``to_ms`` and ``stands`` (the middle point's id) of the runs of ``points`` that are certain.

    ``points``: ``key``, ``ts``, ``ms``, ``id``, ``value``. A point belongs to the run before it if it is less than ``gap_ms`` later and less than
    ``distance`` away than the point before it. Rows later than the watermark, ``late`` behind the newest, are dropped by Spark. A
    run comes out once, when the watermark has passed its end by the gap or passed the first point of the next run.
    """
    need_rocks(points.sparkSession)
    kind = points.schema[key].dataType.simpleString()
    timed = points.withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(Clusters(key, gap_ms, distance), f"{key} {kind}, {CLUSTER}", "Append", "EventTime")


def arriving(rows: DataFrame, arrival: Column, slices: int) -> str:
    """A folder of ``slices`` sets of files that hold ``rows`` in the order of ``arrival``, written one after the other, as a source would."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "arriving")
    cut = materialise(rows.withColumn("_at", arrival).repartitionByRange(slices, "_at").withColumn("_slice", F.spark_partition_id()).drop("_at"), "slices")
    for k in range(slices):
        cut.where(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(path)
    return path


def arriving_in(rows: DataFrame, slice_col: str, slices: int) -> str:
    """As :func:`arriving`, where a column says in which slice, from 0, a row comes."""
    path = new_path(rows.sparkSession, "arriving")
    held = materialise(rows.repartition(F.col(slice_col)), "slices")
    for k in range(slices):
        held.where(F.col(slice_col) == k).drop(slice_col).coalesce(1).write.mode("append").parquet(path)
    return path


def replayed(events: DataFrame, seen: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """What a client that comes back is still to be sent: rows of ``events`` (``key``, ``seq``, ``ts``, others) behind the number that ``seen``
    (``key``, ``upto``) holds, first the history, then what comes live, each once.

    A key that ``seen`` lacks begins at the start. Repeats of (``key``, ``seq``) within the watermark, ``late`` behind the newest event, are
    dropped, and so are rows later than it, as it stood one batch ago: :func:`late_rows` counts these, and ``observe`` counts all that came.
    """
    left = events.join(seen.select(key, "upto"), key, "left").where(F.col("upto").isNull() | (F.col("seq") > F.col("upto"))).drop("upto")
    return left.withWatermark("ts", late).observe("came", F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_seq")).dropDuplicatesWithinWatermark([key, "seq"])


def late_rows(query) -> int:
    """Rows that a finished query dropped because they came after the watermark."""
    return sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)


def came(query) -> int:
    """Rows that :func:`replayed` was given, as observed batch by batch."""
    return sum(int(p.observedMetrics["came"]["rows"]) for p in query.recentProgress if "came" in p.observedMetrics)


def stream_of(spark: SparkSession, path: str, schema: StructType, files: int = 2) -> DataFrame:
    """The files of ``path`` as a stream, the oldest first, ``files`` to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
