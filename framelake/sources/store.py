"""A store of jobs, their frames and their faces on files: first write wins, upserts, cascading deletes, versions.

A table is a set of buckets by ``job_id``, each a folder of Parquet files. A write makes new folders for the buckets that it touches, and
then a new version, a small file that names the folder of every bucket. A version appears by one rename, so readers see all of
a write or nothing, a failed or lost write leaves the last version as it was, and two writers can't both make the same one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.jobs import insert_ignore
from ..plans.tables import materialise, sized

#: Tables with their columns and keys.
TABLES = {
    "jobs": ("job_id long, kind string, display_name string, status string, created_ms long, finished_ms long, frames_processed long, frames_with_face long, total_detections long, original_key string, error string, algo string", ["job_id"]),
    "frames": ("job_id long, idx long, timestamp_ms long, annotated_key string, original_key string", ["job_id", "idx"]),
    "faces": ("job_id long, frame_idx long, face_idx int, key string, x int, y int, w int, h int, score float", ["job_id", "frame_idx", "face_idx"]),
    "pending": ("job_id long, idx long, timestamp_ms long, annotated_key string, original_key string", ["job_id", "idx"]),
}
#: Frames of a job that are written together (a fixed value).
BATCH = 20


class Store:
    """The store at ``path``, of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = spark._jvm.org.apache.hadoop.fs
        self.system = self.files.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.buckets = self._state()[1].get("buckets", buckets)

    # versions

    def version(self) -> int:
        """The last version; 0 for an empty store."""
        folder = self.files.Path(f"{self.path}/versions")
        if not self.system.exists(folder):
            return 0
        return max((int(s.getPath().getName().removesuffix(".json")) for s in self.system.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def _state(self) -> tuple[int, dict]:
        n = self.version()
        if not n:
            return 0, {}
        stream = self.system.open(self.files.Path(f"{self.path}/versions/{n}.json"))
        try:
            return n, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, n: int, tables: dict[str, dict[str, str]]) -> None:
        made = self.files.Path(f"{self.path}/versions/{uuid.uuid4().hex}.part")
        stream = self.system.create(made, False)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "tables": tables}).encode()))
        stream.close()
        target = self.files.Path(f"{self.path}/versions/{n + 1}.json")
        if self.system.exists(target) or not self.system.rename(made, target):
            raise RuntimeError(f"version {n + 1} was made by another writer")

    # reading

    def _read(self, table: str, folders: list[str]) -> DataFrame:
        schema = TABLES[table][0]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table, of the last version or an earlier one."""
        if version is None:
            return self._read(table, sorted(self._state()[1].get("tables", {}).get(table, {}).values()))
        stream = self.system.open(self.files.Path(f"{self.path}/versions/{version}.json"))
        try:
            return self._read(table, sorted(json.loads(bytes(stream.readAllBytes()).decode())["tables"].get(table, {}).values()))
        finally:
            stream.close()

    # writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("job_id"), F.lit(self.buckets)).cast("string")

    def _rewrite(self, changes: dict[str, tuple[DataFrame, object]]) -> int:
        """For each table its rows to come, which say what buckets are touched, and how old and new rows make a bucket; the number of buckets written."""
        n, state = self._state()
        tables, written = {k: dict(v) for k, v in state.get("tables", {}).items()}, 0
        for table, (rows, merge) in changes.items():
            rows = materialise(rows.withColumn("_bucket", self._bucket()), f"store_{table}")
            counts = dict(map(tuple, rows.groupBy("_bucket").count().collect()))  # as many as there are buckets at most
            touched = sorted(counts)
            if not touched:
                continue
            own = tables.setdefault(table, {})
            old = self._read(table, [own[b] for b in touched if b in own])
            new = rows.drop("_bucket")
            new._seen = (sum(counts.values()),)
            merged = merge(old, new).withColumn("_bucket", self._bucket())
            folder = f"data/{table}/{uuid.uuid4().hex}"
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            left = {s.getPath().getName().partition("=")[2] for s in self.system.listStatus(self.files.Path(f"{self.path}/{folder}")) if s.isDirectory()}
            for b in touched:
                if b in left:
                    own[b] = f"{folder}/_bucket={b}"
                else:
                    own.pop(b, None)  # nothing is left of it
            written += len(touched)
        if written:
            self._commit(n, tables)
        return written

    @staticmethod
    def _shaped(table: str, rows: DataFrame) -> DataFrame:
        columns = [c.strip().split(" ") for c in TABLES[table][0].split(",")]
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns))

    def upsert_jobs(self, jobs: DataFrame, order: str = "created_ms") -> int:
        """Insert jobs or replace them; of equal ids the row of the largest ``order`` counts. Columns that ``jobs`` lacks are kept from the old row."""
        given, key = [c for c in jobs.columns if c != "job_id"], "job_id"
        latest = jobs.where("job_id is not null").groupBy(key).agg(F.max_by(F.struct(*given), F.col(order) if order in given else F.lit(0)).alias("r")).select(key, "r.*")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            pick = lambda c: F.when(F.col("seen").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in given else F.col(f"o.{c}")
            both = old.alias("o").join(new.withColumn("seen", F.lit(True)).alias("n"), key, "full")
            return both.select(key, *(pick(c).alias(c) for c in old.columns if c != key))

        return self._rewrite({"jobs": (self._shaped("jobs", latest), merge)})

    def _insert(self, table: str, rows: DataFrame, order: list[str]):
        keys = TABLES[table][1]
        return lambda old, new: insert_ignore(old, new, keys, order)

    def add_frames(self, frames: DataFrame, faces: DataFrame | None = None) -> int:
        """Insert frames and faces whose keys are not there yet; of equal new keys the smallest row counts."""
        changes = {"frames": (self._shaped("frames", frames), self._insert("frames", frames, ["timestamp_ms", "annotated_key", "original_key"]))}
        if faces is not None:
            changes["faces"] = (self._shaped("faces", faces), self._insert("faces", faces, ["key", "x", "y", "w", "h", "score"]))
        return self._rewrite(changes)

    def add_frames_batched(self, frames: DataFrame, finished: DataFrame) -> int:
        """Hold frames back until a job has BATCH of them or is among ``finished`` (``job_id``); whole batches are inserted, the rest waits in ``pending``.

        One version takes frames in and out of ``pending``, so none is lost or doubled if the call fails or is repeated.
        """
        new = self._shaped("frames", frames)
        known = self.read("frames").select("job_id", "idx")
        held = self.read("pending").unionByName(new).dropDuplicates(["job_id", "idx"]).join(known.hint("merge"), ["job_id", "idx"], "left_anti")
        by_job = Window.partitionBy("job_id")
        held = held.withColumn("place", F.row_number().over(by_job.orderBy("idx"))).withColumn("many", F.count("*").over(by_job))
        held = held.join(finished.select("job_id", F.lit(True).alias("over")).distinct().hint("merge"), "job_id", "left")
        held = materialise(held.withColumn("out", F.coalesce("over", F.lit(False)) | (F.col("place") <= F.floor(F.col("many") / BATCH) * BATCH)).drop("place", "many", "over"), "held")
        out, wait = held.where("out").drop("out"), held.where("not out").drop("out")
        return self._rewrite({"frames": (out, self._insert("frames", out, ["timestamp_ms", "annotated_key", "original_key"])), "pending": (held.drop("out"), lambda old, rows: wait)})

    def update_counts(self, counts: DataFrame) -> int:
        """``frames_processed``, ``frames_with_face`` and ``total_detections`` of jobs that are there."""
        names = ["frames_processed", "frames_with_face", "total_detections"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            found = new.select("job_id", *(F.col(c).alias(f"new_{c}") for c in names))
            return old.join(sized(found, 64, new), "job_id", "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns))

        return self._rewrite({"jobs": (self._shaped("jobs", counts), merge)})

    def delete_jobs(self, ids: DataFrame) -> int:
        """Remove the jobs of ``ids`` (``job_id``) with their frames and faces, in one version."""
        gone = materialise(ids.select(F.col("job_id").cast("long").alias("job_id")).where("job_id is not null").distinct(), "gone")
        without = lambda old, new: old.join(sized(new.select("job_id"), 64, new), "job_id", "left_anti").select(*old.columns)
        return self._rewrite({table: (self._shaped(table, gone), without) for table in TABLES})

    def remove_old(self) -> int:
        """Remove folders and versions that the last version does not need; the number of folders. Not to be run beside a writer or a reader of older versions."""
        n, state = self._state()
        used = {f for own in state.get("tables", {}).values() for f in own.values()}
        removed = 0
        for table in TABLES:
            where = self.files.Path(f"{self.path}/data/{table}")
            for made in self.system.listStatus(where) if self.system.exists(where) else ():
                for bucket in self.system.listStatus(made.getPath()):
                    name = f"data/{table}/{made.getPath().getName()}/{bucket.getPath().getName()}"
                    if bucket.isDirectory() and name not in used:
                        removed += bool(self.system.delete(bucket.getPath(), True))
        for s in self.system.listStatus(self.files.Path(f"{self.path}/versions")) if n else ():
            if s.getPath().getName() != f"{n}.json":
                self.system.delete(s.getPath(), False)
        return removed
