"""Tables written between the steps of a plan, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast.
BROADCAST_BYTES = 32 << 20

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of its own; on a cluster the warehouse, which is shared, serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_framelake_work"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/framelake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def counted(df: DataFrame, name: str, *more: Column) -> DataFrame:
    """As :func:`materialise`; what is written is counted on the way, so that no other job has to: ``_seen`` has its rows, then the aggregates ``more``."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("c0"), *(c.alias(f"c{i}") for i, c in enumerate(more, 1))), name)
    out._seen = tuple(seen.get[f"c{i}"] for i in range(len(more) + 1))
    return out


def rows_of(df: DataFrame) -> int:
    return df._seen[0] if hasattr(df, "_seen") else df.count()


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialise` wrote and that nothing will read again: what was made of them must be written, too."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def text_bytes(df: DataFrame, *texts: str) -> int:
    """Bytes of ``df``, a table written before, with its ``texts`` measured and 64 for the rest of a row."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(64)).cast("long")
    return df.agg(F.sum(size)).first()[0] or 0


def hint_measured(df: DataFrame, *texts: str) -> DataFrame:
    """As :func:`hint`, for rows whose ``texts`` may have any length."""
    return F.broadcast(df) if text_bytes(df, *texts) <= BROADCAST_BYTES else df


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Whether ``df``, a table written before, may be broadcast: its rows are counted, it takes BROADCAST_BYTES at most."""
    return rows_of(df) * row_bytes <= BROADCAST_BYTES


def sized(df: DataFrame, row_bytes: int, rows: DataFrame | None = None) -> DataFrame:
    """As :func:`hint`, but what is too large is marked for a merge join: Spark guesses by bytes on disk, which are far too few for rows that compress well."""
    return F.broadcast(df) if small_enough(df if rows is None else rows, row_bytes) else df.hint("merge")


def hint(df: DataFrame, row_bytes: int, rows: DataFrame | None = None) -> DataFrame:
    """``df`` marked for broadcast if its size allows that; else Spark shuffles both sides and splits hot keys. ``rows``: a table of as many rows that was counted."""
    return F.broadcast(df) if small_enough(df if rows is None else rows, row_bytes) else df
