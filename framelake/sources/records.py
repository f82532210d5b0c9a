"""Detection records in and out: JSON lines, the manifest, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,w:int,h:int,score:float>"
RECORD = f"frame_index bigint, timestamp_ms bigint, image_file string, width int, height int, detections array<{BOX}>, detect_ms double"


def scan_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of JSON lines; a line that is no record gives nulls and stands in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """One line a record, a file for each partition; nulls are written, as readers expect every field."""
    records.write.option("ignoreNullFields", "false").json(path)


def fixed(value: Column, places: int) -> Column:
    """A number to so many places, halves to even."""
    return F.bround(value.cast("double").cast("decimal(30,12)"), places).cast("string")


def record_line(detections: Column) -> Column:
    """The manifest's line of a frame: the columns of RECORD, milliseconds to three places, confidence to four."""
    number = lambda c: c.cast("string")
    box = lambda d: F.concat(F.lit('{"x": '), number(d["x"]), F.lit(', "y": '), number(d["y"]), F.lit(', "w": '), number(d["w"]), F.lit(', "h": '), number(d["h"]), F.lit(', "conf": '), fixed(d["score"], 4), F.lit("}"))
    name = F.regexp_replace(F.regexp_replace("image_file", r"(\\|\")", r"\\$1"), "\n", r"\\n")
    return F.concat(
        F.lit('{"frame_index": '), number(F.col("frame_index")), F.lit(', "timestamp_ms": '), number(F.col("timestamp_ms")), F.lit(', "image": "'), name, F.lit('", "width": '), number(F.col("width")),
        F.lit(', "height": '), number(F.col("height")), F.lit(', "detect_ms": '), fixed(F.col("detect_ms"), 3), F.lit(', "detections": ['), F.array_join(F.transform(detections, box), ", "), F.lit("]}"),
    )


def run_statistics(records: DataFrame, elapsed_ms: Column) -> DataFrame:
    """One row: frames, frames with a box, boxes, ``fps`` to two places and ``detect_ms_avg`` to three; zeros for no records."""
    n = F.size("detections")
    out = records.agg(F.count("*").alias("frames_processed"), F.count_if(n > 0).alias("frames_with_face"), F.coalesce(F.sum(n), F.lit(0)).alias("total_detections"), F.coalesce(elapsed_ms.cast("bigint"), F.lit(0)).alias("elapsed_ms"), F.coalesce(F.sum("detect_ms"), F.lit(0.0)).alias("total_ms"))
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        "frames_processed", "frames_with_face", "total_detections", "elapsed_ms", F.round(per(F.col("frames_processed") * 1000.0, F.col("elapsed_ms")), 2).alias("fps"),
        F.round(per(F.col("total_ms"), F.col("frames_processed")), 3).alias("detect_ms_avg"),
    )


def csv_line(*columns: Column) -> Column:
    """A line of CSV: values with a quote, comma or line end are quoted, quotes doubled; null is empty."""

    def cell(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *map(cell, columns))
