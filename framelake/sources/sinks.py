"""Files out: any rows of (``name``, ``content``) as files of their own, annotated frames as PNG, and the manifest.

``df.write.format("named_files").option("path", folder).mode("append").save()`` writes a file for each row. A task writes under a name of its own and
renames, so no reader meets half a file, and a task that runs again puts the same file in the same place; ``_SUCCESS`` is written when all tasks are done.
Folders are those that pyarrow reaches: local paths, ``file://``, ``hdfs://``, ``s3://``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .png import encode_png
from .records import record_line, run_statistics

#: Colour of a box's outline (a fixed value).
OUTLINE = (255, 64, 64)


@dataclass
class Written(WriterCommitMessage):
    files: int


class _NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Written:
        system, base = self._at()
        system.create_dir(base, recursive=True)
        n = 0
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"not a file name: {name!r}")
            part = f"{base}/_{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as out:
                out.write(bytes(row["content"] or b""))
            system.move(part, f"{base}/{name}")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._at()
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files may be there; without ``_SUCCESS`` the folder does not count."""


class NamedFiles(DataSource):
    """A sink: ``name`` string and ``content`` binary; of equal names any row's file stays. Other columns are not written."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("columns name and content are needed")
        return _NamedFilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """A file for each row (``name``, ``content``) in ``path``."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").option("path", path).mode("append").save()


def frame_name(frame: Column) -> Column:
    return F.concat(F.lit("frame_"), F.when(frame < 1_000_000, F.lpad(frame.cast("string"), 6, "0")).otherwise(frame.cast("string")), F.lit(".png"))


def outlined(image: np.ndarray, boxes: list, colour: tuple[int, int, int]) -> np.ndarray:
    """A copy of an image (row, column, channel) with the outlines of boxes (x, y, w, h) on it, cut at its edges."""
    out = image.copy()
    height, width = out.shape[:2]
    for x, y, w, h in boxes:
        across, down = slice(max(0, x), max(0, x + w)), slice(max(0, y), max(0, y + h))
        for row in (y, y + h):
            if 0 <= row < height and w > 0 and h > 0:
                out[row, across] = colour
        for column in (x, x + w):
            if 0 <= column < width and w > 0 and h > 0:
                out[down, column] = colour
    return out


def annotated(frames: DataFrame, boxes: DataFrame, colour: tuple[int, int, int] = OUTLINE) -> DataFrame:
    """``frame``, ``name`` and ``content``: packed frames (``frame``, ``width``, ``height``, ``channels``, ``pixels``) as PNG files in colour, with the outline of each of
    their ``boxes`` (``frame``, ``x``, ``y``, ``w``, ``h``). Frames without boxes are written, too; boxes of other frames are not."""
    own = boxes.groupBy("frame").agg(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in "xywh"))).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for r in batch.itertuples():
                image = np.frombuffer(r.pixels, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                image = np.repeat(image, 3, axis=2) if r.channels == 1 else image
                found = [(b["x"], b["y"], b["w"], b["h"]) for b in r.boxes] if r.boxes is not None else []
                content.append(encode_png(r.width, r.height, 3, outlined(image, found, colour).tobytes()))
            yield pd.DataFrame({"frame": batch["frame"], "content": content})

    joined = frames.where(F.col("pixels").isNotNull()).join(own, "frame", "left").select("frame", "width", "height", "channels", "pixels", "boxes")
    return joined.mapInPandas(run, "frame long, content binary").select("frame", frame_name(F.col("frame")).alias("name"), "content")


def manifest_lines(records: DataFrame, elapsed_ms: Column, version: str = "framelake-0.1") -> DataFrame:
    """``at`` and ``line``: the lines of the manifest of ``records`` (:data:`~framelake.sources.records.RECORD`), in the order of ``at`` (two whole numbers): version and statistics, a line for each frame by its number, the end."""
    stats = run_statistics(records, elapsed_ms)
    number = lambda c, places: F.format_string(f"%.{places}f", F.col(c).cast("double"))
    values = (("frames_processed", None), ("frames_with_face", None), ("total_detections", None), ("elapsed_ms", None), ("fps", 2), ("detect_ms_avg", 3))
    named = [F.concat(F.lit(f'    "{k}": '), number(k, p) if p else F.col(k).cast("string"), F.lit("" if k == "detect_ms_avg" else ",")) for k, p in values]
    head = F.array(F.lit("{"), F.lit(f'  "version": "{version}",'), F.lit('  "stats": {'), *named, F.lit("  },"), F.lit('  "frames": ['))
    place = lambda a, b: F.struct(F.lit(a).alias("part") if isinstance(a, int) else a, b.cast("long").alias("no"))
    first = stats.select(F.posexplode(head).alias("no", "line")).select(place(0, F.col("no")).alias("at"), "line")
    last = records.agg(F.max("frame_index").alias("last"))
    body = records.select("frame_index", record_line(F.col("detections")).alias("text")).join(F.broadcast(last))
    body = body.select(place(1, F.col("frame_index")).alias("at"), F.concat(F.lit("    "), "text", F.when(F.col("frame_index") == F.col("last"), "").otherwise(",")).alias("line"))
    end = stats.select(F.posexplode(F.array(F.lit("  ]"), F.lit("}"))).alias("no", "line")).select(place(2, F.col("no")).alias("at"), "line")
    return first.unionByName(body).unionByName(end)


def write_manifest(records: DataFrame, path: str, elapsed_ms: Column, version: str = "framelake-0.1") -> None:
    """The manifest as text files in ``path``: put together in the order of their names they are the one JSON text. Lines are sorted by range, so no task has all of them."""
    lines = manifest_lines(records, elapsed_ms, version)
    lines.repartitionByRange("at").sortWithinPartitions("at").select("line").write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``text`` of the parts of a manifest."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def manifest_places(spark: SparkSession, path: str) -> DataFrame:
    """``place`` (from 0) and ``line`` of the parts of a manifest, put together in the order of their names. Parts are read line by line, so they may have any size."""
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # one task reads a piece of a file, from its start on
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_name").alias("file"), at.alias("at"), F.col("value").alias("line"))
    counts = read.groupBy("file").agg(F.count("*").alias("n"))  # as many rows as files
    before = counts.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    no = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return read.select("file", no.alias("no"), "line").join(F.broadcast(before), "file").select((F.col("before") + F.col("no")).alias("place"), "line")
