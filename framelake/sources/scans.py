"""Frame sources as Spark data sources: generated frames by number, as a batch and as a stream.

``spark.read.format("generated_frames").option("address", "test://n=120")`` plans a partition for each range of frames. A stream of the
same format has the frames whose time has come, as a camera does; its offsets are frame numbers, so a trigger reads those since
the last one, and a restart goes on with the next frame.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Frames of an address without a number and milliseconds between frames (fixed values), frames of a partition.
FRAMES, STEP_MS, RANGE = 60, 33, 16
PACKED = "frame long, timestamp_ms long, width int, height int, gray binary"


def frames_of(address: str) -> int:
    """How many frames ``test://…`` has: the whole number between the first ``=`` and the next one, before any ``?``; FRAMES if there is none."""
    parts = address.removeprefix("test://").split("?")[0].split("=")
    return int(parts[1]) if len(parts) > 1 and parts[1].isascii() and parts[1].isdigit() else FRAMES


def wave(frame: int, width: int, height: int) -> np.ndarray:
    """The moving wave in single precision, cut to bytes."""
    single = np.float32
    along = (np.arange(width)[None, :] + np.arange(height)[:, None]).astype(single)
    sine = np.sin((along * single(0.02) + single(frame) * single(0.1)).astype(np.float64)).astype(single)
    value = sine * single(127) + single(128)
    return np.clip(value, 0, 255).astype(np.uint8)


class Range(InputPartition):
    def __init__(self, first: int, after: int):
        self.first, self.after = first, after


def ranges(first: int, after: int, size: int) -> list[Range]:
    return [Range(a, min(after, a + size)) for a in range(first, after, size)]


class _Settings:
    def __init__(self, options: dict):
        self.total = frames_of(options.get("address", "test://"))
        self.width, self.height = int(options.get("width", 320)), int(options.get("height", 240))
        self.size, self.first_ms = int(options.get("framesPerPartition", RANGE)), int(options.get("startMs", 0))
        if min(self.width, self.height, self.size) < 1:
            raise ValueError("sizes must be 1 or more")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for frame in range(partition.first, partition.after):
            gray = wave(frame, self.width, self.height).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([frame], pa.int64()), pa.array([frame * STEP_MS], pa.int64()), pa.array([self.width], pa.int32()), pa.array([self.height], pa.int32()), pa.array([gray], pa.binary())],
                names=["frame", "timestamp_ms", "width", "height", "gray"],
            )


class _Batch(_Settings, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(0, self.total, self.size)


class _Stream(_Settings, DataSourceStreamReader):
    """Frame ``k`` is there from ``startMs`` + k * STEP_MS on. No state but the clock, so a restart can't lose its place."""

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        due = (int(time.time() * 1000) - self.first_ms) // STEP_MS + 1
        return {"frame": max(0, min(self.total, due))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start["frame"], end["frame"], self.size)


class GeneratedFrames(DataSource):
    """PACKED rows of the generated scan. Options: ``address``, ``width``, ``height``, ``framesPerPartition``, and for streams ``startMs``, when frame 0 is due."""

    @classmethod
    def name(cls) -> str:
        return "generated_frames"

    def schema(self) -> str:
        return PACKED

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeneratedFrames)
