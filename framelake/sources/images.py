"""Image files as packed frames: a generated scan, sequences of files, and the plain formats P5 and P6 in both directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import materialise
from .png import SIGNATURE, decode_png, encode_png

#: Packed frames as they are read: three channels for P6, else one; ``problem`` says why a file has no pixels.
PACKED = "path string, width int, height int, channels int, pixels binary, problem string"


def synthetic(spark: SparkSession, frames: int = 60, width: int = 320, height: int = 240) -> DataFrame:
    """``frame``, ``x``, ``y``, ``v``, ``timestamp_ms`` of a moving wave in single precision, computed where it is read."""
    n = width * height
    at = spark.range(frames * n).select(F.expr(f"id div {n}").alias("frame"), F.expr(f"cast(id % {width} as int)").alias("x"), F.expr(f"cast(id div {width} % {height} as int)").alias("y"))
    single = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("float")
    wave = single(F.sin(single(F.col("x") + F.col("y")) * single(0.02) + single(F.col("frame")) * single(0.1))) * single(127) + single(128)
    return at.select("frame", "x", "y", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(wave))).cast("int").alias("v"), (F.col("frame") * 33).alias("timestamp_ms"))


def tokens_of(data: bytes, count: int) -> tuple[list[bytes], int]:
    """The first ``count`` words of a header, and where its one closing white space is; comments end at a line's end."""
    words: list[bytes] = []
    at = 0
    while len(words) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
            continue
        start = at
        while at < len(data) and not data[at : at + 1].isspace():
            at += 1
        if start == at:
            raise ValueError("header ends early")
        words.append(data[start:at])
    return words, at


def decode_pnm(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, pixels) of a P5 or P6 file of 255 levels."""
    (magic, *size), at = tokens_of(data, 4)
    if magic not in (b"P5", b"P6"):
        raise ValueError("neither P5 nor P6")
    width, height, levels = map(int, size)
    if levels != 255:
        raise ValueError("levels other than 255")
    channels = 3 if magic == b"P6" else 1
    pixels = data[at + 1 : at + 1 + width * height * channels]
    if len(pixels) < width * height * channels:
        raise ValueError("pixels end early")
    return width, height, channels, pixels


def decode(files: DataFrame) -> DataFrame:
    """Files (``path``, ``content``) as packed frames; a broken file gives a row with its problem, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    content = content or b""
                    rows.append((path, *(decode_png if content[:8] == SIGNATURE else decode_pnm)(content), None))
                except ValueError as why:
                    rows.append((path, None, None, None, None, str(why)))
            out = pd.DataFrame(rows, columns=["path", "width", "height", "channels", "pixels", "problem"])
            yield out.astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return files.select("path", "content").mapInPandas(run, PACKED)


def jvm_images(spark: SparkSession, folder: str, pattern: str = "*.[jJ][pP]*[gG]") -> DataFrame:
    """PACKED rows of the images of ``folder`` that Java reads (JPEG by default): one channel for gray ones, else three, red first.

    Spark's reader gives blue first; transparency is dropped. A file that is no image gives a row with its problem.
    """
    found = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).load(folder).select("image.*")
    found = found.withColumn("origin", F.regexp_replace("origin", "^file:/+", "file:/"))  # as other readers name a local file

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.width <= 0 or r.height <= 0:
                    rows.append((r.origin, None, None, None, None, "not an image"))
                    continue
                image = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                image = image if r.nChannels == 1 else image[..., 2::-1]
                rows.append((r.origin, r.width, r.height, image.shape[2], image.tobytes(), None))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "pixels", "problem"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return found.mapInPandas(turn, PACKED)


def sequence(spark: SparkSession, folder: str, fps: int = 30) -> DataFrame:
    """The P5, P6, PNG and JPEG files of a folder in the order of their names, numbered from 0, with times.

    Names alone are numbered: they are sorted by range, counted in each range, and numbered within it from what stands before.
    Files without a byte are not listed by Spark and give no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.p[gpn][mg]").load(folder)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "{*.p[gpn][mg],*.[jJ][pP]*[gG]}").load(folder)
    names = materialise(listed.select("path").repartitionByRange("path").select("path", F.spark_partition_id().alias("part")), "names")
    counts = names.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    order = names.withColumn("place", place).join(before, "part").select("path", (F.col("before") + F.col("place") - 1).cast("long").alias("frame"))
    return decode(files).unionByName(jvm_images(spark, folder)).join(order, "path").withColumn("timestamp_ms", F.floor(F.col("frame") * 1000 / fps))


def to_pgm(frames: DataFrame) -> DataFrame:
    """``frame`` and ``content``: packed frames (``frame``, ``width``, ``height``, ``gray``) as P5 files."""
    header = F.encode(F.concat(F.lit("P5\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n")), "US-ASCII")
    return frames.select("frame", F.concat(header, F.col("gray")).alias("content"))


def to_ppm(frames: DataFrame) -> DataFrame:
    """``frame`` and ``content``: packed frames (``frame``, ``width``, ``height``, ``channels``, ``pixels``) as P6 files, those of one channel as P5."""
    size = F.concat_ws(" ", F.col("width").cast("string"), F.col("height").cast("string"))
    header = F.encode(F.concat(F.when(F.col("channels") == 3, "P6\n").otherwise("P5\n"), size, F.lit("\n255\n")), "US-ASCII")
    return frames.select("frame", F.concat(header, F.col("pixels")).alias("content"))


def to_png(frames: DataFrame) -> DataFrame:
    """``frame`` and ``content``: packed gray frames as PNG files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = [encode_png(w, h, 1, g) for w, h, g in zip(batch["width"], batch["height"], batch["gray"], strict=True)]
            yield pd.DataFrame({"frame": batch["frame"], "content": content})

    return frames.select("frame", "width", "height", "gray").mapInPandas(run, "frame long, content binary")


def crop(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """``frame``, ``rank``, ``width``, ``height``, ``gray`` of boxes (``frame``, ``rank``, ``x``, ``y``, ``w``, ``h``), kept within their frame.

    A box without any pixel inside gives no row.
    """
    schema = "frame long, rank int, width int, height int, gray binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                image = np.frombuffer(r.gray, dtype=np.uint8).reshape(r.height, r.width)
                part = image[max(0, r.y) : max(0, r.y + r.h), max(0, r.x) : max(0, r.x + r.w)]
                if part.size:
                    rows.append((r.frame, r.rank, part.shape[1], part.shape[0], part.tobytes()))
            yield pd.DataFrame(rows, columns=["frame", "rank", "width", "height", "gray"])

    return boxes.join(frames, "frame").select("frame", "rank", "x", "y", "w", "h", "width", "height", "gray").mapInPandas(run, schema)
