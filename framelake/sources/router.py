"""Where a source's address leads: a column of kinds for tables of addresses, and the scan of one address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images
from .scans import frames_of
from .web import web_images

#: Fixed endings of video files.
VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".webm")


def source_kind(address: Column) -> Column:
    """``generated``, ``image`` (one image of a web address), ``video``, ``sequence`` (of images) or ``unsupported``; null for null.

    Web addresses are told by ending and by words, in any case; other addresses are streams, video files or folders.
    """
    lower = F.lower(address)
    ends = lambda *suffixes: lower.rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")
    web = F.when(ends(".png", ".ppm"), "image").when(lower.contains(".mjpeg") | lower.contains("multipart"), "unsupported")
    web = web.when(ends(*VIDEO) | lower.contains("/upload-") | lower.contains("video"), "video").otherwise("sequence")
    kind = F.when(address.startswith("test://"), "generated").when(address.rlike("^https?://"), web)
    kind = kind.when(address.startswith("rtsp://") | ends(*VIDEO), "video").otherwise("sequence")
    return F.when(address.isNotNull(), kind)


def open_source(spark: SparkSession, address: str, fps: int = 30) -> DataFrame:
    """The frames of an address: generated ones as pixels, as many as it says, image sequences of any folder that Spark reads as packed frames.

    A web address of one image is fetched; one with a place like ``{:05d}`` is for :func:`framelake.sources.web.web_sequence`, which is told how many
    there are. Videos have no reader in Spark and are refused with a reason, as are streams.
    """
    web = address.startswith(("http://", "https://"))
    kind = spark.range(1).select(source_kind(F.lit(address))).first()[0]
    if kind == "generated":
        return images.synthetic(spark, frames_of(address))
    if kind == "sequence" and not web:
        return images.sequence(spark, address, fps)
    if kind == "image":
        return web_images(spark.createDataFrame([(address,)], "address string")).select(F.lit(0).cast("long").alias("frame"), F.lit(0).cast("long").alias("timestamp_ms"), "*")
    raise NotImplementedError(f"{kind} at {'a web address' if web else 'a stream or video file'}: fetch it as an image sequence first")
