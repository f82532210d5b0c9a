"""Images behind web addresses: a table of addresses is fetched by tasks, and decoded like files."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import PACKED, decode

#: Seconds that a server may take, and bytes of an answer at most.
TIMEOUT, MOST = 15.0, 64 << 20
FETCHED = "address string, path string, content binary, problem string"


def fetch(address: str | None, timeout: float = TIMEOUT, most: int = MOST) -> tuple[bytes | None, str | None]:
    """The bytes behind an ``http`` or ``https`` address, or why there are none. An answer of more than ``most`` bytes, or of several parts, is refused."""
    if address is None or urllib.parse.urlsplit(address).scheme not in ("http", "https"):
        return None, "not a web address"
    try:
        with urllib.request.urlopen(address, timeout=timeout) as answer:  # noqa: S310
            if answer.headers.get_content_maintype() == "multipart":
                return None, "a stream of several parts"
            data = answer.read(most + 1)
    except (OSError, ValueError, urllib.error.URLError) as why:
        return None, str(why)
    return (data, None) if len(data) <= most else (None, f"more than {most} bytes")


def fetched(addresses: DataFrame, timeout: float = TIMEOUT, most: int = MOST) -> DataFrame:
    """FETCHED rows of ``addresses`` (``address``); ``path`` is the address. One answer is held at a time. A task that runs again asks again, so write the result before it is read twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for address in batch["address"]:
                content, problem = fetch(address, timeout, most)
                yield pd.DataFrame({"address": [address], "path": [address], "content": [content], "problem": [problem]})

    return addresses.select("address").mapInPandas(run, FETCHED)


def web_images(addresses: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """PACKED rows of the PNG, P5 and P6 images behind ``addresses``; what could not be fetched or decoded gives its problem."""
    found = fetched(addresses, timeout)
    good = decode(found.where("problem is null"))
    bad = found.where("problem is not null").select("path", *(F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("channels", "int"), ("pixels", "binary"))), "problem")
    return good.unionByName(bad)


def numbered_addresses(spark: SparkSession, base: str, count: int, first: int = 0) -> DataFrame:
    """``frame`` and ``address`` of a sequence: ``base`` with a place like ``{:05d}`` for the number."""
    head, _, tail = base.partition("{")
    form, _, rest = tail.partition("}")
    width = int(form.strip(":d") or 0)
    number = F.col("frame").cast("string")
    number = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number) if width else number
    return spark.range(first, first + count).withColumnRenamed("id", "frame").select("frame", F.concat(F.lit(head), number, F.lit(rest)).alias("address"))


def web_sequence(spark: SparkSession, base: str, count: int, fps: int = 30, first: int = 0) -> DataFrame:
    """The frames of a sequence of ``count`` images behind web addresses: PACKED, ``frame`` and ``timestamp_ms``. Frames that are not there give their problem."""
    places = numbered_addresses(spark, base, count, first)
    return web_images(places).join(places.withColumnRenamed("address", "path"), "path").withColumn("timestamp_ms", F.floor((F.col("frame") - first) * 1000 / fps))


__all__ = ["FETCHED", "PACKED", "fetch", "fetched", "numbered_addresses", "web_images", "web_sequence"]
