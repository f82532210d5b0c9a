"""Checksums, generators and stamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the checksum and of the generator.
ADLER, FACTOR, ADDEND = 65521, 1664525, 1013904223


def byte_values(data: Column) -> Column:
    """The bytes of a binary value as numbers."""
    hexed = F.hex(data)
    n = F.octet_length(data)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substr(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def adler32(data: Column) -> Column:
    """The checksum as a number: the sum of the bytes and the sum of its running values, both modulo ADLER. The second is a weighted sum, so nothing is folded twice."""
    bytes_, n = byte_values(data), F.octet_length(data).cast("long")
    low = F.aggregate(bytes_, F.lit(1).cast("long"), lambda a, b: a + b) % ADLER
    weighted = F.aggregate(F.transform(bytes_, lambda b, i: b * (n - i)), n, lambda a, b: a + b) % ADLER
    return F.shiftleft(weighted, 16) + low


def noise(seed: Column, count: int) -> Column:
    """``count`` bytes of a linear congruential generator of 32 bits from ``seed``: the upper byte of each state."""
    step = lambda s: (s * FACTOR + ADDEND) % (1 << 32)

    def more(acc: Column, _: Column) -> Column:
        s = step(acc["s"])
        return F.struct(s.alias("s"), F.array_append(acc["out"], F.shiftright(s, 24).cast("int")).alias("out"))

    start = F.struct(seed.cast("long").alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, more, lambda acc: acc["out"])


def request_time(at: Column) -> Column:
    """A time as signed requests have it: date and time without separators, a T between and a Z behind them, in UTC if that is the session's zone."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
