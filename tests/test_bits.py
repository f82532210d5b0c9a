"""Checksums and the generator against plain ones."""

import zlib

from pyspark.sql import functions as F

from framelake.functions import bits


def test_adler_and_noise(spark):
    values = [b"", b"a", b"Wikipedia", bytes(range(256)) * 20]
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, b binary")
    assert [r.a for r in rows.select("i", bits.adler32(F.col("b")).alias("a")).orderBy("i").collect()] == [zlib.adler32(v) for v in values]
    state, want = 0x12345678, []
    for _ in range(9):
        state = (state * 1664525 + 1013904223) % 2**32
        want.append(state >> 24)
    assert spark.range(1).select(bits.noise(F.lit(0x12345678), 9).alias("n")).first().n == want
