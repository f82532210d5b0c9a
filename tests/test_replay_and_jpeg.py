"""Replay with late rows counted, and images that Java reads."""

import datetime

import numpy as np

from framelake.sources import images, png
from framelake.streaming import keyed_state as k


def test_a_client_gets_the_rest_once_and_late_rows_are_counted(spark, tmp_path):
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    schema = "job long, seq long, ts timestamp"
    for rows in ([(1, 0, at(10)), (1, 1, at(11)), (2, 0, at(12))], [(1, 2, at(1000)), (1, 1, at(11)), (1, 3, at(1001)), (1, 3, at(1001))], [(1, 5, at(1003))], [(2, 1, at(20)), (1, 4, at(1002))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = spark.createDataFrame([(1, 0), (3, 9)], "job long, upto long")
    got = []
    stream = k.replayed(k.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1), seen, "job", "100 seconds")
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, n: got.extend((r.job, r.seq) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0)]
    assert k.late_rows(query) == 1 and k.came(query) == 9


def test_jpeg_and_png_of_the_same_pixels(spark, tmp_path):
    y, x = np.mgrid[0:32, 0:48]
    image = np.stack((60 + 3 * x, 40 + 4 * y, 90 + x + y), axis=-1).astype(np.uint8)
    (tmp_path / "a0.png").write_bytes(png.encode_png(48, 32, 3, image.tobytes()))
    jvm = spark._jvm
    made = jvm.java.awt.image.BufferedImage(48, 32, 1)
    for j in range(32):
        for i in range(48):
            r, g, b = map(int, image[j, i])
            made.setRGB(i, j, r << 16 | g << 8 | b)
    assert jvm.javax.imageio.ImageIO.write(made, "jpg", jvm.java.io.File(str(tmp_path / "a1.jpg")))
    (tmp_path / "a2.jpeg").write_bytes(b"no image")
    rows = images.sequence(spark, f"file://{tmp_path}").orderBy("frame").collect()
    assert [(r.frame, r.width, r.height, r.channels) for r in rows] == [(0, 48, 32, 3), (1, 48, 32, 3), (2, None, None, None)] and rows[2].problem == "not an image"
    plain, lossy = (np.frombuffer(r.pixels, dtype=np.uint8).astype(int) for r in rows[:2])
    assert np.array_equal(plain.reshape(32, 48, 3), image) and np.abs(plain - lossy).mean() < 6 and np.abs(plain - lossy).max() < 40
