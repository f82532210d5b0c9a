"""Annotated frames and manifests as files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import pixels as p
from framelake.sources import images, records, sinks


def test_annotated_files_hold_what_the_operator_draws(spark, tmp_path):
    rng = np.random.default_rng(2)
    image = {k: rng.integers(0, 256, (20, 30, 3), dtype=np.uint8) for k in (1, 7, 1234567)}
    frames = spark.createDataFrame([(k, 30, 20, 3, bytearray(v.tobytes())) for k, v in image.items()], "frame long, width int, height int, channels int, pixels binary")
    boxes = [(1, 2, 3, 10, 8), (1, 25, 15, 12, 9), (1, 0, 0, 30, 20), (7, -3, 18, 6, 6), (7, 5, 5, 0, 4), (99, 1, 1, 2, 2)]
    found = spark.createDataFrame(boxes, "frame long, x int, y int, w int, h int")
    sinks.write_files(sinks.annotated(frames, found), f"file://{tmp_path}/out")
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")) == ["_SUCCESS", "frame_000001.png", "frame_000007.png", "frame_1234567.png"]
    back = {r.path.rsplit("/", 1)[1]: np.frombuffer(r.pixels, dtype=np.uint8).reshape(20, 30, 3) for r in images.sequence(spark, f"file://{tmp_path}/out").collect()}
    rows = spark.createDataFrame([(k, x, y, *map(int, v[y, x])) for k, v in image.items() for y in range(20) for x in range(30)], "frame long, x int, y int, r int, g int, b int")
    for r in p.draw_rects(rows, found, 30, 20).collect():
        assert back[f"frame_{r.frame:06d}.png"][r.y, r.x].tolist() == [r.r, r.g, r.b]
    assert np.array_equal(back["frame_1234567.png"], image[1234567])


def test_file_names_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="not a file name"):
        sinks.write_files(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary"), f"file://{tmp_path}/out")
    sinks.write_files(spark.createDataFrame([], "name string, content binary"), f"file://{tmp_path}/none")
    assert (tmp_path / "none" / "_SUCCESS").read_text() == "0"


@pytest.mark.parametrize("count", [0, 1, 300])
def test_manifest_parts_are_one_json(spark, tmp_path, count):
    rows = [(i, i * 33, f'f"{i}\\.png', 64, 48, [(1, 2, 3, 4, 0.5), (5, 6, 7, 8, 1.0)][: i % 3], i / 4) for i in range(count)]
    df = spark.createDataFrame(rows, records.RECORD).repartition(4)
    sinks.write_manifest(df, str(tmp_path / "m"), F.lit(1000))
    text = "".join(r.text for r in sinks.read_manifest(spark, str(tmp_path / "m")).orderBy("file").collect())
    made = json.loads(text)
    assert made["stats"]["frames_processed"] == count and made["stats"]["total_detections"] == sum(i % 3 for i in range(count))
    assert [f["frame_index"] for f in made["frames"]] == list(range(count))
    assert all(f["image"] == f'f"{i}\\.png' and len(f["detections"]) == i % 3 for i, f in enumerate(made["frames"]))


def test_the_manifest_is_read_by_lines(spark, monkeypatch):
    from framelake import registry

    def whole(*_):
        raise AssertionError("a part as one text")

    monkeypatch.setattr(sinks, "read_manifest", whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # pieces of parts, several to a task
    try:
        got = {r.place: r.line for r in registry.queries()["manifest_file"](spark, "/root/testdata/sf0.001").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = json.loads("\n".join(got[n] for n in range(len(got))))
    assert made["stats"]["frames_processed"] == len(made["frames"]) > 1000 and [f["frame_index"] for f in made["frames"]] == sorted(f["frame_index"] for f in made["frames"])


def test_places_count_through_pieces_of_parts(spark, tmp_path):
    lines = [[f"{k}:{n}" + "\r" * (n % 5 == 0) + "x" * (n % 70) if n % 7 else "" for n in range(size)] for k, size in enumerate((3, 5000, 1))]
    for k, part in enumerate(lines):
        (tmp_path / f"part-{k}.txt").write_bytes("".join(f"{x}\n" for x in part).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = {r.place: r.line for r in sinks.manifest_places(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[n] for n in range(len(got))] == [x for part in lines for x in part]
