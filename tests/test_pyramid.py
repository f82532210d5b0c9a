"""The cascade as a plan against the packed detector, on frames of the tables and of the reference's kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import haar, pyramid
from framelake.plans import haar_queries
from framelake.sources import cascades

DATA = "/root/testdata/sf0.001"


def packed(rows, width, height):
    out = np.zeros((height, width), dtype=np.uint8)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def boxes(rows):
    return sorted((r.x, r.y, r.w, r.h, round(r.score, 3)) for r in rows)


@pytest.mark.parametrize("name", ["demo", "kinds", "biased"])
def test_plan_equals_the_packed_detector(spark, name):
    cascade = {"demo": haar.demo_cascade(), "kinds": haar_queries.every_kind(), "biased": haar_queries.every_kind()._replace(bias=0.5)}[name]
    pixels = haar_queries.tiled(spark, DATA).where("frame < 4")
    by_frame = {}
    for r in pixels.collect():
        by_frame.setdefault(r.frame, []).append(r)
    got = pyramid.detect_pyramid(pixels, 64, 64, cascade).collect()
    assert len(got) > 3
    for frame, rows in by_frame.items():
        want = haar.detect_frame(packed(rows, 64, 64), cascade)
        assert boxes(r for r in got if r.frame == frame) == sorted((*b[:4], round(b[4], 3)) for b in want)


def test_bright_centres_are_found(spark):
    frames = haar.bright_centres(spark, 2)
    plain = {r.frame: sorted((*b[:4], round(b[4], 3)) for b in haar.detect_frame(packed([p for p in frames.where(F.col("frame") == r.frame).collect()], 120, 120), haar.demo_cascade())) for r in frames.select("frame").distinct().collect()}
    got = pyramid.detect_pyramid(frames, 120, 120).collect()
    assert got and all(boxes(r for r in got if r.frame == f) == want for f, want in plain.items())


def test_small_frames_and_no_frames(spark):
    tiny = spark.createDataFrame([(1, x, y, 9) for x in range(8) for y in range(8)], "frame long, x int, y int, v int")
    assert pyramid.detect_pyramid(tiny, 8, 8).count() == 0
    assert pyramid.detect_pyramid(haar_queries.tiled(spark, DATA).where("false"), 64, 64).count() == 0


def test_levels_as_a_table(spark):
    sizes = [(24, 24), (25, 600), (64, 64), (120, 120), (320, 240), (640, 480), (1920, 1080), (10, 99)]
    rows = pyramid.level_table(spark.createDataFrame(sizes, "width int, height int")).collect()
    got = {(r.width, r.height, r.level): (r.level_width, r.level_height, round(r.scale, 5), r.box, r.stride, r.windows) for r in rows}
    want = {(w, h, x["level"]): (x["width"], x["height"], round(x["scale"], 5), x["box"], x["stride"], x["windows"]) for w, h in sizes for x in haar.levels(w, h)}
    assert got == want


def test_demo_cascade_as_named_kinds():
    kinds = {0: cascades.VERTICAL_CENTER, 1: cascades.HORIZONTAL_CENTER, 2: cascades.VERTICAL_EDGE, 3: cascades.HORIZONTAL_EDGE}
    demo, file = haar.demo_cascade(), haar.to_file(haar.demo_cascade())
    named = file._replace(features=tuple(haar.named_kind(kinds[i], 24, 24) if i in kinds else f for i, f in enumerate(file.features)))
    back = haar.from_file(cascades.read_rfcf(cascades.write_rfcf(named)))
    assert [sorted(f) for f in back.features] == [sorted(f) for f in demo.features]
    rng = np.random.default_rng(3)
    image = np.kron(rng.integers(0, 256, (20, 20)), np.ones((6, 6))).astype(np.uint8)
    assert haar.detect_frame(image, back) == haar.detect_frame(image, demo)


def test_units_are_scaled_to_the_window():
    assert haar.in_window(haar.named_kind(cascades.HORIZONTAL_CENTER, 3, 5)) == ((0, 0, 8, 24, 1.0), (8, 0, 8, 24, -2.0), (16, 0, 8, 24, 1.0))
    assert haar.in_window(cascades.Feature(cascades.VERTICAL_EDGE, 60, 60, ((1, 1, 1, 1, 1.0),))) == ((0, 0, 1, 1, 1.0),)
    wide = cascades.CascadeFile(24, 24, (cascades.Feature(cascades.CUSTOM_RECTS, 0, 0, ((20, 0, 8, 8, 1.0),)),), ())
    with pytest.raises(ValueError, match="beyond"):
        haar.from_file(wide)


def test_trace_names_the_first_failing_stage(spark):
    cascade = haar_queries.every_kind()
    rows = pyramid.stage_trace(haar_queries.tiled(spark, DATA).where("frame = 0"), 64, 64, cascade).collect()
    windows = {}
    for r in rows:
        windows.setdefault((r.level, r.wx, r.wy), []).append(r)
    assert len(windows) == sum(x["windows"] for x in haar.levels(64, 64))
    for own in windows.values():
        assert len(own) == sum(len(ws) for _, ws in cascade.stages)
        totals = {}
        for r in sorted(own, key=lambda r: (r.stage, r.weak)):
            w = cascade.stages[r.stage][1][r.weak]
            assert r.vote == ((w.right if r.response > np.float32(w.threshold) else w.left) if w.sign > 0 else (w.left if r.response > np.float32(w.threshold) else w.right))
            totals[r.stage] = totals.get(r.stage, 0) + r.vote
        failing = [s for s, t in sorted(totals.items()) if t < cascade.stages[s][0]]
        assert {r.failed for r in own} == {failing[0] if failing else None}
