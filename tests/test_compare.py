"""Several detectors on one table against their single runs."""

import numpy as np
import pytest

from framelake.operators import compare, haar, networks, sliding
from framelake.plans import haar_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    return haar.pack(haar_queries.tiled(spark, DATA).where("frame < 3"), 64, 64).cache()


def boxes(rows):
    return sorted((r.frame, r.x, r.y, r.w, r.h, round(r.score, 4)) for r in rows)


def test_results_equal_the_single_runs(spark, frames):
    found = compare.detections(frames, " HAAR, nonsense,cnn ,mtcnn,hog").collect()
    by = lambda name: [r for r in found if r.algo == name]
    assert {r.algo for r in found} == {"haar", "cnn", "mtcnn", "hog"}
    assert boxes(r for r in by("haar") if r.rank) == boxes(haar.detect(frames).collect())
    assert boxes(r for r in by("cnn") if r.rank) == boxes(networks.classify(frames).collect())
    assert [(r.rank, r.error) for r in by("mtcnn")] == [(None, None)] * 3
    assert len(by("hog")) == 3 and all(r.rank is None and "not public" in r.error for r in by("hog"))
    summary = {r.algo: r for r in compare.compared(compare.detections(frames, ["haar", "hog"])).collect()}
    assert summary["haar"].detection_count == haar.detect(frames).count() and summary["haar"].frames == 3 and summary["haar"].error is None
    assert summary["hog"].detection_count == 0 and summary["hog"].error


def test_own_detectors_and_sql(spark, frames):
    weights = (np.arange(3780) * 7919 % 17 - 8) / 100.0
    settings = sliding.Gradients(least=-1e9, min_size=16)
    own = {"gradient": compare.gradient_detector(weights, 0.0, settings), "broken": compare.no_weights("broken")}
    tall = haar.pack(haar_queries.tiled(spark, DATA, 16).where("frame < 1"), 128, 128)
    found = compare.detections(tall, ["gradient", "broken"], own).collect()
    want = sliding.detect_gradients(tall, weights, 0.0, settings).collect()
    assert want and boxes(r for r in found if r.rank) == boxes(want) and [r.error for r in found if r.algo == "broken"]
    compare.register_function(spark)
    frames.createOrReplaceTempView("frames_to_compare")
    rows = spark.sql("SELECT frame, d.* FROM frames_to_compare, LATERAL detect('haar', gray, width, height) d").collect()
    assert boxes(r for r in rows if r.rank) == boxes(haar.detect(frames).collect())


def test_names_and_bad_frames(spark):
    assert compare.asked_for(None) == list(compare.NAMES) == compare.asked_for("") and compare.asked_for("cnn,x") == ["cnn"]
    with pytest.raises(ValueError, match="no valid"):
        compare.asked_for("x, y")
    bad = spark.createDataFrame([(1, 4, 4, b"123"), (2, 2, 2, None), (3, 3, 3, b"123456789")], "frame long, width int, height int, gray binary")
    rows = {r.frame: r for r in compare.detections(bad, "haar").collect()}
    assert rows[1].error and rows[2].error and rows[3].error is None and rows[3].rank is None
    assert compare.detections(bad.where("false")).count() == 0 and compare.empty_boxes(spark).columns == ["frame", "x", "y", "w", "h", "score"]
