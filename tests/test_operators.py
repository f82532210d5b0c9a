"""Fixed cases and comparisons of two ways to the same result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.operators import checks, haar, networks
from framelake.operators.boxes import greedy_nms
from framelake.operators.components import connected_components
from framelake.operators.jobs import algo_stats, in_order, insert_ignore
from framelake.operators.pixels import hamming_pairs, resize_area
from framelake.sources import cascades, images, png, records, router


def test_nms_merges_two_of_three(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 20, 20, 1.0), (1, 2, 2, 2, 20, 20, 0.9), (1, 3, 100, 100, 20, 20, 0.5)], "frame long, rank int, x int, y int, w int, h int, score double")
    assert sorted(r["rank"] for r in greedy_nms(boxes).collect()) == [1, 3]


def test_levels_of_known_sizes():
    assert [len(haar.levels(*s)) for s in ((64, 64), (120, 120), (320, 240), (640, 480), (1920, 1080))] == [6, 9, 13, 17, 21]
    assert sum(r["windows"] for r in haar.levels(320, 240)) == 7474
    assert haar.levels(320, 240, least=32) == []
    assert haar.levels(320, 240, least=32, faithful=False)


def test_packed_detector_agrees_with_joins(spark):
    frames = haar.bright_centres(spark, 2)
    cascade = haar.demo_cascade()

    def level_zero(batches):
        for b in batches:
            rows = [(r.frame, *x) for r in b.itertuples() for x in haar.detect_frame(np.frombuffer(r.gray, dtype=np.uint8).reshape(120, 120), cascade, scale=100.0, threshold=2.0)]
            yield pd.DataFrame(rows, columns=["frame", "x", "y", "w", "h", "score"])

    joined = {(r.frame, r.wx, r.wy) for r in haar.accepted(haar.stage_sums(haar.responses(frames, 120, 120, 4)), 8).collect()}
    first = {(r.frame, r.x, r.y) for r in haar.pack(frames, 120, 120).mapInPandas(level_zero, haar.BOXES).collect()}
    assert len(joined) > 20 and joined == first


XML = """<opencv_storage><cascade><height>24</height><width>20</width><stages><_><stageThreshold>-1.5</stageThreshold><weakClassifiers>
<_><internalNodes>0 -1 1 2.5e-1</internalNodes><leafValues>0.5 -0.25</leafValues></_></weakClassifiers></_></stages>
<features><_><rects><_>1 2 3 4 -1.</_><_>0 300 0 4 2.</_></rects></_><_><rects></rects></_></features></cascade></opencv_storage>"""


def test_cascade_files(spark, tmp_path):
    rect, weak = bytes([1, 2, 3, 4]) + b"\x00\x00\x80\xbf", b"\x01\x00\x00\x00" + b"\x00\x00\x80\x3e" + b"\xff" + b"\x00\x00\x00\x3f" + b"\x00\x00\x80\xbe"
    word = lambda n: n.to_bytes(4, "little")
    by_hand = b"RFCF" + word(2) + word(20) + word(24) + word(2) + bytes([5, 0, 0]) + word(1) + rect + bytes([2, 7, 9]) + word(0) + word(1) + b"\x00\x00\xc0\xbf" + word(1) + weak
    read = cascades.read_rfcf(by_hand)
    assert read.features[1] == (2, 7, 9, ()) and read.stages == ((-1.5, ((1, 0.25, -1, 0.5, -0.25),)),) and cascades.write_rfcf(read) == by_hand
    from_xml = cascades.read_xml(XML)
    assert from_xml.features[0] == (5, 0, 0, ((1, 2, 3, 4, -1.0), (0, 255, 1, 4, 2.0))) and from_xml.stages == ((-1.5, ((1, 0.25, 1, 0.5, -0.25),)),)
    for broken in (b"", b"FLHC" + by_hand[4:], by_hand[:-1], by_hand[:20] + bytes([9]) + by_hand[21:]):
        with pytest.raises(ValueError):
            cascades.read_rfcf(broken)
    (tmp_path / "a.rfcf").write_bytes(by_hand)
    (tmp_path / "b.xml").write_text(XML)
    (tmp_path / "c.rfcf").write_bytes(by_hand[:30])
    got = {r.path.rsplit("/", 1)[1]: r for r in cascades.scan_cascades(spark, f"file://{tmp_path}").collect()}
    assert got["a.rfcf"].width == 20 and got["b.xml"].features[0].rects[1].h == 4 and got["c.rfcf"].problem and not got["a.rfcf"].problem
    assert [tuple(r)[1:] for r in cascades.weak_table(cascades.scan_cascades(spark, f"file://{tmp_path}/a.rfcf")).collect()] == [(0, -1.5, 0, 1, 0.25, -1, 0.5, -0.25)]


def test_png(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(1)
    for channels in (1, 3):
        image = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        assert png.decode_png(png.encode_png(5, 7, channels, image.tobytes())) == (5, 7, channels, image.tobytes())
    image, rows, up = rng.integers(0, 256, (10, 6, 4), dtype=np.uint8), b"", np.zeros(24, dtype=int)
    for y in range(10):  # every filter, by its definition
        now, kind, line = image[y].reshape(-1).astype(int), y % 5, []
        for i in range(24):
            a, b, c = now[i - 4] if i > 3 else 0, up[i], up[i - 4] if i > 3 else 0
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((now[i] - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        rows, up = rows + bytes([kind, *line]), now
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    file = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert png.decode_png(file) == (6, 10, 3, image[:, :, :3].tobytes())
    for name, content in (("b.png", file), ("a.pgm", b"P5 1 1 255\n\x07"), ("c.png", file[:-20]), ("d.jpg", b"x")):
        (tmp_path / name).write_bytes(content)
    got = images.sequence(spark, f"file://{tmp_path}").orderBy("frame").collect()
    assert [(r.frame, r.width, r.channels, bool(r.problem)) for r in got] == [(0, 1, 1, False), (1, 6, 3, False), (2, None, None, True)]
    gray = images.decode(images.to_png(spark.createDataFrame([(4, 2, 1, bytearray(b"\x01\xff"))], "frame long, width int, height int, gray binary")).selectExpr("'x' AS path", "content")).first()
    assert (gray.width, gray.height, bytes(gray.pixels)) == (2, 1, b"\x01\xff")


def test_records_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(3, 120, "a.png", 64, 48, [(1, 2, 3, 4, 0.5), (5, 6, 7, 8, 0.25)], 7.25), (4, 160, None, 64, 48, [], 2.5)], records.RECORD)
    records.write_jsonl(rows, f"file://{tmp_path}/r")
    back = records.scan_jsonl(spark, f"file://{tmp_path}/r")
    assert sorted(back.drop("_corrupt_record").collect()) == sorted(rows.collect())
    stats = records.run_statistics(rows, F.lit(40)).first()
    assert tuple(stats) == (2, 1, 2, 40, 50.0, 4.875)
    assert tuple(records.run_statistics(rows.limit(0), F.lit(None)).first()) == (0, 0, 0, 0, 0.0, 0.0)
    (tmp_path / "bad.jsonl").write_text('{"frame_index": 1}\nnot json\n')
    assert [r.frame_index for r in records.scan_jsonl(spark, f"file://{tmp_path}/bad.jsonl").collect()] == [1, None]


def test_first_write_stays(spark):
    old = spark.createDataFrame([(1, "old", 0)], "k long, v string, at int")
    new = spark.createDataFrame([(1, "x", 1), (2, "late", 9), (2, "first", 2), (3, "only", 5)], "k long, v string, at int")
    assert {(r.k, r.v) for r in insert_ignore(old, new, ["k"], ["at"]).collect()} == {(1, "old"), (2, "first"), (3, "only")}


def test_cascade_round_trip():
    got = haar.from_file(cascades.read_rfcf(cascades.write_rfcf(haar.to_file(haar.demo_cascade()))))
    assert [len(s[1]) for s in got.stages] == [1] * 7 + [2] and len(got.features) == 8


def test_uniform_image_stays(spark):
    px = spark.range(64).selectExpr("0L AS frame", "cast(id % 8 as int) AS x", "cast(id div 8 as int) AS y", "137 AS v")
    assert {r.v for r in resize_area(px, 8, 8, 3, 5).collect()} == {137}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hamming_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 30, dtype=np.int64)
    values = np.concatenate([base, *(base ^ (np.int64(1) << np.int64(k)) ^ (np.int64(1) << np.int64(2 * k)) for k in (3, 9, 17))])
    got = {(r.a, r.b, r.distance) for r in hamming_pairs(spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "frame long, hash long"), 6).collect()}
    count = lambda a, b: bin((int(a) ^ int(b)) & (2**64 - 1)).count("1")
    assert got == {(i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := count(values[i], values[j])) <= 6}


def test_algo_stats_of_five_jobs(spark):
    jobs = [("haar", "done", 100, 5), ("haar", "done", 200, 3), ("haar", "error", 150, 0), ("cnn", "done", 200, 3), ("cnn", "running", 999, 0), ("", "queued", 0, 0)]
    got = {r.algo: r for r in algo_stats(spark.createDataFrame(jobs, "algo string, status string, elapsed_ms long, detections long")).collect()}
    assert (got["haar"].total, got["haar"].done, got["haar"].error, got["haar"].elapsed_ms, got["haar"].detections) == (3, 2, 1, 450, 8)
    assert (got["cnn"].total, got["cnn"].active, got["cnn"].elapsed_ms, got["pending"].active) == (1, 1, 200, 1)


def test_convolution_by_joins_and_by_windows(spark):
    rng = np.random.default_rng(5)
    image, kernel = rng.integers(0, 256, (10, 12)), rng.normal(size=(3, 3))
    px = spark.createDataFrame([(0, x, y, int(image[y, x])) for y in range(10) for x in range(12)], "frame long, x int, y int, v int")
    got = {(r.x, r.y): r.v for r in networks.convolve(px, kernel.tolist(), 12, 10).collect()}
    want = np.maximum(np.einsum("yxkl,kl->yx", networks.windows_of(image[None, ..., None], 3)[0, :, :, 0], kernel), 0)
    assert len(got) == 80 and all(abs(got[x, y] - want[y, x]) < 1e-9 for x, y in got)
    assert networks.forward(np.zeros((2, 24, 24)), networks.even_weights()).tolist() == [0.5, 0.5]


def test_plain_images_round_trip(spark, tmp_path):
    frames = haar.pack(haar.bright_centres(spark, 2), 120, 120)
    for r in images.to_pgm(frames).collect():
        (tmp_path / f"f{r.frame}.pgm").write_bytes(r.content)
    (tmp_path / "f2.ppm").write_bytes(b"P6 # two pixels\n2 1\n255\n" + bytes(range(6)))
    (tmp_path / "f3.pgm").write_bytes(b"P5 9 9 255\nshort")
    (tmp_path / "f4.pgm").write_bytes(b"P5")
    (tmp_path / "f5.pgm").write_bytes(b"")
    got = {r.frame: r for r in images.sequence(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and [got[i].problem for i in range(5)] == [None, None, None, "pixels end early", "header ends early"]
    assert (got[2].width, got[2].height, got[2].channels, bytes(got[2].pixels)) == (2, 1, 3, bytes(range(6)))
    assert {i: bytes(got[i].pixels) for i in (0, 1)} == {r.frame: bytes(r.gray) for r in frames.collect()}
    assert [got[i].timestamp_ms for i in range(5)] == [0, 33, 66, 100, 133]


def test_crops_stay_within_their_frame(spark):
    frames = haar.pack(haar.bright_centres(spark, 1), 120, 120)
    boxes = spark.createDataFrame([(0, 1, -5, -5, 15, 10), (0, 2, 115, 0, 50, 3), (0, 3, 200, 0, 5, 5)], "frame long, rank int, x int, y int, w int, h int")
    assert sorted((r["rank"], r.width, r.height, len(r.gray)) for r in images.crop(frames, boxes).collect()) == [(1, 10, 5, 50), (2, 5, 3, 15)]


def test_broken_headers():
    for bad in (b"P4 1 1 255\n\0", b"P5 1 1 15\n\0", b"P5 a 1 255\n\0"):
        with pytest.raises(ValueError):
            images.decode_pnm(bad)


def plain_confidence(window, weights):
    x = window[..., None] / 255.0
    for layer, kernel in enumerate(weights.kernels):
        side = len(x) - networks.KERNEL + 1
        x = np.array([[[max(0.0, (x[r : r + networks.KERNEL, c : c + networks.KERNEL] * kernel[..., o]).sum()) for o in range(kernel.shape[3])] for c in range(side)] for r in range(side)])
        if layer:
            x = np.maximum.reduce([x[i::2, j::2] for i in (0, 1) for j in (0, 1)])
    hidden = np.maximum(x.ravel() @ weights.dense[0] + weights.dense[1], 0)
    return 1 / (1 + np.exp(-(hidden @ weights.head[0] + weights.head[1])))


def test_classifier_scores_every_fourth_place(spark):
    image, weights = np.random.default_rng(4).integers(0, 256, (33, 37), dtype=np.uint8), networks.even_weights()
    scored = [(x, y, 24, 24, plain_confidence(image[y : y + 24, x : x + 24], weights)) for y in range(0, 10, 4) for x in range(0, 14, 4)]
    want = []
    for b in sorted(scored, key=lambda b: -b[4]):
        if all(haar.overlap(b, k) <= 0.3 for k in want):
            want.append(b)
    frames = spark.createDataFrame([(0, 37, 33, image.tobytes())], "frame long, width int, height int, gray binary")
    got = networks.classify(frames, weights, least=0.0).collect()
    assert sorted((r.x, r.y, r.w, r.h) for r in got) == sorted(b[:4] for b in want)
    assert sorted(r.score for r in got) == pytest.approx(sorted(b[4] for b in want))
    every = networks.classify_frame(image, weights, networks.STRIDE, 0.0)
    assert len(scored) == 12 and sorted(b[:4] for b in every) == sorted(b[:4] for b in want)


def test_settings_are_made_sane(spark):
    odd = haar.Settings(min_size=-3, max_size=-9, scale_factor=float("nan"), stride=0).sane()
    assert odd[:4] == (1, 1, 1.01, 1) and haar.Settings(scale_factor=9.0, min_size=50, max_size=20).sane()[:3] == (50, 50, 2.0)
    frames = haar.pack(haar.bright_centres(spark, 1), 120, 120)
    every, some = haar.detect_with(frames, haar.Settings()).collect(), haar.detect_with(frames, haar.Settings(min_size=25, min_score=3.0)).collect()
    assert {(r.x, r.y, r.w) for r in some} == {(r.x, r.y, r.w) for r in every if r.w >= 25 and r.score >= 3.0}
    assert haar.detect_with(frames, haar.FAST).count() < haar.detect_with(frames, haar.ACCURATE).count()


def test_rows_go_out_in_order(spark):
    first = spark.createDataFrame([(1, 1), (1, 0), (1, 3), (2, 1)], "job_id long, seq long")
    out, wait = in_order(first)
    assert {tuple(r) for r in out.collect()} == {(1, 0), (1, 1)} and {tuple(r) for r in wait.collect()} == {(1, 3), (2, 1)}
    done = spark.createDataFrame([(1, 2)], "job_id long, upto long")
    out, wait = in_order(wait.unionByName(spark.createDataFrame([(1, 2), (2, 0)], "job_id long, seq long")), done)
    assert {tuple(r) for r in out.collect()} == {(1, 2), (1, 3), (2, 0), (2, 1)} and wait.count() == 0


def grid(spark, image, frame=0):
    return spark.createDataFrame([(frame, x, y, int(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])], "frame long, x int, y int, v int")


def test_symmetry_of_mirrored_flat_small_and_odd_frames(spark):
    half = np.random.default_rng(5).integers(0, 256, (18, 9))
    whole = np.hstack([half, half[:, ::-1]])
    odd = np.hstack([half, half[:, :1], half[:, ::-1]])
    of = lambda image: checks.symmetry(grid(spark, image), image.shape[1], image.shape[0]).collect()[0]["symmetry"]
    assert of(whole) == 1.0 and of(odd) == 1.0 and of(whole * 0 + 9) == 1.0 and of(whole[:, 2:-2]) == 0.0
    assert of(np.hstack([half, np.random.default_rng(6).integers(0, 256, (18, 9))])) < 1.0


def test_boxes_move_with_their_eyes(spark):
    cases = [
        ("fine", 50, 100, 400, 30, None, None, (50, 100)), ("low, better", 50, 100, 400, 60, 40, True, (15, 135)), ("low, not seen again", 50, 100, 400, 60, None, True, (50, 100)),
        ("low, still low", 50, 100, 400, 60, 70, True, (50, 100)), ("high, better", 50, 100, 400, 10, 40, True, (20, 130)), ("high, not aligned", 50, 100, 400, 10, 40, False, None),
        ("high, at the bottom", 330, 100, 400, 10, 40, True, None), ("high, small", 50, 40, 400, 2, 10, True, None), ("high, at the top edge", 0, 100, 400, 10, 20, True, (0, 130)),
    ]
    rows = spark.createDataFrame([c[:7] for c in cases], "name string, y int, h int, fh int, top int, again int, aligned boolean")
    got = rows.select("name", checks.moved_by_eyes(F.col("y"), F.col("h"), 400, F.col("top"), F.col("again"), F.col("aligned")).alias("m")).collect()
    assert {r["name"]: r["m"] and tuple(r["m"]) for r in got} == {c[0]: c[7] for c in cases}


def test_detector_rows_are_cut_at_the_frame(spark):
    rows = [(1, 0.9, -0.1, 0.25, 0.5, 2.0), (2, 0.4, 0.1, 0.1, 0.5, 0.5), (3, 0.9, 0.5, 0.1, 0.5, 0.5), (4, None, 0.1, 0.1, 0.5, 0.5), (5, float("nan"), 0.1, 0.1, 0.5, 0.5), (6, 0.9, None, 0.1, 0.5, 0.5)]
    got = checks.decoded(spark.createDataFrame(rows, "id int, conf double, x1 double, y1 double, x2 double, y2 double"), 200, 100).collect()
    assert [(r["id"], r["x"], r["y"], r["w"], r["h"]) for r in got] == [(1, 0, 25, 100, 75)]


def test_sources_are_routed(spark, tmp_path):
    (tmp_path / "frame_00000.pgm").write_bytes(b"P5\n2 1\n255\n\x01\x02")
    assert [(r["frame"], r["width"], bytes(r["pixels"])) for r in router.open_source(spark, str(tmp_path)).collect()] == [(0, 2, b"\x01\x02")]
    assert router.open_source(spark, "test://grid").where("frame = 59").count() == 320 * 240
    for address in ("rtsp://h/s", "/a/b.mkv", "https://h/frames/"):
        with pytest.raises(NotImplementedError):
            router.open_source(spark, address)
    assert spark.range(1).select(router.source_kind(F.lit(None).cast("string"))).first()[0] is None


def test_weight_files():
    weights = networks.template_weights()
    data = networks.write_weights(weights)
    assert data[:8] == b"RCNN\x01\0\0\0" and len(data) == 36 + 4 * (72 + 1152 + 4608 + 16384 + 32 + 32 + 1)
    again = networks.read_weights(data)
    for a, b in zip((*weights.kernels, *weights.dense, weights.head[0]), (*again.kernels, *again.dense, again.head[0]), strict=True):
        assert np.array_equal(a.astype(np.float32), b)
    assert again.head[1] == -2
    for broken in (b"", b"RCNX" + data[4:], data[:-1], data[:8] + b"\1" + data[9:]):
        with pytest.raises(ValueError):
            networks.read_weights(broken)


def test_template_finds_a_light_centre():
    image = np.zeros((100, 100), dtype=np.uint8)
    image[38:62, 38:62] = 255
    x, y, w, h, _ = networks.classify_frame(image, networks.template_weights(), networks.STRIDE, 0.5)[0]
    assert x < 62 and x + w > 38 and y < 62 and y + h > 38


def test_block_features_are_the_row_form(spark):
    from framelake.operators import faces, sliding

    image = np.random.default_rng(7).integers(0, 256, (32, 24))
    rows = spark.createDataFrame([(0, x, y, int(image[y, x])) for y in range(32) for x in range(24)], "frame long, x int, y int, v int")
    want = np.zeros((3, 2, 4, 9))
    for r in faces.gradient_blocks(faces.gradient_cells(rows), 3, 4).collect():
        want[r.by, r.bx, r.cell, r.bin] = r.value
    assert np.allclose(sliding.block_features(image[None])[0], want.ravel())


def test_gradient_detector_slides():
    from framelake.operators import sliding

    assert sliding.detect_gradients_in(np.zeros((10, 10)), np.ones(3780), 0.0, sliding.Gradients()) == []
    assert [level[:3] for level in sliding.gradient_levels(96, 160, sliding.Gradients())] == [(1.0, 96, 160), (1.2, 80, 133)]
    image = np.random.default_rng(1).integers(0, 256, (160, 96))
    weights = sliding.block_features(image[None, 16:144, 24:88])[0]
    best = sliding.detect_gradients_in(image, weights, 0.0, sliding.Gradients())[0]
    assert best[:4] == (24, 16, 64, 128) and np.isclose(best[4], weights @ weights)


def test_anchor_scan_is_the_plain_one(spark):
    from framelake.operators import sliding

    image, scales, weights = np.random.default_rng(3).integers(0, 256, (24, 40)), (sliding.Scale(8, 8, 16), sliding.Scale(16, 4, 16), sliding.Scale(32, 8, 64)), sliding.even_anchor_weights(3)
    want = {}
    for k, (s, w) in enumerate(zip(scales, weights, strict=True)):
        for y in range(0, 24 - s.tile + 1, s.stride):
            for x in range(0, 40 - s.tile + 1, s.stride):
                v = image[y : y + s.tile, x : x + s.tile, None] / 255.0
                out = (np.maximum(v * w.hidden + w.hidden_bias, 0) @ w.out + w.out_bias).mean(axis=(0, 1))
                bw, bh = s.anchor * np.exp(out[2] * s.stride), s.anchor * np.exp(out[3] * s.stride)
                bx, by = min(max(x + s.tile // 2 + out[0] * s.stride - bw / 2, 0), 39), min(max(y + s.tile // 2 + out[1] * s.stride - bh / 2, 0), 23)
                x2, y2 = int(bx + max(1, bw)), int(by + max(1, bh))
                if x2 <= 40 and y2 <= 24 and x2 > int(bx) and y2 > int(by):
                    want[k, x, y] = (int(bx), int(by), x2 - int(bx), y2 - int(by), 1 / (1 + np.exp(-out[4])))
    rows = spark.createDataFrame([(0, x, y, int(image[y, x])) for y in range(24) for x in range(40)], "frame long, x int, y int, v int")
    got = {(r.scale, r.tx, r.ty): (r.x, r.y, r.w, r.h, r.score) for r in sliding.anchor_boxes(rows, 40, 24, weights, scales, 0.0).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k][:4] == want[k][:4] and abs(got[k][4] - want[k][4]) < 1e-5 for k in want)
