"""Images from a server of the test's own."""

import http.server
import threading

import numpy as np
import pytest

from framelake.sources import images, png, router, web

IMAGE = (np.arange(60, dtype=np.uint8).reshape(4, 5, 3) * 4).tobytes()


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        found = {"/a/f00000.png": png.encode_png(5, 4, 3, IMAGE), "/a/f00001.ppm": b"P6\n5 4\n255\n" + IMAGE, "/a/f00002.png": png.encode_png(5, 4, 1, IMAGE[:20]), "/a/text.png": b"no image", "/many": b"--x"}.get(self.path)
        self.send_response(200 if found is not None else 404)
        self.send_header("Content-Type", "multipart/x-mixed-replace; boundary=x" if self.path == "/many" else "application/octet-stream")
        self.end_headers()
        self.wfile.write(found or b"")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_single_images_and_problems(spark, base):
    asked = [f"{base}/a/f00000.png", f"{base}/a/f00001.ppm", f"{base}/a/text.png", f"{base}/a/none.png", f"{base}/many", "ftp://x/y.png", None]
    rows = {r.path: r for r in web.web_images(spark.createDataFrame([(a,) for a in asked], "address string")).collect()}
    assert len(rows) == len(asked) and all(bytes(rows[a].pixels) == IMAGE and rows[a].channels == 3 for a in asked[:2])
    assert rows[asked[2]].problem and "404" in rows[asked[3]].problem and "several parts" in rows[asked[4]].problem
    assert rows[asked[5]].problem == rows[None].problem == "not a web address"
    assert web.fetch(asked[0], most=10) == (None, "more than 10 bytes")


def test_a_sequence_is_numbered(spark, base):
    rows = web.web_sequence(spark, base + "/a/f{:05d}.png", 3, fps=10).orderBy("frame").collect()
    assert [(r.frame, r.timestamp_ms, r.width, r.channels) for r in rows] == [(0, 0, 5, 3), (1, 100, None, None), (2, 200, 5, 1)] and rows[1].problem
    one = router.open_source(spark, f"{base}/a/f00000.png").collect()
    assert [(r.frame, bytes(r.pixels)) for r in one] == [(0, IMAGE)]


def test_colour_frames_as_files(spark):
    rows = spark.createDataFrame([(3, 5, 4, 3, bytearray(IMAGE)), (4, 5, 4, 1, bytearray(IMAGE[:20]))], "frame long, width int, height int, channels int, pixels binary")
    got = {r.frame: images.decode_pnm(bytes(r.content)) for r in images.to_ppm(rows).collect()}
    assert got == {3: (5, 4, 3, IMAGE), 4: (5, 4, 1, IMAGE[:20])}
