"""Several detectors on one table of frames: a registry, a table function for lateral joins, and the comparison.

A detector is a name and a function that makes one: it is made in each worker when first asked for, and takes a gray image to boxes
(x, y, w, h, score), the best first. A detector that can't be made gives a row with the reason in place of boxes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import haar, networks, sliding

Detector = Callable[[np.ndarray], list[tuple]]
#: ``rank`` is null in the one row of a frame without boxes, ``error`` in all rows of a detector that could be made.
FOUND = "algo string, error string, elapsed_ms double, rank int, x int, y int, w int, h int, score double"
#: Names that may be asked for, in the order in which they are shown (fixed values).
NAMES = ("haar", "cnn", "yunet", "mtcnn", "hog")

_MAKERS: dict[str, Callable[[], Detector]] = {}
_MADE: dict[str, Detector | str] = {}


def register(name: str, make: Callable[[], Detector]) -> None:
    """Have ``make`` make the detector ``name``. To be called in a module that workers import, or with functions that can be pickled (see :func:`table_function`)."""
    _MAKERS[name] = make
    _MADE.pop(name, None)


def no_weights(name: str) -> Callable[[], Detector]:
    def make() -> Detector:
        raise ValueError(f"{name}: its weights are not public")

    return make


register("haar", lambda: lambda image: haar.detect_frame(image, haar.demo_cascade()))
register("cnn", lambda: lambda image: networks.classify_frame(image, networks.template_weights(), networks.STRIDE, 0.5))
register("hog", no_weights("hog"))
register("yunet", no_weights("yunet"))
register("mtcnn", lambda: lambda image: [])  # its stages have no weights: it finds nothing, and says so by an empty result


def gradient_detector(weights: np.ndarray, bias: float = 0.0, settings: sliding.Gradients | None = None) -> Callable[[], Detector]:
    """A maker of the sliding gradient detector with weights of one's own, for :func:`table_function`."""
    return lambda: lambda image: sliding.detect_gradients_in(image, weights, bias, settings or sliding.Gradients())


def asked_for(names: str | Iterable[str] | None, known: Iterable[str] = NAMES) -> list[str]:
    """The known ones of ``names`` (a list, or one string with commas), small letters, trimmed, in the order given; nothing asked for is all. ValueError if none is left."""
    known = list(known)
    if names is None or names == "":
        return known
    wanted = [n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names)]
    valid = [n for n in wanted if n in known]
    if not valid:
        raise ValueError("no valid detectors asked for")
    return valid


def run_one(algo: str, gray: bytes, width: int, height: int) -> Iterator[tuple]:
    """Rows of FOUND of one frame."""
    if algo not in _MADE:
        try:
            _MADE[algo] = _MAKERS[algo]()
        except (KeyError, ValueError, OSError) as why:
            _MADE[algo] = f"unknown detector {algo}" if isinstance(why, KeyError) else str(why)
    made = _MADE[algo]
    if isinstance(made, str):
        yield algo, made, None, None, None, None, None, None, None
        return
    if gray is None or width is None or height is None or len(gray) != width * height:
        yield algo, "not a gray frame of its size", None, None, None, None, None, None, None
        return
    start = time.perf_counter()
    boxes = made(np.frombuffer(gray, dtype=np.uint8).reshape(height, width)) if width and height else []
    took = (time.perf_counter() - start) * 1000
    if not boxes:
        yield algo, None, took, None, None, None, None, None, None
    for rank, (x, y, w, h, score) in enumerate(boxes, 1):
        yield algo, None, took, rank, int(x), int(y), int(w), int(h), float(score)


def table_function(more: dict[str, Callable[[], Detector]] | None = None):
    """A table function of (algo, gray, width, height) with the rows FOUND, to be registered or joined laterally. ``more``: makers that go with it to the workers."""
    more = dict(more or {})

    @udtf(returnType=FOUND)
    class Detect:
        def __init__(self) -> None:
            for name, make in more.items():
                if name not in _MAKERS or _MAKERS[name] is not make:
                    register(name, make)

        def eval(self, algo: str, gray: bytes, width: int, height: int):
            yield from run_one(algo, gray, width, height)

    return Detect


def register_function(spark: SparkSession, name: str = "detect", more: dict[str, Callable[[], Detector]] | None = None) -> None:
    """``SELECT * FROM frames, LATERAL detect('haar', gray, width, height)``."""
    spark.udtf.register(name, table_function(more))


def detections(frames: DataFrame, names: str | Iterable[str] | None = None, more: dict[str, Callable[[], Detector]] | None = None) -> DataFrame:
    """``frame`` and FOUND of every packed frame and detector asked for: a lateral join, no shuffle; each frame is read once for each detector."""
    valid = asked_for(names, [*NAMES, *(n for n in more or {} if n not in NAMES)])
    each = frames.select("frame", "width", "height", "gray", F.explode(F.array(*map(F.lit, valid))).alias("asked"))
    call = table_function(more)(F.col("asked").outer(), F.col("gray").outer(), F.col("width").outer(), F.col("height").outer())
    return each.lateralJoin(call).select("frame", "algo", "error", "elapsed_ms", "rank", "x", "y", "w", "h", "score")


def compared(found: DataFrame) -> DataFrame:
    """Of :func:`detections`, by detector: frames, frames with a box, boxes, the best score, milliseconds a frame, and the reason it could not be made."""
    per_frame = found.groupBy("algo", "frame").agg(F.count("rank").alias("boxes"), F.max("score").alias("top"), F.max("elapsed_ms").alias("ms"), F.max("error").alias("error"))
    return per_frame.groupBy("algo").agg(F.count("*").alias("frames"), F.count_if(F.col("boxes") > 0).alias("with_box"), F.sum("boxes").alias("detection_count"), F.max("top").alias("top_score"), F.avg("ms").alias("elapsed_ms"), F.max("error").alias("error"))


def empty_boxes(spark: SparkSession) -> DataFrame:
    """What a detector that finds nothing gives: no rows, the columns of boxes."""
    return spark.createDataFrame([], haar.BOXES)
