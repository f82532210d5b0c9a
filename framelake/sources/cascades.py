"""Cascade files: the binary form RFCF, version 2, in both directions, the XML form, and both as tables."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values of the file format: magic, version, and the kinds of features; the last lists its rectangles in pixels.
MAGIC, VERSION = b"RFCF", 2
VERTICAL_EDGE, HORIZONTAL_EDGE, DIAGONAL_EDGE, VERTICAL_CENTER, HORIZONTAL_CENTER, CUSTOM_RECTS = range(6)


class Feature(NamedTuple):
    """``rects``: (x, y, w, h, weight)."""

    kind: int
    width: int
    height: int
    rects: tuple[tuple[int, int, int, int, float], ...]


class WeakFeature(NamedTuple):
    feature: int
    threshold: float
    sign: int
    left: float
    right: float


class CascadeFile(NamedTuple):
    """``stages``: threshold and weak features."""

    width: int
    height: int
    features: tuple[Feature, ...]
    stages: tuple[tuple[float, tuple[WeakFeature, ...]], ...]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise ValueError("cascade ends early")
        self.at += size
        return struct.unpack_from(form, self.data, self.at - size)


def read_rfcf(data: bytes) -> CascadeFile:
    """ValueError for another magic, an unknown kind or a file that ends early. Little-endian throughout."""
    r = _Reader(data)
    magic, _, width, height, n_features = r.take("<4s4I")
    if magic != MAGIC:
        raise ValueError("not a cascade")
    features = []
    for _ in range(n_features):
        kind, w, h, n = r.take("<3BI")
        if kind > CUSTOM_RECTS:
            raise ValueError("unknown kind of feature")
        features.append(Feature(kind, w, h, tuple(r.take("<4Bf") for _ in range(n))))
    stages = []
    for _ in range(*r.take("<I")):
        threshold, n = r.take("<fI")
        stages.append((threshold, tuple(WeakFeature(*r.take("<Ifb2f")) for _ in range(n))))
    return CascadeFile(width, height, tuple(features), tuple(stages))


def write_rfcf(cascade: CascadeFile) -> bytes:
    out = [struct.pack("<4s4I", MAGIC, VERSION, cascade.width, cascade.height, len(cascade.features))]
    for f in cascade.features:
        out += [struct.pack("<3BI", f.kind, f.width, f.height, len(f.rects)), *(struct.pack("<4Bf", *r) for r in f.rects)]
    out.append(struct.pack("<I", len(cascade.stages)))
    for threshold, weak in cascade.stages:
        out += [struct.pack("<fI", threshold, len(weak)), *(struct.pack("<Ifb2f", *w) for w in weak)]
    return b"".join(out)


def read_xml(text: str) -> CascadeFile:
    """The widely used XML form: every feature as rectangles in pixels; a weak feature's first leaf is its left value."""
    root = ET.fromstring(text)
    top = next((e for e in (root.find("cascade"), *root) if e is not None and e.find("stages") is not None), None)
    if top is None:
        raise ValueError("not a cascade")
    size = (top.findtext("size") or f"{top.findtext('width')} {top.findtext('height')}").split()
    numbers = lambda e, tag: [float(x) for x in (e.findtext(tag) or "").split()]

    def rect(text: str) -> tuple[int, int, int, int, float]:
        x, y, w, h, weight = (float(v) for v in text.split())
        byte = lambda v, least: max(least, min(255, int(v)))
        return byte(x, 0), byte(y, 0), byte(w, 1), byte(h, 1), weight

    features = tuple(Feature(CUSTOM_RECTS, 0, 0, tuple(rect(r.text) for r in f.findall("rects/_"))) for f in top.findall("features/_"))
    stages = []
    for stage in top.findall("stages/_"):
        weak = []
        for w in stage.findall("weakClassifiers/_"):
            nodes, leaves = numbers(w, "internalNodes"), numbers(w, "leafValues")
            weak.append(WeakFeature(int(nodes[2]), nodes[3], 1, leaves[0], leaves[1]))
        stages.append((float(stage.findtext("stageThreshold")), tuple(weak)))
    return CascadeFile(int(size[0]), int(size[1]), features, tuple(stages))


TABLES = (
    "path string, problem string, width int, height int, "
    "features array<struct<kind:int,width:int,height:int,rects:array<struct<x:int,y:int,w:int,h:int,weight:float>>>>, "
    "stages array<struct<threshold:float,weak:array<struct<feature:int,threshold:float,sign:int,left:float,right:float>>>>"
)


def scan_cascades(spark: SparkSession, path: str) -> DataFrame:
    """TABLES: a row for every file of ``path``, ``.xml`` or binary; a broken file gives its problem, not a failed job."""

    def run(rows):
        for batch in rows:
            for p, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    c = read_xml(content.decode("utf-8")) if p.lower().endswith(".xml") else read_rfcf(content)
                    yield [(p, None, *c)]
                except (ValueError, ET.ParseError, TypeError, IndexError) as why:
                    yield [(p, str(why), None, None, None, None)]

    form = to_arrow_schema(StructType.fromDDL(TABLES))

    def as_arrow(batches):
        for rows in run(batches):
            named = []
            for p, problem, w, h, features, stages in rows:
                of = lambda f: {"kind": f.kind, "width": f.width, "height": f.height, "rects": [dict(zip("x y w h weight".split(), r, strict=True)) for r in f.rects]}
                named.append({
                    "path": p, "problem": problem, "width": w, "height": h, "features": None if features is None else [of(f) for f in features],
                    "stages": None if stages is None else [{"threshold": t, "weak": [x._asdict() for x in weak]} for t, weak in stages],
                })
            yield pa.RecordBatch.from_pylist(named, schema=form)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(as_arrow, TABLES)


def weak_table(cascades: DataFrame) -> DataFrame:
    """A dump: ``path``, ``stage``, ``stage_threshold``, ``weak_no`` and the weak feature's values, one row each."""
    stages = cascades.select("path", F.posexplode("stages").alias("stage", "s"))
    weak = stages.select("path", "stage", F.col("s.threshold").alias("stage_threshold"), F.posexplode("s.weak").alias("weak_no", "w"))
    return weak.select("path", "stage", "stage_threshold", "weak_no", "w.*")
