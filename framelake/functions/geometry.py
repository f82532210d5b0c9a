"""Box arithmetic as column expressions; a box is four integer columns or a struct of ``x``, ``y``, ``w``, ``h``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(a, b) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a, b, kind: str = "float") -> Column:
    """Intersection over union; ``kind`` float divides in single precision as the threshold tests do."""
    inter = intersection(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when((inter > 0) & (union > 0), inter.cast(kind) / union.cast(kind)).otherwise(F.lit(0.0).cast(kind)).cast(kind)


def columns(*names: str) -> dict[str, Column]:
    return {key: F.col(name) for key, name in zip("xywh", names or "xywh", strict=True)}


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def round_half_up(value: Column) -> Column:
    """Half away from zero for values that are not negative."""
    return F.floor(value + 0.5)


def rotate_back(code: Column, width: Column, height: Column) -> dict[str, Column]:
    """A box found in a turned frame, in the frame's own pixels; codes 90cw, 90ccw, 180, anything else stays."""
    x, y, w, h = (F.col(c) for c in "xywh")
    pick = lambda cw, ccw, half, own: F.when(code == "90cw", cw).when(code == "90ccw", ccw).when(code == "180", half).otherwise(own)
    turned = code.isin("90cw", "90ccw")
    return {"x": pick(height - y - h, y, width - x - w, x), "y": pick(x, width - x - w, height - y - h, y), "w": F.when(turned, h).otherwise(w), "h": F.when(turned, w).otherwise(h)}


def padded(pad: float, width: int, height: int) -> dict[str, Column]:
    """Corners of a box grown by a share of its sides, within the frame."""
    x, y, w, h = (F.col(c) for c in "xywh")
    dx, dy = F.floor(w * pad), F.floor(h * pad)
    return {"x0": F.greatest(x - dx, F.lit(0)), "y0": F.greatest(y - dy, F.lit(0)), "x1": F.least(x + w + dx, F.lit(width)), "y1": F.least(y + h + dy, F.lit(height))}
