"""Boxes: structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return w * h / F.when(union == 0, 1.0).otherwise(union)


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def padded(b: Column, by: Column, width: Column, height: Column) -> Column:
    """Grown by ``by`` to whole pixels and clipped to the frame."""
    x, y = F.greatest(F.lit(0), F.floor(b["x"] - by)), F.greatest(F.lit(0), F.floor(b["y"] - by))
    return box(x, y, F.least(width, F.ceil(b["x"] + b["w"] + by)) - x, F.least(height, F.ceil(b["y"] + b["h"] + by)) - y)


def clipped(b: Column, width: Column, height: Column, least: int = 48) -> Column:
    """Clipped to the frame in whole pixels; null if a side is under ``least``."""
    c = padded(b, F.lit(0), width, height)
    return F.when((c["w"] >= least) & (c["h"] >= least), c)


def shifted(b: Column, by: Column) -> Column:
    return box(b["x"] + by["x"], b["y"] + by["y"], b["w"], b["h"])


def scaled(b: Column, factor: Column) -> Column:
    return box(b["x"] * factor, b["y"] * factor, b["w"] * factor, b["h"] * factor)


def span_box(line: Column, length: Column, start: Column, end: Column) -> Column:
    """The part of a text line's box for a span of characters, a character wider on both sides."""
    one = line["w"] / F.greatest(F.lit(1), length)
    a = F.greatest(line["x"], line["x"] + one * start - one)
    b = F.least(line["x"] + line["w"], line["x"] + one * end + one)
    return box(a, line["y"], b - a, line["h"])


def grown(b: Column, share: float = 0.3) -> Column:
    return box(b["x"] - b["w"] * share / 2, b["y"] - b["h"] * share / 2, b["w"] * (1 + share), b["h"] * (1 + share))


def unclipped(b: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """A shrunken text box grown by 1.5 times area over perimeter, scaled and clipped to the image."""
    d = b["w"] * b["h"] / (2 * (b["w"] + b["h"])) * 1.5
    x, y = F.greatest(F.lit(0.0), (b["x"] - d) * sx), F.greatest(F.lit(0.0), (b["y"] - d) * sy)
    return box(x, y, F.least(width - x, (b["w"] + 2 * d) * sx), F.least(height - y, (b["h"] + 2 * d) * sy))


def suppress(faces: Column, limit: float = 0.3) -> Column:
    """Of boxes with scores (structs of score, box) the best, each without others that overlap it by more than ``limit``; of equal scores the one that stands first."""
    ordered = F.array_sort(faces, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), lambda kept, f: F.when(F.exists(kept, lambda k: iou(k["box"], f["box"]) > limit), kept).otherwise(F.concat(kept, F.array(f))))


def face_box(index: Column, columns: Column, stride: Column, dx: Column, dy: Column, dw: Column, dh: Column, ratio: Column) -> Column:
    """A face detector's box from a cell of its grid, in the pixels of the image that was scaled by ``ratio``."""
    cx, cy = (index % columns + dx) * stride, (F.floor(index / columns) + dy) * stride
    w, h = F.exp(dw) * stride, F.exp(dh) * stride
    return box((cx - w / 2) / ratio, (cy - h / 2) / ratio, w / ratio, h / ratio)


def face_score(cls: Column, obj: Column) -> Column:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.sqrt(unit(cls) * unit(obj))


def union_share(boxes: Column, width: Column, height: Column, by: int = 4) -> Column:
    """Share of a frame's pixels under boxes grown by ``by``: widths of the union of intervals, band by band between the boxes' edges."""
    cut = F.transform(boxes, lambda b: padded(b, F.lit(by), width, height))
    cut = F.filter(cut, lambda b: (b["w"] > 0) & (b["h"] > 0))
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform(cut, lambda b: F.array(b["y"], b["y"] + b["h"])))))

    def covered(y: Column) -> Column:
        rows = F.array_sort(F.transform(F.filter(cut, lambda b: (b["y"] <= y) & (y < b["y"] + b["h"])), lambda b: F.struct(b["x"].alias("a"), (b["x"] + b["w"]).alias("b"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("to"))
        return F.aggregate(rows, start, lambda acc, r: F.struct((acc["sum"] + F.greatest(F.lit(0.0), r["b"] - F.greatest(acc["to"], r["a"]))).alias("sum"), F.greatest(acc["to"], r["b"]).alias("to")), lambda acc: acc["sum"])

    bands = F.zip_with(F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), lambda a, b: (b - a) * covered(a))
    return F.when(F.size(cut) == 0, F.lit(0.0)).otherwise(F.aggregate(bands, F.lit(0.0), lambda s, v: s + v) / (width * height))
