"""Boxes (struct x0, y0, x1, y1; half-open pixels) as Column expressions; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(x.alias(k) if isinstance(x, Column) else F.col(x).alias(k) for x, k in zip((x0, y0, x1, y1), SIDES, strict=True)))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def overlap_x(a: Column, b: Column) -> Column:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def overlap_y(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def intersection(a: Column, b: Column) -> Column:
    """Common area; 0 where the boxes don't meet."""
    return F.greatest(overlap_x(a, b), F.lit(0)) * F.greatest(overlap_y(a, b), F.lit(0))


def iou(a: Column, b: Column) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), area(a) + area(b) - intersection(a, b))


def match_score(a: Column, b: Column) -> Column:
    """IoU, or 0.82 of the share of the smaller box that is covered."""
    smaller = F.least(F.greatest(F.lit(1), area(a)), F.greatest(F.lit(1), area(b)))
    return F.greatest(iou(a, b), F.lit(0.82) * intersection(a, b) / smaller)


def of_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    smaller = F.least(area(a), area(b))
    return F.when((intersection(a, b) > 0) & (smaller > 0), intersection(a, b) / smaller).otherwise(0.0)


def containment(child: Column, parent: Column) -> Column:
    """The share of the child that the parent covers."""
    return F.when((intersection(child, parent) > 0) & (area(child) > 0), intersection(child, parent) / area(child)).otherwise(0.0)


def coverage(subject: Column, covering: Column) -> Column:
    """Intersection over the subject's area, of at least 1."""
    return intersection(subject, covering) / F.greatest(F.lit(1.0), area(subject).cast("double"))


def inside(inner: Column, outer: Column, pad: int = 2) -> Column:
    return (inner["x0"] >= outer["x0"] - pad) & (inner["y0"] >= outer["y0"] - pad) & (inner["x1"] <= outer["x1"] + pad) & (inner["y1"] <= outer["y1"] + pad)


def center_inside(inner: Column, outer: Column) -> Column:
    """Whether the centre lies in the outer box, edges included."""
    return ((inner["x0"] + inner["x1"]) / 2).between(outer["x0"], outer["x1"]) & ((inner["y0"] + inner["y1"]) / 2).between(outer["y0"], outer["y1"])


def source_match(a: Column, b: Column) -> Column:
    """Intersection over the smaller area (of at least 1), at most 1."""
    return F.least(F.lit(1.0), intersection(a, b) / F.least(F.greatest(F.lit(1.0), area(a).cast("double")), F.greatest(F.lit(1.0), area(b).cast("double"))))


def _each(b: Column, x, y) -> Column:
    return F.struct(*((x if k[0] == "x" else y)(b[k]).cast("int").alias(k) for k in SIDES))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(low if isinstance(low, Column) else F.lit(low), F.least(high if isinstance(high, Column) else F.lit(high), c))


def identity_transform(w: Column, h: Column) -> Column:
    return crop_transform(w, h, box(F.lit(0), F.lit(0), w, h), w, h)


def crop_transform(source_w: Column, source_h: Column, region: Column, analysis_w: Column, analysis_h: Column) -> Column:
    """The transform from a crop, resized to the analysis size, to its source."""
    return F.struct(
        source_w.alias("source_w"),
        source_h.alias("source_h"),
        (width(region) / analysis_w).alias("scale_x"),
        (height(region) / analysis_h).alias("scale_y"),
        region["x0"].cast("double").alias("offset_x"),
        region["y0"].cast("double").alias("offset_y"),
    )


def to_source(b: Column, t: Column) -> Column:
    """Map an analysis box to its source by a transform, rounded, then clamped."""
    return _each(b, lambda v: clamp(F.bround(v * t["scale_x"] + t["offset_x"]), 0, t["source_w"]), lambda v: clamp(F.bround(v * t["scale_y"] + t["offset_y"]), 0, t["source_h"]))


def point_to_source(x: Column, y: Column, t: Column) -> Column:
    return F.struct(clamp(F.bround(x * t["scale_x"] + t["offset_x"]), 0, t["source_w"]).cast("int").alias("x"), clamp(F.bround(y * t["scale_y"] + t["offset_y"]), 0, t["source_h"]).cast("int").alias("y"))


def permille(b: Column, w: Column, h: Column) -> Column:
    """Thousandths of the canvas, clamped to 0 to 1000."""
    return _each(b, lambda v: clamp(F.bround(v * 1000 / w), 0, 1000), lambda v: clamp(F.bround(v * 1000 / h), 0, 1000))


def rescale(b: Column, canvas_w: Column, canvas_h: Column, view_w: Column, view_h: Column) -> Column:
    """Viewport pixels as canvas pixels."""
    return _each(b, lambda v: F.bround(v * canvas_w / F.greatest(F.lit(1), view_w)), lambda v: F.bround(v * canvas_h / F.greatest(F.lit(1), view_h)))


def padded(b: Column, w: Column, h: Column) -> Column:
    """Half the width and twice the height more on either side, 16 pixels at least, within the canvas."""
    px, py = F.greatest(F.lit(16), F.bround(width(b) * 0.5)), F.greatest(F.lit(16), F.bround(height(b) * 2.0))
    return F.struct(F.greatest(F.lit(0), b["x0"] - px).cast("int").alias("x0"), F.greatest(F.lit(0), b["y0"] - py).cast("int").alias("y0"), F.least(w, b["x1"] + px).cast("int").alias("x1"), F.least(h, b["y1"] + py).cast("int").alias("y1"))


def delta(reference: Column, candidate: Column) -> Column:
    """Candidate less reference: x, y, width, height."""
    return F.struct((candidate["x0"] - reference["x0"]).alias("x"), (candidate["y0"] - reference["y0"]).alias("y"), (width(candidate) - width(reference)).alias("width"), (height(candidate) - height(reference)).alias("height"))
