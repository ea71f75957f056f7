"""Joins of boxes on geometry, without cross joins.

Boxes of a picture are blocked by the grid cells they touch, so that only boxes
of a common cell meet; of the cells that two boxes share, the one that holds the
upper left corner of their overlap counts, so that each pair appears once and no
distinct is needed. Boxes have columns x0, y0, x1, y1; half-open pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import geometry
from evidentia.operators import greedy

CELL = 128
#: Pairs of boxes that are held at once.
_PAIRS = 1 << 20


def _celled(df: DataFrame, cell: int, pad: int = 0) -> DataFrame:
    span = [F.sequence(F.floor((F.col(a) - pad) / cell), F.floor((F.greatest(F.col(a), F.col(b) - 1) + pad) / cell)) for a, b in (("x0", "x1"), ("y0", "y1"))]
    return df.withColumn("__cx", F.explode(span[0])).withColumn("__cy", F.explode(span[1]))


def _sided(df: DataFrame, group: str, side: str) -> DataFrame:
    kept = [c for c in df.columns if c not in (group, *geometry.SIDES)]
    return df.select(F.col(group), geometry.box(*geometry.SIDES).alias(f"{side}_box"), *(F.col(c).alias(f"{side}_{c}") for c in kept), "__cx", "__cy")


def overlapping(left: DataFrame, right: DataFrame, group: str = "image_id", *, cell: int = CELL) -> DataFrame:
    """Each pair of a left and a right box of one group that share area: group, a_box, b_box, and other columns as a_ and b_."""
    a, b = _sided(_celled(left, cell), group, "a"), _sided(_celled(right, cell), group, "b")
    first = (F.floor(F.greatest("a_box.x0", "b_box.x0") / cell) == F.col("__cx")) & (F.floor(F.greatest("a_box.y0", "b_box.y0") / cell) == F.col("__cy"))
    return a.join(b, [group, "__cx", "__cy"]).where(first & (geometry.intersection(F.col("a_box"), F.col("b_box")) > 0)).drop("__cx", "__cy")


def covered(left: DataFrame, right: DataFrame, least: float, group: str = "image_id", key: str = "seq", *, ratio=geometry.containment, cell: int = CELL) -> DataFrame:
    """group and key of left boxes of which some right box covers at least that share (ratio of left and right box)."""
    pairs = overlapping(left, right, group, cell=cell).where(ratio(F.col("a_box"), F.col("b_box")) >= least)
    return pairs.select(group, F.col(f"a_{key}").alias(key)).distinct()


def drop_covered(left: DataFrame, right: DataFrame, least: float, group: str = "image_id", key: str = "seq", **how) -> DataFrame:
    """The left boxes that no right box covers so far."""
    return left.join(covered(left, right, least, group, key, **how), [group, key], "left_anti")


def keep_covered(left: DataFrame, right: DataFrame, least: float, group: str = "image_id", key: str = "seq", **how) -> DataFrame:
    return left.join(covered(left, right, least, group, key, **how), [group, key], "left_semi")


def best_match(left: DataFrame, right: DataFrame, least: float, score=geometry.of_smaller, group: str = "image_id", key: str = "seq") -> DataFrame:
    """For each left box with a match the right key of the highest score, the first on ties: group, key, match, score."""
    s = score(F.col("a_box"), F.col("b_box"))
    pairs = overlapping(left, right, group).withColumn("score", s).where(F.col("score") >= least)
    best = F.max(F.struct("score", (-F.col(f"b_{key}")).alias("first")))
    return pairs.groupBy(group, F.col(f"a_{key}").alias(key)).agg(best.alias("best")).select(group, key, (-F.col("best.first")).alias("match"), "best.score")


def smallest_container(boxes: DataFrame, least: float = 0.8, group: str = "image_id", key: str = "seq") -> DataFrame:
    """The parent of each box: of the larger boxes that contain that share of it, the smallest, the first on ties; null without one."""
    pairs = overlapping(boxes, boxes, group).where((F.col(f"a_{key}") != F.col(f"b_{key}")) & (geometry.area(F.col("b_box")) > geometry.area(F.col("a_box"))) & (geometry.containment(F.col("a_box"), F.col("b_box")) >= least))
    least_area = F.min(F.struct(geometry.area(F.col("b_box")).alias("area"), F.col(f"b_{key}").alias("parent")))
    found = pairs.groupBy(group, F.col(f"a_{key}").alias(key)).agg(least_area.alias("p")).select(group, key, "p.parent")
    return boxes.join(found, [group, key], "left").select(group, key, "parent")


def centred(elements: DataFrame, sections: DataFrame, group: str = "image_id", *, cell: int = CELL) -> DataFrame:
    """Each pair of an element and a section whose closed box holds the element's centre: group, a_own, b_own (their boxes), and other columns as a_ and b_. An element is in the cell of its centre only, so that each pair meets once."""
    middle = {c: F.floor((F.col(f"{x}0") + F.col(f"{x}1")) / 2 / cell) for c, x in (("__cx", "x"), ("__cy", "y"))}
    a, b = (_sided(_closed(df), group, side) for df, side in ((elements.withColumns(middle), "a"), (_celled(sections, cell, 1), "b")))
    met = a.join(b, [group, "__cx", "__cy"]).where((geometry.intersection(F.col("a_box"), F.col("b_box")) > 0) & geometry.center_inside(F.col("a_own"), F.col("b_own")))
    return met.drop("__cx", "__cy", "a_box", "b_box")


def section_of(elements: DataFrame, sections: DataFrame, group: str = "image_id", key: str = "seq", *, kept: tuple[str, ...] = ()) -> DataFrame:
    """The smallest section whose closed box holds each element's centre, the first on ties; null for the root: group, key, section, and the elements' columns kept."""
    pairs = centred(elements.select(group, key, *geometry.SIDES), sections.select(group, key, *geometry.SIDES), group)
    best = F.min(F.struct(geometry.area(F.col("b_own")).alias("area"), F.col(f"b_{key}").alias("section")))
    found = pairs.groupBy(group, F.col(f"a_{key}").alias(key)).agg(best.alias("s")).select(group, key, "s.section")
    return elements.join(found, [group, key], "left").select(group, key, "section", *kept)


def _closed(df: DataFrame) -> DataFrame:
    """Boxes one pixel wider, so that touching ones meet, with their own box as column own."""
    return df.withColumn("own", geometry.box(*geometry.SIDES)).withColumns({"x0": F.col("x0") - 1, "y0": F.col("y0") - 1, "x1": F.col("x1") + 1, "y1": F.col("y1") + 1})


def labels(objects: DataFrame, readings: DataFrame, text: str, least: float = 0.3, most: int = 3, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Each object's first texts that overlap it by that share of the smaller box, in order of key."""
    pairs = overlapping(objects, readings, group).where(geometry.of_smaller(F.col("a_box"), F.col("b_box")) >= least)
    found = F.array_sort(F.collect_list(F.struct(F.col(f"b_{key}").alias("k"), F.col(f"b_{text}").alias("t"))))
    return pairs.groupBy(group, F.col(f"a_{key}").alias(key)).agg(F.slice(F.transform(found, lambda x: x["t"]), 1, most).alias("labels"))


def layout_gaps(blocks: DataFrame, most: int = 64, touching: int = 4, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Gaps between neighbours: pairs whose extents overlap by 30 % on one axis, neither near-duplicates nor nested, at most that many pixels apart on the other."""
    kinds = blocks.schema[key].dataType.simpleString(), blocks.schema["x0"].dataType.simpleString()

    def step(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, list]:
        own = np.zeros(len(columns["seq"]), np.int64)
        own[starts[1:]] = 1
        own = np.cumsum(own)
        order = np.lexsort((columns["x0"], own))
        low, reach = columns["x0"].min(), int(max(columns["x1"].max(), columns["x0"].max()) - columns["x0"].min()) + most + 2
        place = own[order] * float(reach) + (columns["x0"][order] - low)
        # along x, boxes meet those that begin no further right than most pixels behind them
        ends = np.searchsorted(place, own[order] * float(reach) + np.minimum(columns["x1"][order] - low + most + 1, reach), "left")
        n = np.maximum(ends - np.arange(len(order)) - 1, 0)
        total, k, out = np.cumsum(n), 0, []
        while k < len(n):
            end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _PAIRS, "right")))
            i = np.repeat(np.arange(k, end), n[k:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[k:end]) - n[k:end], n[k:end])
            out.append(_gaps(columns, order[i], order[j], most, touching))
            k = end
        i, j, up, px, span, touch = (np.concatenate([x[c] for x in out]) for c in range(6))
        return i, [columns["seq"][i], columns["seq"][j], pa.array(["x", "y"]).take(pa.array(up.astype(int))), px, span, touch]

    known = blocks.where(F.col(group).isNotNull()).dropna(subset=[key, *geometry.SIDES]).select(group, F.col(key).alias("seq"), *geometry.SIDES)
    types = f"first {kinds[0]}, second {kinds[0]}, axis string, px {kinds[1]}, span {kinds[1]}, touching boolean"
    return greedy.each_batch(known, group, [], ["seq", *geometry.SIDES], ["first", "second", "axis", "px", "span", "touching"], types, step)


def _gaps(columns: dict, i: np.ndarray, j: np.ndarray, most: int, touching: int) -> tuple[np.ndarray, ...]:
    """layout_gaps() of pairs of rows: the two rows in order of seq, whether the axis is y, px, span, touching."""
    later = columns["seq"][i] > columns["seq"][j]
    i, j = np.where(later, j, i), np.where(later, i, j)
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = (columns[c][k] for k in (i, j) for c in geometry.SIDES)
    ox, oy = np.minimum(ax1, bx1) - np.maximum(ax0, bx0), np.minimum(ay1, by1) - np.maximum(ay0, by0)
    wx, wy = np.minimum(ax1 - ax0, bx1 - bx0), np.minimum(ay1 - ay0, by1 - by0)
    near = (columns["seq"][i] < columns["seq"][j]) & (ox + most + 1 > 0) & (oy + most + 1 > 0)
    up = ox >= 0.3 * wx
    gap = np.where(up, np.where(by0 < ay0, ay0 - by1, by0 - ay1), np.where(bx0 < ax0, ax0 - bx1, bx0 - ax1))
    nested = (ax0 >= bx0 + 4) & (ay0 >= by0 + 4) & (ax1 <= bx1 - 4) & (ay1 <= by1 - 4) | (bx0 >= ax0 + 4) & (by0 >= ay0 + 4) & (bx1 <= ax1 - 4) & (by1 <= ay1 - 4)
    kept = near & (up | (oy >= 0.3 * wy)) & ~((ox > 0.75 * wx) & (oy > 0.75 * wy)) & ~nested & (gap <= most)
    return i[kept], j[kept], up[kept], np.maximum(gap, 0)[kept], np.where(up, ox, oy)[kept], (gap <= touching)[kept]


def padding_inside(sections: DataFrame, readings: DataFrame, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Distances from each section's edges to the outermost readings that lie inside it."""
    pairs = overlapping(sections, readings, group).where(geometry.inside(F.col("b_box"), F.col("a_box"), 0) & (F.col(f"a_{key}") != F.col(f"b_{key}")))
    gaps = {"left": F.min(F.col("b_box.x0") - F.col("a_box.x0")), "top": F.min(F.col("b_box.y0") - F.col("a_box.y0")), "right": F.min(F.col("a_box.x1") - F.col("b_box.x1")), "bottom": F.min(F.col("a_box.y1") - F.col("b_box.y1"))}
    return pairs.groupBy(group, F.col(f"a_{key}").alias(key)).agg(*(c.alias(k) for k, c in gaps.items()))


def confirmed_by(blocks: DataFrame, readings: DataFrame, least: float = 0.3, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Each block with has_text: whether some reading overlaps it by that share of the smaller box."""
    hit = covered(blocks, readings, least, group, key, ratio=geometry.of_smaller).withColumn("__hit", F.lit(True))
    return blocks.join(hit, [group, key], "left").withColumn("has_text", F.coalesce("__hit", F.lit(False))).drop("__hit")


def exactly_one_label(outlines: DataFrame, texts: DataFrame, least: float = 0.82, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Outlines that cover exactly one text by that share: group, key, label."""
    pairs = overlapping(texts, outlines, group).where((geometry.containment(F.col("a_box"), F.col("b_box")) >= least) & (F.col(f"a_{key}") != F.col(f"b_{key}")))
    return pairs.groupBy(group, F.col(f"b_{key}").alias(key)).agg(F.count("*").alias("n"), F.min(f"a_{key}").alias("label")).where("n = 1").drop("n")


def role(kind: Column, labelled: Column, over_text: Column) -> Column:
    """What an element is to be rebuilt as."""
    return (
        F.when(kind == "text", "live-text-required")
        .when(kind == "button", F.when(labelled, "semantic-control-candidate").otherwise("decorative-shape"))
        .when(kind == "image", F.when(over_text, "raster-forbidden-overlaps-text").otherwise("raster-asset-candidate"))
        .otherwise(F.coalesce(kind, F.lit("unknown")))
    )


def inside_parts(outer: DataFrame, inner: DataFrame, pad: int = 4, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Each inner box that lies in an outer one, up to pad pixels beyond its edges: group, key of the outer box, part, kind of the part; no box is its own part."""
    wide = outer.withColumn("own", geometry.box(*geometry.SIDES)).withColumns({"x0": F.col("x0") - pad - 1, "y0": F.col("y0") - pad - 1, "x1": F.col("x1") + pad + 1, "y1": F.col("y1") + pad + 1})
    pairs = overlapping(wide, inner, group).where((F.col(f"a_{key}") != F.col(f"b_{key}")) & geometry.inside(F.col("b_box"), F.col("a_own"), pad))
    return pairs.select(group, F.col(f"a_{key}").alias(key), F.col(f"b_{key}").alias("part"), F.col("b_kind").alias("part_kind"))


def section_role(kind: Column, box: Column, n_texts: Column, n_buttons: Column, cap_height: Column, largest_cap: Column, width: int, height: int) -> Column:
    """A section's role by its place, size and content; the first rule that holds decides."""
    w, h, top = geometry.width(box), geometry.height(box), box["y0"]
    return (
        F.when(kind == "texture", "graphic")
        .when((h < height * 0.18) & (top < height * 0.15) & (n_texts >= 2), "nav")
        .when(n_buttons >= 2, "cta")
        .when((h < height * 0.14) & (w < width * 0.55) & (n_texts > 0), "badge")
        .when((top < height * 0.2) & (h < height * 0.3), "header")
        .when(top > height * 0.85, "footer")
        .when((cap_height > 0) & (cap_height >= largest_cap * 0.8), "hero")
        .otherwise("content")
    )


def adjacent_lines(current: Column, neighbour: Column, above: bool) -> Column:
    """Whether a line is the next one above (or below): extents that share 55 % of the narrower, centres at most 1.45 of the taller line apart."""
    narrow = F.greatest(F.least(geometry.width(current), geometry.width(neighbour)), F.lit(1))
    share = F.greatest(geometry.overlap_x(current, neighbour), F.lit(0)) / narrow
    apart = ((neighbour["y0"] + neighbour["y1"]) - (current["y0"] + current["y1"])) / 2
    tall = F.greatest(geometry.height(current), geometry.height(neighbour), F.lit(1))
    return (share >= 0.55) & (apart < 0 if above else apart > 0) & (F.abs(apart) <= tall * 1.45)


def located(readings: DataFrame, queries: DataFrame, group: str, *, text: str = "text", confidence: str = "confidence", key: str = "seq", most: int = 5) -> DataFrame:
    """For each group's query the readings that equal, contain or lie in it, without regard to case: the surest, the first on ties, how many there are, and the first keys; none is found where best is null."""
    needle, hay = F.lower(F.trim("query")), F.lower(F.col(text))
    hits = readings.join(queries.select(group, "query"), group).where((needle != "") & (F.contains(hay, needle) | F.contains(needle, hay)))
    best = F.max(F.struct(F.col(confidence), (-F.col(key)).alias("minus"))).alias("best")
    found = hits.groupBy(group).agg(best, F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(key)), 1, most).alias("matches"))
    return queries.select(group).join(found, group, "left").select(group, (-F.col("best.minus")).alias("best"), F.col(f"best.{confidence}").alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"), "matches")


def cell_width(readings: DataFrame, group: str, *, text: str, glyph_width: str) -> DataFrame:
    """The width of a character cell: the median of measured glyph widths, else of box width by characters; null where neither is known."""
    by_box = F.when((F.length(text) > 0) & (F.col("x1") > F.col("x0")), (F.col("x1") - F.col("x0")) / F.length(text))
    return readings.groupBy(group).agg(F.coalesce(F.median(F.when(F.col(glyph_width) > 0, F.col(glyph_width).cast("double"))), F.median(by_box)).alias("cell_width"))


def unresolved_focus(readings: DataFrame, covers: DataFrame, limit: int, width: int, height: int, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Regions to look at again: unresolved readings that no cover hides by half, the least sure first, then the largest, clipped to the canvas; limit to a group."""
    box = geometry.box(*geometry.SIDES)
    open_ = drop_covered(readings.where("resolution = 'unresolved'"), covers, 0.5, group, key)
    order = F.struct((-(1.0 - F.coalesce("confidence", F.lit(0.0)))).alias("sure"), (-F.greatest(geometry.area(box), F.lit(1))).alias("area"), F.col(key).alias("k"), *(F.least(F.greatest(F.col(c), F.lit(0)), F.lit(width if c[0] == "x" else height)).alias(c) for c in geometry.SIDES))
    top = open_.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(order)), 1, max(0, limit)).alias("top")).select(group, F.posexplode("top").alias("at", "r"))
    return top.select(group, F.col("r.k").alias(key), (F.col("at") + 1).alias("rank"), F.col("r.x0").alias("x"), F.col("r.y0").alias("y"), (F.col("r.x1") - F.col("r.x0")).alias("width"), (F.col("r.y1") - F.col("r.y0")).alias("height"))
