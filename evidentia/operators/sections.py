"""The section tree of a picture: regions cut at empty bands, their content, roles and summary.

What is on a picture is a set of rectangles that don't overlap. Pictures of few
boxes are cut in one pass over partitions, level by level for all pictures of a
batch. Those of many stay distributed: each level finds the widest empty band of all regions of all
pictures in one pass of windows over the places where the profile along an axis
changes, and gives every rectangle to the part it falls in. So a level shuffles
the rectangles of regions that may still be cut once, and there are no more
levels than depth.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import color, geometry
from evidentia.lineage import cut as written
from evidentia.operators import spatial
from evidentia.shipping import ship

#: Narrowest band that is cut, least side of a part, and most levels.
BAND, SIDE, DEPTH = 12, 40, 10
#: Most boxes of a picture that is cut within one task.
LARGE = 4096
#: Least area and side of the content of a section.
LEAST_AREA, LEAST_SIDE = 400, 24
_KEPT_ROLES = ("nav", "badge", "footer", "graphic")


def disjoint(boxes: DataFrame, group: str = "image_id") -> DataFrame:
    """Rectangles (group, x0, y0, x1, y1) that cover what boxes cover and don't overlap: intervals merged within the slabs between the ordinates of a group's boxes. Empty boxes, and ones with a null side or group, cover nothing."""
    real = boxes.where("x0 < x1 AND y0 < y1").select(group, *geometry.SIDES)
    edges = real.groupBy(group).agg(F.array_sort(F.array_union(F.collect_set("y0"), F.collect_set("y1"))).alias("__edges"))
    held = real.join(edges, group).select(group, "x0", "x1", F.explode(F.filter("__edges", lambda y: (y >= F.col("y0")) & (y <= F.col("y1")))).alias("__y"), F.col("y1").alias("__end"))
    slab = Window.partitionBy(group, "__y")
    new = F.col("x0") > F.max("x1").over(slab.orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    runs = held.where("__y < __end").withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(slab.orderBy("x0", "x1")))
    merged = runs.groupBy(group, "__y", "__run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    after = edges.select(group, F.explode(F.arrays_zip(F.col("__edges").alias("lo"), F.slice("__edges", 2, 1 << 30).alias("hi"))).alias("s")).where("s.hi IS NOT NULL").select(group, F.col("s.lo").alias("__y"), "s.hi")
    return merged.join(after, [group, "__y"]).select(group, "x0", F.col("__y").alias("y0"), "x1", F.col("hi").alias("y1"))


def widest_bands(rects: DataFrame, keys: list[str], least: int = BAND) -> DataFrame:
    """For each key and axis ('y' or 'x') with one the widest band that is nearly empty, between filled ones, the first on ties: keys, axis, start, end.

    The profile of rows or columns counts covered pixels; up to 2 % of its most,
    or one pixel, is nearly empty. Rectangles don't overlap.
    """
    spans = {"y": ("y0", "y1", F.col("x1") - F.col("x0")), "x": ("x0", "x1", F.col("y1") - F.col("y0"))}
    steps = F.array(*(F.struct(F.lit(axis).alias("axis"), F.col(at).alias("at"), (sign * n).alias("n")) for axis, (lo, hi, n) in spans.items() for at, sign in ((lo, 1), (hi, -1))))
    changes = rects.select(*keys, F.explode(steps).alias("e")).groupBy(*keys, "e.axis", "e.at").agg(F.sum("e.n").alias("n"))
    line = Window.partitionBy(*keys, "axis")
    level = changes.withColumn("filled", F.sum("n").over(line.orderBy("at"))).withColumn("next", F.lead("at").over(line.orderBy("at"))).withColumn("most", F.max("filled").over(line))
    full = level.where(F.col("filled") > F.greatest(F.lit(1), F.floor(F.col("most") * 0.02)))
    before = F.lag("next").over(line.orderBy("at"))
    bands = full.withColumn("start", before).where(F.col("at") - F.col("start") >= least)
    best = F.max(F.struct((F.col("at") - F.col("start")).alias("wide"), (-F.col("start")).alias("first"), "start", F.col("at").alias("end")))
    return bands.groupBy(*keys, "axis").agg(best.alias("b")).select(*keys, "axis", "b.start", "b.end")


def cut_regions(rects: DataFrame, canvas: DataFrame, group: str = "image_id", *, band: int = BAND, side: int = SIDE, depth: int = DEPTH) -> DataFrame:
    """Regions that no band cuts any more: group, region (0 and 1 for the first and second part of each cut, so regions sort in reading order), x0, y0, x1, y1.

    canvas has one box for each group. A region with both sides of at least side
    is cut in the middle of its widest band of rows, or of columns where no band
    of rows is; if a part would be smaller than side, it stays whole. A group
    without rectangles is one region; rectangles of a null group, or of a group
    without canvas, count for nothing.
    """
    keys = [group, "region"]
    regions = canvas.select(group, F.lit("").alias("region"), *geometry.SIDES)
    rects = written(rects.join(canvas.select(group), group, "left_semi").select(group, F.lit("").alias("region"), *geometry.SIDES), "cut-rects")
    done: list[DataFrame] = []
    for _ in range(depth):
        dealt = rects.repartition(*keys)
        bands = widest_bands(dealt, keys, band).groupBy(*keys).agg(F.min(F.struct((F.col("axis") == "x").alias("later"), "axis", F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("at"))).alias("b")).select(*keys, "b.axis", "b.at")
        found = regions.join(bands, keys, "left")
        low, high = (F.when(F.col("axis") == "y", F.col(f"y{k}")).otherwise(F.col(f"x{k}")) for k in (0, 1))
        may = (F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side) & (F.col("at") - low >= side) & (high - F.col("at") >= side)
        found = written(found.withColumn("cuts", F.coalesce(may, F.lit(False))), "cut-regions")
        done.append(found.where("NOT cuts").select(*keys, *geometry.SIDES))
        cuts = found.where("cuts")
        if not cuts.head(1):
            break
        regions = _parts(cuts, "region").select(*keys, *geometry.SIDES)
        split = dealt.join(cuts.select(*keys, "axis", "at"), keys)
        rects = written(_parts(split, "region").where("x0 < x1 AND y0 < y1").select(*keys, *geometry.SIDES), "cut-rects")
    else:
        done.append(regions)
    return reduce(DataFrame.unionByName, done)


def _parts(df: DataFrame, region: str) -> DataFrame:
    """Both parts of each box that a cut (axis, at) makes, clipped to it; region is carried on by 0 and 1."""
    twice = df.withColumn("__part", F.explode(F.array(F.lit(0), F.lit(1))))
    sides = {f"{a}{k}": F.when((F.col("axis") == a) & (F.col("__part") != k), (F.greatest if k == 0 else F.least)(F.col(f"{a}{k}"), F.col("at"))).otherwise(F.col(f"{a}{k}")) for a in "xy" for k in (0, 1)}
    return twice.withColumns({**sides, region: F.concat(F.col(region), F.col("__part").cast("string"))}).drop("__part")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted keys."""
    return np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)


def _covering(own: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """disjoint() of the boxes (rows x0, y0, x1, y1) of many groups at once: group and rectangle of each."""
    if not len(own):
        return own, boxes
    key = [own << 33 | boxes[:, c] + (1 << 31) for c in (1, 3)]
    edges = np.unique(np.concatenate(key))
    first, end = (np.searchsorted(edges, k) for k in key)
    n = end - first
    box = np.repeat(np.arange(len(own)), n)
    slab = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    order = np.lexsort((boxes[box, 2], boxes[box, 0], slab))
    box, slab = box[order], slab[order]
    x0, x1 = boxes[box, 0], boxes[box, 2]
    # slabs go up, so the greatest end so far is one of the same slab unless it begins
    reach = np.maximum.accumulate(slab << 33 | x1 + (1 << 31))
    at = np.flatnonzero(np.concatenate([[True], (slab[1:] != slab[:-1]) | (x0[1:] + (1 << 31) > (reach[:-1] & (1 << 33) - 1))]))
    ends = (reach[np.concatenate([at[1:], [len(reach)]]) - 1] & (1 << 33) - 1) - (1 << 31)
    low, high = ((edges[slab[at] + k] & (1 << 33) - 1) - (1 << 31) for k in (0, 1))
    return own[box[at]], np.stack([x0[at], low, ends, high], axis=1)


def _middles(own: np.ndarray, rects: np.ndarray, n: int, axis: int, band: int) -> np.ndarray:
    """The middle of the widest band of each of n regions along an axis (0 for x, 1 for y), as widest_bands() has it; -1 << 40 where none is."""
    out = np.full(n, -1 << 40)
    across = rects[:, 3 - axis] - rects[:, 1 - axis]
    key = np.concatenate([own << 33 | rects[:, axis] + (1 << 31), own << 33 | rects[:, axis + 2] + (1 << 31)])
    order = np.argsort(key, kind="stable")
    key, change = key[order], np.concatenate([across, -across])[order]
    at = _runs(key)
    if not len(at):
        return out
    key, filled = key[at], np.add.reduceat(change, at).cumsum()  # a region's changes come to nothing
    region, place = key >> 33, (key & (1 << 33) - 1) - (1 << 31)
    starts = _runs(region)
    most = np.zeros(n, np.int64)
    most[region[starts]] = np.maximum.reduceat(filled, starts)
    full = np.flatnonzero(filled > np.maximum(1, np.floor(most[region] * 0.02)))
    if len(full) < 2:
        return out
    after, region, place = place[np.minimum(full + 1, len(place) - 1)], region[full], place[full]
    gap = np.flatnonzero((region[1:] == region[:-1]) & (place[1:] - after[:-1] >= band))
    of, start, end = region[1:][gap], after[:-1][gap], place[1:][gap]
    order = np.lexsort((start, start - end, of))
    best = order[_runs(of[order])]
    out[of[best]] = (start[best] + end[best]) // 2
    return out


def _tree(boxes: np.ndarray, own: np.ndarray, n: int, canvas: tuple[int, int, int, int], band: int, side: int, depth: int) -> list[tuple]:
    """The regions of n groups at once, level by level: group, region, its box, and the bounds of what is in it (or four None)."""
    own, rects = _covering(own, boxes)
    group, path, area = np.arange(n), np.zeros(n, np.int64), np.tile(np.array(canvas, np.int64), (n, 1))
    out: list[tuple] = []
    for level in range(depth + 1):
        cuts, axis, at = np.zeros(len(group), bool), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        if level < depth:
            by_x, by_y = (_middles(own, rects, len(group), k, band) for k in (0, 1))
            axis = (by_y > -1 << 40).astype(np.int64)
            at, each = np.where(axis == 1, by_y, by_x), np.arange(len(group))
            wide = area[:, 2:] - area[:, :2]
            cuts = (at > -1 << 40) & (wide >= side).all(axis=1) & (at - area[each, axis] >= side) & (area[each, axis + 2] - at >= side)
        held = np.concatenate([np.maximum(rects[:, :2], area[own, :2]), np.minimum(rects[:, 2:], area[own, 2:])], axis=1)
        shown = (held[:, :2] < held[:, 2:]).all(axis=1) & ~cuts[own]
        low, high = np.full((len(group), 2), 1 << 40), np.full((len(group), 2), -1 << 40)
        np.minimum.at(low, own[shown], held[shown, :2])
        np.maximum.at(high, own[shown], held[shown, 2:])
        done = np.flatnonzero(~cuts)
        inside = np.where((low[done] < high[done]).all(axis=1)[:, None], np.concatenate([low, high], axis=1)[done], None)
        names = [f"{p:0{level}b}" if level else "" for p in path[done].tolist()]
        out += zip(group[done].tolist(), names, *area[done].T.tolist(), *inside.T.tolist(), strict=True)
        if not cuts.any():
            break
        # both parts of each cut region, next to each other
        number, twice = np.cumsum(cuts) - 1, np.repeat(np.flatnonzero(cuts), 2)
        part, rows = np.arange(len(twice)) % 2, np.arange(len(twice))
        area, group, path = area[twice], group[twice], path[twice] * 2 + part
        area[rows, axis[twice] + 2 - 2 * part] = at[twice]
        kept = cuts[own]
        own, rects = own[kept], rects[kept]
        halves = []
        for k in (0, 1):
            cut_, rows = rects.copy(), np.arange(len(rects))
            column = axis[own] + 2 - 2 * k
            cut_[rows, column] = (np.minimum if k == 0 else np.maximum)(cut_[rows, column], at[own])
            full = (cut_[:, :2] < cut_[:, 2:]).all(axis=1)
            halves.append((2 * number[own[full]] + k, cut_[full]))
        own, rects = (np.concatenate([h[i] for h in halves]) for i in (0, 1))
    return out


def region_tree(boxes: DataFrame, canvas: tuple[int, int, int, int], group: str = "image_id", *, band: int = BAND, side: int = SIDE, depth: int = DEPTH, large: int = LARGE) -> DataFrame:
    """cut_regions() of disjoint() boxes on one canvas (x0, y0, x1, y1) for each group that has a box: group, region, its box, and held, the bounds of what is in it.

    Pictures of few boxes, up to large, are cut in one pass, many of them at
    once; the boxes of larger ones stay distributed and are cut level by level.
    """
    ship(boxes.sparkSession)
    real = boxes.where("x0 < x1 AND y0 < y1").where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias(group), *(F.col(c).cast("int").alias(c) for c in geometry.SIDES))
    counted = real.withColumn("__n", F.count("*").over(Window.partitionBy(group)))  # which also brings each group together
    held = [f"h{c}" for c in geometry.SIDES]
    names = [group, "region", *geometry.SIDES, *held, "__left"]

    def run(frames):
        def made(pdf):
            ids = pdf[group].to_numpy()
            starts = _runs(ids)
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            rows = _tree(pdf[list(geometry.SIDES)].to_numpy(np.int64), own, len(starts), canvas, band, side, depth)
            out = pd.DataFrame(rows, columns=["k", *names[1:-1]])
            out.insert(0, group, ids[starts][out.pop("k").to_numpy()])
            return out.astype({h: "Int32" for h in held}).assign(__left=False)

        kept = None
        for frame in frames:
            many = frame["__n"].to_numpy() > large
            if many.any():
                yield frame[many].assign(region=None, **{h: pd.array([None] * int(many.sum()), "Int32") for h in held}, __left=True)[names]
            frame = frame[~many] if kept is None else pd.concat([kept, frame[~many]], ignore_index=True)
            if len(frame):
                last = len(frame) - int((frame[group].to_numpy() == frame[group].iloc[-1]).sum())
                kept = frame.iloc[last:]
                if last:
                    yield made(frame.iloc[:last])
        if kept is not None and len(kept):
            yield made(kept)

    types = f"{group} long, region string, " + ", ".join(f"{c} int" for c in (*geometry.SIDES, *held)) + ", __left boolean"
    found = written(counted.mapInPandas(run, types), "regions")
    bounds = F.when(F.col("hx0").isNotNull(), F.struct(*(F.col(h).alias(c) for h, c in zip(held, geometry.SIDES, strict=True)))).alias("held")
    done = found.where("NOT __left").select(group, "region", *geometry.SIDES, bounds)
    left = found.where("__left").select(group, *geometry.SIDES)
    if not left.head(1):
        return done
    rects = written(disjoint(left, group), "large")
    whole = left.select(group).distinct().select(group, *(F.lit(v).alias(c) for c, v in zip(geometry.SIDES, canvas, strict=True)))
    regions = cut_regions(rects, whole, group, band=band, side=side, depth=depth)
    return done.unionByName(regions.join(_bounds(regions, rects, group).select(group, "region", F.struct(*geometry.SIDES).alias("held")), [group, "region"], "left"))


def _bounds(regions: DataFrame, rects: DataFrame, group: str) -> DataFrame:
    """group, region, and the bounds of what is in it; empty ones have none."""
    pairs = spatial.overlapping(regions, rects.withColumn("seq", F.lit(0)), group)
    return pairs.groupBy(group, F.col("a_region").alias("region")).agg(*((F.min if k == "0" else F.max)((F.greatest if k == "0" else F.least)(F.col(f"a_box.{a}{k}"), F.col(f"b_box.{a}{k}"))).alias(f"{a}{k}") for a, k in ("x0", "y0", "x1", "y1")))


def content_sections(regions: DataFrame, rects: DataFrame | None = None, group: str = "image_id", *, least_area: int = LEAST_AREA, least_side: int = LEAST_SIDE) -> DataFrame:
    """Regions shrunk to the bounds of what is in them, as rects or the regions' own column held have it: group, seq (from 1 in reading order), region, x0, y0, x1, y1; small and empty ones go."""
    large = regions.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area)
    held = large.where("held IS NOT NULL").select(group, "region", "held.*") if rects is None else _bounds(large, rects, group)
    kept = held.where((F.col("x1") - F.col("x0") >= least_side) & (F.col("y1") - F.col("y0") >= least_side))
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy("region")))


def _centred(elements: DataFrame, sections: DataFrame, group: str) -> DataFrame:
    return spatial.centred(elements, sections, group)


def assigned_roles(sections: DataFrame, texts: DataFrame, buttons: DataFrame, width: int, height: int, group: str = "image_id", key: str = "seq", *, cap: str = "cap_height") -> DataFrame:
    """group, key, role of each section, by its place and what lies in it; then the first section around the centre of the group's tallest text, the first text on ties, is the hero, unless its role is one that stays.

    texts have a column cap; null counts as 0. sections may have a column kind;
    only those of kind section can become the hero.
    """
    kinds = sections if "kind" in sections.columns else sections.withColumn("kind", F.lit("section"))
    caps = texts.withColumn("__cap", F.coalesce(F.col(cap), F.lit(0)).cast("double"))
    of = [group, F.col(f"b_{key}").alias(key)]
    inside = _centred(caps, kinds, group)
    counts = inside.groupBy(*of).agg(F.count("*").alias("n_texts"), F.max("a___cap").alias("cap"))
    pressed = _centred(buttons, kinds, group).groupBy(*of).agg(F.count("*").alias("n_buttons"))
    tallest = caps.groupBy(group).agg(F.greatest(F.max("__cap"), F.lit(1.0)).alias("largest"), F.max(F.struct("__cap", (-F.col(key)).alias("minus"))).alias("t")).select(group, "largest", (-F.col("t.minus")).alias("tallest"))
    known = kinds.join(counts, [group, key], "left").join(pressed, [group, key], "left").join(tallest, group, "left").fillna(0, ["n_texts", "cap", "n_buttons"])
    role = spatial.section_role(F.col("kind"), geometry.box(*geometry.SIDES), F.col("n_texts"), F.col("n_buttons"), F.col("cap"), F.coalesce("largest", F.lit(1.0)), width, height)
    roles = known.withColumn("role", role)
    around = inside.select(group, F.col(f"b_{key}").alias(key), F.col(f"a_{key}").alias("tallest"))
    may = roles.join(around, [group, key, "tallest"], "left_semi").where((F.col("kind") == "section") & ~F.col("role").isin(*_KEPT_ROLES))
    hero = may.groupBy(group).agg(F.min(key).alias(key)).withColumn("__hero", F.lit(True))
    return roles.join(hero, [group, key], "left").select(group, key, F.when(F.col("__hero"), "hero").otherwise(F.col("role")).alias("role"))


def summary_lines(sections: DataFrame, elements: DataFrame, theme: Column, width: int, height: int, group: str = "image_id", key: str = "seq") -> DataFrame:
    """The lines that describe a picture, in order: group, line, text.

    sections: group, key, role, box, background (of the whole picture; the same
    for all). elements: group, section (key of theirs, null under the screen
    itself), key, kind, box, text, family, size, labels, icon, fill, border, any
    of them null but the box. Elements come before the next section, in order of
    key; a group is described if it has a section or an element.
    """
    b = F.concat(F.lit("["), F.concat_ws(",", *geometry.SIDES), F.lit("]"))
    parts = F.concat_ws(", ", F.concat(F.lit("bg "), "fill"), F.concat(F.lit("border "), "border"), F.when(F.size("labels") > 0, F.concat(F.lit("label "), F.concat_ws("/", "labels"))))
    said = (
        F.when(F.col("kind") == "text", F.concat(F.lit('text "'), F.coalesce("text", F.lit("")), F.lit('" at '), b, F.lit(" font "), F.coalesce("family", F.lit("?")), F.lit("~"), F.coalesce(F.col("size").cast("string"), F.lit("?")), F.lit("px")))
        .when(F.col("kind") == "button", F.concat(F.lit("button "), b, F.lit(" "), parts))
        .when(F.col("kind") == "icon", F.concat(F.lit("icon "), F.coalesce("icon", F.lit("None")), F.lit(" at "), b))
        .when(F.col("kind") == "image", F.concat(F.lit("graphic "), b))
        .otherwise(F.concat("kind", F.lit(" "), b))
    )
    heads = sections.select(group, F.col(key).alias("section"), F.lit(None).cast("long").alias("at"), F.concat(F.lit("    - section role="), "role", F.lit(" "), b).alias("text"))
    under = F.when(F.col("section").isNull(), " " * 4).otherwise(" " * 6)
    lines = elements.select(group, F.coalesce("section", F.lit(0)).alias("section"), F.col(key).cast("long").alias("at"), F.concat(under, F.lit("- "), said).alias("text"))
    groups = sections.select(group).unionByName(elements.select(group)).distinct()
    screen = F.concat(F.lit("  - section role=screen [0,0,%d,%d]" % (width, height)))
    first = groups.select(group, F.lit(-2).alias("section"), F.lit(None).cast("long").alias("at"), F.concat(F.lit(f"Screen {width}x{height}, "), theme, F.lit(".")).alias("text"))
    second = groups.select(group, F.lit(-1).alias("section"), F.lit(None).cast("long").alias("at"), screen.alias("text"))
    every = reduce(DataFrame.unionByName, [first, second, lines, heads])
    order = Window.partitionBy(group).orderBy("section", F.asc_nulls_first("at"))
    return every.select(group, F.row_number().over(order).alias("line"), "text")


def theme(background: Column) -> Column:
    """dark or light, by the luma of a colour, and the colour itself."""
    return F.concat(F.when(color.luma(background) < 128, "dark").otherwise("light"), F.lit(" theme, background "), background)
