"""Controls, surfaces, glyphs and labels of a screen, as joins of boxes and choices by column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import color, geometry
from evidentia.functions.text import axis_amount, letters_and_digits
from evidentia.operators import greedy, spatial

# Geometry sources whose labelled controls need no border, and the source of surfaces that are controls after all.
COMPACT_SOURCES = ("measured-compact-fill", "measured-closed-outline")
RECLASSIFIED = "measured-control-reclassified-as-surface"
# Shapes that may be an arrow in a bottom corner.
CORNER_ICONS = ("cross", "outline", "arrow_down")


def _box() -> Column:
    return geometry.box(*geometry.SIDES)


def _luma_gap(a: Column, b: Column) -> Column:
    return F.abs(color.luma(a) - color.luma(b))


def has_outline(border: Column, fill: Column, page: str = "#FFFFFF", least: float = 15.0) -> Column:
    """Whether a control has a border that stands out from its fill, or from the page where it has none."""
    return border.isNotNull() & (_luma_gap(border, F.coalesce(fill, F.lit(page))) >= least)


def plausible_controls(controls: DataFrame, group: str = "image_id", page: str = "#FFFFFF") -> DataFrame:
    """Outlined controls (border, fill) in turn of seq, without those that a kept one overlaps by more than 85 % of the smaller box: group, seq, rank."""
    return greedy.suppress(controls.where(has_outline(F.col("border"), F.col("fill"), page)), group, ["seq"], 0.85)


def web_control(border: Column, fill: Column, source: Column, labels: Column) -> Column:
    """Whether a control stays one: a measured compact control with a label, or one with a border that differs from its fill where it has one."""
    compact = F.coalesce(source.isin(*COMPACT_SOURCES), F.lit(False)) & (F.coalesce(F.size(labels), F.lit(0)) > 0)
    return compact | (border.isNotNull() & F.coalesce(_luma_gap(border, fill) >= 15.0, F.lit(True)))


def open_surfaces(surfaces: DataFrame, contents: DataFrame, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Surfaces (source) that were not controls before and of which no single text or raster covers three quarters."""
    own = surfaces.where(~F.col("source").eqNullSafe(F.lit(RECLASSIFIED)))
    return spatial.drop_covered(own, contents, 0.75, group, key)


def glyph_noise(texts: DataFrame, width: int, height: int) -> DataFrame:
    """Texts (value, preferred, status, resolution, verified, confidence, ink) with reason: why one is a drawn glyph and no text, null for a text.

    unverified-square-navigation-rail-glyph goes before
    low-confidence-icon-sized-glyph; a digit is always a text of its own.
    """
    plain = letters_and_digits(F.col("value"))
    w, h = geometry.width(_box()), geometry.height(_box())
    unread = F.coalesce(F.col("preferred"), F.lit("")) == ""
    open_ = unread & F.col("status").eqNullSafe(F.lit("candidate")) & F.col("resolution").eqNullSafe(F.lit("unresolved"))
    regional = F.col("resolution").eqNullSafe(F.lit("regional-new-text-candidate")) & ~unread
    small = (w <= max(24, round(width * 0.025))) & (h <= max(24, round(height * 0.05)))
    short = (F.length(plain) <= 1) & ~plain.rlike(r"^\p{Nd}+$")
    unsure = F.coalesce("confidence", F.lit(0.0)) < 0.75
    low = small & short & ((open_ & unsure) | regional)
    ratio = w / F.greatest(h, F.lit(1))
    square = (h >= max(18, height * 0.03)) & ratio.between(0.68, 1.45)
    rail = open_ & ~F.coalesce("verified", F.lit(False)) & F.length(plain).between(1, 3) & (F.col("x1") <= width * 0.07) & square & (F.coalesce("ink", F.lit(0.0)) >= 0.55)
    reason = F.when(rail, "unverified-square-navigation-rail-glyph").when(low, "low-confidence-icon-sized-glyph")
    return texts.withColumn("reason", reason)


def _shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much of each box of a each box of b covers."""
    a, b = a[..., :, None, :], b[..., None, :, :]
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    return np.clip(w, 0, None) * np.clip(h, 0, None) / np.maximum((a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]), 1)


def glyph_icons(glyphs: DataFrame, icons: DataFrame, group: str = "image_id") -> DataFrame:
    """Glyphs that become icons, in turn of seq: those of which no icon, given or made before, covers 35 %: group, seq, rank."""
    return greedy.suppress(glyphs, group, ["seq"], float(np.nextafter(0.35, 0)), score=_shares, standing=[(icons, lambda a, b: _shares(a, b) >= 0.35)])


def _holding(points: DataFrame, boxes: DataFrame, group: str, key: str) -> DataFrame:
    """group and key of the boxes of points whose centre lies in a closed box of the others."""
    pairs = spatial.centred(points, boxes, group)
    return pairs.select(group, F.col(f"a_{key}").alias(key)).distinct()


def top_navigation(texts: DataFrame, controls: DataFrame, width: int, height: int, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Links of a row of short texts at the top: group, key and the box with room around the text.

    texts: value, font_size. Three or more texts whose centres lie around the
    upper median of all small texts up there, and that span 18 % of the width,
    are a row; a text whose centre a control holds has its control already.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    n = F.length(F.trim(F.coalesce("value", F.lit(""))))
    high = F.col("y1") - F.col("y0")
    small = texts.where(n.between(1, 40) & (mid <= height * 0.12) & (high <= height * 0.065) & (F.coalesce("font_size", F.lit(0.0)) <= min(40.0, height * 0.055)))
    # the texts of one screen's head only
    centres = F.array_sort(F.collect_list(mid))
    median = small.groupBy(group).agg(F.get(centres, F.floor(F.count("*") / 2).cast("int")).alias("median"), F.count("*").alias("n")).where("n >= 3")
    row = small.join(median.select(group, "median"), group).where(F.abs(mid - F.col("median")) <= max(12.0, height * 0.018))
    span = row.groupBy(group).agg(F.count("*").alias("n"), (F.max_by("x1", F.struct("x0", key)) - F.min("x0")).alias("span")).where((F.col("n") >= 3) & (F.col("span") >= width * 0.18))
    found = row.join(span.select(group), group, "left_semi")
    free = found.join(_holding(found.select(group, key, *geometry.SIDES), controls.select(group, key, *geometry.SIDES), group, key), [group, key], "left_anti")
    px, py = F.greatest(F.lit(6), F.bround(high * 0.65)), F.greatest(F.lit(5), F.bround(high * 0.45))
    sides = (F.greatest(F.lit(0), F.col("x0") - px), F.greatest(F.lit(0), F.col("y0") - py), F.least(F.lit(width), F.col("x1") + px), F.least(F.lit(height), F.col("y1") + py))
    return free.select(group, key, *(c.cast("int").alias(k) for c, k in zip(sides, geometry.SIDES, strict=True)))


def corner_navigation(icons: DataFrame, controls: DataFrame, width: int, height: int, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Controls around arrows (name) in a bottom left corner, in turn of key, unless a control, given or made before, holds the arrow's centre: group, key, box."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w, h = geometry.width(_box()), geometry.height(_box())
    there = F.lower("name").isin(*CORNER_ICONS) & (cx <= width * 0.08) & (cy >= height * 0.88) & w.between(2, 18) & h.between(4, 18)
    arrows = icons.where(there)
    free = arrows.join(_holding(arrows.select(group, key, *geometry.SIDES), controls.select(group, key, *geometry.SIDES), group, key), [group, key], "left_anti")
    hw, hh = F.greatest(F.lit(10), F.bround(h * 1.2)), F.greatest(F.lit(18), F.bround(h * 2.4))
    sides = (F.greatest(F.lit(0), F.bround(cx - hw)), F.greatest(F.lit(0), F.bround(cy - hh)), F.least(F.lit(width), F.bround(cx + hw)), F.least(F.lit(height), F.bround(cy + hh)))
    made = F.struct(F.col(key), cx.alias("cx"), cy.alias("cy"), *(c.cast("int").alias(k) for c, k in zip(sides, geometry.SIDES, strict=True)))
    turns = free.groupBy(group).agg(F.array_sort(F.collect_list(made)).alias("turns"))

    def take(kept: Column, one: Column) -> Column:
        held = F.exists(kept, lambda k: one["cx"].between(k["x0"], k["x1"]) & one["cy"].between(k["y0"], k["y1"]))
        return F.when(held, kept).otherwise(F.concat(kept, F.array(one)))

    kept = F.aggregate("turns", F.slice("turns", 1, 0), take)
    return turns.select(group, F.explode(kept).alias("c")).select(group, *(F.col(f"c.{k}").alias(k) for k in (key, *geometry.SIDES)))


def refitted_controls(controls: DataFrame, outlines: DataFrame, group: str = "image_id", key: str = "seq") -> DataFrame:
    """The outline that each control takes: of those that overlap it by more than 85 % of the smaller box, of 0.75 to 3 times its area and 0.7 to 1.8 times its height, the largest, the first on ties: group, key, outline."""
    a, b = F.col("a_box"), F.col("b_box")
    near = (geometry.of_smaller(a, b) > 0.85) & geometry.area(b).between(geometry.area(a) * 0.75, geometry.area(a) * 3.0) & geometry.height(b).between(geometry.height(a) * 0.7, geometry.height(a) * 1.8)
    best = F.max(F.struct(geometry.area(b).alias("area"), (-F.col(f"b_{key}")).alias("first")))
    return spatial.overlapping(controls, outlines, group).where(near).groupBy(group, F.col(f"a_{key}").alias(key)).agg((-best["first"]).alias("outline"))


def added_lines(candidates: DataFrame, kept: DataFrame, surfaces: DataFrame, group: str = "image_id") -> DataFrame:
    """Dashed lines to add to the kept ones, in turn of seq: group, seq, rank.

    A line that runs within 3 pixels of a surface's upper or lower edge along
    65 % of its length is that surface's border; one that runs so near a kept
    line, or one added before, along 75 % is that line again.
    """

    def border(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_line_shares(a, b) >= 0.65) | (_line_shares(a, b[..., [0, 3, 2, 3]]) >= 0.65)

    def again(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _line_shares(a, b) >= 0.75

    return greedy.suppress(candidates, group, ["seq"], float(np.nextafter(0.75, 0)), score=_line_shares, standing=[(surfaces, border), (kept, again)])


def _line_shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much of the length of each line of a runs along each line of b, 3 pixels apart at most."""
    a, b = a[..., :, None, :], b[..., None, :, :]
    shared = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    near = np.abs(a[..., 1] - b[..., 1]) <= 3
    return np.where(near, np.clip(shared, 0, None), 0) / np.maximum(a[..., 2] - a[..., 0], 1)


def zoom_regions(requests: DataFrame, elements: DataFrame, group: str = "image_id", key: str = "seq", pad: int = 24) -> DataFrame:
    """The region around a requested element, pad pixels wider on each side, its corner within the picture; an error for an unknown element."""
    found = elements.select(group, key, _box().alias("b"))
    j = requests.join(found, [group, key], "left")
    region = F.struct(F.greatest(F.lit(0), F.col("b.x0") - pad).alias("x"), F.greatest(F.lit(0), F.col("b.y0") - pad).alias("y"), (geometry.width(F.col("b")) + 2 * pad).alias("width"), (geometry.height(F.col("b")) + 2 * pad).alias("height"))
    missing = F.col("b").isNull()
    return j.select(*requests.columns, F.when(~missing, region).alias("region"), F.when(missing, F.concat(F.lit("no element with id "), F.col(key).cast("string"))).alias("error"))


def font_in_source(font: Column, t: Column) -> Column:
    """Glyph measures (cap_height, font_size, stroke_width, glyph_width) of an enlarged crop in pixels of its source, to tenths."""
    across = F.bround(font["glyph_width"] * t["scale_x"], 1).alias("glyph_width")
    return F.struct(*(F.bround(font[k] * t["scale_y"], 1).alias(k) for k in ("cap_height", "font_size", "stroke_width")), across)


def workflow(n_focus: Column, assets_ready: Column, entry: Column) -> Column:
    """What a reconstruction waits for: state, next_action, next_tool."""

    def step(state: str, action: str, tool: str) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(action).alias("next_action"), F.lit(tool).alias("next_tool"))

    return (
        F.when(F.coalesce(n_focus, F.lit(0)) > 0, step("needs-focus", "execute-returned-focus-plan", "zoom"))
        .when(~F.coalesce(assets_ready, F.lit(True)), step("needs-asset-output", "retry-see-with-storage-enabled", "see"))
        .when(F.coalesce(entry, F.lit("")) != "", step("ready-to-implement", "copy-or-serve-starter-then-review", "review"))
        .otherwise(step("ready-to-implement", "implement-first-candidate-then-review", "review"))
    )


def editorial_line(size: Column, family: Column, family_confidence: Column, value: Column, words: Column) -> Column:
    """Whether a large line mixes upright and slanted words of one serif display face.

    words (array of slant, slant_confidence, family, family_confidence,
    candidate, sans_score, serif_score): two to four, as many as the line has,
    64 pixels high; a surely slanted one must look like the serif face, or
    nearly as much as like the sans one, and no sure reading may say sans.
    """

    def sans(name: Column, sure: Column) -> Column:
        return F.coalesce((F.lower(name) == "inter-tight") & (sure >= 0.72), F.lit(False))

    slanted = F.filter(words, lambda w: F.coalesce(F.lower(w["slant"]).isin("italic", "oblique") & (w["slant_confidence"] >= 0.7), F.lit(False)))
    serif = F.exists(slanted, lambda w: F.coalesce(F.lower(w["candidate"]) == "newsreader", F.lit(False)) | F.coalesce(w["serif_score"] <= w["sans_score"] + 0.04, F.lit(False)))
    n = F.size(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(?U)(\S+)"), F.lit(1)))
    fits = (size >= 64) & F.size(words).between(2, 4) & (n == F.size(words))
    return F.coalesce(fits & serif & ~sans(family, family_confidence) & ~F.exists(words, lambda w: sans(w["family"], w["family_confidence"])), F.lit(False))


def axis_labels(readings: DataFrame, group: str = "image_id", key: str = "seq") -> DataFrame:
    """Amounts of an evenly spaced currency axis from the readings (value) that can be read: group, key, label.

    Four or more small readings that begin like a currency sign, aligned at
    the right within 14 pixels and evenly spaced, two of them readable, give
    an arithmetic sequence; no label where one would be negative or a readable
    amount lies off it by more than 5 % of a step.
    """
    plain = letters_and_digits(F.col("value"))
    w, h = geometry.width(_box()), geometry.height(_box())
    like = (F.length(plain) >= 2) & F.substring(plain, 1, 1).isin("s", "5") & (w <= 64) & (h <= 28)
    one = F.struct(F.col("y0"), F.col(key), F.col("x1"), ((F.col("y0") + F.col("y1")) / 2).alias("mid"), axis_amount(F.col("value")).alias("amount"))
    axes = readings.where(like).groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("r")).where(F.size("r") >= 4)
    axes = axes.where(F.array_max("r.x1") - F.array_min("r.x1") <= 14)
    axes = axes.withColumn("gaps", F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda k: F.get(F.col("r.mid"), k) - F.get(F.col("r.mid"), k - 1)))
    axes = axes.withColumn("gap", _upper_median(F.col("gaps")))
    axes = axes.where((F.col("gap") > 0) & F.forall("gaps", lambda g: F.abs(g - F.col("gap")) <= F.greatest(F.lit(5.0), F.col("gap") * 0.18)))
    axes = axes.withColumn("known", F.filter(F.transform("r", lambda x, k: F.struct(k.cast("long").alias("k"), x["amount"].alias("v"))), lambda x: x["v"].isNotNull()))
    apart = F.flatten(F.transform("known", lambda a: F.transform(F.filter("known", lambda b: (b["k"] > a["k"]) & ((b["v"] - a["v"]) % (b["k"] - a["k"]) == 0)), lambda b: ((b["v"] - a["v"]) / (b["k"] - a["k"])).cast("long"))))
    axes = axes.withColumn("step", _upper_median(apart)).where(F.col("step") != 0)
    axes = axes.withColumn("origin", F.get("known", F.lit(0))["v"] - F.get("known", F.lit(0))["k"] * F.col("step"))
    sound = F.forall("known", lambda x: F.abs(F.col("origin") + x["k"] * F.col("step") - x["v"]) <= F.greatest(F.lit(1.0), F.abs("step") * 0.05))
    axes = axes.where(sound & (F.least(F.col("origin"), F.col("origin") + (F.size("r") - 1) * F.col("step")) >= 0))
    return axes.select(group, "origin", "step", F.posexplode("r").alias("k", "x")).select(group, F.col(f"x.{key}").alias(key), F.concat(F.lit("$"), F.format_number(F.col("origin") + F.col("k") * F.col("step"), 0)).alias("label"))


def _upper_median(values: Column) -> Column:
    """The middle value, the greater of two; null where there is none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def refined_pitch(values: Column, pitch: Column, radius: float = 0.8, steps: int = 321) -> Column:
    """The pitch of 321 about a given one whose grid lies nearest to the values: pitch, phase and the median distance, the least pitch on ties to nine places; null for fewer than three values."""
    low, turn = F.greatest(F.lit(1.0), pitch - radius), 2 * np.pi

    # each stage binds the one before it, which is thus computed once for each pitch
    def angled(k: Column) -> Column:
        p = low + k * ((pitch + radius - low) / (steps - 1))
        waves = (F.aggregate(values, F.lit(0.0), lambda s, v: s + wave(v * turn / p)) / F.size(values) for wave in (F.sin, F.cos))
        return F.struct(p.alias("p"), F.atan2(*waves).alias("angle"))

    def placed(x: Column) -> Column:
        return F.struct(x["p"].alias("p"), (F.when(x["angle"] < 0, x["angle"] + turn).otherwise(x["angle"]) * x["p"] / turn).alias("phase"))

    def measured(x: Column) -> Column:
        off = F.transform(F.transform(values, lambda v: F.pmod(v - x["phase"], x["p"])), lambda o: F.least(o, x["p"] - o))
        return F.struct(x["p"].alias("p"), x["phase"].alias("phase"), F.array_sort(off).alias("off"))

    def judged(x: Column) -> Column:
        n = F.size(values)
        middle = (F.get(x["off"], F.floor((n - 1) / 2).cast("int")) + F.get(x["off"], F.floor(n / 2).cast("int"))) / 2
        return F.struct(F.round(middle, 9).alias("error"), x["p"].alias("pitch"), x["phase"].alias("phase"))

    stages = F.sequence(F.lit(0), F.lit(steps - 1))
    for stage in (angled, placed, measured, judged):
        stages = F.transform(stages, stage)
    return F.when(F.size(values) >= 3, F.array_min(stages))


def scene_lines(elements: DataFrame, group: str = "image_id", key: str = "seq") -> DataFrame:
    """One line for each element (kind, text, norm, family, font_size) in order of key, joined: group, text."""
    b = F.col("norm")
    said = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit(' "'), F.col("text"), F.lit('"'))).otherwise("")
    line = F.concat(F.lit(" ["), F.col(key), F.lit("] "), F.col("kind"), said, F.lit(" @["), b["x0"], F.lit(","), b["y0"], F.lit("-"), b["x1"], F.lit(","), b["y1"], F.lit("] "), F.coalesce("family", F.lit("?")), F.lit("~"), F.coalesce(F.col("font_size").cast("string"), F.lit("?")), F.lit("px"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("t")))), lambda x: x["t"])
    return elements.groupBy(group).agg(F.array_join(lines, "\n").alias("text"))


def element_claims(elements: DataFrame, width: int, height: int, group: str = "image_id", key: str = "seq") -> DataFrame:
    """What is claimed of each element (kind, text, method, confidence) and of the screen: group, claim_id, subject, epistemic, method, confidence."""
    name = F.concat(F.lit("element."), F.col(key))
    subject = F.concat(F.lit("element:"), F.col(key))

    def claim(claim_id: Column, of: Column, epistemic: str, method: Column, confidence: Column) -> Column:
        return F.struct(claim_id.alias("claim_id"), of.alias("subject"), F.lit(epistemic).alias("epistemic"), method.alias("method"), confidence.cast("double").alias("confidence"))

    none = F.lit(None)
    shape = claim(F.concat(name, F.lit(".geometry")), subject, "measured", F.lit("element-tree"), none)
    said = F.when(F.coalesce("text", F.lit("")) != "", claim(F.concat(name, F.lit(".text")), F.concat(subject, F.lit(".text")), "inferred", F.coalesce("method", F.lit("rapidocr")), F.col("confidence")))
    each = elements.select(group, F.explode(F.array_compact(F.array(shape, said))).alias("c")).select(group, "c.*")
    size = claim(F.lit("screen.size"), F.lit("screen"), "measured", F.lit("image-decoder"), none)
    return elements.select(group).distinct().select(group, size.alias("c")).select(group, "c.*").unionByName(each)


def epistemic_counts(claims: DataFrame, group: str = "image_id") -> DataFrame:
    """How many claims of each group are measured, inferred and observed."""
    return claims.groupBy(group).agg(*(F.count_if(F.col("epistemic") == k).alias(k) for k in ("measured", "inferred", "observed")))
