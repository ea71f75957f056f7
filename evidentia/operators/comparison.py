"""Colours and acceptance of a candidate picture against its reference, and what may be taken over from a source page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import color, geometry
from evidentia.functions.text import font_family
from evidentia.operators.greedy import dice, similarity

# What a candidate must reach to pass, and to pass in part.
SIMILARITY, PIXELS, FOREGROUND, TEXT, LAYOUT, HOT, HOT_BOX = 0.88, 0.12, 0.18, 0.70, 0.80, 0.05, 0.08
PART = {"similarity": 0.82, "pixels": 0.15, "text": 0.60, "layout": 0.70, "hot": 0.08, "hot_box": 0.12}
# Media types of fonts and their formats, of backgrounds, and the most bytes of each.
FONT_FORMATS = {"font/woff2": "woff2", "application/font-woff2": "woff2", "font/woff": "woff", "application/font-woff": "woff", "font/ttf": "truetype", "application/x-font-ttf": "truetype", "font/otf": "opentype", "application/x-font-opentype": "opentype"}
BACKGROUNDS = ("image/avif", "image/gif", "image/jpeg", "image/png", "image/webp")
FONT_BYTES, BACKGROUND_BYTES = 4 << 20, 12 << 20
# The members of a text style that a result may carry.
STYLE_FIELDS = ("color", "fontFamily", "fontSize", "fontWeight", "fontStyle", "lineHeight", "letterSpacing", "textTransform", "textAlign")


def lab(c: Column) -> Column:
    """Struct l, a, b of a #RRGGBB colour, each from 0 to 255: lightness scaled by 2.55, the others moved by 128, rounded."""

    def linear(v: Column) -> Column:
        s = v / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)

    r, g, b = (linear(v) for v in color.channels(c))
    x, y, z = (curve(v) for v in ((0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754))
    return F.struct(*(F.round(F.round(v, 6)).alias(k) for v, k in (((116 * y - 16) * 2.55, "l"), (500 * (x - y) + 128, "a"), (200 * (y - z) + 128, "b"))))


def binned_palette(pixels: DataFrame, group: str, hex: str = "hex", step: int = 16, limit: int = 16) -> DataFrame:
    """The most frequent colours of each group by bins of step in each channel, the darker in blue, green, red on ties: group, rank, hex of the bin's middle, weight of those kept."""
    r, g, b = (F.floor(v / step).cast("int") for v in color.channels(F.col(hex)))
    counts = pixels.groupBy(group, b.alias("b"), g.alias("g"), r.alias("r")).agg(F.count("*").alias("n"))
    # at most (256 / step) ** 3 bins to a group
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "b", "g", "r"))), 1, limit)
    rows = counts.groupBy(group).agg(top.alias("top")).withColumn("all", F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s - x["minus"]))
    rows = rows.select(group, "all", F.posexplode("top").alias("at", "c"))
    middle = F.format_string("#%02X%02X%02X", *(F.col(f"c.{k}") * step + step // 2 for k in "rgb"))
    return rows.select(group, (F.col("at") + 1).alias("rank"), middle.alias("hex"), (-F.col("c.minus") / F.col("all")).alias("weight"))


def palette_distance(reference: DataFrame, candidate: DataFrame, group: str) -> DataFrame:
    """Mean of both weighted distances from each colour (rank, hex, weight) to the nearest of the other palette, in Lab: group, distance."""
    a, b = (p.select(group, F.col("rank").alias(f"{k}_rank"), F.col("weight").alias(f"{k}_weight"), lab(F.col("hex")).alias(k)) for p, k in ((reference, "a"), (candidate, "b")))
    apart = F.sqrt(sum(((F.col(f"a.{k}") - F.col(f"b.{k}")) ** 2 for k in "lab"), F.lit(0.0)))
    pairs = a.join(b, group).withColumn("d", apart)
    sides = [pairs.groupBy(group, f"{k}_rank").agg(F.min(F.struct("d", f"{k}_weight")).alias("m")).groupBy(group).agg(F.sum(F.col("m.d") * F.col(f"m.{k}_weight")).alias(f"{k}_sum")) for k in "ab"]
    return sides[0].join(sides[1], group).select(group, ((F.col("a_sum") + F.col("b_sum")) / 2).alias("distance"))


def exact_mode(pixels: DataFrame, group: str, hex: str = "hex") -> DataFrame:
    """The most frequent colour of each group, the least in blue, green, red on ties: group, hex, n."""
    blue_first = F.concat(F.substring(hex, 6, 2), F.substring(hex, 4, 2), F.substring(hex, 2, 2))
    counts = pixels.groupBy(group, F.col(hex).alias("hex"), blue_first.alias("k")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), "k", "hex"))
    return counts.groupBy(group).agg(best.alias("m")).select(group, "m.hex", (-F.col("m.minus")).alias("n"))


def foreground_limit(width: Column, height: Column) -> Column:
    """How much of the foreground may differ, by the tolerance of 1 to 6 pixels that a canvas has."""
    pixels = geometry.clamp(F.bround(F.least(width, height) / 256.0), 1, 6)
    return F.least(F.lit(0.34), F.lit(FOREGROUND) + 0.05 * F.greatest(F.lit(0), pixels - 2))


def material_share(signal: Column, bounding: Column) -> Column:
    """The share of the canvas that a dense mismatch bounds; 0 for a small or sparse one."""
    return F.when((signal < 0.025) | (signal / F.greatest(F.lit(1e-9), bounding) < 0.30), 0.0).otherwise(bounding)


def overall_similarity(pixels: Column, palette: Column, edges: Column, text: Column, layout: Column) -> Column:
    """Weighted similarity to four places from mismatches of pixels and edges and similarities of palette, text and layout."""
    return F.round(geometry.clamp(0.30 * (1.0 - pixels) + 0.15 * palette + 0.20 * (1.0 - edges) + 0.20 * text + 0.15 * layout, 0.0, 1.0), 4)


def acceptance(m: Column) -> Column:
    """Verdict pass, partial or fail, the names of the checks that fail in order, and how many there are.

    m: exact (dimensions), resampled, similarity, pixels, foreground,
    foreground_limit, text, layout, hot, hot_box. A measure that is null fails
    its check.
    """

    def ok(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    checks = (
        ("dimension_mismatch", ok(m["exact"])),
        ("resampled_candidate", ok(~m["resampled"])),
        ("similarity_minimum", ok(m["similarity"] >= SIMILARITY)),
        ("pixel_mismatch_maximum", ok(m["pixels"] <= PIXELS)),
        ("foreground_mismatch_maximum", ok(m["foreground"] <= m["foreground_limit"])),
        ("text_similarity_minimum", ok(m["text"] >= TEXT)),
        ("layout_similarity_minimum", ok(m["layout"] >= LAYOUT)),
        ("largest_hot_region_maximum", ok(m["hot"] <= HOT)),
        ("largest_material_hot_region_bounding_maximum", ok(m["hot_box"] <= HOT_BOX)),
    )
    failed = F.array_compact(F.array(*(F.when(~passed, name) for name, passed in checks)))
    near = m["exact"] & (m["similarity"] >= PART["similarity"]) & (m["pixels"] <= PART["pixels"]) & (m["foreground"] <= F.least(F.lit(0.40), m["foreground_limit"] + 0.06))
    near = near & (m["text"] >= PART["text"]) & (m["layout"] >= PART["layout"]) & (m["hot"] <= PART["hot"]) & (m["hot_box"] <= PART["hot_box"])
    verdict = F.when(F.size(failed) == 0, "pass").when(ok(near), "partial").otherwise("fail")
    return F.struct(verdict.alias("verdict"), failed.alias("blocking"), F.size(failed).alias("n_failed"))


def text_agreement(reference: Column, candidate: Column) -> Column:
    """Struct score, method: the greater of the share of common character pairs and the sequence ratio, the latter on ties; 1 for two empty texts. Null counts as empty."""
    a, b = (F.coalesce(c, F.lit("")) for c in (reference, candidate))
    ratio = similarity(a, b)
    pairs = F.coalesce(dice(a, b), ratio)
    empty = (a == "") & (b == "")
    method = F.when(empty, "empty-text-equality").when(pairs > ratio, "visual-latin-character-bigram-dice").otherwise("visual-latin-sequence-similarity")
    return F.struct(F.when(empty, 1.0).otherwise(F.greatest(pairs, ratio)).alias("score"), method.alias("method"))


def regional_score(base: Column, regional: Column, base_text: Column, regional_text: Column) -> Column:
    """How well a reading of a region fits one of the whole: 0.6 of IoU, 0.2 of the ratio of areas, 0.2 of the sequence ratio of texts (0 where one is empty)."""
    a, b = (F.greatest(F.lit(1), geometry.area(x)) for x in (base, regional))
    said = (F.coalesce(base_text, F.lit("")) != "") & (F.coalesce(regional_text, F.lit("")) != "")
    return 0.6 * geometry.iou(base, regional) + 0.2 * F.least(a, b) / F.greatest(a, b) + 0.2 * F.when(said, similarity(base_text, regional_text)).otherwise(0.0)


def verified_backgrounds(assets: DataFrame, width: int, height: int, group: str) -> DataFrame:
    """Of the first twelve rasters (by seq) of each group the sound one that covers most of the canvas, 55 % at least, the first on ties: group, seq, coverage.

    assets: source, method, visible, media_type, n_texts, x0 to y1, size_bytes
    (null: undeclared), sha256, content. Sound are visible pictures from the
    page itself with text upon them, whose size and digest are as declared.
    """
    sides = {k: F.bround(F.col(k)).cast("long") for k in geometry.SIDES}
    first = assets.where(F.col("seq") <= 12).withColumns(sides)
    inside = geometry.intersection(geometry.box(*geometry.SIDES), geometry.box(F.lit(0), F.lit(0), F.lit(width), F.lit(height)))
    size = F.octet_length("content")
    observed = (F.col("source") == "observed") & (F.col("method") == "playwright-response-body") & F.col("visible") & F.lower("media_type").isin(*BACKGROUNDS) & (F.col("n_texts") >= 1)
    same = size.between(1, BACKGROUND_BYTES) & (F.coalesce(F.col("size_bytes"), size) == size) & (F.sha2("content", 256) == F.lower("sha256"))
    sound = first.withColumn("coverage", inside / F.lit(max(1, width * height))).where(observed & same & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("coverage") >= 0.55))
    best = F.max(F.struct("coverage", (-F.col("seq")).alias("minus")))
    return sound.groupBy(group).agg(best.alias("b")).select(group, (-F.col("b.minus")).alias("seq"), F.round("b.coverage", 5).alias("coverage"))


def verified_fonts(assets: DataFrame, group: str) -> DataFrame:
    """Of the first sixteen fonts (by seq: family, weight, style, media_type, sha256, content) of each group those whose bytes have the digest, each face once, the first: group, seq, family, alias, weight, style, format."""
    formats = F.create_map(*(F.lit(x) for item in FONT_FORMATS.items() for x in item))
    digest = F.lower(F.coalesce("sha256", F.lit("")))
    style = F.lower(F.coalesce("style", F.lit("normal")))
    rows = assets.where(F.col("seq") <= 16).select(
        group, "seq", font_family(F.col("family")).alias("family"), digest.alias("digest"), F.substring(F.coalesce(F.nullif("weight", F.lit("")), F.lit("normal")), 1, 32).alias("weight"),
        F.when(style.isin("normal", "italic", "oblique"), style).otherwise("normal").alias("style"), formats[F.lower(F.split("media_type", ";", 2)[0])].alias("format"), "content",
    )
    size = F.octet_length("content")
    sound = rows.where((F.col("family") != "") & digest_like(F.col("digest")) & F.col("format").isNotNull() & size.between(1, FONT_BYTES) & (F.sha2("content", 256) == F.col("digest")))
    face = [F.lower("family").alias("__family"), F.lower("weight").alias("__weight"), F.col("style"), F.col("digest")]
    best = F.min(F.struct("seq", "family", "weight", "format"))
    kept = sound.groupBy(group, *face).agg(best.alias("b"))
    return kept.select(group, "b.seq", "b.family", F.concat(F.lit("Source "), F.substring("digest", 1, 12)).alias("alias"), "b.weight", "style", "b.format")


def digest_like(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def source_texts(nodes: Column, most: int = 600) -> Column:
    """The first text nodes of a page that are fit to pass on, or null where none is.

    nodes: text, box, visible (null: visible), style (map), words (text, box).
    Kept are trimmed texts of 1 to 500 bytes with a box of four, of their
    style the known members cut to 256 characters, and of their first 128
    words those of 1 to 128 bytes whose four coordinates are within a million.
    """
    trim = r"(?U)^\s+|\s+$"

    def clean(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), trim, "")

    def word_fits(w: Column) -> Column:
        return F.octet_length(clean(w["text"])).between(1, 128) & (F.size(w["box"]) == 4) & F.forall(w["box"], lambda v: F.coalesce(F.abs(v) <= 1e6, F.lit(False)))

    def node(x: Column) -> Column:
        style = F.transform_values(F.map_filter(x["style"], lambda k, v: k.isin(*STYLE_FIELDS) & v.isNotNull()), lambda k, v: F.substring(v, 1, 256))
        words = F.filter(F.slice(x["words"], 1, 128), lambda w: F.coalesce(word_fits(w), F.lit(False)))
        return F.struct(clean(x["text"]).alias("text"), x["box"].alias("box"), style.alias("style"), F.transform(words, lambda w: F.struct(clean(w["text"]).alias("text"), w["box"].alias("box"))).alias("words"))

    fit = F.filter(F.slice(nodes, 1, most), lambda x: F.coalesce(F.octet_length(clean(x["text"])).between(1, 500) & (F.size(x["box"]) == 4) & F.coalesce(x["visible"], F.lit(True)), F.lit(False)))
    return F.when(F.size(fit) > 0, F.transform(fit, node))


def resampled(samples: Column, from_rate: Column, to_rate: Column) -> Column:
    """The sample at or before each step of an array; the array itself at equal rates or without samples."""
    step = from_rate / to_rate
    n = F.floor(F.size(samples) / step).cast("int")
    picked = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(samples, F.least(F.floor(k * step).cast("int"), F.size(samples) - 1)))
    return F.when((from_rate == to_rate) | (F.size(samples) == 0), samples).when(n == 0, F.slice(samples, 1, 0)).otherwise(picked)
