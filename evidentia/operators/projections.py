"""Rows cut down to what a caller may see: kept fields, checked assets, summaries, recognised boxes and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many assets of each kind a result may carry.
MOST_ASSETS = {"font": 16, "vector": 12, "raster": 12}


def kept_fields(value: Column, fields: list[str]) -> Column:
    """A JSON object with those of its top-level fields that are in the list, in its order; text that is no object gives none."""
    parsed = F.from_json(F.when(value.rlike(r"^\s*\{"), value), "map<string, string>")
    return F.to_json(F.coalesce(F.map_filter(parsed, lambda k, v: k.isin(*fields) & v.isNotNull()), F.create_map().cast("map<string, string>")))


def sound_assets(assets: Column, kind: str) -> Column:
    """The first assets of a kind that are fit to pass on, or null where none is.

    Fonts (family, path, sha256, media_type): a family of 1 to 128 bytes, a path,
    64 characters of digest and a font media type. Vectors: an SVG media type
    besides path and digest. Rasters: path, digest and media type not empty.
    """

    def filled(c):
        return F.length(F.trim(F.coalesce(c, F.lit("")))) > 0

    tests = {
        "font": lambda a: F.octet_length(F.trim(a["family"])).between(1, 128) & filled(a["path"]) & (F.length(F.trim(a["sha256"])) == 64) & F.contains(a["media_type"], F.lit("font")),
        "vector": lambda a: filled(a["path"]) & filled(a["sha256"]) & (a["media_type"] == "image/svg+xml"),
        "raster": lambda a: filled(a["path"]) & filled(a["sha256"]) & filled(a["media_type"]),
    }
    found = F.filter(F.slice(assets, 1, MOST_ASSETS[kind]), lambda a: F.coalesce(tests[kind](a), F.lit(False)))
    return F.when(F.size(found) > 0, found)


def result_summary(capability: Column, operation: Column, elapsed_ms: Column, fields: dict[str, Column], most: int = 480) -> Column:
    """One sentence on a result: the fields that are not null as name=value, cut to most characters."""
    told = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in fields.items()))), ", ")
    told = F.when(told == "", "").otherwise(F.concat(F.lit(" "), told, F.lit(".")))
    return F.substring(F.concat(capability, F.lit("."), operation, F.lit(" finished in "), elapsed_ms.cast("string"), F.lit(" ms."), told), 1, most)


def image_source(cache_key: Column) -> Column:
    """The id of the image that a cache key was made of: its second part of three, or the whole key without .json."""
    parts = F.split(cache_key, "-", 3)
    return F.concat(F.lit("sha256-128:"), F.when(F.size(parts) > 2, parts[1]).otherwise(F.regexp_replace(cache_key, r"\.json$", "")))


def recognised(points: Column, text: Column, score: Column) -> Column:
    """A reading from a polygon (array of x, y): text, its axis-aligned box in whole pixels, confidence to thousandths; null without text."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    edges = {name: F.bround(edge(of)).cast("int") for name, edge, of in (("x0", F.array_min, xs), ("y0", F.array_min, ys), ("x1", F.array_max, xs), ("y1", F.array_max, ys))}
    made = F.struct(clean.alias("text"), *(edges[k].alias(k) for k in ("x0", "y0", "x1", "y1")), F.round(score, 3).alias("confidence"))
    return F.when(clean != "", made)


def likeliest_labels(similarities: Column, labels: list[str], most: int = 3, least: float = 0.01, scale: float = 100.0) -> Column:
    """The labels of the highest probabilities: softmax over scaled cosine similarities in the order of labels, the first on ties."""

    def weighed(own: Column) -> Column:
        return F.transform(own["values"], lambda s: F.exp(scale * (s - own["top"])))

    def summed(weights: Column) -> Column:
        return F.struct(weights.alias("weights"), F.aggregate(weights, F.lit(0.0), lambda x, w: x + w).alias("total"))

    def ranked(own: Column) -> Column:
        return F.array_sort(F.transform(own["weights"], lambda w, k: F.struct((-w / own["total"]).alias("minus"), k.alias("k"))))

    names = F.array(*map(F.lit, labels))
    topped = _with(similarities, lambda values: F.struct(values.alias("values"), F.array_max(values).alias("top")))
    top = F.slice(_with(_with(_with(topped, weighed), summed), ranked), 1, most)
    return F.transform(F.filter(top, lambda x: -x["minus"] > least), lambda x: F.struct(F.get(names, x["k"]).alias("label"), F.round(-x["minus"], 3).alias("confidence")))


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """What made gives for a value that is computed once, however often made names it, also for each element of an array."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def review_outcome(visual_pass: Column, web_pass: Column, blocking: Column) -> Column:
    """What two verdicts come to together: can_complete, verdict, required_action, and the reasons, the visual one first."""
    both = visual_pass & web_pass
    action = F.when(both, "complete").when(~visual_pass & ~web_pass, "repair-visual-and-web").when(~visual_pass, "repair-visual").otherwise("repair-web-representation")
    reasons = F.concat(F.when(~visual_pass, F.array(F.lit("visual-threshold-failed"))).otherwise(F.array().cast("array<string>")), blocking)
    return F.struct(both.alias("can_complete"), F.when(both, "pass").otherwise("fail").alias("verdict"), action.alias("required_action"), reasons.alias("reasons"))


def repeated_texts(rows: DataFrame, group: str, seq: str, text: Column, *, groups: int = 4, members: int = 12) -> DataFrame:
    """In each group the texts that occur more than once, the most frequent first, then the earliest: text, rank, count and the seqs of the first members."""
    keyed = rows.select(group, seq, text.alias("key")).where(F.col("key") != "")
    counts = keyed.groupBy(group, "key").agg(F.count("*").alias("count"), F.min(seq).alias("first"), F.slice(F.array_sort(F.collect_list(seq)), 1, members).alias("ids")).where("count > 1")
    # distinct texts of one group only, few to a group
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("minus"), "first", "key", "count", "ids"))), 1, groups)
    made = counts.groupBy(group).agg(ranked.alias("top")).select(group, F.posexplode("top").alias("at", "t"))
    return made.select(group, (F.col("at") + 1).alias("rank"), F.col("t.key").alias("text"), "t.count", "t.ids")
