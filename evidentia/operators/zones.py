"""Dominant colours of pictures: k-means over counts of colours, in whole numbers, so that any partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import color
from evidentia.lineage import cut

#: Centres of a picture, rounds, and the side of the cubes that seeds are taken from.
CENTERS, ROUNDS, CUBE = 5, 8, 32


def counted(pixels: DataFrame, group: str, hex: str = "hex") -> DataFrame:
    """group, b, g, r, n: how often each colour occurs; a null colour, and a null group, counts for nothing."""
    r, g, b = color.channels(F.col(hex))
    known = pixels.where(F.col(group).isNotNull() & F.col(hex).rlike("^#[0-9A-Fa-f]{6}$"))
    return known.groupBy(group, b.alias("b"), g.alias("g"), r.alias("r")).agg(F.count("*").alias("n"))


def seeds(colors: DataFrame, group: str, k: int = CENTERS) -> DataFrame:
    """group, centers: the most frequent colour of each of the k fullest cubes, the darker in blue, green, red on ties, in that order."""
    cube = [F.floor(F.col(c) / CUBE).alias(f"c{c}") for c in "bgr"]
    cubes = colors.groupBy(group, *cube).agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("minus"), "b", "g", "r")).alias("top"))
    ranked = cubes.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("all"), "cb", "cg", "cr"))).where(F.col("k") <= k)
    each = F.array_sort(F.collect_list(F.struct("k", F.col("top.b").alias("b"), F.col("top.g").alias("g"), F.col("top.r").alias("r"))))
    return ranked.groupBy(group).agg(F.transform(each, lambda x: F.struct(*(x[c].cast("long").alias(c) for c in "bgr"))).alias("centers"))


def nearest(colors: DataFrame, centers: DataFrame, group: str) -> DataFrame:
    """colors with k, the nearest centre's place (from 0; the first on ties), and centers."""
    far = F.transform("centers", lambda x, i: F.struct(sum(((F.col(c) - x[c]) * (F.col(c) - x[c]) for c in "bgr"), F.lit(0)).alias("d"), i.alias("k")))
    return colors.join(centers, group).withColumn("k", F.array_min(far)["k"])


def color_zones(pixels: DataFrame, group: str, hex: str = "hex", *, k: int = CENTERS, rounds: int = ROUNDS) -> DataFrame:
    """The k dominant colours of each group: group, rank, hex, ratio (of its pixels, four places).

    Each round gives every colour to its nearest centre and moves each centre to
    its colours' mean, rounded half up; a centre without colours stays, and in
    the end isn't told. The larger come first, then the darker in blue, green,
    red. A round shuffles one row for each task and centre.
    """
    colors = cut(counted(pixels, group, hex), "colors")
    centers = cut(seeds(colors, group, k), "centers")
    for _ in range(rounds):
        moved = nearest(colors, centers, group).groupBy(group, "k").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in "bgr"))
        by_place = F.map_from_entries(F.collect_list(F.struct("k", F.struct(*(F.floor((2 * F.col(c) + F.col("n")) / (2 * F.col("n"))).cast("long").alias(c) for c in "bgr")))))
        found = moved.groupBy(group).agg(by_place.alias("m"))
        centers = cut(centers.join(found, group).select(group, F.transform("centers", lambda x, i: F.coalesce(F.try_element_at(F.col("m"), i), x)).alias("centers")), "centers")
    sizes = nearest(colors, centers, group).groupBy(group, "k").agg(F.sum("n").alias("n"), F.first("centers").alias("centers")).withColumn("c", F.get("centers", F.col("k")))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "c.b", "c.g", "c.r", "k")
    name = F.format_string("#%02X%02X%02X", "c.r", "c.g", "c.b")
    return sizes.select(group, F.row_number().over(order).alias("rank"), name.alias("hex"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 4).alias("ratio"))
