"""Queries that deal readings out to measured texts, over sentences of conversations; their choices are ordered, so tests hold them against exhaustive search."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import assignment
from evidentia.plans.bases import base

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Words of a measured piece, and what a worse reader takes letters for.
_PIECE, _MISREAD = 3, ("oeil", "0c1l")


def query(f):
    QUERIES[f.__name__] = f
    return f


def crops(spark, d):
    """Each sentence of each message as a crop (crop, phrase), and its words in threes, every other piece misread, as the texts measured in it (crop, seq, value, box)."""
    texts = base(spark, d, "texts").where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    lines = texts.select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]+")).alias("line", "phrase"))
    lines = lines.select((F.col("conv_id") * 10_000_000_000 + F.col("turn") * 100_000 + F.col("line")).alias("crop"), "phrase").where("trim(phrase) <> ''")
    words = F.split(F.trim("phrase"), " +")
    piece = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / _PIECE).cast("int")), lambda k: F.array_join(F.slice(words, k * _PIECE + 1, _PIECE), " ")))
    pieces = lines.select("crop", piece.alias("seq", "value"))
    k, value = F.col("seq"), F.when(F.col("seq") % 2 == 0, F.translate("value", *_MISREAD)).otherwise(F.col("value"))
    left = F.when(k % 7 == 6, 300).otherwise(16 + k % 3)
    box = {"x0": left, "y0": 30 * k, "x1": left + 9 * F.length("value"), "y1": 30 * k + 20}
    return lines, pieces.withColumn("value", value).withColumns({c: v.cast("int") for c, v in box.items()})


@query
def span_assignments(spark, d):
    lines, pieces = crops(spark, d)
    return assignment.span_assignments(lines, pieces.select("crop", "seq", "value"), "crop")


@query
def row_assignments(spark, d):
    lines, pieces = crops(spark, d)
    return assignment.row_assignments(lines.withColumn("top", F.lit(0)), pieces, "crop")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
