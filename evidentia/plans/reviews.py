"""Queries that review a page against its reference, and words by consensus. Claims are ordered and similarities sequential, so tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import consensus, integrity
from evidentia.plans.bases import HEIGHT, WIDTH, base

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WORDS = ("Total sales", "Sign in", "Overview", "Sign on", "Quarterly plan", "Settings", "Cancel")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _word(n: str):
    return F.element_at(F.array(*(F.lit(w) for w in _WORDS)), (F.expr(f"pmod({n}, {len(_WORDS)})") + 1).cast("int"))


def _page(spark, d):
    """Boxes as what was measured, and the same moved, rewritten and sometimes left out, as what the page shows."""
    measured = base(spark, d, "boxes").withColumns({"value": _word("image_id + seq"), "font_size": (F.col("y1") - F.col("y0")).cast("double")})
    return measured, measured.where("(image_id + seq) % 11 <> 0").withColumns(_moved()).withColumns({"x1": F.col("x0") + F.col("x1") - F.col("x0"), "text": _rewritten(), "selectable": F.col("seq") % 6 != 5, "font_size": F.col("font_size") + F.col("seq") % 3}).where("x0 < x1 AND y0 < y1")


def _moved() -> dict:
    return {c: (F.col(c) + (F.col("image_id") * 7 + F.col("seq") * (3 if c[0] == "x" else 5)) % 9 - 4).cast("int") for c in ("x0", "y0")}


def _rewritten():
    return F.when(F.col("seq") % 4 == 1, _word("image_id + seq + 1")).otherwise(F.lower("value"))


def _reviewed(spark, d):
    measured, shown = _page(spark, d)
    texts = integrity.text_matches(measured.where("kind <> 'A'"), shown.where("kind <> 'A'"), "image_id")
    controls = integrity.control_matches(measured.where("kind = 'A'").withColumnRenamed("value", "label"), shown.where("kind = 'A' AND seq % 5 <> 4").withColumnRenamed("text", "name"), "image_id")
    level = F.when(F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0"), "horizontal").otherwise("vertical")
    lines = integrity.line_matches(measured.where("kind = 'R'").withColumns({"orientation": level, "thickness": F.col("seq")}), shown.where("kind = 'R'").withColumn("orientation", level), "image_id")
    return measured, shown, texts, controls, lines


def _both_sides(spark, d):
    """_page() as one table for page_review(): each box of a reference with, where it is shown, what the page has in its place."""
    art, word = "\n/\\_/\\", F.col("value")
    seq, kind, open_ = F.col("seq"), F.col("kind"), F.col("status") == "O"

    def bits(**roles):
        return sum((F.when(F.coalesce(on, F.lit(False)), getattr(integrity, name)).otherwise(0) for name, on in roles.items()), F.lit(0))

    told = bits(TEXT=kind != "A", CONTROL=kind == "A", ART=open_ & (kind == "N"), ALLOWED_REGION=kind == "A", DIVIDER=kind == "N", READ=kind == "R")
    region = F.when(seq % 4 == 0, "alpha-masked-background-artwork").otherwise("photo")
    nothing = {"selectable": F.lit(None).cast("boolean"), "white_space": F.lit(None).cast("string"), "src": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "trusted": F.lit(None).cast("boolean")}
    reference = {"shown": F.lit(False), "roles": told, "x0": F.col("x0"), "y0": F.col("y0"), "x1": F.col("x1"), "y1": F.col("y1"), "value": word, "drawing": F.concat(word, F.lit(art)), "kind": region, **nothing}
    page = {
        "shown": F.lit(True), "roles": bits(TEXT=kind != "A", CONTROL=(kind == "A") & (seq % 5 != 4), ART=open_, RASTER=kind == "A"), **_moved(), "x1": F.col("x1"), "y1": F.col("y1"), "value": _rewritten(),
        "drawing": F.concat(word, F.when(seq % 2 == 0, F.lit("\r\n/\\_/\\ \n")).otherwise("")), "kind": F.when(seq % 2 == 0, "img").otherwise("background-image"),
        "selectable": seq % 6 != 5, "white_space": F.when(seq % 3 == 0, "PRE"), "src": F.when(seq % 3 == 0, "url(x.png)"), "role": F.when(seq % 4 == 0, "alpha-masked-background-artwork"), "trusted": seq % 8 == 0,
    }
    sides = [F.struct(*(page_or[k].alias(k) for k in reference)) for page_or in (reference, page)]
    sides[1] = F.when(F.expr("(image_id + seq) % 11 <> 0"), sides[1])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = base(spark, d, "boxes").drop("confidence").repartition(n, "image_id")  # before each box becomes two, which then are by page already
    measured = narrow.withColumn("value", _word("image_id + seq"))
    both = measured.select("image_id", "seq", F.explode(F.array_compact(F.array(*sides))).alias("b")).select("image_id", "seq", "b.*")
    return both.where("NOT shown OR x0 < x1 AND y0 < y1")


@query
def page_verdicts(spark, d):
    return integrity.page_review(_both_sides(spark, d), "image_id", WIDTH, HEIGHT)


def _repaired_sides(spark, d):
    """_page() as one table for page_hints(): each box of a reference with, where it is shown, what the page has in its place."""
    seq, kind = F.col("seq"), F.col("kind")
    size = (F.col("y1") - F.col("y0")).cast("double")
    moved = _moved()

    def side(shown: bool, x0, y0, control, value, font_size, thickness):
        divides = F.coalesce(kind == "R", F.lit(False))
        roles = sum((F.when(F.coalesce(on, F.lit(False)), bit).otherwise(0) for on, bit in ((kind != "A", integrity.TEXT), (control, integrity.CONTROL), (divides, integrity.DIVIDER))), F.lit(0))
        level = F.when(divides, F.coalesce(F.col("x1") - x0 >= F.col("y1") - y0, F.lit(False)))
        return F.struct(F.lit(shown).alias("shown"), roles.alias("roles"), x0.alias("x0"), y0.alias("y0"), F.col("x1").alias("x1"), F.col("y1").alias("y1"), value.alias("value"), font_size.alias("font_size"), level.alias("level"), thickness.alias("thickness"))

    reference = side(False, F.col("x0"), F.col("y0"), kind == "A", F.col("value"), size, seq.cast("double"))
    page = side(True, moved["x0"], moved["y0"], (kind == "A") & (seq % 5 != 4), _rewritten(), size + seq % 3, F.lit(1.0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = base(spark, d, "boxes").drop("confidence", "status").repartition(n, "image_id")  # before each box becomes two, which then are by page already
    both = narrow.withColumn("value", _word("image_id + seq")).select("image_id", "seq", F.explode(F.array_compact(F.array(reference, F.when(F.expr("(image_id + seq) % 11 <> 0"), page)))).alias("b"))
    return both.select("image_id", "seq", "b.*").where("NOT shown OR x0 < x1 AND y0 < y1")


@query
def page_repairs(spark, d):
    return integrity.page_hints(_repaired_sides(spark, d), "image_id")


@query
def repeated_words(spark, d):
    """In each conversation, messages of even turns as what was read well, and the words of the others, misread, one by one."""
    texts = base(spark, d, "texts").where("text IS NOT NULL")
    well = texts.where("turn % 2 = 0").select("conv_id", (F.col("turn") * 100_000).alias("seq"), F.lit(None).cast("string").alias("value"), F.col("text").alias("preferred"), F.lit("confirmed").alias("status"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{5,}"), F.lit(0)))
    badly = texts.where("turn % 2 = 1").select("conv_id", "turn", F.posexplode(words).alias("k", "word"))
    badly = badly.select("conv_id", (F.col("turn") * 100_000 + F.col("k")).alias("seq"), F.translate("word", "eo", "c0").alias("value"), F.lit(None).cast("string").alias("preferred"), F.lit("unresolved").alias("status"))
    return consensus.repeated_words(well.unionByName(badly), "conv_id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
