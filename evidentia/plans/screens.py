"""Queries on controls, labels, colours, acceptance, sessions and queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import geometry
from evidentia.operators import comparison, screens, sessions, spatial
from evidentia.plans.bases import HEIGHT, WIDTH, base, in_turn, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, bases: str = ""):
    """Register a function of (spark, sf_dir) under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_sql(bases, sql) if bases else sql
        return f

    return add


def _boxes(spark, d, **columns):
    """Boxes with more columns in SQL that both engines read alike."""
    return base(spark, d, "boxes").withColumns({k: F.expr(v) for k, v in columns.items()})


def _boxes_sql(where: str = "true", **columns) -> str:
    return "SELECT *" + "".join(f", {v} AS {k}" for k, v in columns.items()) + f" FROM b_boxes WHERE {where}"


def _hex(n: str) -> str:
    return f"concat('#', lpad(hex(CAST({n} AS BIGINT)), 6, '0'))"


def _luma(n: str) -> str:
    """SQL of the luma of a colour number."""
    return f"(CAST(0.299 AS DOUBLE) * ({n} // 65536) + CAST(0.587 AS DOUBLE) * ({n} // 256 % 256) + CAST(0.114 AS DOUBLE) * ({n} % 256))"


def _met(a: str, b: str) -> str:
    return f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"


def _area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


_KEPT = "{'seq': c.seq, 'x0': c.x0, 'y0': c.y0, 'x1': c.x1, 'y1': c.y1}"
_NONE = "CAST([] AS STRUCT(seq INT, x0 INT, y0 INT, x1 INT, y1 INT)[])"
_RANKED = "SELECT image_id, seq, CAST(len(s) AS INT) AS rank FROM r WHERE len(s) > 0 AND s[-1].seq = seq"


def _kept_unless(test: str) -> str:
    """The step that keeps a candidate c unless the test holds for a kept x."""
    return f"CASE WHEN len(list_filter(t.s, lambda x: {test})) = 0 THEN list_append(t.s, {_KEPT}) ELSE t.s END"


_BORDER, _FILL = "(image_id * 7919 + seq * 104729) % 16777216", "(image_id * 6007 + seq * 90001) % 16777216"
_OUTLINED = f"seq % 7 <> 0 AND abs({_luma(_BORDER)} - CASE WHEN seq % 3 = 0 THEN 255 ELSE {_luma(_FILL)} END) >= 15"


def _controls(spark, d):
    return _boxes(spark, d, border=f"CASE WHEN seq % 7 <> 0 THEN {_hex(_BORDER)} END", fill=f"CASE WHEN seq % 3 <> 0 THEN {_hex(_FILL)} END")


@query(in_turn("boxes", _boxes_sql(_OUTLINED), "seq", _NONE, _kept_unless(f"CAST({_met('x', 'c')} AS DOUBLE) / least({_area('x')}, {_area('c')}) > 0.85"), _RANKED))
def plausible_controls(spark, d):
    return screens.plausible_controls(_controls(spark, d))


@query(f"SELECT image_id, seq FROM b_boxes WHERE (seq % 4 = 1 AND kind <> 'N') OR (seq % 7 <> 0 AND (seq % 3 = 0 OR abs({_luma(_BORDER)} - {_luma(_FILL)}) >= 15))", "boxes")
def web_controls(spark, d):
    b = _controls(spark, d).withColumns({"source": F.expr("CASE WHEN seq % 4 = 1 THEN 'measured-compact-fill' WHEN seq % 4 = 2 THEN 'other' END"), "labels": F.expr("CASE WHEN kind <> 'N' THEN array(seq) ELSE array() END")})
    return b.where(screens.web_control(F.col("border"), F.col("fill"), F.col("source"), F.col("labels"))).select("image_id", "seq")


@query(f"SELECT image_id, seq FROM b_boxes a WHERE kind = 'R' AND seq % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM b_boxes b WHERE b.image_id = a.image_id AND b.kind <> 'R' AND CAST({_met('a', 'b')} AS DOUBLE) / {_area('a')} >= 0.75)", "boxes")
def open_surfaces(spark, d):
    b = _boxes(spark, d, source=f"CASE WHEN seq % 5 = 0 THEN '{screens.RECLASSIFIED}' WHEN seq % 5 = 1 THEN 'measured' END")
    return screens.open_surfaces(b.where("kind = 'R'"), b.where("kind <> 'R'")).select("image_id", "seq")


_GLYPHS = ("x", "7", "жк", "abc", "*", "", "Ab c", "é")
_GLYPH = {
    "value": "CASE (image_id + seq) % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_GLYPHS)) + " END",
    "preferred": "CASE WHEN (image_id * 3 + seq) % 4 = 0 THEN 'p' WHEN (image_id * 3 + seq) % 4 = 1 THEN '' END",
    "resolution": "CASE WHEN image_id % 3 = 0 THEN 'regional-new-text-candidate' ELSE 'unresolved' END",
    "verified": "image_id % 5 = 0",
    "ink": "seq * 0.2",
}
_OPEN = "(preferred IS NULL OR preferred = '') AND status = 'O' AND resolution = 'unresolved'"


@query(
    "SELECT image_id, seq, CASE WHEN "
    f"{_OPEN} AND NOT verified AND length(p) BETWEEN 1 AND 3 AND x1 <= 112 AND y1 - y0 >= 24 AND CAST(x1 - x0 AS DOUBLE) / (y1 - y0) BETWEEN 0.68 AND 1.45 AND ink >= 0.55 THEN 'unverified-square-navigation-rail-glyph' "
    f"WHEN x1 - x0 <= 40 AND y1 - y0 <= 40 AND length(p) <= 1 AND NOT regexp_matches(p, '^[0-9]+$') AND (({_OPEN} AND confidence < 0.75) OR (resolution = 'regional-new-text-candidate' AND preferred = 'p')) THEN 'low-confidence-icon-sized-glyph' END AS reason "
    f"FROM (SELECT *, regexp_replace(lower(value), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS p FROM ({_boxes_sql(**_GLYPH)}))",
    "boxes",
)
def glyph_noise(spark, d):
    b = _boxes(spark, d, **_GLYPH).withColumn("status", F.when(F.col("status") == "O", "candidate").otherwise("verified"))
    return screens.glyph_noise(b, 1600, 800).select("image_id", "seq", "reason")


@query(
    in_turn(
        "boxes", f"SELECT * FROM b_boxes a WHERE kind <> 'R' AND NOT EXISTS (SELECT 1 FROM b_boxes b WHERE b.image_id = a.image_id AND b.kind = 'R' AND CAST({_met('a', 'b')} AS DOUBLE) / {_area('a')} >= 0.35)",
        "seq", _NONE, _kept_unless(f"CAST({_met('x', 'c')} AS DOUBLE) / {_area('c')} >= CAST(0.35 AS DOUBLE)"), _RANKED,
    )
)
def glyph_icons(spark, d):
    b = _boxes(spark, d)
    return screens.glyph_icons(b.where("kind <> 'R'"), b.where("kind = 'R'"))


_SAID = {"value": "CASE WHEN seq % 6 = 5 THEN ' ' ELSE concat(kind, seq) END", "font_size": "CASE WHEN seq % 4 = 3 THEN 60.0 ELSE 12.0 END"}


@query(
    f", e AS (SELECT *, (y0 + y1) / 2.0 AS mid FROM ({_boxes_sql(**_SAID)}) WHERE kind <> 'R' AND trim(value) <> '' AND font_size <= 40 AND (y0 + y1) / 2.0 <= 168 AND y1 - y0 <= 91),"
    " m AS (SELECT image_id, list_sort(list(mid))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM e GROUP BY 1 HAVING count(*) >= 3),"
    " w AS (SELECT e.* FROM e JOIN m USING (image_id) WHERE abs(mid - median) <= CAST(25.2 AS DOUBLE)),"
    " n AS (SELECT image_id FROM w GROUP BY 1 HAVING count(*) >= 3 AND arg_max(x1, (x0, seq)) - min(x0) >= 57.6),"
    " z AS (SELECT w.*, greatest(6, round_even(CAST(0.65 AS DOUBLE) * (y1 - y0), 0)) AS px, greatest(5, round_even(CAST(0.45 AS DOUBLE) * (y1 - y0), 0)) AS py FROM w JOIN n USING (image_id))"
    " SELECT image_id, seq, CAST(greatest(0, x0 - px) AS INT) AS x0, CAST(greatest(0, y0 - py) AS INT) AS y0, CAST(least(320, x1 + px) AS INT) AS x1, CAST(least(1400, y1 + py) AS INT) AS y1 FROM z a"
    " WHERE NOT EXISTS (SELECT 1 FROM b_boxes b WHERE b.image_id = a.image_id AND b.kind = 'R' AND b.seq % 2 = 0 AND (a.x0 + a.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2.0 BETWEEN b.y0 AND b.y1)",
    "boxes",
)
def top_navigation(spark, d):
    b = _boxes(spark, d, **_SAID)
    return screens.top_navigation(b.where("kind <> 'R'"), b.where("kind = 'R' and seq % 2 = 0"), WIDTH, 1400)


_ARROW = "CASE seq % 4 WHEN 0 THEN 'Cross' WHEN 1 THEN 'outline' WHEN 2 THEN 'arrow_down' END"
_SMALL = "SELECT image_id, seq, kind, x0, y0, x0 + 2 + (x1 - x0) % 19 AS x1, y0 + 4 + (y1 - y0) % 17 AS y1 FROM b_boxes"


@query(
    in_turn(
        "boxes", f"SELECT *, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy, greatest(10, round_even(CAST(1.2 AS DOUBLE) * (y1 - y0), 0)) AS hw, greatest(18, round_even(CAST(2.4 AS DOUBLE) * (y1 - y0), 0)) AS hh FROM ({_SMALL}) a WHERE kind <> 'R' AND {_ARROW} IS NOT NULL AND (x0 + x1) / 2.0 <= 160 AND (y0 + y1) / 2.0 >= 52.8 AND x1 - x0 BETWEEN 2 AND 18 AND y1 - y0 BETWEEN 4 AND 18 AND NOT EXISTS (SELECT 1 FROM b_boxes b WHERE b.image_id = a.image_id AND b.kind = 'R' AND (a.x0 + a.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2.0 BETWEEN b.y0 AND b.y1)",
        "seq", _NONE,
        "CASE WHEN len(list_filter(t.s, lambda x: c.cx BETWEEN x.x0 AND x.x1 AND c.cy BETWEEN x.y0 AND x.y1)) = 0 THEN list_append(t.s, {'seq': c.seq, 'x0': CAST(greatest(0, round_even(c.cx - c.hw, 0)) AS INT), 'y0': CAST(greatest(0, round_even(c.cy - c.hh, 0)) AS INT), 'x1': CAST(least(2000, round_even(c.cx + c.hw, 0)) AS INT), 'y1': CAST(least(60, round_even(c.cy + c.hh, 0)) AS INT)}) ELSE t.s END",
        "SELECT image_id, seq, s[-1].x0 AS x0, s[-1].y0 AS y0, s[-1].x1 AS x1, s[-1].y1 AS y1 FROM r WHERE len(s) > 0 AND s[-1].seq = seq",
    )
)
def corner_navigation(spark, d):
    b = _boxes(spark, d)
    small = b.withColumn("x1", F.expr("x0 + 2 + (x1 - x0) % 19")).withColumn("y1", F.expr("y0 + 4 + (y1 - y0) % 17")).withColumn("name", F.expr(_ARROW))
    return screens.corner_navigation(small.where("kind <> 'R'"), b.where("kind = 'R'"), 2000, 60)


@query(
    f"SELECT a.image_id, a.seq, arg_max(b.seq, ({_area('b')}, -b.seq)) AS outline FROM b_boxes a JOIN b_boxes b ON a.image_id = b.image_id AND a.kind = 'R' AND b.kind <> 'R' WHERE CAST({_met('a', 'b')} AS DOUBLE) / least({_area('a')}, {_area('b')}) > 0.85 AND {_area('b')} BETWEEN CAST(0.75 AS DOUBLE) * {_area('a')} AND 3.0 * {_area('a')} AND b.y1 - b.y0 BETWEEN CAST(0.7 AS DOUBLE) * (a.y1 - a.y0) AND CAST(1.8 AS DOUBLE) * (a.y1 - a.y0) GROUP BY 1, 2",
    "boxes",
)
def refitted_controls(spark, d):
    b = _boxes(spark, d)
    return screens.refitted_controls(b.where("kind = 'R'"), b.where("kind <> 'R'"))


_ALONG = "CAST(greatest(least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0), 0) AS DOUBLE) / ({0}.x1 - {0}.x0)"


@query(
    in_turn(
        "boxes",
        f"SELECT * FROM b_boxes a WHERE kind <> 'R' AND NOT EXISTS (SELECT 1 FROM b_boxes b WHERE b.image_id = a.image_id AND b.kind = 'R' AND ((b.seq % 2 = 1 AND least(abs(a.y0 - b.y0), abs(a.y0 - b.y1)) <= 3 AND {_ALONG.format('a', 'b')} >= 0.65) OR (b.seq % 2 = 0 AND abs(a.y0 - b.y0) <= 3 AND {_ALONG.format('a', 'b')} >= 0.75)))",
        "seq", _NONE, _kept_unless(f"abs(x.y0 - c.y0) <= 3 AND {_ALONG.format('c', 'x')} >= 0.75"), _RANKED,
    )
)
def added_lines(spark, d):
    b = _boxes(spark, d)
    return screens.added_lines(b.where("kind <> 'R'"), b.where("kind = 'R' and seq % 2 = 0"), b.where("kind = 'R' and seq % 2 = 1"))


@query(
    "SELECT q.image_id, q.seq, CASE WHEN b.x0 < 24 THEN 0 ELSE b.x0 - 24 END AS x, CASE WHEN b.y0 < 24 THEN 0 ELSE b.y0 - 24 END AS y, b.x1 - b.x0 + 48 AS width, b.y1 - b.y0 + 48 AS height, CASE WHEN b.seq IS NULL THEN 'no element with id ' || q.seq END AS error FROM (SELECT o_orderkey AS image_id, CAST(1 + o_orderkey % 9 AS INT) AS seq FROM orders) q LEFT JOIN b_boxes b USING (image_id, seq)",
    "boxes",
)
def zoom_regions(spark, d):
    asked = base(spark, d, "orders").selectExpr("o_orderkey as image_id", "cast(1 + o_orderkey % 9 as int) as seq")
    return screens.zoom_regions(asked, _boxes(spark, d)).select("image_id", "seq", *(F.col(f"region.{k}").alias(k) for k in ("x", "y", "width", "height")), "error")


@query("SELECT p_partkey, round_even(p_size * CAST(0.3717 AS DOUBLE), 1) AS cap_height, round_even((p_size + 3) * CAST(0.3717 AS DOUBLE), 1) AS font_size, round_even(CAST(NULL AS DOUBLE), 1) AS stroke_width, round_even((p_size + 1) * CAST(0.5311 AS DOUBLE), 1) AS glyph_width FROM part")
def fonts_in_source(spark, d):
    font = F.struct(F.col("p_size").alias("cap_height"), (F.col("p_size") + 3).alias("font_size"), F.lit(None).cast("double").alias("stroke_width"), (F.col("p_size") + 1).alias("glyph_width"))
    f = screens.font_in_source(font, F.struct(F.lit(0.5311).alias("scale_x"), F.lit(0.3717).alias("scale_y")))
    return base(spark, d, "names").select("p_partkey", f.alias("f")).select("p_partkey", "f.*")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'needs-focus' WHEN o_orderkey % 5 = 0 THEN 'needs-asset-output' ELSE 'ready-to-implement' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'execute-returned-focus-plan' WHEN o_orderkey % 5 = 0 THEN 'retry-see-with-storage-enabled' WHEN o_orderkey % 2 = 0 THEN 'copy-or-serve-starter-then-review' ELSE 'implement-first-candidate-then-review' END AS next_action, CASE WHEN o_orderkey % 3 = 0 THEN 'zoom' WHEN o_orderkey % 5 = 0 THEN 'see' ELSE 'review' END AS next_tool FROM orders"
)
def workflow_states(spark, d):
    k = F.col("o_orderkey")
    w = screens.workflow(F.when(k % 3 == 0, 2).when(k % 7 == 0, 0), F.when(k % 5 == 0, False).when(k % 2 == 0, True), F.when(k % 2 == 0, "/a").otherwise(""))
    return base(spark, d, "orders").select("o_orderkey", w.alias("w")).select("o_orderkey", "w.*")


@query(
    "SELECT o_orderkey, 50 + k % 30 >= 64 AND k % 13 <> 0 AND NOT coalesce(k % 11 = 0 AND k % 4 <> 1, false) AND NOT coalesce(k % 7 = 0 AND (k % 5) * 0.25 >= 0.72, false) AND (k % 3 = 0 AND k % 10 >= 7 AND (k % 4 = 0 OR k % 9 <= 4)) AS editorial FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)"
)
def editorial_lines(spark, d):
    k = F.col("o_orderkey")

    def word(**of):
        names = {"slant": "string", "slant_confidence": "double", "family": "string", "family_confidence": "double", "candidate": "string", "sans_score": "double", "serif_score": "double"}
        return F.struct(*(of.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()))

    first = word(slant=F.when(k % 3 == 0, "Italic").otherwise("upright"), slant_confidence=(k % 10) * 0.1, family=F.when(k % 7 == 0, "Inter-Tight"), family_confidence=(k % 5) * 0.25, candidate=F.when(k % 4 == 0, "Newsreader"), sans_score=F.lit(0.5), serif_score=F.lit(0.4975) + (k % 9) * 0.01)
    second = word(slant=F.lit("Oblique"), slant_confidence=F.when(k % 2 == 0, 0.9).otherwise(0.5))
    line = screens.editorial_line(50 + k % 30, F.when(k % 11 == 0, "INTER-TIGHT"), F.when(k % 4 == 1, 0.7).otherwise(0.8), F.when(k % 13 == 0, "one").otherwise("two words"), F.array(first, second))
    return base(spark, d, "orders").select("o_orderkey", line.alias("editorial"))


_AXIS = "(o_orderkey % 4) * 400 + i * ((o_orderkey % 3) + 1) * CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE -100 END"
_AXIS_ROWS = f"SELECT o_orderkey AS g, CAST(i AS INT) AS seq, CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'Sab' WHEN i % 2 = 0 THEN replace(concat('S', CAST({_AXIS} AS STRING)), '0', 'o') ELSE concat('5', CAST({_AXIS} AS STRING)) END AS value, CAST(10 AS INT) AS x0, CAST(i * 30 + (o_orderkey * i) % 7 AS INT) AS y0, CAST(50 + ((o_orderkey + i) % 6) * 3 AS INT) AS x1, CAST(i * 30 + (o_orderkey * i) % 7 + 14 AS INT) AS y1"


@query(
    "WITH p AS (SELECT *, (y0 + y1) / 2.0 AS mid, row_number() OVER (PARTITION BY g ORDER BY y0, seq) - 1 AS k, count(*) OVER (PARTITION BY g) AS n, max(x1) OVER (PARTITION BY g) - min(x1) OVER (PARTITION BY g) AS spread, regexp_replace(lower(value), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM ("
    + _AXIS_ROWS.replace("STRING", "VARCHAR")
    + " FROM orders, LATERAL (SELECT unnest(generate_series(0, 3 + o_orderkey % 3)) AS i))),"
    " q AS (SELECT *, mid - lag(mid) OVER (PARTITION BY g ORDER BY k) AS gap, CASE WHEN regexp_full_match(translate(substr(t, 2), 'os', '08'), '[0-9]+') AND (regexp_matches(substr(t, 2), '[0-9s]') OR length(t) = 2) THEN CAST(translate(substr(t, 2), 'os', '08') AS BIGINT) END AS amount FROM p WHERE n >= 4 AND spread <= 14),"
    " m AS (SELECT g, list_sort(list(gap) FILTER (gap IS NOT NULL))[CAST(floor(count(gap) / 2) AS INT) + 1] AS median FROM q GROUP BY 1),"
    " e AS (SELECT g FROM q JOIN m USING (g) GROUP BY 1 HAVING min(median) > 0 AND max(coalesce(abs(gap - median) - greatest(5.0, CAST(0.18 AS DOUBLE) * median), 0)) <= 0),"
    " s AS (SELECT a.g, list_sort(list((b.amount - a.amount) // (b.k - a.k)) FILTER ((b.amount - a.amount) % (b.k - a.k) = 0)) AS steps FROM q a JOIN q b ON a.g = b.g AND a.k < b.k AND a.amount IS NOT NULL AND b.amount IS NOT NULL GROUP BY 1),"
    " o AS (SELECT g, steps[CAST(floor(len(steps) / 2) AS INT) + 1] AS step, f.amount - f.k * steps[CAST(floor(len(steps) / 2) AS INT) + 1] AS origin FROM s JOIN (SELECT g, min(k) AS k, arg_min(amount, k) AS amount FROM q WHERE amount IS NOT NULL GROUP BY 1) f USING (g) WHERE len(steps) > 0),"
    " v AS (SELECT q.*, origin + k * step AS v, step FROM q JOIN o USING (g) JOIN e USING (g) WHERE step <> 0),"
    " h AS (SELECT g FROM v GROUP BY 1 HAVING min(v) >= 0 AND max(coalesce(abs(v - amount) - greatest(1, abs(step) * 0.05), 0)) <= 0)"
    " SELECT g AS image_id, seq, format('${:,}', v) AS label FROM v JOIN h USING (g)"
)
def axis_labels(spark, d):
    rows = base(spark, d, "orders").withColumn("i", F.expr("explode(sequence(0L, 3 + o_orderkey % 3))"))
    return screens.axis_labels(rows.selectExpr(*_columns(_AXIS_ROWS)).withColumnRenamed("g", "image_id"))


def _columns(sql: str) -> list[str]:
    """The expressions of a SELECT, split at its outer commas."""
    out, depth, start = [], 0, len("SELECT ")
    for at, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[start:at])
            start = at + 1
    return [*out, sql[start:]]


@query(
    "WITH v AS MATERIALIZED (SELECT image_id, list(v) AS v FROM (SELECT p_size AS image_id, CAST(p_partkey * 37 % 409 AS DOUBLE) + p_partkey % 8 * 0.125 AS v FROM part) GROUP BY 1 HAVING count(*) >= 3),"
    " p AS (SELECT image_id, v, i, 13.2 + i * (CAST(1.6 AS DOUBLE) / 320) AS p FROM v, range(321) t(i)),"
    " a AS (SELECT *, atan2(list_sum(list_transform(v, lambda x: sin(x * 2 * pi() / p))) / len(v), list_sum(list_transform(v, lambda x: cos(x * 2 * pi() / p))) / len(v)) AS a FROM p),"
    " f AS (SELECT *, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END * p / (2 * pi()) AS f FROM a),"
    " e AS (SELECT image_id, i, p, round(list_median(list_transform(list_transform(v, lambda x: x - f - p * floor((x - f) / p)), lambda o: least(o, p - o))), 9) AS e FROM f)"
    " SELECT image_id, round(min(e), 6) AS error, round(arg_min(p, (e, i)), 6) AS pitch FROM e GROUP BY 1"
)
def refined_pitch(spark, d):
    rows = base(spark, d, "names").selectExpr("p_size as image_id", "cast(p_partkey * 37 % 409 as double) + p_partkey % 8 * 0.125d as v")
    values = rows.groupBy("image_id").agg(F.array_sort(F.collect_list("v")).alias("v")).where(F.size("v") >= 3)
    fit = values.select("image_id", screens.refined_pitch(F.col("v"), F.lit(14.0)).alias("f"))
    return fit.select("image_id", F.round("f.error", 6).alias("error"), F.round("f.pitch", 6).alias("pitch"))


_LINE = {"text": "CASE WHEN seq % 3 <> 0 THEN concat(status, seq) END", "family": "CASE WHEN seq % 2 = 0 THEN 'Inter' END", "font_size": "CASE WHEN seq % 4 <> 0 THEN y1 - y0 END", "method": "CASE WHEN seq % 2 = 0 THEN 'latin' END"}


@query(
    "SELECT image_id, string_agg(' [' || seq || '] ' || kind || CASE WHEN text IS NULL THEN '' ELSE ' \"' || text || '\"' END || ' @[' || x0 || ',' || y0 || '-' || x1 || ',' || y1 || '] ' || coalesce(family, '?') || '~' || coalesce(CAST(font_size AS VARCHAR), '?') || 'px', chr(10) ORDER BY seq) AS text FROM ("
    + _boxes_sql(**_LINE)
    + ") GROUP BY 1",
    "boxes",
)
def scene_lines(spark, d):
    return screens.scene_lines(_boxes(spark, d, **_LINE).withColumn("norm", geometry.box(*geometry.SIDES)))


_CLAIMS = (
    f", e AS ({_boxes_sql(**_LINE)}), x AS (SELECT DISTINCT image_id, 'screen.size' AS claim_id, 'screen' AS subject, 'measured' AS epistemic, 'image-decoder' AS method, CAST(NULL AS DOUBLE) AS confidence FROM e"
    " UNION ALL SELECT image_id, 'element.' || seq || '.geometry', 'element:' || seq, 'measured', 'element-tree', NULL FROM e"
    " UNION ALL SELECT image_id, 'element.' || seq || '.text', 'element:' || seq || '.text', 'inferred', coalesce(method, 'rapidocr'), confidence FROM e WHERE text IS NOT NULL)"
)


@query(_CLAIMS + " SELECT * FROM x", "boxes")
def element_claims(spark, d):
    return screens.element_claims(_boxes(spark, d, **_LINE), WIDTH, HEIGHT)


@query(_CLAIMS + " SELECT image_id, count(*) FILTER (epistemic = 'measured') AS measured, count(*) FILTER (epistemic = 'inferred') AS inferred, count(*) FILTER (epistemic = 'observed') AS observed FROM x GROUP BY 1", "boxes")
def epistemic_counts(spark, d):
    return screens.epistemic_counts(screens.element_claims(_boxes(spark, d, **_LINE), WIDTH, HEIGHT))


def _lab_sql(h: str) -> str:
    """SQL of l, a, b of a colour number as a struct."""

    def linear(v: str) -> str:
        return f"CASE WHEN ({v}) / 255.0 <= 0.04045 THEN ({v}) / 255.0 / 12.92 ELSE pow((({v}) / 255.0 + 0.055) / 1.055, 2.4) END"

    def curve(t: str) -> str:
        return f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0 / 3.0) ELSE 7.787 * {t} + 16.0 / 116.0 END"

    return (
        "(SELECT {'l': round(round((116 * y - 16) * 2.55, 6)), 'a': round(round(500 * (x - y) + 128, 6)), 'b': round(round(200 * (y - z) + 128, 6))} FROM (SELECT "
        + f"{curve('x')} AS x, {curve('y')} AS y, {curve('z')} AS z FROM (SELECT (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z"
        + f" FROM (SELECT CAST({linear(f'{h} // 65536')} AS DOUBLE) AS r, CAST({linear(f'{h} // 256 % 256')} AS DOUBLE) AS g, CAST({linear(f'{h} % 256')} AS DOUBLE) AS b))))"
    )


@query(f"SELECT p_partkey, v.l AS l, v.a AS a, v.b AS b FROM (SELECT p_partkey, {_lab_sql('n')} AS v FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS n FROM part))")
def lab_colors(spark, d):
    return base(spark, d, "colors").select("p_partkey", comparison.lab(F.col("hex")).alias("v")).select("p_partkey", "v.*")


def _palette_sql(n: str) -> str:
    return (
        f"SELECT p_size, rank, (r * 16 + 8) * 65536 + (g * 16 + 8) * 256 + b * 16 + 8 AS n, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY p_size) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY c DESC, b, g, r) AS rank FROM (SELECT p_size, n // 65536 // 16 AS r, n // 256 % 256 // 16 AS g, n % 256 // 16 AS b, count(*) AS c"
        f" FROM (SELECT p_size, {n} AS n FROM part) GROUP BY ALL)) WHERE rank <= 16"
    )


_SHADES, _OTHERS = "p_partkey * 7919 % 97 * 131071 % 16777216", "p_partkey * 104729 % 89 * 65521 % 16777216"


def _shades(spark, d, n):
    return comparison.binned_palette(base(spark, d, "names").select("p_size", F.expr(_hex(n)).alias("hex")), "p_size")


@query(f"SELECT p_size, CAST(rank AS INT) AS rank, concat('#', lpad(hex(n), 6, '0')) AS hex, round(weight, 9) AS weight FROM ({_palette_sql(_SHADES)})")
def binned_palettes(spark, d):
    return _shades(spark, d, _SHADES).withColumn("weight", F.round("weight", 9))


@query(
    f"WITH a AS MATERIALIZED (SELECT p_size, rank, weight, {_lab_sql('n')} AS c FROM ({_palette_sql(_SHADES)})), b AS MATERIALIZED (SELECT p_size, rank, weight, {_lab_sql('n')} AS c FROM ({_palette_sql(_OTHERS)})),"
    " j AS (SELECT a.p_size, a.rank AS ra, b.rank AS rb, a.weight AS wa, b.weight AS wb, sqrt(pow(a.c.l - b.c.l, 2) + pow(a.c.a - b.c.a, 2) + pow(a.c.b - b.c.b, 2)) AS d FROM a JOIN b ON a.p_size = b.p_size)"
    " SELECT p_size, round((x + y) / 2, 6) AS distance FROM (SELECT p_size, sum(d * wa) AS x FROM (SELECT p_size, ra, any_value(wa) AS wa, min(d) AS d FROM j GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT p_size, sum(d * wb) AS y FROM (SELECT p_size, rb, any_value(wb) AS wb, min(d) AS d FROM j GROUP BY 1, 2) GROUP BY 1) USING (p_size)"
)
def palette_distances(spark, d):
    return comparison.palette_distance(_shades(spark, d, _SHADES), _shades(spark, d, _OTHERS), "p_size").withColumn("distance", F.round("distance", 6))


_FEW = "p_partkey % 11 * 1118481"


@query(f"SELECT p_size, arg_max(concat('#', lpad(hex(n), 6, '0')), (c, -(n % 256 * 65536 + n // 256 % 256 * 256 + n // 65536))) AS hex, max(c) AS n FROM (SELECT p_size, n, count(*) AS c FROM (SELECT p_size, CAST({_FEW} AS BIGINT) AS n FROM part) GROUP BY 1, 2) GROUP BY 1")
def exact_modes(spark, d):
    return comparison.exact_mode(base(spark, d, "names").select("p_size", F.expr(_hex(_FEW)).alias("hex")), "p_size")


_MEASURES = {
    "pixels": "(o_orderkey % 17) * 0.01", "edges": "(o_orderkey % 13) * 0.02", "palette": "1 - (o_orderkey % 7) * 0.03", "text": "1 - (o_orderkey % 6) * 0.09", "layout": "1 - (o_orderkey % 5) * 0.07",
    "foreground": "(o_orderkey % 23) * 0.015", "hot": "(o_orderkey % 11) * 0.009", "bounding": "(o_orderkey % 9) * 0.021", "width": "(300 + o_orderkey * 37 % 1700)", "height": "(200 + o_orderkey * 53 % 1500)",
}
_MEASURED = ", ".join(f"{v} AS {k}" if k in ("width", "height") else f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in _MEASURES.items())
_SCORED = (
    f"SELECT *, round(0.30 * (1.0 - pixels) + 0.15 * palette + 0.20 * (1.0 - edges) + 0.20 * text + 0.15 * layout, 4) AS similarity, least(0.34, 0.18 + 0.05 * greatest(0, greatest(1, least(6, round_even(least(width, height) / 256.0, 0))) - 2)) AS foreground_limit, CASE WHEN hot < 0.025 OR hot / greatest(1e-9, bounding) < 0.30 THEN 0.0 ELSE bounding END AS hot_box"
    f" FROM (SELECT o_orderkey, o_orderkey % 10 <> 0 AS exact, o_orderkey % 19 = 0 AS resampled, {_MEASURED} FROM orders)"
)


def _scored(spark, d):
    o = base(spark, d, "orders").withColumns({k: F.expr(v) if k in ("width", "height") else F.round(F.expr(f"CAST({v} AS DOUBLE)"), 6) for k, v in _MEASURES.items()})
    o = o.withColumns({"exact": F.col("o_orderkey") % 10 != 0, "resampled": F.col("o_orderkey") % 19 == 0, "foreground_limit": comparison.foreground_limit(F.col("width"), F.col("height")), "hot_box": comparison.material_share(F.col("hot"), F.col("bounding"))})
    return o.withColumn("similarity", comparison.overall_similarity(*(F.col(k) for k in ("pixels", "palette", "edges", "text", "layout"))))


@query(f"SELECT o_orderkey, round(similarity, 3) AS similarity, round(foreground_limit, 6) AS foreground_limit, hot_box FROM ({_SCORED})")
def comparison_scores(spark, d):
    return _scored(spark, d).select("o_orderkey", F.round("similarity", 3).alias("similarity"), F.round("foreground_limit", 6).alias("foreground_limit"), "hot_box")


_CHECKS = {
    "dimension_mismatch": "exact", "resampled_candidate": "NOT resampled", "similarity_minimum": "similarity >= 0.88", "pixel_mismatch_maximum": "pixels <= 0.12", "foreground_mismatch_maximum": "foreground <= foreground_limit",
    "text_similarity_minimum": "text >= 0.70", "layout_similarity_minimum": "layout >= 0.80", "largest_hot_region_maximum": "hot <= 0.05", "largest_material_hot_region_bounding_maximum": "hot_box <= 0.08",
}


@query(
    "SELECT o_orderkey, CASE WHEN blocking = '' THEN 'pass' WHEN exact AND similarity >= 0.82 AND pixels <= 0.15 AND foreground <= least(0.40, foreground_limit + 0.06) AND text >= 0.60 AND layout >= 0.70 AND hot <= 0.08 AND hot_box <= 0.12 THEN 'partial' ELSE 'fail' END AS verdict, blocking FROM (SELECT *, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT ({test}) THEN '{name}' END" for name, test in _CHECKS.items())
    + f") AS blocking FROM ({_SCORED}))"
)
def comparison_verdicts(spark, d):
    m = F.struct("exact", "resampled", "similarity", "pixels", "foreground", "foreground_limit", "text", "layout", "hot", "hot_box")
    return _scored(spark, d).select("o_orderkey", comparison.acceptance(m).alias("v")).select("o_orderkey", "v.verdict", F.array_join("v.blocking", ",").alias("blocking"))


@query()
def text_agreement(spark, d):
    """Each message against the first of its conversation."""
    t = base(spark, d, "texts")
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"))
    both = t.join(first, "conv_id").select("conv_id", "turn", comparison.text_agreement(F.col("reference"), F.col("text")).alias("s"))
    return both.select("conv_id", "turn", F.round("s.score", 6).alias("score"), "s.method")


@query()
def regional_scores(spark, d):
    """Pairs of overlapping boxes as readings of the whole and of a region."""
    b = _boxes(spark, d, text="repeat(kind, seq)")
    pairs = spatial.overlapping(b.where("kind = 'R'"), b.where("kind <> 'R'"))
    score = comparison.regional_score(F.col("a_box"), F.col("b_box"), F.col("a_text"), F.col("b_text"))
    return pairs.select("image_id", "a_seq", "b_seq", F.round(score, 6).alias("score"))


_PAGE = {
    "media_type": "CASE page_id % 4 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/html' ELSE 'image/webp' END",
    "x0": "page_id % 5 * 30 - 20.5", "y0": "page_id % 7 * 9 - 10.25", "x1": "page_id % 5 * 30 + 150 + page_id % 11 * 20.75", "y1": "page_id % 7 * 9 + 100 + page_id % 13 * 12.25",
}


@query(
    "SELECT page_id // 16 AS g, CAST(arg_max(page_id % 16 + 1, (coverage, -(page_id % 16))) AS INT) AS seq, round(max(coverage), 5) AS coverage FROM (SELECT *, CAST(greatest(0, least(320, x1) - greatest(0, x0)) * greatest(0, least(200, y1) - greatest(0, y0)) AS DOUBLE) / 64000 AS coverage"
    " FROM (SELECT page_id, html, media_type, round_even(CAST(x0 AS DOUBLE), 0) AS x0, round_even(CAST(y0 AS DOUBLE), 0) AS y0, round_even(CAST(x1 AS DOUBLE), 0) AS x1, round_even(CAST(y1 AS DOUBLE), 0) AS y1 FROM (SELECT page_id, html"
    + "".join(f", {v} AS {k}" for k, v in _PAGE.items())
    + " FROM pages))) WHERE page_id % 16 < 12 AND media_type <> 'text/html' AND page_id % 9 <> 0 AND page_id % 10 <> 3 AND coverage >= 0.55 AND strlen(html) > 0 GROUP BY 1"
)
def verified_backgrounds(spark, d):
    p = base(spark, d, "urls").withColumns({k: F.expr(v).cast("double") if len(k) == 2 else F.expr(v) for k, v in _PAGE.items()})
    n = F.col("page_id")
    p = p.withColumns({"g": F.floor(n / 16), "seq": (n % 16 + 1).cast("int"), "source": F.lit("observed"), "method": F.lit("playwright-response-body"), "visible": n % 9 != 0, "n_texts": F.lit(1), "content": F.col("html").cast("binary")})
    p = p.withColumns({"size_bytes": F.when(n % 2 == 0, F.octet_length("html")), "sha256": F.when(n % 10 == 3, "0").otherwise(F.upper(F.sha2("html", 256)))})
    return comparison.verified_backgrounds(p, WIDTH, HEIGHT, "g")


@query(
    "SELECT g, CAST(min(seq) AS INT) AS seq, arg_min(family, seq) AS family, 'Source ' || substr(digest, 1, 12) AS alias, 'normal' AS weight, style, arg_min(format, seq) AS format FROM (SELECT page_id // 32 AS g, page_id % 32 + 1 AS seq, CASE WHEN page_id % 3 = 0 THEN 'Inter' WHEN page_id % 3 = 1 THEN 'inter' ELSE 'A B' END AS family, sha256(html) AS digest, CASE WHEN page_id % 2 = 0 THEN 'italic' ELSE 'normal' END AS style, CASE WHEN page_id % 5 = 0 THEN 'woff2' ELSE 'truetype' END AS format, page_id FROM pages WHERE strlen(html) BETWEEN 1 AND 4194304) WHERE seq <= 16 AND page_id % 7 <> 0 AND page_id % 5 <> 4 GROUP BY g, lower(family), digest, style"
)
def verified_fonts(spark, d):
    n = F.col("page_id")
    p = base(spark, d, "urls").withColumns({
        "g": F.floor(n / 32), "seq": (n % 32 + 1).cast("int"), "family": F.when(n % 3 == 0, "'Inter', serif").when(n % 3 == 1, "inter").otherwise('"A B"'), "weight": F.when(n % 2 == 0, "").otherwise("normal"), "style": F.when(n % 2 == 0, "ITALIC").when(n % 4 == 1, "slanted"),
        "media_type": F.when(n % 5 == 0, "font/woff2;v=1").when(n % 5 == 4, "text/css").otherwise("FONT/ttf"), "sha256": F.when(n % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("html", 256)), "content": F.col("html").cast("binary"),
    })
    return comparison.verified_fonts(p, "g")


@query(
    "SELECT conv_id, turn, CAST(len(n) AS INT) AS n, sha256(array_to_string(list_transform(n, lambda x: x.t || '|' || x.c), ';')) AS digest FROM (SELECT conv_id, turn, list_filter([{'t': trim(substr(text, 1, 20)), 'c': CASE WHEN turn % 3 = 0 THEN 'red' ELSE '' END, 'ok': true}, {'t': trim(substr(text, 3, 700)), 'c': '', 'ok': turn % 2 = 0}, {'t': '', 'c': '', 'ok': true}], lambda x: x.ok AND strlen(x.t) BETWEEN 1 AND 500) AS n FROM (SELECT conv_id, turn, regexp_replace(text, '\\s', ' ', 'g') AS text FROM conversations)) WHERE len(n) > 0"
)
def source_texts(spark, d):
    words = F.array(F.struct(F.lit(" w ").alias("text"), F.array(*map(F.lit, (0.0, 1.0, 2.0, 2e6))).alias("box")))
    four = F.array(*map(F.lit, (0.0, 0.0, 9.0, 9.0)))

    def node(t, visible, style):
        return F.struct(t.alias("text"), four.alias("box"), visible.alias("visible"), style.alias("style"), words.alias("words"))

    t = F.regexp_replace("text", r"(?U)\s", " ")
    style = F.create_map(F.lit("color"), F.when(F.col("turn") % 3 == 0, "red"), F.lit("zoom"), F.lit("2"))
    nodes = F.array(node(F.substring(t, 1, 20), F.lit(None).cast("boolean"), style), node(F.substring(t, 3, 700), F.col("turn") % 2 == 0, style), node(F.lit("  "), F.lit(True), style))
    rows = base(spark, d, "texts").select("conv_id", "turn", comparison.source_texts(nodes).alias("n")).where("n is not null")
    said = F.transform("n", lambda x, k: F.concat(x["text"], F.lit("|"), F.when((k == 0) & (F.length(x["text"]) <= 20), F.coalesce(x["style"]["color"], F.lit(""))).otherwise("")))
    return rows.select("conv_id", "turn", F.size("n").alias("n"), F.sha2(F.array_join(said, ";"), 256).alias("digest"))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 4 = 0 THEN s ELSE list_transform(range(CAST(floor(len(s) / step) AS BIGINT)), lambda k: s[CAST(least(floor(k * step), len(s) - 1) AS BIGINT) + 1]) END, ',') AS samples FROM (SELECT p_partkey, list_transform(range(p_size), lambda k: k * 7 % 13) AS s, CASE p_partkey % 4 WHEN 1 THEN 1.5 WHEN 2 THEN 0.5 ELSE 3.0 END AS step FROM part)")
def resampled_clips(spark, d):
    rate = F.expr("CASE p_partkey % 4 WHEN 0 THEN 16000 WHEN 1 THEN 24000 WHEN 2 THEN 8000 ELSE 48000 END")
    samples = F.expr("transform(sequence(0, p_size - 1), k -> k * 7 % 13)")
    return base(spark, d, "names").select("p_partkey", F.array_join(comparison.resampled(samples, rate, F.lit(16000)).cast("array<string>"), ",").alias("samples"))


@query("SELECT user_id, event_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events WHERE epoch(TIMESTAMP '2024-01-20') - epoch(ts) <= 864000) WHERE rank <= 7")
def live_sessions(spark, d):
    e = base(spark, d, "events").withColumnRenamed("ts", "last_active")
    return sessions.live_sessions(e, "user_id", "event_id", F.to_timestamp(F.lit("2024-01-20")), 864_000).select("user_id", "event_id", "rank")


_STATUS = "CASE WHEN o_orderkey % 31 = 0 THEN 'running' WHEN o_orderkey % 5 = 0 THEN 'complete' WHEN o_orderkey % 5 = 1 THEN 'awaiting_consent' WHEN o_orderkey % 5 = 2 THEN 'failed' ELSE 'queued' END"


@query(
    f"SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM (SELECT *, {_STATUS} AS status, count(*) FILTER ({_STATUS} = 'running') OVER (PARTITION BY o_custkey) AS running FROM orders) WHERE status IN ('queued', 'awaiting_consent')) WHERE rank <= 2 - running"
)
def started_jobs(spark, d):
    o = base(spark, d, "orders").withColumns({"status": F.expr(_STATUS), "created_at": F.col("o_orderdate")})
    return sessions.started(o, "o_custkey", "o_orderkey")


@query(
    f"SELECT o_orderkey, CASE WHEN c THEN 'cancelled' WHEN a THEN 'queued' ELSE status END AS state, CASE WHEN status IS NULL THEN NULL WHEN o_orderkey % 2 = 0 THEN CASE WHEN c THEN 'cancelled' ELSE 'complete' END WHEN a THEN 'queued' ELSE status END AS answer, CASE WHEN status IS NULL THEN 'job_not_found' WHEN c THEN 'cancelled by client' END AS error FROM (SELECT o_orderkey, status, coalesce(o_orderkey % 2 = 0 AND status NOT IN ('complete', 'failed', 'cancelled'), false) AS c, coalesce(o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 AND status = 'awaiting_consent', false) AS a FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {_STATUS} END AS status FROM orders))"
)
def job_requests(spark, d):
    k = F.col("o_orderkey")
    after = sessions.after_request(F.expr(f"CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {_STATUS} END"), F.when(k % 2 == 0, "cancel").otherwise("status"), k % 3 == 0)
    return base(spark, d, "orders").select("o_orderkey", after.alias("a")).select("o_orderkey", "a.*")


@query(
    "SELECT e.event_id, CASE WHEN live THEN url END AS url, CASE WHEN NOT live THEN 'web_session_not_found' WHEN url IS NULL THEN 'invalid_input' END AS error FROM (SELECT e.event_id, coalesce(epoch(e.ts) - epoch(s.last_active) <= 7200, false) AS live, coalesce(CASE WHEN e.event_id % 3 = 0 THEN 'http://own' END, s.known_url) AS url FROM events e LEFT JOIN (SELECT user_id, min(ts) + INTERVAL 5 DAY AS last_active, CASE WHEN user_id % 2 = 0 THEN 'http://known' END AS known_url FROM events WHERE user_id % 7 <> 0 GROUP BY user_id) s USING (user_id)) e"
)
def review_requests(spark, d):
    e = base(spark, d, "events")
    known = e.where("user_id % 7 <> 0").groupBy("user_id").agg((F.min("ts") + F.expr("interval 5 days")).alias("last_active")).withColumn("known_url", F.when(F.col("user_id") % 2 == 0, "http://known"))
    asked = e.select("event_id", "user_id", F.col("ts").alias("asked_at"), F.when(F.col("event_id") % 3 == 0, "http://own").when(F.col("event_id") % 3 == 1, " ").alias("candidate_url"))
    return sessions.review_requests(asked, known, "user_id").select("event_id", "url", "error")


@query(
    "SELECT p_partkey, w AS width, r AS dpr, t AS theme, CASE WHEN w NOT BETWEEN 320 AND 3840 THEN 'width' WHEN r NOT BETWEEN 0.5 AND 3.0 THEN 'dpr' WHEN t NOT IN ('light', 'dark', 'no-preference') THEN 'theme' END AS refusal FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1440 ELSE CAST(p_size * 90 AS INT) END AS w, CAST(CASE WHEN p_partkey % 7 = 0 THEN 1.0 ELSE p_size * 0.125 END AS DOUBLE) AS r, CASE p_partkey % 4 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' WHEN 2 THEN 'light' ELSE 'blue' END AS t FROM part)"
)
def capture_options(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    given = {"width": F.when(k % 5 != 0, size * 90).cast("int"), "dpr": F.when(k % 7 != 0, size * 0.125), "theme": F.when(k % 4 == 0, "dark").when(k % 4 == 1, "").when(k % 4 == 3, "blue")}
    options, refusal = sessions.capture_options(given)
    return base(spark, d, "names").select("p_partkey", options.alias("o"), refusal.alias("refusal")).select("p_partkey", "o.width", "o.dpr", "o.theme", "refusal")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
