"""Queries of the section tree, with their SQL: recursive, over profiles pixel by pixel where the operators work on changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.lineage import cut
from evidentia.operators import sections
from evidentia.plans.bases import HEIGHT, WIDTH, base, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What is on a picture: the boxes of its even lines, and what is left of the others beside them when three quarters are gone.
_CONTENT = "CAST(CASE WHEN seq % 2 = 0 THEN x0 ELSE (x0 + x1 + x1) // 3 END AS INT)"
_TALL = "CAST(CASE WHEN kind = 'R' THEN y1 - y0 END AS DOUBLE)"
_COLOR = "concat('#', lpad(hex(CAST(image_id * 7919 % 16777216 AS BIGINT)), 6, '0'))"


def query(sql: str):
    """Register a function of (spark, sf_dir) under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _bands(axis: str) -> str:
    """SQL of the widest band of a region r (x0, y0, x1, y1, and rects within it) along an axis: a struct of its width, less its start, and its middle."""
    other = "x" if axis == "y" else "y"
    n = f"list_sum(list_transform(list_filter(r.rects, lambda q: q.{axis}0 <= p AND p < q.{axis}1), lambda q: q.{other}1 - q.{other}0))"
    profile = f"list_transform(range(r.{axis}0, r.{axis}1), lambda p: coalesce({n}, 0))"
    full = f"(SELECT list_filter(range(r.{axis}0, r.{axis}1), lambda p: f[p - r.{axis}0 + 1] > greatest(1, floor(0.02 * list_max(f)))) FROM (SELECT {profile} AS f))"
    return (
        f"(SELECT list_max(list_filter(list_transform(range(1, len(g)), lambda k: {{'wide': g[k + 1] - g[k] - 1, 'first': -g[k] - 1, 'middle': (g[k] + 1 + g[k + 1]) // 2}}), lambda b: b.wide >= {sections.BAND})) FROM (SELECT {full} AS g))"
    )


def _clipped(parts: str) -> str:
    """SQL of the rectangles of a part p of a region r, cut to it."""
    inner = f"{{'x0': greatest(q.x0, {parts}.x0), 'y0': greatest(q.y0, {parts}.y0), 'x1': least(q.x1, {parts}.x1), 'y1': least(q.y1, {parts}.y1)}}"
    return f"list_filter(list_transform(r.rects, lambda q: {inner}), lambda q: q.x0 < q.x1 AND q.y0 < q.y1)"


_REGIONS = f"""
content AS (SELECT image_id, seq, kind, {_CONTENT} AS x0, y0, x1, y1 FROM b_boxes),
rows AS (SELECT image_id, y, x0, x1 FROM content, range(y0, y1) AS t(y) WHERE x0 < x1),
ahead AS (SELECT *, max(x1) OVER (PARTITION BY image_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rows),
runs AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM ahead),
lines AS (SELECT image_id, y, CAST(min(x0) AS INT) AS x0, CAST(max(x1) AS INT) AS x1 FROM runs GROUP BY image_id, y, run),
marks AS (SELECT image_id, list({{'x0': x0, 'y0': CAST(y AS INT), 'x1': x1, 'y1': CAST(y + 1 AS INT)}}) AS rects FROM lines GROUP BY image_id),
tree AS (
  SELECT image_id, 0 AS depth, '' AS region, 0 AS x0, 0 AS y0, {WIDTH} AS x1, {HEIGHT} AS y1, rects FROM marks
  UNION ALL
  SELECT p.image_id, p.depth + 1, p.region || p.part, p.x0, p.y0, p.x1, p.y1, {_clipped("p").replace("r.rects", "p.rects")}
  FROM (
    SELECT c.image_id, c.depth, c.region, part, c.rects,
      CASE WHEN c.axis = 'x' AND part = 1 THEN c.place ELSE c.x0 END AS x0, CASE WHEN c.axis = 'y' AND part = 1 THEN c.place ELSE c.y0 END AS y0,
      CASE WHEN c.axis = 'x' AND part = 0 THEN c.place ELSE c.x1 END AS x1, CASE WHEN c.axis = 'y' AND part = 0 THEN c.place ELSE c.y1 END AS y1
    FROM (SELECT *, CASE WHEN by_y IS NOT NULL THEN 'y' ELSE 'x' END AS axis, CAST(coalesce(by_y.middle, by_x.middle) AS INT) AS place FROM (SELECT r.*, {_bands("y")} AS by_y, {_bands("x")} AS by_x FROM tree r WHERE r.depth < {sections.DEPTH} AND r.x1 - r.x0 >= {sections.SIDE} AND r.y1 - r.y0 >= {sections.SIDE})) c, range(2) AS t(part)
    WHERE place - CASE axis WHEN 'x' THEN x0 ELSE y0 END >= {sections.SIDE} AND CASE axis WHEN 'x' THEN x1 ELSE y1 END - place >= {sections.SIDE}) p),
regions AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree u WHERE u.image_id = t.image_id AND u.region = t.region || '0')),
bounds AS (
  SELECT image_id, region, list_min(list_transform(rects, lambda q: q.x0)) AS x0, list_min(list_transform(rects, lambda q: q.y0)) AS y0, list_max(list_transform(rects, lambda q: q.x1)) AS x1, list_max(list_transform(rects, lambda q: q.y1)) AS y1
  FROM regions WHERE (x1 - x0) * (y1 - y0) >= {sections.LEAST_AREA} AND len(rects) > 0),
shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY region) AS INT) AS seq FROM bounds WHERE x1 - x0 >= {sections.LEAST_SIDE} AND y1 - y0 >= {sections.LEAST_SIDE}),
inside AS (
  SELECT s.image_id, s.seq, c.seq AS element, c.kind, CASE WHEN c.kind = 'R' THEN c.y1 - c.y0 END AS cap FROM shown s JOIN content c USING (image_id)
  WHERE c.x0 < c.x1 AND (c.x0 + c.x1) / 2.0 BETWEEN s.x0 AND s.x1 AND (c.y0 + c.y1) / 2.0 BETWEEN s.y0 AND s.y1),
tallest AS (SELECT image_id, greatest(max(cap), 1) AS largest, CAST(arg_min(seq, (-cap, seq)) AS INT) AS tallest FROM (SELECT image_id, seq, y1 - y0 AS cap FROM content WHERE kind = 'R' AND x0 < x1) GROUP BY image_id),
facts AS (
  SELECT s.*, coalesce(t.largest, 1) AS largest, t.tallest, count(i.element) FILTER (i.kind = 'R') AS n_texts, count(i.element) FILTER (i.kind = 'A') AS n_buttons, coalesce(max(i.cap), 0) AS cap, coalesce(bool_or(i.kind = 'R' AND i.element = t.tallest), false) AS has
  FROM shown s LEFT JOIN inside i USING (image_id, seq) LEFT JOIN tallest t USING (image_id) GROUP BY ALL),
first_roles AS (
  SELECT *, CASE WHEN y1 - y0 < {HEIGHT * 0.18} AND y0 < {HEIGHT * 0.15} AND n_texts >= 2 THEN 'nav' WHEN n_buttons >= 2 THEN 'cta' WHEN y1 - y0 < {HEIGHT * 0.14} AND x1 - x0 < {WIDTH * 0.55} AND n_texts > 0 THEN 'badge'
    WHEN y0 < {HEIGHT * 0.2} AND y1 - y0 < {HEIGHT * 0.3} THEN 'header' WHEN y0 > {HEIGHT * 0.85} THEN 'footer' WHEN cap > 0 AND cap >= largest * 0.8 THEN 'hero' ELSE 'content' END AS role FROM facts),
roles AS (SELECT image_id, seq, x0, y0, x1, y1, CASE WHEN seq = min(CASE WHEN has AND role NOT IN ('nav', 'badge', 'footer', 'graphic') THEN seq END) OVER (PARTITION BY image_id) THEN 'hero' ELSE role END AS role FROM first_roles)"""


def _sql(result: str) -> str:
    return with_sql("boxes", "").strip().replace("WITH", "WITH RECURSIVE", 1) + "," + _REGIONS + "\n" + result


def _content(spark, d):
    return base(spark, d, "boxes").withColumn("x0", F.expr(_CONTENT.replace("//", "div")))


def _regions(spark, d):
    return sections.region_tree(_content(spark, d), (0, 0, WIDTH, HEIGHT))


@query(_sql("SELECT image_id, region, x0, y0, x1, y1 FROM regions"))
def section_cuts(spark, d):
    return _regions(spark, d).drop("held")


@query(_sql("SELECT image_id, seq, region, x0, y0, x1, y1 FROM shown"))
def content_sections(spark, d):
    return sections.content_sections(_regions(spark, d))


def _roles(spark, d):
    shown = cut(sections.content_sections(_regions(spark, d)), "shown")
    content = cut(_content(spark, d).where("x0 < x1").select("image_id", "seq", "kind", "x0", "y0", "x1", "y1"), "content")  # met several times
    texts = content.where("kind = 'R'").withColumn("cap_height", F.expr(_TALL))
    return shown, content, sections.assigned_roles(shown, texts, content.where("kind = 'A'"), WIDTH, HEIGHT)


@query(_sql("SELECT image_id, seq, role FROM roles"))
def assigned_roles(spark, d):
    return _roles(spark, d)[2]


_ELEMENT_SQL = f"""
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY section, nth NULLS FIRST) AS INT) AS line, text FROM (
  SELECT DISTINCT image_id, -2 AS section, NULL AS nth, concat('Screen {WIDTH}x{HEIGHT}, ', CASE WHEN CAST(0.299 AS DOUBLE) * (n // 65536) + CAST(0.587 AS DOUBLE) * (n // 256 % 256) + CAST(0.114 AS DOUBLE) * (n % 256) < 128 THEN 'dark' ELSE 'light' END, ' theme, background ', {_COLOR}, '.') AS text FROM (SELECT *, image_id * 7919 % 16777216 AS n FROM content)
  UNION ALL SELECT DISTINCT image_id, -1, NULL, '  - section role=screen [0,0,{WIDTH},{HEIGHT}]' FROM content
  UNION ALL SELECT image_id, seq, NULL, concat('    - section role=', role, ' [', x0, ',', y0, ',', x1, ',', y1, ']') FROM roles
  UNION ALL
  SELECT c.image_id, coalesce(s.section, 0), c.seq, concat(CASE WHEN s.section IS NULL THEN '    - ' ELSE '      - ' END,
    CASE c.kind WHEN 'R' THEN concat('text "', c.kind, c.seq, '" at [', c.x0, ',', c.y0, ',', c.x1, ',', c.y1, '] font ?~', c.y1 - c.y0, 'px')
      WHEN 'A' THEN concat('button [', c.x0, ',', c.y0, ',', c.x1, ',', c.y1, '] ', CASE WHEN c.seq % 2 = 0 THEN 'bg #102030' ELSE 'label A' || c.seq END)
      ELSE concat('graphic [', c.x0, ',', c.y0, ',', c.x1, ',', c.y1, ']') END)
  FROM content c LEFT JOIN (SELECT i.image_id, i.element AS seq, arg_min(i.seq, ((r.x1 - r.x0) * (r.y1 - r.y0), i.seq)) AS section FROM inside i JOIN roles r ON r.image_id = i.image_id AND r.seq = i.seq GROUP BY ALL) s ON s.image_id = c.image_id AND s.seq = c.seq
  WHERE c.x0 < c.x1)"""


@query(_sql(_ELEMENT_SQL))
def screen_summaries(spark, d):
    from evidentia.operators import spatial

    shown, content, roles = _roles(spark, d)
    said = {
        "kind": F.expr("CASE kind WHEN 'R' THEN 'text' WHEN 'A' THEN 'button' ELSE 'image' END"), "text": F.concat("kind", "seq"), "family": F.lit(None).cast("string"), "size": F.col("y1") - F.col("y0"),
        "labels": F.expr("CASE WHEN seq % 2 = 0 THEN array() ELSE array(concat('A', seq)) END"), "icon": F.lit(None).cast("string"), "fill": F.expr("CASE WHEN seq % 2 = 0 THEN '#102030' END"), "border": F.lit(None).cast("string"),
    }
    elements = spatial.section_of(content.where("image_id IS NOT NULL"), shown, kept=("kind", "x0", "y0", "x1", "y1")).withColumns(said)
    return sections.summary_lines(shown.join(roles, ["image_id", "seq"]), elements, sections.theme(F.expr(_COLOR)), WIDTH, HEIGHT)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
