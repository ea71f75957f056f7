"""Queries on requests, jobs, recognised speech and projections, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from evidentia.functions import geometry, text
from evidentia.operators import fanout, projections, spatial, speech
from evidentia.plans.bases import HEIGHT, WIDTH, base, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str, bases: str = ""):
    """Register a function of (spark, sf_dir) under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_sql(bases, sql) if bases else sql
        return f

    return add


def _pick(values: tuple, at: str):
    """One of some constants by a number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(f"({at}) % {len(values)}") + 1).cast("int"))


def _pick_sql(values: tuple, at: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST(({at}) % {len(values)} AS INT) + 1]"


_SEGMENTS = "[{'t': substr(text, 1, 12), 's': CAST(turn * 1.237 AS VARCHAR), 'e': CAST(turn * 1.237 + 0.5 AS VARCHAR)}, {'t': '  ', 's': '1', 'e': '2'}, {'t': substr(text, 5, 9), 's': CASE WHEN turn % 2 = 0 THEN 'x' ELSE '7.126' END, 'e': '9'}]"


def _segments():
    def one(t, s, e):
        return F.struct(t.alias("text"), s.alias("start"), e.alias("end"))

    second = F.when(F.col("turn") % 2 == 0, "x").otherwise("7.126")
    return F.array(one(F.substring("text", 1, 12), F.format_string("%.3f", F.col("turn") * 1.237), F.format_string("%.3f", F.col("turn") * 1.237 + 0.5)), one(F.lit("  "), F.lit("1"), F.lit("2")), one(F.substring("text", 5, 9), second, F.lit("9")))


@query(
    "SELECT conv_id, turn, CAST(len(s) AS INT) AS n, array_to_string(list_transform(s, lambda x: trim(x.t, e' \\t\\n\\r')), ' ') AS said, round(list_sum(list_transform(s, lambda x: round(CAST(x.s AS DOUBLE), 2))), 2) AS starts"
    f" FROM (SELECT conv_id, turn, list_filter({_SEGMENTS}, lambda x: trim(x.t, e' \\t\\n\\r') <> '' AND TRY_CAST(x.s AS DOUBLE) IS NOT NULL) AS s FROM conversations)"
)
def clean_segments(spark, d):
    s = speech.clean_segments(_segments())
    starts = F.aggregate(F.col("s"), F.lit(0.0), lambda x, y: x + y["start"])
    rows = base(spark, d, "texts").select("conv_id", "turn", s.alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("n"), speech.joined_text(F.col("s"), F.lit("")).alias("said"), F.when(F.size("s") > 0, F.round(starts, 2)).alias("starts"))


_OPS = ("model_status", "fetch", "transcribe", "dictation_stop", "model_install")
_MODELS_GIVEN = ("qwen", None, "other")
_URLS_GIVEN = (" https://m.example/a", "ftp://m.example/a", None)


@query(
    f"SELECT event_id, CASE WHEN op IN ('model_status', 'model_install') THEN CASE WHEN user_id % 7 = 0 THEN 'invalid_input' WHEN model NOT IN ('qwen', 'gigaam', 'whisper', 'remote') THEN 'invalid_model' END WHEN op = 'dictation_stop' THEN NULL WHEN user_id % 7 = 0 THEN 'invalid_input'"
    " WHEN op = 'fetch' THEN CASE WHEN coalesce(starts_with(trim(url), 'https://') OR starts_with(trim(url), 'http://'), false) THEN NULL ELSE 'invalid_input' END WHEN event_id % 4 = 0 THEN 'invalid_input' WHEN event_id % 4 <> 1 THEN 'file_not_found' END AS refusal"
    f" FROM (SELECT event_id, user_id, {_pick_sql(_OPS, 'event_id')} AS op, {_pick_sql(_MODELS_GIVEN, 'user_id')} AS model, {_pick_sql(_URLS_GIVEN, 'user_id')} AS url FROM events)"
)
def hearing_inputs(spark, d):
    fields = F.when(F.col("user_id") % 7 != 0, F.array(F.lit("audioPath")))
    path = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("/a/"), F.col("event_id") % 4))
    refusal = speech.input_refusal(_pick(_OPS, "event_id"), fields, _pick(_MODELS_GIVEN, "user_id"), _pick(_URLS_GIVEN, "user_id"), path, F.array(F.lit("/a/1")))
    return base(spark, d, "events").select("event_id", refusal.alias("refusal"))


@query(
    f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'observed:camera measured:clock' WHEN event_id % 3 = 1 THEN 'inferred:model' ELSE CASE {_pick_sql(_OPS, 'event_id')} WHEN 'fetch' THEN 'observed:public_media_fetch' WHEN 'transcribe' THEN 'inferred:automatic_speech_recognition'"
    " WHEN 'dictation_stop' THEN 'observed:broker_owned_dictation_state' ELSE 'observed:local_model_state' END END AS claims FROM events"
)
def hearing_provenance(spark, d):
    def claim(kind, method):
        return F.struct(F.lit(kind).alias("kind"), F.lit(method).cast("string").alias("method"), F.lit(0.5).alias("confidence"))

    some, one, none = F.array(claim("measured", "clock"), claim("observed", "camera")), F.array(claim("inferred", "model"), claim("observed", None)), F.array(claim("measured", None))
    made = speech.provenance(_pick(_OPS, "event_id"), F.when(F.col("event_id") % 3 == 0, some).when(F.col("event_id") % 3 == 1, one).otherwise(none))
    told = F.array_join(F.transform(made, lambda c: F.concat_ws(":", c["kind"], c["method"])), " ")
    return base(spark, d, "events").select("event_id", told.alias("claims"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"a\":\"' || event_type || '\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' ELSE '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' END AS kept FROM events")
def kept_fields(spark, d):
    e = base(spark, d, "events")
    more = F.concat(F.lit('{"a":"'), "event_type", F.lit('","b":3,"k":"'), F.get_json_object("props", "$.k"), F.lit('"}'))
    return e.select("event_id", projections.kept_fields(F.when(F.col("event_id") % 2 == 0, more).otherwise(F.regexp_replace("props", r'(\d+)', '"$1"')), ["a", "k", "z"]).alias("kept"))


_MEDIA = ("font/woff2", "image/svg+xml", "application/x-font-ttf", "")


@query(
    f"SELECT page_id, CAST(len(list_filter(range(0, page_id % 20 + 1), lambda k: k < 16 AND length(url) % 5 <> 0 AND k % 3 <> 1 AND contains({_pick_sql(_MEDIA, 'k + page_id')}, 'font'))) AS INT) AS fonts, CAST(len(list_filter(range(0, page_id % 20 + 1), lambda k: k < 12 AND {_pick_sql(_MEDIA, 'k + page_id')} = 'image/svg+xml')) AS INT) AS vectors,"
    f" CAST(len(list_filter(range(0, page_id % 20 + 1), lambda k: k < 12 AND {_pick_sql(_MEDIA, 'k + page_id')} <> '')) AS INT) AS rasters FROM pages"
)
def sound_assets(spark, d):
    def asset(k):
        media = F.element_at(F.array(*map(F.lit, _MEDIA)), ((k + F.col("page_id")) % 4 + 1).cast("int"))
        return F.struct(F.when(F.length("url") % 5 != 0, F.col("url")).otherwise("  ").alias("family"), F.concat(F.lit("/f/"), k).alias("path"), F.when(k % 3 != 1, F.sha2("url", 256)).otherwise("short").alias("sha256"), media.alias("media_type"))

    given = F.transform(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 20), asset)
    rows = base(spark, d, "urls").withColumn("url", F.substring("url", 1, 100)).withColumn("given", given)
    return rows.select("page_id", *(F.coalesce(F.size(projections.sound_assets(F.col("given"), kind)), F.lit(0)).alias(f"{kind}s") for kind in ("font", "vector", "raster")))


@query("SELECT o_orderkey, left('sight.see finished in ' || o_custkey || ' ms.' || CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN '' ELSE ' ' || array_to_string(list_filter([CASE WHEN o_orderkey % 3 <> 0 THEN 'verdict=' || o_orderstatus END, CASE WHEN o_orderkey % 2 <> 0 THEN 'profile=' || repeat(o_orderpriority, 50) END], lambda x: x IS NOT NULL), ', ') || '.' END, 480) AS told FROM orders")
def result_summaries(spark, d):
    fields = {"verdict": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), "profile": F.when(F.col("o_orderkey") % 2 != 0, F.repeat("o_orderpriority", 50))}
    return base(spark, d, "orders").select("o_orderkey", projections.result_summary(F.lit("sight"), F.lit("see"), F.col("o_custkey"), fields).alias("told"))


@query("SELECT page_id, 'sha256-128:' || CASE page_id % 3 WHEN 0 THEN left(sha256(url), 32) WHEN 1 THEN 'v2-' || page_id ELSE CAST(page_id AS VARCHAR) END AS id FROM pages")
def image_sources(spark, d):
    key = F.when(F.col("page_id") % 3 == 0, F.concat_ws("-", F.lit("v1"), F.substring(F.sha2("url", 256), 1, 32), F.lit("10-20-x.json"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("v2-"), "page_id", F.lit(".json"))).otherwise(F.col("page_id").cast("string"))
    return base(spark, d, "urls").select("page_id", projections.image_source(key).alias("id"))


@query("SELECT image_id, seq, x0, y0 - 2 AS y0, x1 + 1 AS x1, y1, round(confidence, 3) AS confidence FROM b_boxes WHERE kind <> 'N'", "boxes")
def recognised_boxes(spark, d):
    corners = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((F.col("x0") + 0.2, F.col("y0")), (F.col("x1") + 0.9, F.col("y0") - 2), (F.col("x1"), F.col("y1")), (F.col("x0"), F.col("y1") - 1))))
    made = projections.recognised(corners, F.when(F.col("kind") != "N", F.col("kind")).otherwise(" \n"), F.col("confidence"))
    return base(spark, d, "boxes").select("image_id", "seq", made.alias("r")).where("r IS NOT NULL").select("image_id", "seq", "r.x0", "r.y0", "r.x1", "r.y1", "r.confidence")


_SCENES = ("photo", "screenshot", "diagram", "chart", "logo")
_LOGITS = [f"(p_partkey * {7 + 12 * k} % 97) / 1000.0" for k in range(5)]


@query(
    "SELECT p_partkey, CAST(count(*) FILTER (rank <= 3 AND p > 0.01) AS INT) AS n, max(label) FILTER (rank = 1) AS label, max(round(p, 3)) FILTER (rank = 1) AS confidence FROM (SELECT p_partkey, label, p, row_number() OVER (PARTITION BY p_partkey ORDER BY p DESC, k) AS rank FROM (SELECT p_partkey, k, label, exp(100 * s) / sum(exp(100 * s)) OVER (PARTITION BY p_partkey) AS p FROM ("
    + " UNION ALL ".join(f"SELECT p_partkey, {k} AS k, '{label}' AS label, {s} AS s FROM part" for k, (label, s) in enumerate(zip(_SCENES, _LOGITS, strict=True)))
    + "))) GROUP BY 1"
)
def likeliest_labels(spark, d):
    top = projections.likeliest_labels(F.array(*(F.expr(s).cast("double") for s in _LOGITS)), list(_SCENES))
    return base(spark, d, "names").select("p_partkey", top.alias("t")).select("p_partkey", F.size("t").alias("n"), F.col("t")[0]["label"].alias("label"), F.col("t")[0]["confidence"].alias("confidence"))


@query("SELECT o_orderkey, v AND w AS can_complete, CASE WHEN v AND w THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN v AND w THEN 'complete' WHEN v THEN 'repair-web-representation' WHEN w THEN 'repair-visual' ELSE 'repair-visual-and-web' END AS required_action, CASE WHEN v THEN '' ELSE 'visual-threshold-failed|' END || CASE WHEN w THEN '' ELSE 'missing-control|' END AS reasons FROM (SELECT o_orderkey, o_totalprice > 120000 AS v, o_orderstatus <> 'F' AS w FROM orders)")
def review_outcomes(spark, d):
    web = F.col("o_orderstatus") != "F"
    made = projections.review_outcome(F.col("o_totalprice") > 120000, web, F.when(web, F.array().cast("array<string>")).otherwise(F.array(F.lit("missing-control"))))
    rows = base(spark, d, "orders").select("o_orderkey", made.alias("r"))
    return rows.select("o_orderkey", "r.can_complete", "r.verdict", "r.required_action", F.array_join(F.transform("r.reasons", lambda x: F.concat(x, F.lit("|"))), "").alias("reasons"))


@query("SELECT p_size, CAST(rank AS INT) AS rank, text, count, ids FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY count DESC, first, text) AS rank FROM (SELECT p_size, lower(p_type) AS text, count(*) AS count, min(p_partkey) AS first, array_to_string(list_sort(list(p_partkey))[1:12], ',') AS ids FROM part GROUP BY 1, 2 HAVING count(*) > 1)) WHERE rank <= 4")
def repeated_texts(spark, d):
    found = projections.repeated_texts(base(spark, d, "names"), "p_size", "p_partkey", F.lower("p_type"))
    return found.withColumn("ids", F.array_join("ids", ","))


@query("SELECT o_orderkey, CAST(n AS INT) AS count, CASE WHEN n BETWEEN 1 AND 4 THEN NULL ELSE 'invalid_parallel' END AS error, CAST(CASE WHEN n BETWEEN 1 AND 4 THEN j END AS INT) AS job_seq, CASE WHEN n BETWEEN 1 AND 4 THEN o_orderpriority || j END AS job FROM (SELECT o_orderkey, o_orderpriority, n, unnest(CASE WHEN n BETWEEN 1 AND 4 THEN range(1, n + 1) ELSE [0] END) AS j FROM (SELECT *, o_custkey % 6 AS n FROM orders))")
def parallel_jobs(spark, d):
    n = F.col("o_custkey") % 6
    jobs = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda k: F.concat("o_orderpriority", k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return fanout.parallel(base(spark, d, "orders").withColumn("jobs", jobs), "o_orderkey", "jobs")


_ROLES = ("researcher", "critic", "reviewer", "coder", "explorer")


@query(
    "WITH p(role, k, perspective) AS (VALUES " + ", ".join(f"('{r}', {k}, '{p}')" for r in _ROLES for k, p in enumerate(fanout.PERSPECTIVES.get(r, fanout.OTHER_ROLES), 1)) + f"), r AS (SELECT o_orderkey, o_custkey, o_orderpriority, {_pick_sql(_ROLES, 'o_orderkey')} AS role FROM orders),"
    " j AS (SELECT o_orderkey, o_orderpriority, CAST(k AS INT) AS job_seq, perspective FROM r JOIN p USING (role) WHERE o_custkey % 3 <> 0 AND k <= CASE o_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END UNION ALL SELECT o_orderkey, o_orderpriority, k, CASE k WHEN 1 THEN 'mine' ELSE o_orderpriority END FROM r, (VALUES (1), (2)) t(k) WHERE o_custkey % 3 = 0)"
    " SELECT o_orderkey, job_seq, perspective, o_orderpriority || chr(10) || chr(10) || 'Perspective: ' || perspective AS objective FROM j"
)
def opinion_jobs(spark, d):
    named = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("mine"), F.col("o_orderpriority"))).otherwise(F.array().cast("array<string>"))
    count = F.when(F.col("o_custkey") % 4 != 0, F.lit(1) * (F.col("o_custkey") % 4 - 1))
    rows = base(spark, d, "orders").withColumns({"role": _pick(_ROLES, "o_orderkey"), "named": named, "wanted": count.cast("int")})
    return fanout.opinions(rows, "o_orderkey", role="role", objective="o_orderpriority", named="named", count="wanted")


@query("SELECT o_orderkey, sha256('Critically verify the following candidate.' || chr(10) || 'Criteria: ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '; ' || o_orderpriority ELSE '' END || chr(10) || chr(10) || 'CANDIDATE:' || chr(10) || o_custkey) AS digest FROM orders")
def verification_jobs(spark, d):
    criteria = F.array_compact(F.array(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))))
    return base(spark, d, "orders").select("o_orderkey", F.sha2(fanout.verification(criteria, F.col("o_custkey").cast("string")), 256).alias("digest"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id % 10 = 0 WHEN 1 THEN true WHEN 2 THEN false ELSE page_id % 7 <> 0 END AS allowed FROM pages")
def scoped_paths(spark, d):
    p = F.col("page_id")
    path = F.when(p % 4 == 0, F.concat(F.lit("/w/src/x"), p % 10, F.lit(".py"))).when(p % 4 == 1, F.concat(F.lit("/w/docs/a/"), p)).when(p % 4 == 2, F.concat(F.lit("/w/docsb/"), p)).otherwise(F.concat(F.lit("/lib/"), F.when(p % 7 == 0, F.lit("a/b/")).otherwise(""), p, F.lit(".rs")))
    return base(spark, d, "urls").select("page_id", fanout.scope_allows(path, "/w", ["web", "src/x0.p?", "docs", "/lib/*.rs"]).alias("allowed"))


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20') - epoch(ts) <= 864000")
def unexpired_entries(spark, d):
    return fanout.unexpired(base(spark, d, "events"), F.to_timestamp(F.lit("2024-01-20")), 864_000).select("event_id")


_CUT = "substr(text, 1, CAST(3 + (conv_id * 7 + turn * 3) % 25 AS INT))"


@query(f"SELECT conv_id, turn, len(p) < 2 OR NOT ((length(p[-1]) = 1 AND regexp_matches(p[-1], '^\\p{{Ll}}$') AND p[-1] NOT IN ('a', 'i')) OR (length(p[1]) = 1 AND regexp_matches(p[1], '^\\p{{L}}$') AND lower(p[1]) NOT IN ('a', 'i') AND length(p[2]) >= 3)) AS plausible FROM (SELECT conv_id, turn, string_split(regexp_replace(trim({_CUT}, e' \\t\\n\\r'), '\\s+', ' ', 'g'), ' ') AS p FROM conversations)")
def spacing_plausible(spark, d):
    cut = F.expr("substring(text, 1, cast(3 + (conv_id * 7 + turn * 3) % 25 as int))")
    return base(spark, d, "texts").select("conv_id", "turn", text.spacing_is_plausible(cut).alias("plausible"))


@query("SELECT a.image_id, a.seq, b.seq AS part, b.kind AS part_kind FROM b_boxes a JOIN b_boxes b ON a.image_id = b.image_id AND a.seq <> b.seq WHERE a.kind = 'R' AND b.kind <> 'R' AND b.x0 >= a.x0 - 4 AND b.y0 >= a.y0 - 4 AND b.x1 <= a.x1 + 4 AND b.y1 <= a.y1 + 4", "boxes")
def button_parts(spark, d):
    b = base(spark, d, "boxes")
    return spatial.inside_parts(b.where("kind = 'R'").drop("kind"), b.where("kind <> 'R'"))


_LOW = 130  # a canvas that some boxes reach the foot of
_ROLE_SQL = f"CASE WHEN kind = 'N' AND seq % 5 = 0 THEN 'graphic' WHEN y1 - y0 < {_LOW} * 0.18 AND y0 < {_LOW} * 0.15 AND seq % 4 >= 2 THEN 'nav' WHEN seq % 3 >= 2 THEN 'cta' WHEN y1 - y0 < {_LOW} * 0.14 AND x1 - x0 < {WIDTH} * 0.55 AND seq % 4 > 0 THEN 'badge' WHEN y0 < {_LOW} * 0.2 AND y1 - y0 < {_LOW} * 0.3 THEN 'header' WHEN y0 > {_LOW} * 0.85 THEN 'footer' WHEN confidence * 100 >= 70 THEN 'hero' ELSE 'content' END"


@query(f"SELECT image_id, seq, {_ROLE_SQL} AS role FROM b_boxes", "boxes")
def section_roles(spark, d):
    kind = F.when((F.col("kind") == "N") & (F.col("seq") % 5 == 0), "texture").otherwise("section")
    role = spatial.section_role(kind, geometry.box(*geometry.SIDES), F.col("seq") % 4, F.col("seq") % 3, F.col("confidence") * 100, F.lit(87.5), WIDTH, _LOW)
    return base(spark, d, "boxes").select("image_id", "seq", role.alias("role"))


_APART = "((by0 + by1) - (ay0 + ay1)) / 2.0"
_SHARE = "greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) / CAST(greatest(least(ax1 - ax0, bx1 - bx0), 1) AS DOUBLE)"


@query(f"SELECT image_id, sa, sb, {_SHARE} >= 0.55 AND {_APART} < 0 AND abs({_APART}) <= 1.45 * greatest(ay1 - ay0, by1 - by0, 1) AS above, {_SHARE} >= 0.55 AND {_APART} > 0 AND abs({_APART}) <= 1.45 * greatest(ay1 - ay0, by1 - by0, 1) AS below FROM b_pairs", "pairs")
def adjacent_lines(spark, d):
    a, b = (geometry.box(*(f"{k}{s}" for s in geometry.SIDES)) for k in "ab")
    return base(spark, d, "pairs").select("image_id", "sa", "sb", *(spatial.adjacent_lines(a, b, above).alias(name) for name, above in (("above", True), ("below", False))))


_WORD = "split_part(trim(first_text), ' ', 2)"


@query(
    f"WITH q AS (SELECT conv_id, lower({_WORD}) AS needle FROM (SELECT conv_id, min_by(text, turn) AS first_text FROM conversations GROUP BY 1)), h AS (SELECT conv_id, turn, length(text) % 50 / 50.0 AS confidence FROM conversations JOIN q USING (conv_id) WHERE needle <> '' AND (contains(lower(text), needle) OR contains(needle, lower(text))))"
    " SELECT conv_id, arg_max(turn, (confidence, -turn)) AS best, max(confidence) AS confidence, count(h.turn) AS n, array_to_string(list_sort(list(turn) FILTER (turn IS NOT NULL))[1:5], ',') AS matches FROM q LEFT JOIN h USING (conv_id) GROUP BY 1"
)
def located_texts(spark, d):
    t = base(spark, d, "texts").withColumn("confidence", F.length("text") % 50 / F.lit(50.0))
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text")).select("conv_id", F.expr(_WORD).alias("query"))
    found = spatial.located(t, first, "conv_id", key="turn")
    return found.withColumn("matches", F.array_join("matches", ","))


@query("SELECT image_id, coalesce(median(CASE WHEN seq % 2 = 0 AND image_id % 2 = 0 THEN CAST(confidence * 10 AS DOUBLE) END), median(CAST(x1 - x0 AS DOUBLE) / length(repeat(kind, seq)))) AS cell_width FROM b_boxes GROUP BY 1", "boxes")
def cell_widths(spark, d):
    rows = base(spark, d, "boxes").withColumns({"text": F.expr("repeat(kind, seq)"), "glyph": F.when((F.col("seq") % 2 == 0) & (F.col("image_id") % 2 == 0), F.col("confidence") * 10)})
    return spatial.cell_width(rows, "image_id", text="text", glyph_width="glyph")


_IN = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@query(
    f"SELECT image_id, seq, CAST(rank AS INT) AS rank, x0 AS x, y0 AS y, least(x1, {WIDTH}) - x0 AS width, least(y1, {HEIGHT}) - y0 AS height FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY 1 - confidence DESC, (x1 - x0) * (y1 - y0) DESC, seq) AS rank FROM b_boxes a WHERE kind <> 'R' AND status = 'O' AND NOT EXISTS (SELECT 1 FROM b_boxes b WHERE b.kind = 'R' AND a.image_id = b.image_id AND {_IN} >= 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0))) WHERE rank <= 2",
    "boxes",
)
def unresolved_focus(spark, d):
    b = base(spark, d, "boxes")
    open_ = b.where("kind <> 'R'").withColumn("resolution", F.when(F.col("status") == "O", "unresolved").otherwise("verified"))
    return spatial.unresolved_focus(open_, b.where("kind = 'R'"), 2, WIDTH, HEIGHT)


#: Each word of a phrase with a mark after it, so that SQL without look-ahead can tell whole words.
_MARKED = "|".join(re.sub(r"\w+", lambda m: m[0] + "\x01", re.escape(p).replace(r"\ ", " ")).replace("'", "''") for p in sorted(text.SILENCE_PHRASES, key=len, reverse=True))
_LEADS = ("Thank you for watching. [Music] \n ... ", "Something else. ", "Young people sing. So. ", "Music theory is hard. Social life. you ", "So you. subscribe! ")


@query(
    f"SELECT conv_id, turn, concat(regexp_extract(t, '^(\\P{{L}}*)', 1), upper(regexp_extract(t, '^\\P{{L}}*(\\p{{L}})', 1)), regexp_extract(t, '^\\P{{L}}*\\p{{L}}(.*)$', 1)) AS out FROM (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(replace(regexp_replace(m, '(?i)(^|[.!?])(?:\\s*(?:{_MARKED})[.,!?]?)+', '\\1', 'g'), chr(1), ''), '\\s+', ' ', 'g')), '^[\\s{text.LEADING_MARKS}]+', '') AS t"
    f" FROM (SELECT conv_id, turn, regexp_replace(trim(regexp_replace({_pick_sql(_LEADS, 'conv_id + turn')} || text, '\\s+', ' ', 'g')), '([\\p{{L}}\\p{{N}}_]+)', '\\1' || chr(1), 'g') AS m FROM conversations))"
)
def clean_transcript(spark, d):
    return base(spark, d, "texts").select("conv_id", "turn", text.clean_transcript(F.concat(_pick(_LEADS, "conv_id + turn"), "text")).alias("out"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
