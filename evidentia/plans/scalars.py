"""Queries that apply scalar functions to evidence tables: (base, keys, {column: (function that makes the Spark column, SQL)})."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import color, geometry, text, values
from evidentia.plans.bases import HEIGHT, WIDTH, base, with_sql

_FOLD = "replace(lower(text), 'ß', 'ss')"
_WORDS = r"'[\p{L}\p{N}_.-]+'"
_IX = "greatest(least(ax1, bx1) - greatest(ax0, bx0), 0)"
_IY = "greatest(least(ay1, by1) - greatest(ay0, by0), 0)"
_I = f"({_IX} * {_IY})"
_AA, _AB = "((ax1 - ax0) * (ay1 - ay0))", "((bx1 - bx0) * (by1 - by0))"


def _a():
    return geometry.box("ax0", "ay0", "ax1", "ay1")


def _b():
    return geometry.box("bx0", "by0", "bx1", "by1")


def _box():
    return geometry.box("x0", "y0", "x1", "y1")


def _text():
    return F.col("text")


def _crop():
    """A crop of twice the canvas, at 100, 50 of a picture of 1280 x 800."""
    return geometry.crop_transform(F.lit(1280), F.lit(800), geometry.box(F.lit(100), F.lit(50), F.lit(740), F.lit(450)), F.lit(WIDTH), F.lit(HEIGHT))


def _r(c):
    return F.round(c, 6)


def _rgb(col):
    return [f"CAST(('0x' || substr({col}, {k}, 2)) AS INT)" for k in (2, 4, 6)]


_R, _G, _B = _rgb("hex")
_R2, _G2, _B2 = _rgb("other")
_LUM = [f"(0.2126 * ({r} / 255) + 0.7152 * ({g} / 255) + 0.0722 * ({b} / 255))" for r, g, b in ((_R, _G, _B), (_R2, _G2, _B2))]
_SPACE = r"'\s+', ' ', 'g'"


def _flat(prefix, box):
    return {f"{prefix}{k}": box[k] for k in geometry.SIDES}


def _sql_map(sx, ox, top_x, sy, oy, top_y):
    return {k: f"CAST(greatest(0, least({top_x if k[0] == 'x' else top_y}, round_even({k} * {sx if k[0] == 'x' else sy} + {ox if k[0] == 'x' else oy}, 0))) AS INT)" for k in geometry.SIDES}


def _both(spark_cols, sql_cols):
    return {k: ((lambda k=k: spark_cols()[k]), sql_cols[k]) for k in sql_cols}


SCALARS = {
    # geometry over pairs of boxes
    "box_iou": ("pairs", "image_id sa sb", {"iou": (lambda: _r(geometry.iou(_a(), _b())), f"round({_I} / greatest(1, {_AA} + {_AB} - {_I}), 6)")}),
    "box_match_score": ("pairs", "image_id sa sb", {"score": (lambda: F.round(geometry.match_score(_a(), _b()), 9), f"round(greatest({_I} / greatest(1, {_AA} + {_AB} - {_I}), CAST(0.82 AS DOUBLE) * CAST({_I} AS DOUBLE) / least(greatest(1, {_AA}), greatest(1, {_AB}))), 9)")}),
    "intersection_ratio": ("pairs", "image_id sa sb", {"ratio": (lambda: _r(geometry.of_smaller(_a(), _b())), f"round(CAST({_I} AS DOUBLE) / least({_AA}, {_AB}), 6)")}),
    "containment_ratio": ("pairs", "image_id sa sb", {"ratio": (lambda: _r(geometry.containment(_a(), _b())), f"round(CAST({_I} AS DOUBLE) / {_AA}, 6)")}),
    "coverage": ("pairs", "image_id sa sb", {"covered": (lambda: _r(geometry.coverage(_a(), _b())), f"round({_I} / greatest(1.0, CAST({_AA} AS DOUBLE)), 6)")}),
    "intersection_area": ("pairs", "image_id sa sb", {"common": (lambda: geometry.intersection(_a(), _b()), _I)}),
    "inside_with_pad": ("pairs", "image_id sa sb", {"inside": (lambda: geometry.inside(_a(), _b(), 2), "ax0 >= bx0 - 2 AND ay0 >= by0 - 2 AND ax1 <= bx1 + 2 AND ay1 <= by1 + 2")}),
    "center_inside": ("pairs", "image_id sa sb", {"inside": (lambda: geometry.center_inside(_a(), _b()), "(ax0 + ax1) / 2 BETWEEN bx0 AND bx1 AND (ay0 + ay1) / 2 BETWEEN by0 AND by1")}),
    "geometry_delta": ("pairs", "image_id sa sb", {k: (lambda k=k, s=s: geometry.delta(_a(), _b())[k], s) for k, s in (("x", "bx0 - ax0"), ("y", "by0 - ay0"), ("width", "(bx1 - bx0) - (ax1 - ax0)"), ("height", "(by1 - by0) - (ay1 - ay0)"))}),
    "source_box_match": ("pairs", "image_id sa sb", {"match": (lambda: _r(geometry.source_match(_a(), _b())), f"round(least(1.0, {_I} / least(greatest(1.0, CAST({_AA} AS DOUBLE)), greatest(1.0, CAST({_AB} AS DOUBLE)))), 6)")}),
    # coordinate transforms of single boxes
    "box_to_source": ("boxes", "image_id seq", _both(lambda: _flat("", geometry.to_source(_box(), _crop())), _sql_map(2.0, 100, 1280, 2.0, 50, 800))),
    "crop_coordinates": ("boxes", "image_id seq", {"scale_x": (lambda: _r(geometry.crop_transform(F.lit(1280), F.lit(800), _box(), F.lit(64), F.lit(64))["scale_x"]), "round((x1 - x0) / 64, 6)"), "offset_y": (lambda: geometry.crop_transform(F.lit(1280), F.lit(800), _box(), F.lit(64), F.lit(64))["offset_y"], "CAST(y0 AS DOUBLE)")}),
    "identity_coordinates": ("boxes", "image_id seq", _both(lambda: _flat("", geometry.to_source(_box(), geometry.identity_transform(F.lit(WIDTH), F.lit(HEIGHT)))), {k: f"least({WIDTH if k[0] == 'x' else HEIGHT}, {k})" for k in geometry.SIDES})),
    "normalize_box": ("boxes", "image_id seq", _both(lambda: _flat("", geometry.permille(_box(), F.lit(WIDTH), F.lit(HEIGHT))), {k: f"CAST(greatest(0, least(1000, round_even({k} * 1000 / {WIDTH if k[0] == 'x' else HEIGHT}, 0))) AS INT)" for k in geometry.SIDES})),
    "viewport_rescale": ("boxes", "image_id seq", _both(lambda: _flat("", geometry.rescale(_box(), F.lit(500), F.lit(333), F.lit(WIDTH), F.lit(HEIGHT))), {k: f"CAST(round_even({k} * {500 if k[0] == 'x' else 333} / {WIDTH if k[0] == 'x' else HEIGHT}, 0) AS INT)" for k in geometry.SIDES})),
    "point_in_source": ("boxes", "image_id seq", {k: (lambda k=k, c=c, o=o, m=m: geometry.point_to_source(F.col("x0"), F.col("y1"), _crop())[k], f"CAST(greatest(0, least({m}, round_even({c} * 2.0 + {o}, 0))) AS INT)") for k, c, o, m in (("x", "x0", 100, 1280), ("y", "y1", 50, 800))}),
    "padded_box": ("boxes", "image_id seq", _both(lambda: _flat("", geometry.padded(_box(), F.lit(WIDTH), F.lit(HEIGHT))), {
        "x0": "CAST(greatest(0, x0 - greatest(16, round_even((x1 - x0) * 0.5, 0))) AS INT)", "y0": "CAST(greatest(0, y0 - greatest(16, round_even((y1 - y0) * 2.0, 0))) AS INT)",
        "x1": f"CAST(least({WIDTH}, x1 + greatest(16, round_even((x1 - x0) * 0.5, 0))) AS INT)", "y1": f"CAST(least({HEIGHT}, y1 + greatest(16, round_even((y1 - y0) * 2.0, 0))) AS INT)"})),
    # colours
    "saturation": ("colors", "p_partkey", {"saturation": (lambda: _r(color.saturation(F.col("hex"))), f"round(CASE WHEN greatest({_R}, {_G}, {_B}) = 0 THEN 0.0 ELSE (greatest({_R}, {_G}, {_B}) - least({_R}, {_G}, {_B})) / greatest({_R}, {_G}, {_B}) END, 6)")}),
    "contrast": ("colors", "p_partkey", {"contrast": (lambda: _r(color.contrast(F.col("hex"), F.col("other"))), f"round((greatest({_LUM[0]}, {_LUM[1]}) + 0.05) / (least({_LUM[0]}, {_LUM[1]}) + 0.05), 6)")}),
    "luminance": ("colors", "p_partkey", {"luma": (lambda: _r(color.luma(F.col("hex"))), f"round(CAST(0.299 AS DOUBLE) * {_R} + CAST(0.587 AS DOUBLE) * {_G} + CAST(0.114 AS DOUBLE) * {_B}, 6)"), "light": (lambda: color.is_light(F.col("hex")), f"0.2126 * {_R} + 0.7152 * {_G} + 0.0722 * {_B} > 128")}),
    "hex_to_bgr": ("colors", "p_partkey", {k: (lambda k=k, s=s: color.bgr(F.col("hex"))[k], s) for k, s in (("b", _B), ("g", _G), ("r", _R))}),
    "color_distance": ("colors", "p_partkey", {"distance": (lambda: _r(color.distance(F.col("hex"), F.col("other"))), f"round((abs({_R} - {_R2}) + abs({_G} - {_G2}) + abs({_B} - {_B2})) / 3.0, 6)")}),
    "css_color": ("colors", "p_partkey", {"hex_out": (lambda: text.css_hex(F.concat(F.lit("rgb("), F.col("p_size"), F.lit(", 20 , 7)"))), "printf('#%02X%02X%02X', p_size, 20, 7)"), "same": (lambda: text.css_hex(F.lower(F.col("hex"))), "upper(hex)"), "none": (lambda: text.css_hex(F.concat(F.lit("rgba(1,2,3,0."), F.col("p_size") % 9, F.lit(")"))), "CAST(NULL AS VARCHAR)")}),
    # text
    "normalized_reading": ("texts", "conv_id turn", {"out": (lambda: text.reading_text(_text()), f"array_to_string(regexp_extract_all({_FOLD}, {_WORDS}), ' ')")}),
    "visible_text": ("texts", "conv_id turn", {"out": (lambda: text.visible_text(_text()), f"replace(lower(regexp_replace(trim(text), {_SPACE})), 'ß', 'ss')")}),
    "alphanumeric_text": ("texts", "conv_id turn", {"out": (lambda: text.letters_and_digits(_text()), rf"regexp_replace({_FOLD}, '[^\p{{L}}\p{{N}}]', '', 'g')")}),
    "visual_latin_text": ("texts", "conv_id turn", {"out": (lambda: text.latin_look(F.concat(_text(), F.lit("Вася"))), rf"translate(regexp_replace(replace(lower(text || 'Вася'), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g'), '{text.HOMOGLYPHS[0]}', '{text.HOMOGLYPHS[1]}')")}),
    "picture_text": ("texts", "conv_id turn", {"out": (lambda: text.picture_text(F.concat(F.lit("Сорт-7 "), _text())), f"array_to_string(regexp_extract_all(translate(replace(lower('Сорт-7 ' || text), 'ß', 'ss'), '{text.HOMOGLYPHS_WIDE[0]}', '{text.HOMOGLYPHS_WIDE[1]}'), {_WORDS}), ' ')")}),
    "symbol_text": ("texts", "conv_id turn", {"out": (lambda: text.symbol_text(F.concat(F.lit("\n\n  a  \r\n"), _text(), F.lit(" \t\n"))), r"regexp_replace(regexp_replace(regexp_replace(chr(10) || chr(10) || '  a  ' || chr(13) || chr(10) || text || ' ' || chr(9) || chr(10), '\r\n|\r', chr(10), 'g'), '^\n+|\n+$', '', 'g'), '(?m)[^\S\n]+$', '', 'g')")}),
    "intent_tokens": ("texts", "conv_id turn", {"n": (lambda: F.size(text.intent_tokens(_text())), f"CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), {_WORDS}), lambda x: length(x) > 2))) AS INT)"), "first": (lambda: text.intent_tokens(_text())[0], f"list_filter(regexp_extract_all(lower(text), {_WORDS}), lambda x: length(x) > 2)[1]")}),
    "letter_offsets": ("texts", "conv_id turn", {"n": (lambda: F.length(text.letter_offsets(_text())["text"]), rf"length(regexp_replace({_FOLD}, '[^\p{{L}}\p{{N}}]', '', 'g'))"), "last": (lambda: F.element_at(text.letter_offsets(_text())["offsets"], -1), r"CAST(length(text) - length(regexp_extract(text, '([^\p{L}\p{N}]*)$', 1)) - 1 AS INT)")}),
    "mostly_ascii": ("texts", "conv_id turn", {"out": (lambda: text.mostly_ascii(_text()), r"length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 0.75 * length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))")}),
    "capitalize_first": ("texts", "conv_id turn", {"out": (lambda: text.capitalize_first(F.concat(F.lit("- "), F.lower(_text()))), r"concat(regexp_extract('- ' || lower(text), '(?s)^(\P{L}*)', 1), upper(regexp_extract('- ' || lower(text), '(?s)^\P{L}*(\p{L})', 1)), regexp_extract('- ' || lower(text), '(?s)^\P{L}*\p{L}(.*)$', 1))")}),
    "single_line_text": ("texts", "conv_id turn", {"out": (lambda: text.single_line(_text()), r"regexp_replace(trim(regexp_replace(text, '[\n\r\\]+', ' ', 'g')), '\s+', ' ', 'g')")}),
    "seam_words": ("texts", "conv_id turn", {"out": (lambda: F.array_join(F.transform(F.split(text.collapse(_text()), " "), text.seam_word), "|"), r"array_to_string(list_transform(string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' '), lambda w: replace(lower(trim(w, '.,!?;:…""''()[]«»—-')), 'ß', 'ss')), '|')")}),
    "path_component": ("urls", "page_id", {"out": (lambda: text.path_component(F.col("url")), "regexp_replace(left(url, 80), '[^A-Za-z0-9_-]', '_', 'g')")}),
    "css_pixels": ("names", "p_partkey", {"px": (lambda: text.css_pixels(F.concat(F.col("p_size"), F.lit("PX"))), "CAST(p_size AS DOUBLE)"), "none": (lambda: text.css_pixels(F.concat(F.col("p_size"), F.lit("em"))), "CAST(NULL AS DOUBLE)")}),
    "font_weight": ("names", "p_partkey", {"named": (lambda: text.font_weight(F.element_at(F.split(F.lit("normal,bold,Light,semibold,x"), ","), (F.col("p_size") % 5 + 1).cast("int"))), "CASE p_size % 5 WHEN 0 THEN 400 WHEN 1 THEN 700 WHEN 2 THEN 300 WHEN 3 THEN 600 ELSE 400 END"), "number": (lambda: text.font_weight(F.concat(F.lit("wght "), (F.col("p_size") % 9 + 1) * 100)), "(p_size % 9 + 1) * 100")}),
    "font_family": ("names", "p_partkey", {"family": (lambda: text.font_family(F.concat(F.lit("'"), F.col("p_brand"), F.lit("', serif"))), "p_brand")}),
    "axis_amount": ("names", "p_partkey", {"amount": (lambda: text.axis_amount(F.concat(F.lit("S"), F.col("p_size"), F.lit("oo"))), "CAST(p_size AS BIGINT) * 100"), "none": (lambda: text.axis_amount(F.concat(F.lit("x"), F.col("p_size"))), "CAST(NULL AS BIGINT)")}),
    "sigil_correction": ("names", "p_partkey", {"out": (lambda: text.sigil_correction(F.concat(F.lit("S"), F.col("p_size"), F.lit("0")), F.concat(F.lit("$"), F.col("p_size"), F.lit("0"))), "'$' || p_size || '0'")}),
    "keeps_numeric_format": ("names", "p_partkey", {"sign": (lambda: text.keeps_numeric_format(F.concat(F.lit("$"), F.col("p_size")), F.lit(""), F.when(F.col("p_size") % 2 == 0, F.lit("$5")).otherwise("5")), "p_size % 2 = 0"), "frozen": (lambda: text.keeps_numeric_format(F.lit("7"), F.lit("layout-sequence-inferred"), F.col("p_size").cast("string")), "p_size = 7")}),
    "glyph_count_matches": ("names", "p_partkey", {"ok": (lambda: text.glyph_count_matches(F.col("p_size") + 20, F.lit(20), F.col("p_name")), r"p_size + 20 < 48 OR length(regexp_replace(p_name, '\s', '', 'g')) >= 15")}),
    "video_id": ("urls", "page_id", {"id": (lambda: text.video_id(F.concat(F.lit("https://x.test/watch?a=1&v="), F.substring(F.sha2(F.col("url"), 256), 1, 11), F.lit("&t=3"))), "left(sha256(url), 11)"), "none": (lambda: text.video_id(F.lit("https://x.test/w")), "CAST(NULL AS VARCHAR)")}),
    # values
    "micro_usd": ("orders", "o_orderkey", {"micro": (lambda: values.micro_usd(F.col("o_totalprice") / 1e6), "CAST(greatest(round(o_totalprice / 1e6 * 1000000), 0) AS BIGINT)")}),
    "format_usd": ("orders", "o_orderkey", {"usd": (lambda: values.usd(F.round(F.col("o_totalprice"), 2)), "printf('$%.4f', round(o_totalprice, 2))")}),
    "pessimistic_cost": ("orders", "o_orderkey", {"cost": (lambda: F.round(values.pessimistic_cost(F.col("o_orderkey") % 40, F.lit(8000), F.col("o_custkey") % 3000), 9), "round(o_orderkey % 40 * 8000 * 0.08 / 1e6 + o_custkey % 3000 * 0.252 / 1e6, 9)")}),
    "rfc3339": ("events", "event_id", {"at": (lambda: values.rfc3339(F.col("ts")), "strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%gZ')")}),
    "civil_from_days": ("orders", "o_orderkey", {k: (lambda k=k: values.civil(F.col("o_orderkey") % 60000 - 20000)[k], f"CAST({k}(DATE '1970-01-01' + CAST(o_orderkey % 60000 - 20000 AS INT)) AS INT)") for k in ("year", "month", "day")}),
    "sha256_hex": ("urls", "page_id", {"digest": (lambda: F.sha2(F.col("html"), 256), "sha256(html)")}),
    "cache_key": ("urls", "page_id", {"key": (lambda: values.cache_key("v1", F.col("html"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("r"), F.col("page_id")))), "concat_ws('-', 'v1', left(sha256(html), 32), CASE WHEN page_id % 2 = 0 THEN 'r' || page_id END)")}),
    "request_id": ("urls", "page_id", {"id": (lambda: values.request_id(F.col("url"), F.lit("{}")), "left(sha256(encode(url) || '\\x00'::BLOB || encode('{}')), 20)")}),
    "evidence_receipt": ("urls", "page_id", {"id": (lambda: values.receipt("web", F.col("page_id"), F.col("url"), F.col("html"), F.timestamp_seconds(F.lit(0)))["evidence_id"], "'ev-' || left(sha256(page_id || '|' || url || '|' || sha256(html)), 16)"), "snippet": (lambda: values.receipt("web", F.col("page_id"), F.col("url"), F.col("html"), F.timestamp_seconds(F.lit(0)))["snippet"], "left(html, 2000)")}),
}


def _query(name):
    table, keys, columns = SCALARS[name]

    def run(spark, sf_dir):
        return base(spark, sf_dir, table).select(*keys.split(), *(c().alias(k) for k, (c, _) in columns.items()))

    return run


def queries() -> dict:
    return {name: _query(name) for name in SCALARS}


def oracle_sql() -> dict[str, str]:
    return {name: with_sql(table, f"SELECT {', '.join(keys.split())}, {', '.join(f'{s} AS {k}' for k, (_, s) in columns.items())} FROM b_{table}") for name, (table, keys, columns) in SCALARS.items()}
