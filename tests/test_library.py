"""The library's own operators on small tables, and a sample of the registered queries against their SQL."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import wave

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from evidentia.functions import color, geometry, text, values
from evidentia.operators import compact, evidence, greedy, sequences, spatial
from evidentia.plans import registry, requests
from evidentia.sources import stores
from evidentia.streaming import jobs, reviews

DATA = "/root/testdata/sf0.001"
BOXES = "image_id long, seq int, x0 int, y0 int, x1 int, y1 int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    cases = [
        (text.reading_text(F.lit("Straße  x-1.")), "strasse x-1."), (text.latin_look(F.lit("Мост-1")), "moct1"), (text.axis_amount(F.lit("S8oo")), 800), (text.axis_amount(F.lit("Soo")), None), (text.axis_amount(F.lit("So")), 0),
        (text.css_hex(F.lit("rgba(1, 2, 3, 1.0)")), "#010203"), (text.css_hex(F.lit("rgba(1,2,3,0.5)")), None), (text.css_hex(F.lit("rgb(300,2,3)")), None), (text.css_hex(F.lit("#abc")), "#AABBCC"), (text.css_pixels(F.lit("12.5PX")), 12.5),
        (text.font_weight(F.lit("wght 650")), 400), (text.font_weight(F.lit(None).cast("string")), 400), (text.font_family(F.lit("'A B', serif")), "A B"), (text.sigil_correction(F.lit("s100"), F.lit("$100")), "$100"), (text.sigil_correction(F.lit("a100"), F.lit("$100")), None),
        (text.clean_transcript(F.lit("Thank you for watching. - hello\nyou there")), "Hello you there"), (text.clean_transcript(F.lit(None).cast("string")), ""), (text.capitalize_first(F.lit("12 éa")), "12 Éa"), (text.seam_word(F.lit("«Ja!»")), "ja"),
        (text.symbol_text(F.lit("\n\na  \r\nb \n")), "a\nb"), (text.path_component(F.lit("")), "session"), (text.video_id(F.lit("https://youtu.be/abcdefghijk?t=1")), "abcdefghijk"), (text.css_urls(F.lit("url('a'), url(b) url(a)")), ["a", "b"]),
        (text.intent_tokens(F.lit("A big BIG do.t")), ["big", "do.t"]), (text.looks_drawn(F.array(F.lit("/--\\"), F.lit("|_|"))), True), (text.mostly_ascii(F.lit("abcя")), True), (text.mostly_ascii(F.lit("..")), False),
    ]
    got = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(got) == [want for _, want in cases]


def test_geometry_and_colour(spark):
    a, b = (geometry.box(*map(F.lit, x)) for x in ((0, 0, 10, 10), (5, 0, 25, 10)))
    assert value(spark, geometry.iou(a, b)) == pytest.approx(50 / 250)
    assert value(spark, geometry.match_score(a, b)) == pytest.approx(0.41)
    assert value(spark, geometry.of_smaller(a, geometry.box(*map(F.lit, (10, 0, 20, 10))))) == 0
    assert tuple(value(spark, geometry.permille(geometry.box(*map(F.lit, (1, 3, 5, 7))), F.lit(16), F.lit(16)))) == (62, 188, 312, 438)
    assert value(spark, color.saturation(F.lit("#FF8000"))) == 1.0
    assert value(spark, color.contrast(F.lit("#FFFFFF"), F.lit("#000000"))) == pytest.approx(21)
    assert tuple(value(spark, color.bgr(F.lit("nope")))) == (0, 0, 0)
    assert value(spark, values.micro_usd(F.lit(-1.0))) == 0 and value(spark, values.usd(F.lit(0.12345))) == "$0.1235"
    assert tuple(value(spark, values.civil(F.lit(-1)))) == (1969, 12, 31)


def brute_common(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def test_spatial_joins_equal_nested_loops(spark):
    rng = np.random.default_rng(2)
    made = [(int(i), k, int(x), int(y), int(x + w), int(y + h)) for i in range(4) for k, (x, y, w, h) in enumerate(rng.integers(0, 300, (12, 4)) + [0, 0, 1, 1])]
    df = spark.createDataFrame(made, BOXES)
    got = spatial.overlapping(df, df, cell=50).select("image_id", "a_seq", "b_seq")
    assert rows(got) == sorted(((a[0], a[1], b[1]) for a in made for b in made if a[0] == b[0] and brute_common(a, b) > 0), key=repr)
    kept, dropped = (f(df, df.where("seq < 4"), 0.9) for f in (spatial.keep_covered, spatial.drop_covered))
    assert kept.count() + dropped.count() == len(made) and kept.where("seq < 4").count() == 16
    assert spatial.smallest_container(df.limit(0)).count() == 0


def test_greedy_steps(spark):
    left = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 1, 0, 11, 10), (2, 0, 0, 0, 5, 5)], BOXES)
    right = spark.createDataFrame([(1, 7, 1, 0, 11, 10), (3, 1, 0, 0, 1, 1)], BOXES)
    assert rows(greedy.match_one_to_one(left, right)) == sorted([(1, 0, 7, round(90 / 110, 6)), (1, 1, None, None), (2, 0, None, None), (3, None, 1, None)], key=repr)
    assert rows(greedy.suppress(left, "image_id", ["x0"], 0.65)) == [(1, 0, 1), (2, 0, 1)]
    assert rows(greedy.first_fit(left, "image_id", ["x0"], greedy.same_column(0.5))) == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    costs = left.withColumn("cost", F.when(F.col("seq") == 0, 5).otherwise(1))
    assert rows(greedy.within_budget(costs, "image_id", ["seq"], "cost", 4)) == [(1, 1, 1)]
    assert value(spark, greedy.dice(F.lit("aab"), F.lit("aa"))) == pytest.approx(2 / 3)


def test_fused_readings(spark):
    a = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "Abc", 0.8), (1, 1, 50, 0, 60, 10, "x", 0.5), (1, 2, 90, 0, 95, 5, "lone", 0.95)], BOXES + ", text string, confidence double")
    b = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "abc", 0.9), (1, 1, 50, 0, 60, 10, "y", 0.58), (1, 2, 200, 0, 210, 10, "new", 0.7)], BOXES + ", text string, confidence double")
    got = greedy.fuse_readings(greedy.match_one_to_one(a, b), a, b).select("text", "confidence", "verified", "method")
    assert rows(got) == sorted([("abc", 0.9, True, "consensus"), ("y", 0.58, False, "disagreement"), ("lone", 0.95, True, "single"), ("new", 0.7, False, "unmatched")], key=repr)


def test_claims_and_predicates(spark):
    claims = spark.createDataFrame([(1, 1, "verified", 0.5, ["a", "b"]), (1, 2, "verified", 0.5, ["a", "zz"]), (1, 3, "verified", None, []), (2, 1, "inferred", 2.0, ["a"])], "job_id long, claim_id long, claim_status string, confidence double, evidence array<string>")
    receipts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "job_id long, evidence_id string")
    got = {(r.job_id, r.claim_id): (r.claim_status, r.n_verified, len(r.errors)) for r in evidence.verify_claims(claims, receipts).collect()}
    assert got == {(1, 1): ("verified", 2, 0), (1, 2): ("inferred", 1, 1), (1, 3): ("inferred", 0, 2), (2, 1): ("inferred", 0, 1)}
    files = spark.createDataFrame([("p", "one\ntwo\r\n"), ("e", "")], "path string, content string")
    preds = [(1, "file_exists", "q", 1, "", None), (2, "line_contains", "p", 2, "tw", None), (3, "line_contains", "p", 3, "x", None), (4, "pattern_count", "p", 1, "", "o"), (5, "line_contains", "q", 1, "x", None), (6, "file_exists", "e", 1, "", None)]
    df = spark.createDataFrame(preds, "pred_id int, type string, path string, line int, value string, pattern string").withColumns({"min": F.lit(2), "max": F.lit(None).cast("int"), "sha256": F.lit("")})
    assert {r.pred_id: r.status for r in evidence.check_predicates(df, files).collect()} == {1: "refuted", 2: "verified", 3: "refuted", 4: "verified", 5: "unverifiable", 6: "verified"}
    assert evidence.glob_regex("a/**/b?.t*") == "^a/.*/b[^/]\\.t[^/]*$" and evidence.static_prefix("a/b/*.py") == "a/b"


def test_sequences(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 5, 50, 51)]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(at)], "k long, i long, ts timestamp_ntz")
    assert [r.n for r in sequences.gap_sessions(df, "k", "ts", 1800, "i").orderBy("island").collect()] == [2, 2]
    assert sequences.merge_parts(["Hello big World.", "big world is", None, "", "is fine"]) == "Hello big world is is fine"
    energies = np.array([1, 1, 0, 1, 1, 0, 1, 1, 1, 1], float)
    assert sequences.chunk_bounds(300, 1000, energies, 0.1, 0.03) == [(0, 90), (90, 180), (180, 280), (280, 300)]
    wave_ = [0.0] * 60 + [0.5] * 90 + [0.0] * 75
    got = spark.createDataFrame([(wave_,)], "s array<double>").select(sequences.speech_span(F.col("s"), F.lit(1000), 0.1, 0.05).alias("x")).first().x
    assert (got.first, got.last) == (60, 150)


def test_sparse_tables_round_trip(spark):
    rng, rows = random.Random(3), []
    for g in range(30):
        kind = rng.choice(["a", "b"])
        for k in range(rng.choice([1, 2, 12])):
            rows.append((g, k, None if g % 3 else k / 4, kind, rng.choice(["x"] * 9 + ['y"\\']), rng.choice([1, 2, None])))
    df = spark.createDataFrame(rows, "g long, seq int, p double, q string, r string, s int")
    tables = compact.sparse_table(df, "g", "seq", ["p", "q", "r", "s"]).collect()
    assert len(tables) == 30 and any(t.constant for t in tables) and any(t.default for t in tables) and any(len(t.columns) < 4 for t in tables)
    for t in tables:
        found = compact.decode({"count": t["count"], "columns": t.columns, "rows": t.rows, "constants": {k: json.loads(v) for k, v in t.constant.items()}, "defaults": {k: json.loads(v) for k, v in t.default.items()}})
        assert [tuple(row.get(c) for c in "pqrs") for row in found] == [r[2:] for r in rows if r[0] == t.g]


def test_transcripts_keep_words_that_begin_like_silence(spark):
    said = {
        "Something else.": "Something else.", "Young people sing.": "Young people sing.", "Music theory is hard. Social life.": "Theory is hard. Social life.", "Thank you for watching. [Music] hello": "Hello",
        "So. you Übung": "Übung", "soß. He said so.": "Soß. He said so.", None: "", "  ": "", "- ok": "Ok",
    }
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.out for r in df.select("t", text.clean_transcript(F.col("t")).alias("out")).collect()} == said


REVIEWS = "reference string, url string, seq long, similarity double, complete boolean, final boolean, checks int, failed int, worst double, total double"


def review_rows():
    return [("r", "u", 1, 0.5, False, False, 4, 2, 0.3, 0.5), ("r", "u", 2, 0.4, False, False, 4, 1, 0.3, 0.5), ("r", "u", 3, 0.9, False, False, 4, 3, 0.3, 0.5), ("r", "u", 4, 0.4, False, True, 4, 3, 0.3, 0.5), ("r", "u", 5, 0.4, False, False, 4, 1, 0.3, 0.5), ("r", "u", 6, 0.4, False, False, 4, 1, 0.3, 0.5), ("r", "u", 7, 0.9, True, False, 4, 0, 0.0, 0.0)]


def test_reviews_in_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(review_rows(), REVIEWS)
    batch = rows(reviews.fold_reviews(df))
    assert [r[3] for r in batch] == ["initial-champion", "new-champion", "regressed-rollback-required", "regressed-rollback-required", "unchanged", "unchanged", "new-champion"]
    assert [r[4] for r in batch] == [0, 0, 1, 1, 2, 3, 0] and batch[5][6] == "stop-and-return-champion"
    for k in range(2):  # two files, two batches: the champion lives on as state
        df.where(f"seq {'<=' if k == 0 else '>'} 3").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    q = reviews.stream_reviews(stream).writeStream.format("memory").queryName("reviews").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(spark.table("reviews").collect()) == 7


def test_jobs(spark):
    events = spark.createDataFrame([(1, 1, "created"), (1, 2, "started"), (1, 3, "cancelled"), (1, 4, "completed"), (2, 1, "created"), (2, 2, "noise")], "job_id long, seq long, kind string")
    assert rows(jobs.job_states(events)) == [(1, "cancelled", 4), (2, "queued", 1)]


def test_sources(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[16384, 0], [-16384, 0]], "<i2").tobytes())
    (tmp_path / "b.txt").write_text("x")
    assert {os.path.basename(r.path): r.reason for r in stores.media_files(spark, str(tmp_path)).collect()} == {"a.wav": None, "b.txt": "unsupported_type"}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {os.path.basename(r.path): r for r in stores.clips(files).collect()}
    assert got["a.wav"].samples == [0.25, -0.25] and got["a.wav"].rate == 8000 and got["b.txt"].error
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "r.jsonl").write_text('{"requestId": "1", "operation": "see", "input": {"a": 1}}\nnot json\n')
    assert sorted(r.request_id or "" for r in stores.request_lines(spark, str(tmp_path / "q")).collect()) == ["", "1"]
    pages = spark.createDataFrame([(1, "<p>Hi <b>there</b></p><script>no</script><button name='go'>Go</button><img src=x>"), (2, None)], "k int, html string")
    one = stores.captured(pages).where("k = 1").first()
    assert [t.text for t in one.texts] == ["Hi", "there", "Go"] and one.controls[0].name == "go" and one.rasters == ["x"]
    assets = spark.createDataFrame([(1, 1, 50), (1, 2, 10), (1, 3, 10)], "g long, k long, n long")
    assert rows(stores.fit_budget(assets, "g", "k", "n", 40, 15, 4)) == [(1, 2, 10)]
    df = spark.createDataFrame([("k", 1), ("k", 1)], "key string, v int")
    for _ in range(2):
        stores.write_once(df, str(tmp_path / "store"), "key")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1


SAMPLE = ["verified_claims", "machine_predicates", "best_overlap_lookup", "layout_gaps", "section_parents", "gap_sessions", "job_states", "compact_tables", "review_quality", "box_to_source", "contrast", "job_store_sweep", "compact_column_statistics", *requests.QUERIES]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)

    def plain(df):
        made = (tuple("" if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in r) for r in df[cols].itertuples(index=False))
        return sorted(made, key=repr)

    assert plain(got) == plain(want)


def test_registry_is_complete():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()


def test_text_similarity_compares_each_message_with_the_one_before(spark, tmp_path):
    said = [(1, 0, "u", "abcd"), (1, 1, "a", "abcd"), (1, 5, "u", "abxy"), (2, 3, "u", "night"), (2, 4, "a", "nacht"), (3, 1, "u", "alone"), (4, 0, "u", None), (4, 2, "a", "ab")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): (r.dice, r.sequence) for r in registry.queries()["text_similarity"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 1), (1, 5), (2, 4), (4, 2)}
    assert got[1, 1] == (1.0, 1.0) and got[1, 5] == (round(1 / 3, 6), 0.5) and got[2, 4][0] == 0.25 and got[4, 2][1] == 0.0
