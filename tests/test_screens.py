"""Operators on screens, comparisons, sessions and ordered steps: queries against their SQL, brute force and edges."""

from __future__ import annotations

import os
import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.functions import geometry
from evidentia.operators import comparison, greedy, screens, sessions
from evidentia.plans import registry
from evidentia.plans import screens as plans

DATA = "/root/testdata/sf0.001"
BOXES = "image_id long, seq int, x0 int, y0 int, x1 int, y1 int"
ORDERED = ["suppressed_boxes", "vertical_groups", "banded_sections", "running_mean_clusters", "budgeted_focus"]


@pytest.mark.parametrize("name", [*ORDERED, *plans.SQL])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(want)

    def plain(df):
        made = (tuple("" if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in r) for r in df[cols].itertuples(index=False))
        return sorted(made, key=repr)

    assert plain(got) == plain(want)


def test_groups_span_batches_and_null_groups_are_one(spark):
    rnd = random.Random(5)
    rows = [(g, k, x := rnd.randrange(200), 0, x + 10, 10) for g in (1, 2, None, 3) for k in range(57)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = greedy.suppress(spark.createDataFrame(rows, BOXES), "image_id", ["-x0"], 0.3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for g in (1, 2, None, 3):
        kept = []
        for _, k, x, *_ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if all(max(0, 10 - abs(x - y)) / 10 <= 0.3 for _, y in kept):
                kept.append((k, x))
        want |= {(g, k, n + 1) for n, (k, _) in enumerate(kept)}
    assert {tuple(r) for r in got} == want


def test_one_to_one_with_an_empty_side(spark):
    left, none = spark.createDataFrame([(1, 1, 0, 0, 5, 5)], BOXES), spark.createDataFrame([], BOXES)
    assert [tuple(r) for r in greedy.match_one_to_one(left, none).collect()] == [(1, 1, None, None)]
    assert [tuple(r) for r in greedy.match_one_to_one(none, left).collect()] == [(1, None, 1, None)]
    assert greedy.match_one_to_one(none, none).count() == 0


def test_text_agreement_and_regional_score(spark):
    pairs = [("abcd", "bcde"), ("one two three", "three two one"), ("", ""), (None, "x"), ("a", "a"), ("ab", "")]
    got = [r.s for r in spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").orderBy("k").select(comparison.text_agreement(F.col("a"), F.col("b")).alias("s")).collect()]
    for (a, b), s in zip(pairs, got, strict=True):
        a, b = a or "", b or ""
        p, q = [[t[k : k + 2] for k in range(len(t) - 1)] for t in (a, b)]
        ratio = SequenceMatcher(None, a, b).ratio()
        dice = 2 * sum(min(p.count(x), q.count(x)) for x in set(p)) / (len(p) + len(q)) if p or q else ratio
        assert s.score == pytest.approx(max(dice, ratio))
        assert s.method == ("empty-text-equality" if not a and not b else "visual-latin-character-bigram-dice" if dice > ratio else "visual-latin-sequence-similarity")
    a, b = (geometry.box(*map(F.lit, x)) for x in ((0, 0, 10, 10), (5, 0, 25, 10)))
    assert spark.range(1).select(comparison.regional_score(a, b, F.lit("abc"), F.lit("abd")).alias("v")).first().v == pytest.approx(0.6 * 50 / 250 + 0.2 * 0.5 + 0.2 * 2 / 3)


def test_refined_pitch_finds_a_planted_grid(spark):
    values = [3.25 + 13.6 * k for k in range(9)]
    fit = spark.range(1).select(screens.refined_pitch(F.array(*map(F.lit, values)), F.lit(14.0)).alias("f"), screens.refined_pitch(F.array(F.lit(1.0)), F.lit(14.0)).alias("none")).first()
    assert fit.none is None and fit.f.pitch == pytest.approx(13.6, abs=0.01) and fit.f.phase == pytest.approx(3.25, abs=0.1) and fit.f.error < 0.05


def test_verdicts_at_their_limits_and_with_missing_measures(spark):
    def verdict(**of):
        m = {"exact": True, "resampled": False, "similarity": 0.88, "pixels": 0.12, "foreground": 0.18, "foreground_limit": 0.18, "text": 0.7, "layout": 0.8, "hot": 0.05, "hot_box": 0.08} | of
        types = {"exact": "boolean", "resampled": "boolean"}
        return spark.range(1).select(comparison.acceptance(F.struct(*(F.lit(v).cast(types.get(k, "double")).alias(k) for k, v in m.items()))).alias("v")).first().v

    assert verdict().verdict == "pass" and verdict(similarity=0.8799).verdict == "partial"
    assert verdict(exact=False).blocking == ["dimension_mismatch"] and verdict(exact=False).verdict == "fail"
    assert verdict(text=None).blocking == ["text_similarity_minimum"] and verdict(text=None).verdict == "fail"


def test_newest_rows_of_a_hot_group(spark):
    jobs = spark.range(3000).selectExpr("0 as store", "id as k", "timestamp_seconds(id % 1000) as last_active")
    got = sessions.live_sessions(jobs, "store", "k", F.timestamp_seconds(F.lit(1000)), 600).orderBy("rank").collect()
    assert [r.k for r in got] == [999, 1999, 2999, 998, 1998, 2998, 997]


def test_samples_and_texts_of_nothing(spark):
    none = F.array().cast("array<double>")
    r = spark.range(1).select(comparison.resampled(none, F.lit(8000), F.lit(16000)).alias("a"), comparison.resampled(F.array(F.lit(1.0)), F.lit(48000), F.lit(16000)).alias("b"), screens.workflow(F.lit(None), F.lit(None), F.lit(None)).alias("w")).first()
    assert r.a == [] and r.b == [] and r.w.state == "ready-to-implement"
