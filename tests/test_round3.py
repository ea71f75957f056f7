"""Cases of the third round's findings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from conftest import rows

from evidentia.operators import greedy, rules, sequences
from evidentia.streaming import reviews


def test_parts_that_do_not_overlap_are_told_whole(spark):
    said = [(1, 0, "so it goes on"), (1, 1, "goes on and\n on x"), (2, 0, None), (2, 1, "a"), (3, 0, None), (4, 0, " ")]
    df = spark.createDataFrame(said, "id long, turn int, text string")
    got = rows(sequences.merge_transcripts(df, "id", "turn", "text", overlapping=False))
    assert got == [(1, "so it goes on goes on and on x"), (2, "a"), (3, None), (4, "")]
    assert rows(sequences.merge_transcripts(df.where("id = 1"), "id", "turn", "text"))[0][1].startswith("so it goes on and on")


def test_equal_coordinates_are_never_parted(spark):
    df = spark.createDataFrame([(1, 5), (1, 40), (1, 40), (1, 40), (1, 41), (2, 7), (2, 7)], "image_id long, x0 int")
    for n in (1, 3):
        got = rows(sequences.coordinate_groups(df.repartition(n), "image_id", "x0", 12))
        assert got == [(1, 1, 1, 5), (1, 2, 4, 40), (2, 1, 2, 7)]


def test_steps_get_arrays_of_their_group(spark):
    def step(got):
        assert isinstance(got["x0"], np.ndarray) and got.floats(["x0", "seq"]).shape == (len(got), 2)
        return [(int(got["x0"].sum()), len(got))]

    df = spark.createDataFrame([(k % 3 if k % 3 else None, k, k * 2) for k in range(12)], "image_id long, seq int, x0 int")
    got = rows(greedy.each_group(df, "image_id", ["x0"], [], ["total", "n"], "total long, n long", step))
    assert got == [(1, 44, 4), (2, 52, 4), (None, 36, 4)]


def test_pixels_are_not_broadcast(spark):
    ink = spark.createDataFrame([(1, x, 9, 0, 0, 0) for x in range(9)], "image_id long, x int, y int, b int, g int, r int")
    found = spark.createDataFrame([(1, 9, 0, 8, 1)], "image_id long, y int, x0 int, x1 int, rule int")
    made = rules.drawn_columns(ink, found, 255.0, 20)
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().toString()
    assert rows(made) == [(1, 1, x, 0, 0, 0) for x in range(9)]


def test_reviews_are_folded_over_batches(spark):
    said = [(key, url, seq, 0.1 * (seq * 7 % 5), False, seq % 4 == 0, 3, seq % 3, 0.0, 0.0) for key in ("a", None) for url in ("x", "y") for seq in range(7)]
    df = spark.createDataFrame(said, "reference string, url string, seq long, similarity double, complete boolean, final boolean, checks int, failed int, worst double, total double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = reviews.fold_reviews(df)
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
        got = rows(made)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for key, part in pd.DataFrame(said, columns=df.columns).groupby(["reference", "url"], dropna=False):
        state = None
        for row in part.itertuples(index=False):
            state, out = reviews.step(state, row)
            want.append((None if pd.isna(key[0]) else key[0], key[1], row.seq, *out))
    assert got == sorted(want, key=repr)
