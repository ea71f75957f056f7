"""What the findings of round 3 changed."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from evidentia.operators import assignment, greedy


def _texts(seed: int, n: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    sizes = (0, 1, 4, 20, 70, 230)
    return [tuple("".join(r.choices(r.choice(("ab", "abcde", "etaoinshrdlu", "éж😀x")), k=r.randint(0, r.choice(sizes)))) for _ in "ab") for _ in range(n)]


def test_pairs_side_by_side_are_as_close_as_alone():
    pairs = [*_texts(3, 1500), ("", ""), ("", "a"), ("a" * 199, "a" * 199), ("ab" * 99, "ba" * 99), ("a" * 200, "a" * 200)]
    want = [SequenceMatcher(None, *p).ratio() for p in pairs]
    assert greedy.closenesses(pairs).tolist() == want
    assert all(got == w if w >= 0.6 else got < 0.6 for got, w in zip(greedy.closenesses(pairs, 0.6).tolist(), want, strict=True))


def test_partitions_of_many_phrases_compare_no_pair_alone(monkeypatch):
    """a comparison of its own for every span was what row_assignments cost."""
    asked = [(f"the quick brown fox {k} jumps over the lazy dog", ["the quick br0wn", "fox", f"{k} jumps over", "the lazy d0g"], k % 2 == 0) for k in range(40)]
    one_by_one = [assignment.partition(*a) for a in asked]
    monkeypatch.setattr(greedy, "closeness", None)
    assert assignment.partitions(asked) == one_by_one and all(one_by_one)
    assert [value for value, _ in one_by_one[3]] == ["the quick brown", "fox", "3 jumps over", "the lazy dog"]


def test_a_kernel_sends_its_rows_in_large_frames(spark):
    """a frame for each row was what the tiles of small pictures cost."""
    from types import SimpleNamespace

    import pandas as pd

    from evidentia.operators import rasters

    class Table:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="frames", addPyFile=lambda at: None))

        def mapInPandas(self, run, schema):
            return list(run(iter([pd.DataFrame({"k": range(5000)}), pd.DataFrame({"k": range(7)})])))

    frames = rasters._mapped(Table(), "k long, x binary", lambda row: iter([(row.k, b"x")]))
    assert [len(f) for f in frames] == [4096, 911] and [*pd.concat(frames)["k"]] == [*range(5000), *range(7)]
    large = rasters._mapped(Table(), "k long, x binary", lambda row: iter([(row.k, bytes(rasters._BYTES // 2))] if row.k < 3 else []))
    assert [len(f) for f in large] == [2, 2, 2]


def test_thresholds_of_one_tile_are_those_of_many(spark):
    import numpy as np

    from evidentia.operators import diffing

    scores = (np.random.default_rng(5).integers(0, 60_000, (5, 40, 48)) // np.array([1, 2, 3, 4, 9])[:, None, None]).astype(np.int32)

    def tiles(h, w):
        rows = [(k, y // h, x // w, y, x, h, w, 40, 48, bytearray(s[y : y + h, x : x + w].tobytes())) for k, s in enumerate(scores) for y in range(0, 40, h) for x in range(0, 48, w)]
        return spark.createDataFrame(rows, f"{diffing.PLACE}, score binary")

    got = [dict(diffing.thresholds(tiles(*size)).collect()) for size in ((40, 48), (20, 16))]
    want = {k: min(max(float(np.percentile(s, 90)), 15_000), 30_000) for k, s in enumerate(scores)}
    assert got[0] == got[1] and all(abs(got[0][k] - want[k]) < 1e-6 for k in want)


def test_pictures_cut_in_one_pass_are_cut_as_level_by_level(spark):
    """F3, F15, F16, F20: a level of its own shuffles for all pictures was what sections cost."""
    from evidentia.operators import sections

    r = random.Random(7)
    rows = []
    for k in range(60):
        for _ in range(r.choice((1, 3, 9, 30))):
            x, y = r.randint(-5, 300), r.randint(-5, 180)
            rows.append((k, x, y, x + r.randint(-2, 60), y + r.randint(-2, 40)))
    boxes = spark.createDataFrame([*rows, (None, 1, 1, 9, 9)], "image_id long, x0 int, y0 int, x1 int, y1 int")
    canvas = (0, 0, 320, 200)
    rects = sections.disjoint(boxes).cache()
    whole = rects.select("image_id").distinct().selectExpr("image_id", *(f"{v} as {c}" for c, v in zip(("x0", "y0", "x1", "y1"), canvas)))
    by_level = sections.cut_regions(rects, whole)
    want = sorted(by_level.collect()), sorted(sections.content_sections(by_level, rects).collect())
    assert len(want[0]) > 100
    for large in (0, 5, 4096):
        found = sections.region_tree(boxes, canvas, large=large)
        assert (sorted(found.drop("held").collect()), sorted(sections.content_sections(found).collect())) == want


def test_repeated_words_ships_the_sources_it_runs(spark, monkeypatch):
    """on workers that had not got the package from another query before, it failed."""
    from evidentia.operators import consensus

    shipped = []
    monkeypatch.setattr(consensus, "ship", shipped.append, raising=False)
    consensus.repeated_words(spark.createDataFrame([], "g long, seq long, value string, preferred string, status string"), "g")
    assert len(shipped) == 1
