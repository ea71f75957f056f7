"""Steps over many groups side by side against plain loops, and plans without joins of boxes."""

from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__
from evidentia.operators import greedy, screens, spatial
from tests.conftest import rows

BOXES = "image_id long, seq int, x0 int, y0 int, x1 int, y1 int"
SMALLEST = "/root/testdata/sf0.001"


def _boxes(seed: int) -> list[tuple]:
    """Groups of 0 to 7 boxes, one of 300, and one without a name."""
    rng, out = random.Random(seed), []
    for image, n in [*((k, rng.randint(0, 7)) for k in range(60)), (900, 300), (None, 5)]:
        for seq in range(n):
            x, y = rng.randint(0, 90), rng.randint(0, 60)
            out.append((image, seq, x, y, x + rng.randint(1, 40), y + rng.randint(1, 25)))
    return out


def _groups(boxes: list[tuple]) -> dict:
    out: dict = {}
    for image, *rest in boxes:
        out.setdefault(image, []).append(rest)
    return out


@pytest.mark.parametrize("name", ["glyph_icons", "added_lines", "fused_readings", "layout_gaps"])
def test_boxes_reach_ordered_steps_without_joins(spark, name):
    plan = __spark_entry__.queries()[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_icons_and_lines_by_plain_loops(spark):
    own, others, more = (_boxes(seed) for seed in (1, 2, 3))
    icons, lines = set(), set()
    for image, boxes in _groups(own).items():
        kept_icons, kept_lines, n_icons, n_lines = list(_groups(others).get(image, [])), [], 0, 0
        for seq, *box in boxes:
            def share(b, box=box):
                w, h = min(box[2], b[-2]) - max(box[0], b[-4]), min(box[3], b[-1]) - max(box[1], b[-3])
                return max(w, 0) * max(h, 0) / ((box[2] - box[0]) * (box[3] - box[1]))

            def along(x0, x1, y, box=box):
                return max(0, min(box[2], x1) - max(box[0], x0)) / (box[2] - box[0]) if abs(box[1] - y) <= 3 else 0

            if all(share(b) < 0.35 for b in kept_icons):
                kept_icons.append((seq, *box))
                n_icons += 1
                icons.add((image, seq, n_icons))
            border = any(along(b[1], b[3], b[k]) >= 0.65 for b in _groups(others).get(image, []) for k in (2, 4))
            again = any(along(b[1], b[3], b[2]) >= 0.75 for b in [*_groups(more).get(image, []), *kept_lines])
            if not border and not again:
                kept_lines.append((seq, *box))
                n_lines += 1
                lines.add((image, seq, n_lines))
    a, b, c = (spark.createDataFrame(x, BOXES) for x in (own, others, more))
    assert {tuple(r) for r in screens.glyph_icons(a, b).collect()} == icons
    assert {tuple(r) for r in screens.added_lines(a, c, b).collect()} == lines
    assert screens.glyph_icons(a.limit(0), b).count() == 0


def test_bands_by_plain_loops(spark):
    want = set()
    for image, boxes in _groups(_boxes(4)).items():
        bands: list[list[int]] = []
        for seq, x0, y0, x1, y1 in sorted(boxes, key=lambda b: (b[2], b[1], b[0])):
            k = next((k for k, (t, b) in enumerate(bands) if min(y1, b) - max(y0, t) >= 0.6 * min(y1 - y0, b - t)), len(bands))
            if k == len(bands):
                bands.append([y0, y1])
            bands[k] = [min(bands[k][0], y0), max(bands[k][1], y1)]
            want.add((image, seq, k + 1))
    df = spark.createDataFrame(_boxes(4), BOXES)
    assert {tuple(r) for r in greedy.first_fit(df, "image_id", ["y0", "x0"], greedy.same_row(0.6)).collect()} == want


def test_fused_readings_stay_with_their_boxes(spark):
    a, b = (spark.createDataFrame([(*x, f"t{x[2] % 3}" if x[2] % 5 else None, None if x[3] % 7 == 0 else x[3] / 60) for x in _boxes(seed) if x[0] is not None], f"{BOXES}, text string, confidence double") for seed in (5, 6))
    assert rows(greedy.match_and_fuse(a, b)) == rows(greedy.fuse_readings(greedy.match_one_to_one(a, b), a, b))


def test_scores_of_groups_side_by_side():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 6, (20, 4, 5)) / 5
    assert np.array_equal(greedy.assign(s, 0.3), np.stack([greedy.assign(x, 0.3) for x in s]))


def test_cells_of_a_picture_are_not_shuffled(spark):
    plan = __spark_entry__.queries()["attention_grid"](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == 1 and "hashpartitioning(image_id#" in plan and ", cx#" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]


def test_gaps_by_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_PAIRS", 50, raising=False)
    want = set()
    for image, boxes in _groups(_boxes(7)).items():
        for s, *a in boxes:
            for t, *b in boxes:
                if image is None or s >= t:
                    continue
                over, low = [min(a[k + 2], b[k + 2]) - max(a[k], b[k]) for k in (0, 1)], [min(a[k + 2] - a[k], b[k + 2] - b[k]) for k in (0, 1)]
                axis = "y" if over[0] >= 0.3 * low[0] else "x" if over[1] >= 0.3 * low[1] else None
                nested = any(all(p[k] >= q[k] + 4 and p[k + 2] <= q[k + 2] - 4 for k in (0, 1)) for p, q in ((a, b), (b, a)))
                if axis is None or nested or all(over[k] > 0.75 * low[k] for k in (0, 1)):
                    continue
                k = "xy".index(axis)
                first, second = (b, a) if b[k] < a[k] else (a, b)
                gap = second[k] - first[k + 2]
                if gap <= 20 and over[1 - k] > -21:
                    want.add((image, s, t, axis, max(gap, 0), over[1 - k], gap <= 4))
    got = spatial.layout_gaps(spark.createDataFrame(_boxes(7), BOXES), 20).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
