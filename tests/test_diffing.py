"""Tiled comparison of rasters: equal for tiles of any size, and to plain kernels over whole pictures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import diffing, rasters

PAIR = "image_id long, height int, width int, data binary, other_height int, other_width int, other binary"


def pictures():
    rng = np.random.default_rng(7)
    a = np.full((70, 90, 3), 240, np.uint8)
    a[10:30, 10:50] = (200, 120, 40)
    a[40:60, 60:85] = rng.integers(0, 255, (20, 25, 3))
    b = a.copy()
    b[12:28, 15:40] = (30, 30, 220)
    b[44:53, 5:30] = (0, 0, 0)
    b[46:51, 10:25] = (240, 240, 240)  # a ring that holds a spot
    b[48:49, 17:18] = (0, 0, 0)
    c = rng.integers(0, 255, (33, 41, 3), dtype=np.uint8)
    d = c[:30, :40].copy()
    return [(1, a, b), (2, a, a), (3, c, d), (4, np.zeros((1, 5, 3), np.uint8), np.zeros((1, 5, 3), np.uint8)), (5, c, None)]


def table(spark):
    rows = [(k, *a.shape[:2], a.tobytes(), *(b.shape[:2] if b is not None else (None, None)), b.tobytes() if b is not None else None) for k, a, b in pictures()]
    return spark.createDataFrame([*rows, (6, None, None, None, 1, 1, b"abc"), (7, 0, 4, b"", 0, 4, b"")], PAIR)


def flood(mask, eight):
    """Labels by flood filling."""
    out, n = np.zeros(mask.shape, int), 0
    around = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if eight else [])
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            n, todo = n + 1, [(y, x)]
            out[y, x] = n
            while todo:
                y, x = todo.pop()
                for dy, dx in around:
                    p, q = y + dy, x + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                        out[p, q] = n
                        todo.append((p, q))
    return out, n


@pytest.mark.parametrize("eight", [False, True])
def test_labels_equal_flood_fill(eight):
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        for _ in range(15):
            mask = rng.random((rng.integers(1, 14), rng.integers(1, 17))) < share
            assert (rasters.label(mask, eight)[0] == flood(mask, eight)[0]).all()


def kept(weak, strong):
    labels, n = flood(weak, True)
    return np.isin(labels, np.unique(labels[strong & weak])) & weak


def plain(a, b):
    """The measures and regions of whole pictures, step by step, without tiles."""
    b = rasters.on_canvas(a, b if b is not None else np.zeros((0, 0, 3), np.uint8))
    h, w = a.shape[:2]
    m = rasters._margined
    raw = (np.abs(a.astype(int) - b) > 8).any(2).mean()
    soft = [np.floor(diffing.blur(m(x, 2).astype(float), diffing._FIVE) + 0.5) for x in (a, b)]
    fronts, edges = [], []
    for x in (a, b):
        g = diffing.gradients(diffing.gray(m(x, 2))[..., None])
        detail = np.abs(x - diffing.blur(m(x, 4).astype(float), diffing._NINE)).max(2) > 8
        fronts.append(detail | kept(g > 40, g > 120))
        e = diffing.gradients(m(x, 2))
        edges.append(kept(e > 60, e > 160))
    by = max(1, min(6, round(min(h, w) / 256)))
    grown = [diffing._grown(np.pad(f, by), by) for f in fronts]
    either = fronts[0] | fronts[1]
    unmatched = fronts[0] & ~grown[1] | fronts[1] & ~grown[0]
    score = diffing.scores(a, b)
    limit = min(max(15.0, np.percentile(score / 1000, 90)), 30.0)
    mask = score / 1000 > limit
    closed = 1 - diffing._grown(1 - np.pad(diffing._grown(np.pad(mask.astype(np.uint8), 4), 4), 4, constant_values=1), 4)
    ground, _ = flood(closed == 0, False)
    rim = np.zeros((h, w), bool)
    rim[[0, -1]] = rim[:, [0, -1]] = True
    labels, n = flood(~np.isin(ground, np.unique(ground[rim & (ground > 0)])) if ground.any() else np.ones((h, w), bool), True)
    regions = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        box, signal = (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1), int((mask & (labels == k)).sum())
        if signal and box[2] - box[0] >= 8 and box[3] - box[1] >= 8:
            regions.append((-signal, box[1], box[0], *map(int, box), round(float(score[mask & (labels == k)].mean()) / 1000, 2)))
    regions = [(r[3:7], -r[0], r[7]) for r in sorted(regions)[:6]] if mask.mean() > 0.001 else []
    front = unmatched.sum() / either.sum() if either.any() else 0.0
    blurred = (np.abs(soft[0] - soft[1]) > 16).any(2).mean()
    return [round(float(v), 4) for v in (raw, blurred, (edges[0] ^ edges[1]).mean(), front)], regions


@pytest.mark.parametrize("size", [256, 17])
def test_tiles_equal_whole_pictures(spark, size):
    measures, regions = diffing.compared(table(spark), size=size)
    got = {r["image_id"]: r for r in measures.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    found: dict = {}
    for r in regions.orderBy("image_id", "rank").collect():
        found.setdefault(r["image_id"], []).append(((r["x0"], r["y0"], r["x1"], r["y1"]), r["signal"], r["mean_delta"]))
    for k, a, b in pictures():
        want, boxes = plain(a, b)
        assert [got[k][n] for n in ("raw", "blurred", "edges", "foreground")] == pytest.approx(want, abs=1.1e-4), k
        assert [x[:2] for x in found.get(k, [])] == [x[:2] for x in boxes] and [x[2] for x in found.get(k, [])] == pytest.approx([x[2] for x in boxes], abs=0.011)
    assert got[2]["mismatch"] == got[2]["foreground"] == got[2]["edges"] == 0 and 2 not in found
    assert len(found[1]) == 2 and found[1][1][0] == (5, 44, 30, 53) and got[1]["exact"] and not got[3]["exact"] and not got[5]["exact"]
    assert diffing.compared(table(spark).where(F.lit(False)))[0].count() == 0
