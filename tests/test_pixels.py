from __future__ import annotations

import numpy as np
import pytest

from evidentia.functions import network
from evidentia.operators import pixels


def picture():
    image = np.full((20, 30, 3), 250, np.uint8)
    image[3:8, 4:10] = (10, 20, 30)
    image[12:15, 20:29] = (0, 0, 255)
    image[13, 22] = 250
    return image


def test_kernels():
    image = picture()
    assert pixels.exact_mode(image) == (250, 250, 250)
    mask = pixels.content_mask(image, (250, 250, 250))
    assert pixels.components(mask) == [(4, 3, 10, 8), (20, 12, 29, 15)]
    assert pixels.components(np.zeros((3, 3), bool)) == []
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    assert pixels.components(ring) == [(0, 0, 5, 5)]
    assert pixels.layout_similarity(mask, mask) == 1.0 and pixels.layout_similarity(mask, ~mask) < 0.2
    own = pixels.palette(image)
    assert own[0][0] == (248, 248, 248) and sum(w for _, w in own) == pytest.approx(1) and pixels.palette_distance(own, own) == 0
    assert pixels.text_contrast(image, (4, 3, 14, 8)) > 0.8 and pixels.text_contrast(image, (5, 5, 5, 5)) == 0
    assert pixels.changed_boxes(image, np.full_like(image, 250), least=20) == [(4, 3, 10, 8), (20, 12, 29, 15)]
    raster = pixels.character_raster(image, 30, 20)
    assert len(raster) == 20 and raster[5][5] == "." and raster[0][0] == "@"
    assert pixels.resample(np.arange(10), 10, 5).tolist() == [0, 2, 4, 6, 8]


def test_components_equal_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.5
        left, want = {tuple(p) for p in np.argwhere(mask).tolist()}, []
        while left:
            todo, part = [left.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                near = {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & left
                left -= near
                todo += near
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
        assert sorted(pixels.components(mask)) == sorted(want)


def test_describe(spark):
    image = picture()
    df = spark.createDataFrame([("a", 20, 30, bytearray(image.tobytes())), ("b", None, None, None)], "path string, height int, width int, data binary")
    got = {r.path: r for r in pixels.describe(df).collect()}
    assert got["a"].background == "#FAFAFA" and [tuple(b) for b in got["a"].boxes] == [(4, 3, 10, 8), (20, 12, 29, 15)]
    assert got["b"].background is None and got["b"].boxes == []


def test_addresses():
    assert network.refusal("https://example.org/a") is None and network.refusal("https://8.8.8.8") is None
    refused = {"http://example.org": "scheme", "https://": "no_host", "https://a.localhost/x": "loopback", "https://10.1.2.3": "private", "https://[::1]/": "private", "https://240.0.0.1": "private", "https://[fe80::1]": "private", None: "scheme", "https://[bad": "invalid"}
    assert {u: network.refusal(u) for u in refused} == refused
