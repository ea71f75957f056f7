"""Pixel kernels in numpy over pictures (height x width x 3, blue-green-red bytes), and their use on picture tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.shipping import ship

#: Characters from dark to light.
RAMP = " .:-=+*#%@"


def luma(image: np.ndarray) -> np.ndarray:
    return image[..., 2] * 0.299 + image[..., 1] * 0.587 + image[..., 0] * 0.114


def exact_mode(pixels: np.ndarray) -> tuple[int, int, int]:
    """The most frequent colour, the least triple on ties."""
    packed = pixels.reshape(-1, 3).astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
    values, counts = np.unique(packed, return_counts=True)
    best = int(values[counts.argmax()])
    return best >> 16, best >> 8 & 255, best & 255


def palette(image: np.ndarray, step: int = 16, limit: int = 16) -> list[tuple[tuple[int, int, int], float]]:
    """The limit most frequent bins of step levels, as bin centres with their share of what is kept."""
    bins = image.reshape(-1, 3).astype(np.int64) // step
    values, counts = np.unique(bins @ np.array([1 << 16, 1 << 8, 1]), return_counts=True)
    order = np.lexsort((values, -counts))[:limit]
    total = counts[order].sum()
    return [(tuple(int(v >> s & 255) * step + step // 2 for s in (16, 8, 0)), float(c / total)) for v, c in zip(values[order].tolist(), counts[order], strict=True)]


def palette_distance(a: list, b: list) -> float:
    """Mean of both directions' weighted distances to the nearest colour of the other palette."""
    if not a or not b:
        return float("inf")
    d = np.linalg.norm(np.array([c for c, _ in a], float)[:, None] - np.array([c for c, _ in b], float)[None], axis=2)
    return float((d.min(1) @ np.array([w for _, w in a]) + d.min(0) @ np.array([w for _, w in b])) / 2)


def text_contrast(image: np.ndarray, box: tuple[int, int, int, int]) -> float:
    """The spread of the luma in a box between its 5th and 95th percentile, 0 to 1; 0 for an empty box."""
    part = luma(image[box[1] : box[3], box[0] : box[2]])
    return float(np.subtract(*np.percentile(part, (95, 5))) / 255) if part.size else 0.0


def content_mask(image: np.ndarray, background: tuple[int, int, int], threshold: int = 14) -> np.ndarray:
    """Where some channel differs from the background by more than the threshold."""
    return (np.abs(image.astype(np.int16) - np.array(background, np.int16)) > threshold).any(axis=2)


def components(mask: np.ndarray, least: int = 1) -> list[tuple[int, int, int, int]]:
    """Boxes of the 4-connected parts of at least least pixels, by top and left.

    Runs of a row are joined with those of the row above that they touch.
    """
    above: list[int] = []
    parts: list[list[int]] = []

    def top(k: int) -> int:
        while above[k] != k:
            k = above[k]
        return k

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for x0, x1 in edges.reshape(-1, 2).tolist():
            k = len(above)
            above.append(k)
            parts.append([x0, y, x1, y + 1, x1 - x0])
            for a0, a1, other in before:
                if a0 < x1 and x0 < a1 and (r := top(other)) != (q := top(k)):
                    lo, hi = min(r, q), max(r, q)
                    above[hi] = lo
                    p, o = parts[lo], parts[hi]
                    parts[lo] = [min(p[0], o[0]), min(p[1], o[1]), max(p[2], o[2]), max(p[3], o[3]), p[4] + o[4]]
            now.append((x0, x1, k))
        before = now
    found = [tuple(p[:4]) for k, p in enumerate(parts) if above[k] == k and p[4] >= least]
    return sorted(found, key=lambda b: (b[1], b[0]))


def changed_boxes(before: np.ndarray, after: np.ndarray, threshold: int = 25, least: int = 400) -> list[tuple[int, int, int, int]]:
    return components(np.abs(luma(before) - luma(after)) > threshold, least)


def layout_similarity(a: np.ndarray, b: np.ndarray, columns: int = 32) -> float:
    """1 less the difference of two masks' occupancy grids over their union; 1 for two empty ones."""

    def grid(m: np.ndarray) -> np.ndarray:
        rows = max(1, round(columns * m.shape[0] / m.shape[1]))
        ys, xs = (np.minimum(np.arange(n) * k // n, k - 1) for n, k in ((m.shape[0], rows), (m.shape[1], columns)))
        out = np.zeros((rows, columns))
        np.add.at(out, (ys[:, None].repeat(m.shape[1], 1), xs[None, :].repeat(m.shape[0], 0)), m)
        size = np.bincount(ys, minlength=rows)[:, None] * np.bincount(xs, minlength=columns)[None, :]
        return out / np.maximum(size, 1)

    x, y = grid(a), grid(b)
    union = np.maximum(x, y).sum()
    return float(1 - np.abs(x - y).sum() / union) if union else 1.0


def character_raster(image: np.ndarray, columns: int = 96, rows: int = 48) -> list[str]:
    """Luma as characters, sampled at cell centres."""
    ys, xs = (((np.arange(k) + 0.5) * n / k).astype(int) for k, n in ((rows, image.shape[0]), (columns, image.shape[1])))
    level = (luma(image)[np.ix_(ys, xs)] * (len(RAMP) - 1) / 255).round().astype(int)
    return ["".join(RAMP[v] for v in line) for line in level]


def resample(samples: np.ndarray, from_rate: int, to_rate: int) -> np.ndarray:
    """The sample at or before each step; the input itself at equal rates."""
    if from_rate == to_rate or not len(samples):
        return samples
    step = from_rate / to_rate
    at = (np.arange(int(len(samples) / step)) * step).astype(np.int64)
    return samples[np.minimum(at, len(samples) - 1)]


def describe(pictures: DataFrame, key: str = "path") -> DataFrame:
    """For each picture (height, width, data): key, background (the border's most frequent colour as #RRGGBB), and boxes of what differs from it."""
    ship(pictures.sparkSession)

    @F.pandas_udf("background string, boxes array<struct<x0: int, y0: int, x1: int, y1: int>>")
    def of(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for height, width, raw in zip(h, w, data, strict=True):
            if not height or not width or not raw:
                rows.append((None, []))
                continue
            image = np.frombuffer(raw, np.uint8).reshape(int(height), int(width), -1)[..., :3]
            b, g, r = exact_mode(np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]]))
            boxes = components(content_mask(image, (b, g, r)), 4)
            rows.append((f"#{r:02X}{g:02X}{b:02X}", [dict(zip(("x0", "y0", "x1", "y1"), x, strict=True)) for x in boxes]))
        return pd.DataFrame(rows, columns=["background", "boxes"])

    return pictures.withColumn("__d", of("height", "width", "data")).select(key, "__d.*")
