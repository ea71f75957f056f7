"""Rasters in tiles: kernels that see a margin around each tile, and components that go on over tile borders.

A raster (image_id, height, width, data: blue, green, red bytes by rows) is cut
into tiles, each a row of its own with a margin, mirrored at the picture's edge.
Whatever a kernel computes for a pixel depends on the margin only, so results
are the same for tiles of any size. Components are labelled within each tile;
labels that touch over a border are links, joined picture by picture. Of the
tiles no more than their labels and borders ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.lineage import cut
from evidentia.shipping import ship

TILE, MARGIN = 256, 4
PLACE = "image_id long, ty int, tx int, top int, left int, h int, w int, height int, width int"
_PLACE = [c.split()[0] for c in PLACE.split(", ")]
_PART = 1 << 32
#: Rows and bytes of pixels of a frame that leaves a kernel.
_FRAME, _BYTES = 4096, 8 << 20


def _mapped(df: DataFrame, schema: str, of: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """The rows that of makes of each row; they leave in frames of up to _FRAME rows or _BYTES, since a frame for each row costs more than most kernels."""
    names = StructType.fromDDL(schema).names
    ship(df.sparkSession)

    def run(frames):
        rows, size = [], 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                for made in of(row):
                    rows.append(made)
                    size += sum(len(v) for v in made if isinstance(v, bytes))
                    if len(rows) >= _FRAME or size >= _BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def picture(data: bytes | None, height: int, width: int) -> np.ndarray:
    """The pixels of a raster; bytes that are missing are black, further ones don't count."""
    raw = np.frombuffer((data or b"")[: height * width * 3], np.uint8)
    return np.concatenate([raw, np.zeros(height * width * 3 - len(raw), np.uint8)]).reshape(height, width, 3)


def on_canvas(reference: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """A candidate of another size on the reference's canvas, not resampled: what it doesn't cover is as different as can be."""
    out = 255 - reference
    h, w = (min(a, b) for a, b in zip(reference.shape[:2], candidate.shape[:2], strict=True))
    out[:h, :w] = candidate[:h, :w]
    return out


def _margined(image: np.ndarray, margin: int) -> np.ndarray:
    return np.pad(image, ((margin, margin), (margin, margin), (0, 0)), "reflect") if min(image.shape[:2]) > 1 else np.pad(image, ((margin, margin), (margin, margin), (0, 0)), "edge")


def sides(row, margin: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Height, width and both pictures of a row of pairs with the margin around, the other on the first one's canvas; None for a raster without pixels."""
    if not (row.height and row.width) or pd.isna(row.height) or pd.isna(row.width) or row.data is None:
        return None
    height, width = int(row.height), int(row.width)
    a = picture(row.data, height, width)
    other = (0, 0) if pd.isna(row.other_height) or pd.isna(row.other_width) else (int(row.other_height), int(row.other_width))
    b = on_canvas(a, picture(row.other, *other))
    return height, width, _margined(a, margin), _margined(b, margin)


def tiled(pairs: DataFrame, *, size: int = TILE, margin: int = MARGIN) -> DataFrame:
    """Tiles of pairs of rasters (image_id, height, width, data, other_height, other_width, other): PLACE, a, b (both with the margin); b is on a's canvas. Rasters without pixels, null ones among them, have no tile."""

    def of(row):
        got = sides(row, margin)
        if got is None:
            return
        height, width, a, b = got
        for top in range(0, height, size):
            for left in range(0, width, size):
                h, w = min(size, height - top), min(size, width - left)
                part = np.s_[top : top + h + 2 * margin, left : left + w + 2 * margin]
                yield row.image_id, top // size, left // size, top, left, h, w, height, width, a[part].tobytes(), b[part].tobytes()

    kept = pairs.select("image_id", "height", "width", "data", "other_height", "other_width", "other")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _mapped(kept, f"{PLACE}, a binary, b binary", of).repartition(n, "image_id", "ty", "tx")


def label(mask: np.ndarray, eight: bool) -> tuple[np.ndarray, int]:
    """Labels from 1 of the connected parts of a mask, by 4 or 8 neighbours, in the order of their first pixel, and their number: runs of each row are joined with those above that they touch."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    above = list(range(len(ys)))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    rows = np.searchsorted(ys, np.arange(len(mask) + 1))
    slack = 1 if eight else 0
    for y in range(1, len(mask)):
        j, stop = int(rows[y - 1]), int(rows[y])
        for k in range(stop, int(rows[y + 1])):
            while j < stop and ends[j] + slack <= starts[k]:
                j += 1
            i = j
            while i < stop and starts[i] < ends[k] + slack:
                a, b = top(i), top(k)
                above[max(a, b)] = min(a, b)
                i += 1
    roots, number = np.unique([top(k) for k in range(len(ys))], return_inverse=True) if len(ys) else (np.zeros(0), np.zeros(0, int))
    out = np.zeros(mask.shape, np.int32)
    for y, a, b, n in zip(ys.tolist(), starts.tolist(), ends.tolist(), number.tolist(), strict=True):
        out[y, a:b] = n + 1
    return out, len(roots)


def held(mask: np.ndarray) -> np.ndarray:
    """The pixels of a mask whose connected part, by 8 neighbours, has a pixel of value 2: runs of each row are joined with those above that they touch, all rows at once."""
    edges = np.diff(np.pad((mask > 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    wide = mask.shape[1] + 2  # places of a row and one between, so that rows don't touch sideways
    first, last = ys * wide + starts, ys * wide + ends
    low, high = np.searchsorted(last, first - wide, "left"), np.searchsorted(first, last - wide, "right")
    n = np.maximum(high - low, 0)
    b = np.repeat(np.arange(len(ys)), n)
    a = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + low[b]
    above = np.arange(len(ys))
    while True:
        p, q = above[a], above[b]
        apart = p != q
        if not apart.any():
            break
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(above, np.maximum(p, q), np.minimum(p, q))
        while (further := above[above]).tobytes() != above.tobytes():
            above = further
    size = mask.shape[1]
    begin, end = ys * size + starts, ys * size + ends
    strong = np.concatenate([[0], np.cumsum(mask.ravel() == 2)])
    root = np.zeros(len(ys), bool)
    root[above[strong[end] > strong[begin]]] = True
    kept = root[above]
    turns = np.zeros(mask.size + 1, np.int8)
    turns[begin[kept]] += 1
    turns[end[kept]] -= 1
    return np.cumsum(turns[:-1], dtype=np.int8).astype(bool).reshape(mask.shape)


def _union(links: pd.DataFrame) -> dict[int, int]:
    above: dict[int, int] = {}

    def top(k: int) -> int:
        while above.get(k, k) != k:
            k = above[k]
        return k

    for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {k: top(k) for k in above}


def labelled(masks: DataFrame, *, eight: bool) -> tuple[DataFrame, DataFrame]:
    """Of tiles (PLACE, layer, mask: one byte a pixel of the tile itself): the tiles with labels (int32) in place of masks, n, their number, and strong, those with a pixel of value 2; and roots: image_id, layer, part, root, for every part of every tile.

    A part is a tile's number times 2^32 and its label; roots are the least
    parts that are reached over the borders of tiles.
    """

    def of(row):
        mask = np.frombuffer(row.mask, np.uint8).reshape(row.h, row.w)
        found, n = label(mask > 0, eight)
        tile = (row.ty << 14 | row.tx) * _PART
        edge = np.zeros(found.shape, bool)
        # at the picture's own edge there is no tile to go on in
        for at, inner in ((np.s_[0], row.top > 0), (np.s_[-1], row.top + row.h < row.height), (np.s_[:, 0], row.left > 0), (np.s_[:, -1], row.left + row.w < row.width)):
            edge[at] |= inner
        ys, xs = np.nonzero((found > 0) & edge)
        border = [{"y": int(y) + row.top, "x": int(x) + row.left, "part": tile + int(found[y, x]), "low": bool(y == row.h - 1), "right": bool(x == row.w - 1)} for y, x in zip(ys, xs, strict=True)]
        yield (*(getattr(row, c) for c in _PLACE), row.layer, found.tobytes(), n, np.unique(found[mask == 2]).tolist(), border)

    tiles = cut(_mapped(masks.select(*_PLACE, "layer", "mask"), f"{PLACE}, layer string, labels binary, n int, strong array<int>, border array<struct<y: int, x: int, part: long, low: boolean, right: boolean>>", of), "labels")
    border = tiles.select("image_id", "layer", F.explode("border").alias("p")).select("image_id", "layer", "p.*")
    reach = (-1, 0, 1) if eight else (0,)
    ahead = F.array_union(F.when(F.col("low"), F.array(*(F.struct((F.col("y") + 1).alias("y"), (F.col("x") + d).alias("x")) for d in reach))).otherwise(F.expr("array()")), F.when(F.col("right"), F.array(*(F.struct((F.col("y") + d).alias("y"), (F.col("x") + 1).alias("x")) for d in reach))).otherwise(F.expr("array()")))
    links = border.select("image_id", "layer", F.col("part").alias("a"), F.explode(ahead).alias("q")).select("image_id", "layer", "a", "q.y", "q.x")
    links = links.join(border.select("image_id", "layer", "y", "x", F.col("part").alias("b")), ["image_id", "layer", "y", "x"]).where("a <> b").select("image_id", "layer", "a", "b").distinct()

    def join(key, frame):
        return pd.DataFrame([(*key, k, r) for k, r in _union(frame).items()], columns=["image_id", "layer", "part", "root"])

    moved = links.groupBy("image_id", "layer").applyInPandas(join, "image_id long, layer string, part long, root long")
    parts = tiles.where("n > 0").select("image_id", "layer", ((F.col("ty") * F.lit(1 << 14).cast("long") + F.col("tx")) * F.lit(_PART)).alias("base"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("k"))
    parts = parts.select("image_id", "layer", (F.col("base") + F.col("k")).alias("part"))
    return tiles, cut(parts.join(moved, ["image_id", "layer", "part"], "left").withColumn("root", F.coalesce("root", "part")), "roots")


def measured_parts(tiles: DataFrame, values: DataFrame, names: list[str], of: Callable[[np.ndarray, int, object], dict]) -> DataFrame:
    """image_id, layer, part and names (doubles) of each part: of gives, for a tile's labels and its row of values, arrays by label."""

    def rows(row):
        n = int(row.n)
        if n:
            labels = np.frombuffer(row.labels, np.int32).reshape(row.h, row.w)
            found = of(labels, n, row)
            tile = (row.ty << 14 | row.tx) * _PART
            for k in range(1, n + 1):
                yield (row.image_id, row.layer, tile + k, *(float(found[name][k]) for name in names))

    joined = tiles.drop("border", "strong").join(values, ["image_id", "ty", "tx"])
    return _mapped(joined, "image_id long, layer string, part long, " + ", ".join(f"{n} double" for n in names), rows)


def flagged(masks: DataFrame, *, eight: bool) -> DataFrame:
    """Tiles (PLACE, layer, mask) whose masks keep the components that have a pixel of value 2 somewhere in the picture; other pixels of a mask are 0 or 1."""
    tiles, roots = labelled(masks, eight=eight)
    strong = tiles.select("image_id", "layer", F.explode("strong").alias("k"), (F.col("ty") * F.lit(1 << 14).cast("long") + F.col("tx")).alias("tile")).select("image_id", "layer", (F.col("tile") * F.lit(_PART) + F.col("k")).alias("part"), F.lit(1).alias("strong"))
    kept = roots.join(strong, ["image_id", "layer", "part"], "left")
    roots_kept = kept.groupBy("image_id", "layer", "root").agg(F.max("strong").alias("any")).where("any = 1").select("image_id", "layer", "root")
    by_tile = kept.join(roots_kept, ["image_id", "layer", "root"], "left_semi").groupBy("image_id", "layer", F.expr(f"part div {_PART}").alias("tile")).agg(F.collect_list((F.col("part") % _PART).cast("int")).alias("kept"))
    joined = tiles.drop("border", "strong").withColumn("tile", F.col("ty") * F.lit(1 << 14).cast("long") + F.col("tx")).join(by_tile, ["image_id", "layer", "tile"], "left")

    def of(row):
        labels = np.frombuffer(row.labels, np.int32)
        keep = np.zeros(int(row.n) + 1, np.uint8)
        if row.kept is not None and len(row.kept):
            keep[np.asarray(row.kept, int)] = 1
        yield (*(getattr(row, c) for c in _PLACE), row.layer, keep[labels].tobytes())

    return _mapped(joined, f"{PLACE}, layer string, mask binary", of)


def with_margin(masks: DataFrame, margin: int, *, size: int = TILE, outside: int = 0) -> DataFrame:
    """Tiles (PLACE, layer, mask) with margin pixels of their neighbours around (wide), outside beyond the picture: strips go to the tiles they border, the tile itself with them."""
    reach = -(-margin // size)

    def strips(row):
        mask = np.frombuffer(row.mask, np.uint8).reshape(row.h, row.w)
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                ty, tx = row.ty + dy, row.tx + dx
                if not (0 <= ty <= (row.height - 1) // size and 0 <= tx <= (row.width - 1) // size):
                    continue
                y0, y1 = max(row.top, ty * size - margin), min(row.top + row.h, (ty + 1) * size + margin)
                x0, x1 = max(row.left, tx * size - margin), min(row.left + row.w, (tx + 1) * size + margin)
                if y0 < y1 and x0 < x1:
                    yield row.image_id, row.layer, ty, tx, y0, x0, y1 - y0, x1 - x0, row.height, row.width, mask[y0 - row.top : y1 - row.top, x0 - row.left : x1 - row.left].tobytes()

    sent = _mapped(masks, "image_id long, layer string, ty int, tx int, y int, x int, sh int, sw int, height int, width int, strip binary", strips)
    met = sent.groupBy("image_id", "layer", "ty", "tx", "height", "width").agg(F.collect_list(F.struct("y", "x", "sh", "sw", "strip")).alias("strips"))

    def of(row):
        top, left = row.ty * size, row.tx * size
        h, w = min(size, row.height - top), min(size, row.width - left)
        wide = np.full((h + 2 * margin, w + 2 * margin), outside, np.uint8)
        for s in row.strips:
            y, x = s["y"] - top + margin, s["x"] - left + margin
            wide[y : y + s["sh"], x : x + s["sw"]] = np.frombuffer(s["strip"], np.uint8).reshape(s["sh"], s["sw"])
        yield row.image_id, row.ty, row.tx, top, left, h, w, row.height, row.width, row.layer, wide.tobytes()

    return _mapped(met, f"{PLACE}, layer string, wide binary", of)
