"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

Windowed spectra are folded onto twelve pitch classes. Over an integral image of
those frames sixteen rectangle filters compare halves, quadrants and thirds in
pitch or time; each comparison gives two bits, and a position's bits make one
packed 32-bit item. Recordings of equal items are one class, and every pair of
classes is compared at every offset, so that no alignment that counts is left
out. Classes are tiles that are files, and a task gets pairs of tiles. A stretch
that counts holds four of the places that stand a quarter of its least length apart in
one recording, with few wrong bits at all, or the whole of a recording that is
shorter than that, with few at both its ends: offsets at which neither holds
are passed over, the others are measured. Of a pair of tiles only each class's best
alignment, its number of alignments, and as many links as connect its classes leave the task. The
comparison grows with the square of the items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared, tiles
from evidentia.llm.components import components

PITCHES, WIDTH = 12, 16
#: (kind, first pitch, pitches, frames) of each filter. Kinds: 1 halves in pitch, 2 halves in time, 3 quadrants, 4 thirds in pitch, 5 thirds in time.
FILTERS = tuple((1 + k % 5, k % 5, 4 + 2 * (k // 2 % 3), 4 * (1 + k % 4)) for k in range(16))
#: Log ratio beyond which a comparison is clear, and up to which it is even: not 0, around which steady sound would flicker.
CLEAR, EVEN = 0.08, 0.02
_GRAY = np.array([0, 1, 3, 2], np.uint32)


@dataclass(frozen=True)
class Settings:
    """rate in Hz, samples of a frame and between frames; items of a key and positions between them; items and share of wrong bits of an alignment that counts; wrong bits of an item that ends a stretch."""

    rate: int = 11_025
    frame: int = 4096
    hop: int = 682
    key_items: int = 3
    key_step: int = 3
    least_items: int = 64
    most_error: float = 0.15
    item_error: int = 10


#: For the bytes of short texts read as unsigned 8-bit samples at 8 kHz.
BYTES = Settings(rate=8000, frame=512, hop=64, least_items=16)
#: Recordings of fewer items have keys of fewer items, those of fewer than TINY single items.
SHORT, TINY = 48, 7
#: Up to so many items a key joins two, and from so many three: recordings between have both.
_TWO_TO, _THREE_FROM = 18, 14
#: Items of a tile, and comparisons that are held at once.
TILE, _CELLS = 1 << 15, 1 << 22
#: The sign bits of an item.
_SIGNS = np.uint32(0xAAAAAAAA)
_SALTS = 32
_COLUMNS = ["print", "first", "offset", "aligned", "error", "n"]


def _pitch_map(s: Settings) -> np.ndarray:
    """(bins, 12): each spectrum bin from 28 Hz to 3.5 kHz belongs to the pitch class of its frequency."""
    f = np.fft.rfftfreq(s.frame, 1 / s.rate)
    out = np.zeros((len(f), PITCHES), np.float32)
    use = np.flatnonzero((f >= 28) & (f <= 3520))
    out[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % PITCHES] = 1
    return out


def chroma(clips: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length pitch-class frames of all clips one after the other, and each clip's number of frames; the end of a clip is padded with silence, and an empty clip has no frame."""
    counts = np.array([-(-max(len(c) - s.frame, 0) // s.hop) + 1 if len(c) else 0 for c in clips], np.int64)
    need = np.where(counts > 0, (counts - 1) * s.hop + s.frame, 0)
    starts = np.concatenate([[0], np.cumsum(need)]).astype(np.int64)
    line = np.zeros(int(starts[-1]), np.float32)
    for clip, at in zip(clips, starts[:-1].tolist(), strict=True):
        line[at : at + len(clip)] = clip
    first = np.repeat(starts[:-1], counts) + s.hop * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    window, pitches = np.hanning(s.frame).astype(np.float32), _pitch_map(s)
    out = np.empty((len(first), PITCHES), np.float32)
    step = max(1, (1 << 20) // s.frame)
    for i in range(0, len(first), step):
        spectrum = np.fft.rfft(line[first[i : i + step, None] + np.arange(s.frame)] * window)
        power = (spectrum.real**2 + spectrum.imag**2) @ pitches
        out[i : i + step] = power / np.maximum(np.linalg.norm(power, axis=1, keepdims=True), 1e-6)
    return out, counts


def items(clips: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    """The packed items of each clip: one for each position that has WIDTH frames after it, one for a shorter clip that has any frame."""
    frames, counts = chroma(clips, s)
    padded = np.maximum(counts, WIDTH) * (counts > 0)
    starts = np.concatenate([[0], np.cumsum(padded)]).astype(np.int64)
    image = np.zeros((int(starts[-1]) + 1, PITCHES + 1))
    rows = np.repeat(starts[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    image[rows + 1, 1:] = frames
    integral = image.cumsum(0).cumsum(1)
    each = np.where(counts > 0, padded - WIDTH + 1, 0)
    at = np.repeat(starts[:-1], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)

    def area(t0, t1, p0, p1):
        return integral[at + t1, p1] - integral[at + t0, p1] - integral[at + t1, p0] + integral[at + t0, p0]

    packed = np.zeros(len(at), np.uint32)
    for k, (kind, p, n, w) in enumerate(FILTERS):
        total = area(0, w, p, p + n)
        if kind == 1:
            part = area(0, w, p, p + n // 2)
        elif kind == 2:
            part = area(0, w // 2, p, p + n)
        elif kind == 3:
            part = area(0, w // 2, p, p + n // 2) + area(w // 2, w, p + n // 2, p + n)
        elif kind == 4:
            part = area(0, w, p + n // 3, p + n - n // 3)
        else:
            part = area(w // 4, w - w // 4, p, p + n)
        ratio = np.log((1 + part) / (1 + np.maximum(total - part, 0)))
        level = (ratio > -CLEAR).astype(np.uint32) + (ratio > EVEN) + (ratio > CLEAR)
        packed |= _GRAY[level] << np.uint32(2 * k)
    ends = np.cumsum(each)
    return [packed[a:b] for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True)]


def _signs(own: np.ndarray, size: int, step: int) -> np.ndarray:
    """A number for each set of size items step apart, from their sign bits: those bits themselves for up to four items, else a hash."""
    n = len(own) - (size - 1) * step
    signs, made = (own & _SIGNS).astype(np.uint64), np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        part = signs[k * step : k * step + n]
        made = made * np.uint64(0x9E3779B97F4A7C15) ^ part if size > 4 else made | part >> np.uint64(k % 2) << np.uint64(32 * (k // 2))
    return made


def keys(own: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and keys (as signed numbers, each size in a range of its own up to three items) of each set of size items step apart, each key where it is first met, and the key of one item more there; a shorter clip has none."""
    found = own.astype(np.uint64) if size == 1 else _signs(own, size, step)
    if not len(found):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    longer, more = found.copy(), _signs(own, size + 1, step)
    longer[: len(more)] = more
    found, at = np.unique(found, return_index=True)
    if size < 4:
        found = found | np.uint64(size << 56)
    return at.astype(np.int32), found.view(np.int64), longer[at].view(np.int64)


def all_keys(own: np.ndarray, late: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ma.MaskedArray]:
    """The keys of a recording and of its readings behind silence (positions count from the silence, so they may be one too high), their size by its number of items; the third array, those of one item more, is masked for single items and behind silence. align() needs no keys; this says which recordings an index by keys would bring together."""
    n = len(own)
    sizes = [s.key_items] if n >= SHORT else [k for k, holds in ((1, n < TINY), (2, TINY - 2 <= n <= _TWO_TO), (s.key_items, n >= _THREE_FROM)) if holds]
    made = [(*keys(x, k, s.key_step), k == 1 or x is not own) for x in (own, *late) for k in sizes]
    if not n or not made:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.ma.array(np.zeros(0, np.int64))
    at, found, longer = (np.concatenate([m[i] for m in made]) for i in range(3))
    alone = np.concatenate([np.full(len(m[0]), m[3]) for m in made])
    found, first = np.unique(found, return_index=True)  # readings without silence come first
    return at[first].astype(np.int32), found, np.ma.array(longer[first], mask=alone[first])


def stretch(a: np.ndarray, b: np.ndarray, offset: int, item_error: int) -> tuple[int, int, int]:
    """(start in a, items, wrong bits) of the longest run along the alignment a[i] ~ b[i + offset] whose items have at most item_error wrong bits."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 0, 0
    wrong = np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).astype(np.int64)
    bad = np.flatnonzero(np.concatenate([[True], wrong > item_error, [True]]))
    k = int(np.argmax(np.diff(bad)))
    first, last = int(bad[k]), int(bad[k + 1]) - 1
    return lo + first, last - first, int(wrong[first:last].sum())


class Tile:
    """Recordings one after the other: prints, lens and starts of each, and of all items flat and own (the recording)."""

    def __init__(self, data: bytes):
        words = np.frombuffer(data, "<u4")
        prints, lens, at = [], [], 0
        while at < len(words):
            prints.append(words[at : at + 2].view("<i8")[0])
            lens.append(int(words[at + 2]))
            at += 3 + lens[-1]
        self.prints, self.lens = np.array(prints, np.int64), np.array(lens, np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.own = np.repeat(np.arange(len(lens)), self.lens)
        self.flat = words[np.arange(len(self.own)) + 3 * (self.own + 1)].astype(np.uint32)

    @staticmethod
    def record(print_: int, own: np.ndarray) -> bytes:
        return np.int64(print_).tobytes() + np.uint32(len(own)).tobytes() + own.astype("<u4").tobytes()


def _wrong(a: Tile, i: np.ndarray, b: Tile, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.flat[i] ^ b.flat[j]).astype(np.int64)


def _within(a: Tile, b: Tile, s: Settings) -> list[np.ndarray]:
    """Alignments of a's recordings of fewer than least_items with recordings of b that hold them whole: rows of x in a, y in b, offset, items, wrong bits."""
    out = []
    for n in np.unique(a.lens[a.lens < s.least_items]).tolist():
        most = s.most_error * 32 * n
        xs, width = np.flatnonzero(a.lens == n), len(b.flat) - n + 1
        if width <= 0:
            continue
        fits, low = b.own[:width] == b.own[n - 1 :], min(s.item_error, int(most))
        for k in range(0, len(xs), max(1, _CELLS // width)):
            part = a.starts[xs[k : k + max(1, _CELLS // width)]]
            near = (np.bitwise_count(a.flat[part, None] ^ b.flat[None, :width]) <= low) & fits
            if n > 1:
                near &= np.bitwise_count(a.flat[part + n - 1, None] ^ b.flat[None, n - 1 :]) <= low
            r, j = np.divmod(np.flatnonzero(near), width)
            i, total = part[r], np.zeros(len(r), np.int64)
            for t in range(n):
                each = _wrong(a, i + t, b, j + t)
                kept = (each <= s.item_error) & (total + each <= most)
                i, j, total = i[kept], j[kept], (total + each)[kept]
            x, y = a.own[i], b.own[j]
            out.append(np.stack([x, y, j - b.starts[y], np.full(len(x), n), total]))
    return out


def _measured(a: Tile, b: Tile, x: np.ndarray, y: np.ndarray, offset: np.ndarray, s: Settings) -> np.ndarray:
    """stretch() of many alignments a[i] ~ b[i + offset] side by side: rows of x, y, offset, items, wrong bits of those that count."""
    lo, hi = np.maximum(0, -offset), np.minimum(a.lens[x], b.lens[y] - offset)
    ends, out, k = np.cumsum(hi - lo + 1), [], 0
    while k < len(x):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _CELLS, "right")))
        sizes = (hi - lo)[k:end] + 1  # each alignment is followed by a place that ends its last stretch
        stop = np.cumsum(sizes)
        at = np.arange(stop[-1]) - np.repeat(stop - sizes, sizes)
        i = np.minimum(np.repeat((a.starts[x] + lo)[k:end], sizes) + at, len(a.flat) - 1)
        j = np.minimum(np.repeat((b.starts[y] + lo + offset)[k:end], sizes) + at, len(b.flat) - 1)
        wrong = _wrong(a, i, b, j)
        wrong[stop - 1] = 33
        bad = np.flatnonzero(wrong > s.item_error)
        wrong[bad] = 0
        total, before = np.concatenate([[0], np.cumsum(wrong)]), np.concatenate([[-1], bad[:-1]])
        length = bad - before - 1
        first = np.searchsorted(bad, stop - sizes)
        # the longest, the first on ties
        longest = np.maximum.reduceat(length * (1 << 32) - np.arange(len(length)), first)
        best = -longest & ((1 << 32) - 1)
        out.append(np.stack([x[k:end], y[k:end], offset[k:end], length[best], total[bad[best]] - total[before[best] + 1]]))
        k = end
    made = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    least = np.minimum(s.least_items, np.minimum(a.lens[made[0]], b.lens[made[1]]))
    return made[:, (made[3] >= least) & (made[4] <= s.most_error * 32 * made[3])]


def _along(a: Tile, b: Tile, s: Settings, same: bool) -> list[np.ndarray]:
    """Alignments of recordings of least_items or more: a stretch of so many items holds four places of a that are a quarter as many apart, and all between."""
    step = s.least_items // 4  # 0 where fewer than four items are a stretch
    every, across = max(1, step), 3 * step
    width = len(b.flat) - across
    if width <= 0:
        return []
    inner = np.arange(len(a.flat)) - a.starts[a.own]
    rows = np.flatnonzero((a.lens[a.own] >= s.least_items) & (inner % every == 0))
    fits = (b.own[:width] == b.own[across:]) & (b.lens[b.own[:width]] >= s.least_items)
    out: list[np.ndarray] = []
    found: list[np.ndarray] = []
    high = max(1, _CELLS // len(b.flat))

    def measure():
        if found:
            x, y, offset = np.unique(np.concatenate(found, axis=1), axis=1)
            out.append(_best(_measured(a, b, x, y, offset, s)))
            found.clear()

    for k in range(0, len(rows), high):
        part = rows[k : k + high + 3 * (step > 0)]  # and those that follow
        near = np.bitwise_count(a.flat[part, None] ^ b.flat[None, :]) <= s.item_error
        if step:
            if len(part) < 4:
                break
            met = near[:-3, :width] & near[3:, across:] & (a.own[part[:-3]] == a.own[part[3:]])[:, None]
            for t in (1, 2):
                met &= near[t : t - 3, t * step : t * step + width]
            near = met
        r, j = np.divmod(np.flatnonzero(near & fits), width)
        i = part[r]
        for t in range(1, across):
            kept = _wrong(a, i + t, b, j + t) <= s.item_error
            i, j = i[kept], j[kept]
        x, y = a.own[i], b.own[j]
        kept = x < y if same else np.ones(len(x), bool)
        offset = (j - b.starts[y]) - (i - a.starts[x])
        found.append(np.stack([x, y, offset])[:, kept])
        if sum(f.shape[1] for f in found) > _CELLS // 4:
            measure()
    measure()
    return out


def _best(rows: np.ndarray) -> np.ndarray:
    """Of the rows of each pair (x, y) that of most items, of these that of the fewest wrong bits, then of the least shift."""
    rows = rows[:, np.lexsort((rows[2], np.abs(rows[2]), rows[4], -rows[3], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
    return rows[:, new]


def alignments(a: Tile, b: Tile | None, s: Settings) -> np.ndarray:
    """The best alignment of each pair of recordings of two tiles (of one, where b is None) of which one counts: rows of x in a, y in b, offset, items, wrong bits."""
    same, b = b is None, a if b is None else b
    rows = _along(a, b, s, same) + _within(a, b, s)
    if not same:
        rows += [np.stack([y, x, -offset, n, wrong]) for x, y, offset, n, wrong in _within(b, a, s)]
    rows = np.concatenate([*rows, np.zeros((5, 0), np.int64)], axis=1)
    if same:
        turned = rows[0] > rows[1]
        rows[:2, turned], rows[2, turned] = rows[1::-1, turned], -rows[2, turned]
        rows = rows[:, rows[0] < rows[1]]
    return _best(rows)


def _told(a: Tile, b: Tile | None, found: np.ndarray) -> pa.RecordBatch:
    """What leaves a pair of tiles: each class's best alignment (print, first, offset, aligned, error) with its number n of alignments, and links that connect the classes, without those and with n 0."""
    p, q = a.prints[found[0]], (b or a).prints[found[1]]
    ends = np.concatenate([np.stack([p, q, found[2], found[3], found[4]]), np.stack([q, p, -found[2], found[3], found[4]])], axis=1)
    ends = ends[:, np.lexsort((ends[1], ends[4], -ends[3], ends[0]))]
    own, at, n = np.unique(ends[0], return_index=True, return_counts=True)
    top = ends[:, at]
    above: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := above.get(k, k)) != k:
            above[k] = above.get(up, up)
            k = up
        return k

    links = []
    for x, y in zip(p.tolist(), q.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            above[max(rx, ry)] = min(rx, ry)
            links.append((x, y))
    src, dst = np.array(links, np.int64).reshape(-1, 2).T
    none = np.ones(len(src), bool)

    def both(x, kind):
        return pa.array(np.concatenate([x, np.zeros(len(src), x.dtype)]), kind, mask=np.concatenate([np.zeros(len(own), bool), none]))

    kept = [pa.array(np.concatenate([own, src])), pa.array(np.concatenate([top[1], dst])), both(top[2], pa.int64()), both(top[3], pa.int64()), both(top[4] / (32 * np.maximum(top[3], 1)), pa.float64())]
    return pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate([n, np.zeros(len(src), n.dtype)]), pa.int64())], _COLUMNS)


def fingerprint(df: DataFrame, *, id_col: str, pcm_col: str, settings: Settings, dtype: str = "<i2") -> DataFrame:
    """id, items (array of int, the packed bits) and print (hash of all items) of each row's PCM bytes; null and empty clips have no items."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for lo, n in _shared.text_slices(batch.column(1), 2 << 20):
                part = batch.slice(lo, n)
                raw = [np.frombuffer(x or b"", np.uint8)[: len(x or b"") // np.dtype(dtype).itemsize * np.dtype(dtype).itemsize].view(dtype) for x in part.column(1).to_pylist()]
                scale, zero = (128.0, 128.0) if np.dtype(dtype).kind == "u" else (float(np.iinfo(dtype).max), 0.0)
                clips = [((x.astype(np.float32) - zero) / scale) for x in raw]
                made = items(clips, settings)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32), pa.array(np.concatenate(made).view(np.int32)))
                prints = pa.array([xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in made], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, prints], ["id", "items", "print"])

    rows = _shared.positional(df).select(_shared.column(df, id_col).cast("long").alias("id"), _shared.column(df, pcm_col).cast("binary").alias("pcm"))
    return _shared.map_arrow(rows, run, "id long, items array<int>, print long")


def align(df: DataFrame, *, id_col: str = "id", pcm_col: str = "pcm", settings: Settings = Settings(), dtype: str = "<i2") -> DataFrame:
    """One row for each row of df: id, n_items, class_id (least id of equal items), aligned_with, offset, aligned_items, bit_error, recording_id, n_links.

    All pairs of classes are compared at all offsets. aligned_with is the class
    whose alignment covers most items, then has the fewest wrong bits, then the
    least print; offset is what to add to a position here to find it there; all
    four are null where none counts. n_links is the number of classes that align
    with this one. recording_id is the least class that alignments reach. Rows of a
    null id have class and recording null where no row of their class has an id.
    Null and empty clips are one class, without items; repeated rows are one
    class each; an empty table gives no rows; other columns don't matter.
    """
    made = _shared.materialize(fingerprint(df, id_col=id_col, pcm_col=pcm_col, settings=settings, dtype=dtype), "prints")
    members = made.select("id", F.size("items").alias("n_items"), "print")
    classes = _shared.materialize(made.groupBy("print").agg(F.min("id").alias("class_id"), F.first("items").alias("items")), "recordings")
    n = -(-(classes.agg(F.sum(F.size("items"))).first()[0] or 0) // TILE)

    def records(batches):
        for batch in batches:
            own = [Tile.record(p, x.values.to_numpy().view(np.uint32)) for p, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["name", "item"])

    tiling = tiles.Tiling(_shared.scratch(df.sparkSession, "recording-tiles"), (0,), (0,), n)
    if n:
        named = classes.where(F.size("items") > 0).select(F.concat(F.lit("tile-"), F.pmod(F.xxhash64("print"), F.lit(n))).alias("name"), "print", "items")
        tiles.write_groups(_shared.map_arrow(named, records, "name string, item binary"), tiling.path, "name")

    def run(i: int, j: int) -> pa.RecordBatch | None:
        a, b = Tile(tiles.read(f"{tiling.path}/tile-{i}")), None if i == j else Tile(tiles.read(f"{tiling.path}/tile-{j}"))
        found = alignments(a, b, settings) if len(a.lens) and (b is None or len(b.lens)) else np.zeros((5, 0), np.int64)
        return _told(a, b, found) if found.shape[1] else None

    schema = "print long, first long, offset long, aligned long, error double, n long"
    aligned = _shared.materialize(tiles.pairs(df.sparkSession, tiling, 0, run, schema), "alignments")
    top = aligned.where("n > 0").groupBy("print").agg(F.max(F.struct("aligned", -F.col("error"), -F.col("first"), F.struct("first", "offset", "aligned", "error").alias("it"))).alias("top"), F.sum("n").alias("n_links"))
    top = top.select("print", F.col("top.it.first").alias("first"), F.col("top.it.offset").cast("int").alias("offset"), F.col("top.it.aligned").cast("int").alias("aligned"), "top.it.error", "n_links")
    roots = components(aligned.select(F.col("print").alias("src"), F.col("first").alias("dst"))).select(F.col("node").alias("print"), "root")
    named = classes.select("print", "class_id")
    known = _shared.materialize(named.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "recording-roots")
    # a recording may have very many classes: they are spread before they meet its name
    least = known.groupBy("root").agg(F.min("class_id").alias("recording_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    known = known.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(_SALTS))).join(least, ["root", "salt"]).join(top, "print", "left")
    known = known.join(named.select(F.col("print").alias("first"), F.col("class_id").alias("aligned_with")), "first", "left")
    return members.join(known, "print").select("id", "n_items", "class_id", "aligned_with", F.col("offset"), F.col("aligned").alias("aligned_items"), F.col("error").alias("bit_error"), "recording_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def op5_chroma_prints(spark, sf_dir: str) -> DataFrame:
    """The bytes of every document as 8-bit sound: its fingerprint class and its alignment with other recordings."""
    docs = _shared.table(spark, sf_dir, "documents")
    found = align(docs, id_col="doc_id", pcm_col="text", settings=BYTES, dtype="u1")
    return found.withColumnRenamed("id", "doc_id")
