"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints of one number of set bits are cut into tiles of about
TILE, each a file that the pairs of tiles name and no shuffle carries. Two fingerprints within the radius differ by no more than it in that
number, so a pair of tiles whose numbers lie further apart is skipped. All other
pairs of tiles are compared in full, in numpy: exclusive or, bit count,
threshold. A pair of tiles yields no more links than it has fingerprints: those
that join what it had not yet joined.
The number of tile pairs grows with the square of the distinct fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared, tiles
from evidentia.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 1 << 14
_ROWS, _COLS = 64, 4096
#: Each bit of a byte in a byte lane of its own.
_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of size words, joined by spaces; of the whole sequence where it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(line, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist()
    return [xxh64_intdigest(line[a:b], seed) for a, b in zip(first, last, strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of consecutive groups of hashes, the 64-bit value whose bits are set in over half the group; an empty group gives zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    pieces = -(-sizes // 255)  # a byte lane holds no more
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(starts, pieces) + 255 * nth
    groups = np.cumsum(pieces) - pieces
    for byte in range(8):
        lanes = _LANES[(hashes >> np.uint64(8 * byte)).astype(np.uint8)]
        sums = np.add.reduceat(lanes, cuts).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(sums, groups, axis=0) * 2 > sizes[:, None]
        out[full] |= np.packbits(ones, axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(texts: list[str | None], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The unsigned 64-bit SimHash of each text."""
    each = [shingle_hashes(t, size, seed) for t in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((h for hashes in each for h in hashes), np.uint64, int(counts.sum()))
    return majority(flat, counts)


def with_fingerprint(df: DataFrame, *, text_col: str = "text", size: int = SHINGLE, seed: int = SEED, carry: list[str] | None = None, name: str = "fp") -> DataFrame:
    """Append the fingerprint as a signed long; null and empty texts have zero; a column that is called name is replaced."""

    def make():
        return lambda texts: pa.array(fingerprints(texts, size, seed).view(np.int64))

    return _shared.annotate(df, text_col, make, "long", carry=carry, name=name)


def join_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of two tiles within radius of each other (of one tile, where b is None), as few as do; tiles are sorted by bit count."""
    nodes = a if b is None else np.concatenate([a, b])
    base = 0 if b is None else len(a)
    b = a if b is None else b
    pops_a, pops_b = (np.bitwise_count(x).astype(np.int16) for x in (a, b))
    label, links = np.arange(len(nodes)), []
    for i in range(0, len(a), _ROWS):
        rows = a[i : i + _ROWS, None]
        lo, hi = np.searchsorted(pops_b, pops_a[i] - radius, "left"), np.searchsorted(pops_b, pops_a[min(i + _ROWS, len(a)) - 1] + radius, "right")
        for j in range(max(lo, i) if not base else lo, hi, _COLS):
            near = np.bitwise_count(rows ^ b[None, j : min(j + _COLS, hi)]) <= radius
            if not near.any():
                continue
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                own = label[i + r]
                others = label[base + j + np.flatnonzero(near[r])]
                others = np.unique(others[others != own])
                if len(others):
                    links += [(int(nodes[i + r]), int(nodes[x])) for x in others]
                    label[np.isin(label, others)] = own
    return links


def links(fps: DataFrame, *, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """src, dst: links that connect the distinct fingerprints (fp long) just as all pairs within radius do."""
    items = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    tiling = tiles.write(fps.select(F.bit_count("fp").cast("int").alias("pop"), F.col("fp").alias("key"), items.alias("item")), tile, "tiles")
    kind = np.dtype(">u8")

    def run(a, b):
        sides = [tiling.read(x, kind).astype(np.uint64) for x in dict.fromkeys((a, b))]
        found = np.array(join_tiles(sides[0], sides[1] if a < b else None, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["src", "dst"])

    return tiles.pairs(fps.sparkSession, tiling, radius, run, "src long, dst long")


def classes(fps: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """fp, root: for each distinct fingerprint of fps (fp long) the least one, as a signed number, that links reach."""
    distinct = _shared.materialize(fps.select("fp").distinct(), "fingerprints")
    roots = components(links(distinct, radius=radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of df: doc_id, fingerprint (16 hex digits), component_id (the least id in its class).

    Equal fingerprints are one node, so copies make no pairs. Texts without
    words, null ones included, share the fingerprint zero and link like any
    other. A null id keeps its row and is never a component_id while its class
    has another. An empty table gives no rows; other columns don't matter,
    whatever their names.
    """
    rows = _shared.positional(df).select(_shared.column(df, id_col).cast("long").alias("doc_id"), _shared.column(df, text_col).alias("text"))
    fps = _shared.materialize(with_fingerprint(rows, size=size, carry=["doc_id"]), "doc-fingerprints")
    return _members(fps, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(fps: DataFrame, radius: int) -> DataFrame:
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = _shared.materialize(classes(fps, radius=radius).join(least, "fp"), "classes")
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the least document that it reaches over links of at most 4 bits."""
    return near_duplicates(_shared.table(spark, sf_dir, "documents"))
