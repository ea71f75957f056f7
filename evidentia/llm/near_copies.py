"""Near copies: wide SimHash fingerprints in tiles propose, shared word shingles decide.

Each distinct set of five-word shingles is one node. Its fingerprint is a
SimHash of 256 bits, of which two sets that share 4/5 of their union differ in
some 39 on average: HEAD and RADIUS leave room for more than four standard
deviations. All pairs of tiles are compared by exclusive or and bit counts; the
first 64 bits alone settle most pairs. What lies within the radius is held
against the sets' bitmaps, which bound how much two sets can share from above,
and the pairs that could share 4/5 against the sets themselves: no pair of a
lesser similarity ever links. Within a pair of tiles, sets that are already
connected are not compared again, so a group of copies makes as many links as it
has members and not all its pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared, tiles
from evidentia.llm.components import components
from evidentia.llm.simhash import majority, shingle_hashes

SHINGLE = 5
#: Bits that may differ, of the first 64 and of all 256.
HEAD, RADIUS = 22, 64
TILE, WORDS, SLOTS = 1 << 12, 4, 1 << 12
#: Bytes of shingle sets in one file.
FILE_BYTES = 4 << 20
_ROWS, _COLS, _TEXTS, _STEP = 64, 4096, 1024, 1024
_ITEM = np.dtype([("node", "<i8"), ("size", "<i4"), ("fp", "<u8", (WORDS,)), ("bits", "<u8", (SLOTS // 64,))])


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order; none without words."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, WORDS): the SimHash of each set, whose further words come from hashes of the shingles' hashes; an empty set has zeros."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    out = np.empty((len(sets), WORDS), np.uint64)
    for k in range(WORDS):
        h = flat
        if k:  # the finishing steps of a 64-bit generator, one start for each word
            h = flat + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        out[:, k] = majority(h, counts)
    return out


def items(sets: list[np.ndarray]) -> np.ndarray:
    """What a tile holds of each set."""
    from xxhash import xxh3_64_intdigest

    out = np.zeros(len(sets), _ITEM)
    out["node"] = [xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
    out["size"] = [len(s) for s in sets]
    out["fp"] = fingerprints(sets)
    slots = np.zeros((len(sets), SLOTS), bool)
    slots[np.repeat(np.arange(len(sets)), out["size"]), np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(32) & np.uint64(SLOTS - 1)] = True
    out["bits"] = np.packbits(slots, axis=1, bitorder="little").view("<u8")
    return out


class Tile:
    """The items of one tile by column, and how many shingles of each have no slot of their own."""

    def __init__(self, own: np.ndarray):
        self.node, self.size = own["node"].copy(), own["size"].astype(np.int64)
        self.fp, self.bits = np.ascontiguousarray(own["fp"].T), np.ascontiguousarray(own["bits"])
        self.crowded = self.size - np.bitwise_count(self.bits).sum(1, dtype=np.int64)


def close(a: Tile, b: Tile, same: bool, wanted):
    """Blocks of index pairs (into a, into b) that may share 4/5 of their union; wanted(i, j) says which are still of interest."""
    for lo in range(0, len(a.node), _ROWS):
        for at in range(0, len(b.node), _COLS):
            head = np.bitwise_count(a.fp[0][lo : lo + _ROWS, None] ^ b.fp[0][None, at : at + _COLS])
            i, j = np.nonzero(head <= HEAD)
            wrong = head[i, j].astype(np.int64)
            i, j = i + lo, j + at
            for k in range(1, WORDS):
                wrong += np.bitwise_count(a.fp[k][i] ^ b.fp[k][j])
            n, m = a.size[i], b.size[j]
            fits = (wrong <= RADIUS) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            if same:
                fits &= i < j
            i, j = i[fits], j[fits]
            for k in range(0, len(i), _STEP):
                x, y = i[k : k + _STEP], j[k : k + _STEP]
                use = wanted(x, y)
                x, y = x[use], y[use]
                shared = np.bitwise_count(a.bits[x] & b.bits[y]).sum(1, dtype=np.int64) + np.minimum(a.crowded[x], b.crowded[y])
                use = 9 * shared >= 4 * (a.size[x] + b.size[y])
                if use.any():
                    yield x[use], y[use]


@lru_cache(maxsize=16)
def _sets(uri: str) -> dict[int, np.ndarray]:
    """The shingle sets of a file: for each its node, its size and its hashes."""
    flat, out, at = np.frombuffer(tiles.read(uri), "<u8"), {}, 0
    while at < len(flat):
        n = int(flat[at + 1])
        out[int(flat[at].astype("<i8"))] = flat[at + 2 : at + 2 + n]
        at += 2 + n
    return out


def _proposed(nodes: DataFrame, tiling: tiles.Tiling) -> DataFrame:
    """a, b, node: the nodes of each pair of tiles that may share 4/5 with another there."""

    def run(a, b):
        x = Tile(tiling.read(a, _ITEM))
        y = x if a == b else Tile(tiling.read(b, _ITEM))
        seen = [np.zeros(len(x.node), bool), np.zeros(len(y.node), bool)]
        for i, j in close(x, y, a == b, lambda i, j: ~(seen[0][i] & seen[1][j])):
            seen[0][i] = seen[1][j] = True
        found = np.concatenate([x.node[seen[0]], y.node[seen[1]]])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k)) for k in (a, b)] + [pa.array(found)], ["a", "b", "node"]) if len(found) else None

    return tiles.pairs(nodes.sparkSession, tiling, RADIUS, run, "a long, b long, node long")


def _confirmed(pairs: DataFrame, tiling: tiles.Tiling, path: str, files: int) -> DataFrame:
    """src, dst: for each pair of tiles links that connect its nodes as all pairs of similarity 4/5 or more do, as few as do."""

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = Tile(tiling.read(a, _ITEM))
                y = x if a == b else Tile(tiling.read(b, _ITEM))
                base = 0 if a == b else len(x.node)
                label, links = np.arange(base + len(y.node)), []

                def of(tile, node):
                    return _sets(f"{path}/sets-{tile}-{node % files}")[node]

                for i, j in close(x, y, a == b, lambda i, j: label[i] != label[base + j]):  # noqa: B023  used before they change
                    while len(i):
                        own, other = int(x.node[i[0]]), int(y.node[j[0]])
                        s, t = of(a, own), of(b, other)
                        if 9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t)):
                            links.append((own, other))
                            label[label == label[base + j[0]]] = label[i[0]]
                        use = label[i] != label[base + j]
                        use[0] = False
                        i, j = i[use], j[use]
                found = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["src", "dst"])

    return _shared.map_arrow(pairs, run, "src long, dst long")


def _nodes(marked: DataFrame, names: list[str]) -> DataFrame:
    """node, pop, item of each distinct shingle set, and the best of its rows."""

    def make():
        def of(texts):
            made = np.concatenate([items([shingle_set(t) for t in texts[k : k + _TEXTS]]) for k in range(0, len(texts), _TEXTS)])
            pops = np.bitwise_count(made["fp"]).sum(1).astype(np.int32)
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_ITEM.itemsize), len(made), [None, pa.py_buffer(made.tobytes())])
            return pa.StructArray.from_arrays([pa.array(made["node"].copy()), pa.array(made["size"].copy()), pa.array(pops), whole.cast(pa.binary())], ["node", "size", "pop", "item"])

        return of

    made = _shared.annotate(marked, "text", make, "struct<node: long, size: int, pop: int, item: binary>", carry=names, name="made")
    made = made.groupBy("made.node").agg(F.min(F.struct(*names)).alias("best"), F.max(F.struct("made.size", "made.pop", "made.item")).alias("of"))
    return _shared.materialize(made.select("node", "best", "of.*"), "nodes")


def links(nodes: DataFrame, marked: DataFrame, names: list[str]) -> DataFrame:
    """src, dst: links that connect the nodes just as all their pairs of similarity 4/5 or more do."""
    tiling = tiles.write(nodes.select("pop", F.col("node").alias("key"), "item"), TILE, "near-tiles")
    proposed = _shared.materialize(_proposed(nodes, tiling), "proposed")
    ends = nodes.join(proposed.select("node").distinct(), "node").withColumn("tile", tiling.number("pop", "node")) if tiling.n else nodes.withColumn("tile", F.lit(0).cast("long"))
    ends = _shared.materialize(ends.select("node", "tile", "size", "best.*"), "proposed-nodes")
    most = ends.groupBy("tile").agg(F.sum(8 * F.col("size") + 16).alias("n")).agg(F.max("n")).first()[0] or 0
    files = max(1, -(-most // FILE_BYTES))
    texts = marked.join(ends.drop("size"), names).select("node", "tile", "text").dropDuplicates(["node"])

    path = _shared.scratch(nodes.sparkSession, "shingle-sets")

    def framed(batches):
        for batch in batches:
            for lo, n in _shared.text_slices(batch.column(2)):
                node, tile, text = (c.to_pylist() for c in batch.slice(lo, n).columns)
                sets = [shingle_set(t).astype("<u8") for t in text]
                whole = [np.array([k, len(s)], "<i8").tobytes() + s.tobytes() for k, s in zip(node, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"sets-{t}-{k % files}" for t, k in zip(tile, node, strict=True)]), pa.array(whole, pa.binary())], ["name", "item"])

    tiles.write_groups(_shared.map_arrow(texts, framed, "name string, item binary"), path, "name")
    pairs = proposed.select("a", "b").distinct().repartition(4 * _shared.partitions(nodes.sparkSession))
    return _shared.materialize(_confirmed(pairs, tiling, path, files), "near-links")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with the columns that they have, one left of each class that links of similarity 4/5 or more connect: that of the least id (null last), then the least hash of the text.

    Repeated rows count as one. Texts without words, null ones included, are
    one class; a text of fewer than five words has one shingle. An empty table
    gives no rows.
    """
    flat, names = _shared.positional(df), ["no_id", "id", "hash"]
    own, text = _shared.column(df, id_col), _shared.column(df, text_col)
    key = [own.isNull().alias("no_id"), F.coalesce(own.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash")]
    marked = flat.select(text.alias("text"), *key)
    nodes = _nodes(marked, names)
    roots = components(links(nodes, marked, names))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.*")
    kept = _shared.materialize(kept, "kept")
    left = flat.select("*", *key).join(kept, names, "left_semi").dropDuplicates(names)
    return left.select(*flat.columns).toDF(*df.columns)
