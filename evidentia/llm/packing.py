"""Best-fit packing of token sequences by exact complements.

Only counts of lengths reach the driver, at most one for each length up to the
capacity. The plan is a list of patterns (the lengths that share a sequence)
with how many sequences use each: lengths are taken from the longest down, the
gap that one leaves is looked up among single lengths, sums of two and sums of
three, and as many sequences are filled exactly as the counts allow; what finds
no complement goes, longest first, to the smallest gap that holds it. Of the
complements of one kind that with the longest piece counts, which spares short
pieces for gaps that nothing else fills. Filling much exactly can leave residuals
that fit badly, so plans with complements of up to three, two, one and no pieces,
of any length or of longer ones only, are made, and the one with the fewest
sequences is used: it never has more than best fit by itself. Each piece then finds its place by its rank among the pieces
of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import _shared
from evidentia.llm.encode import default_path, encoder

CAPACITY = 1024
#: Most pieces of a complement, and the share of the capacity that each has at least: shorter ones are left for residuals.
TRIALS = ((3, 0.25), (3, 0.05), (3, 0), (2, 0.25), (2, 0.05), (2, 0), (1, 0), (0, 0))


def cut(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """Encode every text and cut it into pieces of at most capacity tokens, of which the first takes the remainder.

    Columns: doc_id, piece, start, length, ids_crc32, ids (little-endian, two
    bytes an id, four for a vocabulary beyond 65,536), part and nth (the rank
    among the task's pieces of that length). A null text is empty; a text
    without any token makes no piece. Repeated rows and ids, null ids among them,
    are cut one by one; an empty table gives no rows; other columns don't matter,
    whatever their names.
    """
    tokenizer = tokenizer or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"]

    def run(batches):
        enc = encoder(tokenizer)
        size = enc.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, n_rows in _shared.text_slices(texts):
                rows = []
                for doc_id, raw in zip(ids.slice(lo, n_rows).to_pylist(), enc.encode(texts.slice(lo, n_rows)), strict=True):
                    raw = bytes(raw) + end
                    n, at = len(raw) // size, 0
                    for piece in range(-(-n // capacity)):
                        length = (n % capacity or capacity) if piece == 0 else capacity
                        own = raw[at * size : (at + length) * size]
                        rows.append((doc_id, piece, at, length, zlib.crc32(np.frombuffer(own, enc.dtype).astype("<u4").tobytes()), own, part, seen[length]))
                        seen[length] += 1
                        at += length
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = _shared.positional(df).select(_shared.column(df, id_col).cast("long").alias("doc_id"), _shared.column(df, text_col).alias("text"))
    return _shared.map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part long, nth long")


def _complement(counts: np.ndarray, first: int, gap: int, most: int, least: int) -> tuple[int, ...] | None:
    """Available lengths, from least up to first and at most so many, that sum to gap: one, else two, else three, of each kind the combination with the longest piece."""
    if most and least <= gap <= first and counts[gap] > (gap == first):
        return (gap,)
    top = min(first, gap - 1)
    spare = counts[: top + 1].copy()
    spare[first : first + 1] -= 1  # the piece that leaves the gap is in use
    spare[:least] = 0

    def two(g: int, most: int) -> tuple[int, int] | None:
        a = np.arange(min(most, g - 1), (g + 1) // 2 - 1, -1)
        have = np.flatnonzero((spare[a] > (a == g - a)) & (spare[g - a] > 0))
        return (int(a[have[0]]), g - int(a[have[0]])) if len(have) else None

    if most > 1 and (found := two(gap, top)):
        return found
    for a in np.flatnonzero(spare > 0)[::-1].tolist() if most > 2 else ():
        if 3 * a < gap:
            break
        if gap - a < 2:
            continue
        spare[a] -= 1
        found = two(gap - a, min(a, gap - a - 1))
        spare[a] += 1
        if found:
            return a, *found
    return None


def plan(counts_by_length: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences use each; every counted piece is in exactly one. Of the plans for TRIALS the first with the fewest sequences."""
    return min((_plan(counts_by_length, capacity, most, max(1, int(share * capacity))) for most, share in TRIALS), key=lambda made: sum(n for _, n in made))


def _plan(counts_by_length: dict[int, int], capacity: int, most: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in counts_by_length.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens cannot be packed into {capacity}")
        counts[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        made.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    for first in range(capacity - 1, 0, -1):
        while counts[first] > 0 and (rest := _complement(counts, first, capacity - first, most, least)):
            pattern = (first, *rest)
            uses = Counter(pattern)
            n = min(int(counts[x]) // k for x, k in uses.items())
            for x, k in uses.items():
                counts[x] -= n * k
            made.append((pattern, n))
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in range(capacity - 1, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g, bins in gaps.items() if g >= length and bins), default=None)
            if gap is None:
                each = capacity // length
                for n, bins in ((each, left // each), (left % each, 1)):
                    if n and bins:
                        gaps[capacity - n * length][(length,) * n] = bins
                left = 0
                continue
            pattern, bins = next(iter(gaps[gap].items()))
            n = min(left, bins)
            if n == bins:
                del gaps[gap][pattern]
            else:
                gaps[gap][pattern] = bins - n
            wider = gaps[gap - length]
            wider[(*pattern, length)] = wider.get((*pattern, length), 0) + n
            left -= n
    return made + [(pattern, n) for bins in gaps.values() for pattern, n in bins.items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length an array of rows (first rank, first sequence, offset): where the pieces of that length go, by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: Counter = Counter()
    sequence = 0
    for pattern, n in patterns:
        at = 0
        for length in pattern:
            runs[length].append((taken[length], sequence, at))
            taken[length] += n
            at += length
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in runs.items()}


def place(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of cut()'s pieces, read from a written table, its sequence_id and offset.

    The tasks' own ranks become ranks over all pieces through the sums of the
    counts by length of the tasks before: no length's pieces meet in one task.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = _shared.materialize(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    totals = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(totals, capacity))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(lengths), 2), np.int64)
        for n in np.unique(lengths).tolist():
            rows, runs = np.flatnonzero(lengths == n), where[n]
            k = np.searchsorted(runs[:, 0], ranks[rows], side="right") - 1
            out[rows, 0] = runs[k, 1] + ranks[rows] - runs[k, 0]
            out[rows, 1] = runs[k, 2]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    ranked = pieces.join(by_part.select("part", "length", "base"), ["part", "length"])
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    return ranked.withColumn("at", find("length", F.col("base") + F.col("nth"))).select(*kept, "at.sequence_id", "at.offset")


def pack(df: DataFrame, **options) -> DataFrame:
    """Cut and place every text of df; options are those of cut(). Columns: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    An empty table gives no rows; repeated rows and ids are packed one by one.
    """
    return place(_shared.materialize(cut(df, **options), "packing-pieces"), capacity=options.get("capacity", CAPACITY))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (concatenated in order of offset), doc_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    return rows.select("sequence_id", "length", ids.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents with the end id 2, packed into sequences of at most 1024 tokens."""
    return pack(_shared.table(spark, sf_dir, "documents")).drop("ids")
