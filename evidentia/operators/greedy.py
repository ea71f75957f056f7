"""Ordered greedy steps over one picture's few boxes.

A group is one picture, whose boxes are few; ties are taken in the order of
seq, so that results don't depend on the order of arrival. Groups are not given
a frame each: sorted partitions are read in batches, one group after another.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.shipping import ship

SIDES = ["x0", "y0", "x1", "y1"]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared area of every box of a with every box of b; axes before the last two are groups side by side, here and in all scores."""
    a, b = a[..., :, None, :], b[..., None, :, :]
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def _area(a: np.ndarray) -> np.ndarray:
    return (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1])


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    common = _common(a, b)
    return common / np.maximum(1, _area(a)[..., :, None] + _area(b)[..., None, :] - common)


def smaller_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _common(a, b) / np.maximum(1, np.minimum(_area(a)[..., :, None], _area(b)[..., None, :]))


def script_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(iou_matrix(a, b), 0.82 * smaller_matrix(a, b))


def assign(scores: np.ndarray, least: float) -> np.ndarray:
    """For each row in turn the free column of the highest score, the first on ties; -1 where that is below least."""
    scores = scores.astype(float).copy()
    out = np.full(scores.shape[:-1], -1)
    if not scores.size:
        return out
    flat, found = scores.reshape(-1, *scores.shape[-2:]), out.reshape(-1, out.shape[-1])
    groups = np.arange(len(flat))
    for i in range(out.shape[-1]):
        k = flat[:, i].argmax(axis=1)
        best = flat[groups, i, k]
        taken = (best >= least) & (best > 0)
        found[taken, i] = k[taken]
        flat[groups[taken], :, k[taken]] = -1.0
    return out


def _starts(keys: pd.Series) -> np.ndarray:
    """Where a new group begins, null keys being one group."""
    before = keys.shift()
    new = ~((keys == before) | (keys.isna() & before.isna())).to_numpy(bool)
    new[:1] = True
    return np.flatnonzero(new)


class Rows:
    """The rows of one group: columns as arrays, cut from those of a whole batch, since a frame for each small group costs more than its step."""

    __slots__ = ("_columns", "_part", "_size")

    def __init__(self, columns: dict, first: int, end: int):
        self._columns, self._part, self._size = columns, slice(first, end), end - first

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, name: str) -> np.ndarray:
        return self._columns[name][self._part]

    def floats(self, names: list[str]) -> np.ndarray:
        """Several columns side by side."""
        key = tuple(names)
        if key not in self._columns:
            self._columns[key] = np.stack([self._columns[n].astype(float) for n in names], axis=1)
        return self._columns[key][self._part]


def each_group(df: DataFrame, group: str, order: list[str], columns: list[str], names: list[str], types: str, step: Callable, *, together: bool = False) -> DataFrame:
    """The rows that step (of Rows) gives for each group's rows in order (- before a column: the greatest first; nulls last; then seq); together: step gets the groups of a batch as a list, and gives a list of rows for each.

    One sort in each partition and one pass over its batches; of a partition
    only the rows of the group in turn and one batch are held.
    """
    ship(df.sparkSession)
    keys = [c.removeprefix("-") for c in order]
    by = [F.col(k).desc_nulls_last() if c.startswith("-") else F.col(k).asc_nulls_last() for c, k in zip(order, keys, strict=True)]
    cols = list(dict.fromkeys([group, "seq", *keys, *columns]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[group, *names]).astype(object)

        def whole(pdf: pd.DataFrame, starts: np.ndarray) -> list[tuple]:
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            parts = zip(pdf[group].iloc[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True)
            keys, groups = zip(*((key, Rows(columns, i, k)) for key, i, k in parts), strict=True)
            found = step(list(groups)) if together else map(step, groups)
            return [(None if pd.isna(key) else key, *row) for key, rows in zip(keys, found, strict=True) for row in rows]

        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            starts = _starts(pdf[group])
            held = pdf.iloc[starts[-1] :]
            if len(starts) > 1:
                yield made(whole(pdf.iloc[: starts[-1]], starts[:-1]))
        if held is not None and len(held):
            yield made(whole(held, np.array([0])))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told by number, so that small rows with much to do aren't brought together
    ordered = df.select(cols).repartition(n, group).sortWithinPartitions(F.col(group), *by, F.col("seq"))
    return ordered.mapInPandas(run, f"{group} long, {types}")


#: Rows that a step over whole batches gets at least, and numbers that it holds at once for groups of one shape.
_BATCH_ROWS, _HELD = 1 << 16, 1 << 20


def each_batch(df: DataFrame, group: str, order: list[str], columns: list[str], names: list[str], types: str, step: Callable, *, kept: Sequence[str] = ()) -> DataFrame:
    """each_group() for steps over many groups side by side: step gets columns as arrays, those kept as Arrow arrays (of whole groups, one after the other) and where each group starts, and gives the rows whose groups its results belong to and an array for each of names."""
    ship(df.sparkSession)
    keys = [c.removeprefix("-") for c in order]
    by = [F.col(k).desc_nulls_last() if c.startswith("-") else F.col(k).asc_nulls_last() for c, k in zip(order, keys, strict=True)]
    cols = list(dict.fromkeys([group, *columns, *kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            rows, arrays = step({c: batch.column(k) if c in kept else batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(cols)}, starts)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(x if isinstance(x, pa.Array) else pa.array(x) for x in arrays)], [group, *names])

        parts, size, wanted = [], 0, _BATCH_ROWS
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size < wanted:
                continue
            whole = pa.concat_batches(parts)
            starts = _starts(whole.column(0).to_pandas())
            if len(starts) > 1:
                yield made(whole.slice(0, starts[-1]), starts[:-1])
            parts, size = [whole.slice(starts[-1])], size - int(starts[-1])
            wanted = max(_BATCH_ROWS, 2 * size)
        if size:
            whole = pa.concat_batches(parts)
            yield made(whole, _starts(whole.column(0).to_pandas()))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told by number, so that small rows with much to do aren't brought together
    ordered = df.select(list(dict.fromkeys([*cols, "seq", *keys]))).repartition(n, group).sortWithinPartitions(F.col(group), *by, F.col("seq")).select(cols)
    return ordered.mapInArrow(run, f"{group} long, {types}")


def _shapes(*sizes: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each combination of sizes that groups have, with those groups, as many at a time as may be held."""
    code, at = np.unique(np.stack(sizes, axis=1), axis=0, return_inverse=True)
    order = np.argsort(at.ravel(), kind="stable")
    for shape, groups in zip(code.tolist(), np.split(order, np.cumsum(np.bincount(at.ravel()))[:-1]), strict=True):
        n = max(1, _HELD // max(1, sum(shape)) ** 2)
        for k in range(0, len(groups), n):
            yield tuple(shape), groups[k : k + n]


def _sides(columns: dict) -> np.ndarray:
    return np.stack([columns[c].astype(float) for c in SIDES], axis=1)


def match_one_to_one(left: DataFrame, right: DataFrame, group: str = "image_id", *, least: float = 0.30, score: Callable = iou_matrix, kept: tuple[str, ...] = ()) -> DataFrame:
    """Full outer one-to-one matching in order of the left rows: group, left_seq, right_seq, score (rounded to six places), and columns kept of both as left_ and right_; null where one has no partner."""

    def step(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, list]:
        boxes, seq = _sides(columns), columns["seq"]
        right = np.add.reduceat(columns["__second"].astype(int), starts)
        left = np.diff(np.append(starts, len(seq))) - right  # those of the left come first
        pairs, alone = [], [np.zeros((2, 0), int)]
        for (n, m), groups in _shapes(left, right):
            p = starts[groups, None] + np.arange(n)
            q = starts[groups, None] + n + np.arange(m)
            s = score(boxes[p], boxes[q])
            got = assign(s, least)
            g, i = np.nonzero(got >= 0)
            k = got[g, i]
            pairs.append((p[g, i], q[g, k], s[g, i, k]))
            free = np.ones((len(groups), m), bool)
            free[g, k] = False
            alone += [np.stack([x[where], np.full(int(where.sum()), side)]) for x, where, side in ((p, got < 0, 0), (q, free, 1))]
        i, j, scores = (np.concatenate([x[k] for x in pairs]) for k in range(3))
        rest, side = np.concatenate(alone, axis=1)
        l, r = np.concatenate([i, rest]), np.concatenate([j, rest])
        no_left, no_right = np.concatenate([np.zeros(len(i), bool), side == 1]), np.concatenate([np.zeros(len(i), bool), side == 0])
        rounded = pa.array([*(round(x, 6) for x in scores.tolist()), *[None] * len(rest)], pa.float64())
        told = [pa.array(seq[l].astype(np.int64), mask=no_left), pa.array(seq[r].astype(np.int64), mask=no_right), rounded]
        return l, told + [columns[c].take(pa.array(x, mask=no)) for x, no in ((l, no_left), (r, no_right)) for c in kept]

    both = [df.select(group, "seq", *SIDES, *kept, F.lit(second).alias("__second")) for df, second in ((left, False), (right, True))]
    both = both[0].unionByName(both[1])
    more = [(f"{side}_{c}", both.schema[c].dataType.simpleString()) for side in ("left", "right") for c in kept]
    names = ["left_seq", "right_seq", "score", *(c for c, _ in more)]
    types = ", ".join(["left_seq long, right_seq long, score double", *(f"{c} {kind}" for c, kind in more)])
    return each_batch(both, group, ["__second"], ["seq", *SIDES, "__second"], names, types, step, kept=kept)


def fuse_readings(matched: DataFrame, base: DataFrame, second: DataFrame, group: str = "image_id") -> DataFrame:
    """One reading for each row of match_one_to_one(): equal texts agree and keep the surer one; others keep the base unless the second is surer by 0.08.

    base and second: group, seq, text, confidence. Returns group, left_seq,
    right_seq, text, confidence, verified, method.
    """
    a = base.select(group, F.col("seq").cast("long").alias("left_seq"), F.col("text").alias("ta"), F.col("confidence").alias("ca"))
    b = second.select(group, F.col("seq").cast("long").alias("right_seq"), F.col("text").alias("tb"), F.col("confidence").alias("cb"))
    return _fused(matched.join(a, [group, "left_seq"], "left").join(b, [group, "right_seq"], "left"), group)


def match_and_fuse(base: DataFrame, second: DataFrame, group: str = "image_id") -> DataFrame:
    """fuse_readings() of base and second matched one to one; the readings stay with their boxes, so that no join looks them up again."""
    matched = match_one_to_one(base, second, group, kept=("text", "confidence"))
    return _fused(matched.withColumnsRenamed({"left_text": "ta", "left_confidence": "ca", "right_text": "tb", "right_confidence": "cb"}), group)


def _fused(j: DataFrame, group: str) -> DataFrame:
    from evidentia.functions.text import reading_text

    both = F.col("left_seq").isNotNull() & F.col("right_seq").isNotNull()
    agree = both & (reading_text(F.col("ta")) == reading_text(F.col("tb")))
    surer = both & F.when(agree, F.col("cb") > F.col("ca")).otherwise(F.col("cb") >= F.col("ca") + 0.08)
    take = surer | F.col("left_seq").isNull()
    method = F.when(agree, "consensus").when(both, "disagreement").when(F.col("left_seq").isNull(), "unmatched").otherwise("single")
    verified = F.when(agree, True).when(both | F.col("left_seq").isNull(), False).otherwise(F.col("ca") >= 0.90)
    return j.select(group, "left_seq", "right_seq", F.when(take, F.col("tb")).otherwise(F.col("ta")).alias("text"), F.bround(F.when(take, F.col("cb")).otherwise(F.col("ca")), 3).alias("confidence"), verified.alias("verified"), method.alias("method"))


def suppress(df: DataFrame, group: str, order: list[str], most_overlap: float, *, limit: int | None = None, score: Callable = smaller_matrix, standing: Sequence[tuple[DataFrame, Callable]] = ()) -> DataFrame:
    """Rows of each group in turn unless a kept one overlaps them by more: group, seq, rank. limit keeps that many, as a feature.

    standing: boxes that were there before, each table with what says for boxes a and b of a group whether
    b rules a out.
    """

    rules = [rule for _, rule in standing]

    def ruled_out(boxes: np.ndarray, others: np.ndarray, rule: Callable) -> np.ndarray:
        step = max(1, _HELD // max(1, len(boxes) * others.shape[1]))
        return np.concatenate([rule(boxes[:, k : k + step], others).any(axis=2) for k in range(0, boxes.shape[1], step)], axis=1)

    def step(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, list]:
        boxes, seq, kind = _sides(columns), columns["seq"], columns["__kind"]
        sizes = [np.add.reduceat((kind == k).astype(int), starts) for k in range(len(rules) + 1)]
        rows, ranks = [np.zeros(0, int)], [np.zeros(0, int)]
        for (n, *others), groups in _shapes(*sizes):
            if not n:
                continue
            at = starts[groups, None] + np.arange(n)
            own = boxes[at]
            free, first = np.ones((len(groups), n), bool), n
            for rule, m in zip(rules, others, strict=True):
                if m:
                    free &= ~ruled_out(own, boxes[starts[groups, None] + first + np.arange(m)], rule)
                first += m
            kept, count = np.zeros((len(groups), n), bool), np.zeros(len(groups), int)
            for i in range(n):
                some = np.flatnonzero(kept[0, :i]) if len(groups) == 1 else slice(0, i)
                s = np.where(kept[:, None, some], score(own[:, i : i + 1], own[:, some]), -np.inf)
                kept[:, i] = free[:, i] & (~kept[:, :i].any(axis=1) | (s.max(axis=(1, 2), initial=-np.inf) <= most_overlap))
                if limit:
                    kept[:, i] &= count < limit
                count += kept[:, i]
            g, i = np.nonzero(kept)
            rows.append(at[g, i])
            ranks.append(kept.cumsum(axis=1)[g, i])
        rows, ranks = np.concatenate(rows), np.concatenate(ranks)
        return rows, [seq[rows].astype(np.int32), ranks.astype(np.int32)]

    keys = list(dict.fromkeys(c.removeprefix("-") for c in order))
    cols = list(dict.fromkeys([group, "seq", *SIDES, *keys]))
    rows = df.select(*cols, F.lit(0).alias("__kind"))
    for k, (others, _) in enumerate(standing, 1):
        rows = rows.unionByName(others.select(group, "seq", *SIDES, F.lit(k).alias("__kind")), allowMissingColumns=True)
    return each_batch(rows, group, ["__kind", *order], ["seq", *SIDES, "__kind"], ["seq", "rank"], "seq int, rank int", step)


def first_fit(df: DataFrame, group: str, order: list[str], bands: Callable[[int], Bands]) -> DataFrame:
    """Each row in turn joins the first band that takes it, or begins one: group, seq, band."""

    def step(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, list]:
        boxes, out = _sides(columns), np.zeros(len(columns["seq"]), np.int32)
        for (n,), groups in _shapes(np.diff(np.append(starts, len(boxes)))):
            made, count, each = bands(len(groups)), np.zeros(len(groups), int), np.arange(len(groups))
            for i in range(n):
                own = boxes[starts[groups] + i]
                takes = made.takes(own) & (np.arange(made.width) < count[:, None])
                k = np.where(takes.any(axis=1), takes.argmax(axis=1), count) if made.width else count.copy()
                if k.max() == made.width:
                    made.widen()
                made.add(each, k, own, k == count)
                count = np.maximum(count, k + 1)
                out[starts[groups] + i] = k + 1
        return np.arange(len(out)), [columns["seq"].astype(np.int32), out]

    return each_batch(df, group, order, ["seq", *SIDES], ["seq", "band"], "seq int, band int", step)


class Bands:
    """What the bands of some groups (a row for each, width bands in it) remember of their members: enough to say which take one more."""

    def __init__(self, groups: int, kept: int):
        self.kept = np.zeros((kept, groups, 0))

    @property
    def width(self) -> int:
        return self.kept.shape[2]

    def widen(self) -> None:
        self.kept = np.concatenate([self.kept, np.zeros((*self.kept.shape[:2], max(1, self.width)))], axis=2)

    def takes(self, boxes: np.ndarray) -> np.ndarray:
        """For each group's box which of its bands take it."""
        raise NotImplementedError

    def add(self, groups: np.ndarray, band: np.ndarray, boxes: np.ndarray, new: np.ndarray) -> None:
        """Each group's box joins that band, or begins it where it is new."""
        raise NotImplementedError


class SameColumn(Bands):
    """Takes a box whose centre is at most tolerance from that of the last member in x."""

    def __init__(self, tolerance: float, groups: int):
        super().__init__(groups, 1)
        self.tolerance = tolerance

    def takes(self, boxes):
        return np.abs((boxes[:, 0] + boxes[:, 2])[:, None] / 2 - self.kept[0]) <= self.tolerance

    def add(self, groups, band, boxes, new):
        self.kept[0, groups, band] = (boxes[:, 0] + boxes[:, 2]) / 2


class SameRow(Bands):
    """Takes a box that overlaps the extent of all members by that share of the lesser height."""

    def __init__(self, least: float, groups: int):
        super().__init__(groups, 2)
        self.least = least

    def takes(self, boxes):
        (top, bottom), y0, y1 = self.kept, boxes[:, 1, None], boxes[:, 3, None]
        return np.minimum(y1, bottom) - np.maximum(y0, top) >= self.least * np.minimum(y1 - y0, bottom - top)

    def add(self, groups, band, boxes, new):
        top, bottom = self.kept[:, groups, band]
        self.kept[0, groups, band] = np.where(new, boxes[:, 1], np.minimum(top, boxes[:, 1]))
        self.kept[1, groups, band] = np.where(new, boxes[:, 3], np.maximum(bottom, boxes[:, 3]))


def same_column(tolerance: float) -> Callable[[int], Bands]:
    return lambda groups: SameColumn(tolerance, groups)


def same_row(least: float) -> Callable[[int], Bands]:
    return lambda groups: SameRow(least, groups)


def running_mean_clusters(df: DataFrame, group: str, value: str, tolerance: float) -> DataFrame:
    """Sorted values join the last cluster while they are within tolerance of its mean so far: group, cluster, n, mean."""

    def step(pdf: Rows) -> list[tuple]:
        sums: list[float] = []
        sizes: list[int] = []
        for v in pdf[value].tolist():
            if not sums or abs(v - sums[-1] / sizes[-1]) > tolerance:
                sums.append(0)
                sizes.append(0)
            sums[-1] += v
            sizes[-1] += 1
        return [(k + 1, n, s / n) for k, (s, n) in enumerate(zip(sums, sizes, strict=True))]

    rows = df if "seq" in df.columns else df.withColumn("seq", F.lit(0))
    return each_group(rows, group, [value], [], ["cluster", "n", "mean"], "cluster int, n long, mean double", step)


def within_budget(df: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows of each group in turn while their summed cost fits the budget; what doesn't fit is passed over: group, seq, spent."""

    def step(pdf: Rows) -> list[tuple]:
        out, spent = [], 0
        for seq, price in zip(pdf["seq"].tolist(), pdf[cost].tolist(), strict=True):
            if spent + price <= budget:
                spent += int(price)
                out.append((seq, spent))
        return out

    return each_group(df, group, order, [cost], ["seq", "spent"], "seq int, spent int", step)


def closeness(left: str, right: str, least: float = 0.0) -> float:
    """The sequence ratio of two texts; 0 without a comparison where the characters they share, at most the fewer of each, could not reach least."""
    total = len(left) + len(right)
    if least and total and (2 * min(len(left), len(right)) < least * total or 2 * (Counter(left) & Counter(right)).total() < least * total):
        return 0.0
    return SequenceMatcher(None, left, right).ratio()


#: Longest texts that are compared side by side, and cells of the tables that are held at once.
_SIDE_BY_SIDE, _CELLS = 199, 1 << 19


def _longest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each column of a and b (texts downwards, padded by -1 and -2) the longest common part, the first in a and then in b on ties: its length times 2^16, and 255 less its two starts in a byte each."""
    first = np.arange(255, 255 - len(b), -1, dtype=np.int32)[:, None] + (1 << 16)
    line, best, grown = np.zeros((len(b) + 1, b.shape[1]), np.int32), np.zeros(b.shape, np.int32), np.empty(b.shape, np.int32)
    for i in range(len(a)):
        # along a diagonal the starts stay and the length grows
        np.add(line[:-1], 1 << 16, out=grown)
        np.maximum(grown, first + (255 - i << 8), out=grown)
        np.multiply(grown, b == a[i], out=line[1:])
        np.maximum(best, line[1:], out=best)
    return best.max(axis=0)


#: Longest text whose places are the bits of one number, and numbers of letters that needn't be made less.
_BITS, _FEW_LETTERS = 64, 64


def _subsequence(codes: tuple, starts: list, sizes: list) -> np.ndarray:
    """The longest common subsequence of each pair of texts (up to _SIDE_BY_SIDE letters), which has at least all their common parts together; where both are longer than _BITS, the lesser length. The places of one text are bits, and the other is read along all pairs at once."""
    most = np.minimum(*sizes).astype(np.int64)
    coded, wide = codes, max(int(c.max(initial=0)) for c in codes) + 1
    if wide > _FEW_LETTERS:
        letters = np.unique(np.concatenate(codes))
        coded, wide = [np.searchsorted(letters, c) for c in codes], len(letters)
    for i, some in ((0, sizes[0] <= _BITS), (1, (sizes[0] > _BITS) & (sizes[1] <= _BITS))):
        rows = np.flatnonzero(some & (most > 0))
        rows = rows[np.argsort(-sizes[1 - i][rows], kind="stable")]
        step = max(1, (1 << 22) // wide)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            texts, own = np.unique(starts[i][part] << 8 | sizes[i][part], return_inverse=True)
            first, n = texts >> 8, texts & 255
            bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            table = np.zeros(len(texts) * wide, np.uint64)
            np.add.at(table, np.repeat(np.arange(len(texts)) * wide, n) + coded[i][np.repeat(first, n) + bit], np.uint64(1) << bit.astype(np.uint64))
            own, along, size = own * wide, starts[1 - i][part], sizes[1 - i][part]
            left = np.full(len(part), ~np.uint64(0))
            for t in range(int(size[0])):
                m = int(np.searchsorted(-size, -t, "left"))
                free = left[:m]
                met = free & table[own[:m] + coded[1 - i][along[:m] + t]]
                left[:m] = (free + met) | (free - met)
            most[part] = np.bitwise_count(~left & (~np.uint64(0) >> (_BITS - sizes[i][part]).astype(np.uint64)))
    return most


def closenesses(pairs: list[tuple[str, str]], least: float = 0.0) -> np.ndarray:
    """closeness() of each pair, where it reaches least, else any number below: all pairs side by side, those of long texts alone."""
    codes, starts, sizes = [], [], []
    for i in (0, 1):
        at: dict[str, int] = {}
        index = np.array([at.setdefault(pair[i], len(at)) for pair in pairs], np.int64)
        long = np.array([len(text) for text in at], np.int64)
        codes.append(np.frombuffer("".join(at).encode("utf-32-le", "surrogatepass"), np.int32))
        starts.append((np.cumsum(long) - long)[index])
        sizes.append(long[index])
    return closenesses_at(tuple(codes), starts, sizes, least)


def closenesses_at(codes: tuple, starts: list, sizes: list, least: float = 0.0) -> np.ndarray:
    """closenesses() of pairs of texts that are parts of two arrays of code points, by their starts and sizes (int64)."""
    total = sizes[0] + sizes[1]
    out, alone = np.zeros(len(total)), np.maximum(*sizes) > _SIDE_BY_SIDE
    for k in np.flatnonzero(alone).tolist():
        out[k] = closeness(*(c[s[k] : s[k] + n[k]].tobytes().decode("utf-32-le", "surrogatepass") for c, s, n in zip(codes, starts, sizes, strict=True)), least)
    out[total == 0] = 1.0
    side = np.flatnonzero(~alone & (total > 0))
    if least and len(side):
        # what shares too few letters in order cannot be close enough
        most = _subsequence(codes, [x[side] for x in starts], [x[side] for x in sizes])
        side = side[2.0 * most / total[side] >= least]
    if not len(side):
        return out
    sizes = [x[side].astype(np.int32) for x in sizes]
    texts = [(c, x[side]) for c, x in zip(codes, starts, strict=True)]
    matched, total = np.zeros(len(side), np.int64), total[side]
    zero = np.zeros(len(side), np.int32)
    # parts that are still to be compared: pair, from and to in both texts
    parts = np.stack([np.arange(len(side), dtype=np.int32), zero, sizes[0], zero, sizes[1]])
    while True:
        left = np.minimum(parts[2] - parts[1], parts[4] - parts[3])
        most = matched + np.bincount(parts[0], left, len(side)).astype(np.int64)
        parts = parts[:, (left > 0) & (2.0 * most / total >= least)[parts[0]]]
        if not parts.shape[1]:
            break
        high, wide = parts[2] - parts[1], parts[4] - parts[3]
        order = np.lexsort((high, wide))
        found, at = np.zeros(parts.shape[1], np.int32), 0
        while at < len(order):
            n = max(1, _CELLS // 8 // int(wide[order[at]]))
            some = order[at : at + n]
            cut = int(np.searchsorted(wide[some], wide[some[0]] + max(2, int(wide[some[0]]) // 4), "right"))
            some = some[:cut]
            both = []
            for i, size in ((0, high[some]), (1, wide[some])):
                code, starts = texts[i]
                down = np.arange(int(size.max()))[:, None]
                both.append(np.where(down < size, code[np.minimum(starts[parts[0, some]] + parts[1 + 2 * i, some] + down, len(code) - 1)], -1 - i).astype(np.int32))
            found[some] = _longest(*both)
            at += len(some)
        parts, found = parts[:, found > 0], found[found > 0]
        n = found >> 16
        np.add.at(matched, parts[0], n)
        i, j = parts[1] + 255 - (found >> 8 & 255), parts[3] + 255 - (found & 255)
        before, after = np.stack([parts[0], parts[1], i, parts[3], j]), np.stack([parts[0], i + n, parts[2], j + n, parts[4]])
        parts = np.concatenate([before, after], axis=1)
    out[side] = 2.0 * matched / total
    return out


def similarity(left, right, least: float = 0.0):
    """The sequence ratio of two texts, as a pandas function that compares the distinct pairs of a batch side by side; null counts as empty, and what cannot reach least gives less than it."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
        distinct = list(dict.fromkeys(pairs))
        each = dict(zip(distinct, closenesses(distinct, least).tolist(), strict=True))
        return pd.Series([each[pair] for pair in pairs], dtype=float)

    return ratio(left, right)


def dice(left, right):
    """Twice the shared character pairs over all of both texts, as a multiset, in one pass over each; null where neither has a pair or either text is null."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            p, q = (Counter(map(str.__add__, t, t[1:])) for t in (x, y))
            total = max(len(x) - 1, 0) + max(len(y) - 1, 0)
            out.append(2.0 * (p & q).total() / total if total else None)
        return pd.Series(out, dtype=float)

    return share(left, right)
