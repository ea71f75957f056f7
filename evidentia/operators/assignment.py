"""One reading of a whole crop, dealt out to the texts that were measured in it.

Spans of a phrase's words are proposed for each measured text of about as many
words: of each group all that may match are met by arrays, so that none is lost
and no pair leaves the task. Lengths, then letters shared in order, bound the
similarity of what meets before it is computed. The best proposals that don't
overlap win, one for each text. Where measured texts form rows below each other,
the phrase is partitioned among the rows instead: the best sum over rows, for
all first words at once, by products of matrices over (max, plus).
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as texts
from evidentia.operators import greedy, sequences
from evidentia.shipping import ship

WORD = re.compile(r"[^\W_]+(?:['’\-–—][^\W_]+)*")
#: Words that a span may have more or fewer than the text, least ratio of lengths, least similarity, and what a full difference of lengths costs.
SLACK, LEAST_LENGTH, LEAST_SIMILARITY, LENGTH_COST = 2, 0.65, 0.68, 0.08
#: Most rows of a paragraph and words of a row; least ratio of lengths and similarity of a row; least row score, overall similarity and quality of a partition.
ROWS, ROW_WORDS = 6, 8
ROW_LENGTH, ROW_SIMILARITY, ROW_SCORE, OVERALL, QUALITY = 0.45, 0.35, 0.48, 0.55, 0.61


def words(c):
    """Start and end of each word of a text (letters and digits, joined by apostrophes or hyphens), in code points; null has none."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def find(values: pd.Series) -> pd.Series:
        return pd.Series([[{"start": m.start(), "end": m.end()} for m in WORD.finditer(v or "")] for v in values])

    return find(c)


#: Spans beside candidates that are held at once.
_MET = 1 << 20


def _codes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and where each begins, with the end of the last."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    return np.frombuffer("".join(values).encode("utf-32-le"), np.int32), ends


def _proposed(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[str]]:
    """Of the groups of a batch, each with its phrase before its candidates: the candidates' rows and groups, arrays of start, end, length and score, and the segments of the proposals."""
    own = np.zeros(len(columns["__kind"]), np.int64)
    own[starts[1:]] = 1
    own = np.cumsum(own)
    said, shown = (np.flatnonzero(columns["__kind"] == k) for k in (0, 1))
    phrases, found, looks = (columns[c].take(pa.array(said)) for c in ("phrase", "words", "looks"))
    n_words = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first_word = np.cumsum(n_words) - n_words
    first, last = (found.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    text, at = _codes(looks.flatten().to_pylist())
    target, begin = _codes(columns["target"].take(pa.array(shown)).to_pylist())
    size = np.diff(begin)
    n = np.array([max(1, len(WORD.findall(v))) for v in columns["value"].take(pa.array(shown)).to_pylist()], np.int64)
    # each candidate with its group's phrase and each number of words that a span may have
    low, high = (np.searchsorted(own[said], own[shown], side) for side in ("left", "right"))
    c = np.repeat(np.arange(len(shown)), high - low)
    p = np.arange(len(c)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[c]
    count = (n[c][:, None] + np.arange(-SLACK, SLACK + 1)).ravel()
    c, p = np.repeat(c, 2 * SLACK + 1), np.repeat(p, 2 * SLACK + 1)
    fits = (count >= 1) & (count <= n_words[p])
    c, p, count = c[fits], p[fits], count[fits]
    places = n_words[p] - count + 1
    total, k, out = np.cumsum(places), 0, [np.zeros((6, 0))]
    while k < len(c):
        end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _MET, "right")))
        each = np.repeat(np.arange(k, end), places[k:end])
        word = first_word[p[each]] + np.arange(len(each)) - np.repeat(np.cumsum(places[k:end]) - places[k:end], places[k:end])
        long = at[word + count[each]] - at[word]
        wanted = size[c[each]]
        ratio = np.minimum(long, wanted) / np.maximum(long, wanted)
        kept = np.flatnonzero((long > 0) & (ratio >= LEAST_LENGTH))
        each, word, long, ratio = each[kept], word[kept], long[kept], ratio[kept]
        close = greedy.closenesses_at((target, text), [begin[c[each]], at[word]], [size[c[each]], long], LEAST_SIMILARITY)
        kept = np.flatnonzero(close >= LEAST_SIMILARITY)
        each, word = each[kept], word[kept]
        score = close[kept] - LENGTH_COST * (1 - ratio[kept])
        out.append(np.stack([c[each], p[each], first[word], last[word + count[each] - 1], long[kept], score]))
        k = end
    c, p, start, end, long = (np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(5))
    score = np.concatenate([x[5] for x in out])
    whole = phrases.to_pylist()
    segments = [whole[i][a:b] for i, a, b in zip(p.tolist(), start.tolist(), end.tolist(), strict=True)]
    return shown[c], own[shown[c]], [start, end, long, score], segments


def _met(phrases: DataFrame, candidates: DataFrame, group: str, names: list[str], types: str, step) -> DataFrame:
    """What step gives for the groups of a batch: each group's phrase with its words and their looks, then its candidates with theirs."""
    ship(phrases.sparkSession)
    seq = candidates.schema["seq"].dataType.simpleString()
    found = phrases.select(group, "phrase", words(F.col("phrase")).alias("words"))
    looks = F.transform("words", lambda w: texts.latin_look(F.substring("phrase", w["start"] + 1, w["end"] - w["start"])))
    said = found.select(group, F.lit(0).cast(seq).alias("seq"), F.lit(0).alias("__kind"), "phrase", "words", looks.alias("looks"))
    target = texts.latin_look(F.trim("value"))
    shown = candidates.select(group, "seq", F.lit(1).alias("__kind"), "value", target.alias("target")).where("target <> ''")
    both = said.unionByName(shown, allowMissingColumns=True).where(F.col(group).isNotNull())
    return greedy.each_batch(both, group, ["__kind"], ["seq", "__kind"], names, types.format(seq=seq), step, kept=("phrase", "words", "looks", "value", "target"))


def span_proposals(phrases: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """Spans of each group's phrase that may be what a candidate (group, seq, value) shows: group, seq, start, end, segment, length, score.

    Candidates without a letter or digit, null ones among them, get none; a
    group has one phrase. What a span shows are the letters and digits of its
    words. A group's spans are compared in one task, a bounded number at a time.
    """

    def step(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, list]:
        rows, _, (start, end, long, score), segments = _proposed(columns, starts)
        return rows, [columns["seq"][rows], start.astype(np.int32), end.astype(np.int32), pa.array(segments, pa.string()), long.astype(np.int32), score]

    return _met(phrases, candidates, group, ["seq", "start", "end", "segment", "length", "score"], "seq {seq}, start int, end int, segment string, length int, score double", step)


def span_assignments(phrases: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """The proposals that win: group, seq, start, segment, score.

    Proposals are taken by score, then the shorter, then the later candidate and
    the later span; one that overlaps a taken span, or whose candidate has one,
    is passed over. A group without proposals gives no rows.
    """

    def step(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, list]:
        rows, own, (start, end, long, score), segments = _proposed(columns, starts)
        seq = columns["seq"][rows]
        order = np.lexsort((-start, -seq.astype(np.int64), long, -score, own))
        taken: list[tuple[int, int]] = []
        given: set[int] = set()
        won, last = [], None
        for k, g, s, a, b in zip(order.tolist(), own[order].tolist(), seq[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
            if g != last:
                taken, given, last = [], set(), g
            if s in given:
                continue
            i = bisect_left(taken, (a, b))
            if i and taken[i - 1][1] > a or i < len(taken) and taken[i][0] < b:
                continue
            insort(taken, (a, b))
            given.add(s)
            won.append(k)
        won = np.array(won, np.int64)
        return rows[won], [seq[won].astype(np.int32), start[won].astype(np.int32), pa.array([segments[k] for k in won.tolist()], pa.string()), score[won]]

    return _met(phrases, candidates, group, ["seq", "start", "segment", "score"], "seq int, start int, segment string, score double", step)


def paragraphs(rows: DataFrame, group: str) -> DataFrame:
    """Measured rows (group, seq, value, box) with paragraph (the number of its run), place in it (from 1) and n, its rows: runs, by centre, that begin at about one place and follow closely below each other.

    Rows of fewer than three letters and digits, or without a box, don't count;
    a paragraph has two rows at least, of which the first ROWS are given.
    """
    real = rows.where(F.expr("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL") & (F.length(texts.latin_look(F.col("value"))) >= 3))
    center = (F.col("y0") + F.col("y1")) / 2
    line = Window.partitionBy(group).orderBy("center", "x0", "seq")
    sided = real.withColumn("center", center)
    before = {c: F.lag(c).over(line) for c in ("x0", "y0", "x1", "y1", "center")}
    tall = F.greatest(F.lit(1), before["y1"] - before["y0"], F.col("y1") - F.col("y0"))
    wide = F.greatest(before["x1"] - before["x0"], F.col("x1") - F.col("x0"))
    aligned = F.abs(F.col("x0") - before["x0"]) <= F.greatest(F.lit(24.0), wide * 0.18)
    below = (F.col("center") - before["center"] > tall * 0.42) & (F.col("y0") - before["y0"] <= F.greatest(F.lit(24.0), tall * 3.0))
    found = sequences.islands(sided.withColumn("__new", ~(aligned & below)), [group], ["center", "x0", "seq"], F.col("__new"))
    own = Window.partitionBy(group, "island")
    placed = found.withColumns({"place": F.row_number().over(own.orderBy("center", "x0", "seq")), "n": F.count("*").over(own)})
    return placed.where((F.col("n") >= 2) & (F.col("place") <= ROWS)).drop("__new", "center").withColumnRenamed("island", "paragraph")


def _look(value: str) -> str:
    return "".join(c for c in value.casefold() if c.isalnum()).translate(str.maketrans(*texts.HOMOGLYPHS))


#: Sums of first and last words of paragraphs of like size that are held at once.
_SUMS = 1 << 19


class _Looks:
    """The looks of many texts as code points one after the other: how long each letter's look is, so that a part of a text is a part of the looks."""

    def __init__(self, values: list[str]):
        codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.int32)
        self.begin = np.cumsum([0, *map(len, values)], dtype=np.int64)
        letters, at = np.unique(codes, return_inverse=True)
        looks = [_look(chr(c)) for c in letters.tolist()]
        size = np.array([len(v) for v in looks], np.int64)
        first, known = np.cumsum(size) - size, np.frombuffer("".join(looks).encode("utf-32-le", "surrogatepass"), np.int32)
        n = size[at]
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.codes = known[np.arange(self.at[-1]) - np.repeat(self.at[:-1], n) + np.repeat(first[at], n)]


class _Asked:
    """Phrases and the rows among which they are dealt out, as arrays: numbers of words and rows, where words begin, and all looks."""

    def __init__(self, asked: list[tuple[str, list[str], bool]]):
        phrases: dict[str, int] = {}
        own = np.array([phrases.setdefault(phrase, len(phrases)) for phrase, *_ in asked], np.int64)
        words_at = [[m.start() for m in WORD.finditer(v)] for v in phrases]
        self.at = [[*starts, len(v)] for starts, v in zip(words_at, phrases, strict=True)]
        self.phrase, self.own = list(phrases), own
        n = np.array([len(w) for w in words_at], np.int64)
        self.n, self.rows = n[own], np.array([len(rows) for _, rows, _ in asked], np.int64)
        self.bound = np.array([bool(first) for *_, first in asked], bool)
        self.said, self.seen = _Looks(self.phrase), _Looks([v for _, rows, _ in asked for v in rows])
        # letters are only told apart, so they are numbered once for all comparisons
        letters = np.unique(np.concatenate([self.said.codes, self.seen.codes]), return_inverse=True)[1].astype(np.int32)
        self.said.codes, self.seen.codes = np.split(letters, [len(self.said.codes)])
        # where the look of each word begins, and that of each row
        place = np.concatenate([np.array(w, np.int64) + b for w, b in zip(self.at, self.said.begin[:-1].tolist(), strict=True)])
        self.word_at = self.said.at[place]
        self.first_word = (np.cumsum(n + 1) - (n + 1))[own]
        self.row_at = self.seen.at[self.seen.begin]
        self.first_row = np.cumsum(self.rows) - self.rows

    def chunks(self) -> Iterator[np.ndarray]:
        """Paragraphs that can be dealt out, those of like size together, as many at a time as may be held."""
        open_ = np.flatnonzero((self.rows > 0) & (self.n >= np.maximum(2, self.rows)))
        order = open_[np.lexsort((self.n[open_], self.bound[open_], self.rows[open_]))]
        k = 0
        while k < len(order):
            p = order[k]
            most = int(self.n[p]) * 5 // 4 + 2
            held = max(1, _SUMS // ((1 if self.bound[p] else most) * (most + 1)))
            part = order[k : k + held]
            part = part[(self.rows[part] == self.rows[p]) & (self.bound[part] == self.bound[p]) & (self.n[part] <= most)]  # in order, so these come first
            yield part
            k += len(part)

    def dealt(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of paragraphs of as many rows: which have a good partition, its quality, the cuts between its rows and the rows' scores."""
        rows, n = int(self.rows[part[0]]), self.n[part]
        wide, count = int(n.max()), len(part)
        firsts = 1 if self.bound[part[0]] else wide - rows + 1
        best = np.full((count, firsts, wide + 1), -np.inf)
        g, f = np.nonzero(np.arange(firsts)[None] <= (n - rows)[:, None])
        best[g, f, f] = 0.0
        used, scores = [], []
        for row in range(rows):
            seen = self.first_row[part] + row
            size = self.row_at[seen + 1] - self.row_at[seen]
            g, i = np.nonzero(np.isfinite(best).any(axis=1) & (size > 0)[:, None])
            g, i, w = np.repeat(g, ROW_WORDS), np.repeat(i, ROW_WORDS), np.tile(np.arange(1, ROW_WORDS + 1), len(g))
            fits = i + w <= n[g] - (rows - row - 1)
            g, i, w = g[fits], i[fits], w[fits]
            word = self.first_word[part[g]] + i
            start, long = self.word_at[word], self.word_at[word + w] - self.word_at[word]
            ratio = np.minimum(size[g], long) / np.maximum(size[g], long)
            some = ratio >= ROW_LENGTH
            g, i, w, start, long, ratio = (x[some] for x in (g, i, w, start, long, ratio))
            close = greedy.closenesses_at((self.seen.codes, self.said.codes), [self.row_at[seen[g]], start], [size[g], long], ROW_SIMILARITY)
            some = close >= ROW_SIMILARITY
            own = np.full((count, ROW_WORDS + 1, wide + 1), -np.inf)
            own[g[some], w[some], i[some]] = 0.82 * close[some] + 0.18 * ratio[some]
            # the best sums with one row more, longer segments first on ties
            reach, taken = np.full_like(best, -np.inf), np.zeros(best.shape, np.int8)
            for w in range(min(ROW_WORDS, wide), 0, -1):
                if np.isfinite(own[:, w]).any():
                    sums = best[:, :, : wide + 1 - w] + own[:, w, None, : wide + 1 - w]
                    better = sums > reach[:, :, w:]
                    reach[:, :, w:][better] = sums[better]
                    taken[:, :, w:][better] = w
            best = reach
            used.append(taken)
            scores.append(own)
        g, f, end = np.nonzero(np.isfinite(best))
        sums = best[g, f, end] / rows
        order = np.lexsort((-sums, g))
        g, f, end, sums = (x[order] for x in (g, f, end, sums))
        cuts, each = [end], []
        for taken, own in zip(reversed(used), reversed(scores), strict=True):
            w = taken[g, f, cuts[-1]].astype(np.int64)
            cuts.append(cuts[-1] - w)
            each.append(own[g, w, cuts[-1]])
        cuts, each = np.stack(cuts[::-1]), np.stack(each[::-1])
        good = (each >= ROW_SCORE).all(axis=0)
        return self._best(part, rows, g[good], sums[good], cuts[:, good], each[:, good])

    def _best(self, part: np.ndarray, rows: int, g: np.ndarray, sums: np.ndarray, cuts: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the partitions of each paragraph g, the greatest sums first: the one of the greatest quality, the first on ties; more of them at a time, until none can be better."""
        at, stop = (np.searchsorted(g, np.arange(len(part)), side) for side in ("left", "right"))
        quality, chosen, step = np.full(len(part), -np.inf), np.full(len(part), -1), 1
        seen = self.row_at[self.first_row[part]]
        size = self.row_at[self.first_row[part] + rows] - seen
        while True:
            # not even the whole phrase alike could make up for a lesser sum
            turn = np.flatnonzero(at < stop)
            turn = turn[0.65 * sums[at[turn]] + 0.35 >= quality[turn]]
            if not len(turn):
                break
            many = np.minimum(step, stop[turn] - at[turn])
            k = np.repeat(at[turn] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at[turn] += many
            step *= 2
            p, word = g[k], self.first_word[part[g[k]]]
            start = self.word_at[word + cuts[0, k]]
            overall = greedy.closenesses_at((self.seen.codes, self.said.codes), [seen[p], start], [size[p], self.word_at[word + cuts[-1, k]] - start], OVERALL)
            found = 0.65 * sums[k] + 0.35 * overall
            some = (overall >= OVERALL) & (found >= QUALITY) & (found > quality[p])
            k, p, found = k[some], p[some], found[some]
            order = np.lexsort((k, -found, p))
            p, first = np.unique(p[order], return_index=True)
            quality[p], chosen[p] = found[order][first], k[order][first]
        some = np.flatnonzero(chosen >= 0)
        return part[some], quality[some], cuts[:, chosen[some]], each[:, chosen[some]]


def partitions(asked: list[tuple[str, list[str], bool]]) -> list[list[tuple[str, float]] | None]:
    """partition() of each (phrase, observed, first_word_only): paragraphs of like size are worked out side by side, row by row."""
    out: list[list[tuple[str, float]] | None] = [None] * len(asked)
    if not asked:
        return out
    all_ = _Asked(asked)
    for part in all_.chunks():
        for p, quality, cuts, scores in zip(*(x.T.tolist() for x in all_.dealt(part)), strict=True):
            own = int(all_.own[p])
            phrase, at = all_.phrase[own], all_.at[own]
            out[p] = [(phrase[at[i] : at[j]].strip(), min(quality, s)) for i, j, s in zip(cuts, cuts[1:], scores, strict=False)]
    return out


def partition(phrase: str, observed: list[str], first_word_only: bool = False) -> list[tuple[str, float]] | None:
    """The segment and score of each row, of the best partition of consecutive words of phrase among rows; None where none is good enough.

    For every first and last word the partition of the greatest sum of row
    scores counts, with longer earlier segments on ties; of those that hold the
    thresholds, the one of the greatest quality, the first on ties.
    """
    return partitions([(phrase, observed, first_word_only)])[0]


def row_assignments(phrases: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """What the rows of each paragraph show, from the group's phrase: group, seq, segment, score; a paragraph without a good partition gives no rows.

    phrases may have a column top, the upper edge of the crop; where the topmost
    run of rows begins closely below it, it begins with the phrase's first word.
    """
    known = phrases if "top" in phrases.columns else phrases.withColumn("top", F.lit(None).cast("int"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told by number, so that small rows with much to do aren't brought together by the windows either
    placed = paragraphs(rows.repartition(n, group), group)
    led = placed.join(known.select(group, "phrase", "top"), group).withColumn("phrase", F.when(F.col("place") == 1, F.col("phrase")))
    near = F.col("y0") - F.col("top") <= F.greatest(F.lit(24), 3 * F.greatest(F.lit(1), F.col("y1") - F.col("y0")))
    led = led.withColumn("bound", F.coalesce(near & (F.col("paragraph") == 1), F.lit(False)).cast("int"))

    def step(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, list]:
        first = np.diff(columns["paragraph"], prepend=-1) != 0
        first[starts] = True
        begin = np.flatnonzero(first)
        values, said = columns["value"].to_pylist(), columns["phrase"].take(pa.array(begin)).to_pylist()
        ends = [*begin[1:].tolist(), len(values)]
        made = partitions([(phrase or "", values[i:k], bool(bound)) for phrase, i, k, bound in zip(said, begin.tolist(), ends, columns["bound"][begin].tolist(), strict=True)])
        found = [(i + k, *one) for i, own in zip(begin.tolist(), made, strict=True) for k, one in enumerate(own or [])]
        at = np.array([i for i, *_ in found], np.int64)
        return at, [columns["seq"][at].astype(np.int32), pa.array([v for _, v, _ in found], pa.string()), np.array([x for *_, x in found], float)]

    return greedy.each_batch(led, group, ["paragraph", "place"], ["seq", "paragraph", "bound"], ["seq", "segment", "score"], "seq int, segment string, score double", step, kept=("value", "phrase"))
