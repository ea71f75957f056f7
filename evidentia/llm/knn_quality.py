"""Document quality by votes of the nearest labelled documents in a latent space.

A text's terms are of three parts. Forms: adjacent pairs of character classes
(letters by case, digits, kinds of white space, each ASCII mark; runs count as
two). Words: case-folded, without the marks around them, hashed into WORDS
buckets. Repetition: the shares of words that repeat the one before, of words
and of lines that occurred already, and what each leaves. Log frequencies,
weighted by inverse document frequency, make each part a unit vector; the three
are projected on the RANK leading right singular vectors of the labelled sample
and made unit vectors again. The sample's vectors are broadcast; each block of
documents takes its cosines with all of them, in double precision and then
rounded to whole steps, and its NEIGHBOURS nearest, and all that are as near as
the last of those, vote with the cosine as weight.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

#: Most labelled rows in the neighbour table, in the order of a hash of the id; with RANK it bounds the broadcast to about 4 MB.
SAMPLE_ROWS = 6144
RANK = 48
NEIGHBOURS = 7
THRESHOLD = 0.3
#: Buckets of words, and the steps of 1 that cosines are rounded to: those of one step count as equal.
WORDS, STEPS = 1024, 1e6
_BLOCK, _CACHE_WORDS = 256, 400_000
RESULT = "struct<score: double, neighbours: int>"


def _classes() -> tuple[np.ndarray, int]:
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table = np.full(256, 1, np.int64)  # control characters
    table[128:] = 0
    for members, k in ((range(97, 123), 2), (range(65, 91), 3), (range(48, 58), 4), (b" ", 5), (b"\n", 6), (b"\t\r\x0b\x0c", 7)):
        table[list(members)] = k
    table[marks] = np.arange(8, 8 + len(marks))
    return table, 8 + len(marks)


_CLASS, _N = _classes()
_FORMS = _N * _N
TERMS = _FORMS + WORDS + 6
_PARTS = (slice(0, _FORMS), slice(_FORMS, _FORMS + WORDS), slice(_FORMS + WORDS, TERMS))
_AROUND = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


class _Buckets(dict):
    """The bucket of each word met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = bucket = zlib.crc32(word.strip(_AROUND).casefold().encode("utf-8", "surrogatepass")) % WORDS
        return bucket


_bucket = _Buckets()


def terms(text: str | None) -> np.ndarray:
    """Counts of forms and of words, then the three pairs of shares; a null text is empty and has none."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    c = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(c) > 2:
        c = c[np.concatenate([[True, True], (c[2:] != c[1:-1]) | (c[1:-1] != c[:-2])])]
    out[:_FORMS] = np.bincount(c[:-1] * _N + c[1:], minlength=_FORMS)
    words, lines = text.split(), text.split("\n")
    if words:
        out[_PARTS[1]] = np.bincount(np.fromiter(map(_bucket.__getitem__, words), np.int64, len(words)), minlength=WORDS)
    again = sum(map(str.__eq__, words[1:], words)) / max(1, len(words) - 1)
    new, fresh = len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines)
    out[_PARTS[2]] = [again, 1 - again, 1 - new, new, 1 - fresh, fresh]
    return out


def frequencies(texts: list[str | None]) -> np.ndarray:
    """Log frequencies: of forms by length, of words as they are; shares stay."""
    out = np.array([terms(t) for t in texts], np.float32).reshape(-1, TERMS)
    forms, words = out[:, _PARTS[0]], out[:, _PARTS[1]]
    forms *= 1000 / np.maximum(forms.sum(1, keepdims=True), 1)
    np.log1p(forms, out=forms)
    np.log1p(words, out=words)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start."""
    width = min(rank + 16, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :rank], np.float32)


@dataclass
class Model:
    """idf and axes of the projection; vectors and labels of the sample. Without labelled rows every score is base."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float = 0.5

    def _weighted(self, freq: np.ndarray) -> np.ndarray:
        freq = freq * self.idf
        return np.concatenate([_unit(freq[:, part]) for part in _PARTS], axis=1)

    def place(self, freq: np.ndarray) -> np.ndarray:
        return _unit(self._weighted(freq.astype(np.float64)) @ self.axes)

    def votes(self, texts: list[str | None]) -> np.ndarray:
        """The rounded cosine, in steps, of each text with each vector, where it is among the nearest and above 0, else 0."""
        cosines = np.rint(STEPS * (self.place(frequencies(texts)) @ self.vectors.T))
        k = min(NEIGHBOURS, len(self.labels))
        last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        return np.where(cosines >= last, np.maximum(cosines, 0), 0)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, int]:
        """The share of label 1 among the neighbours' votes; the mean label for a text without terms, or without any cosine above 0. Sums of whole steps are exact."""
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(texts), self.base), 0
        each: dict[str | None, float] = {}
        distinct = list(dict.fromkeys(texts))
        for lo in range(0, len(distinct), _BLOCK):
            part = distinct[lo : lo + _BLOCK]
            weight = self.votes(part)
            total = weight.sum(1)
            each.update(zip(part, np.where(total > 0, weight @ self.labels / np.maximum(total, 1), self.labels.mean()).tolist(), strict=True))
        return np.array([each[t] for t in texts]), k


def fit(sample: DataFrame) -> Model:
    """Learn from sample (text, y), a written table of at most SAMPLE_ROWS rows, whose terms other than 0 reach the driver."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                freq = frequencies(part.column(0).to_pylist())
                at = [np.flatnonzero(x) for x in freq]
                yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()), pa.array([x[i].tobytes() for x, i in zip(freq, at, strict=True)], pa.binary()), part.column(1)], ["at", "freq", "y"])

    rows = sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in _shared.map_arrow(sample, run, "at binary, freq binary, y int").collect())
    if not rows:
        return Model(np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0))
    x = np.zeros((len(rows), TERMS), np.float32)
    for out, (at, freq, _) in zip(x, rows, strict=True):
        out[np.frombuffer(at, np.uint16)] = np.frombuffer(freq, np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32)
    idf[_PARTS[2]] = 1
    model = Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1)), np.array([y for *_, y in rows], float))
    model.axes = _axes(model._weighted(x), RANK).astype(np.float64)
    model.vectors = model.place(x)
    return model


def score(df: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None, name: str = "quality") -> DataFrame:
    """Append the similarity-weighted share of label 1 among the nearest labelled vectors, for each whole text.

    Empty and null texts have no terms: they score the mean label of the sample.
    Neighbours that are equally near all vote, so the order of the sample
    doesn't matter. Nor does the batch that a text comes in: cosines in double
    precision, which may differ by some 1e-15 with the shape of a product, are
    rounded to 1e-6 before anything is compared or added, so a score could change
    only where a cosine lies that close to the middle of two steps. An empty table gives no rows; repeated rows score one by
    one; a column that is called name is replaced, all others stay.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def of(texts):
            scores, k = model.scores(texts)
            return pa.StructArray.from_arrays([pa.array(scores), pa.array(np.full(len(scores), k, np.int32))], ["score", "neighbours"])

        return of

    return _shared.annotate(df, text_col, make, RESULT, carry=carry, name=name)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows of labels outside the held-out fold, at most SAMPLE_ROWS."""
    return fit(_shared.labelled_sample(docs, labels, "quality", mod=5, held=0, limit=SAMPLE_ROWS, name="quality-sample"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with the columns that they have."""
    name = _shared.unused(docs, "quality")
    return score(docs, train(docs, labels), name=name).where(F.col(f"{name}.score") >= THRESHOLD).drop(name)


def op6_knn_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    docs, labels = (_shared.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels), carry=["doc_id"])
    return scored.select("doc_id", (_shared.fold("doc_id", 5) == 0).alias("held_out"), F.col("quality.score").alias("score"), F.when(F.col("quality.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
