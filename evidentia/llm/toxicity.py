"""Toxic passages by maximum-scoring segments over token log-odds.

A token's score is how much likelier it, or a prefix of it, is in a toxic
labelled document than in a clean one: log-odds under a Dirichlet prior that
spreads PRIOR pseudo-documents as the pooled counts lie, less one standard
error, kept where the odds are clear of chance. Every other token costs the
drift. One linear scan of a text then finds all its maximal segments, those
that neither extend nor contain a higher-scoring one. Extreme-value statistics
of the clean documents (lambda, K) say how surprising a segment of a text of n
tokens is, and a logistic curve over a text's best and summed evidence, fitted
on the training sample, turns that into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

#: Most labelled rows that a model is fitted on, in the order of a hash of the id.
SAMPLE_ROWS = 16_384
THRESHOLD = 0.3
PRIOR = 20.0
_SHORT, _LONG = 4, 10
_CLEAR, _LEAST = 2.5, 1.0
#: Word bytes: digits, a-z after folding A-Z, and all beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RESULT = "struct<score: double, n_tokens: long, segments: array<struct<first: int, last: int, bits: double, p: double>>>"
_TYPE = pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("segments", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("bits", pa.float64()), ("p", pa.float64())])))])


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def features(token: bytes) -> list[bytes]:
    """The token itself, marked as whole, and its prefixes of _SHORT to _LONG bytes."""
    return [token + b"$", *(token[:k] for k in range(_SHORT, min(len(token), _LONG) + 1))]


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a sequence whose positions score -drift but for hits, (position, positive score) in order.

    Candidates keep the cumulative score before and after them. A new one is
    absorbed into the nearest earlier one that starts lower, if that ends lower;
    only candidates that start lower than all later ones can absorb, and rising
    has those alone, so each is pushed and popped once: linear time and memory.
    """
    found: list[tuple[float, float, int, int]] = []
    rising: list[int] = []
    total, before = 0.0, -1
    for at, score in hits:
        total -= drift * (at - before - 1)
        left, total, first, before = total, total + score, at, at
        while rising and found[rising[-1]][0] >= left:
            rising.pop()
        while rising and found[rising[-1]][1] < total:
            j = rising.pop()
            left, first = found[j][0], found[j][2]
            del found[j:]
        rising.append(len(found))
        found.append((left, total, first, at))
    return [(right - left, first, last) for left, right, first, last in found]


@dataclass
class Model:
    """scores: feature -> log-odds; drift, lam, k: of the scan; curve: logistic weights over standardised evidence; base: score of all texts where nothing was learned."""

    scores: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.0
    lam: float = 1.0
    k: float = 1.0
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)
    base: float = 0.0

    def __post_init__(self):
        self._heads = {(f[:-1] if f.endswith(b"$") else f)[:_SHORT] for f in self.scores}

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        heads, scores, short = self._heads, self.scores, _SHORT
        maybe = [i for i, w in enumerate(words) if w[:short] in heads]
        scored = ((i, max((scores.get(f, 0.0) for f in features(words[i])), default=0.0)) for i in maybe)
        return [(i, s) for i, s in scored if s > 0]

    def surprise(self, score: float, n: int) -> float:
        """-ln of the expected number of segments of that score in n clean tokens."""
        return self.lam * score - math.log(max(self.k * max(n, 1), 1e-9))

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> list[float]:
        best = max((self.surprise(s, n) for s, _, _ in found), default=self.surprise(0.0, n))
        return [best, self.lam * sum(s for s, _, _ in found), math.log1p(n)]

    def score(self, evidence: list[float]) -> float:
        if not self.curve:
            return self.base
        z = self.curve[0] + sum(w * (x - m) / s for w, x, m, s in zip(self.curve[1:], evidence, self.mean, self.scale, strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _log_odds(counts: list[tuple[bytes, int, int]], toxic: int, clean: int) -> dict[bytes, float]:
    out = {}
    for f, a, b in counts:
        prior = PRIOR * (a + b) / (toxic + clean) + 0.01
        y1, y0 = a + prior, b + prior
        odds = math.log(y1 / (toxic + PRIOR - y1)) - math.log(y0 / (clean + PRIOR - y0))
        error = math.sqrt(1 / y1 + 1 / y0)
        if odds - _CLEAR * error > _LEAST:
            out[f] = odds - error
    return out


def _counts(sample: DataFrame) -> DataFrame:
    """feature, a, b: of how many toxic and clean rows of the sample each feature is part."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update({f for w in set(tokens(text)) for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[1][f] for f in part], pa.int64()), pa.array([counts[0][f] for f in part], pa.int64())], ["feature", "a", "b"])

    return _shared.map_arrow(sample, run, "feature binary, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _evidence_curve(model: Model, rows: list[tuple[int, int, list[tuple[int, float]]]]) -> None:
    """Set drift, lam, k and the logistic curve from (label, tokens, hits) of the sample."""
    n = [sum(r[1] for r in rows if r[0] == y) for y in (0, 1)]
    hit = [sum(len(r[2]) for r in rows if r[0] == y) for y in (0, 1)]
    model.drift = max(2 * hit[1] / max(1, n[1]), 1e-3)
    clean = np.array([s for y, _, h in rows if not y for _, s in h])
    low, high = 1e-3, 5.0
    for _ in range(60):  # the lambda at which clean tokens' exponentiated scores average one
        mid = (low + high) / 2
        mean = ((n[0] - hit[0]) * math.exp(-mid * model.drift) + float(np.exp(mid * clean).sum())) / max(1, n[0])
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.lam, floor = low, 3.0
    beyond = sum(s >= floor for y, _, h in rows if not y for s, _, _ in segments(h, model.drift))
    model.k = max(beyond, 1) * math.exp(model.lam * floor) / max(1, n[0])
    x = np.array([model.evidence(r[1], segments(r[2], model.drift)) for r in rows])
    y = np.array([r[0] for r in rows], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(4) * 1e-2, z.T @ (y - p) - 1e-2 * w)
        w += step
    model.mean, model.scale, model.curve = mean.tolist(), scale.tolist(), w.tolist()


def fit(sample: DataFrame) -> Model:
    """Learn from sample (text, y), a written table of at most SAMPLE_ROWS rows; with one class or no row all texts score the mean label."""
    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Model(base=float(toxic > 0))
    # only features in at least one toxic row can have positive odds; their number is bounded by the sample
    found = _counts(sample).where("a >= 2 AND a / {:d} > b / {:d}".format(toxic, clean)).collect()
    model = Model(_log_odds([(bytes(r["feature"]), r["a"], r["b"]) for r in found], toxic, clean))

    def run(batches):
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                hits = model.hits(words)
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([len(words)], pa.int64()), pa.array([[i for i, _ in hits]], pa.list_(pa.int64())), pa.array([[s for _, s in hits]], pa.list_(pa.float64()))], ["y", "n", "at", "score"])

    rows = sorted(tuple(r) for r in _shared.map_arrow(sample, run, "y int, n long, at array<long>, score array<double>").collect())
    _evidence_curve(model, [(y, n, list(zip(at, score, strict=True))) for y, n, at, score in rows])
    return model


def score(df: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """Append score (0 to 1), n_tokens and segments (first and last token, evidence in bits, p value) of each whole text.

    Null and empty texts have no token and no segment, and score alike; an empty
    table gives no rows; repeated rows score one by one; a column that is called
    name is replaced, all other columns stay as they are.
    """

    def make():
        def of(texts):
            rows = []
            for text in texts:
                words = tokens(text)
                found, n = segments(model.hits(words), model.drift), len(words)
                parts = [{"first": a, "last": b, "bits": model.lam * s / math.log(2), "p": -math.expm1(-math.exp(-model.surprise(s, n)))} for s, a, b in found]
                rows.append({"score": model.score(model.evidence(n, found)), "n_tokens": n, "segments": parts})
            return pa.array(rows, _TYPE)

        return of

    return _shared.annotate(df, text_col, make, RESULT, carry=carry, name=name)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows of labels outside the held-out fold, at most SAMPLE_ROWS."""
    return fit(_shared.labelled_sample(docs, labels, "toxic", mod=4, held=2, limit=SAMPLE_ROWS, name="toxicity-sample"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below THRESHOLD, with the columns that they have."""
    name = _shared.unused(docs, "toxicity")
    return score(docs, train(docs, labels), name=name).where(F.col(f"{name}.score") < THRESHOLD).drop(name)


def op9_toxic_segments(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs, labels = (_shared.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels), carry=["doc_id"])
    return scored.select("doc_id", (_shared.fold("doc_id", 4) == 2).alias("held_out"), F.col("toxicity.score").alias("score"), F.when(F.col("toxicity.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
