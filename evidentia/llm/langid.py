"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as its runs of non-space characters, in pieces of at most
WORD_BYTES bytes that end where a character does. Over each piece one network runs forwards and one backwards;
at every byte position their joined states give a probability of each language.
A document's probabilities are the means over all its positions. The networks
are trained in numpy by backpropagation through time, with Adam, on pieces
drawn from a bounded sample of documents.

Equal pieces have equal position labels, so each distinct piece of a batch is
run once and its sums are counted as often as it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

#: Most labelled documents that the network is trained on, in the order of a hash of the id, and most pieces of each, evenly spaced over its text: at most 17 MB reach the driver.
SAMPLE_ROWS, SAMPLE_PIECES = 2048, 256
WORD_BYTES = 32
HIDDEN = 16
STEPS, BATCH, RATE = 360, 512, 0.02
UNKNOWN = "und"
RESULT = "struct<lang: string, score: double, probabilities: array<double>>"
_CACHE_WORDS = 400_000
_BLOCK = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _batch(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (step, word) left-aligned, the same reversed, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    steps = int(lengths.max())
    ahead = np.zeros((len(words), steps), np.uint8)
    inside = np.arange(steps) < lengths[:, None]
    ahead[inside] = np.frombuffer(b"".join(words), np.uint8)
    back = np.zeros_like(ahead)
    back[inside] = np.frombuffer(b"".join(w[::-1] for w in words), np.uint8)
    return ahead.T, back.T, lengths


def pieces(raw: bytes) -> list[bytes]:
    """A run of bytes cut into pieces of at most WORD_BYTES, none within a character."""
    if len(raw) <= WORD_BYTES:
        return [raw]
    out, at = [], 0
    while at < len(raw):
        end = min(at + WORD_BYTES, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80 and end > at + WORD_BYTES - 4:
            end -= 1
        out.append(raw[at:end])
        at = end
    return out


def _mirror(lengths: np.ndarray, steps: int) -> np.ndarray:
    """(step, word) -> the step of the reversed word at the same byte."""
    return np.maximum(lengths[None, :] - 1 - np.arange(steps)[:, None], 0)


class Cell:
    """One direction: wx (256 x 3H) by byte, wh (H x 2H) for the update and reset gates, wc (H x H) for the candidate."""

    def __init__(self, wx: np.ndarray, wh: np.ndarray, wc: np.ndarray):
        self.wx, self.wh, self.wc = wx, wh, wc

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, word, H); keep gets what backward() needs of each step."""
        size = self.wc.shape[0]
        h = np.zeros((x.shape[1], size), np.float32)
        out = np.empty((*x.shape, size), np.float32)
        for t in range(len(x)):
            g = self.wx[x[t]]
            gates = _sigmoid(g[:, : 2 * size] + h @ self.wh)
            z, r = gates[:, :size], gates[:, size:]
            c = np.tanh(g[:, 2 * size :] + (r * h) @ self.wc)
            if keep is not None:
                keep.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of wx, wh and wc, from those of the states."""
        d_wh, d_wc = np.zeros_like(self.wh), np.zeros_like(self.wc)
        d_g = np.empty((*x.shape, self.wx.shape[1]), np.float32)
        d_h = np.zeros_like(kept[0][0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = kept[t]
            d_h = d_h + d_out[t]
            d_c = d_h * z * (1 - c * c)
            d_rh = d_c @ self.wc.T
            d_wc += (r * h).T @ d_c
            d_gates = np.concatenate([d_h * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            d_wh += h.T @ d_gates
            d_g[t] = np.concatenate([d_gates, d_c], axis=1)
            d_h = d_h * (1 - z) + d_rh * r + d_gates @ self.wh.T
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        d_wx = np.zeros_like(self.wx)
        d_wx[seen] = np.add.reduceat(d_g.reshape(len(flat), -1)[order], first, axis=0)
        return [d_wx, d_wh, d_wc]


@dataclass
class Network:
    """weights: wx, wh, wc ahead, then back, then the output's matrix and bias; langs in the order of the output."""

    langs: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self._known: dict[str, int] = {}
        self._sums = np.zeros((0, len(self.langs)))

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def logits(self, words: list[bytes], kept: tuple[list, list] | None = None):
        """Of every position (step, word), and the mask of those within the words."""
        x, y, lengths = _batch(words)
        a, b = Cell(*self.weights[:3]), Cell(*self.weights[3:6])
        keep = kept or (None, None)
        mirror = _mirror(lengths, len(x))
        ahead = a.forward(x, keep[0])
        back = np.take_along_axis(b.forward(y, keep[1]), mirror[:, :, None], axis=0)
        states = np.concatenate([ahead, back], axis=2)
        return states @ self.weights[6] + self.weights[7], np.arange(len(x))[:, None] < lengths, (x, y, states, mirror)

    def positions(self, word: bytes) -> np.ndarray:
        """The probabilities of each language at each byte of one piece."""
        return _softmax(self.logits([word])[0])[:, 0]

    def _learned(self, words: list[str]) -> np.ndarray:
        """For each word the sums of its positions' probabilities; new ones are run in blocks of like length."""
        known = self._known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > _CACHE_WORDS:
            self._known, self._sums, new = {}, np.zeros((0, len(self.langs))), words
            known = self._known
        if new:
            parts, owner = [], []
            for k, w in enumerate(new):
                own = pieces(w.encode("utf-8", "surrogatepass"))
                parts += own
                owner += [k] * len(own)
            sums = np.zeros((len(new), len(self.langs)))
            order = np.argsort(np.fromiter(map(len, parts), np.int64, len(parts)), kind="stable")
            owner = np.array(owner, np.int64)
            for i in range(0, len(order), _BLOCK):
                part = order[i : i + _BLOCK]
                logits, inside, _ = self.logits([parts[k] for k in part.tolist()])
                np.add.at(sums, owner[part], (_softmax(logits) * inside[:, :, None]).sum(0))
            known.update(zip(new, range(len(self._sums), len(self._sums) + len(new)), strict=True))
            self._sums = np.concatenate([self._sums, sums])
        return self._sums[np.fromiter((known[w] for w in words), np.int64, len(words))]

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Each text's mean probabilities; zero for a text without bytes but white space."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        out = np.zeros((len(texts), len(self.langs)))
        if len(coded):
            sums = self._learned(words)[coded.indices.to_numpy()]
            cum = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(sums, axis=0)])
            at = split.offsets.to_numpy() - split.offsets[0].as_py()
            out = cum[at[1:]] - cum[at[:-1]]
        return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], *, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> Network:
    """Train on pieces of the texts, each labelled with its text's language at every position; each language is drawn alike."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pools = []
    for name in names:
        words = [w for t, x in zip(texts, langs, strict=True) if x == name for w in (t or "").encode("utf-8", "surrogatepass").split()]
        pools.append([p for w in words for p in pieces(w)] or [b" "])
    shapes = [(256, 3 * hidden), (hidden, 2 * hidden), (hidden, hidden)] * 2 + [(2 * hidden, len(names)), (len(names),)]
    net = Network(names, [(rng.standard_normal(s) * (0.3 if len(s) == 2 else 0)).astype(np.float32) for s in shapes])
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for step in range(steps if len(names) > 1 else 0):
        y = rng.integers(0, len(names), BATCH)
        words = [pools[k][i] for k, i in zip(y.tolist(), (rng.random(BATCH) * [len(pools[k]) for k in y]).astype(int).tolist(), strict=True)]
        kept: tuple[list, list] = ([], [])
        logits, inside, (x, back, states, mirror) = net.logits(words, kept)
        d = _softmax(logits)
        d[:, np.arange(BATCH), y] -= 1
        d *= inside[:, :, None] / inside.sum()
        flat = states.reshape(-1, states.shape[2])
        d_states = d @ net.weights[6].T
        d_back = np.zeros_like(d_states[:, :, hidden:])
        rows, cols = np.nonzero(inside)
        d_back[mirror[rows, cols], cols] = d_states[rows, cols, hidden:]
        grads = [
            *Cell(*net.weights[:3]).backward(x, kept[0], d_states[:, :, :hidden]),
            *Cell(*net.weights[3:6]).backward(back, kept[1], d_back),
            flat.T @ d.reshape(-1, len(names)),
            d.sum((0, 1)),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / steps)
        for w, g, m, v in zip(net.weights, grads, first, second, strict=True):
            g = g * min(1.0, 1 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network:
    """Fit on at most SAMPLE_PIECES pieces of each of at most SAMPLE_ROWS ids with a language outside the held-out fold; of other columns only the fold and the order use the id.

    An id that occurs more than once gives its least text and language.
    """
    rows = _shared.positional(docs).select(*(_shared.column(docs, c).alias(k) for c, k in ((id_col, "id"), (text_col, "text"), (lang_col, "lang"))))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_shared.fold("id", 5) != 0))
    ids = known.select(F.col("id").alias("own")).distinct().orderBy(F.xxhash64("own"), "own").limit(SAMPLE_ROWS)
    texts = known.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("own"))).groupBy("id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))

    def make():
        def of(texts):
            out = []
            for text in texts:
                own = [p.decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").split() for p in pieces(w)]
                out.append(" ".join(own[:: -(-len(own) // SAMPLE_PIECES) or 1]))
            return pa.array(out)

        return of

    drawn = _shared.annotate(texts.select("text", "lang"), "text", make, "string", carry=["lang"], name="drawn")
    drawn = sorted(tuple(r) for r in drawn.collect())
    return fit([t for _, t in drawn], [x for x, _ in drawn])


def identify(df: DataFrame, net: Network, *, text_col: str = "text", carry: list[str] | None = None, name: str = "language") -> DataFrame:
    """Append lang, score (its mean probability) and all probabilities in the order of net.langs, of each whole text.

    A null text, or one without a letter, is UNKNOWN with score 0; so is every
    text where nothing was learned. Equal texts score alike; an empty table
    gives no rows; a column that is called name is replaced, all others stay.
    """
    held = df.sparkSession.sparkContext.broadcast(net)

    def make():
        net = held.value

        def of(texts):
            texts_ = pa.array(texts, pa.string())
            p = net.documents(texts_) if net.langs else np.zeros((len(texts), 0))
            best = p.argmax(1) if net.langs else None
            real = [bool(net.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
            return pa.StructArray.from_arrays(
                [pa.array([net.langs[best[k]] if ok else UNKNOWN for k, ok in enumerate(real)], pa.string()), pa.array([float(p[k].max()) if ok else 0.0 for k, ok in enumerate(real)]), pa.array(list(p), pa.list_(pa.float64()))],
                ["lang", "score", "probabilities"],
            )

        return of

    return _shared.annotate(df, text_col, make, RESULT, carry=carry, name=name)


def op10_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents outside the held-out fold."""
    docs = _shared.table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), carry=["doc_id"])
    return found.select("doc_id", (_shared.fold("doc_id", 5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.least(F.col("language.score"), F.lit(1.0)).alias("score"))
