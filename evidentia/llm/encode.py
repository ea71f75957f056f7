"""Byte-level BPE encoding through the tokenizers library, with each distinct word encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the word cache of a worker; beyond it the cache starts anew (about 160 MB).
CACHE_WORDS = 800_000
_JOIN = 2000
#: Marks the first word of a text; texts that hold it are encoded whole.
_FIRST = "\x01"
_CLOSE = frozenset(".,;:!?")
_SPACE = re.compile(r"\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts exactly as Tokenizer.encode(text, add_special_tokens=False) does.

    The pre-tokenizer always cuts before a single space between two visible
    characters, so the words between such spaces can be encoded apart and
    remembered. It also cuts between a letter and one closing mark at the end
    of a word, and around a line feed between two visible characters. Texts
    with other runs of white space, or with the string of a special token, go
    through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        vocab = self._tok.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        self._opens = np.zeros(self.vocab_size, dtype=bool)
        for piece, i in vocab.items():
            self._opens[i] = piece.startswith("Ġ")
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._marks = {c: self._whole([c])[0] for c in [*_CLOSE, "\n"]}
        #: Ids of words after one space and, marked by _FIRST, of words that begin a text or line; None where white space makes the cut uncertain.
        self._words: dict[str, bytes | None] = {"": None, _FIRST: b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space, each after one space, many in one call; a token that opens with the space opens a word."""
        out: list[bytes] = []
        for i in range(0, len(words), _JOIN):
            part = words[i : i + _JOIN]
            ids = np.array(self._tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = (np.flatnonzero(self._opens[ids]) * self.dtype.itemsize).tolist()
            if len(cuts) != len(part):
                raise AssertionError("words and tokens do not align")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def _learn(self, words: list[str], openers: list[str]) -> None:
        """Remember the ids of words that are not known yet, each given once."""
        known, marks, close = self._words, self._marks, _CLOSE
        parts: dict[str, tuple[str, str]] = {}
        ended: list[str] = []
        bare: list[str] = []
        spaced = _SPACE.search("".join(words)) is not None
        for w in words:
            if spaced and _SPACE.search(w):
                if w[0].isspace() or w[-1].isspace():
                    known[w] = None
                    continue
                head, feed, tail = w.partition("\n")
                if feed:
                    if head[-1].isspace() or tail[0].isspace():
                        known[w] = None
                        continue
                    parts[w] = (head, tail)
                    openers.append(_FIRST + tail)
                    w = head
            if w[-1] in close and w[-2:-1].isalpha():
                ended.append(w)
                w = w[:-1]
            bare.append(w)
        bare = [w for w in dict.fromkeys(bare) if w not in known]
        odd = [w for w in bare if _SPACE.search(w)] if spaced else []
        plain = [w for w in bare if not _SPACE.search(w)] if odd else bare
        known.update(zip(plain, self._apart(plain), strict=True))
        known.update(zip(odd, self._whole([" " + w for w in odd]), strict=True))
        fresh = [w for w in dict.fromkeys(openers) if w not in known]
        whole = [w for w in fresh if not w[-1].isspace()]
        known.update(zip(whole, self._whole([w[1:] for w in whole]), strict=True))
        known.update((w, None) for w in fresh if w[-1].isspace())
        for w in ended:
            known[w] = known[w[:-1]] + marks[w[-1]]
        for w, (head, tail) in parts.items():
            known[w] = known[head] + marks["\n"] + known[_FIRST + tail]

    def encode(self, texts: pa.Array | list[str | None]) -> list[memoryview | bytes]:
        """Little-endian ids (of self.dtype) of each text; null counts as empty.

        Arrow splits the texts, numbers their distinct words and lays out the
        ids; Python touches each distinct word once.
        """
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        whole = np.zeros(len(texts), bool)
        for s in [*self._special, _FIRST]:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.binary_join_element_wise(_FIRST, texts, ""), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            self._words = known = {"": None, _FIRST: b""}
            new = [w for w in words if w not in known]
        self._learn([w for w in new if w[0] != _FIRST], [w for w in new if w[0] == _FIRST])
        laid = pa.array([known[w] for w in words], pa.binary()).take(coded.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int32, len(laid) + 1) if len(laid) else np.zeros(1, np.int32)
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist() if len(split) else [0]
        if laid.null_count:
            rows = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
            whole[rows[laid.is_null().to_numpy(zero_copy_only=False)]] = True
        data = memoryview(laid.buffers()[2] or b"")
        out: list[memoryview | bytes] = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        odd = np.flatnonzero(whole).tolist()
        if odd:
            for k, ids in zip(odd, self._whole([texts[k].as_py() for k in odd]), strict=True):
                out[k] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    return Encoder(path)
