"""Every pair of recordings at every offset by brute force against the operator."""

from __future__ import annotations

import numpy as np
import pytest

from evidentia.llm import chroma


def _recordings() -> list[np.ndarray]:
    rng = np.random.default_rng(31)

    def noise(n):
        return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def turned(x, most):
        return x ^ np.array([np.bitwise_or.reduce(np.uint32(1) << rng.choice(32, rng.integers(1, most + 1), replace=False).astype(np.uint32)) for _ in x], np.uint32)

    own = []
    for n in (1, 1, 1, 2, 3, 6, 9, 15, 16, 17, 24, 40, 60):
        a = noise(n)
        # every item differs in its sign bits too, so that no key is shared
        own += [a, turned(a, 4) ^ np.uint32(2), turned(np.concatenate([noise(7), a, noise(3)]), 8), noise(n)]
    return [*own, np.zeros(30, np.uint32), np.full(45, 7, np.uint32), np.zeros(1, np.uint32)]


@pytest.mark.parametrize(("least", "tile"), [(16, 1 << 15), (16, 64), (5, 200), (2, 100), (1, 1 << 15)])
def test_chroma_links_every_pair_that_aligns(spark, monkeypatch, least, tile):
    own, s = _recordings(), chroma.Settings(least_items=least)
    links = {}
    for i in range(len(own)):
        for j in range(i):
            for o in range(-len(own[i]), len(own[j]) + 1):
                _, n, wrong = chroma.stretch(own[i], own[j], o, s.item_error)
                if n >= max(1, min(least, len(own[i]), len(own[j]))) and wrong <= s.most_error * 32 * n:
                    links[i, j] = max(links.get((i, j), (0, 0)), (n, -wrong))
    root = list(range(len(own)))
    for i, j in links:
        lo, hi = sorted((root[i], root[j]))
        root = [lo if x == hi else x for x in root]
    made = spark.createDataFrame([(k, x.view(np.int32).tolist(), 1000 - k, []) for k, x in enumerate(own)], "id long, items array<int>, print long, late array<array<int>>")
    monkeypatch.setattr(chroma, "fingerprint", lambda *_, **__: made)
    monkeypatch.setattr(chroma, "TILE", tile, raising=False)
    got = sorted(chroma.align(made, pcm_col="items", settings=s).collect())
    assert len(links) >= 20 and [r.recording_id for r in got] == root
    for r in got:
        of = {pair: best for pair, best in links.items() if r.id in pair}
        assert r.n_links == len(of) and (r.offset is None) == (not of)
        if of:
            n, wrong = max(of.values())
            assert (r.aligned_items, round(r.bit_error * 32 * n)) == (n, -wrong) and (max(r.id, r.aligned_with), min(r.id, r.aligned_with)) in of
            assert chroma.stretch(own[r.id], own[r.aligned_with], r.offset, s.item_error)[1:] == (n, -wrong)
