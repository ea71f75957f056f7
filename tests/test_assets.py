"""The store of assets under several writers, and dominant colours against plain k-means."""

from __future__ import annotations

import random
import threading

from pyspark.sql import functions as F

from evidentia.operators import zones
from evidentia.sources import assets


def test_store_keeps_one_copy_under_two_writers(spark, tmp_path):
    folder = f"file://{tmp_path}/assets"
    rows = [(k, bytes([k % 7]) * (k % 5 * 1000)) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, content binary").withColumn("media", F.lit("image/png")).repartition(6)
    failed = []

    def write():
        try:
            told = {r["id"]: r for r in assets.store(df, folder).collect()}
            assert told[99]["sha256"] is None and told[99]["place"] is None and "content" not in told[1]
            assert all(told[k]["sha256"] == assets.digest_of(c) and told[k]["length"] == len(c) for k, c in rows if c is not None)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    (tmp_path / "assets" / "ab").mkdir(exist_ok=True)
    (tmp_path / "assets" / "ab" / f"{'a' * 64}.123.tmp").write_bytes(b"interrupted")
    got = assets.load(spark, folder).collect()
    want = {assets.digest_of(c): c for _, c in rows if c}
    assert sorted(r["sha256"] for r in got) == sorted(want) and all(r["sound"] and bytes(r["content"]) == want[r["sha256"]] for r in got)
    assert not assets.put_if_absent(folder, assets.place(got[0]["sha256"]), b"other") and assets.store(df.limit(0), folder).count() == 0


def plain_zones(pixels, k, rounds):
    counts: dict = {}
    for c in pixels:
        counts[c] = counts.get(c, 0) + 1
    cubes: dict = {}
    for c, n in counts.items():
        cubes.setdefault(tuple(v // 32 for v in c), []).append((-n, c))
    centers = [min(v)[1] for _, v in sorted(cubes.items(), key=lambda x: (sum(n for n, _ in x[1]), x[0]))][:k]
    for step in range(rounds + 1):
        own: dict = {}
        for c, n in counts.items():
            own.setdefault(min(range(len(centers)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(c, centers[i])), i)), []).append((c, n))
        if step < rounds:
            for i, members in own.items():
                total = sum(n for _, n in members)
                centers[i] = tuple((2 * sum(c[d] * n for c, n in members) + total) // (2 * total) for d in range(3))
    sizes = sorted((-sum(n for _, n in m), centers[i], i) for i, m in own.items())
    return [(f"#{c[2]:02X}{c[1]:02X}{c[0]:02X}", round(-n / len(pixels), 4)) for n, c, _ in sizes]


def test_color_zones_equal_plain_means(spark):
    rng = random.Random(3)
    pictures = {p: [tuple(min(255, max(0, int(rng.gauss(m, 25)))) for m in rng.choice([(20, 40, 200), (230, 230, 230), (90, 160, 30), (10, 10, 10)][: 1 + p % 4])) for _ in range(rng.choice([1, 3, 60, 300]))] for p in range(12)}
    pictures[50] = [(10, 20, 30)] * 7
    rows = [(p, f"#{r:02x}{g:02X}{b:02x}") for p, pixels in pictures.items() for b, g, r in pixels] + [(3, None), (3, "red"), (None, "#000000")]
    df = spark.createDataFrame(rows, "picture long, hex string")
    want = {p: plain_zones(v, 3, 4) for p, v in pictures.items()}
    for parts in (1, 5):
        got: dict = {}
        for r in zones.color_zones(df.repartition(parts), "picture", k=3, rounds=4).orderBy("picture", "rank").collect():
            got.setdefault(r["picture"], []).append((r["hex"], r["ratio"]))
        assert got == want
    assert zones.color_zones(df.limit(0), "picture", k=3, rounds=1).count() == 0
