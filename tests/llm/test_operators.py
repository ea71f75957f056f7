"""Brute-force checks of the training-data operators on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import chat_quotes, chroma, components, decontaminate, encode, knn_quality, langid, near_copies, packing, simhash, token_store, toxicity, warc
from evidentia.llm._shared import scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(400)]
    made = [words(rng, rng.randint(1, 60), pool) for _ in range(40)]
    long = words(rng, 6000, pool)
    return [*made, made[0], made[0], made[3] + " w1", None, "", "  ", long, "a\n b  c\t<|endoftext|> don't. Éß　x", "One two. Three\nFour, five!"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k % 7 == 0 else "en", "s", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[1], (None, "null id", "en", "s", 1)], DOC)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encode.default_path())


def test_encoder_equals_library(texts):
    rng = random.Random(1)
    alphabet = ["a", "Z", "é", "ß", "1", "²", ".", ",", "'", "'s", "\n", " ", " ", "\t", " ", "　", "_", "the", "\x01", "\x1c", "\x85", "日", "😀", "<|endoftext|>", "!"]
    made = texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    tok, enc = tokenizer(), encode.Encoder(encode.default_path())
    for text, got in zip(made, enc.encode(made), strict=True):
        assert np.frombuffer(bytes(got), enc.dtype).tolist() == tok.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packed_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    assert (token_store.unpack(token_store.pack(ids, bits), bits, len(ids)) == ids).all()


def test_token_store(spark, docs):
    path = scratch(spark, "test-store")
    shards = token_store.write(docs, path, block_tokens=64)
    got = [tuple(r) for r in token_store.read_index(spark, shards).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    tok, at = tokenizer(), 0
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, start, n, crc), (_, text) in zip(got, want, strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    uri, _, n_docs, _ = shards[-1]
    shard = token_store.Shard(uri)
    assert (shard.tokens(3, 100) == np.concatenate([shard.document(k) for k in range(n_docs)])[3:103]).all()
    assert token_store.write(docs.limit(0), scratch(spark, "none")) == []


def test_packing(spark, docs):
    packed = packing.pack(docs, capacity=128).cache()
    pieces = packed.collect()
    tok = tokenizer()
    total = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(p.length for p in pieces) == total
    by: dict = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
        assert p.piece == 0 or p.length == 128
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 128
    assert len(by) <= -(-total // 128) + 2
    whole = []
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 128 or 128, len(ids) + 1, 128)]
        whole += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(whole, key=str) == sorted(((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces), key=str)
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == 2 * total
    assert packing.pack(docs.limit(0)).count() == 0


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> int:
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
            gaps.append((min(fits) if fits else capacity) - length)
    return len(gaps)


@pytest.mark.parametrize("longest", [1024, 700, 400, 200])
def test_plan_never_beyond_best_fit(longest):
    rng = random.Random(longest)
    fewer = 0
    for _ in range(12):
        counts: dict = {}
        for _ in range(rng.choice([30, 200, 700])):
            length = min(rng.randint(1, longest), rng.randint(1, 1024))
            counts[length] = counts.get(length, 0) + 1
        used, plain = sum(n for _, n in packing.plan(counts)), best_fit_decreasing(counts, 1024)
        assert used <= plain
        fewer += used < plain
    assert fewer or longest != 400


def test_plan_uses_every_piece():
    rng = random.Random(2)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 30))}
        used: dict = {}
        for pattern, n in packing.plan(counts, 64):
            assert sum(pattern) <= 64 and n > 0
            for x in pattern:
                used[x] = used.get(x, 0) + n
        assert used == counts


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(7)
    pool = ["a", "b", "c", "The", "É", "x9"]
    items = [(k, words(rng, rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14]), pool)) for k in range(12)] + [(3, "a  B-c"), (99, None)]
    docs = [(k, words(rng, rng.randint(0, 60), pool)) for k in range(60)] + [(60, None), (61, ""), (5, "a b c")]

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    want = []
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for i, item in items:
            v = split(item)
            for k in range(max(1, len(v) - 9) if v else 0):
                window = v[k : k + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(i))
        want.append((d, len(w), len(hit), sorted(found)))
    got = decontaminate.occurrences(spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.overlap.n_words, r.overlap.n_hit, r.overlap["items"]) for r in got.collect()) == sorted(want)


def test_decontamination_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_simhash(spark, docs):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    ids = {k: min((r.doc_id for r, x in zip(rows, root, strict=True) if x == k and r.doc_id is not None), default=None) for k in set(root)}
    got = simhash.near_duplicates(docs)
    want = sorted(((r.doc_id, f"{f:016x}", ids[x]) for r, f, x in zip(rows, fps, root, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_join_tiles_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4))]))
    values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    for a, b in ((values, None), (values[::2], values[1::2])):
        nodes = a if b is None else np.concatenate([a, b])
        label = {int(x): int(x) for x in nodes}
        for x, y in simhash.join_tiles(a, b, 4):
            old, new = label[x], label[y]
            label = {k: new if v == old else v for k, v in label.items()}
        for x in a:
            for y in a if b is None else b:
                if np.bitwise_count(x ^ y) <= 4:
                    assert label[int(x)] == label[int(y)]


def test_components_both_ways(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(k, k + 1) for k in range(200, 230)] + [(5, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    local, steps = (sorted(map(tuple, components.components(df, local_links=n).collect())) for n in (1 << 20, 0))
    assert local == steps and (230, 200) in local


def test_warc(spark):
    body = "ä" * 600
    pages = [(k, f"http://h/{k}\n", body if k in (2, 5, 9) else "x" * k) for k in range(12)] + [(20, None, None), (None, "u", body), (9, "again", body)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = scratch(spark, "test-warc")
    manifest = warc.write(df, path, target_bytes=600)
    got = sorted((tuple(r) for r in warc.read(manifest).drop("url").collect()), key=repr)
    want = []
    for k, _, html in pages:
        raw = (html or "").encode()
        revisit = html == body and k != 9
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=repr)
    again = warc.write(df, scratch(spark, "test-warc"), target_bytes=600)
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in manifest.collect()) and manifest.count() > 2
    other = warc.write(df.repartition(7, "url"), scratch(spark, "test-warc"), target_bytes=600)
    assert sorted((tuple(r) for r in warc.read(other).drop("url").collect()), key=repr) == got
    assert warc.read(manifest, payloads=True).where("record_type = 'response' AND page_id = 9").first().payload == body.encode()
    assert warc.read(warc.write(df.limit(0), scratch(spark, "test-warc"))).count() == 0


def test_quotation_links(spark):
    said = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "On Monday, u wrote:\n> How are  you?\n\nFine, thanks."), (1, 2, "u", "> > How are you?\n> Fine, thanks.\nGreat."), (1, 3, "b", "> hello there.\nHi!"),
        (1, 4, "c", "no quote"), (2, 0, "u", None), (2, 1, "a", "> unknown\ntext"), (None, 3, "x", "> text"), (1, 5000, "z", "> Great.\nLate"), (1, 9000, "z", "> Late\nLater"),
    ]
    got = chat_quotes.link(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(0), "position": F.lit("x"), "key": F.lit(1), "parsed": F.lit(2), "a.b": F.lit(3)}))
    assert got.columns == ["conv_id", "turn", "role", "key", "parsed", "a.b", "own_text", "n_quotes", "parent_turn", "root_turn", "depth", "position"]
    found = {(r.conv_id, r.turn): (r.own_text, r.parent_turn, r.root_turn, r.depth, r.position) for r in got.collect()}
    assert found == {
        (1, 0): ("Hello there.\nHow are you?", None, 0, 0, 1), (1, 1): ("Fine, thanks.", 0, 0, 1, 2), (1, 2): ("Great.", 1, 0, 2, 3), (1, 3): ("Hi!", 0, 0, 1, 4), (1, 4): ("no quote", None, 4, 0, 1),
        (2, 0): ("", None, 0, 0, 1), (2, 1): ("text", None, 1, 0, 1), (None, 3): ("", None, 3, 0, 1), (1, 5000): ("Late", 2, 0, 3, 5), (1, 9000): ("Later", 5000, 0, 4, 6),
    }
    assert chat_quotes.link(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_chroma_aligns_shifted_recordings(spark):
    rng = np.random.default_rng(0)
    s = chroma.Settings(rate=8000, frame=512, hop=128, least_items=8)
    t = np.arange(8000 * 3) / 8000
    song = sum(np.sin(2 * np.pi * f * t) * (np.sin(t * k) > 0) for k, f in enumerate((220, 277, 330, 415, 494), 3))
    other = np.sin(2 * np.pi * 300 * t * (1 + t / 9))

    def pcm(x):
        return (x / np.abs(x).max() * 20000).astype("<i2").tobytes()

    late = np.concatenate([np.zeros(128 * 20), song])
    rows = [(1, pcm(song)), (2, pcm(late)), (3, pcm(other)), (4, pcm(song)), (5, None), (6, b""), (7, pcm(song + rng.normal(0, 0.01, len(song))))]
    got = {r.id: r for r in chroma.align(spark.createDataFrame(rows, "id long, pcm binary"), settings=s).collect()}
    assert got[4].class_id == 1 and got[1].recording_id == got[2].recording_id == got[7].recording_id == 1
    assert got[3].recording_id == 3 and got[5].class_id == got[6].class_id == 5
    offsets = {abs(r.offset) for r in (got[1], got[2]) if r.offset is not None}
    assert 20 in offsets
    assert chroma.align(spark.createDataFrame([], "id long, pcm binary")).count() == 0


def melody(seed: int, seconds: float, rate: int) -> np.ndarray:
    rng, parts, n = np.random.default_rng(seed), [], 0
    while n < seconds * rate:
        t = np.arange(int(rate * rng.uniform(0.15, 0.6))) / rate
        f = 220 * 2 ** (rng.integers(0, 24) / 12)
        parts.append(np.minimum(1, t * 40) * np.exp(-2 * t) * sum(np.sin(2 * np.pi * f * k * t) / k for k in (1, 2, 3)))
        n += len(t)
    line = np.concatenate(parts)[: int(seconds * rate)]
    return line / np.abs(line).max()


def test_chroma_recall_on_shifted_and_noisy_copies(spark):
    """All pairs by brute force over all offsets against the operator, on copies off the grid of frames, with noise, and on steady tones."""
    s, rng, rows = chroma.Settings(), np.random.default_rng(7), []
    for k in range(20):
        line = melody(k, 20, s.rate)
        rows.append((10 * k, line))
        for n, (part, db) in enumerate(((0.5, None), (0.25, 20), (0.5, 10))):
            copy = line[int(s.hop * (7 + part)) :]
            noise = 0 if db is None else rng.normal(0, np.sqrt((copy**2).mean() / 10 ** (db / 10)), len(copy))
            rows.append((10 * k + n + 1, copy + noise))
    t = np.arange(6 * s.rate) / s.rate
    rows += [(901, np.sin(2 * np.pi * 440 * t)), (902, 0.5 * np.sin(2 * np.pi * 440 * t + 1)[: 5 * s.rate])]
    pcm = [(k, (x / np.abs(x).max() * 20000).astype("<i2")) for k, x in rows]
    made = chroma.items([x.astype(np.float32) / 32767 for _, x in pcm], s)
    want = set()
    for i in range(len(made)):
        for j in range(i):
            if rows[i][0] // 10 == rows[j][0] // 10:
                found = (chroma.stretch(made[i], made[j], o, s.item_error) for o in range(-12, 13))
                if any(n >= s.least_items and wrong <= s.most_error * 32 * n for _, n, wrong in found):
                    want.add((rows[j][0], rows[i][0]))
    got = {r.id: r.recording_id for r in chroma.align(spark.createDataFrame([(k, x.tobytes()) for k, x in pcm], "id long, pcm binary")).collect()}
    assert len(want) > 100 and sum(got[a] == got[b] for a, b in want) >= 0.95 * len(want)
    assert got[901] == got[902] == 901 and len({got[10 * k] for k in range(20)}) == 20


def test_chroma_recall_on_document_bytes(spark):
    """Copies of texts behind a lead of any length, most of it off the grid of frames."""
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    rows = []
    for k in range(48):
        text = words(rng, 700, pool)
        rows += [(10 * k, text), (10 * k + 1, words(rng, 200, pool)[: 300 + 4 * k] + text)]
    got = {r.id: r.recording_id for r in chroma.align(spark.createDataFrame(rows, "id long, pcm string"), settings=chroma.BYTES, dtype="u1").collect()}
    assert sum(got[10 * k] == got[10 * k + 1] for k in range(48)) >= 0.9 * 48 and len({got[10 * k] for k in range(48)}) == 48


def test_chroma_recall_by_size_and_shift(spark):
    """Texts from the shortest that have an item, behind leads of every part of a hop: of the pairs that brute force over offsets aligns, nine in ten are found in each class at each shift."""
    rng, s = random.Random(22), chroma.BYTES
    texts = sorted({r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"]})
    rng.shuffle(texts)
    sizes, shifts = ((600, 1600), (1600, 2400), (2400, 4000), (4000, 9000)), (8, 20, 32, 44, 56)
    lead = "the quick brown fox jumps over the lazy dog and runs away again."
    rows, of = [], {}
    for n, (lo, hi) in enumerate(sizes):
        for text in [t for t in texts if lo <= len(t.encode()) < hi][:30]:
            k = 100 * (len(of) + 1)
            of[k] = n
            rows += [(k, text), *((k + shift, lead[:shift] + text) for shift in shifts)]
    raw = {k: np.frombuffer(t.encode(), np.uint8).astype(np.float32) / 128 - 1 for k, t in rows}
    made = dict(zip(raw, chroma.items(list(raw.values()), s), strict=True))
    got = {r.id: r for r in chroma.align(spark.createDataFrame(rows, "id long, pcm string"), settings=s, dtype="u1").collect()}
    for n in range(len(sizes)):
        for shift in shifts:
            pairs = []
            for k in (k for k, c in of.items() if c == n):
                a, b = made[k], made[k + shift]
                found = (chroma.stretch(a, b, o, s.item_error) for o in (-1, 0, 1, 2))
                if any(m >= min(s.least_items, len(a), len(b)) and wrong <= s.most_error * 32 * m for _, m, wrong in found):
                    pairs.append((k, k + shift))
            assert len(pairs) > 15 and sum(got[a].recording_id == got[b].recording_id for a, b in pairs) >= 0.9 * len(pairs), (sizes[n], shift)
    assert sum(got[k].offset is not None for k in got) > 0.9 * len(got)


def test_segments_are_maximal():
    rng = random.Random(6)
    for _ in range(300):
        scores = [-1.0 if rng.random() < 0.6 else rng.uniform(0.1, 3) for _ in range(rng.randint(1, 16))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
        want, todo = [], [(0, len(scores))]
        while todo:  # the definition: take the best segment, then look left and right of it
            lo, hi = todo.pop()
            best = max(((sum(scores[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] > 0:
                want.append((best[1], best[2] - 1, pytest.approx(best[0])))
                todo += [(lo, best[1]), (best[2], hi)]
        assert sorted((a, b, s) for s, a, b in got) == sorted(want, key=lambda x: x[:2])


@pytest.mark.parametrize("gap", [1, 7])
def test_segments_in_linear_time(gap):
    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        assert toxicity.segments([(k * gap, 0.5 + k % 3) for k in range(n)], 1.0)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_extreme_value_calibration():
    """Random tokens without any toxic passage: segments of a score occur as often as lambda and K say."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(3000):
        n = 400
        rate = 0.2 if k % 10 == 0 else 0.03
        at = np.flatnonzero(rng.random(n) < rate)
        rows.append((int(k % 10 == 0), n, list(zip(at.tolist(), rng.choice([1.0, 1.6, 2.3], len(at)).tolist(), strict=True))))
    model = toxicity.Model()
    toxicity._evidence_curve(model, rows)
    clean = [toxicity.segments(h, model.drift) for y, _, h in rows if not y]
    for level in (3.0, 4.5, 6.0):
        seen = sum(s >= level for found in clean for s, _, _ in found)
        expected = sum(np.exp(-model.surprise(level, 400)) for _ in clean)
        assert 0.4 < (seen + 1) / (expected + 1) < 2.5


def labelled(spark, n=300):
    rng = random.Random(8)
    pool = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        toxic, bad = k % 5 == 0, k % 4 == 0
        text = words(rng, 40, pool)
        if toxic:
            text += " grubbish snotter " + words(rng, 5, pool)
        if bad:
            text = " ".join(w.upper() + "###" for w in text.split()) if not toxic else text + " buy buy buy buy buy buy buy buy buy buy" * 4
        rows.append((k, text, "en", "s", 1))
        labels.append((k, 0 if bad else 1, int(toxic)))
    rows += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "x", "en", "s", 0)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame([*labels, labels[0], (n + 5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k].score >= 0.3) == (k % 5 == 0) for k in held]) > 0.97
    assert got[300].n_tokens == 0 and 0 <= got[300].score <= 1 and got[300].score == got[301].score
    assert toxicity.train(docs, labels.limit(0)).base == 0.0
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    model = knn_quality.train(docs, labels)
    got = {r.doc_id: r.quality.score for r in knn_quality.score(docs, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.3) == (k % 4 != 0) for k in held]) > 0.95
    assert got[300] == got[301] == pytest.approx(model.labels.mean())
    rng, texts = np.random.default_rng(2), [r.text for r in docs.collect()]
    turn = rng.permutation(len(model.labels))
    turned = knn_quality.Model(model.idf, model.axes, model.vectors[turn], model.labels[turn])
    assert np.allclose(turned.scores(texts)[0], model.scores(texts)[0], atol=0, rtol=0)
    assert np.allclose([model.scores([t])[0][0] for t in texts], model.scores(texts)[0], atol=0, rtol=0)
    text = docs.where("doc_id = 3").first().text  # cosines by hand
    v = model.place(knn_quality.frequencies([text]))[0]
    cosines = np.rint(model.vectors @ v * knn_quality.STEPS)
    near = np.flatnonzero(cosines >= np.sort(cosines)[-knn_quality.NEIGHBOURS])
    assert got[3] == pytest.approx((cosines[near] * model.labels[near]).sum() / cosines[near].sum(), abs=1e-5)
    assert knn_quality.score(docs, knn_quality.train(docs, labels.limit(0))).where("quality.score <> 0.5").count() == 0


def test_recurrent_gradients():
    rng = np.random.default_rng(1)
    cell = langid.Cell(*(rng.standard_normal(s).astype(np.float64) * 0.5 for s in ((256, 9), (3, 6), (3, 3))))
    x = rng.integers(0, 256, (5, 4)).astype(np.uint8)
    out_grad = rng.standard_normal((5, 4, 3)).astype(np.float32)

    def loss():
        return float((cell.forward(x).astype(np.float64) * out_grad).sum())

    kept: list = []
    cell.forward(x, kept)
    for weight, grad in zip((cell.wx, cell.wh, cell.wc), cell.backward(x, kept, out_grad), strict=True):
        for at in zip(*(rng.integers(0, n, 6) for n in weight.shape), strict=True):
            at = (int(x[0, 0]), at[1]) if weight is cell.wx else at
            old = weight[at]
            weight[at] = old + 1e-3
            up = loss()
            weight[at] = old - 1e-3
            down = loss()
            weight[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-3, abs=3e-2)


def test_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 60)
    rng = random.Random(3)
    pools = {"aa": ["kana", "moto", "naka", "toko"], "bb": ["schte", "brü", "gend", "ßer"]}
    rows = [(k, words(rng, 30, pools["aa" if k % 2 else "bb"]), "aa" if k % 2 else "bb", "s", 0) for k in range(60)]
    rows += [(60, None, "aa", "s", 0), (61, "123 !!", "aa", "s", 0), (62, "gend " * 20_000, None, "s", 0), (63, "x" * 5000, "bb", "s", 0), (None, "kana moto", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    net = langid.fit([r[1] for r in rows[:40]], [r[2] for r in rows[:40]], steps=60)
    got = {r.doc_id: r.language for r in langid.identify(docs, net).collect()}
    assert all(got[k].lang == ("aa" if k % 2 else "bb") for k in range(60)) and got[62].lang == "bb" and got[None].lang == "aa"
    assert got[60].lang == got[61].lang == "und" and 0 <= got[3].score <= 1.000001
    whole = np.concatenate([net.positions(w.encode()) for w in rows[0][1].split()]).mean(0)
    assert np.allclose(got[0].probabilities, whole, atol=1e-5)
    assert net.positions(b"gend").shape == (4, 2)
    none = langid.identify(docs, langid.fit([], []))
    assert none.where("language.lang <> 'und'").count() == 0


def test_near_copies_from_four_fifths(spark, monkeypatch):
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(300)]
    boiler = words(rng, 12, pool)
    texts = [None, "", " ", "a b", "A  b", "a b c"]
    for k in range(30):
        base = words(rng, rng.randint(5, 120), pool).split()
        texts.append(" ".join(base) + (" " + boiler if k % 3 == 0 else ""))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(" ".join(copy[rng.randint(0, 4) :]) + (" " + boiler if k % 3 == 0 else ""))
    texts += [" ".join(f"c{k}" for k in range(60)) + f" {e}" for e in ("x", "y", "z")] + [texts[8]]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root, found = [shingles(t) for t in texts], list(range(len(texts))), []
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or 5 * len(sets[a] & sets[b]) >= 4 * both:
                found.append(1.0 if not both else len(sets[a] & sets[b]) / both)
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    assert sum(0.8 <= j < 0.9 for j in found) > 20
    docs = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), (7, texts[7])], "doc_id long, text string")
    for tile, files in ((1 << 12, 4 << 20), (16, 2000)):  # neither the tiles nor the files may change the result
        monkeypatch.setattr(near_copies, "TILE", tile)
        monkeypatch.setattr(near_copies, "FILE_BYTES", files)
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(set(root))
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_chroma_finds_every_pair_behind_a_common_key(spark, monkeypatch):
    rng = np.random.default_rng(12)

    def noise(n):
        return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    own = []
    for _ in range(12):
        a = noise(24)
        b = a ^ (np.uint32(1) << rng.integers(0, 32, 24).astype(np.uint32))
        b[10:20] = a[10:20]
        decoy = noise(24)  # it has the keys that a and b share, and aligns with neither
        decoy[3:13] = a[10:20]
        own += [a, np.concatenate([noise(5), b]), decoy, noise(9)]
    prints = rng.permutation(len(own)).tolist()
    root, at = list(range(len(own))), [chroma.all_keys(x, [], chroma.Settings())[:2] for x in own]
    for i in range(len(own)):
        for j in range(i):
            offsets = [q - p for p, h in zip(*at[i], strict=True) for q, g in zip(*at[j], strict=True) if g == h]
            if offsets:
                _, n, wrong = chroma.stretch(own[i], own[j], max(offsets, key=offsets.count), 10)
                if n >= 16 and wrong <= 0.15 * 32 * n:
                    root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert sum(prints[k + 2] < min(prints[k], prints[k + 1]) for k in range(0, len(own), 4)) > 1 and len(set(root)) == 36
    made = spark.createDataFrame([(k, x.view(np.int32).tolist(), p, []) for k, (x, p) in enumerate(zip(own, prints, strict=True))], "id long, items array<int>, print long, late array<array<int>>")
    monkeypatch.setattr(chroma, "fingerprint", lambda *_, **__: made)
    got = sorted(chroma.align(made, pcm_col="items", settings=chroma.Settings(least_items=16)).collect())
    assert [r.recording_id for r in got] == root
    for r in got:  # both ends of an alignment name it
        assert (r.offset is None) == (root.count(root[r.id]) == 1)
        if r.offset is not None:
            assert got[r.aligned_with].aligned_with == r.id and got[r.aligned_with].offset == -r.offset


def test_quality_scores_do_not_depend_on_the_batch(spark, texts):
    """Equal texts score alike to the last digit, whatever comes with them."""
    rng = random.Random(12)
    pool = [f"q{k}" for k in range(300)]
    many = [words(rng, rng.randint(1, 80), pool) for _ in range(300)] + texts
    sample = spark.createDataFrame([(t, k % 2) for k, t in enumerate(many[:200])], "text string, y int")
    model = knn_quality.fit(sample)
    whole, _ = model.scores(many)
    for size in (1, 7, 97):
        parts = np.concatenate([model.scores(many[k : k + size])[0] for k in range(0, len(many), size)])
        assert (parts == whole).all()
    back, _ = model.scores(many[::-1])
    assert (back[::-1] == whole).all()


CLASHES = ["made", "result", "fp", "overlap", "toxicity", "quality", "language", "c0", "c1", "k0", "text_", "a.b", "no_id", "id", "hash", "name", "items", "print", "position", "depth", "TEXT2", "row"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, tied and repeated rows, with columns called like the operators' own."""
    rng = random.Random(13)
    pool = [f"t{k}" for k in range(200)]
    texts = [None, "", " ", "x", "same text here", "same text here", words(rng, 9000, pool), "é" * 3000, *(words(rng, 30, pool) for _ in range(12))]
    rows = [(k, t, "en" if k % 2 else None, "s", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None)], DOC)
    return df.withColumns({c: F.lit("z") for c in CLASHES})


def stages(spark, folder):
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(8, 20)] + [(8, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some benchmark words that no text has at all"), (None, None)], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", items)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return [stage for _, stage in corpus_pipeline.STAGES]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, odd, tmp_path, empty):
    df = odd.limit(0) if empty else odd
    for k, stage in enumerate(stages(spark, str(tmp_path))):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        assert out.count() <= (0 if empty else 60)


@pytest.mark.parametrize("empty", [False, True])
def test_operators_on_odd_tables(spark, odd, tmp_path, empty, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    df = odd.limit(0) if empty else odd
    n = df.count()
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(8, 20)], "doc_id long, quality int, toxic int").withColumn("text", F.lit(1))
    items = spark.createDataFrame([(1, "t1 t2 t3"), (2, None)], "item_id long, text string").withColumns({"id": F.lit(1), "item_id2": F.lit(2)})
    made = [
        (toxicity.score(df, toxicity.train(df, labels)), "toxicity"), (knn_quality.score(df, knn_quality.train(df, labels)), "quality"), (langid.identify(df, langid.train(df)), "language"),
        (decontaminate.occurrences(df, items), "overlap"), (simhash.with_fingerprint(df), "fp"),
    ]
    for out, name in made:
        assert out.columns == [*(c for c in df.columns if c != name), name] and out.count() == n
        if not empty:  # repeated rows and equal texts come out alike
            same = {str(r[name]) for r in out.where("text = 'same text here'").collect()}
            assert len(same) == 1
    assert simhash.near_duplicates(df).count() == n
    assert chroma.align(df, id_col="doc_id", pcm_col="text", settings=chroma.BYTES, dtype="u1").count() == n
    assert chat_quotes.link(df, conv_col="source", turn_col="doc_id").count() == n
    assert near_copies.keep_one(df).columns == df.columns
    shards = token_store.write(df, scratch(spark, "odd"))
    assert sum(s[2] for s in shards) == n and packing.pack(df).select("doc_id").distinct().count() == (0 if empty else 21)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *(f"`{c}`" for c in CLASHES))
    assert warc.read(warc.write(pages, scratch(spark, "odd"))).count() == n
