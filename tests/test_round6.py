"""Pairs of texts that are passed over by a bound, and steps that need no joined rows."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from evidentia.llm import encode
from evidentia.operators import greedy, integrity, projections
from tests.conftest import rows

SMALLEST = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def longest(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_subsequence_bounds_what_is_compared():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdé\U0001f600") for _ in range(n)) for n in (1, 2, 5, 17, 40, 63, 64, 65, 90, 199) for _ in range(4)]
    pairs = [(a, b) for a in texts for b in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    size = np.array([len(t) for t in texts])
    starts, n = np.cumsum(size) - size, len(texts)
    first, second = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    got = greedy._subsequence((code, code), [starts[first], starts[second]], [size[first], size[second]])
    assert got.tolist() == [longest(a, b) if min(len(a), len(b)) <= 64 else min(len(a), len(b)) for a, b in pairs]
    for least, found in ((x, greedy.closenesses(pairs, x).tolist()) for x in (0.5, 0.68, 0.9)):
        want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
        assert all(g == w if w >= least else g < least for g, w in zip(found, want, strict=True))


def test_spans_meet_their_candidates_without_a_join(spark):
    plan = plan_of(__spark_entry__.queries()["span_assignments"](spark, SMALLEST))
    assert "Join" not in plan and "MapInArrow" in plan


def test_page_review_equals_its_parts(spark):
    rng = random.Random(11)
    words, kinds = ["Total sales", "total  SALES", "Sign in", "Sign on", "", None], ["img", "background-image", "svg", None]
    made = []
    for page, seq in ((p, s) for p in (*range(60), None) for s in range(rng.randint(0, 9))):
        for shown in (False, True):
            x, y = rng.randint(0, 30), rng.randint(0, 20)
            side = [integrity.TEXT, integrity.CONTROL, integrity.ART, *((integrity.RASTER,) if shown else (integrity.ALLOWED_REGION, integrity.DIVIDER, integrity.READ))]
            roles = sum(bit for bit in side if rng.random() < 0.5)
            role = rng.choice(["photo", "alpha-masked-background-artwork", None])
            made.append((page, seq, x, y, x + rng.randint(0, 50), y + rng.randint(1, 40), shown, roles, rng.choice(words), rng.choice(["/\\_/\\", "\r\n/\\_/\\ \n", None]), rng.choice(kinds) if shown else role, rng.choice([True, True, False, None]), rng.choice(["PRE", None]), rng.choice(["url(x)", "none", None]), role, rng.choice([True, False, None])))
    schema = "page long, seq int, x0 int, y0 int, x1 int, y1 int, shown boolean, roles int, value string, drawing string, kind string, selectable boolean, white_space string, src string, role string, trusted boolean"
    boxes = spark.createDataFrame(made, schema).cache()

    def of(bit, shown, **names):
        return boxes.where((F.col("shown") == shown) & (F.col("roles").bitwiseAND(bit) != 0)).withColumns({k: F.col(v) for k, v in {"font_size": "y0", **names}.items()})

    texts = integrity.text_matches(of(integrity.TEXT, False), of(integrity.TEXT, True, text="value"), "page")
    art = of(integrity.ART, False, text="drawing")
    drawings = integrity.art_matches(art, of(integrity.ART, True, text="drawing"), "page")
    controls = integrity.control_matches(of(integrity.CONTROL, False, label="value"), of(integrity.CONTROL, True, name="value"), "page")
    audit = integrity.raster_audit(of(integrity.RASTER, True), of(integrity.ALLOWED_REGION, False), of(integrity.READ, False), art, of(integrity.DIVIDER, False), 60, 40, "page")
    want = rows(integrity.verdicts(boxes.select("page").distinct(), "page", texts, drawings, controls, audit))
    got = integrity.page_review(boxes, "page", 60, 40)
    assert rows(got) == want and {x["code"] for r in want for x in r[2]} == set(integrity.REASONS)
    assert integrity.page_review(boxes.limit(0), "page", 60, 40).count() == 0


def test_page_verdicts_need_no_join(spark):
    assert "Join" not in plan_of(__spark_entry__.queries()["page_verdicts"](spark, SMALLEST))


def test_likeliest_labels_sum_once(spark):
    made = spark.createDataFrame([([0.1, 0.3, 0.3],), ([0.5],), ([],), (None,), ([0.2, None],)], "s array<double>").select(projections.likeliest_labels(F.col("s"), ["a", "b", "c"]).alias("t"))
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in made.collect()] == [[("b", 0.5), ("c", 0.5)], [("a", 1.0)], [], None, []]
    # the sum and the maximum are told once, not within what is done for each element
    told = made._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("aggregate(") == told.count("array_max(") == 1


def test_words_are_learned_once_each():
    enc = encode.Encoder(encode.default_path())
    rng = random.Random(3)
    pieces = ["word", "Word.", "word.", "a", ".", "...", "x\ty", "x\ty.", "one\ntwo", "one.\ntwo,", "one.\n", "\ntwo", "a\n\nb", "a\n b", " ", "é!", "ΑΣ.Α", "\x1c", "1.", "a\nb\nc", ""]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    for k in range(0, len(texts), 40):
        want = [np.array(x.ids, enc.dtype).tobytes() for x in enc._tok.encode_batch(texts[k : k + 40], add_special_tokens=False)]
        assert [bytes(x) for x in enc.encode(texts[k : k + 40])] == want
    asked: list[str] = []
    apart = enc._apart
    enc._apart = lambda words: asked.extend(words) or apart(words)
    enc.encode(["fresh1 fresh1. fresh1, fresh2", "fresh2! fresh1"])
    assert sorted(asked) == ["fresh1", "fresh1,", "fresh1.", "fresh2"]
    enc._learn(["other", "other", "othera."], ["\x01other", "\x01other"])
    assert asked[4:] == ["other", "othera"]
