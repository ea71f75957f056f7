"""Reviews, pictures and rules in one pass, against what they were put together from."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from evidentia.operators import assignment, diffing, greedy, integrity, rasters, rules
from tests.conftest import rows
from tests.test_diffing import table

SMALLEST = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_hints_equal_their_parts(spark, monkeypatch):
    monkeypatch.setattr(integrity, "_PAIRS", 40)
    rng = random.Random(13)
    words = ["Total sales", "total  SALES", "Sign in", "Sign on", "", None]
    made = []
    for page, seq in ((p, s) for p in (*range(80), 900, None) for s in range(rng.randint(0, 9) if p != 900 else 60)):
        for shown in (False, True):
            x, y = (rng.randint(0, 30), rng.randint(0, 20)) if rng.random() < 0.95 or shown else (None, 3)
            roles = sum(bit for bit in (integrity.TEXT, integrity.CONTROL, integrity.DIVIDER) if rng.random() < 0.5)
            made.append((page, seq, x, y, (x or 0) + rng.randint(0, 50), y + rng.randint(1, 40), shown, roles, rng.choice(words), rng.choice([None, 12.0, 12.05, 12.25, 13.5]), rng.choice([True, True, False, None]), rng.choice([None, 0.0, 1.0, 8.0]), True))
    boxes = spark.createDataFrame(made, "page long, seq int, x0 int, y0 int, x1 int, y1 int, shown boolean, roles int, value string, font_size double, level boolean, thickness double, selectable boolean").cache()

    def of(bit, shown, **names):
        side = F.when(F.col("level"), "horizontal").when(~F.col("level"), "vertical")
        return boxes.where((F.col("shown") == shown) & (F.col("roles").bitwiseAND(bit) != 0)).withColumn("orientation", side).withColumns({k: F.col(v) for k, v in names.items()})

    texts = integrity.text_matches(of(integrity.TEXT, False), of(integrity.TEXT, True, text="value"), "page")
    controls = integrity.control_matches(of(integrity.CONTROL, False, label="value"), of(integrity.CONTROL, True, name="value"), "page")
    known = of(integrity.DIVIDER, False).where("x0 IS NOT NULL")
    lines = integrity.line_matches(known, of(integrity.DIVIDER, True), "page")
    want = rows(integrity.repair_hints(texts, controls, lines, "page"))
    got = integrity.page_hints(boxes.where(f"x0 IS NOT NULL OR (roles & {integrity.DIVIDER}) = 0"), "page")
    at = boxes.where(f"x0 IS NULL AND (roles & {integrity.DIVIDER}) <> 0").withColumn("roles", F.col("roles").bitwiseAND(~integrity.DIVIDER))
    assert rows(integrity.page_hints(boxes.where(f"x0 IS NOT NULL OR (roles & {integrity.DIVIDER}) = 0").unionByName(at), "page")) == want
    assert {r[3] for r in want} == {k for k, _ in integrity.HINTS} and [tuple(c) for c in got.dtypes] == [tuple(c) for c in integrity.repair_hints(texts, controls, lines, "page").dtypes]
    assert integrity.page_hints(boxes.limit(0), "page").count() == 0


def test_repairs_shuffle_boxes_not_pairs(spark):
    plan = plan_of(__spark_entry__.queries()["page_repairs"](spark, SMALLEST))
    assert "Join" not in plan and "MapInArrow" in plan


def test_paragraphs_are_dealt_out_side_by_side(spark, monkeypatch):
    rng, tables = random.Random(17), []
    vocabulary = ["total", "Sales", "sign-in", "Straße", "\u0421\u043e\u0441", "plan", "q3", "\U0001f600", "of", "the"]
    asked = [("", ["total"], True), ("total", ["total", "sales"], False), ("- –", ["plan", "of"], True)]
    for _ in range(300):
        said = [rng.choice(vocabulary) for _ in range(rng.randint(2, 24))]
        at = sorted(rng.sample(range(len(said) + 1), min(len(said) + 1, rng.randint(2, 6))))
        seen = [" ".join(said[i:j]).translate(str.maketrans("oeil", "0c1l") if rng.random() < 0.6 else {}) for i, j in zip(at, at[1:], strict=False)]
        asked.append((" ".join(said), seen, rng.random() < 0.5))
    one_by_one = [assignment.partition(*a) for a in asked]
    exact = greedy.closenesses_at

    def compared(*args):
        tables.append(len(args[1][0]))
        return exact(*args)

    monkeypatch.setattr(greedy, "closenesses_at", compared)
    assert assignment.partitions(asked) == one_by_one and sum(x is not None for x in one_by_one) > 100
    assert len(tables) < len(asked)  # not even one comparison for each paragraph
    monkeypatch.setattr(assignment, "_SUMS", 50)
    assert assignment.partitions(asked) == one_by_one and assignment.partitions([]) == []
    plan = plan_of(__spark_entry__.queries()["row_assignments"](spark, SMALLEST))
    assert "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan


def test_rules_by_arrays_equal_rules_by_tables(spark, monkeypatch):
    rng, pixels = random.Random(23), []
    for picture in range(30):
        for _ in range(rng.randint(0, 7)):
            y, x0, on, off, shade = rng.randint(0, 179), rng.randint(0, 120), rng.choice([1, 3, 4, 7, 40]), rng.choice([0, 2, 4, 12, 14]), rng.choice([0, 90, 200, 247, 253])
            color = tuple(min(255, shade + rng.choice([0, 0, 10, 40])) for _ in range(3))
            slope = rng.choice([0, 0, 0.006, -0.012])
            pixels += [(picture, x, round(y + (x - x0) * slope), *color) for x in range(x0, x0 + rng.randint(40, 290)) if (x - x0) % (on + off) < on]
        pixels += [(picture, rng.randint(0, 419), rng.randint(0, 179), *rng.choices(range(256), k=3)) for _ in range(60)]
    pixels = list({p[:3]: p for p in pixels}.values())
    pixels += [(31, x, y, 5, 5, 5) for y in (50, 51) for x in range(2**30 - 5, 2**30 + 300) if x % 8 < 4]  # places beyond four bytes
    ink = spark.createDataFrame(pixels, "image_id long, x int, y int, b int, g int, r int").cache()
    white = (255, 255, 255)
    want = rows(rules._by_tables(ink, 420, 180, "image_id", white, None))
    dashed, large = rules._measured(ink, 420, 180, "image_id", white)
    assert rows(dashed) == [r for r in want if r[0] != 31] and len(want) > 20 and {r[0] for r in want} > {31}
    assert [r[0] for r in large.select("image_id").distinct().collect()] == [31]
    whole = rows(rules.dashed_rules(ink, 420, 180))
    monkeypatch.setattr(rules, "LARGE", 400)
    monkeypatch.setattr(rules, "_HELD", 1000)
    assert rows(rules.dashed_rules(ink.repartition(3), 420, 180)) == whole and rules._measured(ink, 420, 180, "image_id", white)[1].select("image_id").distinct().count() > 5
    assert rows(rules._unpacked(rules._packed(ink, "image_id"), "image_id", ink)) == rows(ink.select("image_id", "x", "y", "b", "g", "r"))
    assert rules.dashed_rules(ink.limit(0), 420, 180).count() == 0


def test_held_parts_equal_labels():
    rng = np.random.default_rng(5)
    masks = [(rng.random((h, w)) < share) + (rng.random((h, w)) < 0.03) for h, w, share in ((1, 1, 1.0), (1, 9, 0.6), (9, 1, 0.6), (40, 31, 0.3), (40, 31, 0.6), (25, 64, 0.5), (6, 6, 0.0))]
    snake = np.zeros((21, 21), int)
    snake[::2], snake[1::4, -1], snake[3::4, 0], snake[0, 0] = 1, 1, 1, 2
    for mask in (*masks, snake, snake[::-1] * 1):
        mask = mask.astype(np.uint8)
        found, n = rasters.label(mask > 0, True)
        keep = np.zeros(n + 1, bool)
        keep[found[mask == 2]] = True
        assert np.array_equal(rasters.held(mask), keep[found])


@pytest.mark.parametrize("size", [256, 17, 8])
def test_differences_equal_those_of_tiles(spark, size):
    want = diffing.compared(table(spark), size=size)[0]
    got = diffing.differences(table(spark), size=size)
    assert rows(got) == rows(want) and got.dtypes == want.dtypes and want.count() > 3
    assert diffing.differences(table(spark).limit(0)).count() == 0


def test_small_pictures_meet_no_join(spark):
    plan = plan_of(__spark_entry__.queries()["picture_differences"](spark, SMALLEST))
    assert "Join" not in plan and "Union" not in plan
