"""Claims of references on pages, and words by consensus, against plain loops over all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from evidentia.operators import consensus, integrity

BOX = "x0 int, y0 int, x1 int, y1 int"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def look(v):
    return "".join(c for c in (v or "").casefold() if c.isalnum())


def coverage(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return max(w, 0) * max(h, 0) / max(1, (a[2] - a[0]) * (a[3] - a[1]))


def boxes(rng, n):
    out = []
    for _ in range(n):
        x, y = rng.randint(0, 200), rng.randint(0, 120)
        out.append((x, y, x + rng.randint(1, 90), y + rng.randint(1, 40)))
    return out


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_texts_equal_plain_claims(spark):
    rng = random.Random(3)
    said = ["Total sales", "Sign in", "sign-in", "", None, "Totl saIes", "…"]
    refs = [(p, k, *b, rng.choice(said), rng.choice([None, 12.0])) for p in range(25) for k, b in enumerate(boxes(rng, 6))]
    nodes = [(p, k, *b, rng.choice(said), rng.random() < 0.8, rng.choice([None, 12.0, 14.5])) for p in range(24) for k, b in enumerate(boxes(rng, 7))]
    nodes += [(p, 50 + k, r[2] + 1, r[3], r[4] + 1, r[5], r[6], True, 13.0) for p in range(24) for k, r in enumerate(refs) if r[0] == p and k % 2]
    got = integrity.text_matches(table(spark, refs, f"page long, seq int, {BOX}, value string, font_size double"), table(spark, nodes, f"page long, seq int, {BOX}, text string, selectable boolean, font_size double"), "page")
    want = {}
    for p in range(25):
        used = set()
        for _, k, *rest in (r for r in refs if r[0] == p):
            box, value = rest[:4], look(rest[4])
            found = []
            for _, j, *other in sorted(n for n in nodes if n[0] == p and n[1] not in used):
                over = coverage(box, other[:4])
                alike = ratio(value, look(other[4])) if value and look(other[4]) else 0.0
                if over >= 0.12:
                    found.append((0.7 * alike + 0.3 * min(over, coverage(other[:4], box)), j, alike))
            if not found:
                want[p, k] = ("missing", None)
                continue
            _, j, alike = max(found, key=lambda f: f[0])
            taken = not value or alike >= 0.72
            used |= {j} if taken else set()
            want[p, k] = ("matched" if taken else "mismatch", j)
    assert {(r["page"], r["seq"]): (r["outcome"], r["candidate"]) for r in got.collect()} == want
    assert len({o for o, _ in want.values()}) == 3


def test_controls_equal_plain_claims(spark):
    rng = random.Random(5)
    names = ["Save", "Save all", "Cancel", "", None]
    refs = [(p, k, *b, rng.choice(names)) for p in range(25) for k, b in enumerate(boxes(rng, 5))]
    controls = [(p, k, *b, rng.choice(names)) for p in range(24) for k, b in enumerate(boxes(rng, 6))] + [(p, 70 + k, *r[2:6], rng.choice(names)) for p in range(24) for k, r in enumerate(refs) if r[0] == p]
    got = integrity.control_matches(table(spark, refs, f"page long, seq int, {BOX}, label string"), table(spark, controls, f"page long, seq int, {BOX}, name string"), "page")
    want = {}
    for p in range(25):
        used = set()
        for _, k, *rest in (r for r in refs if r[0] == p):
            label, good, bad = look(rest[4]), [], []
            for _, j, *other in sorted((c for c in controls if c[0] == p and c[1] not in used), key=lambda c: c[1]):
                over, name = coverage(rest[:4], other[:4]), look(other[4])
                if over >= 0.2:
                    alike = (ratio(label, name) if name else 0.0) if label else 1.0
                    (bad if label and alike < 0.65 else good).append((0.8 * over + 0.2 * alike, over, j))
            if good:
                j = max(good, key=lambda f: f[0])[2]
                used.add(j)
                want[p, k] = ("matched", j)
            else:
                want[p, k] = ("mismatch", max(bad, key=lambda f: f[1])[2]) if bad else ("missing", None)
    assert {(r["page"], r["seq"]): (r["outcome"], r["candidate"]) for r in got.collect()} == want
    assert len({o for o, _ in want.values()}) == 3


def test_lines_equal_plain_claims(spark):
    rng = random.Random(6)

    def some(n):
        return [(p, k, *b, rng.choice(["horizontal", "vertical", "horizontal", None])) for p in range(30) for k, b in enumerate(boxes(rng, n))]

    refs, lines = [(*r, rng.choice([None, 1, 8])) for r in some(4)], some(rng.randint(3, 5))
    got = integrity.line_matches(table(spark, refs, f"page long, seq int, {BOX}, orientation string, thickness int"), table(spark, lines, f"page long, seq int, {BOX}, orientation string"), "page")
    want = {}
    for p in range(30):
        used = set()
        for _, k, *rest in (r for r in refs if r[0] == p):
            box, side, thick = rest[:4], rest[4], rest[5] or 1
            if side is None:
                continue
            a, c = (0, 1) if side == "horizontal" else (1, 0)
            free = [(abs(o[c] - box[c]) + 0.25 * abs((o[a + 2] - o[a]) - (box[a + 2] - box[a])) + 0.1 * abs(o[a] - box[a]), j, o) for _, j, *o in lines if _ == p and o[4] == side and j not in used]
            if not free:
                want[p, k] = ("missing", None)
                continue
            _, j, o = min(free, key=lambda f: f[0])
            fits = abs(o[c] - box[c]) <= max(12, thick * 4) and o[a + 2] - o[a] >= max(8, (box[a + 2] - box[a]) * 0.5)
            used |= {j} if fits else set()
            want[p, k] = ("matched" if fits else "displaced", j)
    assert {(r["page"], r["seq"]): (r["outcome"], r["candidate"]) for r in got.collect()} == want
    assert len({o for o, _ in want.values()}) == 3


def test_rasters_and_verdict(spark):
    rasters = [
        (1, 0, 0, 0, 50, 50, "img", None, "photo", None), (1, 1, 0, 0, 200, 90, "background-image", "linear-gradient(red)", None, None), (1, 2, 100, 0, 150, 40, "canvas", "url(x)", None, None), (1, 3, 300, 0, 301, 1, "img", None, None, None),
        (1, 4, 0, 0, 400, 90, "background-image", "url(x)", "alpha-masked-background-artwork", True), (2, 0, 0, 0, 400, 90, "background-image", "url(x)", "alpha-masked-background-artwork", False), (2, 1, 0, 0, 9, 9, "svg", None, None, None),
    ]
    made = table(spark, rasters, f"page long, seq int, {BOX}, kind string, src string, role string, trusted boolean")
    allowed = table(spark, [(1, 0, 0, 0, 60, 60, "other"), (1, 1, 0, 0, 50, 50, "photo"), (1, 2, 0, 0, 400, 100, "alpha-masked-background-artwork"), (2, 0, 0, 0, 400, 100, "alpha-masked-background-artwork")], f"page long, seq int, {BOX}, kind string")
    layer = f"page long, seq int, {BOX}"
    texts, art, lines = (table(spark, rows, layer) for rows in ([(1, 0, 110, 0, 140, 10), (2, 0, 5, 5, 50, 20)], [(2, 0, 0, 0, 4, 4)], [(1, 0, 0, 60, 400, 61)]))
    audit = integrity.raster_audit(made, allowed, texts, art, lines, 400, 100, "page")
    got = {(r["page"], r["seq"]): tuple(r)[2:] for r in audit.collect()}
    assert got == {
        (1, 0): (True, 1, False, False, False, 0.0625, False, False, False), (1, 2): (False, 2, True, False, False, 0.05, False, False, False), (1, 3): (True, 2, False, False, False, 0.00003, False, False, False),
        (1, 4): (True, 2, False, False, False, 0.9, False, False, False), (2, 0): (False, 0, True, True, False, 0.9, True, False, True),
    }
    outside = integrity.raster_audit(made, allowed.where("seq < 2 AND page = 1"), texts, art, lines, 400, 100, "page").where("page = 1")
    assert {r["seq"]: (r["allowed"], r["outside"]) for r in outside.collect()} == {0: (True, False), 2: (False, True), 3: (False, False), 4: (False, True)}
    none = table(spark, [], "page long, seq long, outcome string, selectable boolean, candidate long, preformatted boolean, similarity double, error long, font_delta double")
    matched = table(spark, [(2, 7, "missing", None), (2, 3, "matched", False), (2, 5, "missing", None), (3, 1, "matched", True)], "page long, seq long, outcome string, selectable boolean")
    pages = table(spark, [(1,), (2,), (3,)], "page long")
    out = {r["page"]: (r["web_pass"], [(x["code"], x["seqs"]) for x in r["reasons"]]) for r in integrity.verdicts(pages, "page", matched, none, none, audit.where("page = 2")).collect()}
    assert out[1] == out[3] == (True, [])
    assert out[2] == (False, [("missing-live-text", [5, 7]), ("unselectable-live-text", [3]), ("raster-overlaps-text", [0]), ("raster-overlaps-symbol-art", [0]), ("full-reference-raster", [0]), ("untrusted-background-raster", [0])])


def test_consensus_equals_comparison_with_every_entry(spark):
    rng = random.Random(9)
    pool = ["revenue", "Revenues", "quarter", "CRAVE", "craven", "total", "Totals", "größe", "ab", "margin", "margins", "forecast"]

    def noisy(word):
        return "".join(rng.choice("xl0") if rng.random() < 0.2 else c for c in word)

    rows = []
    for d in range(120):
        for k in range(rng.randint(1, 9)):
            word = rng.choice(pool)
            rows.append((d, k, *rng.choice([
                (noisy(word), None, "unresolved"), (noisy(word), None, None), (f"{word} and {rng.choice(pool)}", None, "confirmed"), (word, f"{rng.choice(pool)}, {word}", "confirmed"),
                (word, noisy(word), "regional-fragment-consensus"), (None, None, None), ("two words", None, None), (word, word, "unresolved"),
            ])))
    got = consensus.repeated_words(spark.createDataFrame(rows, "doc long, seq int, value string, preferred string, status string"), "doc")
    want = {}
    import re

    for d in range(120):
        known = {}
        own = [r[1:] for r in rows if r[0] == d]
        for _, value, preferred, status in own:
            said = preferred or (value if status == "confirmed" else None)
            if said and status not in ("unresolved", "regional-fragment-consensus"):
                for w in re.findall(r"[^\W_]+", said):
                    if 4 <= len(look(w)) <= 32:
                        known.setdefault(look(w), w)
        for seq, value, preferred, status in own:
            weak = status == "regional-fragment-consensus"
            words = re.findall(r"[^\W_]+", value or "")
            if not weak and (preferred or len(words) != 1):
                continue
            o = look(preferred if weak else words[0])
            ranked = sorted(((ratio(o, n), n, w) for n, w in known.items() if min(len(o), len(n)) / max(len(o), len(n)) >= 0.8), reverse=True) if 4 <= len(o) <= 32 else []
            if ranked and ranked[0][0] >= 0.6 and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= 0.12):
                want[d, seq] = (ranked[0][2], round(ranked[0][0], 3))
    assert {(r["doc"], r["seq"]): (r["word"], r["confidence"]) for r in got.collect()} == want and len(want) > 30
