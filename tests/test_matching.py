"""Span and row assignment against exhaustive search."""

from __future__ import annotations

import itertools
import random
import re
from difflib import SequenceMatcher

from evidentia.operators import assignment

WORD = r"[^\W_]+(?:['’\-–—][^\W_]+)*"


def look(value):
    return "".join(c for c in value.casefold() if c.isalnum())


def noisy(rng, text):
    return "".join(rng.choice("0cxl") if rng.random() < 0.12 else c for c in text)


def made_crops(seed, n):
    rng = random.Random(seed)
    pool = ["crave", "more", "chart", "total", "don't", "of", "a", "naïve", "grid-line", "x1", "Sum", "is", "plan", "Größe", "now"]
    crops = []
    for k in range(n):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        phrase = " ".join(w + rng.choice(["", "", ",", "."]) for w in words)
        values, i = [], 0
        while i < len(words):
            j = i + rng.randint(1, 4)
            values.append(noisy(rng, " ".join(words[i:j])))
            i = j
        rng.shuffle(values)
        crops.append((k, phrase, values + rng.choice([[], [None], ["", "..."], values[:1], ["unrelated words here"]])))
    return crops


def exhaustive_spans(phrase, values):
    words = [m.span() for m in re.finditer(WORD, phrase)]
    found = []
    for seq, value in enumerate(values):
        target = look((value or "").strip())
        n = max(1, len(re.findall(WORD, value or "")))
        for i, j in itertools.combinations(range(len(words) + 1), 2):
            segment = phrase[words[i][0] : words[j - 1][1]]
            if not target or abs(j - i - n) > 2 or not look(segment):
                continue
            ratio = min(len(target), len(look(segment))) / max(len(target), len(look(segment)))
            close = SequenceMatcher(None, target, look(segment)).ratio()
            if ratio >= 0.65 and close >= 0.68:
                found.append((close - 0.08 * (1 - ratio), -len(look(segment)), seq, words[i][0], segment))
    out, taken = [], []
    for score, _, seq, start, segment in sorted(found, reverse=True):
        if all(seq != s for s, *_ in out) and all(start >= b or start + len(segment) <= a for a, b in taken):
            out.append((seq, start, segment, score))
            taken.append((start, start + len(segment)))
    return out


def test_spans_equal_exhaustive_search(spark):
    crops = made_crops(1, 160)
    phrases = spark.createDataFrame([(k, p) for k, p, _ in crops] + [(999, None)], "crop long, phrase string")
    candidates = spark.createDataFrame([(k, s, v) for k, _, values in crops for s, v in enumerate(values)] + [(999, 0, "crave"), (1000, 0, "no phrase")], "crop long, seq int, value string")
    got: dict = {}
    for r in assignment.span_assignments(phrases, candidates, "crop").collect():
        got.setdefault(r["crop"], []).append((r["seq"], r["start"], r["segment"], round(r["score"], 9)))
    want = {k: sorted((a, b, c, round(d, 9)) for a, b, c, d in exhaustive_spans(p, v)) for k, p, v in crops}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert sum(map(len, want.values())) > 200


def exhaustive_partition(phrase, observed, first_word_only):
    words = [m.span() for m in re.finditer(WORD, phrase)]
    n, rows = len(words), len(observed)
    ends = [a for a, _ in words] + [len(phrase)]

    def score(value, segment):
        a, b = look(value), look(segment)
        ratio = min(len(a), len(b)) / max(len(a), len(b), 1)
        close = SequenceMatcher(None, a, b).ratio()
        return None if ratio < 0.45 or close < 0.35 else 0.82 * close + 0.18 * ratio

    best = {}
    for cuts in itertools.combinations(range(n + 1), rows + 1) if n >= 2 else ():
        if first_word_only and cuts[0] or any(j - i > 8 for i, j in zip(cuts, cuts[1:])):
            continue
        parts = [phrase[ends[i] : ends[j]].strip() for i, j in zip(cuts, cuts[1:])]
        scores = [score(v, p) for v, p in zip(observed, parts)]
        if None in scores:
            continue
        if sum(scores) > best.get((cuts[0], cuts[-1]), (-1,))[0] + 1e-12:
            best[cuts[0], cuts[-1]] = (sum(scores), scores, parts)
    found = None
    for _, (total, scores, parts) in sorted(best.items()):
        overall = SequenceMatcher(None, "".join(map(look, observed)), "".join(map(look, parts))).ratio()
        quality = 0.65 * total / rows + 0.35 * overall
        if min(scores) >= 0.48 and overall >= 0.55 and quality >= 0.61 and (found is None or quality > found[0] + 1e-12):
            found = (quality, scores, parts)
    return found and [(p, round(min(found[0], s), 9)) for p, s in zip(found[2], found[1])]


def test_partition_equals_exhaustive_search():
    rng = random.Random(5)
    pool = ["crave", "more", "chart", "total", "of", "now", "grid", "plans", "ever"]
    hits = 0
    for _ in range(250):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 9))]
        phrase = " ".join(w + rng.choice(["", ",", "!"]) for w in words)
        rows = rng.randint(2, 4)
        cuts = sorted(rng.sample(range(len(words) + 1), min(rows + 1, len(words) + 1)))
        observed = [noisy(rng, " ".join(words[i:j])) for i, j in zip(cuts, cuts[1:])]
        if len(observed) < 2:
            continue
        only = rng.random() < 0.3
        got = assignment.partition(phrase, observed, only)
        want = exhaustive_partition(phrase, observed, only)
        assert (got and [(p, round(s, 9)) for p, s in got]) == want, (phrase, observed)
        hits += want is not None
    assert hits > 60


def test_paragraphs_and_rows(spark):
    rows = [
        (1, 0, "CFAIE MOFE", 20, 10, 200, 30), (1, 1, "every singlo day", 22, 40, 210, 60), (1, 2, "far off", 300, 45, 380, 65), (1, 3, "no", 20, 70, 60, 90), (1, 4, None, 20, 70, 60, 90),
        (2, 0, "first line here", 0, 0, 90, 20), (2, 1, "second line here", 0, 200, 90, 220), (3, 0, "no box", None, 0, 9, 9), (4, 5, "a row b", 0, 0, 50, 10), (4, 6, "c row d", 0, 12, 50, 22),
    ]
    df = spark.createDataFrame(rows, "crop long, seq int, value string, x0 int, y0 int, x1 int, y1 int")
    assert sorted((r["crop"], r["seq"], r["place"]) for r in assignment.paragraphs(df, "crop").collect()) == [(1, 0, 1), (1, 1, 2), (4, 5, 1), (4, 6, 2)]
    phrases = spark.createDataFrame([(1, "Crave more every single day!", 0), (2, "x", 0), (4, None, 0)], "crop long, phrase string, top int")
    got = sorted((r["crop"], r["seq"], r["segment"]) for r in assignment.row_assignments(phrases, df, "crop").collect())
    assert got == [(1, 0, "Crave more"), (1, 1, "every single day!")]
    assert assignment.row_assignments(phrases, df.limit(0), "crop").count() == 0
