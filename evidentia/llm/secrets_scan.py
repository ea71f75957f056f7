"""Secrets in texts: plain spans, and credentials whose parts lie apart.

Some spans stand by themselves: assigned secrets, access identifiers, long runs
of hex digits. Others are too weak for that: a login, a random looking word, a
short password, an endpoint. They are reported only where complementary parts
meet. A scope is a paragraph, or a block in braces within it; parts are joined
to the scopes that hold their interval, and a part counts as linked if a part of
a complementary role lies in the innermost scope of either and within REACH
characters. Scopes and parts are both sorted, so one sweep over a text finds the
nearest complement of every part, however many parts there are, and no pairs are
listed. A text is scanned whole, in its own row, without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

#: Fixed patterns of the spans that stand by themselves, and the characters that group 2 or the match must have.
BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 16),
}
#: Weak candidates.
LOGIN = re.compile(r"(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]{3,})", re.ASCII | re.IGNORECASE)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:@%\[\]-]+|(?<![A-Za-z0-9])(?:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z0-9.:-]+", re.ASCII)
#: A short assigned secret has at least so many characters.
SHORT = 4
#: Bits a character of a random looking word, which mixes letters of both cases and digits.
ENTROPY = 3.5
REACH = 400
KINDS = ("assign", "access", "hex", "short", "login", "random", "endpoint")
IDENTIFIER, SECRET, PLACE = range(3)
ROLE = {"assign": SECRET, "hex": SECRET, "short": SECRET, "random": SECRET, "access": IDENTIFIER, "login": IDENTIFIER, "endpoint": PLACE}
#: A secret goes with an identifier or an endpoint, either of those with a secret.
COMPLEMENTS = {SECRET: (IDENTIFIER, PLACE), IDENTIFIER: (SECRET,), PLACE: (SECRET,)}
RESULT = "array<struct<kind: string, start: int, end: int, partner: int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("partner", pa.int32())]))
_MARK = re.compile(r"[{}]|\n[\x20\t\r]*(?=\n)")
Span = tuple[int, int, str]


def entropy(word: str) -> float:
    """Bits a character of the distribution of word's own characters."""
    return -sum(n / len(word) * math.log2(n / len(word)) for n in (word.count(c) for c in set(word)))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(start, end, kind) of the spans that stand by themselves, by start and then kind as listed; and assigned secrets that are too short for it."""
    found, short = [], []
    pattern, least = BASE["assign"]
    for m in pattern.finditer(text):
        size = m.end(2) - m.start(2)
        if size >= least:
            found.append((*m.span(), "assign"))
        elif size >= SHORT:
            short.append((*m.span(), "short"))
    for kind in ("access", "hex"):
        pattern, least = BASE[kind]
        found += [(*m.span(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return sorted(found, key=_order), short


def _order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def _weak_spans(text: str, base: list[Span], short: list[Span]) -> list[Span]:
    """Weak candidates, but for those that overlap a base span or a candidate of a kind listed earlier; none in a text without any secret, where nothing can be linked."""
    random = [(*m.span(), "random") for m in RANDOM.finditer(text) if _mixed(m.group()) and entropy(m.group()) >= ENTROPY]
    if not (short or random or any(ROLE[kind] == SECRET for _, _, kind in base)):
        return []
    out: list[Span] = []
    for found in (short, [(*m.span(), "login") for m in LOGIN.finditer(text)], random, [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]):
        out += _apart(found, [*base, *out])
    return out


def _apart(found: list[Span], held: list[Span]) -> list[Span]:
    """Those found that overlap none of held."""
    held = sorted(held)
    starts, ends = [s for s, _, _ in held], list(accumulate((e for _, e, _ in held), max))
    before = [(s, bisect_left(starts, s[1])) for s in found]
    return [s for s, k in before if not k or ends[k - 1] <= s[0]]


def _mixed(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


def scopes(text: str) -> list[tuple[int, int]]:
    """Paragraphs, and blocks in braces that open and close in one paragraph, as (start, end), by start and outer ones first; blank lines part paragraphs."""
    out, begin, opened = [], 0, []
    for m in _MARK.finditer(text):
        if m.group() == "{":
            opened.append(m.start())
        elif m.group() == "}":
            if opened:
                out.append((opened.pop(), m.end()))
        else:
            out.append((begin, m.start()))
            begin, opened = m.end(), []
    out.append((begin, len(text)))
    return sorted(out, key=lambda s: (s[0], -s[1]))


def innermost(found: list[tuple[int, int]], parts: list[Span]) -> list[int]:
    """For each part, in order of start, the innermost scope that holds its interval (no part crosses a line, so its paragraph does); both lists are swept once."""
    out, opened, k = [], [], 0
    for a, b, _ in parts:
        while k < len(found) and found[k][0] <= a:
            while opened and found[opened[-1]][1] <= found[k][0]:
                opened.pop()
            opened.append(k)
            k += 1
        while found[opened[-1]][1] <= a:
            opened.pop()
        holding = len(opened) - 1
        while found[opened[holding]][1] < b:
            holding -= 1
        out.append(opened[holding])
    return out


def link(text: str, parts: list[Span], reach: int = REACH) -> list[int | None]:
    """For each part, in order of start, the nearest one of a complementary role that it doesn't overlap, within reach, and that the innermost scope of either holds; None where there is none.

    Distance is the number of characters between the two; of equally near ones
    that which starts first counts, then the kind listed first.
    """
    found = scopes(text)
    at = innermost(found, parts)
    by_start = [[k for k, p in enumerate(parts) if ROLE[p[2]] == role] for role in range(3)]
    by_end = [sorted(ks, key=lambda k: parts[k][1]) for ks in by_start]
    starts, ends = [[parts[k][0] for k in ks] for ks in by_start], [[parts[k][1] for k in ks] for ks in by_end]

    def meets(k: int, j: int) -> bool:
        outer = [found[at[x]] for x in (k, j)]
        return outer[0][0] <= parts[j][0] and parts[j][1] <= outer[0][1] or outer[1][0] <= parts[k][0] and parts[k][1] <= outer[1][1]

    def nearest(k: int) -> int | None:
        best: tuple[int, int] | None = None
        start, end, kind = parts[k]
        for role in COMPLEMENTS[ROLE[kind]]:
            before = (by_end[role][x] for x in range(bisect_right(ends[role], start) - 1, -1, -1))
            after = (by_start[role][x] for x in range(bisect_left(starts[role], end), len(by_start[role])))
            for side, far_of in ((before, lambda j: start - parts[j][1]), (after, lambda j: parts[j][0] - end)):
                for j in side:
                    far = far_of(j)
                    if far > reach or best is not None and far > best[0]:
                        break
                    if (best is None or (far, j) < best) and meets(k, j):
                        best = (far, j)
        return None if best is None else best[1]

    return [nearest(k) for k in range(len(parts))]


def spans(text: str | None) -> list[tuple[str, int, int, int | None]]:
    """kind, start, end and the start of the complement, if any, of all spans to report: base ones, and weak ones that are linked; in code points, end exclusive."""
    if not text:
        return []
    base, short = base_spans(text)
    parts = sorted([*base, *_weak_spans(text, base, short)], key=_order)
    if not parts:
        return []
    partners = link(text, parts)
    return [(kind, a, b, None if p is None else parts[p][0]) for (a, b, kind), p in zip(parts, partners, strict=True) if p is not None or kind in BASE]


def scan(df: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, name: str = "secrets") -> DataFrame:
    """Append the spans of each whole text: kind, start, end (code points, end exclusive), partner (start of the nearest complementary part, or null).

    Null and empty texts have none; repeated rows are scanned one by one; an
    empty table gives no rows; a column that is called name is replaced, all
    other columns stay as they are.
    """

    def make() -> Callable[[list], pa.Array]:
        return lambda texts: pa.array([[{"kind": k, "start": a, "end": b, "partner": p} for k, a, b, p in spans(t)] for t in texts], _TYPE)

    return _shared.annotate(df, text_col, make, RESULT, carry=carry, name=name)


def op12_secret_parts(spark, sf_dir: str) -> DataFrame:
    """The spans of every document: how many of each base kind, the SHA-256 of the base spans, and all spans."""
    scanned = scan(_shared.table(spark, sf_dir, "documents"), carry=["doc_id"])

    def joined(of) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kinds(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    base = of_kinds(*BASE)
    counts = [F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return scanned.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("secrets").alias("spans"), F.size(F.filter("secrets", lambda s: s["partner"].isNotNull())).cast("long").alias("n_linked"))
