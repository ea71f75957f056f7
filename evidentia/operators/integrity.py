"""Whether a page that looks right is a real page: live text, usable controls, dividers and rasters against what was measured on the reference.

References claim candidates in order, each candidate once. Only candidates that
share area with a reference are looked at (boxes meet by grid cell), so a page's
pairs are few; the claims themselves are one pass over a page's sorted pairs.
Dividers, which need not touch, are compared within a page by arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import geometry, text
from evidentia.operators import greedy, spatial
from evidentia.shipping import ship

# Least coverage of a text, of a control, of a raster by an allowed region, of a divider under a raster; least similarity of a text and of a label; largest raster share.
COVERED, PRESSED, ALLOWED, CROSSED, SAME_TEXT, SAME_LABEL, WHOLE, SPECK = 0.12, 0.2, 0.72, 0.5, 0.72, 0.65, 0.45, 0.0005
RASTERS = ("img", "image", "canvas", "video", "picture", "background-image")
# The reasons against a page, in the order in which they are told.
REASONS = (
    "missing-live-text", "unselectable-live-text", "live-text-content-mismatch", "missing-live-symbol-art", "unselectable-live-symbol-art", "non-preformatted-symbol-art", "missing-semantic-control",
    "semantic-control-label-mismatch", "raster-overlaps-text", "raster-overlaps-symbol-art", "raster-layout-structure", "raster-outside-allowed-region", "full-reference-raster", "untrusted-background-raster",
)


def _error(a: Column, b: Column) -> Column:
    d = geometry.delta(a, b)
    return sum((F.abs(d[k]) for k in ("x", "y", "width", "height")), F.lit(0)).cast("long")


def _claims(pairs: DataFrame, references: DataFrame, group: str, choose) -> DataFrame:
    """One row for each reference: group, seq, outcome, candidate. choose gives, of a reference's free candidates (candidate, score, coverage, ok), the one to take or name, and whether it is taken."""
    rows = references.select(group, "seq").join(pairs.select(group, F.col("a_seq").alias("seq"), F.col("b_seq").alias("candidate"), "score", "coverage", "ok"), [group, "seq"], "left")

    def step(pdf: greedy.Rows) -> list[tuple]:
        out, used, own, last = [], set(), [], None
        rows = list(zip(pdf["seq"].tolist(), pdf["candidate"].tolist(), pdf["score"].tolist(), pdf["coverage"].tolist(), pdf["ok"].tolist(), strict=True))
        for k, (seq, candidate, score, coverage, ok) in enumerate(rows):
            if candidate is not None and candidate == candidate and int(candidate) not in used:
                own.append((int(candidate), score, coverage, bool(ok)))
            if k + 1 == len(rows) or rows[k + 1][0] != seq:
                if seq != last:
                    best, taken = choose(own) if own else (None, False)
                    out.append((int(seq), "missing" if best is None else "matched" if taken else "mismatch", best))
                    if taken:
                        used.add(best)
                last, own = seq, []
        return out

    return greedy.each_group(rows, group, ["seq", "candidate"], ["score", "coverage", "ok"], ["seq", "outcome", "candidate"], "seq long, outcome string, candidate long", step)


def _most(own: list[tuple], by: int) -> tuple:
    """The first of those with the greatest value in that place."""
    return max(own, key=lambda c: c[by])


def text_matches(references: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """What each reference text (group, seq, box, value, font_size) finds among live nodes (group, seq, box, text, selectable, font_size): group, seq, outcome, candidate, coverage, similarity, selectable, error, font_delta.

    In order of seq, a reference takes the free node of at least COVERED of its
    box with the best score, 0.7 of the similarity of letters and digits and 0.3
    of the lesser coverage; below SAME_TEXT it is a mismatch and the node stays
    free. A reference without letters or digits takes whatever scores best.
    """
    ship(references.sparkSession)
    said, shown = references.withColumn("look", text.letters_and_digits(F.col("value"))), nodes.withColumn("look", text.letters_and_digits(F.col("text")))
    a, b = F.col("a_box"), F.col("b_box")
    pairs = spatial.overlapping(said.select(group, "seq", *geometry.SIDES, "look", "font_size"), shown.select(group, "seq", *geometry.SIDES, "look", "selectable", "font_size"), group)
    pairs = pairs.withColumn("coverage", geometry.coverage(a, b)).where(F.col("coverage") >= COVERED)
    alike = F.when((F.col("a_look") != "") & (F.col("b_look") != ""), greedy.similarity(F.col("a_look"), F.col("b_look"))).otherwise(0.0)
    pairs = pairs.withColumn("similarity", alike).withColumn("score", 0.7 * F.col("similarity") + 0.3 * F.least("coverage", geometry.coverage(b, a))).withColumn("ok", (F.col("a_look") == "") | (F.col("similarity") >= SAME_TEXT))

    def choose(own):
        best = _most(own, 1)
        return best[0], best[3]

    found = _claims(pairs, references, group, choose)
    facts = pairs.select(group, F.col("a_seq").cast("long").alias("seq"), F.col("b_seq").cast("long").alias("candidate"), "coverage", "similarity", F.col("b_selectable").alias("selectable"), _error(a, b).alias("error"), F.round(F.col("b_font_size") - F.col("a_font_size"), 1).alias("font_delta"))
    return found.join(facts, [group, "seq", "candidate"], "left").select(group, "seq", "outcome", "candidate", "coverage", "similarity", "selectable", "error", "font_delta")


def control_matches(references: DataFrame, controls: DataFrame, group: str) -> DataFrame:
    """What each reference control (group, seq, box, label) finds among usable controls (group, seq, box, name): group, seq, outcome, candidate, coverage, similarity, error.

    A control of at least PRESSED of the box whose name is like the label, or any
    where there is no label, may be taken: the best of 0.8 of the coverage and 0.2
    of the similarity. Where only others are free, the one that covers most is
    named as a mismatch.
    """
    ship(references.sparkSession)
    said, shown = references.withColumn("look", text.letters_and_digits(F.col("label"))), controls.withColumn("look", text.letters_and_digits(F.col("name")))
    a, b = F.col("a_box"), F.col("b_box")
    pairs = spatial.overlapping(said.select(group, "seq", *geometry.SIDES, "look"), shown.select(group, "seq", *geometry.SIDES, "look"), group)
    pairs = pairs.withColumn("coverage", geometry.coverage(a, b)).where(F.col("coverage") >= PRESSED)
    alike = F.when(F.col("a_look") == "", 1.0).when(F.col("b_look") == "", 0.0).otherwise(greedy.similarity(F.col("a_look"), F.col("b_look")))
    pairs = pairs.withColumn("similarity", alike).withColumn("score", 0.8 * F.col("coverage") + 0.2 * F.col("similarity")).withColumn("ok", (F.col("a_look") == "") | (F.col("similarity") >= SAME_LABEL))

    def choose(own):
        good = [c for c in own if c[3]]
        return (_most(good, 1)[0], True) if good else (_most(own, 2)[0], False)

    found = _claims(pairs, references, group, choose)
    facts = pairs.select(group, F.col("a_seq").cast("long").alias("seq"), F.col("b_seq").cast("long").alias("candidate"), "coverage", "similarity", _error(a, b).alias("error"))
    return found.join(facts, [group, "seq", "candidate"], "left").select(group, "seq", "outcome", "candidate", "coverage", "similarity", "error")


def art_matches(references: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """Drawings of characters (group, seq, box, text) as live text of exactly their lines (group, seq, box, text, selectable, white_space): group, seq, candidate (null where none), selectable, preformatted; the most covering, the first on ties."""
    drawn, shown = references.withColumn("lines", text.symbol_text(F.col("text"))), nodes.withColumn("lines", text.symbol_text(F.col("text")))
    pairs = spatial.overlapping(drawn.select(group, "seq", *geometry.SIDES, "lines"), shown.select(group, "seq", *geometry.SIDES, "lines", "selectable", "white_space"), group)
    pairs = pairs.withColumn("coverage", geometry.coverage(F.col("a_box"), F.col("b_box"))).where((F.col("coverage") >= COVERED) & (F.col("a_lines") == F.col("b_lines")))
    best = F.max(F.struct("coverage", (-F.col("b_seq")).alias("minus"), F.col("b_selectable").alias("selectable"), F.lower(F.coalesce("b_white_space", F.lit("normal"))).alias("space")))
    found = pairs.groupBy(group, F.col("a_seq").alias("seq")).agg(best.alias("m"))
    return references.select(group, "seq").join(found, [group, "seq"], "left").select(group, "seq", (-F.col("m.minus")).alias("candidate"), F.col("m.selectable").alias("selectable"), F.col("m.space").isin("pre", "pre-wrap", "break-spaces").alias("preformatted"))


def line_matches(references: DataFrame, lines: DataFrame, group: str) -> DataFrame:
    """What each reference divider (group, seq, box, orientation, thickness) finds among a page's dividers (group, seq, box, orientation): group, seq, outcome, candidate.

    In order, the free divider of the same orientation with the least distance
    (across, a quarter of the difference in length, a tenth of that in start) is
    taken if it lies within 12 pixels or four times the thickness and is half as
    long; else the reference is displaced, or missing where none is free.
    """
    sides = [df.select(group, "seq", *geometry.SIDES, (F.col("orientation") == "horizontal").alias("level"), thick.cast("double").alias("thickness"), F.lit(k).alias("side")) for k, df, thick in ((0, references, F.coalesce(F.col("thickness"), F.lit(1))), (1, lines, F.lit(1)))]

    def step(pdf: greedy.Rows) -> list[tuple]:
        refs = len(pdf) - int(pdf["side"].sum())  # references come first
        flat, boxes, keys, thick = pdf["level"].astype(bool), pdf.floats([*geometry.SIDES]), pdf["seq"].tolist(), pdf["thickness"].tolist()
        x0, y0, x1, y1 = boxes.T
        start, far, across_at = (np.where(flat, a, b) for a, b in ((x0, y0), (x1, y1), (y0, x0)))
        long = far - start
        (s, n, c), (p, m, d) = ([v[part] for v in (start, long, across_at)] for part in (slice(refs), slice(refs, None)))
        level = [flat[:refs], flat[refs:]]
        out, used = [], np.zeros(len(p), bool)
        for k, seq in enumerate(keys[:refs]):
            across = np.abs(d - c[k])
            score = np.where((level[1] == level[0][k]) & ~used, across + 0.25 * np.abs(m - n[k]) + 0.1 * np.abs(p - s[k]), np.inf)
            j = int(score.argmin()) if len(score) else -1
            if j < 0 or not np.isfinite(score[j]):
                out.append((int(seq), "missing", None))
                continue
            fits = across[j] <= max(12.0, (thick[k] or 1) * 4) and m[j] >= max(8.0, n[k] * 0.5)
            used[j] |= fits
            out.append((int(seq), "matched" if fits else "displaced", int(keys[refs + j])))
        return out

    both = sides[0].unionByName(sides[1]).where("level IS NOT NULL")
    return greedy.each_group(both, group, ["side"], [*geometry.SIDES, "level", "thickness"], ["seq", "outcome", "candidate"], "seq long, outcome string, candidate long", step)


def _met(rasters: DataFrame, others: DataFrame, group: str, share: Column, least: float, name: str) -> DataFrame:
    found = spatial.overlapping(rasters.select(group, "seq", *geometry.SIDES), others.select(group, "seq", *geometry.SIDES), group).where(share >= least)
    return found.select(group, F.col("a_seq").alias("seq"), F.lit(True).alias(name)).distinct()


def raster_audit(rasters: DataFrame, allowed: DataFrame, texts: DataFrame, drawings: DataFrame, dividers: DataFrame, width: int, height: int, group: str) -> DataFrame:
    """What each visible raster (group, seq, box, kind, src, role, trusted) covers: group, seq, allowed, region (seq of the allowed one that counts), overlaps_text, overlaps_art, overlaps_lines, share (of the canvas), whole, outside, untrusted.

    allowed regions (group, seq, box, kind): of those that cover ALLOWED of the
    raster, one of the raster's role counts before others, then the first. A
    trusted background may lie under anything; one that claims to be a
    background without being trusted is untrusted. Backgrounds without a file,
    and kinds that aren't rasters, don't count.
    """
    source = F.lower(F.coalesce("src", F.lit("url(")))
    real = rasters.where(F.col("kind").isin(*RASTERS) & ~((F.col("kind") == "background-image") & ~F.contains(source, F.lit("url(")) & ~F.contains(source, F.lit("image-set("))))
    a, b = F.col("a_box"), F.col("b_box")
    regions = spatial.overlapping(real.select(group, "seq", *geometry.SIDES, "role"), allowed.select(group, "seq", *geometry.SIDES, "kind"), group).where(geometry.coverage(a, b) >= ALLOWED)
    own = F.coalesce(F.col("a_role") == F.col("b_kind"), F.lit(False))
    regions = regions.groupBy(group, F.col("a_seq").alias("seq")).agg(F.min(F.struct((~own).alias("other"), F.col("b_seq").alias("region"), F.col("b_kind").alias("region_kind"))).alias("r")).select(group, "seq", "r.region", "r.region_kind")
    out = real.join(regions, [group, "seq"], "left")
    for name, others, least in (("t", texts, COVERED), ("s", drawings, COVERED), ("l", dividers, CROSSED)):
        out = out.join(_met(real, others, group, geometry.coverage(b, a), least, name), [group, "seq"], "left")
    trusted = F.coalesce("trusted", F.lit(False))
    over = {f"overlaps_{name}": F.coalesce(F.col(k), F.lit(False)) & ~trusted for name, k in (("text", "t"), ("art", "s"), ("lines", "l"))}
    claims = F.coalesce((F.col("region_kind") == F.col("role")) & F.col("role").isin("alpha-masked-background-artwork", "browser-source-background-artwork"), F.lit(False))
    share = geometry.area(geometry.box(*geometry.SIDES)) / max(1.0, float(width * height))
    out = out.withColumns(over).withColumn("share", share).withColumn("inside", F.col("region").isNotNull())
    clear = F.col("inside") & ~F.col("overlaps_text") & ~F.col("overlaps_art") & ~F.col("overlaps_lines")
    return out.select(group, "seq", clear.alias("allowed"), "region", *over, F.round("share", 5).alias("share"), ((F.col("share") >= WHOLE) & ~trusted).alias("whole"), (~F.col("inside") & (F.col("share") >= SPECK)).alias("outside"), (claims & ~trusted).alias("untrusted"))


def trusted_background(raster: Column, region: Column, asset: Column) -> Column:
    """Whether a raster is a background that can be trusted, of either kind: masked by alpha after its content was removed, or the very file that a browser received.

    raster: role, artifact. region: kind, artifact, alpha, removed, version,
    discovered, only, live_text, decoration, whole, kept (whether interface
    pixels are preserved in it), source, method, media, sha256. asset: sha256,
    media, source, method; null where no file was received.
    """
    same = (raster["role"] == region["kind"]) & (raster["artifact"] == region["artifact"]) & region["removed"] & region["only"] & ~F.coalesce(region["kept"], F.lit(False))
    masked = (region["kind"] == "alpha-masked-background-artwork") & region["alpha"] & (region["version"] >= 3) & region["discovered"]
    digest = F.lower(region["sha256"])
    received = (
        (region["kind"] == "browser-source-background-artwork") & (region["version"] >= 4) & (region["source"] == "observed") & (region["method"] == "verified-playwright-response-body")
        & (region["live_text"] == "separate-observed-live-dom") & (region["decoration"] == "separate-semantic-css") & ~region["whole"] & digest.rlike("^[0-9a-f]{64}$")
        & (raster["artifact"] == F.concat(F.lit("raster:"), F.substring(digest, 1, 16))) & (F.lower(asset["sha256"]) == digest) & (F.lower(asset["media"]) == F.lower(region["media"])) & (asset["source"] == "observed") & (asset["method"] == "playwright-response-body")
    )
    return F.coalesce(same & F.coalesce(masked, F.lit(False)), F.lit(False)) | F.coalesce(same & F.coalesce(received, F.lit(False)), F.lit(False))


def verdicts(pages: DataFrame, group: str, texts: DataFrame, drawings: DataFrame, controls: DataFrame, rasters: DataFrame) -> DataFrame:
    """For each page (group) whether it passes, and the reasons against it, in order: group, web_pass, reasons (structs code, seqs). From the results of the matches and of the audit."""
    no = F.lit(False)
    against = {
        "missing-live-text": (texts, F.col("outcome") == "missing"), "unselectable-live-text": (texts, (F.col("outcome") == "matched") & ~F.coalesce("selectable", F.lit(True))), "live-text-content-mismatch": (texts, F.col("outcome") == "mismatch"),
        "missing-live-symbol-art": (drawings, F.col("candidate").isNull()), "unselectable-live-symbol-art": (drawings, F.col("candidate").isNotNull() & ~F.coalesce("selectable", F.lit(True))), "non-preformatted-symbol-art": (drawings, F.col("candidate").isNotNull() & ~F.coalesce("preformatted", no)),
        "missing-semantic-control": (controls, F.col("outcome") == "missing"), "semantic-control-label-mismatch": (controls, F.col("outcome") == "mismatch"), "raster-overlaps-text": (rasters, F.col("overlaps_text")), "raster-overlaps-symbol-art": (rasters, F.col("overlaps_art")),
        "raster-layout-structure": (rasters, F.col("overlaps_lines")), "raster-outside-allowed-region": (rasters, F.col("outside")), "full-reference-raster": (rasters, F.col("whole")), "untrusted-background-raster": (rasters, F.col("untrusted")),
    }
    frames: dict[int, tuple[DataFrame, list]] = {}
    for rank, code in enumerate(REASONS):
        df, holds = against[code]
        frames.setdefault(id(df), (df, []))[1].append(F.when(holds, F.lit(rank)))
    told = [df.select(group, "seq", F.explode(F.array_compact(F.array(*tests))).alias("rank")) for df, tests in frames.values()]
    each = reduce(DataFrame.unionByName, [t.select(group, F.col("seq").cast("long").alias("seq"), "rank") for t in told]).groupBy(group, "rank").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    code = F.element_at(F.array(*(F.lit(r) for r in REASONS)), F.col("rank") + 1)
    reasons = each.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", code.alias("code"), "seqs"))).alias("r"))
    out = pages.select(group).join(reasons, group, "left").withColumn("reasons", F.transform(F.coalesce("r", F.expr("array()").cast("array<struct<rank: int, code: string, seqs: array<bigint>>>")), lambda x: F.struct(x["code"].alias("code"), x["seqs"].alias("seqs"))))
    return out.select(group, (F.size("reasons") == 0).alias("web_pass"), "reasons")


#: What a box of a reference, or of a page, is: bits of its roles.
TEXT, CONTROL, ART, ALLOWED_REGION, DIVIDER, READ, RASTER = (1 << k for k in range(7))
#: Pairs of boxes that are held at once.
_PAIRS = 1 << 20


class _Boxes:
    """The boxes of some pages, by page, side and seq, as arrays."""

    def __init__(self, lists: pa.ListArray):
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        own = np.repeat(np.arange(len(n)), n)
        seq, shown = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("seq", "shown"))
        order = np.lexsort((seq, shown, own))
        self.own, self.seq, self.shown = own[order], seq[order], shown[order].astype(bool)
        self.roles = flat.field("roles").to_numpy(zero_copy_only=False)[order]
        self.sides = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float)[order] for k in geometry.SIDES], axis=1)
        self.area = (self.sides[:, 2] - self.sides[:, 0]) * (self.sides[:, 3] - self.sides[:, 1])
        at = pa.array(order)
        self.text, self.names = {}, {}
        given = {lists.type.value_type.field(k).name for k in range(lists.type.value_type.num_fields)}
        for k in ("look", "lines", "kind", "role"):
            if k not in given:
                continue
            coded = flat.field(k).dictionary_encode()
            self.names[k] = coded.dictionary.to_pylist()
            self.text[k] = pc.fill_null(coded.indices.take(at), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flags = {k: pc.fill_null(flat.field(k).take(at), unknown).to_numpy(zero_copy_only=False) for k, unknown in (("selectable", True), ("preformatted", False), ("trusted", False)) if k in given}
        self.measures = {k: flat.field(k).take(at).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("font_size", "thickness", "level") if k in given}

    def of(self, role: int, shown: bool) -> np.ndarray:
        return np.flatnonzero((self.roles & role != 0) & (self.shown == shown))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each pair of a box of a and one of b of the same page, in order, a bounded number at a time (all of one box of a at least)."""
        low, high = (np.searchsorted(self.own[b], self.own[a], side) for side in ("left", "right"))
        n = high - low
        total, k = np.cumsum(n), 0
        while k < len(a):
            end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _PAIRS, "right")))
            i = np.repeat(np.arange(k, end), n[k:end])
            yield a[i], b[np.arange(len(i)) - np.repeat(np.cumsum(n[k:end]) - n[k:end], n[k:end]) + low[i]]
            k = end

    def met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each pair of a box of a and one of b of the same page that share area, and the share of each that the other covers."""
        out = [np.zeros((3, 0))]
        for i, j in self.pairs(a, b):
            p, q = self.sides[i], self.sides[j]
            across, down = (np.minimum(p[:, m + 2], q[:, m + 2]) - np.maximum(p[:, m], q[:, m]) for m in (0, 1))
            some = np.flatnonzero((across > 0) & (down > 0))
            out.append(np.stack([i[some], j[some], (across * down)[some]]))
        found = np.concatenate(out, axis=1)
        i, j = found[:2].astype(np.int64)
        return i, j, found[2] / np.maximum(1.0, self.area[i]), found[2] / np.maximum(1.0, self.area[j])

    def is_(self, name: str, value: str) -> np.ndarray:
        return self.text[name] == (self.names[name].index(value) if value in self.names[name] else -2)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The similarity of the looks of pairs, each distinct pair compared once."""
        names = self.names["look"]
        codes, at = np.unique(self.text["look"][i] * len(names) + self.text["look"][j], return_inverse=True)
        return greedy.closenesses([(names[c // len(names)], names[c % len(names)]) for c in codes.tolist()])[at]


def _settled(refs: np.ndarray, i: np.ndarray, j: np.ndarray, good: np.ndarray, score: np.ndarray, else_by: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The rules of _claims() over the pairs (i, j) of all pages, in order: for each reference the box that is named (-1: none), and whether it is taken. else_by: good candidates come first, and what names another; None: the best score alone counts."""
    named, taken, used = np.full(len(refs), -1), np.zeros(len(refs), bool), set()
    place = np.searchsorted(refs, i)
    starts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
    rows = list(zip(j.tolist(), good.tolist(), score.tolist(), (score if else_by is None else else_by).tolist(), strict=True))
    for s, e, at in zip(starts, [*starts[1:], len(rows)], place[starts].tolist(), strict=True):
        free = [r for r in rows[s:e] if r[0] not in used]
        fit = [r for r in free if r[1]] if else_by is not None else []
        if free:
            best = _most(fit, 2) if fit else _most(free, 3)
            named[at], taken[at] = best[0], best[1]
            if best[1]:
                used.add(best[0])
    return named, taken


def _texts(b: _Boxes, known: np.ndarray | bool = True) -> tuple[np.ndarray, ...]:
    """text_matches() over the pages of b whose boxes are known: references, the box that each names (-1: none), whether it is taken, and the similarity to it."""
    empty, refs = b.is_("look", ""), b.of(TEXT, False)
    i, j, c, d = b.met(refs, b.of(TEXT, True))
    i, j, c, d = (x[(c >= COVERED) & (known if known is True else known[i])] for x in (i, j, c, d))
    close = np.where(empty[i] | empty[j], 0.0, b.alike(i, j)) if len(i) else np.zeros(0)
    named, taken = _settled(refs, i, j, empty[i] | (close >= SAME_TEXT), 0.7 * close + 0.3 * np.minimum(c, d), None)
    return refs, named, taken, _of_named(refs, named, i, j, close)


def _controls(b: _Boxes, known: np.ndarray | bool = True) -> tuple[np.ndarray, ...]:
    """control_matches() in the same way."""
    empty, refs = b.is_("look", ""), b.of(CONTROL, False)
    i, j, c, _ = b.met(refs, b.of(CONTROL, True))
    i, j, c = (x[(c >= PRESSED) & (known if known is True else known[i])] for x in (i, j, c))
    close = np.where(empty[i], 1.0, np.where(empty[j], 0.0, b.alike(i, j))) if len(i) else np.zeros(0)
    named, taken = _settled(refs, i, j, empty[i] | (close >= SAME_LABEL), 0.8 * c + 0.2 * close, c)
    return refs, named, taken, _of_named(refs, named, i, j, close)


def _of_named(refs: np.ndarray, named: np.ndarray, i: np.ndarray, j: np.ndarray, close: np.ndarray) -> np.ndarray:
    """The similarity of each reference and the box that it names, from that of all pairs (i, j), which are in order; 0 where it names none."""
    out, some, n = np.zeros(len(refs)), np.flatnonzero(named >= 0), int(j.max(initial=0)) + 1
    out[some] = close[np.searchsorted(i * n + j, refs[some] * n + named[some])]
    return out


def _dividers(b: _Boxes) -> tuple[np.ndarray, ...]:
    """line_matches() over the pages of b: references, the divider that each names (-1: none), and whether it is taken."""
    level, thick = b.measures["level"], b.measures["thickness"]
    refs, lines = (x[~np.isnan(level[x])] for x in (b.of(DIVIDER, False), b.of(DIVIDER, True)))
    flat, (x0, y0, x1, y1) = level == 1, b.sides.T
    start, across_at = np.where(flat, x0, y0), np.where(flat, y0, x0)
    long = np.where(flat, x1, y1) - start
    reach = np.maximum(12.0, np.where(np.isnan(thick) | (thick == 0), 1.0, thick) * 4)
    named, taken, used = np.full(len(b.own), -1), np.zeros(len(b.own), bool), set()
    for i, j in b.pairs(refs, lines):
        across = np.abs(across_at[j] - across_at[i])
        score = across + 0.25 * np.abs(long[j] - long[i]) + 0.1 * np.abs(start[j] - start[i])
        some = (flat[i] == flat[j]) & np.isfinite(score)
        i, j, across, score = i[some], j[some], across[some], score[some]
        fits = (across <= reach[i]) & (long[j] >= np.maximum(8.0, long[i] * 0.5))
        order = np.lexsort((j, score, i))
        last = -1
        for a, c, fit in zip(i[order].tolist(), j[order].tolist(), fits[order].tolist(), strict=True):
            if a != last and c not in used:
                named[a], taken[a], last = c, fit, a
                if fit:
                    used.add(c)
    return refs, named[refs], taken[refs]


def _told(b: _Boxes, width: int, height: int) -> list[np.ndarray]:
    """For each of REASONS the boxes that are against their page."""
    out = []
    refs, named, taken, _ = _texts(b)
    out += [refs[named < 0], refs[taken & ~b.flags["selectable"][named]], refs[(named >= 0) & ~taken]]

    refs = b.of(ART, False)
    i, j, c, _ = b.met(refs, b.of(ART, True))
    same = (c >= COVERED) & (b.text["lines"][i] == b.text["lines"][j])
    i, j, c = i[same], j[same], c[same]
    order = np.lexsort((b.seq[j], -c, i))
    found, first = np.unique(i[order], return_index=True)
    by = j[order][first]
    out += [np.setdiff1d(refs, found), found[~b.flags["selectable"][by]], found[~b.flags["preformatted"][by]]]

    refs, named, taken, _ = _controls(b)
    out += [refs[named < 0], refs[(named >= 0) & ~taken]]

    real = b.of(RASTER, True)
    trusted = b.flags["trusted"]
    for role, least in ((READ, COVERED), (ART, COVERED), (DIVIDER, CROSSED)):
        i, _, _, d = b.met(real, b.of(role, False))
        i = np.unique(i[d >= least])
        out.append(i[~trusted[i]])
    i, j, c, _ = b.met(real, b.of(ALLOWED_REGION, False))
    i, j = i[c >= ALLOWED], j[c >= ALLOWED]
    kinds = {v: k for k, v in enumerate(b.names["kind"])}
    role = np.array([*(kinds.get(v, -2) for v in b.names["role"]), -2], np.int64)[b.text["role"]]  # as a kind's number
    order = np.lexsort((b.seq[j], role[i] != b.text["kind"][j], i))
    inside, first = np.unique(i[order], return_index=True)
    region = j[order][first]
    claims = (role[inside] == b.text["kind"][region]) & (b.is_("role", "alpha-masked-background-artwork") | b.is_("role", "browser-source-background-artwork"))[inside]
    share = b.area[real] / max(1.0, float(width * height))
    out += [np.setdiff1d(real[share >= SPECK], inside), real[(share >= WHOLE) & ~trusted[real]], inside[claims & ~trusted[inside]]]
    return out


def page_review(boxes: DataFrame, group: str, width: int, height: int) -> DataFrame:
    """verdicts() of pages whose boxes of both sides are one table, in one pass, without joins: group, web_pass, reasons.

    boxes: group, seq, box, shown (false: of the reference, true: of the page),
    roles, and what these need: value (of texts and controls), drawing (of art),
    kind (of allowed regions and rasters), selectable, white_space, src, role,
    trusted. Roles are bits: TEXT, CONTROL, ART of both sides, ALLOWED_REGION,
    DIVIDER and READ (the texts that rasters may not cover) of the reference,
    RASTER of the page. The rules are those of text_matches(), control_matches(),
    art_matches() and raster_audit(). The boxes of a page are held together.
    """
    ship(boxes.sparkSession)
    source = F.lower(F.coalesce("src", F.lit("url(")))
    real = F.coalesce(F.col("kind").isin(*RASTERS) & ~((F.col("kind") == "background-image") & ~F.contains(source, F.lit("url(")) & ~F.contains(source, F.lit("image-set("))), F.lit(False))
    roles = F.when(F.col("shown") & ~real, F.col("roles").bitwiseAND(~RASTER)).otherwise(F.col("roles"))
    drawn = F.when(F.col("roles").bitwiseAND(ART) != 0, text.symbol_text(F.col("drawing")))
    preformatted = F.lower(F.coalesce("white_space", F.lit("normal"))).isin("pre", "pre-wrap", "break-spaces")
    box = F.struct(F.col("seq").cast("long").alias("seq"), "shown", roles.cast("int").alias("roles"), *geometry.SIDES, text.letters_and_digits(F.col("value")).alias("look"), drawn.alias("lines"), F.when(~F.col("shown"), F.col("kind")).alias("kind"), F.when(F.col("shown"), F.col("role")).alias("role"), "selectable", preformatted.alias("preformatted"), "trusted")
    pages = boxes.groupBy(group).agg(F.collect_list(box).alias("boxes"))

    def run(batches):
        for batch in batches:
            b = _Boxes(batch.column(1))
            told = _told(b, width, height)
            rows = np.concatenate(told)
            rank = np.repeat(np.arange(len(told)), [len(x) for x in told])
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[b.own[rows]]  # a page without a name meets nothing
            rows, rank = rows[known], rank[known]
            order = np.lexsort((b.seq[rows], rank, b.own[rows]))
            rows, rank = rows[order], rank[order]
            key = b.own[rows] * len(REASONS) + rank
            first = np.flatnonzero(np.diff(key, prepend=-1))
            seqs = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(b.seq[rows].astype(np.int64)))
            codes = pa.array(REASONS).take(pa.array(rank[first]))
            ends = np.searchsorted(key[first] // len(REASONS), np.arange(batch.num_rows + 1), "left")
            reasons = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([codes, seqs], ["code", "seqs"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends) == 0), reasons], [group, "web_pass", "reasons"])

    return pages.mapInArrow(run, f"{group} {boxes.schema[group].dataType.simpleString()}, web_pass boolean, reasons array<struct<code: string, seqs: array<bigint>>>")


def repair_hints(texts: DataFrame, controls: DataFrame, lines: DataFrame, group: str) -> DataFrame:
    """What to repair first: group, part, rank, kind, seq, candidate, priority; the eight first of texts, four of controls and of lines, by priority and then kind."""
    million = F.lit(1_000_000.0)
    wrong = F.coalesce("error", F.lit(0)) + F.abs(F.coalesce("font_delta", F.lit(0.0)))
    off = (F.col("outcome") == "matched") & ((F.col("error") >= 2) | (F.abs(F.coalesce("font_delta", F.lit(0.0))) >= 1))
    kinds = {
        "text": (texts, F.when(F.col("outcome") == "missing", "live-text-missing-or-displaced").when(F.col("outcome") == "mismatch", "live-text-content-mismatch").when(off, "text-geometry-or-typography"), F.when(F.col("outcome") == "missing", million).when(F.col("outcome") == "mismatch", million + (1 - F.col("similarity")) * 1000).otherwise(wrong), 8),
        "controls": (controls, F.when(F.col("outcome") == "missing", "semantic-control-missing-or-displaced").when(F.col("outcome") == "mismatch", "semantic-control-label-mismatch").when(F.col("error") >= 2, "semantic-control-geometry"), F.when(F.col("outcome") == "missing", million).when(F.col("outcome") == "mismatch", million + (1 - F.col("similarity")) * 1000).otherwise(F.col("error")), 4),
        "structure": (lines, F.when(F.col("outcome") == "missing", "structural-line-missing").when(F.col("outcome") == "displaced", "structural-line-missing-or-displaced"), million, 4),
    }
    found = [df.select(group, F.lit(part).alias("part"), kind.alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("candidate").cast("long").alias("candidate"), priority.cast("double").alias("priority"), F.lit(most).alias("most")).where("kind IS NOT NULL") for part, (df, kind, priority, most) in kinds.items()]
    order = Window.partitionBy(group, "part").orderBy(F.desc("priority"), "kind", "seq")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where("rank <= most").select(group, "part", "rank", "kind", "seq", "candidate", F.round("priority", 3).alias("priority"))


#: Parts of a page with the most hints of each, and the kinds of hints by name, each with its part.
PARTS = (("text", 8), ("controls", 4), ("structure", 4))
HINTS = (
    ("live-text-content-mismatch", 0), ("live-text-missing-or-displaced", 0), ("semantic-control-geometry", 1), ("semantic-control-label-mismatch", 1), ("semantic-control-missing-or-displaced", 1),
    ("structural-line-missing", 2), ("structural-line-missing-or-displaced", 2), ("text-geometry-or-typography", 0),
)
_WORST = 1_000_000.0


def _tenths(values: np.ndarray) -> np.ndarray:
    """Numbers to one decimal, halves away from zero, as Spark rounds; NaN as 0."""
    distinct, at = np.unique(np.nan_to_num(values), return_inverse=True)
    return np.array([float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in distinct.tolist()], float)[at]


def _hinted(b: _Boxes, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pages of b: the boxes that repair_hints() names, with kind (of HINTS), candidate (-1: none), priority and rank, by page and part."""
    found = []

    def hint(kind: str, rows: np.ndarray, named: np.ndarray, priority: np.ndarray | float) -> None:
        found.append((rows, np.full(len(rows), [k for k, _ in HINTS].index(kind)), named, np.broadcast_to(priority, len(rows)).astype(float)))

    for match, missing, mismatch, moved in ((_texts, 1, 0, 7), (_controls, 4, 3, 2)):
        refs, named, taken, close = match(b, known)
        p, q = b.sides[refs], b.sides[named]
        error = np.abs(np.stack([q[:, 0] - p[:, 0], q[:, 1] - p[:, 1], (q[:, 2] - q[:, 0]) - (p[:, 2] - p[:, 0]), (q[:, 3] - q[:, 1]) - (p[:, 3] - p[:, 1])])).sum(0)
        larger = np.abs(_tenths(b.measures["font_size"][named] - b.measures["font_size"][refs])) if match is _texts else np.zeros(len(refs))
        for kind, which, priority in ((missing, named < 0, np.full(len(refs), _WORST)), (mismatch, (named >= 0) & ~taken, _WORST + (1 - close) * 1000), (moved, taken & ((error >= 2) | (larger >= 1)), error + larger)):
            hint(HINTS[kind][0], refs[which], named[which], priority[which])
    refs, named, taken = _dividers(b)
    for kind, which in (("structural-line-missing", named < 0), ("structural-line-missing-or-displaced", (named >= 0) & ~taken)):
        hint(kind, refs[which], named[which], _WORST)
    rows, kind, named, priority = (np.concatenate([f[k] for f in found]) for k in range(4))
    part = np.array([p for _, p in HINTS])[kind]
    order = np.lexsort((b.seq[rows], kind, -priority, part, b.own[rows]))
    rows, kind, named, priority, part = (x[order] for x in (rows, kind, named, priority, part))
    key = b.own[rows] * len(PARTS) + part
    rank = np.arange(len(rows)) - np.searchsorted(key, key) + 1
    few = rank <= np.array([n for _, n in PARTS])[part]
    return tuple(x[few] for x in (rows, kind, named, priority, rank))


def page_hints(boxes: DataFrame, group: str) -> DataFrame:
    """repair_hints() of pages whose boxes of both sides are one table, in one pass, without joins.

    boxes: group, seq, box, shown and roles as for page_review() (TEXT, CONTROL
    and DIVIDER count, each of both sides), value, font_size, level (whether a
    divider is horizontal; null: none) and thickness. The rules are those of
    text_matches(), control_matches() and line_matches(); texts and controls of
    a page without a name meet nothing. The boxes of a page are held together.
    """
    ship(boxes.sparkSession)
    box = F.struct(F.col("seq").cast("long").alias("seq"), "shown", F.col("roles").cast("int").alias("roles"), *geometry.SIDES, text.letters_and_digits(F.col("value")).alias("look"), F.col("font_size").cast("double").alias("font_size"), F.col("level").cast("int").alias("level"), F.col("thickness").cast("double").alias("thickness"))
    pages = boxes.groupBy(group).agg(F.collect_list(box).alias("boxes"))
    kind = boxes.schema[group].dataType.simpleString()

    def run(batches):
        for batch in batches:
            b = _Boxes(batch.column(1))
            rows, kinds, named, priority, rank = _hinted(b, batch.column(0).is_valid().to_numpy(zero_copy_only=False)[b.own])
            parts = pa.array([PARTS[p][0] for _, p in HINTS]).take(pa.array(kinds))
            candidate = pa.array(b.seq[named].astype(np.int64), mask=named < 0) if len(named) else pa.array([], pa.int64())
            columns = [batch.column(0).take(pa.array(b.own[rows])), parts, pa.array(rank.astype(np.int32)), pa.array([k for k, _ in HINTS]).take(pa.array(kinds)), pa.array(b.seq[rows].astype(np.int64)), candidate, pa.array(priority)]
            yield pa.RecordBatch.from_arrays(columns, [group, "part", "rank", "kind", "seq", "candidate", "priority"])

    made = pages.mapInArrow(run, f"{group} {kind}, part string, rank int, kind string, seq long, candidate long, priority double")
    return made.withColumn("priority", F.round("priority", 3))
