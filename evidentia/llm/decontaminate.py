"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the items' windows of WINDOW consecutive words, and each item
of fewer words as a whole. All patterns of one length m share a table: the last
block of BLOCK words that a position ends on says how far the search may move,
up to m - BLOCK + 1 words; at shift 0 the block's bucket names the patterns that
end in it, told apart by their first word and confirmed by comparison.

Items are spread over blocks of about BLOCK_BYTES, each a file in the shared
folder. With one block the documents are scanned once and nothing is shuffled.
With more there is one scan for each block, whose tables each worker builds
once, so memory doesn't grow with the benchmark; a scan gives rows for documents
with hits only, and those of one document are then merged.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

WINDOW = 10
BLOCK = 2
BLOCK_BYTES = 4 << 20
#: Bytes of words: digits, a-z after folding, and everything beyond ASCII; all others part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RESULT = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<first: int, last: int>>>"
_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, with A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Searches word sequences for patterns that all have m words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m = m = len(next(iter(patterns)))
        self.block = block = min(BLOCK, m)
        self.furthest = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, list[bytes], set[str]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(block, m + 1):
                key = b" ".join(pattern[end - block : end])
                self.shift[key] = min(self.shift.get(key, self.furthest), m - end)
            self.bucket[b" ".join(pattern[m - block :])].append((pattern[0], list(pattern), items))

    def find(self, text: list[bytes]):
        """The position of the first word of each occurrence, ascending, and the items that have the pattern."""
        m, n, furthest, shift = self.m, len(text), self.furthest, self.shift.get
        at = m - 1
        if self.block == 1:
            while at < n:
                if not (move := shift(text[at], furthest)):
                    for _, _, items in self.bucket[text[at]]:
                        yield at, items
                at += move or 1
            return
        while at < n:
            key = text[at - 1] + b" " + text[at]
            move = shift(key, furthest)
            if move:
                at += move
                continue
            first = at - m + 1
            for head, pattern, items in self.bucket[key]:
                if text[first] == head and text[first : at + 1] == pattern:
                    yield first, items
            at += 1


def searchers(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One table for each pattern length among (item id, text); items without words have none."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            pattern = tuple(w[i : i + window])
            by_length[len(pattern)][pattern].add(name)
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


@lru_cache(maxsize=1)
def _load(uri: str, window: int) -> list[WuManber]:
    fs, path = _shared.open_fs(uri)
    with fs.open_input_stream(path) as f:
        return searchers(pickle.loads(f.read()), window)


def _write_blocks(items: DataFrame, id_col: str, text_col: str, path: str) -> list[str]:
    """Spread the items over files of about BLOCK_BYTES; returns their URIs."""
    rows = _shared.positional(items).select(F.coalesce(_shared.column(items, id_col).cast("string"), F.lit("")).alias("id"), _shared.column(items, text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        part, found = TaskContext.get().partitionId(), []
        for batch in batches:
            found += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if found:
            fs, where = _shared.open_fs(f"{path}/block-{part:05d}")
            temp = f"{where}.{TaskContext.get().taskAttemptId()}.tmp"
            with fs.open_output_stream(temp) as f:
                f.write(pickle.dumps(found))
            fs.move(temp, where)
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/block-{part:05d}"])], ["uri"])

    fs, where = _shared.open_fs(path)
    fs.create_dir(where, recursive=True)
    spread = rows.repartition(-(-total // BLOCK_BYTES) or 1)
    return sorted(r[0] for r in _shared.map_arrow(spread, run, "uri string").collect())


def occurrences(df: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: list[str] | None = None, name: str = "overlap") -> DataFrame:
    """Append to each row of df where the items' windows occur in its whole text.

    The column is a struct: n_words, n_hit (words inside any occurrence), items
    (ids as text, sorted, of the items that occur) and spans (first and last
    word of each run of hit words). Null and empty texts have no words; a null
    item id counts as ''; items of equal text, or rows of equal id, count alike.
    An empty table gives no rows, empty items no hit; a column that is called
    name is replaced, all others stay.
    """
    path = _shared.scratch(df.sparkSession, "benchmark")
    blocks = _write_blocks(items, item_id, item_text, path)
    if len(blocks) > 1:
        return _over_blocks(df, blocks, text_col, window, carry, name)

    def make():
        tables = _load(blocks[0], window) if blocks else []

        def of(texts):
            split = [words(t) for t in texts]
            return pa.array([_merged(len(w), at, names) for w, (at, names) in zip(split, _search(split, tables), strict=True)], _TYPE)

        return of

    return _shared.annotate(df, text_col, make, RESULT, carry=carry, name=name)


def _search(split: list[list[bytes]], tables: list[WuManber]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each sequence of words the (first, last) words of occurrences and the items that occur."""
    found: list[tuple[list, set]] = [([], set()) for _ in split]
    for table in tables:
        for w, (at, names) in zip(split, found, strict=True):
            for first, items in table.find(w):
                at.append((first, first + table.m - 1))
                names |= items
    return found


def _merged(n_words: int, at: list[tuple[int, int]], names: Iterable[str]) -> dict:
    spans: list[dict] = []
    for first, last in sorted(at):
        if spans and first <= spans[-1]["last"] + 1:
            spans[-1]["last"] = max(last, spans[-1]["last"])
        else:
            spans.append({"first": first, "last": last})
    return {"n_words": n_words, "n_hit": sum(s["last"] - s["first"] + 1 for s in spans), "items": sorted(names), "spans": spans}


def _over_blocks(df: DataFrame, blocks: list[str], text_col: str, window: int, carry: list[str] | None, name: str) -> DataFrame:
    """occurrences() by one scan for each block; the first gives every row, for its number of words."""
    names, at = _shared.carried(df, carry, name)
    flat = _shared.positional(df).select(*(F.col(f"c{k}") for k in at), _shared.column(df, text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    flat = _shared.materialize(flat, "texts")

    def scan(uri: str, all_rows: bool) -> DataFrame:
        def run(batches):
            tables = _load(uri, window)
            for batch in batches:
                for lo, n in _shared.text_slices(batch.column(1)):
                    part = batch.slice(lo, n)
                    split = [words(t) for t in part.column(1).to_pylist()]
                    rows = [(row, len(w), spans, sorted(items)) for row, w, (spans, items) in zip(part.column(0).to_pylist(), split, _search(split, tables), strict=True) if all_rows or spans]
                    if rows:
                        row, size, spans, items = zip(*rows, strict=True)
                        spans = pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], _TYPE.field("spans").type)
                        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(size), spans, pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

        return _shared.map_arrow(flat.select("row", "text"), run, "row long, n_words long, spans array<struct<first: int, last: int>>, items array<string>")

    found = reduce(DataFrame.unionByName, [scan(uri, k == 0) for k, uri in enumerate(blocks)])
    found = _shared.materialize(found, "hits").groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(batches):
        for batch in batches:
            rows = [_merged(n, [(s["first"], s["last"]) for s in spans], items) for n, spans, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _TYPE)], ["row", "made"])

    made = _shared.map_arrow(found, merge, f"row long, made {RESULT}")
    return flat.join(made, "row").select(*(F.col(f"c{k}") for k in at), "made").toDF(*names, name)


def drop_contaminated(df: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of df without any occurrence, with the columns that they have; options are those of occurrences()."""
    name = _shared.unused(df, "overlap")
    return occurrences(df, items, **options, name=name).where(f"{name}.n_hit = 0").drop(name)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which words of each document lie in windows of ten words of the benchmark."""
    docs, items = (_shared.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = occurrences(docs, items, carry=["doc_id"])
    return found.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH fold AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
patterns AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS window_text
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM fold WHERE kind = 'i' AND len(w) > 0)),
places AS (
  SELECT id AS doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS window_text
  FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM fold CROSS JOIN (SELECT DISTINCT m FROM patterns) WHERE kind = 'd' AND len(w) >= m)),
found AS (SELECT doc_id, p, m, item_id FROM places JOIN patterns USING (m, window_text)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT f.id AS doc_id, CAST(len(f.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN hit h ON f.id = h.doc_id LEFT JOIN named n ON f.id = n.doc_id WHERE f.kind = 'd'
"""
