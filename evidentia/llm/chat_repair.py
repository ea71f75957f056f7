"""Repair of conversation structure: the cheapest edits, by A* on the edit lattice.

A node of the lattice is a row and what the repaired sequence ends with so far.
An edge keeps, reroles or deletes a row, or inserts an empty message. What the
rows that remain must cost at least is known beforehand, as a sum over the
suffix: a blank or repeated row has to be deleted, a truncated one is charged or
deleted. That estimate is consistent, so keyed by (cost + estimate, audit) the
first arrival at a node has its least cost and, among equal costs, the least
audit. Two ways of one cost to one node never have audits of which one begins
the other, for then it would hold inserts that cost nothing; so the least audit
of a whole is made of least audits of its parts, and the lattice may be searched
in blocks of rows, from the nodes at which the last block ended.

Rows reach the search without their texts, sorted, one block in memory at a
time, however long a conversation is. Its audit, a letter for each edit, then
meets the sorted texts, which are edited as they stream by.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a conversation that are searched at once.
BLOCK = 256
#: Faults of a row, the first that counts.
NONE, BLANK, DUPLICATE, CUT = range(4)
_ROLES = {"u": "user", "a": "assistant"}
#: What a sequence ends with -> what may follow, by initial: nothing yet (0), system (1), user (2), assistant (3).
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _made(state: int) -> str:
    """The initial of the role that an inserted or reroled message has after state."""
    return "a" if state == 2 else "u"


def search(starts: dict[int, tuple[int, str]], rows: list[tuple[str, int]], last: bool) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) at each state behind rows (initial, fault), from starts of that kind; of the last block only the end of the cheapest repair."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        rest[i] = rest[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else min(TRUNCATED, DELETE) if fault == CUT else 0)
    heap = [(cost + rest[0], audit, 0, state) for state, (cost, audit) in starts.items()]
    heapq.heapify(heap)
    seen: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str]] = {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n:
            if not last:
                out[state] = (bound, audit)
            elif state in _ENDS:
                return {state: (bound, audit)}
        cost, to = bound - rest[i], _NEXT[state][_made(state)]
        if (i, to) not in seen:
            heapq.heappush(heap, (bound + INSERT, audit + "I", i, to))
        if i < n:
            initial, fault = rows[i]
            cost += rest[i + 1]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                cost += TRUNCATED if fault == CUT else 0
                if (kept := _NEXT[state].get(initial)) is not None:
                    heapq.heappush(heap, (cost + KEEP, audit + "K", i + 1, kept))
                heapq.heappush(heap, (cost + REROLE, audit + "R", i + 1, to))
    return out


class Lattice:
    """The search of one conversation, whose rows come in order: audits of the nodes reached so far, without what all of them begin with."""

    def __init__(self):
        self.begun: list[str] = []
        self.nodes: dict[int, tuple[int, str]] = {0: (0, "")}
        self.rows: list[tuple[str, int]] = []

    def add(self, initial: str, fault: int) -> None:
        if len(self.rows) == BLOCK:
            found = search(self.nodes, self.rows, False)
            # what can follow nothing, but for a system message that a deletion spares, or follow a system message, can follow an assistant too
            most = found[3][0]
            found = {s: (cost, audit) for s, (cost, audit) in found.items() if s > 1 or cost <= most + (DELETE if s == 0 else 0)}
            shared = os.path.commonprefix([audit for _, audit in found.values()])
            self.begun.append(shared)
            self.nodes = {s: (cost, audit[len(shared) :]) for s, (cost, audit) in found.items()}
            self.rows = []
        self.rows.append((initial, fault))

    def end(self) -> tuple[int, str]:
        ((cost, audit),) = search(self.nodes, self.rows, True).values()
        return cost, "".join([*self.begun, audit])


@dataclass
class _Conversation:
    """What is known of a conversation after some of its rows, which come by turn, role and digest of the text."""

    lattice: Lattice
    first: int | None = None
    turn: int | None = None
    turns: int = 0
    counts: list[int] | None = None
    illegal: int = 0
    before: tuple | None = None

    def add(self, turn: int | None, role: str, digest: bytes, fault: int, later: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in _LEGAL
        if fault != BLANK and (later or self.before == (turn, role, digest)):
            fault = DUPLICATE
        self.before = (turn, role, digest)
        self.counts[fault] += 1
        self.lattice.add(role[:1], fault)

    def report(self) -> tuple:
        cost, audit = self.lattice.end()
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, cost, audit)


def _groups(batches, width: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """The rows of consecutive batches, by runs of equal first columns; each run is to be read before the next is asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[:width]), strict=True))
    held = next(rows, None)

    def run(key):
        nonlocal held
        while held is not None and held[0] == key:
            row, held = held, next(rows, None)
            yield row

    while held is not None:
        yield held[0], (of := run(held[0]))
        for _ in of:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many rows and about as many bytes of strings."""
    held, held_size = [], 0
    for row in rows:
        held.append(row)
        held_size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == most or held_size >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, held_size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _flat(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    present = F.lit(True) if present_col is None else F.coalesce(_shared.column(df, present_col).cast("boolean"), F.lit(False))
    text = [F.coalesce(_shared.column(df, c).cast("string"), F.lit(" ")) for c in (role_col, text_col)]
    rows = _shared.positional(df).select(_shared.column(df, conv_col).cast("long").alias("conv_id"), _shared.column(df, turn_col).cast("long").alias("turn"), text[0].alias("role"), text[1].alias("text"), present.alias("present"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _fault() -> Column:
    ends = F.rtrim(F.translate("text", _SPACE, " " * len(_SPACE)))
    return F.when(ends == "", BLANK).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)


def _reports(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of REPORT."""
    light = rows.select("conv_id", "turn", "role", "digest", "present", F.when(F.col("present"), _fault()).alias("fault"))
    same = ["conv_id", "role", "digest"]
    firsts = light.where("present").groupBy(*same).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least"))
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("role").alias("as"), F.col("digest").alias("text"), F.col("least.turn").alias("first"))
    marked = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("as")) & (F.col("digest") == F.col("text")), "left")
    marked = marked.select("conv_id", "turn", "role", "digest", "present", "fault", (~F.col("turn").eqNullSafe(F.col("first"))).alias("later"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])

    def run(batches):
        def made():
            for conv_id, each in _groups(batches, 7):
                now = _Conversation(Lattice(), counts=[0] * 4)
                for _, turn, role, digest, present, fault, later in each:
                    if present:
                        now.add(turn, role, digest, fault, later)
                yield (conv_id, *now.report())

        yield from _batches(made(), schema)

    return _shared.map_arrow(marked.repartition("conv_id").sortWithinPartitions(*order), run, f"conv_id long, {REPORT}")


def _edited(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The messages of all repaired conversations, each conversation's within one partition and in order."""
    texts = rows.where("present").select("conv_id", "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    both = texts.unionByName(reports.where("audit <> ''").select("conv_id", "audit"), allowMissingColumns=True)
    order = ["conv_id", F.asc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", "digest"]
    kinds = [("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]

    def run(batches):
        def made():
            for conv_id, each in _groups(batches, 6):
                audit, position, state = next(each)[5], 0, 0
                for edit in audit:
                    role, text = (None, "") if edit == "I" else (row := next(each))[2:5:2]
                    if edit == "D":
                        continue
                    if edit != "K":
                        role = _ROLES[_made(state)]
                    state, position = _NEXT[state][role[:1]], position + 1
                    yield conv_id, position, role, text, edit

        yield from _batches(made(), pa.schema(kinds))

    return _shared.map_arrow(both.repartition("conv_id").sortWithinPartitions(*order), run, "conv_id long, position long, role string, text string, edit string")


def repair(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports, one row for each conversation (conv_id and the columns of REPORT), and the repaired messages: conv_id, position, role, text, edit.

    Rows count by turn, null turns first, those of one turn by role and by the
    SHA-256 of the text, so that repeated rows are neighbours. Null roles and
    texts are one space, which makes a row blank; a null conv_id is a
    conversation like any other. A row for which present_col is not true only
    names its conversation: one without other rows has zeros, an empty audit and
    no message, as has one that is repaired to nothing. An empty table gives
    empty tables. Other columns don't matter, whatever their names. Messages of
    a conversation follow each other in order within one partition, until a
    shuffle takes them apart.
    """
    rows = _flat(df, conv_col, turn_col, role_col, text_col, present_col)
    reports = _shared.materialize(_reports(rows), "repair-reports")
    return reports, _edited(rows, reports)


def digests(messages: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of what repair() made: SHA-256 of its role:text lines, taken as they stream by."""

    def run(batches):
        def made():
            for conv_id, each in _groups(batches, 4):
                whole = hashlib.sha256()
                for _, position, role, text in each:
                    whole.update(f"{'' if position == 1 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield conv_id, whole.hexdigest()

        yield from _batches(made(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return _shared.map_arrow(messages, run, "conv_id long, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by a hash of conversation and turn: rows dropped (present is false), emptied, without stops, repeated, or with the role user."""
    key = F.concat_ws(":", *(F.coalesce(_shared.column(df, c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(_shared.column(df, c), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = _shared.positional(df).select(_shared.column(df, "conv_id").alias("conv_id"), _shared.column(df, "turn").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """What the damaged conversations lack, their cheapest repair, and the SHA-256 of the repaired messages."""
    reports, messages = repair(damage(_shared.table(spark, sf_dir, "conversations")), present_col="present")
    made = digests(messages).withColumnRenamed("conv_id", "of")
    whole = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    return reports.join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*reports.columns, whole.alias("repaired_sha256"))


def _sql() -> str:
    """The same by dynamic programming over rows. A state is one string: cost in nine digits, audit, chr(1), repaired lines, each with chr(10) before it; least() of such strings is the rule of ties."""

    def go(state: str, cost: str, letter: str, line: str) -> str:
        at = f"instr({state}, chr(1))"
        return f"lpad((left({state}, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({state}, 10, {at} - 10) || '{letter}' || substr({state}, {at}) || {line}"

    def of(edges: list[str]) -> str:
        return f"least({', '.join(edges)})" if len(edges) > 1 else edges[0]

    def inserts(source: str) -> str:
        """A subquery with up to two inserts after each state; three in a row come back to a state that they left."""
        once = {2: [go(s, "3", "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3")], 3: [go("s2", "3", "I", "chr(10) || 'assistant:'")]}
        step = ", ".join(f"{of([f's{k}', *once[k]])} AS s{k}" for k in once)
        return f"(SELECT * REPLACE ({step}) FROM (SELECT * REPLACE ({step}) FROM {source}))"

    charge, line = "(CASE WHEN fault = 3 THEN {} + 3 ELSE {} END)", "chr(10) || {} || ':' || text"

    def keep(state: str, initial: str) -> str:
        return f"CASE WHEN fault NOT IN (1, 2) AND initial = '{initial}' THEN {go(state, charge.format(0, 0), 'K', line.format('role'))} END"

    def rerole(state: str) -> str:
        role = "assistant" if state == "s2" else "user"
        return f"CASE WHEN fault NOT IN (1, 2) THEN {go(state, charge.format(3, 3), 'R', line.format(repr(role)))} END"

    delete = {k: go(f"s{k}", "4", "D", "''") for k in range(4)}
    row = {
        0: of([delete[0], "NULL"]), 1: of([delete[1], keep("s0", "s")]),
        2: of([delete[2], *(keep(s, "u") for s in ("s0", "s1", "s3")), *(rerole(s) for s in ("s0", "s1", "s3"))]),
        3: of([delete[3], keep("s2", "a"), rerole("s2")]),
    }
    return f"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc FROM range(256) AS t(b)),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda k: ascii(substr(key, k, 1))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, bytes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS plain FROM numbered),
rows AS MATERIALIZED (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN trim(plain) = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(rtrim(plain), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM seen),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conversations
  UNION ALL
  SELECT w.conv_id, r.i, {", ".join(f"{row[k]} AS s{k}" for k in range(4))}
  FROM {inserts("steps")} AS w JOIN rows AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
ends AS (SELECT conv_id, s0, s1, s2, s3 FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
best AS (SELECT conv_id, least(s0, s3) AS s FROM {inserts("ends")}),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  left(s, 9)::BIGINT AS cost, substr(s, 10, instr(s, chr(1)) - 10) AS audit, sha256(substr(s, instr(s, chr(1)) + 2)) AS repaired_sha256
FROM best AS b LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE_SQL = _sql()
