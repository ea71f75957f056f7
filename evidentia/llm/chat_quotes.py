"""Conversations from quoting messages: quotes are linked to what they quote, then removed.

A line's quote level is the number of > marks before its text. Runs of lines of
one level are passages; an attribution ("On ... wrote:") before a quote goes
with it. Passages are normalised (case folded, white space as one space) and
hashed, whole and by line; so are each message's own text, paragraphs and
lines. Within a conversation a quoted hash is joined to the latest earlier
message that has it: an as-of join over blocks of turns, which makes one row
for each quoted hash however often a line recurs.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import _shared

#: Turns of one block of the as-of join.
BLOCK_TURNS = 4096
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"(?i)on\b.*\bwrote:\s*\Z")
RESULT = "struct<own: string, keys: array<string>, quotes: array<struct<level: int, key: string, chars: int>>>"
_TYPE = pa.struct([("own", pa.string()), ("keys", pa.list_(pa.string())), ("quotes", pa.list_(pa.struct([("level", pa.int32()), ("key", pa.string()), ("chars", pa.int32())])))])


def normalise(text: str) -> str:
    return " ".join(text.casefold().split())


def _key(text: str) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own text and its quoted passages (level, lines) in order; empty lines end a passage."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    running = 0
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        marks = _MARKS.match(line)
        level = marks.group(1).count(">") if marks else 0
        if level and not running:
            while own and not own[-1].strip():
                own.pop()
            if own and _ATTRIBUTION.match(own[-1].strip()):
                own.pop()
        body = line[marks.end() :] if marks else line
        if level and normalise(body):
            if level == running:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
            running = level
        elif level:
            running = -level  # a new passage follows, and no attribution
        else:
            running = 0
            own.append(line)
    return "\n".join(own).strip(), passages


def _own_keys(own: str) -> set[str]:
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    return {_key(n) for p in parts if (n := normalise(p))}


def _quote_keys(passages: list[tuple[int, list[str]]]) -> dict[tuple[int, str], int]:
    """(level, hash) -> the characters it stands for: a passage as a whole, and each of its lines."""
    out: dict[tuple[int, str], int] = {}
    for level, lines in passages:
        for part in ("\n".join(lines), *(lines if len(lines) > 1 else ())):
            n = normalise(part)
            out[level, _key(n)] = len(n)
    return out


def _parsed(df: DataFrame, text_col: str) -> DataFrame:
    def make():
        def of(texts):
            rows = []
            for text in texts:
                own, passages = parse(text)
                rows.append({"own": own, "keys": sorted(_own_keys(own)), "quotes": [{"level": level, "key": key, "chars": chars} for (level, key), chars in sorted(_quote_keys(passages).items())]})
            return pa.array(rows, _TYPE)

        return of

    return _shared.annotate(df, text_col, make, RESULT, name="parsed")


def _latest_before(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes with parent, the latest earlier turn of their conversation that has their key; others are left out."""
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    wanted = originals.join(quotes.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").groupBy("conv_id", "key", "turn").agg(F.lit(True).alias("has"))
    events = wanted.withColumn("block", block).unionByName(quotes.withColumn("block", block), allowMissingColumns=True)
    near = Window.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    here = events.withColumn("near", F.max(F.when(F.col("has"), F.col("turn"))).over(near)).where("has IS NULL")
    before = Window.partitionBy("conv_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("conv_id", "key", "block").agg(F.max(F.when(F.col("has"), F.col("turn"))).alias("last"))
    far = blocks.withColumn("far", F.max("last").over(before)).select("conv_id", "key", "block", "far")
    return here.join(far, ["conv_id", "key", "block"]).withColumn("parent", F.coalesce("near", "far")).where("parent IS NOT NULL")


def _threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of every linked message, by pointer doubling: as many rounds as the logarithm of the longest chain."""
    now = _shared.materialize(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = now.join(up, ["conv_id", "root"], "left")
        moved = joined.select("conv_id", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        moved = _shared.materialize(moved, "threads")
        now = moved.drop("moved")
        if not moved.where("moved").head(1):
            return now


def link(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its other columns, own_text, n_quotes, parent_turn, root_turn, depth, position.

    parent_turn is the message that the least nested linked quotes refer to: the
    one with most quoted characters, then the latest. root_turn and depth follow
    parents up; a message without a linked quote is its own root, at depth 0.
    position counts a thread's messages from 1 in order of turns, so a reply
    always comes after what it replies to; repeated rows, and rows of one turn,
    come in order of their text. Null texts are empty; rows with a null
    conversation or turn are never linked, and each is at position 1. Columns of
    df that are called like one of the new ones give way to it. An empty table
    gives no rows.
    """
    made = ["own_text", "n_quotes", "parent_turn", "root_turn", "depth", "position"]
    text_at = _shared.position(df, text_col)
    kept = [k for k, c in enumerate(df.columns) if k != text_at and c.lower() not in made]
    flat = _shared.positional(df)
    rows = flat.select(*(F.col(f"c{k}") for k in kept), _shared.column(df, conv_col).alias("conv_id"), _shared.column(df, turn_col).cast("long").alias("turn"), F.col(f"c{text_at}").alias("text"))
    parsed = _shared.materialize(_parsed(rows, "text").drop("text"), "messages")
    keyed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "parsed")
    originals = keyed.select("conv_id", "turn", F.explode("parsed.keys").alias("key"))
    quotes = keyed.select("conv_id", "turn", F.explode("parsed.quotes").alias("q")).select("conv_id", "turn", "q.*").groupBy("conv_id", "turn", "level", "key").agg(F.max("chars").alias("chars"))
    found = _latest_before(originals, quotes).groupBy("conv_id", "turn", "level", "parent").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct(-F.col("level"), "chars", "parent"))
    parents = _shared.materialize(found.groupBy("conv_id", "turn").agg(best["parent"].alias("parent_turn")), "parents")
    threads = _threads(parents.withColumnRenamed("parent_turn", "parent")).join(parents, ["conv_id", "turn"]).withColumnRenamed("root", "root_turn")
    out = parsed.join(threads, ["conv_id", "turn"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    own = [*(f"c{k}" for k in kept), F.col("parsed.own").alias("own_text"), F.size("parsed.quotes").alias("n_quotes"), "parent_turn", "root_turn", "depth"]
    loose = out.where("conv_id IS NULL OR turn IS NULL").select(*own, F.lit(1).alias("position"))
    return _numbered(out.where("conv_id IS NOT NULL AND turn IS NOT NULL")).select(*own, "position").unionByName(loose).toDF(*(df.columns[k] for k in kept), *made)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with position, their rank in the thread: by blocks of turns, so that no thread meets in one task."""
    thread = ["conv_id", "root_turn"]
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    before = Window.partitionBy(*thread).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*thread, "block").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    near = F.row_number().over(Window.partitionBy(*thread, "block").orderBy("turn", "parsed.own"))
    return rows.join(blocks, [*thread, "block"]).withColumn("position", (F.col("base") + near).cast("int"))


def op3_quotation_links(spark, sf_dir: str) -> DataFrame:
    """All messages without quotes, with the message that each replies to and its place in the thread."""
    return link(_shared.table(spark, sf_dir, "conversations"))
