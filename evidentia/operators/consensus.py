"""Single words that were misread, from the same word where it was read well.

A group's well read words are its vocabulary, each in the first spelling met. A
misread word meets the entries of lengths near its own only: an equal join on
length, one row for each length of the band, that loses no entry which could win
or spoil a win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators.greedy import similarity
from evidentia.shipping import ship

# Lengths of words, least ratio of lengths, least similarity and lead over the second.
SHORT, LONG, LENGTHS, LEAST, LEAD = 4, 32, 0.8, 0.6, 0.12
_WORD = r"[\p{L}\p{N}]+"
_WEAK, _OPEN = "regional-fragment-consensus", "unresolved"


def vocabulary(entries: DataFrame, group: str) -> DataFrame:
    """group, look, word: the words of resolved entries (group, seq, value, preferred, status) by their letters as Latin ones, in the first spelling by seq and place."""
    kept = F.coalesce("status", F.lit("")).isin(_WEAK, _OPEN)
    value = F.when(F.coalesce("preferred", F.lit("")) != "", F.col("preferred")).when(F.col("status") == "confirmed", F.col("value"))
    words = entries.where(~kept).select(group, "seq", F.posexplode(F.regexp_extract_all(value, F.lit(_WORD), F.lit(0))).alias("place", "word")).withColumn("look", text.latin_look(F.col("word")))
    first = F.min(F.struct("seq", "place", "word"))
    return words.where(F.length("look").between(SHORT, LONG)).groupBy(group, "look").agg(first.alias("f")).select(group, "look", F.col("f.word").alias("word"))


def observed(entries: DataFrame, group: str) -> DataFrame:
    """group, seq, look of entries that need help: weak fragments, and single words without a preferred reading."""
    words = F.regexp_extract_all(F.coalesce("value", F.lit("")), F.lit(_WORD), F.lit(0))
    weak = F.coalesce(F.col("status") == _WEAK, F.lit(False))
    open_ = (F.coalesce("preferred", F.lit("")) == "") & (F.size(words) == 1)
    look = text.latin_look(F.when(weak, F.col("preferred")).otherwise(F.get(words, 0)))
    return entries.where(weak | open_).select(group, "seq", look.alias("look")).where(F.length("look").between(SHORT, LONG))


def repeated_words(entries: DataFrame, group: str) -> DataFrame:
    """Entries that a vocabulary word explains: group, seq, word, confidence (three places).

    The most similar entry of a length within LENGTHS wins if it reaches LEAST
    and leads the second by LEAD; the greater in the order of looks is first on
    ties, where nothing wins. Null groups are groups like any other in neither
    table: their entries get nothing.
    """
    ship(entries.sparkSession)
    n = F.length("look")
    near = observed(entries, group).withColumn("length", F.explode(F.sequence(F.ceil(n * LENGTHS).cast("int"), F.floor(n / LENGTHS).cast("int"))))
    words = vocabulary(entries, group).select(group, "word", F.col("look").alias("entry"), F.length("look").alias("length"))
    ratio = F.least(F.length("look"), F.col("length")) / F.greatest(F.length("look"), F.col("length"))
    # what is further than LEAD below the least that wins can neither win nor spoil a win
    close = near.join(words, [group, "length"]).where(ratio >= LENGTHS).withColumn("close", similarity(F.col("look"), F.col("entry"), LEAST - LEAD))
    line = Window.partitionBy(group, "seq").orderBy(F.desc("close"), F.desc("entry"))
    ranked = close.withColumns({"rank": F.row_number().over(line), "second": F.lead("close").over(line)})
    won = ranked.where((F.col("rank") == 1) & (F.col("close") >= LEAST) & (F.col("second").isNull() | (F.col("close") - F.col("second") >= LEAD)))
    return won.select(group, "seq", "word", F.round("close", 3).alias("confidence"))
