"""Compact tables: rows as JSON arrays, one a line, with constants and defaults told apart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SHARE = 0.8


def plain_table(df: DataFrame, group: str, seq: str, columns: list[str]) -> DataFrame:
    """columns, count and rows of each group, in order of seq."""
    row = F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("{}")) for c in columns)), F.lit("]"))
    row = F.regexp_replace(F.regexp_replace(row, r'\{"v":((?:[^"{}]|"(?:[^"\\]|\\.)*")*)\}', "$1"), r"\{\}", "null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("k"), row.alias("r")))), lambda x: x["r"])
    return df.groupBy(group).agg(F.array(*map(F.lit, columns)).alias("columns"), F.count("*").alias("count"), F.array_join(lines, "\n").alias("rows"))


def column_statistics(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """How each group's column is stored: dropped (all null), constant, default (80 % one value and no null) or kept, with that value as JSON."""
    long = df.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v"), F.col(c).isNull().alias("null")) for c in columns))).alias("x")).select(group, "x.*")
    counts = long.groupBy(group, "column", "v").agg(F.count("*").alias("n"), F.max("null").alias("null"))
    every = counts.groupBy(group, "column").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.max("null").alias("any_null"), F.min("null").alias("only_null"), F.max(F.struct("n", "v")).alias("top"))
    how = F.when(F.col("only_null"), "dropped").when(F.col("kinds") == 1, "constant").when(~F.col("any_null") & (F.col("top.n") >= DEFAULT_SHARE * F.col("all")), "default").otherwise("kept")
    return every.select(group, "column", how.alias("how"), F.when(how.isin("constant", "default"), F.get_json_object("top.v", "$.v")).alias("value"), F.when(how.isin("constant", "default"), F.regexp_replace("top.v", r'^\{"v":|\}$', "")).alias("json"))


def sparse_table(df: DataFrame, group: str, seq: str, columns: list[str]) -> DataFrame:
    """One compact table for each group: count, constants and defaults (JSON objects), kept column names, and rows as JSON arrays, one a line.

    What column_statistics() finds decides: dropped and constant columns leave
    the rows, and a null cell of a default column stands for its default. A
    table of one row keeps every column that isn't null.
    """
    stats = column_statistics(df, group, columns)
    sizes = df.groupBy(group).agg(F.count("*").alias("count"))
    stats = stats.join(sizes, group).withColumn("how", F.when((F.col("count") == 1) & (F.col("how") != "dropped"), "kept").otherwise(F.col("how")))
    order = F.create_map(*(x for k, c in enumerate(columns) for x in (F.lit(c), F.lit(k))))
    told = stats.groupBy(group, "count").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("how") == how, F.struct("column", "json")))).alias(how) for how in ("constant", "default")), F.transform(F.array_sort(F.collect_list(F.when(F.col("how").isin("default", "kept"), F.struct(order[F.col("column")].alias("k"), "column")))), lambda x: x["column"]).alias("columns"))
    cells = F.create_map(*(x for c in columns for x in (F.lit(c), F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{(?:"v":)?|\}$', ""))))
    rows = df.select(group, seq, cells.alias("cells")).join(told, group)
    line = F.transform("columns", lambda c: F.when((F.col("cells")[c] == "") | F.col("cells")[c].eqNullSafe(F.col("default")[c]), F.lit("null")).otherwise(F.col("cells")[c]))
    row = F.concat(F.lit("["), F.array_join(line, ","), F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("k"), row.alias("r")))), lambda x: x["r"])
    return rows.groupBy(group, "count", "constant", "default", "columns").agg(F.array_join(lines, "\n").alias("rows"))


def decode(table: dict) -> list[dict]:
    """The rows of a compact table, with constants and defaults; lines that aren't arrays of the right length are skipped."""
    out = []
    for line in table.get("rows", "").split("\n") if table.get("count") else []:
        try:
            cells = json.loads(line)
        except ValueError:
            continue
        if isinstance(cells, list) and len(cells) == len(table["columns"]):
            row = dict(zip(table["columns"], cells, strict=True))
            out.append(table.get("constants", {}) | {k: table.get("defaults", {}).get(k) if v is None else v for k, v in row.items()})
    return out


def decoded(df: DataFrame, group: str, rows: str, columns: list[str]) -> DataFrame:
    """Cells of plain tables as JSON text, one row for each line: group, line, and the columns."""
    lines = df.select(group, F.posexplode(F.split(rows, "\n")).alias("line", "cells"))
    cells = F.from_json("cells", "array<string>")
    return lines.withColumn("cells", cells).where(F.size("cells") == len(columns)).select(group, "line", *(F.col("cells")[k].alias(c) for k, c in enumerate(columns)))
