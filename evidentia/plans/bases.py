"""Evidence tables derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Canvas of the boxes.
WIDTH, HEIGHT = 320, 200

BASES = {
    "boxes": """
        SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS seq, CAST(l_partkey * 13 % 200 AS INT) AS x0, CAST(l_suppkey * 7 % 150 AS INT) AS y0,
          CAST(l_partkey * 13 % 200 + 10 + 2 * CAST(l_quantity AS INT) AS INT) AS x1, CAST(l_suppkey * 7 % 150 + 6 + l_suppkey % 30 AS INT) AS y1,
          round(1.0 - l_discount * 4, 3) AS confidence, l_returnflag AS kind, l_linestatus AS status
        FROM {lineitem}""",
    "pairs": """
        SELECT a.image_id, a.seq AS sa, b.seq AS sb, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
        FROM ({boxes}) a JOIN ({boxes}) b ON a.image_id = b.image_id AND a.seq < b.seq""",
    "texts": "SELECT conv_id, turn, text FROM {conversations}",
    "colors": "SELECT p_partkey, p_size, concat('#', lpad(hex(CAST(p_partkey * 7919 % 16777216 AS BIGINT)), 6, '0')) AS hex, concat('#', lpad(hex(CAST(p_partkey * 104729 % 16777216 AS BIGINT)), 6, '0')) AS other FROM {part}",
    "urls": "SELECT page_id, url, html FROM {pages}",
    "names": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {part}",
    "events": "SELECT event_id, ts, user_id, event_type, value, props FROM {events}",
    "orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders}",
    "documents": "SELECT doc_id, text, lang, source, n_chars FROM {documents}",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def _expand(sql: str) -> str:
    for name in names_in(sql):
        if name in BASES and "{" + name + "}" not in BASES[name]:
            sql = sql.replace("{" + name + "}", _expand(BASES[name]))
    return sql


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One evidence table over the Parquet files of sf_dir."""
    sql = _expand(BASES[name])
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names_in(sql)})


def base_sql(name: str) -> str:
    """The same table as DuckDB SQL over the driver's views."""
    return _expand(BASES[name]).format_map(_Names())


class _Names(dict):
    def __missing__(self, key):
        return key


def with_sql(names: str, body: str) -> str:
    """body with a common table expression for each named evidence table, called b_<name>."""
    return "WITH " + ", ".join(f"b_{n} AS ({base_sql(n)})" for n in names.split()) + " " + body


def in_turn(names: str, candidates: str, order: str, empty: str, step: str, result: str, group: str = "image_id") -> str:
    """SQL of an ordered step over each group: candidates by order, a state that begins as empty and becomes step (over the state s and the candidate c), and result over r (group, k, s, and the candidate's columns)."""
    head = with_sql(names, "").strip() if names else "WITH"
    head = head.replace("WITH", "WITH RECURSIVE", 1) + ("," if names else "")
    return (
        f"{head} c AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM ({candidates})), "
        f"t AS (SELECT DISTINCT {group}, CAST(0 AS BIGINT) AS k, {empty} AS s FROM c UNION ALL SELECT c.{group}, c.k, {step} FROM t JOIN c ON c.{group} = t.{group} AND c.k = t.k + 1), "
        f"r AS (SELECT c.*, t.s FROM t JOIN c ON c.{group} = t.{group} AND c.k = t.k) {result}"
    )
