"""Tables cut into tiles that are files, and work on pairs of tiles.

Rows of one number of set bits are hashed into tiles of about as many rows, and
each tile's fixed-width items become one file in the shared folder. A unit of
work is a pair of square blocks of tiles, named by two numbers: what a task
compares it reads from the files itself, and a tile that it needs for the next
pair too it has kept. So no tile is ever shuffled, however many pairs it is in.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.llm import _shared

#: Most tiles along the side of a block.
SIDE = 8


@dataclass(frozen=True)
class Tiling:
    """path of the files; pops: numbers of set bits, ascending, and the first tile of each; n: tiles."""

    path: str
    pops: tuple[int, ...]
    starts: tuple[int, ...]
    n: int

    def pop(self, tile: int) -> int:
        return self.pops[bisect_right(self.starts, tile) - 1]

    def number(self, pop: str, key: str) -> Column:
        """The tile that a row belongs to."""
        each = [b - a for a, b in zip(self.starts, (*self.starts[1:], self.n), strict=True)]
        of = F.create_map(*(F.lit(x) for p, a, n in zip(self.pops, self.starts, each, strict=True) for x in (p, F.array(F.lit(a).cast("long"), F.lit(n).cast("long")))))
        of = F.element_at(of, F.col(pop))
        return of[0] + F.pmod(F.xxhash64(key), of[1])

    def read(self, tile: int, dtype: np.dtype) -> np.ndarray:
        """The items of a tile; a tile that no row was hashed to has none."""
        return np.frombuffer(_kept(f"{self.path}/tile-{tile}"), dtype)


def read(uri: str) -> bytes:
    """The bytes of a file; one that was never written, as nothing belongs in it, has none."""
    fs, path = _shared.open_fs(uri)
    try:
        with fs.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return b""


_kept = lru_cache(maxsize=2 * SIDE)(read)


def write_groups(rows: DataFrame, path: str, group: str) -> None:
    """One file for each value of group: its rows' items (binary) one after the other."""

    def run(batches):
        for batch in batches:
            for k, name in enumerate(batch.column(0).to_pylist()):
                _shared.put(f"{path}/{name}", b"".join(batch.column(1)[k].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    fs, where = _shared.open_fs(path)
    fs.create_dir(where, recursive=True)
    grouped = rows.groupBy(F.col(group).alias("name")).agg(F.collect_list("item").alias("items"))
    _shared.map_arrow(grouped, run, "name string").agg(F.count("*")).collect()


def write(rows: DataFrame, tile: int, name: str) -> Tiling:
    """Write rows (pop int, key long, item binary), whose keys are distinct, as tiles of about tile rows."""
    spark = rows.sparkSession
    # one row for each number of set bits, whatever the input
    counts = sorted((r["pop"], r["n"]) for r in rows.groupBy("pop").agg(F.count("*").alias("n")).collect())
    each = [-(-n // tile) for _, n in counts]
    starts = [sum(each[:k]) for k in range(len(each))]
    tiling = Tiling(_shared.scratch(spark, name), tuple(p for p, _ in counts), tuple(starts), sum(each))
    if counts:
        write_groups(rows.select(F.concat(F.lit("tile-"), tiling.number("pop", "key")).alias("name"), "item"), tiling.path, "name")
    return tiling


def pairs(spark: SparkSession, tiling: Tiling, apart: int, run: Callable[[int, int], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """The rows that run makes of each pair of tiles (a <= b), whose numbers of set bits differ by no more than apart."""
    side = max(1, min(SIDE, tiling.n // 32))
    blocks = -(-tiling.n // side)
    units = spark.range(0, blocks * blocks, 1, max(1, min(blocks * blocks, 4 * _shared.partitions(spark) + blocks * blocks // 64)))
    units = units.select(F.expr(f"id div {max(1, blocks)}").alias("i"), F.expr(f"id % {max(1, blocks)}").alias("j")).where("i <= j")

    def of_block(i: int) -> range:
        return range(i * side, min(tiling.n, (i + 1) * side))

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a in of_block(i):
                    for b in of_block(j):
                        if a <= b and tiling.pop(b) - tiling.pop(a) <= apart and (made := run(a, b)) is not None:
                            yield made

    return _shared.map_arrow(units, work, schema)
