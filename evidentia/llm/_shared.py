"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from evidentia.shipping import ship

_scratch: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Where that setting is absent and Spark runs in one process, as in tests, a
    temporary folder serves; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(root)
        return re.sub(r"^file:/+", "file:///", at.getFileSystem(conf).makeQualified(at).toString())
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/evidentia-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root; it is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path within it; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all, under a name of this attempt first; where another attempt was first, its file stays."""
    fs, path = open_fs(uri)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    try:
        fs.move(temp, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(temp)


@atexit.register
def release() -> None:
    """Remove all scratch folders made so far."""
    while _scratch:
        try:
            fs, path = open_fs(_scratch.pop())
            fs.delete_dir(path)
        except OSError:
            pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends in files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """df.mapInArrow() with this package importable in the workers."""
    ship(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # the worker stays, for other tasks

    return df.mapInArrow(whole, schema)


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... in order, so that no name of its own, repeated, dotted or clashing, can be misread."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def position(df: DataFrame, name: str) -> int:
    """Where the column of that name is: the first that equals it, else the first that does but for case."""
    found = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return found[0]


def column(df: DataFrame, name: str) -> Column:
    """The column of positional(df) that stands for that name."""
    return F.col(f"c{position(df, name)}")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def carried(df: DataFrame, carry: list[str] | None, name: str) -> tuple[list[str], list[int]]:
    """The names and positions of the columns to keep, all by default, but for those called name."""
    names = [c for c in (df.columns if carry is None else carry) if c.lower() != name.lower()]
    return names, [k for k, c in enumerate(df.columns) if c.lower() != name.lower()] if carry is None else [position(df, c) for c in names]


def annotate(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], pa.Array]], result: str, *, carry: list[str] | None = None, name: str = "result") -> DataFrame:
    """Append one column that a function of whole texts makes, without a shuffle.

    make() runs once in each task and returns the function, which takes the texts
    (null included) of one of text_slices() and returns an Arrow array of the
    DDL type result. carry names the columns to keep, all by default, whatever
    their names; one that is called name as well is replaced, as withColumn()
    would do.
    """
    names, at = carried(df, carry, name)
    flat = positional(df)
    kept = flat.select(*(F.col(f"c{k}") for k in at), column(df, text_col).alias("text"))
    made = [f"k{k}" for k in range(len(at))] + ["made"]
    schema = StructType([*(StructField(c, flat.schema[k].dataType) for c, k in zip(made, at)), *StructType.fromDDL(f"made {result}")])

    def run(batches):
        of = make()
        for batch in batches:
            for lo, n in text_slices(batch.column(batch.num_columns - 1), 2 << 20):
                *columns, texts = batch.slice(lo, n).columns
                yield pa.RecordBatch.from_arrays([*columns, of(texts.to_pylist())], made)

    return map_arrow(kept, run, schema).toDF(*names, name)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, mod: int, held: int, limit: int, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and y (0 or 1) of at most limit labelled ids outside the held-out fold, in the order of a hash of the id; written to the shared folder.

    An id that occurs more than once gives one row: its greatest label, and its
    least text that is not null.
    """
    flat = positional(labels).select(column(labels, id_col).alias("id"), column(labels, label).cast("int").alias("y"))
    known = flat.where(F.col("y").isNotNull() & F.col("id").isNotNull() & (fold("id", mod) != held))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = positional(docs).select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    return materialize(texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), name)


def text_slices(texts: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Offset and length of consecutive slices of about limit bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    lo = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > lo and size + n > limit:
            yield lo, k - lo
            lo, size = k, 0
        size += n
    if len(sizes):
        yield lo, len(sizes) - lo
