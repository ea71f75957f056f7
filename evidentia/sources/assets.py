"""A store of assets by content: each file is called by the SHA-256 of its bytes, and is there whole or not at all.

A writer puts bytes under a name of its own first and then moves them to their
digest. Whoever is second finds the file there, or replaces it by the same
bytes; so any number of writers, and tasks that run again, leave one copy of each
asset and raise no error.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.shipping import ship


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def put_if_absent(folder: str, name: str, data: bytes) -> bool:
    """Whether this call put the file there; a file that is there already stays."""
    files, root = _open(folder)
    path = f"{root}/{name}"
    if files.get_file_info(path).type == pafs.FileType.File:
        return False
    files.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as f:
        f.write(data)
    try:
        files.move(own, path)
    except OSError:
        files.delete_file(own)
        if files.get_file_info(path).type != pafs.FileType.File:
            raise
        return False
    return True


def place(digest: str) -> str:
    """Where an asset of that digest is within a store."""
    return f"{digest[:2]}/{digest}"


def store(assets: DataFrame, folder: str, *, content: str = "content") -> DataFrame:
    """assets without their content, with sha256, length and place in the store at folder, where each distinct content is written once; null content is no asset: its digest and place are null.

    Equal contents of one task are written once, and one that another task has
    written already is left alone. Empty content needs no file, its digest says
    all: load() doesn't list it.
    """
    ship(assets.sparkSession)
    digest = F.sha2(F.col(content), 256)
    told = assets.withColumns({"sha256": digest, "length": F.length(content).cast("long")})
    told = told.withColumn("place", F.concat(F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256")))
    _write(assets.where(F.length(content) > 0).select(digest.alias("sha256"), F.col(content).alias("content")), folder)
    return told.drop(content)


def _write(rows: DataFrame, folder: str) -> None:
    def run(batches):
        done: set[str] = set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name not in done:
                    done.add(name)
                    put_if_absent(folder, place(name), data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def load(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, content and whether it is sound (its digest is its name), of every asset of a store; files of writers that were interrupted don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = files.select(F.regexp_extract("path", r"/([0-9a-f]{64})$", 1).alias("sha256"), "content").where("sha256 <> ''")
    return found.select("sha256", "content", (F.sha2("content", 256) == F.col("sha256")).alias("sound"))


def digest_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
