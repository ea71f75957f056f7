"""Token ids as fixed-width packed bits: writer, random-access reader and the corpus index over both.

A shard file holds, in this order,

* the magic ``EVTOK001``;
* blocks of BLOCK_TOKENS ids (the last may be shorter), each id in the fewest
  bits that the vocabulary needs, lowest bit first, blocks padded to a byte;
* the footer: the byte offset of each block and of the end of the last, as
  little-endian int64; each document's id, whether it has one (uint8) and its
  number of tokens, int64 each;
* a trailer of six int64 (bits, tokens for each block, number of blocks,
  documents, tokens, byte offset of the footer) and the magic again.

Ids are contiguous across documents, so any range of tokens is found by
arithmetic: its blocks are read and unpacked with numpy, the rest stays on disk.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared
from evidentia.llm.encode import default_path, encoder

MAGIC = b"EVTOK001"
BLOCK_TOKENS = 1 << 16
_TRAILER = struct.Struct("<6q8s")
_READ_TOKENS = 1 << 20


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id below vocab_size."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in bits bits, lowest first; the last byte is padded with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids that pack() stored, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class ShardWriter:
    """Writes one shard under a temporary name; close() moves it to its own."""

    def __init__(self, uri: str, bits: int, block_tokens: int = BLOCK_TOKENS):
        self._fs, self._path = _shared.open_fs(uri)
        self._temp = f"{self._path}.{uuid.uuid4().hex}.tmp"
        self._out = self._fs.open_output_stream(self._temp)
        self._bits, self._block = bits, block_tokens
        self._pending: list[np.ndarray] = []
        self._n_pending = self.n_tokens = 0
        self._offsets: list[int] = []
        self._ids: list[int] = []
        self._known: list[int] = []
        self._lengths: list[int] = []
        self._out.write(MAGIC)
        self._at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._ids.append(doc_id or 0)
        self._known.append(doc_id is not None)
        self._lengths.append(len(ids))
        self._pending.append(ids)
        self._n_pending += len(ids)
        self.n_tokens += len(ids)
        if self._n_pending >= 16 * self._block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._pending) if self._pending else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // self._block * self._block
        for i in range(0, end, self._block):
            raw = pack(ids[i : min(i + self._block, end)], self._bits)
            self._offsets.append(self._at)
            self._out.write(raw)
            self._at += len(raw)
        self._pending, self._n_pending = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(last=True)
        for values, kind in (([*self._offsets, self._at], "<i8"), (self._ids, "<i8"), (self._known, "u1"), (self._lengths, "<i8")):
            self._out.write(np.array(values, dtype=kind).tobytes())
        self._out.write(_TRAILER.pack(self._bits, self._block, len(self._offsets), len(self._ids), self.n_tokens, self._at, MAGIC))
        self._out.close()
        self._fs.move(self._temp, self._path)


class Shard:
    """Random access to a shard's documents and tokens."""

    def __init__(self, uri: str):
        fs, path = _shared.open_fs(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        self.bits, self.block, n_blocks, self.n_docs, self.n_tokens, footer, magic = _TRAILER.unpack(self._file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        raw = self._file.read_at(size - _TRAILER.size - footer, footer)
        self.offsets = np.frombuffer(raw, "<i8", n_blocks + 1)
        at = 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.known = np.frombuffer(raw, "u1", self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<i8", self.n_docs, at + 9 * self.n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position start on, as uint32; only their blocks are read."""
        if n <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        raw = self._file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = [
            unpack(raw[int(self.offsets[b] - self.offsets[first]) : int(self.offsets[b + 1] - self.offsets[first])], self.bits, min(self.block, self.n_tokens - b * self.block))
            for b in range(first, last + 1)
        ]
        skip = start - first * self.block
        return np.concatenate(parts)[skip : skip + n]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.lengths[k]))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each document's position and ids, in order; about a million tokens are held at once."""
        lo = 0
        while lo < self.n_docs:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + _READ_TOKENS, side="right")) - 1)
            hi = min(hi, self.n_docs)
            base = int(self.starts[lo])
            ids = self.tokens(base, int(self.starts[hi]) - base)
            for k in range(lo, hi):
                yield k, ids[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]
            lo = hi

    def close(self) -> None:
        self._file.close()


def write(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2, block_tokens: int = BLOCK_TOKENS) -> list[tuple[str, int, int, int]]:
    """Encode every text of df and write it to shards under path, in ascending order of ids (null ids first; equal ids by text).

    Rows are range-partitioned on the id and the text's hash, so neither a hot
    id nor a long text gathers more than its own rows in a task. A null text is
    empty: with an end_id it has that one token. An empty table writes nothing.
    A retried task writes the same shard under another temporary name.

    Returns one entry for each shard: its URI, the number of ids before it, its
    documents and its tokens; their number follows the number of partitions.
    """
    tokenizer = tokenizer or default_path()

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], dtype=enc.dtype)
        part, out = TaskContext.get().partitionId(), None
        uri = f"{path}/shard-{part:06d}.tok"
        n = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, size in _shared.text_slices(texts):
                for doc_id, raw in zip(ids[lo : lo + size], enc.encode(texts.slice(lo, size)), strict=True):
                    out = out or ShardWriter(uri, bits_for(max(enc.vocab_size, (end_id or 0) + 1)), block_tokens)
                    out.add(doc_id, np.concatenate([np.frombuffer(raw, enc.dtype), end]))
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([out.n_tokens], pa.int64())], ["part", "uri", "docs", "tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").drop("tie")
    fs, where = _shared.open_fs(path)
    fs.create_dir(where, recursive=True)
    found = sorted(tuple(r) for r in _shared.map_arrow(ordered, run, "part long, uri string, docs long, tokens long").collect())
    shards, before = [], 0
    for _, uri, docs, tokens in found:
        shards.append((uri, before, docs, tokens))
        before += tokens
    return shards


def read_index(spark, shards: list[tuple[str, int, int, int]]) -> DataFrame:
    """One row for each document from the shard files: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32 of its ids as little-endian uint32, shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"

    def run(batches):
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in shard.documents()]
                for lo in range(0, shard.n_docs, 10_000):
                    k = slice(lo, lo + 10_000)
                    size = len(crc[k])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[k], mask=~shard.known[k]), pa.array(shard.starts[:-1][k] + before), pa.array(shard.lengths[k]), pa.array(crc[k], pa.int64()), pa.array([uri] * size)],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )
                shard.close()

    made = spark.createDataFrame([s[:2] for s in shards], "uri string, before long")
    return _shared.map_arrow(made.repartition(max(1, len(shards))), run, schema)


def read_tokens(uri: str, start: int, n: int) -> np.ndarray:
    """n ids of one shard from its position start on."""
    shard = Shard(uri)
    try:
        return shard.tokens(start, n)
    finally:
        shard.close()


def op1_token_store(spark, sf_dir: str) -> DataFrame:
    """All documents written as packed ids with the end id 2, then indexed from the files."""
    path = _shared.scratch(spark, "token-store")
    return read_index(spark, write(_shared.table(spark, sf_dir, "documents"), path))
