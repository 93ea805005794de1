"""Operator 10: token ids as Arrow IPC files of fixed-size-list batches.

A shard holds a range of documents in ascending ``doc_id`` order as one token stream, cut into
equal-length sequences. ``<shard>.seq.arrow`` has a row per sequence: ``ids``
(fixed_size_list<uint16 or uint32>) and ``mask`` (fixed_size_list<bool>, false on the padding
of the shard's last sequence). ``<shard>.doc.arrow`` has a row per document: doc_id, start
(in the shard's stream), n_tokens. The files are uncompressed, so a memory map gives any
sequence without a copy.
"""

from __future__ import annotations

import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshloom.llm.common import Scratch, id_text, n_partitions, release_memory
from meshloom.llm.word_tokens import word_encoder

BATCH = 256  # sequences in every record batch but the last one of a shard


class TokenFiles(NamedTuple):
    """Where the shards are, and their table: shard, folder, n_docs, n_tokens, start."""

    folder: str
    shards: DataFrame


def _fixed(flat: np.ndarray, kind: pa.DataType, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), length)


class _ShardWriter:
    """Streams one shard to a file of its own name; moved into place when whole, so that a
    second attempt at the same task replaces a first one that was lost half way."""

    def __init__(self, folder: str, shard: int, seq_len: int, dtype: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.stem, self.seq_len, self.dtype = f"{root}/{shard:08d}", seq_len, dtype
        self.kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.parts: dict[str, tuple] = {}
        self.seq = self._open("seq", self.schema)
        self.doc = self._open("doc", pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.left = np.empty(0, dtype)
        self.n_docs = self.n_tokens = 0

    def _open(self, what: str, schema: pa.Schema):
        temp = f"{self.stem}.{what}.{uuid.uuid4().hex}.part"
        sink = self.fs.open_output_stream(temp)
        self.parts[what] = (temp, sink, w := pa.ipc.new_file(sink, schema))
        return w

    def add(self, doc_ids: pa.Array, flat: np.ndarray, n: np.ndarray) -> None:
        """Documents of ``n`` ids each, one after another in ``flat``."""
        starts = self.n_tokens + np.cumsum(n) - n
        self.doc.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(n)], ["doc_id", "start", "n_tokens"]))
        self.n_docs += len(n)
        self.n_tokens += len(flat)
        flat = np.concatenate([self.left, flat])
        step = BATCH * self.seq_len
        whole = len(flat) // step * step
        for at in range(0, whole, step):
            self._write(flat[at : at + step], np.ones(step, bool))
        self.left = flat[whole:].copy()

    def _write(self, flat: np.ndarray, mask: np.ndarray) -> None:
        self.seq.write_batch(pa.RecordBatch.from_arrays([_fixed(flat, self.kind, self.seq_len), _fixed(mask, pa.bool_(), self.seq_len)], schema=self.schema))

    def close(self) -> None:
        if n := len(self.left):
            padded = np.zeros(-(-n // self.seq_len) * self.seq_len, self.dtype)
            padded[:n] = self.left
            self._write(padded, np.arange(len(padded)) < n)
        for what, (temp, sink, w) in self.parts.items():
            w.close()
            sink.close()
            self.fs.move(temp, f"{self.stem}.{what}.arrow")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, seq_len: int = 2048, end_id: int = 1, name: str = "token_files") -> TokenFiles:
    """Encode every text, append ``end_id``, and write shards in ascending doc_id order.

    One shuffle: a range partitioning of the texts by doc_id (ties: by text), so shard k holds
    smaller ids than shard k+1. Null texts count as empty and give just the end id; null ids
    come first; repeated ids stay as rows of their own. An empty table gives no shards. Other
    columns are not carried. ``folder`` must be one that all executors share.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)

    def run(batches):
        release_memory()
        enc, writer = word_encoder(tokenizer), None
        dtype = "<u2" if max(enc.n_ids, end_id + 1) <= 1 << 16 else "<u4"
        shard = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            writer = writer or _ShardWriter(folder, shard, seq_len, dtype)
            for first, ids, at in enc.blocks(b.column(1)):
                writer.add(b.column(0).slice(first, len(at) - 1), np.insert(ids.astype(dtype), at[1:], end_id), np.diff(at) + 1)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, writer.n_docs, writer.n_tokens)], ["shard", "n_docs", "n_tokens"])

    rows = id_text(docs)
    ordered = rows.repartitionByRange(n_partitions(rows), F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    shards = scratch.put(ordered.mapInArrow(run, "shard long, n_docs long, n_tokens long"), "shards")
    return TokenFiles(folder, with_starts(spark, shards))


def with_starts(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Each shard's place in the whole stream. One row for each shard: at 100 TB some hundred
    thousand, three numbers each, so a running sum on the driver is bounded by the task count."""
    rows, at, out = sorted(map(tuple, shards.select("shard", "n_docs", "n_tokens").collect())), 0, []
    for shard, n_docs, n_tokens in rows:
        out.append((shard, n_docs, n_tokens, at))
        at += n_tokens
    return spark.createDataFrame(out, "shard long, n_docs long, n_tokens long, start long")


def read_token_files(files: TokenFiles) -> DataFrame:
    """Documents as the files have them: doc_id, start (in the whole stream), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers). A task maps its shards
    into memory and touches one document's sequences at a time."""
    folder = files.folder
    n = max(1, files.shards.count())

    def run(batches):
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from read_shard(folder, shard, base)

    return files.shards.select("shard", "start").repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_file(folder: str, shard: int, what: str) -> pa.ipc.RecordBatchFileReader:
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{shard:08d}.{what}.arrow"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def read_shard(folder: str, shard: int, base: int):
    seq, doc = open_file(folder, shard, "seq"), open_file(folder, shard, "doc")
    length = seq.schema.field("ids").type.list_size
    held, first, last = np.empty(0, np.uint16), 0, 0  # the stream's part [first, last) that is held
    k = 0
    for i in range(doc.num_record_batches):
        b = doc.get_batch(i)
        crcs = []
        for start, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            parts = [held[start - first :]]
            while last < start + n:
                ids = seq.get_batch(k).column(0)
                parts.append(ids.values.to_numpy(zero_copy_only=True)[ids.offset * length : (ids.offset + len(ids)) * length])
                last += len(parts[-1])
                k += 1
            if len(parts) > 1:
                held, first = np.concatenate(parts), start
            crcs.append(zlib.crc32(held[start - first : start - first + n].astype("<u4").tobytes()))
        starts = pa.array(np.asarray(b.column(1)) + base)
        yield pa.RecordBatch.from_arrays([b.column(0), starts, b.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def sequence(files: TokenFiles, shard: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence and its mask by random access."""
    f = open_file(files.folder, shard, "seq")
    k, at = divmod(row, BATCH)  # all record batches but the last have BATCH rows
    if row < 0 or k >= f.num_record_batches or at >= (b := f.get_batch(k)).num_rows:
        raise IndexError(f"shard {shard} has no sequence {row}")
    return b.column(0)[at].values.to_numpy(zero_copy_only=True), b.column(1)[at].values.to_numpy(zero_copy_only=False)


def token_files(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Write the files below the shared folder and read them back; see the two functions above."""
    scratch = Scratch(docs.sparkSession, "token_files")
    return read_token_files(write_token_files(docs, tokenizer, scratch.path("arrow"), seq_len, end_id))
