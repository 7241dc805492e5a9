"""Token-id files with fixed-width bit packing.

A file holds::

    magic   8 bytes  b"ASHTOK1\\0"
    blocks  ids in ceil(log2(vocabulary)) bits each; 32 ids fill as many 32-bit
            little-endian words as an id has bits; a block has ``block`` ids
    index   block byte offsets, then doc_id and first id of every document
    tail    n_ids, n_docs, n_blocks, index offset (u64), width, block (u32)

Blocks start at known offsets and unpack with a few vectorised shifts, so any
range of ids can be read by touching only its blocks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import runs, tokenizer

MAGIC = b"ASHTOK1\0"
TAIL = np.dtype([("n_ids", "<u8"), ("n_docs", "<u8"), ("n_blocks", "<u8"), ("index", "<u8"), ("width", "<u4"), ("block", "<u4")])
BLOCK = 1 << 16


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """32 ids to ``width`` words; the last group is filled up with zeros."""
    rows = -(-len(ids) // 32)
    v = np.zeros((rows, 32), np.uint64)
    v.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, width + 1), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for j in range(32):
        k, s = divmod(j * width, 32)
        shifted = v[:, j] << np.uint64(s)
        out[:, k] |= shifted & low
        out[:, k + 1] |= shifted >> np.uint64(32)
    return out[:, :width].astype("<u4").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u4").reshape(-1, width).astype(np.uint64)
    words = np.concatenate((words, np.zeros((len(words), 1), np.uint64)), axis=1)
    out = np.empty((len(words), 32), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(32):
        k, s = divmod(j * width, 32)
        out[:, j] = ((words[:, k] | (words[:, k + 1] << np.uint64(32))) >> np.uint64(s)) & mask
    return out.reshape(-1)[:n]


def _store(uri: str):
    """A file system and path; plain and file: paths are a folder all machines share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:].replace("//", "", 1) if uri.startswith("file://") else uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, uri: str, width: int, block: int = BLOCK):
        if width > 32 or block % 32:
            raise ValueError("ids have at most 32 bits and a block a multiple of 32 ids")
        store, at = _store(uri)
        store.create_dir(os.path.dirname(at), recursive=True)
        self.out, self.width, self.block = store.open_output_stream(at), width, block
        self.out.write(MAGIC)
        self.at, self.offsets, self.docs, self.first = len(MAGIC), [], [], []
        self.n, self.held, self.waiting = 0, [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.first.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(self.waiting // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for k in range(0, n, self.block):
            part = ids[k : min(k + self.block, n)]
            if int(part.max()) >> self.width:
                raise ValueError("an id lies outside the vocabulary")
            data = pack_bits(part, self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        for x, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.first, "<u8")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(np.array([(self.n, len(self.docs), len(self.offsets), self.at, self.width, self.block)], TAIL).tobytes())
        self.out.close()


class Reader:
    """Random access: ``ids(a, b)`` reads only the blocks that hold ids a to b - 1."""

    def __init__(self, uri: str):
        store, at = _store(uri)
        self.file = store.open_input_file(at)
        size = self.file.size()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        tail = np.frombuffer(self.file.read_at(TAIL.itemsize, size - TAIL.itemsize), TAIL)[0]
        self.n, self.width, self.block = int(tail["n_ids"]), int(tail["width"]), int(tail["block"])
        blocks, docs = int(tail["n_blocks"]), int(tail["n_docs"])
        index = self.file.read_at(8 * (blocks + 2 * docs), int(tail["index"]))
        self.offsets = np.frombuffer(index, "<u8", blocks)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.first = np.append(np.frombuffer(index, "<u8", docs, 8 * (blocks + docs)), np.uint64(self.n)).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        k, z = a // self.block, (b - 1) // self.block
        out = []
        for x in range(k, z + 1):
            n = min(self.block, self.n - x * self.block)
            out.append(unpack_bits(self.file.read_at(-(-n // 32) * 4 * self.width, int(self.offsets[x])), self.width, n))
        return np.concatenate(out)[a - k * self.block : b - k * self.block]

    def close(self) -> None:
        self.file.close()


def write_ids(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending id order; returns (path, n_docs, n_ids, base) of the files.

    Texts are range-partitioned by id, so file k holds smaller ids than file
    k + 1; base counts the ids in the files before.  A task writes to a name of
    its own attempt and only the files of finished tasks are returned, so
    retries and speculative copies do no harm.  Null texts count as empty,
    repeated rows are written each time, rows with a null id are left out.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch.small_batches(spark)
    width = width_of(max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, t, out = TaskContext.get(), tokenizer(tokenizer_file), None
        end, where = np.array([end_id], "<u4"), f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        for b in parts:
            docs, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for i, j in runs(texts):
                for doc, ids in zip(docs[i:j], t.encode_batch(texts[i:j]), strict=True):
                    out = out or Writer(where, width)
                    out.add(doc, np.concatenate((np.frombuffer(ids, "<u4"), end)))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([where]), pa.array([len(out.docs)], pa.int64()), pa.array([out.n], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    done, base, files = sorted(rows.mapInArrow(write, "part int, path string, n_docs long, n_ids long").collect()), 0, []
    for _, path, n_docs, n_ids in done:
        files.append((path, n_docs, n_ids, base))
        base += n_ids
    return spark.createDataFrame(files, "path string, n_docs long, n_ids long, base long").repartition(max(1, len(files)))


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files of ``write_ids``; ids are little-endian u32."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file, at = Reader(path), 0
                while at < len(file.docs):
                    # whole documents of about 16 blocks at a time
                    end = max(at + 1, int(np.searchsorted(file.first, file.first[at] + 16 * BLOCK, "right")) - 1)
                    ids = file.ids(int(file.first[at]), int(file.first[end])).astype("<u4")
                    cuts = file.first[at : end + 1] - file.first[at]
                    yield pa.RecordBatch.from_arrays([pa.array(file.docs[at:end]), pa.array(base + file.first[at:end]), pa.array([ids[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["doc_id", "start", "ids"])
                    at = end
                file.close()

    return files.select("path", "base").mapInArrow(read, "doc_id long, start long, ids binary")


def encode_to_files(docs: DataFrame, tokenizer_file: str, end_id: int, **named) -> DataFrame:
    """``write_ids`` to a folder in shared storage."""
    return write_ids(docs, tokenizer_file, end_id, scratch.path(docs.sparkSession, "tokens"), **named)
