"""Chunks of whole texts, and which of their hashes occur elsewhere too.

A chunk row holds some megabytes of consecutive texts, compressed, so that a
pass can be repeated over the same chunks and told something about each.
``repeated`` finds the hashes that occur in more than one place of the corpus
while moving only four bytes for each distinct hash of a chunk: hashes are
dealt into buckets that are small by construction (a chunk gives a hash once,
however hot it is), and each bucket answers its chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .kernels import U, strings

CHUNK = 2 << 20
#: hashes of a bucket, about
BUCKET = 400_000
SEEN = 1 << 22
SCHEMA = "chunk long, docs array<long>, sizes array<long>, at array<long>, pieces array<long>, digests array<binary>, bytes long, data binary"


def make_chunks(docs: DataFrame, id_col: str, text_col: str, piece: int | None = None, overlap: int = 0) -> DataFrame:
    """Chunk rows of all texts with an id; null texts count as empty.

    A text longer than ``piece`` bytes is cut into pieces that overlap by
    ``overlap`` bytes; ``at`` is a piece's place in its text, and
    ``pieces`` numbers the texts that were cut (-1: whole).  digests
    are 128 bits of the whole text's SHA-256, the same in all its pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("doc_id is not null").select("doc_id", "text", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        k = many = part << 33
        held: list[tuple] = []
        size = 0
        for b in parts:
            raw, offsets = strings(b.column(1))
            ids, digests = b.column(0).to_pylist(), b.column(2).to_pylist()
            for r in range(b.num_rows):
                text = raw[offsets[r] : offsets[r + 1]]
                step = piece or max(1, len(text))
                starts = range(0, max(1, len(text) - overlap), step)
                many += len(starts) > 1
                for at in starts:
                    own = text[at : at + step + overlap] if len(starts) > 1 else text
                    held.append((ids[r], at, many if len(starts) > 1 else -1, digests[r], own.tobytes()))
                    size += len(own)
                    if size >= CHUNK:
                        yield _chunk(k, held)
                        held, size, k = [], 0, k + 1
        if held:
            yield _chunk(k, held)

    return scratch.save_bucketed(rows.mapInArrow(cut, SCHEMA), "chunks", "chunk")


def _chunk(name: int, held: list[tuple]) -> pa.RecordBatch:
    ids, at, pieces, digests, parts = zip(*held, strict=True)
    data = b"".join(parts)
    many = lambda x: pa.array([list(x)], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), many(ids), many(map(len, parts)), many(at), many(pieces), pa.array([list(digests)], pa.list_(pa.binary())), pa.array([len(data)], pa.int64()), pa.array([pack(data)], pa.binary())], ["chunk", "docs", "sizes", "at", "pieces", "digests", "bytes", "data"])


_codecs: dict[str, object] = {}


def pack(data: bytes) -> bytes:
    try:
        import zstandard
    except ImportError:
        return b"z" + zlib.compress(data, 1)
    if "pack" not in _codecs:
        _codecs["pack"] = zstandard.ZstdCompressor(level=1)
    return b"s" + _codecs["pack"].compress(data)


def unpack(data: bytes) -> bytes:
    if data[:1] == b"z":
        return zlib.decompress(data[1:])
    import zstandard

    if "unpack" not in _codecs:
        _codecs["unpack"] = zstandard.ZstdDecompressor()
    return _codecs["unpack"].decompress(data[1:])


def texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk row."""
    sizes = np.asarray(row["sizes"], np.int64)
    return np.frombuffer(unpack(row["data"]), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) % U(n)).astype(np.int64)


def repeated(chunks: DataFrame, hashes: Callable[[dict], tuple[np.ndarray, np.ndarray]], total: int, hot: int = 1 << 62) -> DataFrame:
    """(chunk, again, buckets): for each chunk its hashes that occur in two places at least.

    ``hashes(row)`` gives the chunk's distinct hashes (u64) and a mask of those
    that occur twice within the chunk already.  ``total`` is about how many
    there are in all.  Hashes are compared by 32 bits inside their bucket, so a
    few more than the repeated ones may be told.  Those of ``hot`` chunks at
    least are marked.
    """
    buckets = max(256, -(-total // BUCKET))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in rows_of(b):
                h, twice = hashes(row)
                if not len(h):
                    continue
                at = bucket_of(h, buckets)
                order = np.argsort(at, kind="stable")
                h, twice, at = h[order], twice[order], at[order]
                low = (h & U(0xFFFFFFFF)).astype("<u4")
                cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
                yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, row["chunk"], np.int64)), pa.array([low[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([np.packbits(twice[x:y]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "chunk", "low", "twice"])
        scratch.trim()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u4") for x in pdf["low"]]
        sizes = np.array([len(x) for x in parts])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf["twice"], sizes, strict=True)]).astype(bool)
        every = np.concatenate(parts)
        _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        count = count[inverse]
        again = (count > 1) | twice
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        low, many = [], []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = again[a:z]
            low.append(every[a:z][own].tobytes())
            many.append(np.packbits(count[a:z][own] >= hot).tobytes())
        out = pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "low": low, "hot": many})
        return out[out["low"].map(len) > 0]

    dealt = chunks.mapInArrow(deal, "bucket long, chunk long, low binary, twice binary")
    told = dealt.groupBy("bucket").applyInPandas(meet, "chunk long, bucket long, low binary, hot binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "low", "hot")).alias("again"))
    return told.withColumn("buckets", F.lit(buckets))


def is_repeated(h: np.ndarray, again: list[dict] | None, buckets: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which of a chunk's hashes ``repeated`` has told, and which of these are hot."""
    if not again or not len(h):
        return np.zeros(len(h), bool), np.zeros(len(h), bool)
    known = np.concatenate([np.frombuffer(x["low"], "<u4").astype(U) | (U(x["bucket"]) << U(32)) for x in again])
    many = np.concatenate([np.unpackbits(np.frombuffer(x["hot"], np.uint8), count=len(x["low"]) // 4) for x in again]).astype(bool)
    order = np.argsort(known)
    known, many = known[order], many[order]
    # most hashes stand alone, and most of these are told by their last bits
    seen = np.zeros(SEEN, bool)
    seen[(known & U(SEEN - 1)).astype(np.int64)] = True
    at = np.flatnonzero(seen[(h & U(SEEN - 1)).astype(np.int64)])
    key = (h[at] & U(0xFFFFFFFF)) | (bucket_of(h[at], buckets).astype(U) << U(32))
    k = np.minimum(np.searchsorted(known, key), len(known) - 1)
    own, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    own[at] = known[k] == key
    hot[at] = own[at] & many[k]
    return own, hot


def rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for k in range(b.num_rows):
        yield b.slice(k, 1).to_pylist()[0]


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether they have two owners at least."""
    if not len(h):
        return h, np.zeros(0, bool)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    lo, hi = np.minimum.reduceat(owner, cuts), np.maximum.reduceat(owner, cuts)
    return h[cuts], lo < hi
