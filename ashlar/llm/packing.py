"""Packing of documents into fixed-length training sequences: concatenate and cut.

Two passes.  The first tokenises every document once, where it lies, and
stores its ids with their offset inside the partition.  The partitions' token
totals (one number each) are summed up into global offsets.  In the second
pass every document knows its place in the concatenation, and is cut at the
multiples of the sequence length; documents that cross a boundary give a piece
on either side.  Only the last sequence of the whole corpus is padded, and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import runs, tokenizer


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", narrow: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids plus ``end_id``; a null or empty text is ``end_id``
    alone.  ids holds the piece's ids as little-endian unsigned 32-bit integers,
    start counts the document's ids before it, offset is its place in the
    sequence.  Sequences are filled without gaps; all but the last are full.
    Repeated rows, and rows with a null id, are packed once for each row.
    Other columns are ignored.  ``narrow`` stores ids below 65,536 in two bytes
    between the passes.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    kind = "<u2" if narrow else "<u4"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], kind).tobytes()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        t = tokenizer(tokenizer_file)
        for b in parts:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, j in runs(texts):
                ids = t.encode_batch(texts[i:j])
                if narrow:
                    flat = np.frombuffer(b"".join(ids), "<u4")
                    if len(flat) and flat.max() > 0xFFFF:
                        raise ValueError("narrow=True needs ids below 65,536")
                    flat = flat.astype("<u2").tobytes()
                    cuts = [0, *accumulate(len(x) // 2 for x in ids)]
                    ids = [flat[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                ids = [x + end for x in ids]
                sizes = np.array([len(x) for x in ids], np.int64) // np.dtype(kind).itemsize
                starts = local + np.cumsum(sizes) - sizes
                local += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int32)), pa.array(starts), b.column(0).slice(i, j - i), pa.array(sizes), pa.array(ids, pa.binary())], ["part", "local", "doc_id", "n", "ids"])
        scratch.trim()

    coded = scratch.save(rows.mapInArrow(encode, f"part int, local long, doc_id {id_type}, n long, ids binary"), "ids")
    totals = sorted(coded.groupBy("part").agg(F.sum("n")).collect())
    before = [0, *accumulate(n for _, n in totals)]
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at, n = np.asarray(b.column(0)), np.asarray(b.column(2))
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            doc = np.repeat(np.arange(len(n)), count)
            sequence = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            start = np.maximum(sequence * length, at[doc]) - at[doc]
            end = np.minimum((sequence + 1) * length, (at + n)[doc]) - at[doc]
            whole = [np.frombuffer(x.as_buffer(), kind) for x in b.column(3)]
            ids = [whole[d][s:e].astype("<u4").tobytes() for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(doc)), pa.array(start), pa.array(end - start), pa.array(ids, pa.binary()), pa.array(n[doc]), pa.array(sequence), pa.array(at[doc] + start - sequence * length)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        scratch.trim()

    placed = coded.join(F.broadcast(bases), "part").select((F.col("base") + F.col("local")).alias("at"), "doc_id", "n", "ids")
    return placed.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
