"""Line deduplication against levelled sorted runs of line hashes.

The index of lines seen so far is a log-structured merge tree: each run is a
table of (128-bit line hash, first document), bucketed and sorted by the hash.
A new batch of documents reduces its own lines to one row a key and is
merge-joined with every run, which stand ready in their buckets: only the
batch is shuffled.  Its keys that no run holds are its new lines and become a
run of level 0.  ``FANOUT`` runs of one level are merged into one run of the
next, so n batches leave O(log n) runs and each hash is rewritten O(log n)
times.

Batches are taken in ascending doc_id, so the first batch that brings a key
also brings the least doc_id holding it.  Only keys found again are joined
with the documents, those of very many documents by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hot, scratch

FANOUT = 3
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes | None:
    """128-bit key of a line as it is compared; bytes.lower touches A-Z only."""
    return xxhash.xxh3_128_digest(line.strip(STRIPPED).encode("utf-8", "surrogatepass").lower())


class LineIndex:
    """Runs of (h1, h2, owner) by level; ``add`` takes batches in ascending document order."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge the batch's (h1, h2, doc_id) with the runs and keep what is new as a run.

        Returns (h1, h2, owner, n) of the batch's keys that stand in another
        document too: the first one, and the batch's number of rows.
        """
        batch = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        known = F.lit(None).cast("long")
        for k, run in enumerate(self.runs()):
            batch = batch.join(run.select("h1", "h2", F.col("owner").alias(f"known{k}")).hint("merge"), ["h1", "h2"], "left")
            known = F.coalesce(known, F.col(f"known{k}"))
        batch = batch.select("h1", "h2", "owner", "last", "n", known.alias("known"))
        batch = scratch.save_bucketed(batch, "run0", "h1", "h2", dealt=True)
        self._put(batch.where("known is null").select("h1", "h2", "owner"), 0)
        return batch.where("known is not null or owner < last").select("h1", "h2", F.coalesce("known", "owner").alias("owner"), "n")

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            whole, *rest = self.levels[level]
            self.levels[level] = []
            for other in rest:
                whole = whole.unionByName(other)
            merged = whole.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
            self._put(scratch.save_bucketed(merged, f"run{level + 1}", "h1", "h2", dealt=True), level + 1)

    def owners(self) -> DataFrame:
        """(h1, h2, owner): each key stands in exactly one run."""
        whole, *rest = self.runs()
        for run in rest:
            whole = whole.unionByName(run)
        return whole


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, batches: int = 4) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, plus n_lines and n_dropped (long).

    Texts are split at ``\\n`` (null or empty: one empty line).  A line's key is
    the line without ASCII white space at both ends and with A-Z lower-cased.
    Every line whose key has at least ``least_chars`` code points and occurs in
    a document with a smaller id is dropped; within the first document all its
    repeats stay.  Null texts stay null; rows with a null id neither own nor
    lose lines.  Rows of one id count as one document.  Other columns pass
    through unless they are named n_lines or n_dropped, which are replaced.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    docs = docs.drop("n_lines", "n_dropped")

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, digests = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen = {line_key(x) for x in text.as_py().split("\n") if len(x.strip(STRIPPED)) >= least_chars}
                ids += [doc] * len(seen)
                digests += seen
            h = pa.py_buffer(b"".join(digests))
            both = pa.Array.from_buffers(pa.int64(), 2 * len(ids), [None, h])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), both.take(pa.array(range(0, 2 * len(ids), 2), pa.int64())), both.take(pa.array(range(1, 2 * len(ids), 2), pa.int64()))], ["doc_id", "h1", "h2"])
        scratch.trim()

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    cuts = [c for c in known.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []] if batches > 1 else []
    cuts = sorted(set(cuts))
    batch = F.lit(0)
    for k, c in enumerate(cuts):
        batch = F.when(F.col("doc_id") > c, k + 1).otherwise(batch)
    found = known.mapInArrow(keys, "doc_id long, h1 long, h2 long").withColumn("batch", batch.cast("int"))
    found = scratch.save(found, "lines")
    index, again = LineIndex(spark), None
    for k in range(len(cuts) + 1):
        own = found.where(F.col("batch") == k).drop("batch")
        late = hot.join(own, index.add(own), ["h1", "h2"], "n").where("owner < doc_id").select("doc_id", "h1", "h2")
        again = late if again is None else again.unionByName(late)
    again = again.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))

    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1), strict=True):
                lines = (text or "").split("\n")
                kept = lines
                if gone.is_valid:
                    drop = {x["h1"].to_bytes(8, "little", signed=True) + x["h2"].to_bytes(8, "little", signed=True) for x in gone.as_py()}
                    kept = [x for x in lines if len(x.strip(STRIPPED)) < least_chars or line_key(x) not in drop]
                    text = "\n".join(kept)
                texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*schema.fieldNames(), "n_lines", "n_dropped"])
        scratch.trim()

    # keys and lists are given names that no column of docs has
    key, gone = scratch.fresh("gone_id", docs), scratch.fresh("gone", docs)
    joined = docs.withColumn(key, F.col(id_col).cast("long")).join(again.select(F.col("doc_id").alias(key), F.col("gone").alias(gone)), key, "left").select(*docs.columns, gone)
    out = type(schema)([*schema.fields]).add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(rewrite, out)
