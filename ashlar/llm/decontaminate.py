"""Benchmark decontamination by winnowing (Schleimer, Wilkerson, Aiken 2003).

Every window of ``WINDOW`` consecutive words is represented by the least of
its k-gram hashes, so a text's fingerprints are few, and two texts that share
a whole window share that window's fingerprint at the same place: a shared
span of ``WINDOW`` words can't be missed.  A document's fingerprints are
matched with the benchmark's, and each match is extended to the windows around
it, whose full hashes must occur in the benchmark.

The benchmark's windows are dealt into blocks of a bounded number; each block
is broadcast (``BLOCK_WINDOWS`` rows of 32 bytes and their item ids at most)
and the documents pass it once, so neither memory nor the broadcast grows with
the benchmark.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .kernels import _Q, NON_WORDS, U, grams, mix, sliding_min, strings, winnow, words_of_rows

WINDOW = 10
GRAM = 5
BLOCK_WINDOWS = 400_000


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id, length, hash, print): the distinct windows of each item, with their fingerprints."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids = b.column(0).to_pylist()
            raw, offsets = strings(b.column(1))
            for i, j, h, _, _, first in words_of_rows(raw, offsets, NON_WORDS):
                for r in range(j - i):
                    w = h[first[r] : first[r + 1]]
                    if not len(w):
                        continue
                    length = min(window, len(w))
                    full = grams(w, length)
                    least = sliding_min(grams(w, gram), window - gram + 1) if length == window else full
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i + r]] * len(full), pa.string()), pa.array(np.full(len(full), length, np.int32)), pa.array(full.astype(np.int64)), pa.array(least.astype(np.int64))], ["item_id", "length", "hash", "print"])

    return items.mapInArrow(cut, "item_id string, length int, hash long, print long").distinct()


class _Block:
    """Sorted window hashes of a block by length, each with its items."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        self.window, self.gram = window, gram
        names = table.column("item_id").combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        self.names = names.dictionary.to_pylist()
        item = np.asarray(names.indices.fill_null(-1))
        length, full, least = (np.asarray(table.column(c).combine_chunks()) for c in ("length", "hash", "print"))
        full, least = full.astype(U), least.astype(U)
        self.prints = np.unique(least[length == window])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.prints >> U(44)).astype(np.int64)] = True
        self.by_length = {}
        for n in sorted(set(length.tolist())):
            own = np.flatnonzero(length == n)
            own = own[np.argsort(full[own], kind="stable")]
            self.by_length[n] = (full[own], item[own])

    def starts(self, w: np.ndarray, n: int) -> np.ndarray:
        """Word positions at which a window of length n may start."""
        if n < self.window:
            return np.arange(len(w) - n + 1)
        g = grams(w, self.gram)
        at = winnow(g, self.window - self.gram + 1)
        at = at[self.seen[(g[at] >> U(44)).astype(np.int64)]]
        at = at[_among(g[at], self.prints)]
        reach = at[:, None] - np.arange(self.window - self.gram + 1)
        return np.unique(reach[(reach >= 0) & (reach <= len(w) - n)])

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """A mask of the words inside windows of the block, and their items."""
        hit, items = np.zeros(len(w), bool), set()
        for n, (full, item) in self.by_length.items():
            if len(w) < n:
                continue
            at = self.starts(w, n)
            if not len(at):
                continue
            if n < self.window:
                own = grams(w, n)
            else:
                own = _grams_at(w, at, n)
            lo, hi = np.searchsorted(full, own, "left"), np.searchsorted(full, own, "right")
            for k in np.flatnonzero(lo < hi):
                hit[at[k] : at[k] + n] = True
            for a, z in set(zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True)):
                items.update(self.names[x] for x in item[a:z] if x >= 0)
        return hit, items


def _grams_at(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return grams_rows(w[at[:, None] + np.arange(n)])


def grams_rows(rows: np.ndarray) -> np.ndarray:
    """``grams`` of each row, taken as one window."""
    out = rows[:, 0].copy()
    for j in range(1, rows.shape[1]):
        out *= _Q
        out += rows[:, j]
    return mix(out + U(rows.shape[1]))


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    k = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[k] == x


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, unnamed: bool = False) -> DataFrame:
    """``docs`` plus n_words, n_hit (long), hit_spans (array<int>), hit_items (array<string>), contaminated.

    Words are runs of digits, letters and code points from U+0080 on, A-Z
    lower-cased.  An item's windows are its runs of ``window`` words; an item of
    fewer words is one window, one without words has none.  n_hit counts the
    document's words inside any occurrence of a window; hit_spans lists them as
    start, end, start, end ... in words; hit_items are the items with occurring
    windows.  Null texts have no words, rows of one item id count as one item.
    Items with a null id are left out; with ``unnamed`` they count in n_hit,
    hit_spans and contaminated, and are left out of hit_items only.  Columns of ``docs`` named like an output
    are replaced, all others pass through.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    made = ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated"]
    docs = docs.drop(*made)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null" if unnamed else "item_id is not null and text is not null")
    windows = scratch.save(item_windows(items, window, gram), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    state = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")})
    schema = state.schema
    at = schema.fieldNames().index(text_col)
    for k in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("hash", "length"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(own.toArrow())

        def match(parts: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _Block(block.value, window, gram)
            for b in parts:
                raw, offsets = strings(b.column(at))
                counts, hits, spans, names = [], [], b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                for i, j, h, _, _, first in words_of_rows(raw, offsets, NON_WORDS):
                    for r in range(j - i):
                        w = h[first[r] : first[r + 1]]
                        hit, items = index.hits(w)
                        old = spans[i + r]
                        for a, z in zip(old[::2], old[1::2], strict=True):
                            hit[a:z] = True
                        spans[i + r] = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist() if hit.any() else []
                        names[i + r] = sorted(items | set(names[i + r]))
                        counts.append(len(w))
                        hits.append(int(hit.sum()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns - 4)), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=schema.fieldNames())
            scratch.trim()

        state = state.mapInArrow(match, schema)
        if k + 1 < blocks:
            state = scratch.save(state, "decontaminated")
    return state.withColumn("contaminated", F.col("n_hit") > 0)
