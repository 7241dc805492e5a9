"""Repeated paragraphs by MinHash banding, and passages repeated inside other text.

Paragraphs are the text's own: every line with a word, however short, and in
texts with blank lines also each block of several lines.  Each paragraph's
5-word shingles give ``KEYS`` keys of two min-hashes, and only paragraphs with
a key that stands elsewhere too go on (``chunks.repeated`` tells, at four
bytes a key): of two paragraphs at the threshold 0.8 one of eight keys agrees
with probability 1 - 0.36**8 = 0.9997, as in the bands, and equal ones always agree.  What is
left collapses to distinct paragraphs, is banded (8 bands of 2, tuned for
recall: 1 - 0.36**8 = 0.9997 at 0.8), joined, verified by exact Jaccard, and
clustered by components.

Passages are copies of ``LEAST`` words at least that lie anywhere in a text,
across line breaks too.  Every run of ``LEAST`` words learns its first place
in the corpus (least document, then position), and runs that continue one
another in both texts make one passage, so it ends where the copy ends.  A
phrase said again and again is one passage too, however often either side says it.
Passages of the same two documents are joined over edits if the whole has a
Jaccard similarity at the threshold.  Runs are prefiltered like the keys; then
only each chunk's first places of repeated runs travel, column by column and
compressed, to buckets that are small by construction; a bucket answers with
the number of a place and the earlier place it has found.  The chunks
themselves are bucketed and never shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot, minhash, scratch
from .chunks import BUCKET, bucket_of, distinct, is_repeated, make_chunks, pack, repeated, rows_of, texts, unpack
from .kernels import SPACES, U, grams, mix, words_of_rows

LEAST, SHINGLE, KEYS = 9, 5, 8
#: odd factors; gram hashes are mixed already, so multiplying orders them anew
_SALTS = mix(np.arange(1, 2 * KEYS + 1, dtype=U) * U(0xE7037ED1A0B428DB)) | U(1)
#: a run's first place: its hash, document, word, first byte and bytes
PLACE = np.dtype([("h", "<u8"), ("doc", "<i8"), ("word", "<i4"), ("start", "<i4"), ("size", "<i4")])


class Words:
    """The words of a run of a chunk's texts, one after the other.

    ``text`` numbers the texts in the chunk; starts and ends are bytes of the
    text; ``breaks`` counts the line breaks before each word, with two more
    between texts.
    """

    def __init__(self, i: int, j: int, h: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.h, self.text = h, np.repeat(np.arange(i, j), np.diff(first))
        within = np.flatnonzero(raw[offsets[i] : offsets[j]] == 10)
        if j > i + 1:  # separators stand between the texts of a run
            within = within + np.searchsorted(offsets[i + 1 : j] - offsets[i], within, "right")
        self.breaks = np.searchsorted(within, s) + 2 * (self.text - i)
        base = (offsets[self.text] - offsets[i] + (self.text - i)) if j > i + 1 else 0
        self.start, self.end = s - base, e - base

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words that lie in one text, and their first words."""
        inside = np.flatnonzero(self.text[: len(self.text) - k + 1] == self.text[k - 1 :]) if len(self.h) >= k else np.zeros(0, np.int64)
        return grams(self.h, k)[inside], inside

    def units(self) -> np.ndarray:
        """(first, end) words of the paragraphs: lines, and the blocks of several lines of texts with blank lines."""
        if not len(self.h):
            return np.zeros((0, 2), np.int64)
        step = np.diff(self.breaks)
        new = self.text[1:] != self.text[:-1]
        lines = _between(np.flatnonzero((step > 0) | new) + 1, len(self.h))
        parted = np.unique(self.text[1:][(step > 1) & ~new])
        if not len(parted):
            return lines
        blocks = _between(np.flatnonzero((step > 1) | new) + 1, len(self.h))
        several = self.breaks[blocks[:, 1] - 1] > self.breaks[blocks[:, 0]]
        return np.concatenate((lines, blocks[several & np.isin(self.text[blocks[:, 0]], parted)]))


def _between(cuts: np.ndarray, n: int) -> np.ndarray:
    at = np.concatenate(([0], cuts, [n]))
    return np.stack((at[:-1], at[1:]), axis=1)


def keys(h: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """KEYS keys of each paragraph, each of two min-hashes of its shingles; one of fewer words is one shingle."""
    out = np.empty((len(spans), KEYS), U)
    size = spans[:, 1] - spans[:, 0]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(size == n)
        if len(short):
            out[short] = grams(h, n)[spans[short, 0]][:, None]
    full = size >= SHINGLE
    if full.any():
        own, g = spans[full], np.append(grams(h, SHINGLE), U(0))
        at = np.stack((own[:, 0], own[:, 1] - SHINGLE + 1), axis=1).ravel()
        least = [np.minimum.reduceat(g * s, at)[::2] for s in _SALTS]
        out[full] = np.stack([mix(mix(least[2 * k] ^ _SALTS[k]) + least[2 * k + 1]) for k in range(KEYS)], axis=1)
    return out


def names(h: np.ndarray, spans: np.ndarray) -> list[int]:
    """A hash of each paragraph's word sequence."""
    return np.array([xxhash.xxh3_64_intdigest(h[a:z].tobytes()) for a, z in spans.tolist()], U).astype(np.int64).tolist()


def word_runs(row: dict) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """The words of a chunk's texts run by run, with the chunk's bytes and offsets."""
    raw, offsets = texts(row)
    for i, j, h, s, e, first in words_of_rows(raw, offsets, SPACES):
        yield Words(i, j, h, s, e, first, raw, offsets), raw, offsets


def runs(row: dict) -> np.ndarray:
    """The runs of LEAST words of a chunk that occur elsewhere too, by document, text and position."""
    out, docs = [np.zeros(0, PLACE)], np.array(row["docs"], np.int64)
    told = [(w, *w.grams(LEAST)) for w, _, _ in word_runs(row)]
    again = is_repeated(np.concatenate([np.zeros(0, U), *(h for _, h, _ in told)]), row["again"], row["buckets"])[0]
    for (w, h, at), mine in zip(told, np.split(again, np.cumsum([len(h) for _, h, _ in told])), strict=False):
        h, at = h[mine], at[mine]
        own = np.empty(len(h), PLACE)
        first = np.searchsorted(w.text, w.text[at])
        own["h"], own["doc"], own["word"], own["start"], own["size"] = h, docs[w.text[at]], at - first, w.start[at], w.end[at + LEAST - 1] - w.start[at]
        out.append(own)
    every = np.concatenate(out)
    return every if (np.diff(every["doc"]) >= 0).all() else every[np.argsort(every["doc"], kind="stable")]


def packed(places: np.ndarray) -> bytes:
    """Places column by column, the positions as differences, compressed."""
    steps = lambda x: np.diff(x, prepend=x[:0].dtype.type(0)).tobytes()
    return pack(b"".join((places["h"].tobytes(), steps(places["doc"]), steps(places["word"]), steps(places["start"]), places["size"].tobytes())))


def unpacked(data: bytes) -> np.ndarray:
    raw = unpack(data)
    n = len(raw) // PLACE.itemsize
    out, at = np.empty(n, PLACE), 0
    for name in PLACE.names:
        kind = PLACE[name]
        own = np.frombuffer(raw, kind, n, at)
        out[name] = np.cumsum(own, dtype=kind) if name in ("doc", "word", "start") else own
        at += n * kind.itemsize
    return out


def first_places(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in order: the first of each hash (hashes ascending), and for each run which of these is its own."""
    order = np.argsort(every["h"], kind="stable")
    h = every["h"][order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    own = np.empty(len(h), np.int64)
    own[order] = np.cumsum(new) - 1
    return every[order[new]], own


def passages(every: np.ndarray, source: np.ndarray, share: int) -> np.ndarray:
    """(start, bytes, source's start, source's bytes, document, source) of the copies of earlier documents' text."""
    copy = source["doc"] < every["doc"]
    every, source = every[copy], source[copy]
    if not len(every):
        return np.zeros((0, 6), np.int64)
    goes_on = (every["doc"][1:] == every["doc"][:-1]) & (every["word"][1:] == every["word"][:-1] + 1) & (source["doc"][1:] == source["doc"][:-1])
    goes_on &= (source["word"][1:] == source["word"][:-1] + 1) | (every["h"][1:] == every["h"][:-1])
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.concatenate((first[1:], [len(every)])) - 1
    ranges = looped(every, source, first, last)
    order = np.lexsort((every["word"][ranges[0]], source["doc"][ranges[0]], every["doc"][ranges[0]]))
    first, last, low, high = bridged(every, source, *(x[order] for x in ranges), share)
    x, y = every["start"][first].astype(np.int64), source["start"][low].astype(np.int64)
    ends = (part["start"][at].astype(np.int64) + part["size"][at] for part, at in ((every, last), (source, high)))
    return np.stack((x, next(ends) - x, y, next(ends) - y, every["doc"][first], source["doc"][first]), axis=1)


def looped(every: np.ndarray, source: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last runs of passages, and those with the least and the greatest source, parts joined whose sources make one gapless place.

    Where a text says the same again and again, first places step back with
    every round.  A part that goes on right after another, with sources that
    meet or overlap the other's, belongs to the same passage: both sides hold
    the same runs.
    """
    meets = (every["doc"][first[1:]] == every["doc"][last[:-1]]) & (every["word"][first[1:]] == every["word"][last[:-1]] + 1) & (source["doc"][first[1:]] == source["doc"][last[:-1]])
    low, high, last, owner = first.copy(), last.copy(), last.copy(), np.arange(len(first))
    lo, hi = source["word"][first].tolist(), source["word"][last].tolist()
    for i in (np.flatnonzero(meets) + 1).tolist():
        p = owner[i - 1]
        if lo[i] > hi[p] + 1 or lo[p] > hi[i] + 1:
            continue
        owner[i], last[p] = p, last[i]
        if lo[i] < lo[p]:
            lo[p], low[p] = lo[i], low[i]
        if hi[i] > hi[p]:
            hi[p], high[p] = hi[i], high[i]
    own = owner == np.arange(len(owner))
    return first[own], last[own], low[own], high[own]


def bridged(every: np.ndarray, source: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last runs of passages, and those with the least and the greatest source, joined that are one near copy together with the words between them.

    Passages come by document, source and position.  Shared shingles are
    counted with their multiplicity, at the places where the copies lie; in
    looped passages, which have no such places, as many as there are at least.
    """
    more = LEAST - SHINGLE + 1  # shingles that start in a run
    a, z = every["word"][first].astype(np.int64), every["word"][last].astype(np.int64) + more
    b, y = source["word"][low].astype(np.int64), source["word"][high].astype(np.int64) + more
    same = (every["doc"][first][1:] == every["doc"][first][:-1]) & (source["doc"][first][1:] == source["doc"][first][:-1]) & (a[1:] > a[:-1]) & (b[1:] > b[:-1])
    chains = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(first)]))
    turned = low != first
    size, loops = np.minimum(z - a, y - b) - np.where(turned, more - 1, 0), turned | (z - a != y - b)
    joined = []
    for i, end in zip(chains[:-1].tolist(), chains[1:].tolist(), strict=True):
        while i < end:
            k = top = i
            if i + 1 < end:
                reach = np.maximum.accumulate(y[i:end])
                # shingles that a passage adds to those of the ones before it
                x_again, y_again = np.maximum(z[i : end - 1] - a[i + 1 : end], 0), np.maximum(reach[:-1] - b[i + 1 : end], 0)
                again = np.where(loops[i + 1 : end], x_again + y_again, np.maximum(x_again, y_again))
                both = size[i] + np.cumsum(np.maximum(size[i + 1 : end] - again, 0))
                fits = np.flatnonzero(100 * both >= share * ((z[i + 1 : end] - a[i]) + (reach[1:] - b[i]) - both))
                k = i + 1 + int(fits[-1]) if len(fits) else i
                top = i + int(np.argmax(y[i : k + 1]))
            joined.append((first[i], last[k], low[i], high[top]))
            i = k + 1
    return tuple(np.array(joined, np.int64).reshape(-1, 4).T)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a bucket: which of its places have an earlier one in another document, and that place."""
    parts = [unpacked(x) for x in pdf["places"]]
    every = np.concatenate(parts)
    order = np.lexsort((every["word"], every["doc"], every["h"]))
    h = every["h"][order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    least = np.empty(len(every), np.int64)
    least[order] = order[new][np.cumsum(new) - 1]
    other = every["doc"][least] != every["doc"]
    every["h"] = 0  # the chunk knows it
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    which, places = [], []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.flatnonzero(other[a:z])
        which.append(pack(np.diff(own, prepend=0).astype("<i4").tobytes()) if len(own) else None)
        places.append(packed(every[least[a:z][own]]) if len(own) else None)
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "which": which, "places": places}).dropna()


def _dealt(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeated runs of a chunk, first places, each run's first place, these in order of bucket and position, and their buckets."""
    every = runs(row)
    source, own = first_places(every)
    at = bucket_of(source["h"], buckets)
    order = np.lexsort((source["word"], source["doc"], at))
    return every, source, own, order, at[order]


def inside(found: np.ndarray, gone: list[dict] | None) -> np.ndarray:
    """Which passages lie within a paragraph that is ``gone`` from their document already."""
    if not gone or not len(found):
        return np.zeros(len(found), bool)
    doc, a, n = (np.array([x[c] for x in gone], np.int64) for c in ("doc_id", "start", "length"))
    docs, number = np.unique(np.concatenate((doc, found[:, 4])), return_inverse=True)
    far = int(max((a + n).max(), (found[:, 0] + found[:, 1]).max())) + 1  # documents lie one after the other
    base, own = number[: len(doc)] * far, number[len(doc) :] * far
    order = np.argsort(base + a)
    reach = np.maximum.accumulate((base + a + n)[order])
    at = np.searchsorted((base + a)[order], own + found[:, 0], "right") - 1
    return (at >= 0) & (reach[at] >= own + found[:, 0] + found[:, 1])


def repeated_passages(told: DataFrame, gone: DataFrame, buckets: int, share: int) -> DataFrame:
    """(doc_id, start, length, cluster, kept_doc_id, kept) of passages.

    ``told`` is chunks with their repeated hashes, ``gone`` the paragraphs
    (chunk, doc_id, start, length) that are to be removed anyway.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                _, source, _, which, at = _dealt(row, buckets)
                if not len(which):
                    continue
                cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
                yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, row["chunk"], np.int64)), pa.array([packed(source[which[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "chunk", "places"])
        scratch.trim()

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                every, source, own, which, at = _dealt(row, buckets)
                for x in row["known"] or ():
                    mine = which[np.searchsorted(at, x["bucket"]) + np.cumsum(np.frombuffer(unpack(x["which"]), "<i4"))]
                    places = unpacked(x["places"])
                    places["h"] = source["h"][mine]
                    source[mine] = places
                out = passages(every, source[own], share)
                out = out[~inside(out, row["gone"])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T.copy()], ["start", "length", "kept_start", "kept_length", "doc_id", "kept_doc_id"])
        scratch.trim()

    known = told.mapInArrow(deal, "bucket long, chunk long, places binary").groupBy("bucket").applyInPandas(_meet, "chunk long, bucket long, which binary, places binary")
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "which", "places")).alias("known"))
    gone = gone.groupBy("chunk").agg(F.collect_list(F.struct("doc_id", "start", "length")).alias("gone"))
    found = told.join(known, "chunk", "left").join(gone, "chunk", "left").mapInArrow(copies, "start long, length long, kept_start long, kept_length long, doc_id long, kept_doc_id long")
    found = scratch.save(found.withColumn("cluster", F.xxhash64("kept_doc_id", "kept_start", "kept_length")), "passages")
    kept = found.select(F.col("kept_doc_id").alias("doc_id"), F.col("kept_start").alias("start"), F.col("kept_length").alias("length"), "cluster", "kept_doc_id").distinct()
    return found.select("doc_id", "start", "length", "cluster", "kept_doc_id", F.lit(False).alias("kept")).unionAll(kept.withColumn("kept", F.lit(True)))


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 80) -> DataFrame:
    """(doc_id, start, length, cluster, kept_doc_id, kept): what (near-)repeats in another document.

    start and length are bytes of the UTF-8 text.  A cluster holds either
    paragraphs, linked by a Jaccard similarity of ``share`` percent at least of
    their 5-word shingles (A-Z lower-cased, words parted by ASCII white space;
    one of fewer words is one shingle), or a passage of ``LEAST`` words at
    least and its copies, wherever they lie, equal or joined over edits at the
    same share.  A passage inside a paragraph that is removed anyway is not told
    again; else a place may be in several rows.  The members in the cluster's
    least document are kept; those in later documents are to be removed.  Repeats within one document only, null
    texts, and rows with a null id give no rows.  Rows of one id count as one
    document.
    """
    chunks = make_chunks(docs, id_col, text_col)

    def hashes(row: dict) -> tuple[np.ndarray, np.ndarray]:
        docs, hs, owners = np.array(row["docs"], np.int64), [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for w, _, _ in word_runs(row):
            spans = w.units()
            if len(spans):
                h, at = w.grams(LEAST)
                hs += [keys(w.h, spans).ravel(), h]
                owners += [np.repeat(docs[w.text[spans[:, 0]]], KEYS), docs[w.text[at]]]
        return distinct(np.concatenate(hs), np.concatenate(owners))

    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    again = scratch.save(repeated(chunks, hashes, int(total / 5)), "again")
    scratch.free(docs.sparkSession)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                every = np.array(row["docs"], np.int64)
                doc, start, size, name, text = [], [], [], [], []
                seen = set()
                for w, raw, offsets in word_runs(row):
                    spans = w.units()
                    if not len(spans):
                        continue
                    told = is_repeated(keys(w.h, spans).ravel(), row["again"], row["buckets"])[0]
                    own = spans[told.reshape(-1, KEYS).any(axis=1)]
                    if not len(own):
                        continue
                    which, x, y, h = w.text[own[:, 0]], w.start[own[:, 0]], w.end[own[:, 1] - 1], names(w.h, own)
                    doc.append(every[which])
                    start.append(x)
                    size.append(y - x)
                    name += h
                    for k, r, a, z in zip(h, which.tolist(), x.tolist(), y.tolist(), strict=True):
                        text.append(None if k in seen else raw[offsets[r] + a : offsets[r] + z].tobytes().decode("utf-8", "replace"))
                        seen.add(k)
                if not name:
                    continue
                doc, start, size = (np.concatenate(x).astype(np.int64) for x in (doc, start, size))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), row["chunk"], np.int64)), *(pa.array(x, pa.int64()) for x in (doc, start, size, name)), pa.array(text, pa.string())], ["chunk", "doc_id", "start", "length", "name", "text"])
        scratch.trim()

    told = chunks.join(again, "chunk")
    found = scratch.save(told.mapInArrow(candidates, "chunk long, doc_id long, start long, length long, name long, text string"), "paragraphs")
    scratch.free(docs.sparkSession)
    once = found.where("text is not null").groupBy("name").agg(F.min("text").alias("text"))
    clusters = minhash.near_duplicates(once, "name", "text", k=SHINGLE, share=share, bands=8, rows_a_band=2)
    # hot names and clusters hold many places, so each is counted before it is met
    count = found.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    clusters = scratch.save(count.join(clusters.select(F.col("doc_id").alias("name"), F.col("component_id").alias("cluster")), "name"), "clusters")
    least = clusters.groupBy("cluster").agg(F.min("least").alias("kept_doc_id"), F.max("last").alias("last")).where("kept_doc_id < last").drop("last")
    named = scratch.save(clusters.select("name", "n", "cluster").join(least, "cluster"), "names")
    out = hot.join(found.drop("text"), named, ["name"], "n").drop("name")
    out = scratch.save(out.withColumn("kept", F.col("doc_id") == F.col("kept_doc_id")), "reported")
    scratch.discard(found)
    scratch.free(docs.sparkSession)
    within = repeated_passages(told, out.where("not kept"), max(256, -(-int(total / 5) // BUCKET)), share)
    scratch.discard(chunks, again)
    scratch.free(docs.sparkSession)
    return out.select("doc_id", "start", "length", "cluster", "kept_doc_id", "kept").unionAll(within)
