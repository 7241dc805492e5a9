"""Removal of repeated byte strings by longest previous factors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.  That is the longest-previous-factor question: in
the suffix order of all texts, does the nearest suffix before or after that
belongs to an earlier document share at least ``LENGTH`` bytes?

One suffix array of a corpus doesn't fit a machine, so it is built in parts
that answer the question on their own.  Each window of LENGTH bytes names an
anchor, the rightmost least hash of its k-grams; equal windows name equal
anchors, so suffixes that share LENGTH bytes meet in the part of their anchor.
Each part is put into suffix order (to the depth of LENGTH bytes, more is
never asked), with the common prefix of neighbours; the previous and the next
position of a smaller document, and the least common prefix on the way there,
give every suffix its longest previous factor.

Most anchors occur once and never leave their chunk: a first pass finds the
repeated ones (``chunks.repeated``).  A suffix without an earlier document in
its own chunk goes on to its part; those of hot anchors, which stand in
``HOT`` chunks or more, first meet in shares of the chunks, and only what has
no earlier document there goes on.  Whole-text copies are settled by digest
before.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot, scratch
from .chunks import distinct, is_repeated, make_chunks, pack, repeated, rows_of, texts, unpack
from .kernels import U, mix, powers

LENGTH = 50
GRAM = 24
PIECE = 1 << 19
#: windows of a part, about
PART = 200_000
#: an anchor in so many chunks is hot
HOT = 20_000
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x8CB92BA72F3D8DD7))


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of windows with the same anchor: first window, one past the last, and the anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, np.zeros(0, U)
    up, down = powers()
    total = np.zeros(len(text) + 1, U)
    np.cumsum(_BYTES[text] * up[: len(text)], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(text) - GRAM + 1])
    w = length - GRAM + 1
    value, at, have = h, np.arange(len(h)), 1
    while have < w:  # rightmost least value of every window, by doubling
        step = min(have, w - have)
        right = value[step:] <= value[:-step]
        value, at, have = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step]), have + step
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return cuts, np.append(cuts[1:], len(at)), h[at[cuts]]


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start ``at``, to a depth of ``length`` bytes, and the common prefix of each with the one before it."""
    words = -(-length // 8)
    padded = np.zeros((len(at), words * 8), np.uint8)
    padded[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    order = np.argsort(padded.view(f"S{words * 8}").ravel(), kind="stable")  # compared byte by byte
    numbers = padded.view(">u8")[order].astype(U)
    common = np.zeros(len(at), np.int64)
    if len(at) > 1:
        differ = numbers[1:] ^ numbers[:-1]
        word = (differ != 0).argmax(axis=1)
        x = differ[np.arange(len(differ)), word]
        same = np.where(x == 0, 8 * words, 0)
        for shift in (32, 16, 8):  # equal leading bytes of the first word that differs
            high = x >> U(64 - shift) == 0
            same += np.where(high & (x != 0), shift // 8, 0)
            x = np.where(high, x << U(shift), x)
        common[1:] = np.minimum(same + 8 * word, length)
    return order, common


def previous_smaller(doc: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place of a suffix order: the longest prefix it shares with the nearest place before it that has a smaller document.

    Below ``least`` the search stops and the answer is 0.  All places search
    at once: who meets no smaller document goes on from where that one got to.
    """
    at, shared = np.arange(len(doc)) - 1, common.copy()
    open_ = np.flatnonzero((shared >= least) & (doc[at] >= doc))
    while len(open_):
        met = at[open_]
        at[open_], shared[open_] = at[met], np.minimum(shared[open_], shared[met])
        open_ = open_[(shared[open_] >= least) & (doc[at[open_]] >= doc[open_])]
    return np.where(shared >= least, shared, 0)


def previous_factors(docs: np.ndarray, counts: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For the windows of some contexts: the longest prefix shared with an earlier document of the part (0 below ``length``).

    A context is ``counts + length - 1`` bytes of ``data`` and has ``counts`` windows.
    """
    n = int(counts.sum())
    base = np.cumsum(counts + length - 1) - (counts + length - 1)
    order, common = suffix_order(data, np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(n), length)
    doc = np.repeat(docs, counts)[order]
    out = np.zeros(n, np.int64)
    if n:
        before = previous_smaller(doc, common, length)
        after = previous_smaller(doc[::-1], np.concatenate(([0], common[:0:-1])), length)[::-1]
        out[order] = np.maximum(before, after)
    return out


def _settle(docs, starts, counts, data, tag, length):
    """Removed spans (tag, doc, from, to), and the contexts that go on."""
    late = previous_factors(docs, counts, data, length) >= length
    context = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(late)) - np.repeat(np.cumsum(counts) - counts, counts)
    c, p = context[late], place[late]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] > p[:-1] + length))) if len(c) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(c)) - 1 if len(a) else a
    spans = (tag[c[a]], docs[c[a]], starts[c[a]] + p[a], starts[c[a]] + p[z] + length)
    c, p = context[~late], place[~late]
    stay, at = np.unique(c, return_index=True)
    lo = p[at]
    hi = p[np.append(at[1:], len(c)) - 1] if len(stay) else lo
    sizes = counts + length - 1
    base = (np.cumsum(sizes) - sizes)[stay]
    size = hi - lo + length
    take = np.repeat(base + lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return spans, (stay, docs[stay], starts[stay] + lo, hi - lo + 1, data[take])


_OUT = "kind int, chunk long, part long, share long, docs binary, starts binary, counts binary, data binary"


def _span_rows(tags: np.ndarray, docs: np.ndarray, a: np.ndarray, z: np.ndarray) -> list[tuple]:
    order = np.argsort(tags, kind="stable")
    tags, docs, a, z = tags[order], docs[order], a[order], z[order]
    cuts = np.flatnonzero(np.concatenate(([True], tags[1:] != tags[:-1], [True]))) if len(tags) else np.zeros(0, int)
    return [(0, int(tags[x]), int(tags[x]), -1, docs[x:y].astype("<i8").tobytes(), a[x:y].astype("<i8").tobytes(), z[x:y].astype("<i8").tobytes(), b"") for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans as start, end, start, end ... and the remaining bytes.

    Texts are UTF-8 bytes, null is empty; matches don't cross documents.  A
    byte is removed if a string of ``length`` bytes that covers it also starts
    in a document with a smaller id.  Rows of one id don't remove each other;
    each comes back, with its text's result.  Rows with a null id are left out.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be above {GRAM}")
    spark = docs.sparkSession
    chunks = make_chunks(docs, id_col, text_col, PIECE, length - 1)
    meta = chunks.select("chunk", F.explode(F.arrays_zip("docs", "digests")).alias("x")).select("chunk", F.col("x.docs").alias("doc"), F.col("x.digests").alias("digest"))
    least = scratch.save(meta.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"), "least")
    copies = hot.join(meta, least, ["digest"], "n").where("doc > least")
    copies = scratch.save(copies.groupBy("chunk").agg(F.collect_set(F.struct("doc", "digest")).alias("copies")), "copies")
    total, number = chunks.agg(F.sum("bytes"), F.count("*")).first()

    def chunk_anchors(row: dict):
        raw, offsets = texts(row)
        for r in range(len(row["docs"])):
            a, z, h = anchors(raw[offsets[r] : offsets[r + 1]], length)
            yield r, raw[offsets[r] : offsets[r + 1]], a, z, h

    def hashes(row: dict) -> tuple[np.ndarray, np.ndarray]:
        hs, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for r, _, _, _, h in chunk_anchors(row):
            hs.append(h)
            owners.append(np.full(len(h), row["docs"][r], np.int64))
        return distinct(np.concatenate(hs), np.concatenate(owners))

    again = scratch.save(repeated(chunks, hashes, int((total or 0) * 2 / (length - GRAM + 2)), HOT), "again")
    scratch.free(spark)
    parts = max(256, -(-(total or 0) // (8 * PART)))
    shares = max(1, isqrt(number))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                gone = {(x["doc"], x["digest"]) for x in row["copies"] or ()}
                doc, start, count, data, part = [], [], [], [], []
                found = [x for x in chunk_anchors(row) if len(x[4])]
                # one look-up for the whole chunk
                again, often = is_repeated(np.concatenate([x[4] for x in found]) if found else np.zeros(0, U), row["again"], row["buckets"])
                share = np.where(often, 1 + row["chunk"] % shares, 0)
                shared, at = [], 0
                for r, text, a, z, h in found:
                    own = np.flatnonzero(again[at : at + len(h)])
                    if len(own) and (row["docs"][r], row["digests"][r]) not in gone:
                        lo, hi = a[own], z[own]
                        doc += [row["docs"][r]] * len(own)
                        start.append(row["at"][r] + lo)
                        count.append(hi - lo)
                        part.append((h[own] % U(parts)).astype(np.int64))
                        shared.append(share[at + own])
                        size = hi - lo + length - 1
                        data.append(text[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())])
                    at += len(h)
                if not doc:
                    continue
                doc, start, count, part, shared = np.array(doc, np.int64), *(np.concatenate(x) for x in (start, count, part, shared))
                spans, (stay, d, s, c, bytes_) = _settle(doc, start, count, np.concatenate(data), np.full(len(doc), row["chunk"]), length)
                yield _batch(_span_rows(*spans) + _context_rows(part[stay], shared[stay], np.full(len(stay), row["chunk"]), d, s, c, bytes_, length))
        scratch.trim()

    def among(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["share"].iloc[0] < 0:  # spans that are settled already
            return pdf
        docs, starts, counts = (np.concatenate([np.frombuffer(x, "<i8") for x in pdf[c]]) for c in ("docs", "starts", "counts"))
        chunk = np.repeat(pdf["chunk"].to_numpy(), pdf["docs"].map(len) // 8)
        data = np.frombuffer(b"".join(map(unpack, pdf["data"])), np.uint8)
        spans, (stay, d, s, c, bytes_) = _settle(docs, starts, counts, data, chunk, length)
        rows = _span_rows(*spans)
        if pdf["share"].iloc[0] > 0:
            rows += _context_rows(np.full(len(stay), pdf["part"].iloc[0]), np.zeros(len(stay), np.int64), chunk[stay], d, s, c, bytes_, length)
        return pd.DataFrame(rows, columns=_OUT.replace(",", "").split()[::2])

    told = chunks.join(again, "chunk", "left").join(copies, "chunk", "left")
    first = scratch.save(told.mapInArrow(contexts, _OUT).groupBy("part", "share").applyInPandas(among, _OUT), "settled")
    scratch.free(spark)
    scratch.discard(again)
    spans, open_ = first.where("kind = 0"), first.where("kind = 1")
    if not open_.isEmpty():
        spans = spans.unionByName(open_.groupBy("part", "share").applyInPandas(among, _OUT))
    spans = spans.groupBy("chunk").agg(F.collect_list(F.struct("docs", "starts", "counts")).alias("spans"))

    def marked(row: dict) -> Iterator[tuple]:
        """(piece, doc, at, mask of removed bytes, bytes) of each text or piece in a chunk."""
        gone = {(x["doc"], x["digest"]) for x in row["copies"] or ()}
        held = [tuple(np.frombuffer(x[c], "<i8") for c in ("docs", "starts", "counts")) for x in row["spans"] or ()]
        d, a, z = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(d, kind="stable")
        d, a, z = d[order], a[order], z[order]
        raw, offsets = texts(row)
        for r, doc in enumerate(row["docs"]):
            at, size, piece = row["at"][r], row["sizes"][r], row["pieces"][r]
            if (doc, row["digests"][r]) in gone:
                mask = np.full(size, piece >= 0 or size >= length)
            else:
                cover = np.zeros(size + 1, np.int32)
                lo, hi = np.searchsorted(d, doc, "left"), np.searchsorted(d, doc, "right")
                np.add.at(cover, np.clip(a[lo:hi] - at, 0, size), 1)
                np.add.at(cover, np.clip(z[lo:hi] - at, 0, size), -1)
                mask = np.cumsum(cover[:-1]) > 0
            yield piece, doc, at, mask, raw[offsets[r] : offsets[r + 1]]

    def result(doc: int, mask: np.ndarray, text: np.ndarray) -> tuple:
        spans = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
        return doc, len(mask), spans.tolist(), text[~mask].tobytes()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                out = [result(doc, mask, text) for piece, doc, _, mask, text in marked(row) if piece < 0]
                doc, n, spans, kept = zip(*out, strict=True) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                for piece, doc, at, mask, text in marked(row):
                    if piece >= 0:
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (piece, doc, at)), pa.array([mask.tobytes()], pa.binary()), pa.array([text.tobytes()], pa.binary())], ["piece", "doc_id", "at", "mask", "text"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        """The pieces of a long text, whose overlaps are settled by either."""
        end = max(at + len(text) for at, text in zip(pdf["at"], pdf["text"], strict=True))
        mask, text = np.zeros(end, bool), np.zeros(end, np.uint8)
        for at, own, raw in zip(pdf["at"], pdf["mask"], pdf["text"], strict=True):
            mask[at : at + len(own)] |= np.frombuffer(own, bool)
            text[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        return pd.DataFrame([result(int(pdf["doc_id"].iloc[0]), mask, text)], columns=["doc_id", "n_bytes", "spans", "kept"])

    schema = "doc_id long, n_bytes long, spans array<long>, kept binary"
    spans = scratch.save(spans, "spans")
    scratch.discard(first)
    scratch.free(spark)
    with_spans = lambda x: x.join(spans, "chunk", "left").join(copies, "chunk", "left")
    long_ones = with_spans(chunks.where(F.exists("pieces", lambda x: x >= 0))).mapInArrow(cut, "piece long, doc_id long, at long, mask binary, text binary")
    return with_spans(chunks).mapInArrow(whole, schema).unionByName(long_ones.groupBy("piece").applyInPandas(together, schema))


def _context_rows(part, share, chunk, docs, starts, counts, data, length) -> list[tuple]:
    """Contexts packed to a row for each part, share and chunk."""
    if not len(docs):
        return []
    sizes = counts + length - 1
    base = np.concatenate(([0], np.cumsum(sizes)))
    order = np.lexsort((chunk, share, part))
    part, share, chunk = part[order], share[order], chunk[order]
    cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (share[1:] != share[:-1]) | (chunk[1:] != chunk[:-1]), [True])))
    raw = data.tobytes()
    out = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[x:y]
        out.append((1, int(chunk[x]), int(part[x]), int(share[x]), docs[own].astype("<i8").tobytes(), starts[own].astype("<i8").tobytes(), counts[own].astype("<i8").tobytes(), pack(b"".join(raw[base[k] : base[k + 1]] for k in own))))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, chunk, part, share, docs, starts, counts, data = zip(*rows, strict=True) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (chunk, part, share)), *(pa.array(x, pa.binary()) for x in (docs, starts, counts, data))], _OUT.replace(",", "").split()[::2])
