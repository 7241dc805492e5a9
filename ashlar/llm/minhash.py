"""Near-duplicate documents by fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017).

A document's word-shingle set is thrown into T = bands * rows bins.  In round i < T every
element falls into a hashed bin with value i + fraction; in round i >= T every
element falls into bin i - T.  Each bin keeps its least value, and the rounds
end once no bin is empty, so after at most 2T rounds every coordinate is
filled, whatever the set's size, and the share of equal coordinates of two
sketches is concentrated around their Jaccard similarity.

Candidates come from bands of the sketch; every link is then confirmed on the
full shingle sets, so no false link survives.  A pair at the threshold 0.8
shares no band with probability (1 - 0.8**4)**32 = 5e-8.

Plan (only steps 4 and 5 look at pairs, of groups that hold several components):

1. one pass over the texts: set size, a 128-bit set digest, 32 band keys;
2. equal sets collapse to their least doc_id, by a partial aggregate;
3. in each band bucket every member is paired with the bucket's least member
   only, and the pairs are verified on their sets and contracted;
4. buckets whose members still lie in different components are cut into blocks
   of about ``BLOCK_DOCS`` documents or ``BLOCK_SHINGLES`` shingles.  Documents
   outside the bucket's largest component meet all others, block by block, by
   matrix products of incidence matrices.  Links within a component are
   skipped: they can't change it;
5. buckets with more than ``MANY`` documents outside their largest component
   first go through an exact prefix filter: shingles are ordered by the documents that hold them, and
   two sets that are similar enough share one of their rarest
   ``n - ceil(share * n) + 1`` shingles.  The documents of one such shingle take
   the bucket's place in step 4, so documents that only share common text
   never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot, scratch
from .components import connected_components
from .kernels import SPACES, U, grams, mix, strings, words_of_rows

BANDS, ROWS = 32, 4
#: documents and shingles of a block, on average
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 20
#: documents of a bucket whose pairs are verified one by one
FEW = 12
#: documents outside a bucket's largest component beyond which only those that share a rare shingle meet
MANY = 1024
#: of 2T rounds for T up to 256
_ROUND = mix(np.arange(1, 513, dtype=U) * U(0xA24BAED4963EE407))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the rows' distinct k-word shingle hashes one after the other, and their counts.

    A row's hashes ascend; a row of fewer than k words has its whole sequence as one.
    """
    for i, j, h, _, _, first in words_of_rows(raw, offsets, SPACES):
        size = np.diff(first)
        row = np.repeat(np.arange(j - i), size)
        g = grams(h, k)
        inside = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
        values, owner = [g[inside]], [row[: len(g)][inside]]
        for r in np.flatnonzero((size > 0) & (size < k)).tolist():
            values.append(grams(h[first[r] : first[r + 1]], int(size[r])))
            owner.append(np.array([r]))
        values, owner = np.concatenate(values), np.concatenate(owner)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        if len(values):
            new = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
            values, owner = values[new], owner[new]
        yield i, values, np.bincount(owner, minlength=j - i)


def sketch(s: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """The t coordinates (a power of two) of a non-empty set of hashes."""
    out = np.full(t, np.iinfo(U).max, U)
    i, n = 0, len(s)
    while i < 2 * t:
        m = min(max(1, 2 * t // n), (t if i < t else 2 * t) - i)
        h = mix(s[None, :] + _ROUND[i : i + m, None])
        value = (h >> U(9)) | (np.arange(i, i + m, dtype=U) << U(55))[:, None]
        if i < t:
            np.minimum.at(out, (h & U(t - 1)).astype(np.int64).ravel(), value.ravel())
        else:
            np.minimum(out[i - t : i - t + m], value.min(axis=1), out=out[i - t : i - t + m])
        i += m
        if out.max() != np.iinfo(U).max:
            break
    return out


def sketches(values: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """``sketch`` of many sets at once: large ones one by one, the others round by round together."""
    out = np.full((len(counts), t), np.iinfo(U).max, U)
    cuts = np.concatenate(([0], np.cumsum(counts)))
    large = counts >= 4 * t
    for r in np.flatnonzero(large).tolist():
        out[r] = sketch(values[cuts[r] : cuts[r + 1]], t)
    owner = np.repeat(np.arange(len(counts)), counts)
    open_ = ~large[owner]
    values, owner = values[open_], owner[open_]
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values + _ROUND[i])
        value = (h >> U(9)) | (U(i) << U(55))
        cell = (h & U(t - 1)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + cell, value)
        if i % 4 == 3:  # sets without an empty bin are done
            open_ = (out == np.iinfo(U).max).any(axis=1)[owner]
            values, owner = values[open_], owner[open_]
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The band keys of each row of coordinates."""
    cells = sig.reshape(len(sig), bands, -1)
    key = np.arange(1, bands + 1, dtype=U) * U(0x9FB21C651E98DF25)
    for c in range(cells.shape[2]):
        key = mix(key + cells[:, :, c])
    return key


def _features(batches: Iterator[pa.RecordBatch], k: int, bands_n: int, rows_n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = strings(b.column(1))
        n, d1, d2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
        bands = np.zeros((b.num_rows, bands_n), np.int64)
        for i, values, counts in shingle_sets(raw, offsets, k):
            n[i : i + len(counts)] = counts
            some = np.flatnonzero(counts)
            if len(some):
                cuts = (np.cumsum(counts) - counts)[some]
                d1[i + some] = np.add.reduceat(mix(values + U(1)), cuts).astype(np.int64)
                d2[i + some] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), cuts).astype(np.int64)
                bands[i + some] = band_keys(sketches(values, counts[some], bands_n * rows_n), bands_n).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(np.where(n > 0, bands_n, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(at), pa.array(bands[n > 0].ravel()))], ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = strings(b.column(1))
        sets, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, values, counts in shingle_sets(raw, offsets, k):
            sets.append(values.astype(np.int64))
            sizes.append(counts)
        at = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], ["doc_id", "s"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect the same nodes: each one with the least that it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, low = None, np.arange(len(nodes))
    while root is None or (low != root).any():
        root, low = low, low.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[other]], nodes[other]


def _block_links(pdf: pd.DataFrame, share: int) -> pd.DataFrame:
    """Links that connect the different components of similar documents in one pair of blocks, fewer than there are components."""
    sizes = pdf["s"].map(len).to_numpy()
    comp, side = pdf["component"].to_numpy(), pdf["side"].to_numpy()
    doc = np.repeat(np.arange(len(pdf)), sizes)
    every = np.concatenate(list(pdf["s"]))
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    code = np.cumsum(new) - 1
    shared = np.bincount(code)[code] > 1
    code, doc = code[shared], doc[shared]
    both = np.zeros((len(pdf), len(pdf)), np.float32)
    if len(code):
        code = np.cumsum(np.concatenate(([True], code[1:] != code[:-1]))) - 1
        cuts = np.searchsorted(code, np.arange(0, code[-1] + 4097, 4096))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            m = np.zeros((len(pdf), 4096), np.float32)
            m[doc[lo:hi], code[lo:hi] % 4096] = 1
            both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    a, b = np.nonzero((100 * both >= share * union) & (comp[:, None] < comp[None, :]) & ((side[:, None] != side[None, :]) | (side.max() == 0)))
    a, b = _forest(comp[a], comp[b])
    return pd.DataFrame({"a": a, "b": b})


def _verified(pairs: DataFrame, sets: DataFrame, share: int, *more: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    pairs = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").where(F.size("sb") > 0)
    pairs = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    pairs = pairs.where((F.size("sa") * 100 >= F.size("sb") * share) & (F.size("sb") * 100 >= F.size("sa") * share))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * share).select("a", "b", *more)


def _mixed(named: DataFrame) -> DataFrame:
    """The buckets that hold several components, one of those with the same members.

    (bucket, n, main, others, rest, left): n documents, of which left lie
    outside the largest component main; others and rest are the numbers of
    blocks of main and of those left.
    """

    def blocks(docs: F.Column, shingles: F.Column) -> F.Column:
        return F.ceil(F.greatest(docs / BLOCK_DOCS, shingles / BLOCK_SHINGLES)).cast("int")

    who = F.sum(F.xxhash64("doc_id").cast("decimal(38,0)"))
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"), who.alias("who"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("m", "component", "w")).alias("main"), F.sum("m").alias("n"), F.sum("w").alias("w"), F.sum("who").alias("who"))
    left = F.col("n") - F.col("main.m")
    mixed = mixed.where(left > 0).select("who", "n", "bucket", F.col("main.component").alias("main"), blocks(F.col("main.m"), F.col("main.w")).alias("others"), blocks(left, F.col("w") - F.col("main.w")).alias("rest"), left.alias("left"))
    mixed = mixed.groupBy("who", "n").agg(F.min(F.struct("bucket", "main", "others", "rest", "left")).alias("of"))
    return scratch.save(mixed.select("n", "of.*"), "mixed")


def _links(named: DataFrame, mixed: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between the components that meet in a mixed bucket; ``named`` holds (bucket, doc_id, component, n_shingles)."""

    def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
        return _block_links(pdf, share)

    # a small bucket has at most FEW * (FEW - 1) / 2 pairs, which need no block
    few = named.join(mixed.where(F.col("n") <= FEW).select("bucket"), "bucket")
    near = few.select("bucket", F.col("doc_id").alias("a"), F.col("component").alias("ca")).join(few.select("bucket", F.col("doc_id").alias("b"), F.col("component").alias("cb")), "bucket")
    near = near.where("ca < cb").select("a", "b", "ca", "cb").distinct()
    near = _verified(near, sets, share, "ca", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    # blocks 0 to rest - 1 meet all blocks, the largest component's blocks behind them don't meet each other
    cells = hot.join(named, mixed.where(F.col("n") > FEW).withColumn("rows", F.col("n")), ["bucket"], "rows").withColumn("is_main", F.col("component") == F.col("main"))
    place = F.xxhash64("doc_id", "bucket")
    cells = cells.withColumn("own", F.when(F.col("is_main"), F.col("rest") + F.pmod(place, F.col("others"))).otherwise(F.pmod(place, F.col("rest"))).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rest")).otherwise(F.col("rest") + F.col("others")) - 1)))
    cells = cells.select("bucket", "doc_id", "component", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), (F.col("own") > F.col("o")).cast("int").alias("side"))
    one = sets.where(F.size("s") > 0)
    return cells.join(one, "doc_id").groupBy("bucket", "x", "y").applyInPandas(block_links, "a long, b long").unionByName(near).distinct()


def _rarest(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, share: int) -> Iterator[pa.RecordBatch]:
    """A row for each of a set's first ``n - ceil(share * n) + 1`` shingles: by hash, the ``frequent`` ones last and in their order."""
    by_value = np.argsort(frequent)
    known = frequent[by_value]
    for b in batches:
        sizes = b.column(2).value_lengths().to_numpy()
        values = b.column(2).flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(values), -1)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            rank = np.where(known[at] == values, by_value[at], -1)
        order = np.lexsort((values, rank, owner))
        nth = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        taken = order[nth < (sizes - (sizes * share + 99) // 100 + 1)[owner]]
        row = pa.array(owner[taken])
        yield pa.RecordBatch.from_arrays([pa.array(values[taken]), b.column(0).take(row), b.column(1).take(row), pa.array(sizes[owner[taken]].astype(np.int64))], ["bucket", "doc_id", "component", "n_shingles"])


def _by_rare_shingles(named: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(bucket, doc_id, component, n_shingles): the documents of ``named`` anew, in a bucket for each of their rarest shingles.

    Any two sets of ``named`` with ``100 * |A & B| >= share * |A | B|`` share a
    bucket: B holds ``share`` of A at least, and A of B, so in any one order of
    all shingles the first common one is among the first
    ``n - ceil(share * n) + 1`` of both.  The order is by hash, but shingles
    with a ``hot.MOST``-th of all occurrences come last, so they only make
    buckets of sets that consist of such shingles nearly alone.
    """
    docs = scratch.save(named.select("doc_id", "component").distinct().join(sets.where(F.size("s") > 0), "doc_id").select("doc_id", "component", "s"), "large")
    total = docs.agg(F.sum(F.size("s"))).first()[0] or 0
    held = docs.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("held"))
    # at most MOST of them
    frequent = held.where(F.col("held") >= max(hot.LEAST, -(-total // hot.MOST))).orderBy("held", "g").select("g").toPandas()["g"].to_numpy(np.int64)
    return docs.mapInArrow(partial(_rarest, frequent=frequent, share=share), "bucket long, doc_id long, component long, n_shingles long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 80, bands: int = BANDS, rows_a_band: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if ``100 * |A & B| >= share * |A | B|`` for their
    sets of distinct k-word shingles (A-Z lower-cased, words are runs of
    characters other than ASCII white space).  A text of fewer words than k is
    one shingle; a null, empty or blank text has the empty set and no link.
    component_id is the least doc_id reachable, kept says whether it is the
    row's own.  Rows with a null id are given back with a null component and
    are kept.  Repeated rows come back as often as they were given; rows of one
    id with different texts are judged text by text.  Other columns are
    ignored, so their names can't clash.
    """

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.save(docs.mapInArrow(partial(_features, k=k, bands_n=bands, rows_n=rows_a_band), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketches")
    full = rows.where("doc_id is not null and n_shingles > 0")
    least = full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    least = scratch.save(least, "distinct")
    # one row for each distinct set, under its least id
    reps = full.select("doc_id", "d1", "d2", "n_shingles", "bands").join(least.drop("rows"), ["doc_id", "d1", "d2", "n_shingles"], "left_semi")
    members = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    least_of = members.groupBy("bucket").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center < last").select("bucket", "center")
    members = scratch.save(members.join(least_of, "bucket"), "buckets")

    stars = members.where("doc_id > center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    ids = members.select("doc_id").distinct()
    wanted = docs.join(ids, "doc_id", "left_semi")
    sets = scratch.save(wanted.mapInArrow(partial(_sets, k=k), "doc_id long, s array<long>"), "sets")
    links = _verified(stars, sets, share)
    first = scratch.save(connected_components(links, "a", "b"), "components")

    named = members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"), "n_shingles")
    named = scratch.save(named.distinct(), "named")
    mixed = _mixed(named)
    across = _links(named, mixed.where(F.col("left") <= MANY), sets, share)
    large = mixed.where(F.col("left") > MANY).select("bucket", "n")
    if not large.isEmpty():
        rare = scratch.save(_by_rare_shingles(hot.join(named, large, ["bucket"], "n"), sets, share), "rare")
        across = across.unionByName(_links(rare, _mixed(rare), sets, share)).distinct()
    second = connected_components(across, "a", "b")
    final = first.select("node", "component").join(second.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    final = final.select("node", F.coalesce("least", "component").alias("component")).unionAll(second.join(first.select("node"), "node", "left_anti").select("node", "component"))

    by_set = least.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("d1", "d2", "n_shingles", "rows", F.coalesce("component", "doc_id").alias("component_id"))
    by_set = scratch.save(by_set, "classes")
    # a set that very many documents share meets them by broadcast; rows without a set have nothing to meet
    slim = rows.select("doc_id", "n_shingles", "d1", "d2")
    out = hot.join(slim.where("doc_id is not null and n_shingles > 0"), by_set, ["d1", "d2", "n_shingles"], "rows", "left")
    out = out.unionByName(slim.where("doc_id is null or n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
