"""Approximate nearest neighbours by a forest of random-projection trees.

The forest (Dasgupta and Freund 2008) is fitted on a bounded sample: each node
splits at the median of a projection on the line between two sampled points.
Every vector is routed to one leaf of each tree.  A query walks all trees
through one priority queue: leaves are visited in the order of their penalty,
the squared margins by which the path departs from the query's side, whichever
tree they belong to, until the visited leaves hold the wanted share of rows.
The rows of visited leaves are reranked by the exact cosine.

The share is calibrated: for at most ``CALIBRATION`` queries the true
neighbours are found by brute force, which shows how far the queue must be
followed; vectors with little structure need a large share, others a small one.

Leaves are joined with their visits by key; large leaves and long visit lists
are cut into chunks of bounded size, so no task holds a whole leaf.  Equal
vectors have equal scores, and ties go to the smaller id, so of each distinct
vector only the k + 1 least ids can appear in a result: hot vectors shrink to
these before anything else, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

TREES, DEPTH, LEAF = 8, 8, 64
SAMPLE = 16_384
CALIBRATION = 64
ROWS, QUERIES = 4096, 1024


class Forest:
    """Complete binary trees in heap order; leaf cells are numbered through all trees."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        inner = 2**depth - 1
        self.lines = np.zeros((trees, inner, sample.shape[1]))
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(inner):
                own = held.pop(node)
                line = rng.standard_normal(sample.shape[1])
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    line = a - b if np.any(a != b) else line
                line /= np.linalg.norm(line)
                at = sample[own] @ line
                cut = float(np.median(at)) if len(own) else 0.0
                self.lines[t, node], self.cuts[t, node] = line, cut
                held[2 * node + 1], held[2 * node + 2] = own[at <= cut], own[at > cut]

    @property
    def cells(self) -> int:
        return self.trees * 2**self.depth

    def route(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row in each tree."""
        out = np.empty((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.lines[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + right
            out[:, t] = node - (2**self.depth - 1) + t * 2**self.depth
        return out

    def penalties(self, q: np.ndarray) -> np.ndarray:
        """Of each query and cell: the sum of squared margins crossed on the way."""
        out = []
        for t in range(self.trees):
            margin = q @ self.lines[t].T - self.cuts[t]
            cost, nodes = np.zeros((len(q), 1)), np.array([0])
            for _ in range(self.depth):
                m = margin[:, nodes]
                left, right = cost + np.where(m > 0, m * m, 0), cost + np.where(m > 0, 0, m * m)
                cost = np.stack([left, right], axis=2).reshape(len(q), -1)
                nodes = np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1).ravel()
            out.append(cost)
        return np.concatenate(out, axis=1)

    def visits(self, q: np.ndarray, counts: np.ndarray, rows: float) -> list[np.ndarray]:
        """Cells each query visits, best first, until they hold ``rows`` rows."""
        order = np.argsort(self.penalties(q), axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        return [o[(b < rows) & (counts[o] > 0)] for o, b in zip(order, before, strict=True)]


def _matrix(column) -> np.ndarray:
    """Rows scaled by a power of two to a largest component of about 1: exact, and no square under- or overflows."""
    if not len(column):
        return np.zeros((0, 1))
    x = np.array([np.frombuffer(x, "<f8") for x in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None] if len(x) else x


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k nearest rows, by score, then id.

    A matrix product finds who can be among the k; their scores are computed
    again one by one, so that equal vectors get equal scores wherever they are.
    """
    near = _units(q) @ _units(x).T
    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
    a, b = np.nonzero(near >= least[:, None] - 1e-9)
    score = (q[a] * x[b]).sum(axis=1) / (np.sqrt((q[a] * q[a]).sum(axis=1)) * np.sqrt((x[b] * x[b]).sum(axis=1)))
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], ids[b[rank < k]], score[rank < k]


def _is_usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", wanted_recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row whose id is divisible by ``every``.

    score is the cosine in double precision; ties go to the smaller id.  Null
    ids, null and zero vectors and vectors with null or non-finite components
    take no part.  Vectors of different lengths have no cosine, so each length
    is searched on its own.  Rows that repeat an id count as that id's row and
    never answer its own query; if they differ, an id may have hits of each.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch.small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & _is_usable(F.col("v")))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    found = [_nearest(rows.where(F.size("v") == d), d, k, every, wanted_recall) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


FOUND = "query_id long, rank int, vec_id long, score double"


def _nearest(rows: DataFrame, length: int, k: int, every: int, wanted_recall: float) -> DataFrame:
    """``nearest`` among usable vectors of one length."""
    spark = rows.sparkSession
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    index = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("r", F.row_number().over(same)).where(f"r <= {k + 1}").drop("r")

    def binary(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            flat = np.asarray(b.column(1).flatten(), "<f8").reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in flat], pa.binary()), b.column(2), b.column(3)], ["vec_id", "v", "h1", "h2"])

    index = scratch.save(index.mapInArrow(binary, "vec_id long, v binary, h1 long, h2 long"), "vectors")
    n = index.count()
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2")
    queries = asked.select("h1", "h2").distinct().join(index.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v"), ["h1", "h2"])
    queries = scratch.save(queries.withColumn("q", F.xxhash64("h1", "h2")), "queries")
    m = queries.count()
    if not m:
        return spark.createDataFrame([], FOUND)

    share = min(1.0, SAMPLE / n)
    sample = index.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)).select("v").toPandas()
    depth = max(0, min(DEPTH, (n // LEAF).bit_length() - 1)) if len(sample) > 1 else 0
    forest = Forest(_units(_matrix(sample["v"])) if len(sample) else np.zeros((0, length)), TREES if depth else 1, depth)
    shared = spark.sparkContext.broadcast(forest)

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in parts:
            if not b.num_rows:
                continue
            cells = f.route(_units(_matrix(b.column(1).to_pylist())))
            doc = pa.array(np.repeat(np.arange(b.num_rows), f.trees))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), b.column(0).take(doc), b.column(1).take(doc)], ["cell", "vec_id", "v"])

    leaves = index.select("vec_id", "v").mapInArrow(route, "cell int, vec_id long, v binary")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.cells, np.int64)
        for b in parts:
            if b.num_rows:
                total += np.bincount(shared.value.route(_units(_matrix(b.column(0).to_pylist()))).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["cell", "n"])

    counts = np.zeros(forest.cells, np.int64)
    for cell, c in index.select("v").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = c
    # every tree holds each row once, so this many rows of leaves are k + 2 different ones at least
    wanted = max(_calibrated(spark, index, queries, m, forest, counts, k, wanted_recall) * n, forest.trees * (k + 2))

    def visit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cells = shared.value.visits(_units(_matrix(part.column(1).to_pylist())), counts, wanted)
                doc = pa.array(np.repeat(np.arange(part.num_rows), [len(c) for c in cells]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).astype(np.int32)), part.column(0).take(doc), part.column(1).take(doc)], ["cell", "q", "qv"])

    visits = queries.select("q", "v").mapInArrow(visit, "cell int, q long, qv binary")
    # chunks of bounded size; this table has a row for each leaf of the forest
    sizes = spark.createDataFrame([(i, int(max(1, -(-c // ROWS)))) for i, c in enumerate(counts)], "cell int, row_chunks int")
    query_chunks = max(1, -(-m // QUERIES))
    left = leaves.join(F.broadcast(sizes), "cell").withColumn("x", F.pmod(F.xxhash64("vec_id"), F.col("row_chunks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(query_chunks - 1))))
    right = visits.join(F.broadcast(sizes), "cell").withColumn("y", F.pmod(F.col("q"), F.lit(query_chunks)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("row_chunks") - 1)))

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        who, ids, score = best(_matrix(b["qv"]), _matrix(a["v"]), a["vec_id"].to_numpy(), k + 1)
        return pd.DataFrame({"q": b["q"].to_numpy()[who], "vec_id": ids, "score": score})

    found = left.select("cell", "x", "y", "vec_id", "v").groupBy("cell", "x", "y").cogroup(right.select("cell", "x", "y", "q", "qv").groupBy("cell", "x", "y")).applyInPandas(rerank, "q long, vec_id long, score double")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    out = asked.select("vec_id", F.xxhash64("h1", "h2").alias("q")).distinct().join(found, "q")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.withColumnRenamed("vec_id", "query_id").select("query_id", F.posexplode(others).alias("p", "hit"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _calibrated(spark, index: DataFrame, queries: DataFrame, m: int, forest: Forest, counts: np.ndarray, k: int, recall: float) -> float:
    """The share of rows to visit for the wanted recall, measured on at most CALIBRATION queries."""
    if forest.depth == 0:
        return 1.0
    some = queries.orderBy(F.xxhash64("q", F.lit("calibration"))).limit(CALIBRATION).select("q", "v").toPandas()
    q = _matrix(some["v"])
    shared = spark.sparkContext.broadcast(q)

    def brute(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                x = _matrix(part.column(1).to_pylist())
                who, at, score = best(shared.value, x, np.arange(len(x)), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(score)], ["i", "vec_id", "v", "score"])

    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    true = index.select("vec_id", "v").mapInArrow(brute, "i int, vec_id long, v binary, score double").withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}").toPandas()
    cells = forest.route(_units(_matrix(true["v"])))
    ranked = np.argsort(forest.penalties(_units(q)), axis=1, kind="stable")
    before = np.zeros_like(ranked)
    np.put_along_axis(before, ranked, np.cumsum(counts[ranked], axis=1) - counts[ranked], axis=1)
    needed = before[true["i"].to_numpy()[:, None], cells].min(axis=1)
    needed = np.sort(needed[true["score"].to_numpy() < 1 - 1e-12]) if (true["score"] < 1 - 1e-12).any() else np.array([0])
    at = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]
    return float(at + 1) / max(1, counts.sum() / forest.trees)
