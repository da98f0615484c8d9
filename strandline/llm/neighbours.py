"""Approximate nearest neighbours by largest inner product, with randomly rotated one-bit codes.

Index, a table in the shared folder. Vectors are dealt into cells around centroids. Of each, what remains beside its
centroid is scaled to length one, rotated at random, and kept as one sign bit a dimension, packed in 64-bit words, with
correction scalars: its length by its inner product with its code, and how far the estimate may be off.

Search. A query visits the cells whose centroids promise most. There its rotated components are quantised to PLANES
bits, and AND and bit counts of these planes and a vector's packed code give, with the scalars, an estimate of the inner
product and an error bound. Only vectors whose upper bound reaches the query's floor, its k-th best score in the sample,
are measured on the original vectors. A query that finds fewer than k that way is measured against every vector, in the
same blocks, so that each returns k. In a block of some hundred queries nearly every vector is measured by one of them,
so it travels beside its code.

Fitted on SAMPLE vectors at most (those of the smallest id hashes): centroids, and how many cells a query visits, such
that a share RECALL of the sample's true neighbours lies in them. Every vector is indexed. Cells are processed in blocks
of vectors and queries, so neither a large cell nor many copies of one vector meet in one task; of the best k of each
block, a window keeps k in each task before they are shuffled.

Defined results: a vector that is null, empty, zero, of another length than most, or has a null or non-finite component
neither asks nor answers; a null id doesn't either; repeated rows answer as often as they stand, but never a query of
their own id, and ask once (with the smallest vector); ties go to the smaller vec_id; with k candidates or fewer all are
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, to_python

K = 20
SAMPLE = 16_384
SAMPLE_QUERIES = 512
RECALL = 0.99
VECTORS_PER_CELL = 4_096
MAX_CELLS = 1_024
BLOCK = 8_192
QUERIES_PER_BLOCK = 1_024
#: Bounds are so many standard deviations of the estimate wide; 99 of 100 neighbours lie within.
EPSILON = 2.4
#: Bits of a query's quantised components.
PLANES = 4
#: For rounding of single-precision bounds.
SLACK = 1e-4


class Plan:
    """What is fitted: rotation, centroids, cells to visit."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        rng = np.random.default_rng(11)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        cells = int(max(1, min(MAX_CELLS, n // VECTORS_PER_CELL, len(sample) // 16)))
        self.centroids = _k_means(sample, cells, rng)
        self.visits = self._visits(sample, rng)
        self.sample = sample.astype(np.float32)

    def _visits(self, sample: np.ndarray, rng: np.random.Generator) -> int:
        cells = len(self.centroids)
        if cells == 1:
            return 1
        asked = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
        scores = sample[asked] @ sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        best = np.argsort(-scores, axis=1)[:, :K]
        rank = np.argsort(np.argsort(-(sample[asked] @ self.centroids.T), axis=1), axis=1)
        needed = np.take_along_axis(rank, self.cell_of(sample)[best], axis=1).ravel()
        return int(np.quantile(needed, RECALL)) + 1

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmin((self.centroids**2).sum(axis=1) - 2 * part @ self.centroids.T, axis=1) for part in np.array_split(x, max(1, len(x) // 8192))]) if len(x) else np.empty(0, int)

    def floors(self, q: np.ndarray, k: int) -> np.ndarray:
        """What each query's k-th best score can't be below: its k-th best in the sample, itself aside."""
        if len(self.sample) <= k:
            return np.full(len(q), -np.inf)
        parts = np.array_split(q.astype(np.float32), max(1, len(q) // 256))
        return np.concatenate([-np.partition(-(p @ self.sample.T), k, axis=1)[:, k] for p in parts]).astype(float)

    def visited(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : self.visits]


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(10 if k > 1 else 1):
        near = np.argmin((centroids**2).sum(axis=1) - 2 * x @ centroids.T, axis=1)
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), bool)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


class Codes:
    """One-bit codes of vectors around a centroid, with what corrects their inner products."""

    def __init__(self, bits: np.ndarray, factor: np.ndarray, error: np.ndarray) -> None:
        self.bits, self.factor, self.error = bits, factor, error
        self.ones = np.bitwise_count(bits).sum(axis=1).astype(np.float32)

    @staticmethod
    def of(vectors: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> Codes:
        """centroid: one, or one for each vector."""
        d = vectors.shape[1]
        rest = vectors - centroid
        length = np.linalg.norm(rest, axis=1)
        turned = rest @ rotation / np.maximum(length, 1e-12)[:, None]
        share = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(d), 1e-6)  # <code, vector>
        # What one unit of <query, code> stands for, and how far, for a query of length one, the estimate may be off.
        factor = (length / share / np.sqrt(d)).astype(np.float32)
        error = (EPSILON * length * np.sqrt(np.maximum(1 - share**2, 0)) / share / np.sqrt(max(d - 1, 1))).astype(np.float32)
        return Codes(_packed(turned > 0), factor, error)

    def bounds(self, queries: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of inner products, queries x vectors, and the errors within: the estimate is upper minus error."""
        turned = (queries @ rotation).astype(np.float32)
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-12) / ((1 << PLANES) - 1)
        level = np.rint((turned - low) / step).astype(np.uint8)
        kind = np.uint16 if turned.shape[1] << PLANES < 1 << 16 else np.uint32
        counted = np.zeros((len(queries), len(self.bits)), kind)
        for j in range(PLANES):
            plane = _packed((level >> j & 1).astype(bool))
            for w in range(self.bits.shape[1]):
                counted += np.bitwise_count(plane[:, w, None] & self.bits[None, :, w]).astype(kind) << j
        # <quantised query, code> = 2 <it, ones> - its sum, where <it, ones> = low * ones + step * counted.
        product = counted * (2 * step)
        product += 2 * low * self.ones
        product -= low * turned.shape[1] + step * level.sum(axis=1, keepdims=True, dtype=np.float32)
        norm = np.linalg.norm(queries, axis=1, keepdims=True).astype(np.float32)
        rounding = EPSILON * step * np.sqrt(turned.shape[1] / 12)
        error = norm * self.error + rounding * self.factor
        return (queries @ centroid)[:, None].astype(np.float32) + product * self.factor + error, error


def _best(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes, centroid: np.ndarray, rotation: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block for each query, among those that reach the query's floor. A query with the floor -inf is measured against all."""
    out = []
    for start in range(0, len(queries), 128):
        part = slice(start, start + 128)
        q, qi = queries[part], query_ids[part]
        floor = floors[part, None] - SLACK
        if np.isneginf(floor).any():
            upper = np.where(ids[None, :] != qi[:, None], q @ vectors.T, -np.inf)
            at = min(k, upper.shape[1]) - 1
            floor = np.where(np.isneginf(floor), -np.partition(-upper, at, axis=1)[:, at, None] - SLACK, floor)
        else:
            upper, floor = codes.bounds(q, centroid, rotation)[0], floor.astype(np.float32)
        rows, cols = np.nonzero(upper >= floor)
        exact = np.empty(len(rows))
        for a in range(0, len(rows), 16_384):
            b = slice(a, a + 16_384)
            exact[b] = (q[rows[b]] * vectors[cols[b]]).sum(axis=1)
        good = (exact >= floors[part][rows] - SLACK) & (ids[cols] != qi[rows])
        rows, cols, exact = rows[good], cols[good], exact[good]
        order = np.lexsort((ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append(pd.DataFrame({"query_id": qi[rows[top]], "vec_id": ids[cols[top]], "score": exact[top]}))
    return pd.concat(out)


def _search(indexed: DataFrame, held: DataFrame, asked: DataFrame, shipped, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every block of the cells that asked (query_id, v, floor, cell) names."""
    wanted = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).alias("q_blocks"))
    blocks = F.broadcast(held.join(wanted, "cell"))
    numbers = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))
    left = indexed.join(blocks, "cell").withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("v_blocks"))).withColumn("qb", numbers("q_blocks"))
    right = asked.join(blocks, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q_blocks"))).withColumn("vb", numbers("v_blocks"))

    def search(key, vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        p = shipped.value
        bits = np.frombuffer(b"".join(vs["code"]), np.uint64).reshape(len(vs), -1)
        codes = Codes(bits, vs["factor"].to_numpy(np.float32), vs["error"].to_numpy(np.float32))
        return _best(qs["query_id"].to_numpy(), np.stack(qs["v"].to_numpy()), qs["floor"].to_numpy(), vs["vec_id"].to_numpy(), np.stack(vs["v"].to_numpy()), codes, p.centroids[int(key[0])], p.rotation, k)

    by = ("cell", "vb", "qb")
    groups = left.select(*by, "vec_id", "v", "code", "factor", "error").groupBy(*by).cogroup(right.select(*by, "query_id", "v", "floor").groupBy(*by))
    return groups.applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == lengths["d"])
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    plan = Plan(np.array([r["v"] for r in chosen]), lengths["count"])
    shipped = spark.sparkContext.broadcast(plan)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            cell = p.cell_of(v)
            codes = Codes.of(v, p.centroids[cell], p.rotation)
            columns = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes.bits], pa.binary()), pa.array(codes.factor), pa.array(codes.error)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["vec_id", "v", "cell", "code", "factor", "error"])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visited(x: pd.Series) -> pd.Series:
        return pd.Series(list(shipped.value.visited(np.stack(x.to_numpy())).astype(np.int32))) if len(x) else pd.Series([], dtype=object)

    @F.pandas_udf(T.DoubleType())
    def floor_of(x: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.floors(np.stack(x.to_numpy()), k)) if len(x) else pd.Series([], dtype=float)

    indexed = materialize(to_python(rows).mapInArrow(index, "vec_id long, v array<double>, cell int, code binary, factor float, error float"), "vectors")
    held = materialize(indexed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("v_blocks")), "cells")  # MAX_CELLS rows at most
    asked = materialize(indexed.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).select("query_id", "v", floor_of("v").alias("floor"), visited("v").alias("cells")), "queries")
    found = materialize(_search(indexed, held, asked.select("query_id", "v", "floor", F.explode("cells").alias("cell")), shipped, k), "found")
    # A query that found fewer than k (a neighbour lay in a cell not visited, or an estimate missed) is measured against every vector.
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = materialize(asked.join(enough, "query_id", "left_anti").select("query_id", "v", F.lit(float("-inf")).alias("floor")), "short")
    if not short.isEmpty():
        cells = F.array(*[F.lit(r["cell"]) for r in held.select("cell").collect()])
        every = short.withColumn("cell", F.explode(cells))
        found = found.join(short.select("query_id"), "query_id", "left_anti").union(_search(indexed, held, every, shipped, k))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # a limit by rank keeps k of a query in each task before the shuffle
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
