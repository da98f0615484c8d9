"""Sums of products over wide panels, by blocks of rows and tiles of columns, as numpy matrix products in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 64 << 20
SMALL_BYTES = 32 << 20
WIDE = 1_000


def packed(panel: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """keep's columns and v, the features' values: what comes after has a few columns, however wide the panel is."""
    cast = lambda f: "CAST(`" + f.replace("`", "``") + "` AS DOUBLE)"
    return panel.select(*keep, F.expr(f"array({', '.join(map(cast, features))})").alias("v"))  # as text: thousands of column objects take minutes


@contextmanager
def _plain_code(rows: DataFrame, d: int) -> Iterator[None]:
    """Compiling one loop over thousands of columns takes time quadratic in them; without whole-stage code it is split into functions."""
    key, conf = "spark.sql.codegen.wholeStage", rows.sparkSession.conf
    before = conf.get(key)
    if d > WIDE:
        conf.set(key, "false")
    try:
        yield
    finally:
        conf.set(key, before)


def _first(x: np.ndarray) -> np.ndarray:
    """Of each column its first value that is there: subtracted before products are summed, so that large means cost no digits."""
    there = np.isfinite(x)
    return np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0) if len(x) else np.zeros(x.shape[1])


def _matrix(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column("label").to_numpy(), values.astype(float).reshape(table.num_rows, d)


def head(rows: DataFrame, label: Column, d: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Labels and values of rows of SMALL_BYTES at most, and whether these are all."""
    most = max(1, SMALL_BYTES // (8 * d))
    with _plain_code(rows, d):
        held = rows.select(label.cast("int").alias("label"), "v").limit(most + 1).toArrow()
    return *_matrix(held, d), held.num_rows <= most


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(label of each row, rows x d with NaN for NULL), CHUNK_BYTES at most at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    most = max(1, CHUNK_BYTES // (8 * max(d, 1)))
    joined = lambda: (np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held]))
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(1).flatten()
        held.append((batch.column(0).to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)))
        if sum(len(h[0]) for h in held) >= most:
            yield joined()
            held = []
    if held:
        yield joined()


def summed(rows: DataFrame, label: Column, d: int, tiles: int, partial: Callable[[np.ndarray, np.ndarray, Iterable[int]], Iterator[tuple[int, int, np.ndarray]]], final: Callable[[int, Iterator[tuple[int, np.ndarray]]], Iterator[tuple]], names: list[str], types: list[pa.DataType], schema: str) -> tuple[DataFrame, np.ndarray]:
    """rows have v, of d entries. partial(labels, rows, tiles) gives (tile, kind, sums) of a block of rows; final(tile, (kind, sums) of all blocks) gives the result's rows.
    Entries come to partial less a value for each of the d, which is returned beside the result.

    Rows of SMALL_BYTES at most, which is checked, are broadcast, and tiles are the tasks: nothing is shuffled, however many columns there are. Of
    more rows each task sums its blocks, and a tile's sums are read one by one, in one task, which holds one tile at a time.
    """
    rows = rows.select(label.cast("int").alias("label"), "v")
    spark = rows.sparkSession

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    labels, x, whole = head(rows, F.col("label"), d)
    shift = _first(x)
    if whole:
        shipped = spark.sparkContext.broadcast((labels, x - shift))

        def made_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels, x = shipped.value
            for b in batches:
                for tile in b.column(0).to_pylist():
                    yield batch(list(final(tile, ((k, s) for _, k, s in partial(labels, x, [tile])))) if len(x) else [])

        return spark.range(0, tiles, 1, max(1, min(tiles, 2 * spark.sparkContext.defaultParallelism))).mapInArrow(made_of_all, schema), shift

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, x in _chunks(batches, d):
            for tile, kind, sums in partial(labels, x - shift, range(tiles)):
                yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([kind], pa.int32()), pa.array([sums.astype(float).tobytes()], pa.binary())], ["tile", "kind", "sums"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((t, k, np.frombuffer(s)) for b in batches for t, k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (v.as_py() for v in b.column(2)), strict=True))
        for tile, group in groupby(each, key=lambda e: e[0]):
            yield batch(list(final(tile, ((k, s) for _, k, s in group))))

    partials = rows.mapInArrow(made, "tile int, kind int, sums binary")
    return partials.repartition("tile").sortWithinPartitions("tile").mapInArrow(combined, schema), shift
