"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
#: What goes to a Python worker at once, and what it makes lists of at once. A longer text goes by itself.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_FOLDERS: list[str] = []  # in the order they were made


def new_folder(spark: SparkSession, label: str) -> str:
    _FOLDERS.append(path := f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return path


def folders() -> int:
    """How many folders this process has in the shared folder: where a later release() may begin."""
    return len(_FOLDERS)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes what this process wrote to the shared folder (or the folders since and until a count), once no result that reads it is needed any more."""
    jvm = spark.sparkContext._jvm
    for path in _FOLDERS[since:until]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _FOLDERS[since:until]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def to_python(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends batches of BATCH_BYTES and BATCH_ROWS at most to Python (unless it has lower limits): with
    Spark's own limits, a task holds tens of MB of texts on both sides."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices that hold BATCH_BYTES of the column's text at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Remembered(dict):
    """What made(key) gives for the last keys asked for: LIMIT to 2 * LIMIT of them, those in use again and again always among them.

    A worker process keeps it from task to task, until a task of another operator begins.
    """

    LIMIT = 1 << 16
    OPERATOR = ""
    _every: ClassVar[list] = []

    def __init__(self) -> None:
        self.older: dict = {}
        Remembered._every.append(weakref.ref(self))

    def made(self, key):
        raise NotImplementedError

    def release(self) -> None:
        self.clear()
        self.older = {}

    @staticmethod
    def begin(operator: str) -> None:
        """Releases what other operators remember in this process."""
        Remembered._every[:] = [r for r in Remembered._every if r() is not None]
        for other in [r() for r in Remembered._every]:
            if other is not None and other.OPERATOR != operator and (other or other.older):
                other.release()

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df is called so: columns that an operator adds for itself."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list[Column]:
    """Columns by their exact names, dots and back-ticks included."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def map_texts(docs: DataFrame, kept: list[str], text: str, made: list[T.StructField], make: Callable[[list[str | None]], list[pa.Array]], operator: str = "") -> DataFrame:
    """kept's columns of all rows, and the columns that make gives for the texts of each slice."""
    own = docs.select(*quoted(*kept))
    if text in kept and own.schema[text].dataType == T.StringType():
        rows, at = own, kept.index(text)
    else:
        rows, at = docs.select(*quoted(*kept), *[c.cast("string").alias(n) for c, n in zip(quoted(text), unused(own, "text"), strict=True)]), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.begin(operator)
        for batch in slices(batches, at):
            columns = [*(batch.column(k) for k in range(len(kept))), *make(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *(f.name for f in made)])

    return to_python(rows).mapInArrow(run, T.StructType([*own.schema.fields, *made]))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(column: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII white spaces."""
    return F.size(F.filter(F.split(column, WORD_SEPARATORS), lambda w: w != "")).cast("long")


PER_BLOCK = 4_096


def sums_before(cells: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """cells (a row for each by and at) with name, the sum of value over the rows of by with a smaller at.

    Windows run inside blocks of PER_BLOCK values of at; what a task orders as a whole is one row for each block.
    """
    [block, total] = unused(cells, "block", "total")
    cells = cells.withColumn(block, F.floor(F.col(at) / PER_BLOCK))
    up_to = lambda order, *keys: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = cells.groupBy(*by, block).agg(F.sum(value).alias(total))
    blocks = blocks.withColumn(total, F.sum(total).over(up_to(block, *by)) - F.col(total))
    inside = F.sum(value).over(up_to(at, *by, block)) - F.col(value)
    return cells.withColumn(name, inside).join(blocks, [*by, block]).withColumn(name, F.col(name) + F.col(total)).drop(block, total)
