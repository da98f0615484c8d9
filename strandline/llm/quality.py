"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors. Every word has a fixed sparse index vector (NONZERO entries of +1 or -1 among DIMENSIONS, from its hash),
and its context vector is the sum of its neighbours' index vectors over the whole corpus. Words are hashed to WORDS
rows; a word's outline (letters as x or X, digits as 9, runs collapsed; or that it repeats the word before) is a second
vocabulary of SHAPES rows with context vectors of its own. All sums are integers, so they don't depend on the order in
which tasks end. The table's size is fixed by these parameters.

Documents. The unit context vectors of a text's words and outlines are averaged, and so are the squares of the
outlines' (their spread), with the logarithm of the word count.

Network. One hidden layer of tanh, trained by Adam on SAMPLE labelled rows at most (those of the smallest id hashes; the
one bounded step; of several rows with one id the one of the smallest hash), then temperature scaling on every CALIBRATION-th of them, which the training didn't see.

Defined results: a null, empty or blank text has the zero vector and gets its score like others; labels that are null
are not used, of several for one doc_id the mean decides (0.5 and more is 1); without labels, or of one value only, the
score is the share of ones (1.0 without any); repeated rows count as often as they stand in the vectors; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, id_remainder, map_texts, quoted, slices, to_python, unused

WORDS, SHAPES, DIMENSIONS, NONZERO = 1 << 14, 1 << 10, 32, 2
ROWS = WORDS + SHAPES
REPEATED = 0
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
SAMPLE = 20_000
CALIBRATION = 5
THRESHOLD = 0.3
SCORE = "__score"
#: Characters pooled at once; a longer text is pooled by itself.
POOL_CHARS = 1 << 17
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUNS = re.compile(r"(.)\1+")


def outline(word: str) -> str:
    word = _LETTERS.sub(lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "x", word)
    return _RUNS.sub(r"\1", _DIGITS.sub("9", word))[:12]


class _Codes(Remembered):
    """word -> its row times SHAPES plus its outline's row."""

    OPERATOR = "quality"

    def __init__(self) -> None:
        super().__init__()
        self.shapes = _Shapes()

    def made(self, word: str) -> int:
        body, last = (word, "") if word.isalpha() else (word[:-1], word[-1])
        # Letters, or letters and one mark, are most words; the others take the general way.
        plain = body.isalpha() and not last.isalnum() and last != "_"
        shape = ("X" if len(body) > 1 and body.isupper() else "x") + last if plain else outline(word)
        return xxhash.xxh3_64_intdigest(word.lower()) % WORDS * SHAPES + self.shapes[shape]


class _Shapes(Remembered):
    LIMIT, OPERATOR = 1 << 12, "quality"

    def made(self, shape: str) -> int:
        return 1 + xxhash.xxh3_64_intdigest(shape) % (SHAPES - 1)


#: One for each worker process, which its tasks share.
_CODES = _Codes()


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    places = np.argsort(rng.random((ROWS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


def rows_of(texts: list[str | None], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words in the word table, of their outlines in the outline table, and the number of words of each text."""
    words = [(t or "").split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    word, shape = code // SHAPES, code % SHAPES
    again = np.zeros(len(code), bool)
    again[1:] = word[1:] == word[:-1]
    again[(np.cumsum(counts) - counts)[counts > 0]] = False
    return word, np.where(again, REPEATED, shape), counts


def _pieces(texts: list[str | None], chars: int) -> Iterator[slice]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > chars and i > start:
            yield slice(start, i)
            start, size = i, len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Remembered.begin("quality")
    places, signs = _index_vectors()
    # Words: counts of (word, entry, sign) of the neighbours. Outlines are few: counts of neighbouring pairs, multiplied out at the end.
    cell = places * 2 + (signs > 0)
    counts_of, pairs = np.zeros(WORDS * DIMENSIONS * 2, np.int64), np.zeros(SHAPES * SHAPES, np.int64)
    for batch in slices(batches, 0):
        word, shape, counts = rows_of(batch.column(0).to_pylist(), _CODES)
        ends = np.cumsum(counts)
        joined = np.ones(max(len(word) - 1, 0), bool)
        joined[ends[(ends > 0) & (ends < len(word))] - 1] = False
        left, right = word[:-1][joined], word[1:][joined]
        for me, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                counts_of += np.bincount(me * (2 * DIMENSIONS) + cell[other, k], minlength=len(counts_of))
        pairs += np.bincount(shape[:-1][joined] * SHAPES + shape[1:][joined], minlength=len(pairs))
    split = counts_of.reshape(WORDS, DIMENSIONS, 2)
    index, square = np.zeros((SHAPES, DIMENSIONS), np.int64), pairs.reshape(SHAPES, SHAPES)
    np.put_along_axis(index, places[WORDS:], signs[WORDS:].astype(np.int64), axis=1)
    total = np.vstack([split[:, :, 1] - split[:, :, 0], (square + square.T) @ index])
    at = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in np.ascontiguousarray(total[at].T))], ["row", *(f"c{k}" for k in range(DIMENSIONS))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors, ROWS x DIMENSIONS, from all rows of docs. Tasks send at most ROWS partial sums each."""
    names = [f"c{k}" for k in range(DIMENSIONS)]
    partial = to_python(docs.select(F.col(text).cast("string").alias("text"))).mapInArrow(_contexts, "row int, " + ", ".join(f"{c} long" for c in names))
    table = np.zeros((ROWS, DIMENSIONS), np.float32)
    for r in partial.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toLocalIterator():
        v = np.array(r[1:], float)
        table[r[0]] = v / max(np.linalg.norm(v), 1e-9)
    return table


def pooled(texts: list[str | None], vectors: np.ndarray, codes: _Codes) -> np.ndarray:
    """A row for each text: mean word vector, mean and mean square of outline vectors, logarithm of the number of words."""
    out, outlines = np.zeros((len(texts), 3 * DIMENSIONS + 1), np.float32), vectors[WORDS:]
    for piece in _pieces(texts, POOL_CHARS):
        word, shape, counts = rows_of(texts[piece], codes)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        n = counts[full]
        of = np.repeat(np.arange(len(full)), n)
        histogram = np.bincount(of * SHAPES + shape, minlength=len(full) * SHAPES).reshape(len(full), SHAPES).astype(np.float32)
        sums = [np.add.reduceat(vectors[word], np.cumsum(n) - n, axis=0), histogram @ outlines, histogram @ (outlines * outlines)]
        out[piece][full] = np.hstack([*(s / n[:, None] for s in sums), np.log1p(n)[:, None]])
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def gradients(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float, x: np.ndarray, y: np.ndarray) -> list:
    """Of the mean logistic loss and DECAY / 2 times the weights' squares, by w1, b1, w2 and b2."""
    h = np.tanh(x @ w1 + b1)
    error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - y) / len(y)
    back = error[:, None] * w2 * (1 - h * h)
    return [x.T @ back + DECAY * w1, back.sum(axis=0), h.T @ error + DECAY * w2, error.sum()]


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """x and y in a fixed order: the result depends on nothing else."""
    x, y = x.astype(float), y.astype(float)
    share, d = (float(y.mean()) if len(y) else 1.0), x.shape[1] if len(y) else 3 * DIMENSIONS + 1
    if share in (0.0, 1.0):
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 60.0 * (2 * share - 1), 1.0)
    held = np.arange(len(y)) % CALIBRATION == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    rng = np.random.default_rng(7)
    net = Network(mean, scale, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(share / (1 - share))), 1.0)
    xs, ys = (x[~held] - mean) / scale, y[~held]
    state, step = [(0.0, 0.0)] * 4, 0
    for _ in range(EPOCHS if len(ys) > 2000 else 3 * EPOCHS):
        order = rng.permutation(len(ys))
        for i in range(0, len(order), BATCH):
            xb, yb = xs[order[i : i + BATCH]], ys[order[i : i + BATCH]]
            step += 1
            values = [net.w1, net.b1, net.w2, net.b2]
            for k, g in enumerate(gradients(*values, xb, yb)):
                m, v = 0.9 * state[k][0] + 0.1 * g, 0.999 * state[k][1] + 0.001 * g * g
                state[k] = m, v
                values[k] = values[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.w1, net.b1, net.w2, net.b2 = values
    if held.any():
        z, t = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        loss = [np.mean(np.logaddexp(0, z / s) - t * z / s) for s in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, text) of SAMPLE labelled documents at most, those outside the held-out fifth of the smallest id hashes."""
    by_id = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    by_id = by_id.filter(id_remainder("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(by_id), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)
    make = lambda texts: [pa.array([r.tobytes() for r in pooled(texts, shipped.value, _CODES)], pa.binary())]
    rows = map_texts(sample(docs, labels), ["doc_id", "label"], "text", [T.StructField("x", T.BinaryType())], make, "quality")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x", "label")).alias("r")).select("doc_id", "r.label", "r.x").collect()
    shipped.destroy()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[0]))
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows]) if rows else np.zeros((0, 3 * DIMENSIONS + 1))
    return vectors, train(x, np.array([r[1] for r in rows]))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, only: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (or only those named) with the score, all rows: __score, with more underscores if docs has such."""
    [score] = unused(docs, SCORE)
    shipped = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def make(texts: list[str | None]) -> list[pa.Array]:
        table, net = shipped.value
        return [pa.array(net.probabilities(pooled(texts, table, _CODES)))]

    return map_texts(docs, list(docs.columns if only is None else only), "text", [T.StructField(score, T.DoubleType())], make, "quality")


def accepted(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """docs without the rows that score below THRESHOLD."""
    [score] = unused(docs, SCORE)
    return scored(docs, vectors, network).filter(F.col(score) >= THRESHOLD).select(*quoted(*docs.columns))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all rows of docs."""
    found = scored(docs, *fit(docs, labels), only=("doc_id",)).toDF("doc_id", "score")
    p = F.col("score")
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), p.alias("score"), (p >= THRESHOLD).cast("int").alias("predicted"))
